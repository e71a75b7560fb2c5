"""Where tables, their descriptions and the logs come from and go to."""
