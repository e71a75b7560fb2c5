"""askframe: plain-English questions over tabular data, planned and executed on Spark."""
