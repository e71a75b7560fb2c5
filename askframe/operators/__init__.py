"""What turns a plan into rows: compiler, runner, gateway, and the learning and evaluation pipelines."""
