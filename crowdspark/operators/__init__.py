"""People-flow operators: each takes DataFrames and returns one."""
