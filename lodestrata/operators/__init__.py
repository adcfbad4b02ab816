"""DataFrame operators: each takes and returns DataFrames and fits any table of the named columns."""
