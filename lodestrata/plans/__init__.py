"""Registered queries: the operators applied to the test tables, each with DuckDB SQL of the same rows where SQL can express it."""
