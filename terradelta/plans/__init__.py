"""Registered queries: operators applied to the tables, with DuckDB twins."""
