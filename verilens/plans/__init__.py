"""Bindings of operators to the given tables, each beside its DuckDB check."""
