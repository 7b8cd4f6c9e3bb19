"""Registered queries and their DuckDB counterparts, grouped by topic."""
