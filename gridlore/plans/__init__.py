"""Named queries and their DuckDB equivalents."""
