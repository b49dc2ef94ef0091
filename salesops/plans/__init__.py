"""The reports, the registry of queries and their DuckDB oracles."""
