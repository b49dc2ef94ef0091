"""Sources and sinks: table schemas, loaders, fixture derivation, writers."""

from .loader import (Tables, cached_fixture_tables, conform, driver_tables, fixture_tables,
                     read_jdbc, read_tables, write_tables)
from .schemas import DOCTYPES, SCHEMAS, TABLES

__all__ = [
    "Tables", "cached_fixture_tables", "conform", "driver_tables", "fixture_tables", "read_jdbc",
    "read_tables", "write_tables", "DOCTYPES", "SCHEMAS", "TABLES",
]
