"""salesops: sales-team CRM reports as lazy Spark DataFrame plans.

Subpackages: ``sources`` (schemas, loaders, fixture derivation, writers),
``functions`` (calendar and number Column expressions), ``operators``
(filters, joins, aggregates, windows, metrics, report shaping) and ``plans``
(the six reports, the query registry and their DuckDB oracles).
"""

from .config import Config

__all__ = ["Config"]
