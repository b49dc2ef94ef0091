"""Stored tables laid out for the reports.

Balances are sums by party, so the fact tables are bucketed by their party column,
all into the same number of buckets: aggregations by party and the joins between
them then need no exchange of ledger, payments, invoices or journal lines.  Inside a
bucket rows are sorted by the date that reports cut by, so row groups (and
pages) before the ledger cut-off are skipped by their statistics.

Each bucket is written by one task as one file; the number of buckets is what
sets a file's size (64 to 512 MB each is a good aim).  A party that holds a large share
of the rows makes a large bucket: the sums over it are partial sums taken
while its file is read, so it costs time to read and no memory.

Spark keeps bucketing in its catalog.  ``write_layout`` stores the files and
``read_layout`` declares them as external tables of the session's catalog, so any later
session can read them by path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .loader import Tables, read_tables
from .schemas import SCHEMAS


@dataclass(frozen=True)
class Layout:
    """Bucket column and the sort inside a bucket."""

    bucket: str
    sort: tuple[str, ...]


#: Fact tables by party; dates are those of the reports' cut-offs.
LAYOUTS: dict[str, Layout] = {
    "gl_entry": Layout("party", ("creation",)),
    "payment_entry": Layout("party", ("creation",)),
    "sales_invoice": Layout("customer", ("posting_date",)),
    "journal_entry_account": Layout("party", ()),
}


def table_name(path: str, name: str) -> str:
    """Catalog name of a table stored under ``path``."""
    return f"crm_{hashlib.sha256(path.encode()).hexdigest()[:12]}_{name}"


@contextmanager
def timestamps_with_statistics(spark: SparkSession) -> Iterator[None]:
    """Parquet files get timestamps in microseconds: the default, INT96, has no statistics, so no cut-off could skip any of them."""
    key = "spark.sql.parquet.outputTimestampType"
    held = spark.conf.get(key)
    spark.conf.set(key, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        spark.conf.set(key, held)


def write_layout(tables: Mapping[str, DataFrame], path: str, buckets: int, layouts: Mapping[str, Layout] = LAYOUTS,
                 row_group_bytes: int | None = None) -> None:
    """Write each table under ``path``, those of ``layouts`` in ``buckets`` buckets.

    A NULL party is a bucket's row like others.  An existing table of the same path is replaced."""
    for name in tables:
        df, where = tables[name], f"{path}/{name}.parquet"
        plan = layouts.get(name)
        with timestamps_with_statistics(df.sparkSession):
            if plan is None:
                df.write.mode("overwrite").parquet(where)
                continue
            # the rows of a bucket lie in one task, by the same hash that buckets them
            writer = df.repartition(buckets, F.col(plan.bucket)).write.mode("overwrite").format("parquet").option("path", where)
            if row_group_bytes:
                writer = writer.option("parquet.block.size", row_group_bytes)
            writer = writer.bucketBy(buckets, plan.bucket).sortBy(*(plan.sort or (plan.bucket,)))
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table_name(path, name)}")
            writer.saveAsTable(table_name(path, name))


def read_layout(spark: SparkSession, path: str, buckets: int, layouts: Mapping[str, Layout] = LAYOUTS) -> Tables:
    """The tables that ``write_layout`` stored under ``path`` with the same buckets and layouts."""
    tables = read_tables(spark, path)
    for name, plan in layouts.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[name].fields)
        sort = ", ".join(f"`{c}`" for c in plan.sort or (plan.bucket,))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table_name(path, name)} ({columns}) USING parquet "
                  f"CLUSTERED BY (`{plan.bucket}`) SORTED BY ({sort}) INTO {buckets} BUCKETS LOCATION '{path}/{name}.parquet'")
        tables = tables.with_table(name, spark.table(table_name(path, name)))
    return tables
