"""Load the CRM tables as DataFrames.

``Tables`` is a lazy name -> DataFrame mapping: a table is planned the first
time a report asks for it, so a report only touches the tables it reads and
Catalyst prunes each scan to the columns it uses.

Sources:
* ``read_tables``   parquet/orc/... files, one folder or file per table, read
                    with the explicit schema of ``schemas.SCHEMAS``.
* ``read_jdbc``     a live site database, ``tab<DocType>`` tables, fact tables
                    in parallel slices.
* ``fixture_tables`` tables derived from the driver's TPC-H-style files.
Sink: ``write_tables`` writes any ``Tables`` to a folder (parquet by default).
"""

from __future__ import annotations

import datetime as _dt
import os
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixtures import VIEWS, driver_tables_of
from .schemas import DOCTYPES, SCHEMAS

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Tables(Mapping):
    """Lazy, cached mapping from table name to DataFrame."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name not in self._builders:
                raise KeyError(f"no table {name!r}; have {sorted(self._builders)}")
            self._cache[name] = self._builders[name]()
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(name) from e

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def with_table(self, name: str, df: DataFrame) -> "Tables":
        out = Tables({**self._builders, name: (lambda d=df: d)})
        out._cache.update({k: v for k, v in self._cache.items() if k != name})
        return out


# Columns that hold user ids, by table.
USER_COLUMNS: dict[str, tuple[str, ...]] = {
    "sales_target": ("business_head",), "business_developer": ("bd", "zonal_head"), "sales_person": ("custom_user",),
    "customer": ("account_manager",), "lead": ("lead_owner",), "todo": ("owner",),
    "daily_achievement": ("bd",), "weekly_achievement": ("bd",), "monthly_achievement": ("bd",),
    "quaterly_achievement": ("bd",), "zonal": ("zonal_head",),
}


def fold_users(tables: Mapping[str, DataFrame]) -> Tables:
    """The tables with user ids in lower case, so that joins, groups and the
    visibility rule take ids that differ in case for one."""
    def build(name: str) -> Callable[[], DataFrame]:
        return lambda: tables[name].withColumns({c: F.lower(c) for c in USER_COLUMNS.get(name, ())})

    return Tables({n: build(n) for n in tables})


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast present columns, add missing ones as NULL."""
    have = set(df.columns)
    cols: list[Column] = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_tables(spark: SparkSession, path: str, fmt: str = "parquet",
                names: tuple[str, ...] | None = None, suffix: str | None = None) -> Tables:
    """Tables stored as ``{path}/{name}{suffix}`` in ``fmt`` (default parquet)."""
    suffix = f".{fmt}" if suffix is None else suffix

    def build(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.schema(SCHEMAS[name]).format(fmt).load(os.path.join(path, name + suffix))

    return Tables({n: build(n) for n in (names or tuple(SCHEMAS))})


# Tables that grow with the business: never read over one connection.
FACT_TABLES = ("sales_invoice", "payment_entry", "gl_entry", "journal_entry", "journal_entry_account", "sales_order",
               "opportunity", "lead", "customer", "todo", "event_participants", "daily_achievement",
               "weekly_achievement", "monthly_achievement", "quaterly_achievement", "address", "customer_credit_limit",
               "party_account")


def creation_slices(start: _dt.date, end: _dt.date, slices: int, column: str = "creation") -> list[str]:
    """Predicates that cut a table by its creation time into ``slices`` parts;
    the first takes all before ``start`` and NULL, the last all after ``end``."""
    step = max((end - start).days // max(slices, 1), 1)
    cuts = [start + _dt.timedelta(days=step * i) for i in range(1, max(slices, 1))]
    if not cuts:
        return ["1 = 1"]
    inner = [f"`{column}` >= '{a}' AND `{column}` < '{b}'" for a, b in zip(cuts[:-1], cuts[1:])]
    return [f"`{column}` < '{cuts[0]}' OR `{column}` IS NULL", *inner, f"`{column}` >= '{cuts[-1]}'"]


def jdbc_plan(name: str, partitions: Mapping[str, tuple[str, int, int, int]],
              created: tuple[_dt.date, _dt.date, int] | None) -> tuple[str, object]:
    """How ``read_jdbc`` reads a table: ("range", bounds), ("slices",
    predicates) or ("whole", None); a fact table without bounds or slices is
    refused."""
    if name in partitions:
        return "range", partitions[name]
    if name not in FACT_TABLES:
        return "whole", None
    if created is None:
        raise ValueError(f"{name} is a fact table: give its partitions, or the span of creation dates to slice by")
    return "slices", creation_slices(*created)


def read_jdbc(spark: SparkSession, url: str, properties: dict[str, str],
              partitions: Mapping[str, tuple[str, int, int, int]] | None = None,
              names: tuple[str, ...] | None = None,
              created: tuple[_dt.date, _dt.date, int] | None = None) -> Tables:
    """Tables of a live site database (``tab<DocType>``).

    ``partitions`` maps a table to ``(column, lower, upper, num_partitions)``;
    the other fact tables are read in slices by ``creation``, over ``created`` =
    (first day, last day, slices).  Small tables come over one connection.
    """
    def build(name: str) -> Callable[[], DataFrame]:
        def load() -> DataFrame:
            how, what = jdbc_plan(name, partitions or {}, created)
            table = f"`tab{DOCTYPES[name]}`"
            if how == "slices":
                return conform(spark.read.jdbc(url, table, predicates=what, properties=properties), SCHEMAS[name])
            reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
            if how == "range":
                col, lo, hi, n = what
                reader = (reader.option("partitionColumn", col).option("lowerBound", lo)
                          .option("upperBound", hi).option("numPartitions", n))
            return conform(reader.load(), SCHEMAS[name])
        return load

    return Tables({n: build(n) for n in (names or tuple(SCHEMAS))})


def driver_tables(spark: SparkSession, sf_dir: str) -> Tables:
    def build(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return Tables({n: build(n) for n in DRIVER_TABLES})


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The CRM tables derived from the driver files in ``sf_dir``."""
    src = driver_tables(spark, sf_dir)

    def build(view: str) -> Callable[[], DataFrame]:
        def plan() -> DataFrame:
            bound = {n: src[n] for n in driver_tables_of(view)}
            return conform(spark.sql(VIEWS[view], **bound), SCHEMAS[view])
        return plan

    return Tables({v: build(v) for v in VIEWS})


def write_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet",
                 mode: str = "overwrite", names: tuple[str, ...] | None = None) -> None:
    """Write each table to ``{path}/{name}.{fmt}``."""
    for name in names or tuple(tables):
        tables[name].write.mode(mode).format(fmt).save(os.path.join(path, f"{name}.{fmt}"))


_FIXTURE_CACHE: dict[tuple[int, str], tuple[SparkSession, Tables]] = {}


def cached_fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """``fixture_tables`` memoised per session and folder (plans only, no data).
    The entry keeps its session, so an id can never be reused by another one."""
    key = (id(spark), os.path.abspath(sf_dir))
    hit = _FIXTURE_CACHE.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, fixture_tables(spark, sf_dir))
        _FIXTURE_CACHE[key] = hit
    return hit[1]
