"""Stored intermediate tables and connected components, both on Spark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Share of the rows beyond which a key is a hub.
HUB_SHARE = 1 / 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and the session is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _write(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: the lineage is cut and a lost executor loses nothing."""
    path = _write(df)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Removes a table that ``_write`` made and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def with_least(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """``rows`` with ``m``, the smallest ``value`` of their ``key``; ``most`` is an upper bound of the number of rows.

    Keys with more than a ``HUB_SHARE`` of the bound (so less than 1 / HUB_SHARE of
    them) are not shuffled: their minima are broadcast to where the rows lie."""
    low = rows.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("__n"))
    hub = F.col("__n") > max(most * HUB_SHARE, 1.0)
    hubs = F.broadcast(low.where(hub).select(F.col(key).alias("__hub"), "m"))
    marked = rows.join(hubs, F.col(key) == F.col("__hub"), "left")
    near = marked.where("__hub is not null").drop("__hub")
    far = marked.where("__hub is null").drop("__hub", "m").join(low.where(~hub).select(key, "m"), key)
    return near.unionByName(far)


def numbered(df: DataFrame, *order) -> DataFrame:
    """Adds ``number``, each row's place from 0 in the order of the columns: rows are dealt into ranges and numbered in each, and one row a range tells how many come before it."""
    ranged = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("number", inside - 1).join(before, "__range").withColumn("number", F.col("number") + F.col("__before")).drop("__range", "__before")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b), as rows (node, component) of every node but the smallest of each component, which names it.

    Alternating large and small stars: each round links every neighbour of a
    node to the smallest node it sees, until only stars are left.  A round is
    two grouped minima and two joins on small rows, hubs apart (``with_least``); its table
    replaces that of the round before.  Nothing reaches the driver
    but a count and a checksum.  Null ends and self links are ignored.
    """
    spark = edges.sparkSession

    def star(rows: DataFrame) -> tuple[str, DataFrame]:
        path = _write(rows.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
        return path, spark.read.schema("a long, b long").parquet(path)

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    path, e = star(edges.where("a <> b"))
    seen = state(e)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = with_least(both, "u", "v", 2 * seen[0]).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        large_path, large = star(large)
        small = with_least(large, "a", "b", 2 * seen[0])
        last, (path, e) = path, star(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))))
        now = state(e)
        _remove(spark, last)
        _remove(spark, large_path)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
