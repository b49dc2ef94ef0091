"""Sharding by sampled splitters, with sizes near equal (the law ``bytes``).

1. Each row has a key, the 64-bit hash of its text, so equal texts lie together
   in key order, and a size, its text's UTF-8 bytes plus one.  Rows alike in
   doc_id and text are one row with a number until the end, so no group of
   them is ranked by one task.
2. A size-weighted sample of keys is drawn by a hash of the row (a row of size
   s is drawn with probability min(1, s * rate)); the rate makes its expected
   number ``ranges * SAMPLES_PER_RANGE`` whatever the table's size.  Quantiles of the
   sample cut the key order into ``ranges`` ranges of nearly equal bytes.
3. Rows are dealt to their ranges.  The bytes of every range are summed; an
   overfull one (a group of equal texts, a long document) is subdivided by a
   hash of doc_id and key into parts of about the target size, a range's share of all bytes
   but ``PART_BYTES`` at most, so that the number of parts grows with the input.
4. Running sums inside each part, on top of the sums of the parts before it,
   give every row its exact place in the whole order.  A row goes to the shard
   in which the middle of its bytes falls, so a shard's bytes miss total/shards
   by less than the largest row.  Slots number a shard's rows from 0 in order.

Only DataFrame functions run.  The driver gets the sample's quantiles, bounded by
``ranges``, and two sums.

Defined results: a null text has no bytes (size 1, text_crc32 0).  Rows with a null doc_id or
repeating one are rows like others.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
RANGES = 256
SAMPLES_PER_RANGE = 64
#: Most bytes of text in a part, far below what a task can rank: only sizes and hashes are ranked.
PART_BYTES = 1 << 31


def _sized(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def _range_of(key: Column, bounds: list[int], low: int = 0) -> Column:
    """Number of bounds at or below the key, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _range_of(key, bounds[:mid], low)).otherwise(_range_of(key, bounds[mid + 1 :], low + mid + 1))


def splitters(sized: DataFrame, ranges: int = RANGES) -> tuple[list[int], int]:
    """Quantile boundaries of a size-weighted key sample, and the sum of all sizes; sized: doc_id, key, size, times."""
    total = sized.agg(F.sum(F.col("size") * F.col("times"))).first()[0] or 0
    rate = ranges * SAMPLES_PER_RANGE / max(total, 1)
    draw = F.pmod(F.xxhash64(F.lit(29), "doc_id", "key"), F.lit(1 << 40)) / float(1 << 40)
    cuts = [i / ranges for i in range(1, ranges)]
    found = sized.where(draw < F.col("size") * F.col("times") * rate).agg(F.percentile_approx("key", cuts, 10 * ranges)).first()[0]
    return sorted(set(found or [])), total


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    sized = _sized(docs).groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("times"))
    bounds, total = splitters(sized, ranges)
    ranged = sized.withColumn("range", _range_of(F.col("key"), bounds)).withColumn("all", F.col("size") * F.col("times"))
    target = min(max(total / ranges, 1.0), float(part_bytes))
    # At most one row per range.
    held = ranged.groupBy("range").agg(F.sum("all").alias("bytes"))
    parts = held.select("range", F.greatest(F.lit(1), F.round(F.col("bytes") / F.lit(target))).cast("int").alias("parts"))
    split = ranged.join(F.broadcast(parts), "range").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(F.lit(31), "doc_id", "key"), F.col("parts"))).otherwise(0).cast("int"))
    # The bytes of a part decide where it starts in the whole order.
    sums = split.groupBy("range", "part").agg(F.sum("all").alias("bytes"), F.sum("times").alias("rows"))
    ahead = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", "part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("range", "part").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        split.withColumn("bytes_in", F.coalesce(F.sum("all").over(inside), F.lit(0)))
        .withColumn("rows_in", F.coalesce(F.sum("times").over(inside), F.lit(0)))
        .join(starts, ["range", "part"])
        .withColumn("time", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
        .withColumn("middle", F.col("bytes_before") + F.col("bytes_in") + (F.col("time") + 0.5) * F.col("size"))
        .withColumn("shard", F.least(F.floor(F.col("middle") * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int"))
        .withColumn("row", F.col("rows_before") + F.col("rows_in") + F.col("time"))
    )
    # At most one row per shard.
    heads = placed.groupBy("shard").agg(F.min("row").alias("head"))
    return placed.join(F.broadcast(heads), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("head")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
