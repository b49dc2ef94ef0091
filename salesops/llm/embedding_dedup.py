"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors of one label link if their cosine, in double precision, is 0.98 or
more.  A normalised vector falls into one bucket of each of ``TABLES`` tables:
``PROJECTIONS`` Gaussian projections, shifted and cut into steps of ``WIDTH``.  Two vectors
of cosine 0.98 lie 0.2 apart; with a step of 1.6 one projection agrees with
probability 0.90, all eight of a table with 0.43, and 20 tables miss the pair
with probability 0.00001.

Equal vectors of a label go on as one, with their number.  Buckets travel narrow,
as (bucket, row, sketch): a sketch holds the vector's coordinates along ``AXES``
orthonormal directions, a byte each.  Linked vectors are within 0.2 of each other,
so also along these directions; that leaves few of the pairs that a bucket
brings together by chance, and only rows with such a pair are joined with their
vectors.  Buckets over ``block`` rows are cut into blocks and every pair of blocks
is one unit of work, in both steps; so no task holds an unbounded bucket.  Cosines are
matrix products.  A pair counts in the first table that brings it
together only, so links are summed without listing pairs: a unit emits one row per linked
vector, its number of links and the smallest row it is joined with.

Defined results: null vectors, zero vectors, vectors with null or non-finite
components and vectors with a null label or vec_id link with nothing and are
their own component.  Vectors of different lengths never link.  Rows repeating
a vec_id are vectors of their own, each with its own links; a component is named by
the smallest vec_id in it.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.llm.graph import components, stored
from salesops.llm.tasks import map_arrow
from salesops.llm.text import mix

THRESHOLD = 0.98
TABLES, PROJECTIONS, WIDTH = 20, 8, 1.6
BLOCK = 512
SEED = 20
#: Directions of a sketch, a byte each; steps of a sketch within a unit length.
AXES, STEPS = 8, 100


def usable(vector: str = "embedding"):
    """A vector that is not null and has only finite components."""
    x = F.col(vector)
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def _buckets(x: np.ndarray) -> np.ndarray:
    """Rows x TABLES bucket hashes of normalised vectors."""
    rng = np.random.default_rng([SEED, x.shape[1]])
    a = rng.standard_normal((x.shape[1], TABLES * PROJECTIONS))
    b = rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    step = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), TABLES, PROJECTIONS)
    odd = rng.integers(1, 2**63, PROJECTIONS) | 1
    with np.errstate(over="ignore"):
        mixed = (step * odd).sum(axis=2)
        return mixed ^ (mixed >> 29)


def _axes(length: int) -> np.ndarray:
    """Up to ``AXES`` orthonormal directions, as columns."""
    rng = np.random.default_rng([SEED + 1, length])
    return np.linalg.qr(rng.standard_normal((length, min(AXES, length))))[0]


def _sketches(x: np.ndarray) -> np.ndarray:
    """Coordinates of normalised vectors along the axes in whole steps, packed into a long."""
    at = np.zeros((len(x), 8), np.int8)
    steps = np.rint(x @ _axes(x.shape[1]) * STEPS)
    at[:, : steps.shape[1]] = steps
    return at.view(np.int64).ravel()


def _reach(threshold: float) -> float:
    """Greatest distance of the sketches of two vectors at the threshold, in steps: their own, and half a step of rounding at either end of each axis."""
    return float(np.sqrt(max(2 - 2 * threshold, 0.0)) * STEPS + np.sqrt(AXES) + 1e-6)


def hashed(distinct: DataFrame) -> DataFrame:
    """Adds the buckets (one key per table, told apart by label, length and table) and the sketch; distinct: rep, label, n, embedding."""
    kind = distinct.schema["embedding"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths[lengths > 0]).tolist():
                part = batch.filter(pa.array(lengths == size))
                x = _matrix(part.column("embedding"), size)
                norm = np.sqrt((x * x).sum(axis=1))
                some = (norm > 0) & np.isfinite(norm)
                part, x = part.filter(pa.array(some)), x[some] / norm[some][:, None]
                if not len(x):
                    continue
                labels = part.column("label").to_numpy().astype(np.int64)
                keys = mix((_buckets(x) + np.arange(TABLES) * 0x51ED27).view(np.uint64)) ^ mix((labels * 1_000_003 + size).view(np.uint64) + np.uint64(SEED))[:, None]
                found = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * TABLES + 1, TABLES, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "label", "n", "embedding")), found, pa.array(_sketches(x))], names=["rep", "label", "n", "embedding", "buckets", "sketch"])

    return map_arrow(distinct, run, f"rep long, label int, n long, embedding {kind}, buckets array<long>, sketch long")


def _linked(key: int, rep: np.ndarray, n: np.ndarray, label: np.ndarray, x: np.ndarray, buckets: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of one unit with new links: rep, number of links, smallest vector joined with."""
    norm = np.sqrt((x * x).sum(axis=1))
    linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
    np.fill_diagonal(linked, False)
    linked &= label[:, None] == label[None, :]
    if side is not None:
        linked &= side[:, None] != side[None, :]
    if linked.any():
        for t in range(int(np.flatnonzero(buckets[0] == key)[0])):
            linked &= buckets[:, t][:, None] != buckets[:, t][None, :]
    links = linked @ n
    some = links > 0
    low, top = rep.copy(), np.iinfo(np.int64).max
    while some.any():
        least = np.minimum(low, np.where(linked, low[None, :], top).min(axis=1))
        if (least == low).all():
            break
        low = least
    return rep[some], links[some], low[some]


UNIT = ["key", "i", "j"]


def _units(batches, columns: list[str]):
    """Key and rows of each unit of rows sorted by ``UNIT``; units of one row are left out."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in UNIT]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cut = np.append(np.flatnonzero(new), batch.num_rows)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            this = tuple(int(c[a]) for c in cols)
            if last is not None and this != last:
                if sum(h.num_rows for h in held) > 1:
                    yield last, pa.Table.from_batches(held).select(columns).combine_chunks()
                held = []
            last = this
            held.append(batch.slice(a, b - a))
    if held and sum(h.num_rows for h in held) > 1:
        yield last, pa.Table.from_batches(held).select(columns).combine_chunks()


def candidates(signed: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """key, i, j, own, rep of rows that a bucket brings near another one, by unit of work."""
    banded = signed.select(F.explode("buckets").alias("key"), "rep", "sketch")
    sizes = signed.select(F.explode("buckets").alias("key")).groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    placed = banded.join(sizes, "key").withColumn("cuts", F.ceil(F.col("size") / F.lit(block)).cast("int")).withColumn("own", F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("cuts")).cast("int"))
    pair = F.when(F.col("cuts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j"))))
    units = placed.select("key", "own", "rep", "sketch", F.explode(pair).alias("pair")).select("key", "pair.i", "pair.j", "own", "rep", "sketch")
    reach = _reach(threshold) ** 2

    def run(batches):
        out, rows = [], 0
        for (key, i, j), t in _units(batches, ["own", "rep", "sketch"]):
            x = t.column("sketch").to_numpy().reshape(-1, 1).view(np.int8).astype(np.float64)
            own, rep = t.column("own").to_numpy(), t.column("rep").to_numpy()
            square = (x * x).sum(axis=1)
            near = square[:, None] + square[None, :] - 2 * (x @ x.T) <= reach
            np.fill_diagonal(near, False)
            if i != j:
                near &= own[:, None] != own[None, :]
            some = near.any(axis=1)
            n = int(some.sum())
            if n:
                out.append((np.full(n, key), np.full(n, i, np.int32), np.full(n, j, np.int32), own[some].astype(np.int32), rep[some]))
                rows += n
            if rows > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=[*UNIT, "own", "rep"])
                out, rows = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=[*UNIT, "own", "rep"])

    return map_arrow(units.repartition(*UNIT).sortWithinPartitions(*UNIT), run, "key long, i int, j int, own int, rep long")


def links(signed: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Rows (rep, links, low) of linked vectors, by unit of work."""
    near = stored(candidates(signed, threshold, block))
    units = near.join(signed.drop("sketch"), "rep")

    def run(batches):
        for (key, i, j), rows in _units(batches, ["own", "rep", "n", "label", "embedding", "buckets"]):
            get = lambda c: rows.column(c).to_numpy()
            vectors = rows.column("embedding").combine_chunks()
            x = _matrix(vectors, len(vectors[0]))
            found = _linked(key, get("rep"), get("n"), get("label"), x, rows.column("buckets").combine_chunks().flatten().to_numpy().reshape(-1, TABLES), get("own") if i != j else None, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["rep", "links", "low"])

    return map_arrow(units.repartition(*UNIT).sortWithinPartitions(*UNIT), run, "rep long, links long, low long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    # Floats stay floats on the way; products are taken in double precision.
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("int").alias("label"))
    fit = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("embedding", lambda v: v != 0)
    told = rows.withColumn("fit", fit)
    grouped = told.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # Numbered where they are written; everything else reads the written rows.
    same = stored(grouped.withColumn("rep", F.monotonically_increasing_id()))
    found = stored(links(stored(hashed(same.select("rep", "label", "n", "embedding"))), threshold, block))
    joined = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    summed = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = same.select("rep", "least").join(summed, "rep", "left").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = linked.join(named, "component").select("rep", F.coalesce("links", F.lit(0)).alias("links"), "component_id")
    facts = same.select("rep", "label", "embedding", "n").join(facts, "rep").select("label", "embedding", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id")
    fitted = told.where("fit").join(facts, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = told.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fitted.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
