"""MinHash near-dedup of texts by BagMinHash (weighted Jaccard of word shingles).

1. One pass signs every text: 100 BagMinHash slots of its multiset of five-word
   shingles, folded into 20 bands of 5, and a 128-bit fingerprint of its words.
2. Texts of the same words fold into their smallest doc_id first, so copies,
   however many, go on as one.
3. Texts sharing a band are linked to the smallest id of that band's bucket (a
   grouped minimum, no pairs); connected components of these links hold every
   pair that shares a band.
4. Inside each component the exact multiset overlap of all texts is computed in
   blocks of bounded size (a matrix product over the shingles that at least two
   texts have).  Components over ``block`` texts are cut into blocks and every
   pair of blocks is one task, so no task holds an unbounded group.  A block
   emits at most one link a text, to the smallest text it is joined with in
   the block: links are not listed, but none between different texts is lost.
5. Connected components of the verified links are the classes.

Defined results: null texts and rows with a null doc_id link with nothing (a
null doc_id has a null class and is kept).  Texts without words are copies of
each other.  Texts of one to four words have one shingle, all their words.
Rows that repeat a doc_id share its class.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.llm import bagminhash as B
from salesops.llm.graph import components, stored
from salesops.llm.tasks import map_arrow
from salesops.llm.text import U64, chunks, mix, powers, words

THRESHOLD = 0.8
BLOCK = 512
_SIGNED = "doc_id long, f1 long, f2 long, bands array<long>"


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, word fingerprint (f1, f2) and band hashes of every text that is not null."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words(part.column("text"))
                h = w.hashes()
                bands = B.band_hashes(B.signatures(*B.bags(*B.shingles(w, h)), part.num_rows)).view(np.int64)
                place = np.arange(len(h)) - np.repeat(w.first[:-1], np.diff(w.first))
                weight = mix(powers(0x2545F4914F6CDD1D, int(place.max(initial=0)) + 1)[place])
                prints = []
                for v in (h, w.hashes(1)):
                    total = np.append(np.zeros(1, U64), np.cumsum(mix(v ^ weight)))
                    prints.append(mix(total[w.first[1:]] - total[w.first[:-1]] + np.diff(w.first).astype(U64)).view(np.int64))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32)), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints[0]), pa.array(prints[1]), flat], names=["doc_id", "f1", "f2", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows.where("doc_id is not null and text is not null"), run, _SIGNED)


def _links(members: list[tuple[int, np.ndarray, np.ndarray]], cross: np.ndarray | None, threshold: float) -> list[tuple[int, int]]:
    """Links (text, smallest text joined with it) of one block: the pairs with exact overlap of ``threshold`` or more.

    members: doc_id, sorted shingles, counts.  cross: the side of each member if only pairs across two blocks are asked for."""
    ids = np.array([m[0] for m in members])
    n = len(ids)
    size = np.array([m[2].sum() for m in members], float)
    lens = [int(m[2].sum()) for m in members]
    row = np.repeat(np.arange(n), lens)
    count = np.concatenate([m[2] for m in members])
    key = np.repeat(np.concatenate([m[1] for m in members]), count)
    nth = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
    key = mix(key + nth.astype(U64) * U64(0x9E3779B97F4A7C15)) if nth.any() else key
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    new = np.append(True, key[1:] != key[:-1])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    new_column = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], new_column[column[keep]]
    both = np.zeros((n, n))
    step = max(1, (8 << 20) // max(n, 1))
    for low in range(0, int(often.sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        m = np.zeros((n, step), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        both += m @ m.T
    close = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    close &= both > 0
    if cross is not None:
        close &= cross[:, None] != cross[None, :]
    np.fill_diagonal(close, True)
    label = ids.copy()
    big = np.iinfo(ids.dtype).max
    while True:
        low = np.where(close, label[None, :], big).min(axis=1)
        if (low == label).all():
            break
        label = low
    return [(int(i), int(s)) for i, s in zip(ids, label, strict=True) if i != s]


def verified_links(candidates: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between texts of one candidate group; candidates: doc_id, text, grp, n_grp (texts in the group)."""

    def run_bags(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                bags = B.text_bags(part.column("text"))
                names = [c for c in part.schema.names if c != "text"]
                packed = [pa.array([v.tobytes() for v, _ in bags], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in bags], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + packed, names=[*names, "shingles", "counts"])

    # Groups of up to one block are packed about a block to a task unit; larger ones are cut, and each pair of blocks is a unit.
    cuts = F.ceil(F.col("n_grp") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(11), "doc_id"), cuts).cast("int")
    placed = candidates.select("doc_id", "grp", cuts.alias("cuts"), own.alias("own"), "text")
    bags = map_arrow(placed, run_bags, "doc_id long, grp long, cuts int, own int, shingles binary, counts binary")
    pair = F.when(F.col("cuts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j"))))
    units = bags.withColumn("pair", F.explode(pair)).select("doc_id", "grp", "own", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "shingles", "counts")

    def run_links(batches):
        held: dict[tuple, list] = {}
        last = None

        def links(part: list) -> list[tuple[int, int]]:
            (i, j), members = part[0], [(d, np.frombuffer(s, U64), np.frombuffer(c, np.int32)) for _, _, d, s, c in part[1]]
            return _links(members, None if i == j else np.array([m[1] for m in part[1]]), threshold) if len(members) > 1 else []

        def flush(unit):
            out = links([(unit[1], unit[2]), held.pop(unit)])
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("grp", "i", "j", "own", "doc_id", "shingles", "counts")]
            for g, i, j, o, d, s, c in zip(*cols, strict=True):
                unit = (g, i, j)
                if last is not None and unit != last:
                    yield flush(last)
                held.setdefault(unit, []).append((g, o, d, s, c))
                last = unit
        if last is not None:
            yield flush(last)

    # Rows of one unit come together: hash-partitioned by unit and sorted by it within the partition.
    together = units.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return map_arrow(together, run_links, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its class) and kept (doc_id = class_id, or null)."""
    signed = stored(sign(docs))
    # Texts of the same words: one goes on.
    same = stored(signed.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    first = signed.join(same.select("f1", "f2", "rep"), ["f1", "f2"])
    reps = first.where("doc_id = rep").select("doc_id", "bands")
    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "hash"))
    hubs = banded.groupBy("band", "hash").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub < top").select("band", "hash", "hub")
    grouped = components(banded.join(hubs, ["band", "hash"]).where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    sizes = grouped.groupBy("component").agg((F.count("*") + 1).alias("n_grp"))
    members = grouped.union(sizes.select(F.col("component").alias("node"), "component")).join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("grp"), "n_grp")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # A merge join at every size: the texts move once, in proportion to the input, and skewed partitions can be split.
    near = components(verified_links(members.join(texts.hint("merge"), "doc_id"), threshold, block))
    classes = first.select("doc_id", "rep").distinct().join(near.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    # A doc_id that comes with different texts takes its smallest class.
    classes = classes.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(classes, "doc_id", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that represent their class, all columns kept; of rows repeating a doc_id and text, one."""
    drop = near_duplicates(docs, threshold).where("not kept").select(F.col("doc_id").alias("__drop")).distinct()
    left = docs.join(drop, docs["doc_id"] == drop["__drop"], "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return left
    again = stored(again)
    once = left.join(again, left["doc_id"] == again["__again"], "left_anti")
    return once.unionByName(left.join(again, left["doc_id"] == again["__again"], "left_semi").dropDuplicates(["doc_id", "text"]))
