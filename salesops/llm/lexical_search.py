"""Ranked lexical search, reversed: documents stream through an index of the items.

1. Items (the standing queries) are cut into blocks of at most ``BLOCK_TERMS``
   (item, term) pairs or one item; each block's distinct pairs make an inverted
   index, term to items, that is broadcast: its size is bounded by the block.
2. One pass over the documents keeps, of each whole text, its number of terms and
   the counts of the terms that the index knows.  These narrow rows are stored.  N
   (documents with a term), L (all terms) and the document frequency of every
   indexed term are sums over all documents.
3. The stored counts stream through the index: a term's count and weight give a
   number that is added to every item of its posting list.  Each task holds one
   heap of ``k`` documents an item and passes on a document only if it beats the
   heap's last.
4. The tasks' heaps, at most k rows an item and task, are merged by rank.

Terms are runs of ASCII letters and digits and of all code points from 0x80,
A-Z lower-cased.  A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))); a
document's m is 100 - 90 + (90 * n * N) div L; the score sums weight *
((10**9 * tf) div (1000 * tf + 8 * m)) over the item's terms, in integers.

Terms are told apart by two independent 64-bit hashes.  Defined results: null
texts have no terms.  Items without a term, or whose terms no document has,
return nothing.  Rows that repeat an item_id are one item with the terms of all
of them, null item_ids too.  Rows that repeat a doc_id are documents of their
own; a null doc_id comes last among equal scores.  Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesops.llm.graph import stored
from salesops.llm.tasks import map_arrow
from salesops.llm.text import Words, chunks, words

K = 10
#: Most (item, term) pairs of one broadcast index, but one item stays whole.
BLOCK_TERMS = 1_000_000
#: Cells (document x item) scored at once.
CELLS = 1 << 20
#: Stands for a null doc_id in comparisons.
LAST = np.iinfo(np.int64).max

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def terms(texts: pa.Array) -> Words:
    """The terms of a string array, lower-cased."""
    found = words(texts, _OUTSIDE)
    found.data = _LOWER[found.data]
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct item_id, h and g (two hashes) of every term of the items."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                w = terms(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(w.doc)), pa.array(w.hashes(0).view(np.int64)), pa.array(w.hashes(1).view(np.int64))], names=["item_id", "h", "g"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "item_id long, h long, g long").distinct()


class Index:
    """Term hashes in order, the items of each term, and the items' ids."""

    def __init__(self, item: np.ndarray, h: np.ndarray, g: np.ndarray, ids: list):
        order = np.lexsort((item, g, h))
        item, h, g = item[order], h[order], g[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        self.h, self.g = h[new], g[new]
        self.first = np.append(np.flatnonzero(new), len(h))
        self.item, self.ids = item, ids
        if (self.h[1:] == self.h[:-1]).any():
            raise ValueError("two item terms share a hash")

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that the index has, and their terms."""
        if not len(self.h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h, g = w.hashes(0).view(np.int64), w.hashes(1).view(np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = np.flatnonzero((self.h[at] == h) & (self.g[at] == g))
        return hit, at[hit]


def item_blocks(pairs: DataFrame, most: int = BLOCK_TERMS) -> tuple[DataFrame, int]:
    """``pairs`` with the number of the block that its item belongs to, and the number of blocks."""
    total = pairs.count()
    blocks = max(1, -(-2 * total // most)) if total > most else 1
    return pairs.withColumn("block", F.pmod(F.xxhash64(F.lit(53), "item_id"), F.lit(blocks)).cast("int")), blocks


def _index(pairs: DataFrame) -> Index:
    held = pairs.select("item_id", "h", "g").toArrow()
    ids = sorted(set(held.column("item_id").to_pylist()), key=lambda i: (i is None, i or 0))
    place = {v: i for i, v in enumerate(ids)}
    item = np.array([place[v] for v in held.column("item_id").to_pylist()], np.int64)
    return Index(item, held.column("h").to_numpy().astype(np.int64), held.column("g").to_numpy().astype(np.int64), ids)


def counted(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n, and the indexed terms of every document with their counts."""
    index_ = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = index_.value
        for batch in batches:
            for part in chunks(batch, "text"):
                w = terms(part.column("text"))
                hit, term = index.find(w)
                key, tf = np.unique(w.doc[hit] * len(index.h) + term, return_counts=True)
                cut = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * max(len(index.h), 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(w.first).astype(np.int64)), pa.ListArray.from_arrays(cut, pa.array((key % max(len(index.h), 1)).astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int64)))],
                    names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n long, terms array<int>, counts array<long>")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The documents' m."""
    if len(n) and 90 * int(n.max()) * documents >= 1 << 63:
        return np.array([10 + 90 * int(x) * documents // total for x in n], np.int64)
    return 10 + (90 * n * documents) // max(total, 1)


class Heaps:
    """The best ``k`` documents of every item: higher scores first, then smaller ids."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)

    def offer(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = np.flatnonzero((score > 0) & (score >= self.least[item]))
        for i, d, s in zip(item[good].tolist(), doc[good].tolist(), score[good].tolist(), strict=True):
            heap, entry = self.held[i], (s, -d)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def rows(self) -> tuple[list[int], list[int], list[int]]:
        found = [(i, -d, s) for i, heap in enumerate(self.held) for s, d in heap]
        return ([f[0] for f in found], [f[1] for f in found], [f[2] for f in found])


def streamed(told: DataFrame, index: Index, weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """item_id, doc_id, score: each task's heaps after its documents went through the index."""
    index_ = told.sparkSession.sparkContext.broadcast((index, weight))

    def run(batches):
        index, weight = index_.value
        items = len(index.ids)
        heaps, step = Heaps(items, k), max(1, CELLS // max(items, 1))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                ids = batch.column("doc_id").fill_null(LAST).to_numpy()
                m = lengths(batch.column("n").to_numpy(), documents, total)
                held = batch.column("terms").value_lengths().to_numpy()
                doc = np.repeat(np.arange(batch.num_rows), held)
                term, tf = batch.column("terms").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
                value = weight[term] * ((10**9 * tf) // (1000 * tf + 8 * m[doc]))
                # Every count is added to all items of its term's posting list.
                many = index.first[term + 1] - index.first[term]
                posting = np.repeat(index.first[term] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                cell = np.repeat(doc, many) * items + index.item[posting]
                # Integers up to 2**53 are exact in these sums: a term adds at most 10**6 times its weight.
                score = np.bincount(cell, np.repeat(value, many), batch.num_rows * items).astype(np.int64)
                some = np.flatnonzero(score)
                heaps.offer(some % items, ids[some // items], score[some])
        item, doc, score = heaps.rows()
        found = pa.array([None if d == LAST else d for d in doc], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([index.ids[i] for i in item], pa.int64()), found, pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return map_arrow(told, run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, most: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every item with a score above 0."""
    pairs, blocks = item_blocks(stored(item_terms(items)), most)
    found = None
    for b in range(blocks):
        index = _index(pairs.where(F.col("block") == b))
        told = stored(counted(docs, index))
        sums = told.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("total")).first()
        documents, total = sums["documents"], sums["total"] or 0
        df = np.zeros(len(index.h), np.int64)
        # At most one row per indexed term.
        for r in told.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
            df[r["term"]] = r["df"]
        rows = streamed(told.where(F.size("terms") > 0), index, weights(df, documents), documents, total, k)
        found = rows if found is None else found.union(rows)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
