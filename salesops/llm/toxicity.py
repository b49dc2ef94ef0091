"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

1. Labels come from a bounded sample of labelled rows whose crc32(doc_id as
   text) mod 4 is not 2, drawn by a hash, as many toxic as clean ones at most.
2. A word has one term: its first ``LETTERS`` characters in lower case (insults come
   inflected), dealt by a hash into ``BUCKETS`` buckets.  So every term of every
   text is in the space, whether a labelled row has it or not, and the table
   of document frequencies, counted over all documents, has a fixed size.
3. A text's weight for a term is its count times the inverse document frequency, to
   the powers ``COUNT_POWER`` and ``IDF_POWER`` (chosen on the rows the curve is fitted
   to); vectors have length one over all their terms.
4. Examples lie in blocks of ``BLOCK`` alike ones.  The index keeps postings (term,
   example, weight) and, for common terms (in one of ``COMMON`` examples), the largest
   weight of each block.  Texts are taken in batches.  Postings of the rarer terms, which
   carry most of the weight, are added up first; the block maxima then bound
   what the common ones can still add.  The most promising blocks of each text are
   finished, by matrix products, and then every block whose bound reaches the text's
   k-th cosine: the neighbours are exact.
5. Neighbours vote by closeness, 1 / (0.05 + 1 - cosine), with the labels' share of
   toxic rows as a prior for what the votes lack; a monotone curve fitted to sampled rows that are not
   in the index turns votes into probabilities.  The neighbours are returned as evidence.

Rows are read whole; doc_id, lang, source and labels are never inputs of a
score (doc_id only decides which labels may be learnt from).  Defined results:
null and empty texts and texts without a term of an example have no neighbours and take the
curve's value at no votes.  Rows with a null doc_id are scored and not held
out.  Labels that are null are ignored; a doc_id labelled twice counts as toxic
if one of its labels is.  Without labelled rows every score is 0.  Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesops.llm.graph import stored
from salesops.llm.tasks import map_arrow
from salesops.llm.text import chunks

#: Most labelled rows of each class that are learnt from, examples of each class in the index, rows of each class the curve is fitted to.
SAMPLE, EXAMPLES, CURVE_ROWS = 10_000, 2048, 4096
LETTERS, BUCKETS, COUNT_POWER, IDF_POWER = 4, 1 << 20, 1.25, 2.0
BLOCK, COMMON, AT_ONCE, NEIGHBOURS = 32, 8, 4, 15
PRIOR_VOTES = 1.0
THRESHOLD = 0.3
#: Terms a worker remembers the bucket of, and characters from which a text's words are not held in a list.
KEPT_TERMS, LONG = 400_000, 1 << 22

_BEGINNING = re.compile(rf"(\w{{1,{LETTERS}}})\w*")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


class _Known(dict):
    """Buckets of terms, found once."""

    def __missing__(self, term: str) -> int:
        self[term] = bucket = zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


class Terms:
    """Counts the terms of texts."""

    def __init__(self):
        self.known = _Known()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and count of every term of every text, by row and term."""
        if len(self.known) > KEPT_TERMS:
            self.known.clear()
        known, keys, counts = self.known, [], []
        for row, text in enumerate(texts):
            low = (text or "").lower()
            found = Counter(_BEGINNING.findall(low)) if len(low) < LONG else Counter(m[1] for m in _BEGINNING.finditer(low))
            keys.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)) + row * BUCKETS)
            counts.append(np.fromiter(found.values(), np.int64, len(found)))
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        key, back = np.unique(key, return_inverse=True)
        return key // BUCKETS, key % BUCKETS, np.bincount(back, np.concatenate([np.zeros(0, np.int64), *counts]), len(key))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic, fold and draw of the sampled labelled rows; fold 3 fits the curve, 0 and 1 the index."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marks = marks.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("draw", F.xxhash64(F.lit(41), "doc_id")).withColumn("fold", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).cast("int"))
    each = [stored(marks.where(F.col("toxic") == v).orderBy("draw", "doc_id").limit(sample)) for v in (0, 1)]
    chosen = each[0].union(each[1])
    # At most two samples of four numbers a row.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each term, over all documents, and the number of documents."""

    def run(batches):
        count = Terms()
        for batch in batches:
            seen = np.zeros(BUCKETS + 1, np.int64)
            for part in chunks(batch, "text"):
                seen[:-1] += np.bincount(count(part.column("text").to_pylist())[1], minlength=BUCKETS)
            seen[-1] = batch.num_rows
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["term", "n"])

    # At most one row per bucket.
    rows = map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS + 1)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return out[:-1], int(out[-1])


def idf_of(df: np.ndarray, documents: int) -> np.ndarray:
    return np.log((documents + 1.0) / (df + 1.0)) + 1e-6


def vectors(counted: tuple[np.ndarray, np.ndarray, np.ndarray], idf: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of the texts' vectors of length one."""
    row, term, count = counted
    w = count**COUNT_POWER * idf[term] ** IDF_POWER
    norm = np.sqrt(np.bincount(row, w * w, rows))
    return row, term, w / np.where(norm > 0, norm, 1)[row]


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first..last-1 in turn, and the lengths of the ranges."""
    n = last - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), n


class Postings:
    """Weights of examples by term; common terms as a matrix (examples x terms) with the largest weights by block."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, examples: int):
        order = np.lexsort((example, term))
        example, term, weight = example[order], term[order], weight[order]
        self.examples, self.blocks = examples, -(-examples // BLOCK)
        self.terms, first, many = np.unique(term, return_index=True, return_counts=True)
        common = many * COMMON > max(examples, BLOCK)
        self.place = np.where(common, np.cumsum(common) - 1, -1)
        own = self.place[np.searchsorted(self.terms, term)] if len(term) else np.zeros(0, np.int64)
        self.matrix = np.zeros((self.blocks * BLOCK, int(common.sum())))
        self.matrix[example[own >= 0], own[own >= 0]] = weight[own >= 0]
        self.top = self.matrix.reshape(self.blocks, BLOCK, -1).max(axis=1) if self.blocks else self.matrix
        self.example, self.weight = example, weight
        self.first, self.last = first, np.where(common, first, first + many)

    def nearest(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and cosines of each text's k examples of highest positive cosine, ties to the smaller position, -1 and 0 where there are fewer; and the number of (text, block) pairs finished."""
        place, cosine = np.full((rows, k), -1, np.int64), np.zeros((rows, k))
        if not self.examples or not rows:
            return place, cosine, 0
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        here = self.terms[at] == term
        row, at, w = row[here], at[here], w[here]
        posting, n = _ranges(self.first[at], self.last[at])
        wide = self.blocks * BLOCK
        sums = np.bincount(np.repeat(row, n) * wide + self.example[posting], np.repeat(w, n) * self.weight[posting], rows * wide).astype(float).reshape(rows, self.blocks, BLOCK)
        common = self.place[at] >= 0
        query = np.zeros((rows, self.matrix.shape[1]))
        query[row[common], self.place[at[common]]] = w[common]
        bound = sums.max(axis=2) + query @ self.top.T
        done = np.zeros(bound.shape, bool)

        def finish(todo: np.ndarray) -> None:
            for b in np.flatnonzero(todo.any(axis=0)).tolist():
                which = np.flatnonzero(todo[:, b])
                sums[which, b] += query[which] @ self.matrix[b * BLOCK : (b + 1) * BLOCK].T
            done[todo] = True

        def kth(held: np.ndarray) -> np.ndarray:
            n = held.shape[1]
            return np.partition(held, n - k, axis=1)[:, n - k] if n > k else np.zeros(rows)

        best = np.argsort(-bound, axis=1, kind="stable")[:, :AT_ONCE]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, best, True, axis=1)
        finish(first)
        least = kth(np.take_along_axis(sums, best[:, :, None], axis=1).reshape(rows, -1))
        finish((bound >= least[:, None] - 1e-9) & (bound > 0) & ~done)
        sums[~done] = 0
        held = sums.reshape(rows, wide)
        last = kth(held)
        for i in range(rows):
            good = np.flatnonzero(held[i] > max(last[i] - 1e-12, 0))
            best = good[np.lexsort((good, -np.round(held[i, good], 12)))[:k]]
            place[i, : len(best)], cosine[i, : len(best)] = best, held[i, best]
        return place, cosine, int(done.sum())


@dataclass
class Index:
    """Examples, the terms' inverse document frequencies, and the curve from votes to probabilities."""

    idf: np.ndarray
    postings: Postings
    ids: np.ndarray
    toxic: np.ndarray
    prior: float
    curve: tuple[list[float], list[float]] = ((0.0, 1.0), (0.0, 1.0))

    def nearest(self, count: Terms, texts: list[str | None], k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, int]:
        return self.postings.nearest(*vectors(count(texts), self.idf, len(texts)), len(texts), k)

    def votes(self, place: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Share of closeness that votes toxic; the prior fills in for closeness that is missing."""
        near = np.where(place >= 0, 1.0 / (0.05 + 1.0 - np.minimum(cosine, 1.0)), 0.0)
        marks = np.append(self.toxic, 0.0)[place]
        return ((near * marks).sum(axis=1) + PRIOR_VOTES * self.prior) / (near.sum(axis=1) + PRIOR_VOTES)


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of a rising curve through pooled neighbours, each pool with one clean half vote and one toxic half vote."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            s, n, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], high]
    knots, values = [], []
    for s, n, low, high in pools:
        p = (s + 0.5) / (n + 1.0)
        for v in dict.fromkeys((low, high)):
            knots.append(v)
            values.append(max(p, values[-1]) if values else p)
    return knots, values


def _order(told: list[tuple]) -> list[int]:
    """Examples so that alike ones lie together: by label, then by their weightiest terms."""
    lead = [tuple(t[np.argsort(-w, kind="stable")[:3]].tolist()) for _, _, t, w in told]
    return sorted(range(len(told)), key=lambda i: (told[i][1], lead[i], told[i][0]))


def examples(rows: DataFrame, idf: np.ndarray) -> tuple[Postings, np.ndarray, np.ndarray]:
    """Postings, doc_ids and labels of the rows (doc_id, text, toxic), which their number must bound."""
    idf_ = rows.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        count = Terms()
        for batch in batches:
            for part in chunks(batch, "text"):
                row, term, w = vectors(count(part.column("text").to_pylist()), idf_.value, part.num_rows)
                cut = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.ListArray.from_arrays(cut, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(w))], names=["doc_id", "toxic", "terms", "weights"])

    t = map_arrow(rows.select("doc_id", "toxic", "text"), run, "doc_id long, toxic int, terms array<int>, weights array<double>").toArrow()
    told = [(i, y, np.asarray(a.values), np.asarray(b.values)) for i, y, a, b in zip(t["doc_id"].to_pylist(), t["toxic"].to_pylist(), t["terms"], t["weights"], strict=True) if len(a.values)]
    told = [told[i] for i in _order(told)]
    at = np.repeat(np.arange(len(told)), [len(r[2]) for r in told])
    none = [np.zeros(0)]
    term, weight = np.concatenate(none + [r[2] for r in told]).astype(np.int64), np.concatenate(none + [r[3] for r in told])
    return Postings(at, term, weight, len(told)), np.array([r[0] for r in told], np.int64), np.array([r[1] for r in told], float)


def build(docs: DataFrame, labels: DataFrame) -> Index:
    """Fits the index and its curve."""
    rows = stored(labelled(docs, labels))

    def take(where: str, most: int) -> DataFrame:
        each = [rows.where(f"toxic = {v} and {where}").orderBy("draw", "doc_id", "text").limit(most) for v in (0, 1)]
        return each[0].unionByName(each[1])

    counts = {(r["toxic"], r["own"]): r["n"] for r in rows.groupBy("toxic", (F.col("fold") != 3).alias("own")).agg(F.count("*").alias("n")).collect()}
    rates = {r["toxic"]: r["n"] for r in labels.where("toxic is not null").where(~held_out()).groupBy(F.col("toxic").cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    prior = rates.get(1, 0) / max(sum(rates.values()), 1)
    if not (counts.get((0, True)) or counts.get((1, True))) or len({k[0] for k in counts}) < 2:
        return Index(np.zeros(BUCKETS), Postings(*[np.zeros(0, np.int64)] * 2, np.zeros(0), 0), np.zeros(0, np.int64), np.zeros(0), prior, ([0.0, 1.0], [prior, prior]))
    idf = idf_of(*document_frequencies(docs))
    index = Index(idf, *examples(take("fold <> 3", EXAMPLES), idf), prior)
    if not all(counts.get((v, False)) for v in (0, 1)):
        return index
    index_ = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index, count = index_.value, Terms()
        for batch in batches:
            for part in chunks(batch, "text"):
                place, cosine, _ = index.nearest(count, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(index.votes(place, cosine)), part.column("toxic")], names=["vote", "toxic"])

    told = map_arrow(take("fold = 3", CURVE_ROWS).select("text", "toxic"), run, "vote double, toxic int").toArrow()
    vote, mark = told.column("vote").to_numpy(), told.column("toxic").to_numpy().astype(float)
    if mark.mean() > 0 and prior > 0:
        # Both classes are cut at the same number of rows; clean rows count as often as they stand for.
        stand = np.where(mark == 1, 1.0, max(1.0, (1 - prior) / prior * mark.sum() / (1 - mark).sum()))
        times = np.maximum(1, np.round(stand)).astype(int)
        vote, mark = np.repeat(vote, times), np.repeat(mark, times)
    order = np.lexsort((mark, vote))
    return replace(index, curve=monotone(vote[order], mark[order]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, neighbours (doc_ids of labelled examples, nearest first) and their toxic marks."""
    index_ = docs.sparkSession.sparkContext.broadcast(build(docs, labels))

    def run(batches):
        index, count = index_.value, Terms()
        for batch in batches:
            for part in chunks(batch, "text"):
                place, cosine, _ = index.nearest(count, part.column("text").to_pylist())
                scores = np.interp(index.votes(place, cosine), *index.curve)
                cut = pa.array(np.append(0, np.cumsum((place >= 0).sum(axis=1))).astype(np.int32))
                some = place[place >= 0]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.ListArray.from_arrays(cut, pa.array(index.ids[some])), pa.ListArray.from_arrays(cut, pa.array(index.toxic[some].astype(np.int32)))],
                    names=["doc_id", "held_out", "score", "predicted", "neighbours", "neighbours_toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", held_out().alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, neighbours_toxic array<int>")
