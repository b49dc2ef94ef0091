"""Substring dedup by Rabin-Karp hashes of every fixed-length word window.

A window is ``WINDOW`` consecutive words of one document.  A word goes if some
window over it has the same word sequence as a window that starts in a document
with a smaller doc_id; windows are judged on the input.

1. One pass keeps, of every document, a 128-bit fingerprint of its words and
   its minimisers: the smallest hash of a half-length gram in each window.
   Equal windows have equal minimisers, so a window whose minimiser occurs in
   one document only has a count of one and needs no shuffle.
2. Copies of a whole earlier text go entirely; only the first copy goes on.
3. The other windows get a 96-bit Rabin-Karp hash.  Inside one slice of a task
   a window keeps its smallest document only, the others are settled at once:
   however many documents share a passage, each slice sends one row for it.
   Spark then takes the smallest document of every window hash (partial sums
   first) and joins it back to the rows.
4. Start positions of repeated windows gather by document, merge into maximal
   intervals and are cut out.

Defined results: null and empty texts have no words; a row with a null doc_id
keeps all its words and removes none elsewhere; rows with the same doc_id never
remove each other's words; rows repeating doc_id and text get the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.llm.graph import stored
from salesops.llm.tasks import map_arrow
from salesops.llm.text import U64, Words, chunks, mix, powers, rolling, words

WINDOW = 50
#: Bytes of text in which a window keeps its smallest document only.
SLICE_BYTES = 4 << 20
_BASES = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive values."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if width < n else x


def _inside(w: Words, window: int) -> np.ndarray:
    """Word positions at which a whole window of one document starts."""
    n = len(w.doc) - window + 1
    return np.flatnonzero(w.doc[:n] == w.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)


def _minimisers(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    gram = max(1, window // 2)
    return _sliding_min(mix(rolling(h, gram)), window - gram + 1)[at] if len(at) else np.zeros(0, U64)


def fingerprints(w: Words, hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Two 64-bit hashes of each document's word sequence."""
    place = np.arange(len(w.doc)) - np.repeat(w.first[:-1], np.diff(w.first))
    weight = mix(powers(_BASES[0], int(place.max(initial=0)) + 1)[place])
    out = []
    for h in hashes:
        total = np.append(np.zeros(1, U64), np.cumsum(mix(h ^ weight)))
        out.append(mix(total[w.first[1:]] - total[w.first[:-1]] + np.diff(w.first).astype(U64)).view(np.int64))
    return out


def _profile(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, key, fingerprint and distinct minimisers of each text of at least one window."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words(part.column("text"))
                h = w.hashes()
                at = _inside(w, window)
                if not len(at):
                    continue
                m, doc = _minimisers(h, at, window), w.doc[at]
                new = np.ones(len(m), bool)
                new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
                m, doc = m[new], doc[new]
                order = np.lexsort((m, doc))
                m, doc = m[order], doc[order]
                new = np.ones(len(m), bool)
                new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
                m, doc = m[new].view(np.int64), doc[new]
                rows = np.unique(doc)
                f1, f2 = fingerprints(w, [h, w.hashes(1)])
                cut = np.append(np.searchsorted(doc, rows), len(doc)).astype(np.int32)
                pick = pa.array(rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pick), part.column("key").take(pick), pa.array(f1[rows]), pa.array(f2[rows]), pa.ListArray.from_arrays(pa.array(cut), pa.array(m))], names=["doc_id", "key", "f1", "f2", "minis"])

    return map_arrow(docs, run, "doc_id long, key long, f1 long, f2 long, minis array<long>")


def _windows(marked: DataFrame, window: int) -> DataFrame:
    """Rows (h1, h2, doc_id, key, start, settled) of the windows with a marked minimiser; marked: doc_id, key, text, minis."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", SLICE_BYTES):
                w = words(part.column("text"))
                at = _inside(w, window)
                if not len(at):
                    continue
                h = w.hashes()
                m = _minimisers(h, at, window)
                lists = part.column("minis")
                marks = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                salt = mix(np.arange(part.num_rows, dtype=U64) + U64(1))
                hit = np.isin(m ^ salt[w.doc[at]], marks ^ salt[owner])
                at = at[hit]
                if not len(at):
                    continue
                h1, h2 = rolling(h, window, _BASES[0])[at], rolling(w.hashes(1), window, _BASES[1])[at]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                doc = w.doc[at]
                start = at - w.first[doc]
                order = np.lexsort((ids[doc], h2, h1))
                h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
                new = np.ones(len(h1), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                lowest = ids[doc[new]][np.cumsum(new) - 1]
                settled = ids[doc] > lowest
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(mix(h1).view(np.int64), mask=settled), pa.array((h2 >> U64(32)).astype(np.uint32).view(np.int32), mask=settled), part.column("doc_id").take(rows), part.column("key").take(rows), pa.array(start.astype(np.int32)), pa.array(settled)], names=["h1", "h2", "doc_id", "key", "start", "settled"])

    return map_arrow(marked, run, "h1 long, h2 int, doc_id long, key long, start int, settled boolean")


def _cut(joined: DataFrame, window: int, original: bool) -> DataFrame:
    """n_words, n_removed and the kept words of each text; joined: doc_id, key, text, copied, starts and perhaps rest."""
    carry = [c for c in joined.columns if c not in ("text", "copied", "starts")]

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                counts, removed, kept = [], [], []
                for text, copied, starts in zip(part.column("text"), part.column("copied").to_pylist(), part.column("starts"), strict=True):
                    found = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    counts.append(len(found))
                    if copied:
                        found = []
                    elif starts.is_valid and len(starts):
                        step = np.zeros(len(found) + 1, np.int64)
                        at = starts.values.to_numpy(zero_copy_only=False)
                        np.add.at(step, at, 1)
                        np.add.at(step, at + window, -1)
                        found = [found[i] for i in np.flatnonzero(np.cumsum(step)[:-1] == 0).tolist()]
                    removed.append(counts[-1] - len(found))
                    kept.append(text.as_buffer().to_pybytes() if original and text.is_valid and not removed[-1] else b" ".join(found))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*carry, "n_words", "n_removed", "kept_text"])

    types = dict(joined.dtypes)
    return map_arrow(joined, run, ", ".join(f"{c} {types[c]}" for c in carry) + ", n_words long, n_removed long, kept_text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (of rows that share a doc_id), n_words, n_removed, kept_text (kept words joined by one space).

    ``whole`` adds the other columns as the struct ``rest`` and leaves texts of which nothing goes as they are."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] if whole else []
    rest = [F.struct(*others).alias("rest")] if others else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    told_rest = ["rest"] * len(rest)
    # The key tells rows of one doc_id apart; where every doc_id is there once, a constant takes no room.
    once = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = rows.select("doc_id", (F.lit(0).cast("long") if once else F.xxhash64("text")).alias("key"), "text", *told_rest)
    named = rows.where("doc_id is not null")
    profile = stored(_profile(named.select("doc_id", "key", "text"), window))
    first = profile.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"))
    told = profile.join(first, ["f1", "f2"])
    mini = told.where("doc_id = first").select("doc_id", F.explode("minis").alias("m"))
    shared = mini.groupBy("m").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).where("low < top").select("m")
    # A document has each minimiser once, so this list is no longer than the document.
    marks = stored(mini.join(shared, "m").groupBy("doc_id").agg(F.collect_set("m").alias("minis")))
    found = _windows(named.join(marks, "doc_id"), window)
    open_, settled = found.where("not settled"), found.where("settled").select("doc_id", "key", "start")
    lowest = open_.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"))
    later = open_.join(lowest, ["h1", "h2"]).where("doc_id > low").select("doc_id", "key", "start")
    # Starts of one document: no more than it has words.
    starts = later.union(settled).groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))
    copied = told.where("doc_id > first").select("doc_id", "key", F.lit(True).alias("copied"), F.lit(None).cast("array<int>").alias("starts")).distinct()
    told_again = copied.unionByName(starts.select("doc_id", "key", F.lit(False).alias("copied"), "starts"))
    # Joined by doc_id alone, as above, so that the texts are dealt out once for both joins.
    told_again = told_again.select(F.col("doc_id").alias("told_id"), F.col("key").alias("told_key"), "copied", "starts")
    joined = named.join(told_again, (named["doc_id"] == F.col("told_id")) & (named["key"] == F.col("told_key")) if not once else named["doc_id"] == F.col("told_id"), "left")
    nameless = rows.where("doc_id is null").select("doc_id", "key", "text", *told_rest, F.lit(False).alias("copied"), F.lit(None).cast("array<int>").alias("starts"))
    return _cut(joined.select("doc_id", "key", "text", *told_rest, F.coalesce("copied", F.lit(False)).alias("copied"), "starts").unionByName(nameless), window, whole)


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with its columns, repeated words cut from the texts and n_chars renewed; rows that had words and keep none go."""
    cut = remove_repeats(docs, window, whole=True).where("n_removed = 0 or n_removed < n_words")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    own = [new[c].alias(c) if c in new else (F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars").cast("long")) if c == "n_chars" else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns]
    return cut.select(*own)
