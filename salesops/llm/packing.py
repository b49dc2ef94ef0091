"""Packing by power-of-two decomposition.

A document's ids (with the end id) are cut from the front into pieces whose
lengths are powers of two: as many of ``SEQUENCE`` as fit, then the binary
digits of the rest, longest first.  Each piece is one sequence, so no sequence
crosses documents and none needs padding; sequences of equal length form a
bucket and are numbered through, short buckets first.

The ids of a text come from its units: a word with the one space or line feed
before it.  The vocabulary's pattern always cuts there, so the units' ids in a
row are the ids of the text.  Units are looked up by a 64-bit hash, a whole
slice of texts at once, in a table of bounded size per worker.  New units go
through the same vocabulary's rank file, whose encoder takes a fifth of the
time a short string takes in the vocabulary file's (tests hold the ids of both
against each other); texts with other white space, or with the string of a
special token, go through the vocabulary file whole.

Defined results: null and empty texts are the end id alone, one piece of one
id.  Rows with a null doc_id and rows that repeat a doc_id are documents of
their own.  An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesops.llm.graph import stored
from salesops.llm.tasks import map_arrow
from salesops.llm.text import U64, chunks, mix, words

SEQUENCE = 2048
END_ID = 1
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Units whose ids a worker keeps; beyond it the table starts anew.
KEPT_UNITS = 1 << 19

#: Most counts (length and task) that are broadcast; beyond it they are joined by shuffle.
BROADCAST_COUNTS = 200_000

#: White space that separates no units.
_OTHER_SPACE = "[\\x{09}\\x{0B}-\\x{0D}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_LINE = 0x0A


def vocabulary_paths() -> tuple[str, str]:
    """The vocabulary file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)


@cache
def _encoder(paths: tuple[str, str]) -> Encoder:
    return Encoder(*paths)


class Encoder:
    """Ids of texts; one per Python worker."""

    def __init__(self, path: str, ranks: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.units = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.clear(KEPT_UNITS)

    def clear(self, most: int) -> None:
        self.known, self.most = 0, most
        size = 4 * KEPT_UNITS
        while size < 4 * most:
            size *= 2
        self.mask = U64(size - 1)
        self.keys = np.zeros(size, U64)
        self.place = np.full(size, -1, np.int32)
        self.begin = np.zeros(most + 1, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the empty slot where its search ends."""
        at = keys & self.mask
        open_ = np.flatnonzero((self.place[at] >= 0) & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + U64(1)) & self.mask
            here = at[open_]
            open_ = open_[(self.place[here] >= 0) & (self.keys[here] != keys[open_])]
        return at

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        own = [self.units.encode_ordinary(u.decode()) for u in units]
        ids = np.fromiter(chain.from_iterable(own), np.uint32)
        end = int(self.begin[self.known])
        while end + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids), np.uint32))
        self.ids[end : end + len(ids)] = ids
        self.begin[self.known + 1 : self.known + 1 + len(own)] = end + np.cumsum([len(x) for x in own])
        self.known += len(own)
        first = self.known - len(keys)
        todo = np.arange(len(keys))
        while len(todo):  # keys that meet in one empty slot go in one after the other
            at = self._slots(keys[todo])
            _, lead = np.unique(at, return_index=True)
            self.keys[at[lead]] = keys[todo[lead]]
            self.place[at[lead]] = first + todo[lead]
            todo = np.delete(todo, lead)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the first of each text (one more entry than texts)."""
        n = len(texts)
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _OTHER_SPACE).to_numpy(zero_copy_only=False)
        for s in self.special:
            odd = odd | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        w = words(texts)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        offset = np.append(0, np.cumsum(sizes))
        head = np.zeros(len(w.start), bool)
        head[w.first[:-1][np.diff(w.first) > 0]] = True
        gap = w.start - np.append(0, w.end[:-1])[: len(w.start)]
        gap[head] = (w.start - offset[w.doc])[head]
        # One space or line feed before each word but the first, none around the text.
        odd[w.doc[gap != np.where(head, 0, 1)]] = True
        full = np.diff(w.first) > 0
        odd[full] |= w.end[w.first[1:][full] - 1] != offset[1:][full]
        odd |= ~full & (sizes > 0)
        line = w.data[np.maximum(w.start, 1) - 1] == _LINE if len(w.start) else np.zeros(0, bool)
        kind = np.where(head, U64(1), np.where(line, U64(3), U64(2)))
        keys = mix(w.hashes() + kind * U64(0x9E3779B97F4A7C15))
        plain = ~odd[w.doc]
        at = self._slots(keys)
        new = np.flatnonzero((self.place[at] < 0) & plain)
        if len(new):
            _, lead = np.unique(keys[new], return_index=True)
            if self.known + len(lead) > self.most:
                self.clear(max(KEPT_UNITS, len(np.unique(keys))))
                new = np.flatnonzero(plain)
                _, lead = np.unique(keys[new], return_index=True)
            new = new[lead]
            raw = w.data.tobytes()
            begin = w.start[new] - ~head[new]
            self._learn(keys[new], [raw[a:b] for a, b in zip(begin.tolist(), w.end[new].tolist(), strict=True)])
            at = self._slots(keys)
        place = np.where(plain, self.place[at], 0)
        begin = self.begin[place]
        size = np.where(plain, self.begin[place + 1] - begin, 0)
        done = np.cumsum(size)
        take = np.arange(done[-1] if len(done) else 0) + np.repeat(begin - (done - size), size)
        ids = self.ids[take]
        first = np.append(0, done)[w.first]
        rows = np.flatnonzero(odd)
        if not len(rows):
            return ids, first
        own = dict(zip(rows.tolist(), (np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.take(pa.array(rows)).to_pylist(), add_special_tokens=False)), strict=True))
        parts = [own.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))]
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))


def piece_lengths(n: int, sequence: int = SEQUENCE) -> list[int]:
    """Power-of-two lengths, longest first, that add up to ``n``."""
    return [sequence] * (n // sequence) + [1 << k for k in range(sequence.bit_length() - 2, -1, -1) if n % sequence >> k & 1]


def pieces(docs: DataFrame, paths: tuple[str, str] | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), its task and the place ``nth`` among the task's pieces of its length."""
    paths = paths or vocabulary_paths()
    if sequence & (sequence - 1) or sequence < 1:
        raise ValueError("the sequence length must be a power of two")

    def run(batches):
        encoder = _encoder(paths)
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, first = encoder.encode(part.column("text"))
                row, start, length, total, packed, nth = [], [], [], [], [], []
                raw = ids.astype("<u4").tobytes()
                end = np.array([end_id], "<u4").tobytes()
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    n, own = b - a + 1, raw[4 * a : 4 * b] + end
                    at = 0
                    for size in piece_lengths(n, sequence):
                        row.append(i)
                        start.append(at)
                        length.append(size)
                        nth.append(seen[size])
                        seen[size] += 1
                        total.append(n)
                        packed.append(own[4 * at : 4 * (at + size)])
                        at += size
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(packed, pa.binary()), pa.array(np.full(len(row), task, np.int32)), pa.array(nth, pa.int64())], names=["doc_id", "start", "length", "doc_tokens", "ids", "task", "nth"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, start long, length long, doc_tokens long, ids binary, task int, nth long")


def number(rows: DataFrame) -> DataFrame:
    """Adds sequence_id and offset (0: a piece fills its sequence) to pieces.

    Ids run through the buckets of equal length.  The pieces are written once, with their
    place among the pieces of their length in their task; the counts of the tasks
    before set the places off, so no piece is shuffled and no text is read twice."""
    rows = stored(rows)
    counts = rows.groupBy("length", "task").count()
    # One row for each length (at most 12) and task.
    ahead = Window.orderBy("length", "task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    before = stored(before)
    out = rows.join(F.broadcast(before) if before.count() <= BROADCAST_COUNTS else before, ["length", "task"])
    return out.withColumn("sequence_id", (F.col("before") + F.col("nth")).cast("long")).withColumn("offset", F.lit(0).cast("long")).drop("task", "before", "nth")


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Numbered pieces with their ids."""
    return number(pieces(docs, paths, sequence))
