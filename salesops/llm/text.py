"""Word arrays of whole Arrow text columns.

A word is a run of bytes other than space and 0x09-0x0D (the pattern
``[^\\x20\\x09-\\x0D]+``).  ``words`` hashes every word of a column at once with
a polynomial over its bytes, taken from one running sum over the buffer, so no
Python loop runs per word.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Odd bases of the byte polynomials and their inverses modulo 2**64, by hash number.
_BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_POWERS: dict[tuple[int, int], np.ndarray] = {}

#: Bytes of text handled at once inside a task: arrays of eight bytes for each of them are held at a time.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(seed: int) -> np.uint64:
    """One well mixed 64-bit constant per small seed."""
    return mix(np.array([(seed + 1) & (2**64 - 1)], U64) * _GOLDEN)[0]


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, kept per worker up to a chunk's length."""
    have = _POWERS.get((base, 0))
    if have is None or len(have) < n:
        size = max(n, 1024)
        have = np.full(size, U64(base))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 2 * CHUNK_BYTES:
            _POWERS[(base, 0)] = have
    return have[:n]


_BYTE = [mix(np.arange(1, 257, dtype=U64) * seeded(7 + k)) for k in range(2)]


@dataclass
class Words:
    """The words of a text column: byte ``start`` and ``end`` in ``data``, row ``doc``, and the first word ``first[row]`` of each row (``first`` has one more entry than rows)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self, number: int = 0) -> np.ndarray:
        """64-bit hash of each word; ``number`` picks one of two independent hashes."""
        if not len(self.start):
            return np.zeros(0, U64)
        low, high = int(self.start[0]), int(self.end[-1])
        term = _BYTE[number][self.data[low:high]] * powers(_BASES[number], high - low)
        total = np.empty(high - low + 1, U64)
        total[0] = 0
        np.cumsum(term, out=total[1:])
        s, e = self.start - low, self.end - low
        value = (total[e] - total[s]) * powers(_INVERSES[number], high - low)[s]
        return mix(value + (self.end - self.start).astype(U64) * _GOLDEN)


def words(texts: pa.Array, between: np.ndarray = _SPACE) -> Words:
    """Words of a string array; ``between`` marks the bytes that part them."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    base = int(offs[0])
    size = int(offs[-1]) - base
    raw = np.frombuffer(data, np.uint8, size, base) if data is not None and size else np.zeros(0, np.uint8)
    offs = offs - base
    full = ~between[raw]
    cut = np.zeros(size + 1, bool)
    cut[offs] = True
    before = np.empty(size, bool)
    if size:
        before[0] = False
        before[1:] = full[:-1]
        start = np.flatnonzero(full & (~before | cut[:-1]))
        after = np.empty(size, bool)
        after[-1] = False
        after[:-1] = full[1:]
        end = np.flatnonzero(full & (~after | cut[1:])) + 1
    else:
        start = end = np.zeros(0, np.int64)
    first = np.searchsorted(start, offs)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(raw, start, end, doc, first)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``limit`` bytes of text each, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if held and held + s > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += s
    yield batch.slice(begin)


def rolling(h: np.ndarray, width: int, base: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values, across row borders."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    if width <= 8:
        out = np.zeros(n, U64)
        for k in range(width):
            out = out * U64(base) + h[k : k + n]
        return out
    term = h * powers(base, len(h))
    total = np.empty(len(h) + 1, U64)
    total[0] = 0
    np.cumsum(term, out=total[1:])
    inverse = pow(base, -1, 1 << 64)
    return (total[width:] - total[:-width]) * powers(inverse, n)
