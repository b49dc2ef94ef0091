"""Fill-in-the-middle transformation over a Fenwick tree of text blocks.

1. A text is cut into blocks of ``BLOCK`` bytes of its UTF-8 form.  Each block has
   two counts, the line ends in it and the code points that begin in it.  Two
   Fenwick trees over the blocks hold these counts (a node adds the blocks that
   its lowest bit spans), so a text is read once to build them.
2. Units are lines, ``[^\\n]*\\n|[^\\n]+``.  Four numbers from the sha256 of
   ``seed:doc_id`` decide the two cuts, whether the document is transformed and in
   which form.
3. A cut after k units is found by binary lifting: the descent through the line
   tree passes every block that ends before the k-th line end, summing the
   code points of the same nodes, and the line end is then looked for in one block
   only.  The cut's byte and its number of code points come out together.
4. The pieces are put together with sentinels; ``restored`` takes an output apart
   again and gives the exact text.

A document is handled on its own, so there is no shuffle and no group.  Texts
are taken in slices of at most 1 MB or one row; beside a text and its output,
only arrays of one entry a block are held.

Defined results: a null or empty text has no units, is plain and stays empty.
A text that contains a sentinel is plain and stays as it is.  A null doc_id
is hashed as an empty string; rows that repeat a doc_id get the same four
numbers.  A text without line ends is one unit: one of its three pieces is the
whole text.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.llm.tasks import map_arrow
from salesops.llm.text import chunks

BLOCK = 4096
SEED, RATE, SPM_RATE = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Blocks whose bytes are counted at once.
AT_ONCE = 256


def fenwick(counts: np.ndarray) -> np.ndarray:
    """Tree over ``counts``; node i (from 1) sums the ``i & -i`` counts that end with the i-th."""
    tree = np.concatenate([np.zeros(1, np.int64), counts])
    step = 1
    while 2 * step < len(tree):
        above = tree[2 * step :: 2 * step]
        above += tree[step :: 2 * step][: len(above)]
        step *= 2
    return tree


class Blocks:
    """Line ends and code points of a UTF-8 text, by block."""

    def __init__(self, text: bytes, block: int = BLOCK):
        self.text, self.block = text, block
        data = np.frombuffer(text, np.uint8)
        lines, points = [], []
        for low in range(0, len(data), block * AT_ONCE):
            part = data[low : low + block * AT_ONCE]
            at = np.arange(0, len(part), block)
            lines.append(np.add.reduceat(part == 0x0A, at, dtype=np.int64))
            points.append(np.add.reduceat((part & 0xC0) != 0x80, at, dtype=np.int64))
        none = [np.zeros(0, np.int64)]
        lines, points = np.concatenate(lines or none), np.concatenate(points or none)
        self.ends, self.chars = int(lines.sum()), int(points.sum())
        self.units = self.ends + int(bool(text) and not text.endswith(b"\n"))
        self.size = len(lines)
        self.line_tree, self.point_tree = fenwick(lines), fenwick(points)

    def cut(self, units: int) -> tuple[int, int]:
        """Byte and code point at which the first ``units`` units end."""
        if units <= 0:
            return 0, 0
        if units > self.ends:
            return len(self.text), self.chars
        at, left, chars = 0, units, 0
        step = 1 << (self.size.bit_length() - 1)
        while step:
            if at + step <= self.size and self.line_tree[at + step] < left:
                at += step
                left -= int(self.line_tree[at])
                chars += int(self.point_tree[at])
            step >>= 1
        own = np.frombuffer(self.text, np.uint8, min(self.block, len(self.text) - at * self.block), at * self.block)
        end = int(np.flatnonzero(own == 0x0A)[left - 1]) + 1
        return at * self.block + end, chars + int(np.count_nonzero((own[:end] & 0xC0) != 0x80))


def numbers(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The first four groups of eight hex digits of the sha256 of ``seed:doc_id``."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(text: bytes, doc_id: int | None, sentinels: tuple[bytes, bytes, bytes], seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle (none if plain), and the output of one text."""
    h1, h2, h3, h4 = numbers(doc_id, seed)
    blocks = Blocks(text, block)
    n = blocks.units
    if not text or any(s in text for s in sentinels) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, head), (b, upto) = blocks.cut(first), blocks.cut(second)
    p, s, m = sentinels
    form = "spm" if h4 % 100 < spm_rate else "psm"
    parts = (s, text[b:], p, text[:a], m, text[a:b]) if form == "spm" else (p, text[:a], s, text[b:], m, text[a:b])
    return n, form, head, upto - head, b"".join(parts)


def _apart(sentinels: tuple[str, str, str]) -> None:
    """Outputs can be taken apart if no sentinel lies in another or begins where one, itself included, ends."""
    for x in sentinels:
        for y in sentinels:
            if not x or (x is not y and x in y) or any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)))):
                raise ValueError(f"sentinels {x!r} and {y!r} overlap")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    ``rate`` per cent of the documents are transformed, ``spm_rate`` per cent of these suffix first; ``sentinels`` mark prefix, suffix and middle."""
    _apart(sentinels)
    marks = tuple(s.encode() for s in sentinels)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                texts = part.column("text").cast(pa.large_binary())
                found = [arranged(t.as_py() or b"", i, marks, seed, rate, spm_rate, block) for i, t in zip(ids, texts, strict=True)]
                n, form, prefix, middle, output = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Adds ``restored``, the text that ``output`` was made of, to rows that have ``form`` and ``output``."""
    _apart(sentinels)
    between = "|".join(rf"\Q{s}\E" for s in sentinels)
    piece = F.split("output", between, -1)
    text = {"psm": F.concat(piece[1], piece[3], piece[2]), "spm": F.concat(piece[2], piece[3], piece[1])}
    return rows.withColumn("restored", F.when(F.col("form") == "psm", text["psm"]).when(F.col("form") == "spm", text["spm"]).otherwise(F.col("output")))
