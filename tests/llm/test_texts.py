"""Fill-in-the-middle, fingerprints and ranked search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from salesops.llm import fill_middle, fingerprints, lexical_search
from tests.llm.helpers import frame, prose, words


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill in the middle.


def _plain_middle(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def _lined(rng, n):
    return "".join(rng.choice(["\n", "a\n", "é ñ\n", "\r\n", "two words \n", "日本語 text\n", "x", "<P", "S>", "😀\n", "\x00\n"]) for _ in range(n))


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_cuts_are_those_of_the_units(spark, block):
    rng = random.Random(block)
    rows = [(i, _lined(rng, rng.randrange(60))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "no end"), (204, "a<M>b\nc"), (205, "\n" * 5000), (206, "line of some length é\n" * 20000 + "end"), (None, "x\ny\nz"), (3, "again\n3"), (3, "again\n3"), (207, "é" * 100000)]
    got = fill_middle.restored(fill_middle.transform(frame(spark, rows), block=block)).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    have = sorted(((r["doc_id"], r["restored"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key)
    want = sorted(((i, t or "", *_plain_middle(i, t)) for i, t in rows), key=key)
    assert have == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rates_and_sentinels_are_parameters(spark):
    rng = random.Random(2)
    rows = [(i, _lined(rng, 30)) for i in range(200)]
    got = {r["doc_id"]: r for r in fill_middle.transform(frame(spark, rows), rate=30, spm_rate=0).collect()}
    assert all((got[i]["n"], got[i]["form"], got[i]["prefix_chars"], got[i]["middle_chars"], got[i]["output"]) == _plain_middle(i, t, 30, 0) for i, t in rows)
    marks = ("[.pre]", "[.suf]", "[.mid]")
    other = fill_middle.restored(fill_middle.transform(frame(spark, rows), sentinels=marks), marks).collect()
    assert {r["doc_id"]: r["restored"] for r in other} == dict(rows) and any(r["output"].startswith("[.suf]") for r in other)
    for bad in (("aba", "c", "d"), ("ab", "bc", "d"), ("a", "xax", "d"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.transform(frame(spark, rows), sentinels=bad)
    assert fill_middle.restored(fill_middle.transform(frame(spark, []))).count() == 0


def test_tree_sums_and_descent():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 9, 100):
        counts = rng.integers(0, 4, n)
        tree = fill_middle.fenwick(counts)
        for i in range(1, n + 1):
            assert tree[i] == counts[i - (i & -i) : i].sum()
    text = "a\nbé\n\n\nxyz\nend".encode()
    blocks = fill_middle.Blocks(text, 2)
    assert [blocks.cut(k)[0] for k in range(8)] == [0, 2, 6, 7, 8, 12, len(text), len(text)]
    assert [blocks.cut(k)[1] for k in range(7)] == [0, 2, 5, 6, 7, 11, 14]


# Fingerprints.


def _weighted(a, b):
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 1.0


def _plain_fingerprint(text, count):
    """The definition, sample by sample, over the same hashes."""
    out = []
    weights = {xxhash.xxh64_intdigest(w.encode(), 42): n for w, n in Counter(words(text)).items()}
    for k in range(count):
        best = None
        for h, n in weights.items():
            one = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42))
            two = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42))
            u = lambda x, shift, width: ((x >> shift & (1 << width) - 1) + 0.5) * 2.0**-width
            r = -math.log(u(one, 43, 21) * u(one, 22, 21))
            c = -math.log(u(two, 43, 21) * u(two, 22, 21))
            beta = u(one, 0, 22)
            t = math.floor(math.log(n) / r + beta)
            rank = math.log(c) - r * (t - beta + 1)
            entry = (math.floor((rank + 64) * (1 << 24)), (two ^ t) & 0xFFFFFFFF)
            best = entry if best is None else min(best, entry)
        out.append(f"{best[1] if best else 0:08x}")
    return "".join(out)


def test_fingerprints_follow_the_definition(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(prose(rng, rng.randrange(1, 60), 30))) for i in range(40)] + [(50, None), (51, ""), (52, " \n\t"), (53, "a  b\tc\nd\x0be\x0cf\rg"), (54, "é " * 3000)]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(frame(spark, rows), "doc_id", 12).collect()}
    assert got == {i: _plain_fingerprint(t, 12) for i, t in rows}


def test_samples_agree_as_often_as_generalised_jaccard(spark):
    rng = random.Random(9)
    rows, want = [], []
    for i in range(60):
        a = Counter({f"w{rng.randrange(40)}": rng.randrange(1, 30) for _ in range(25)})
        b = Counter({w: max(1, int(n * rng.choice([0.3, 0.5, 1, 1, 2]))) for w, n in a.items()}) + Counter({f"v{rng.randrange(40)}": rng.randrange(1, 9) for _ in range(5)})
        rows += [(2 * i, " ".join(f"{i}{w}" for w in a.elements())), (2 * i + 1, " ".join(f"{i}{w}" for w in b.elements()))]
        want.append(_weighted(a, b))
    count = 120
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(frame(spark, rows), "doc_id", count).collect()}
    have = [np.mean([got[2 * i][8 * k : 8 * k + 8] == got[2 * i + 1][8 * k : 8 * k + 8] for k in range(count)]) for i in range(60)]
    assert abs(np.mean(have) - np.mean(want)) < 0.015
    assert np.abs(np.array(have) - want).max() < 0.2


def _plain_neighbours(rows):
    """(doc_id, n_chars, hash of the edited text, texts) of every row, in the operator's order."""
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, _key(r)))
    out = []
    for at, (i, t) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        q = len(t) // 4
        out.append((i, len(t), t, t[: len(t) - q] + after[:q], after))
    return out


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _key(row):
    return _signed(xxhash.xxh64_intdigest(int(row[0] is None).to_bytes(4, "little"), xxhash.xxh64_intdigest(row[1].encode(), 42)))


@pytest.mark.parametrize("size", [0, 1, 2, 90])
def test_neighbours_are_the_next_rows(spark, size):
    rng = random.Random(size)
    rows = [(rng.randrange(-50, 500), " ".join(prose(rng, rng.randrange(0, 80), 60))) for _ in range(size)]
    if size > 2:
        rows += [(7, "alike text here twice or more"), (7, "alike text here twice or more"), (7, "alike text here twice or more"), (7, "other"), (8, None), (9, ""), (None, "no id"), (None, "no id"), (None, None), (1000, "é" * 70 + " ñ" * 40), (-60, "word " * 30000), (501, " \n ")]
    want = _plain_neighbours(rows)
    got = fingerprints.with_neighbours(frame(spark, rows), 30).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["n_chars"], r["edited_sha256"]), []).append(r)
    for i, n, text, edited, after in want:
        found = by[(i, n, _sha(edited))].pop()
        assert found["fingerprint"] == _plain_fingerprint(text, 30) and found["edited_fingerprint"] == _plain_fingerprint(edited, 30)
        like = lambda a, b: 1.0 if a == b else 0.0 if not words(a) or not words(b) else np.mean([x == y for x, y in zip(_parts(a), _parts(b), strict=True)])
        assert found["near_edited"] == pytest.approx(like(text, edited)) and found["near_next"] == pytest.approx(like(text, after))


def _parts(text, count=30):
    f = _plain_fingerprint(text, count)
    return [f[8 * k : 8 * k + 8] for k in range(count)]


def test_generated_code_is_short_enough_to_be_compiled(spark):
    """The JVM interprets methods of 8,000 bytes and more, at a tenth of the speed."""
    df = fingerprints.fingerprints(frame(spark, [(1, "a b")]), "doc_id")
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = fingerprints.fingerprints(frame(spark, [(1, "a b")]), "doc_id")._jdf.queryExecution().debug().codegenToSeq()
        sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    assert sizes and max(sizes) < 8000 and df.count() == 1


# Ranked search.

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _plain_search(docs, items, k):
    held = [(i, Counter(_terms(t))) for i, t in docs]
    some = [c for _, c in held if c]
    N, L = len(some), sum(sum(c.values()) for c in some)
    df = Counter(t for c in some for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(_terms(t))
    out = []
    for item, terms in queries.items():
        scores = []
        for d, c in held:
            n = sum(c.values())
            if not n:
                continue
            m = 100 - 90 + (90 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_search_matches_the_plain_version(spark, most):
    rng = random.Random(4)
    words_ = lambda n: " ".join(rng.choice([f"W{rng.randrange(60)}", f"é{rng.randrange(9)},", "the", "and-so", "ÀB", "x_y", "3.14"]) for _ in range(n))
    docs = [(i, words_(rng.randrange(1, 90))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "... --- \n"), (403, docs[0][1]), (3, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (None, docs[5][1]), (404, "the w1 " * 60000), (405, "w" * 100000)]
    items = [(i, words_(rng.randrange(1, 12))) for i in range(25)] + [(30, None), (31, ""), (32, "nowhere at_all q"), (33, "the"), (1, "w7 w8 more"), (None, "w3 w4"), (None, "w5"), (34, "W9 w9 w9 ÀB àb")]
    queries = spark.createDataFrame([(i, t, 5, "x") for i, t in items], "item_id long, text string, doc_id int, score string")
    got = [tuple(r) for r in lexical_search.search(frame(spark, docs), queries, 10, most).select("item_id", "rank", "doc_id", "score").collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(_plain_search(docs, items, 10), key=order)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(frame(spark, []), items).count() == 0
    assert lexical_search.search(frame(spark, [(1, "a")]), items.limit(0)).count() == 0
    assert lexical_search.search(frame(spark, [(1, None), (2, "...")]), items).count() == 0


def test_heaps_keep_the_best():
    rng = np.random.default_rng(5)
    heaps = lexical_search.Heaps(3, 4)
    item, doc, score = rng.integers(0, 3, 400), rng.integers(0, 1000, 400), rng.integers(0, 20, 400)
    for low in range(0, 400, 37):
        heaps.offer(item[low : low + 37], doc[low : low + 37], score[low : low + 37])
    found = sorted(zip(*heaps.rows(), strict=True))
    want = [(i, d, s) for i in range(3) for s, d in sorted(((-s, d) for j, d, s in zip(item, doc, score, strict=True) if j == i and s > 0))[:4] for s in [-s]]
    assert found == sorted(want)


def test_terms_are_lowered_by_ascii_only():
    w = lexical_search.terms(pa.array(["Ab1 cÉ-dÀ\x7fZz", None, "_"]))
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == ["ab1", "cÉ", "dÀ", "zz"]
    assert np.diff(w.first).tolist() == [4, 0, 0]
