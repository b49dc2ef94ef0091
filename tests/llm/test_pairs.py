"""Near-duplicate, substring, embedding and search operators against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from salesops.llm import bagminhash, embedding_dedup, graph, near_dup, substring_dedup, text, topk
from salesops.llm.graph import components
from tests.llm.helpers import bag, classes, frame, jaccard, prose, words

ODD = ["", None, " ", "one", "a  b\tc\nd\x0be\x0cf\rg", "x y z", "é ñ ü", "end ", "\n start"]


def test_words_are_runs_of_other_bytes():
    w = text.words(pa.array(ODD))
    found = [[] for _ in ODD]
    for d, a, b in zip(w.doc, w.start, w.end, strict=True):
        found[d].append(bytes(w.data[a:b]).decode())
    assert found == [words(t) for t in ODD]
    assert len(text.words(pa.array([], pa.string())).start) == 0
    sliced = text.words(pa.array(["no", *ODD]).slice(1))
    assert sliced.first.tolist() == w.first.tolist() and (sliced.hashes() == w.hashes()).all()


def test_equal_words_and_windows_have_equal_hashes():
    w = text.words(pa.array(["aa b aa c", "c aa b"]))
    h = w.hashes()
    assert h[0] == h[2] == h[5] and h[3] == h[4] and len(set(h.tolist())) == 3
    long = np.tile(h[:4], 40)
    r = text.rolling(long, 50)
    assert r[0] == r[4] != r[1] and len(r) == 111


def test_signatures_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    value = text.mix(np.arange(1, 401, dtype=np.uint64))
    a, b = rng.integers(0, 6, 400), rng.integers(0, 6, 400)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    seen = []
    for salt in range(40):
        v = text.mix(value + np.uint64(salt * 1000))
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = bagminhash.signatures(doc, np.concatenate([v[a > 0], v[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 3)
        assert not s[2].any()
        seen.append((s[0] == s[1]).mean())
    assert abs(np.mean(seen) - want) < 0.025


def test_overlap_counts_repeated_shingles():
    a, b = "x y z u v " * 9 + "end of it all here now", "x y z u v " * 6 + "other end of it all here now"
    found = bagminhash.overlap(*bagminhash.text_bags(pa.array([a, b])))
    assert found == pytest.approx(jaccard(bag(a), bag(b)))


def test_components_name_the_smallest(spark):
    links = [(5, 3), (3, 9), (9, 12), (20, 21), (7, 7), (30, 31), (31, 32), (32, 33), (33, 34), (34, 30), (None, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {5: 3, 9: 3, 12: 3, 21: 20, 31: 30, 32: 30, 33: 30, 34: 30}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_large_star_and_a_path(spark):
    """A hub of 100,000 links meets no single task; a path takes rounds."""
    star = spark.range(100_000).selectExpr("cast(500000 + id as long) a", "7L b")
    path = spark.range(300).selectExpr("cast(id * 3 + 1000 as long) a", "cast(id * 3 + 1003 as long) b")
    other = spark.range(50).selectExpr("cast(1000000 - id as long) a", "cast(2000000 + id as long) b")
    got = components(star.union(path).union(other).union(spark.createDataFrame([(2000000, 1000)], "a long, b long")))
    sizes = {r["component"]: r["n"] for r in got.groupBy("component").count().withColumnRenamed("count", "n").collect()}
    assert sizes[7] == 100_000 and sizes[1000] == 302 and sum(sizes.values()) == 100_000 + 302 + 49


def test_least_of_hubs_and_others(spark):
    rows = spark.range(5000).selectExpr("if(id % 2 = 0, -1, id) k", "id * 37 % 1009 v", "id")
    got = {r["id"]: r["m"] for r in graph.with_least(rows, "k", "v", 5000).collect()}
    want, least = {}, {}
    for r in rows.collect():
        least[r["k"]] = min(least.get(r["k"], 10**9), r["v"])
        want[r["id"]] = r["k"]
    assert got == {i: least[k] for i, k in want.items()}


def _near_rows():
    rng = random.Random(4)
    rows, i = [], 100
    for _ in range(12):
        base = prose(rng, rng.choice([4, 30, 120]))
        for _ in range(rng.choice([1, 3, 8])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 4])):
                own[rng.randrange(len(own))] = f"z{rng.randrange(999)}"
            rows.append((i, " ".join(own)))
            i += 1
    return rows


def test_near_duplicates_match_all_pairs(spark):
    rows = _near_rows()
    bags = {i: bag(t) for i, t in rows}
    ids = [i for i, _ in rows]
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and jaccard(bags[a], bags[b]) >= 0.8])
    for block in (512, 2):
        got = near_dup.near_duplicates(frame(spark, rows), block=block).collect()
        assert {r["doc_id"]: r["class_id"] for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    same = "a b c d e f g h i j"
    rows = [(1, None), (2, None), (3, ""), (4, " "), (None, same), (5, same), (6, same + " "), (6, same + " "), (7, "one two"), (8, "one two"), (9, "one"), (10, "w " * 30000)]
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in near_dup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (None, None, True), (5, 5, True), (6, 5, False), (6, 5, False), (7, 7, True), (8, 7, False), (9, 9, True), (10, 10, True)], key=str)
    docs = frame(spark, [*rows, (1, None)])
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["1", "2", "3", "None", "5", "7", "9", "10"])
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def _plain_cut(rows, window):
    starts, out = {}, {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            if i is not None:
                starts[s] = min(starts.get(s, i), i)
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and starts[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.setdefault(i, []).append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("window", [50, 7])
def test_repeats_match_plain_version(spark, window):
    rng = random.Random(window)
    shared = [prose(rng, n) for n in (window, window + 13, 2 * window, window - 1)]
    rows = []
    for i in range(30):
        t = []
        for _ in range(rng.randrange(4)):
            t += prose(rng, rng.randrange(60)) + rng.choice(shared)
        rows.append((i * 3, "\n".join([" ".join(t), "tail"])))
    rows += [(200, rows[4][1]), (201, rows[4][1]), (None, rows[4][1]), (202, None), (203, ""), (204, "q " * 500), (205, "q " * 300), (7, "q " * 90)]
    rows += [(200, rows[4][1]), (201, "other text of the same id " * 20)]
    got = {}
    for r in substring_dedup.remove_repeats(frame(spark, rows), window).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_text"]))
    assert {i: sorted(v) for i, v in got.items()} == _plain_cut(rows, window)


def test_cut_repeats_keeps_columns_and_clean_texts(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "clean\n text  here"), (2, passage), (3, "before it " + passage + "\nafter"), (4, passage), (5, None)]
    docs = frame(spark, rows)
    got = substring_dedup.cut_repeats(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["row"]) for r in got.collect()} == {1: ("clean\n text  here", 17, "x"), 2: (passage, len(passage), "x"), 3: ("before it after", 15, "x"), 5: ("", 0, "x")}
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, n long, rep string"


def _vectors(rng, n, labels=3, dim=16, near=0.02):
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            v = out[rng.integers(len(out))][1]
            v = v + near * rng.standard_normal(dim) * rng.choice([0, 1, 3])
        else:
            v = rng.standard_normal(dim)
            v = v / np.linalg.norm(v)
        out.append((i * 2, v.astype(np.float32), int(rng.integers(labels))))
    return out


def test_embedding_links_match_all_pairs(spark):
    rows = _vectors(np.random.default_rng(3), 240)
    x = np.stack([v for _, v, _ in rows]).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    root = classes(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    df = spark.createDataFrame([(i, v.tolist(), la, 1, "r") for i, v, la in rows], VECTORS)
    for block in (512, 8):
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
        assert {i: r["n_links"] for i, r in got.items()} == dict(zip(ids, near.sum(axis=1).tolist(), strict=True))
        assert {i: r["component_id"] for i, r in got.items()} == root
        assert all(r["kept"] == (i == root[i]) for i, r in got.items())


def test_embeddings_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0], 1), (12, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], VECTORS)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    want = {i: (0, i, True) for i, _, _ in rows} | {1: (2, 1, True), 2: (2, 1, False), 12: (2, 1, False)}
    assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_repeat_a_vec_id_have_their_own_links(spark):
    one, two = np.eye(8)[0], np.eye(8)[1]
    near = lambda v, k: (v + 0.05 * np.eye(8)[k]).tolist()
    rows = [(7, one.tolist(), 1), (7, two.tolist(), 1), (8, near(one, 4), 1), (9, near(two, 5), 1), (9, near(two, 5), 1), (3, near(two, 6), 2)]
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], VECTORS)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(3, 0, 3, True), (7, 1, 7, True), (7, 2, 7, True), (8, 1, 7, False), (9, 2, 7, False), (9, 2, 7, False)]


def test_sketches_leave_no_near_pair_out():
    rng = np.random.default_rng(2)
    for dim in (1, 3, 64):
        x = rng.standard_normal((500, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = x + rng.standard_normal((500, dim)) * 0.2 / np.sqrt(dim)
        y /= np.linalg.norm(y, axis=1)[:, None]
        a, b = (embedding_dedup._sketches(v).reshape(-1, 1).view(np.int8).astype(float) for v in (x, y))
        near = (x * y).sum(axis=1) >= 0.98
        assert near.any() and (np.linalg.norm(a - b, axis=1)[near] <= embedding_dedup._reach(0.98)).all()


@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 40)])
def test_search_matches_brute_force(spark, blocks):
    rows = _vectors(np.random.default_rng(8), 300, dim=24)
    rows += [(600 + i, rows[5][1], 0) for i in range(40)]
    x = np.floor(256 * np.stack([v for _, v, _ in rows]).astype(float)).astype(int)
    ids = np.array([r[0] for r in rows])
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q]
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != ids[q]][:5]
        want |= {(int(ids[q]), n + 1, int(ids[k]), int(score[k])) for n, k in enumerate(order)}
    df = spark.createDataFrame([(i, v.tolist(), la, 1, "r") for i, v, la in rows], VECTORS)
    got = {tuple(r) for r in topk.search(df, query_block=blocks[0], row_block=blocks[1]).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == want


def test_search_of_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (50, [1.0], 1), (None, [1.0, 1.0], 1), (100, None, 1)]
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], VECTORS)
    assert [tuple(r) for r in topk.search(df).collect()] == [(0, 1, 1, 256 * 128 + 128 * 128)]
    assert topk.search(df.limit(0)).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(2)
    q, x = rng.integers(-300, 300, (20, 50)).astype(float), rng.integers(-300, 300, (80, 50)).astype(float)
    last = None
    for s in topk.SEGMENTS:
        bound = topk.statistics(q, s) @ topk.statistics(x, s).T
        assert (bound >= q @ x.T - 1e-6).all()
        last = bound if last is None else last
    assert (topk.statistics(q, 32) @ topk.statistics(x, 32).T).mean() < last.mean()
