"""Row operators: sharding, mixing, packing, quality, page text and toxicity."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from salesops.llm import html_text, mixing, packing, quality, sharding, toxicity
from tests.llm.helpers import frame, prose, share, words

LABELS = "doc_id long, quality int, toxic int"


def _mixed_rows(n=400, seed=5):
    rng = random.Random(seed)
    rows = [(i, " ".join(prose(rng, int(rng.paretovariate(0.9)) % 2000 + 1)), rng.choice(["a", "b", "b", "b", "ß", None, "Z"])) for i in range(n)]
    rows += [(n + i, rows[3][1], "b") for i in range(300)]
    return [*rows, (5, None, "a"), (6, "", "a"), (None, "x y", "b"), (None, None, None), (7, rows[7][1], rows[7][2]), (9999, "one two", "empty"), (10000, None, "nil")]


def test_shards_hold_near_equal_bytes(spark):
    rows = _mixed_rows()
    got = sharding.shard(frame(spark, rows)).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    held, most = Counter(), max(size(t) for _, t, _ in rows)
    slots = {}
    for r in got:
        held[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    even = sum(held.values()) / 16
    assert max(held.values()) <= even + most and min(held.values()) >= even - most
    again = sharding.shard(frame(spark, rows[::-1]).repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_shards_of_repeated_rows_and_small_parts(spark):
    """A third of the rows is one row many times; parts are as small as asked."""
    rows = [(5, "same text", "s")] * 400 + [(None, "x" * 50, "s")] * 300 + [(i, "y" * (i % 90), "s") for i in range(500)]
    for part_bytes in (200, 1 << 31):
        got = sharding.shard(frame(spark, rows), ranges=8, part_bytes=part_bytes).collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t) + 1) for i, t, _ in rows)
        sums, slots = Counter(), {}
        for r in got:
            sums[r["shard"]] += r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(abs(sums[k] - sum(sums.values()) / 16) <= 91 for k in range(16))
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_of_few_or_no_rows(spark):
    assert sharding.shard(frame(spark, [])).count() == 0
    got = sharding.shard(frame(spark, [(1, None), (2, "x")]), shards=2).collect()
    assert sorted((r["doc_id"], r["size"], r["slot"]) for r in got) == [(1, 1, 0), (2, 2, got[0]["slot"] if got[0]["doc_id"] == 2 else got[1]["slot"])]


def test_share_moves_excess_by_weight(spark):
    assert share([100, 100, 100], [5, 2, 1], 450) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert share([10, 1000, 0], [5, 2, 1], 1515) == [20.0, 1495.0, 0.0]
    assert share([], [], 0) == []
    rng = random.Random(3)
    for n in (0, 1, 3, 40):
        names = sorted(f"s{rng.randrange(10**6)}é" for _ in range(n))
        sizes = [int(rng.paretovariate(0.4)) % 10**6 * (rng.random() < 0.9) for _ in names]
        # A source's size comes in two counted sizes.
        counted = spark.createDataFrame([(s, z, 1) for s, z in zip(names, sizes, strict=True)] + [(s, 0, 2) for s in names] + [(None, 5, 7)] * (n > 0), "source string, size long, n long")
        got = {r["of"]: (r["source_size"], r["target"]) for r in mixing.targets(counted).collect()}
        every = [*names, *([None] if n else [])]
        full = [*sizes, *([35] if n else [])]
        want = share(full, [(5, 2, 1)[i % 3] for i in range(len(every))], 1.5 * sum(full))
        assert got == {s: (z, pytest.approx(w)) for s, z, w in zip(every, full, want, strict=True)}


def test_many_sources(spark):
    """A source for every site: fifty thousand of them, a third of all rows in one."""
    n = 75_000
    docs = spark.range(n).selectExpr("id doc_id", "repeat('w ', cast(1 + id * 7919 % 23 as int)) text", "'en' lang", "case when id < 25000 then 'site0' else concat('site', id) end source", "0L n_chars")
    got = mixing.mix(docs)
    r = got.selectExpr("count(*) n", "count(distinct source) sources", "sum(taken) taken", "sum(size) size", "max(taken - 2 * size) over").first()
    assert (r["n"], r["sources"], r["over"]) == (n, 50_001, 0) and abs(r["taken"] / r["size"] - 1.5) < 0.15


def test_mix_comes_near_its_targets(spark):
    rows = _mixed_rows()
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, _ in rows)
    total = Counter()
    for _, t, s in rows:
        total[s] += len(words(t))
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode("utf-32-be")) + [None]
    want = dict(zip(names, share([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(total.values())), strict=True))
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in names:
        if total[s] > 50:
            assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 40)
    assert {(r["doc_id"], r["key"], r["source"]): r["taken"] for r in mixing.mix(docs.repartition(5)).collect()} == {(r["doc_id"], r["key"], r["source"]): r["taken"] for r in got}
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    # Rows alike in doc_id, text and source are taken alike.
    assert sum(len(words(r["text"])) for r in out.collect()) == sum(r["taken"] for r in got)


def _dual(sizes, target):
    """Rates of the entropy problem by bisection on its multiplier."""
    sizes, low, high = np.array(sizes, float), -4000.0, 4000.0
    with np.errstate(over="ignore"):
        rates = lambda m: 2 / (1 + np.exp(-m * sizes / sizes.mean()))
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (sizes * rates(mid)).sum() < target else (low, mid)
        return rates((low + high) / 2)


def test_rates_solve_the_dual(spark):
    rng = random.Random(8)
    # Targets by the shares: words of "a" at the cap, "b" above, "c" below its own words, "d" nearly none of them.
    sizes = {"a": [1, 5, 0, 40], "b": [int(rng.paretovariate(0.8)) % 3000 + 1 for _ in range(150)], "c": [rng.randrange(1, 90) for _ in range(150)] + [0], "d": [1, 2, 3, 9000, 20000, 70000]}
    rows, n = [], 0
    for s, of in sizes.items():
        for k in of:
            rows.append((n, "w " * k, s))
            n += 1
    got = {}
    for r in mixing.mix(frame(spark, rows)).collect():
        got.setdefault(r["source"], {})[r["doc_id"]] = r
    for s, of in sizes.items():
        mine = [got[s][i] for i in sorted(got[s])]
        target = mine[0]["target"]
        rates = np.array([r["rate"] for r in mine])
        assert [r["size"] for r in mine] == of and abs((rates * of).sum() - target) <= 1e-6 * target
        if target >= 2 * sum(of):
            assert (rates == 2).all()
        else:
            assert np.allclose(rates, _dual(of, target), atol=1e-5) and np.ptp(rates) > 0.05
    assert got["a"][0]["target"] == 2 * sum(sizes["a"])


def test_mix_of_no_rows(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None), (2, "")])).select("taken").distinct().collect()[0][0] == 0


TEXTS = ["", "  a  b \n c", " x  y", "a <|endoftext|> b", "x\x1c y z", "don't 's a 's", " lead", "trail ", "a\n\nb c\td", "w" * 100 + " b " + "é" * 50, "a \n b", "plain words, one by one.\nAnd 12 lines; more—of “it”.", "日本語 の テキスト", "non break here", "tab\tin it"]


def test_ids_are_the_vocabulary_files():
    encoder = packing._encoder(packing.vocabulary_paths())
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(TEXTS) + "".join(rng.choice("abcéß.,'1 ") for _ in range(9)) for _ in range(20)) for _ in range(60)] + [None]
    want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for most in (packing.KEPT_UNITS, 40):
        encoder.clear(most)
        for low in range(0, len(texts), 9):
            part = texts[low : low + 9]
            ids, first = encoder.encode(pa.array(part, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want[low : low + 9]
    encoder.clear(packing.KEPT_UNITS)


def test_pieces_are_powers_of_two_that_add_up():
    for n in [1, 2, 3, 2047, 2048, 2049, 10000]:
        p = packing.piece_lengths(n)
        assert sum(p) == n and all(x & (x - 1) == 0 and x <= 2048 for x in p) and p == sorted(p, reverse=True)


def test_pack_round_trip(spark):
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, " ".join(prose(rng, 4000))), (None, "nameless row"), (51, None), (0, "again"), (0, "again")]
    got = packing.pack(frame(spark, rows)).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    assert all(r["offset"] == 0 and len(r["ids"]) == 4 * r["length"] for r in got)
    by_length = sorted((r["sequence_id"], r["length"]) for r in got)
    assert [n for _, n in by_length] == sorted(n for _, n in by_length)
    tokenizer = packing._encoder(packing.vocabulary_paths()).tokenizer
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for n in packing.piece_lengths(len(ids)):
            want[(i, at, len(ids), np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    assert Counter((r["doc_id"], r["start"], r["doc_tokens"], bytes(r["ids"])) for r in got) == want
    assert packing.pack(frame(spark, [])).count() == 0


def _quality_rows(rng):
    rows, labels = [], []
    for i in range(240):
        w = prose(rng, rng.randrange(20, 200))
        bad = i % 4 == 0
        t = " ".join(x.upper() + "!!" for x in w) if bad and i % 8 else " | ".join(w) if bad else ". ".join(" ".join(w[k : k + 8]).capitalize() for k in range(0, len(w), 8))
        rows.append((i, t, "host" if i % 3 else f"h{i}", "en" if i % 2 else "de"))
        if i < 160:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_keeps_good_rows(spark):
    rows, labels = _quality_rows(random.Random(2))
    odd = [(1000, None, "host"), (1001, "", None, "en"), (None, rows[1][1], None), (1, rows[1][1], "host"), (1002, "Long text. " * 20000, "host")]
    docs, marks = frame(spark, rows + odd), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (777, 1, 0)], LABELS)
    got = quality.posteriors(docs, marks).collect()
    assert len(got) == len(rows) + len(odd)
    kept = {r["doc_id"]: r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 240}
    assert np.mean([kept[i] == (i % 4 != 0) for i in range(160, 240)]) > 0.97
    assert {r["doc_id"]: r["kept"] for r in got if r["doc_id"] in (1000, 1001)} == {1000: False, 1001: False}
    good = quality.keep_good(docs, marks)
    assert good.columns == docs.columns and good.count() == sum(r["kept"] for r in got)
    assert quality.posteriors(frame(spark, []), marks).count() == 0
    assert {r["kept"] for r in quality.posteriors(frame(spark, rows[:3]), marks.limit(0)).collect()} == {True}


def test_sparse_sites_shrink_to_their_priors(spark):
    odds = [(s, "en", 4.0 if good else -4.0) for s, n, k in (("a", 300, 270), ("b", 300, 90), ("tiny", 1, 0), ("c", 200, 120)) for good in [True] * k + [False] * (n - k)]
    odds.append((None, None, None))
    got = {r["source"]: r["rate"] for r in quality.site_rates(spark.createDataFrame(odds, "source string, lang string, evidence double"), 0.0).collect()}
    assert got["a"] > 0.8 and got["b"] < 0.4 and 0.2 < got["tiny"] < 0.6 and set(got) == {"a", "b", "c", "tiny", None}


def _page(body, article=True):
    return f"<!DOCTYPE html><html><head><title>T t</title><script>if (a<b) x='</p>';</script></head><body><nav><ul><li><a href='/x'>Home page</a></li><li><a>Other</a></li></ul></nav><!-- c --><div class=\"ad\">Buy it now cheap</div>{'<article>' if article else '<div>'}{body}{'</article>' if article else '</div>'}<footer>&copy; foot note</footer></body></html>"


BODY = "<h1>The  head &amp; more</h1><p>First <b>bo</b>ld\n para<br>graph that has a fair number of words in it.<p>Second &lt;one&gt; &eacute; with some words too.</p><div class='advert box'>An advert inside</div><ul><li>item one</li><li>item two</li></ul>"
TEXT = "The head & more First bold para graph that has a fair number of words in it. Second <one> é with some words too. item one item two"


def test_main_text_of_pages(spark):
    comments = "<section id='comments'><p>Reader one says a lot of words here that are not the article at all.</p></section>"
    pages = [_page(BODY + f"<p>more text of page {i} follows here</p>") for i in range(30)]
    odd = {100: None, 101: "", 102: "plain words only", 103: _page(BODY, article=False), 104: _page(BODY) + comments, 105: _page(BODY)[:-14], 106: "<p>unclosed <b>text", 107: "<script>x</script>", 108: _page(BODY + "<aside>side words</aside><form><label>Mail</label><input></form>"), 109: "<a < b> text", 110: _page("<p>" + "long words here " * 30000 + "</p>")}
    rows = [(i, "u", p, "x") for i, p in enumerate(pages)] + [(i, None, p, "x") for i, p in odd.items()] + [(None, "u", pages[0], "x"), (3, "u", pages[3], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {}
    for r in html_text.extract(df).collect():
        got[r["page_id"]] = r["text"]
        assert r["n_chars"] == len(r["text"])
    for i in range(30):
        assert got[i] == f"{TEXT} more text of page {i} follows here"
    assert got[None] == got[0] and [got[i] for i in (100, 101, 107)] == ["", "", ""]
    assert got[102] == "plain words only" and got[106] == "unclosed text"
    assert [got[i] for i in (103, 104, 105, 108)] == [TEXT] * 4
    assert got[110] == " ".join(["long words here"] * 30000)
    assert html_text.extract(df.limit(0)).count() == 0


def test_furniture_inside_and_around_the_article():
    nav, text = "<nav><a>Home</a></nav>", "Words of the article go on for a while here and end now."
    for page in (
        f"<body class='has-sidebar'>{nav}<div class='wrap sidebar'><article><p>{text}</p></article></div></body>",
        f"<body>{nav}<main><p>{text}</p><div class='cookie-notice'>We use cookies, click here</div></main></body>",
        f"<body>{nav}<article><p>{text}</p><section class='comments'><article class='comment'><p>Nice one, I liked this a lot, thank you.</p></article></section></article></body>",
        f"<body><header><h2>Site name</h2></header><div class='content with-menu'><p>{text}</p><p hidden>unseen words</p></div><footer>foot</footer></body>",
        f"<body><p>{text}</p><form><label>Your mail</label><textarea>Type here</textarea></form><aside>More to read</aside></body>",
    ):
        assert html_text.main_text(page, {}) == text


def test_names_and_styles_do_not_hide_the_text():
    nav, text = "<nav><a>Home</a></nav>", "Words of the article go on for a while here and end now."
    body = f"<p>{text}</p><p>More of it.</p>"
    for wrap in ("style='overflow:hidden'", "style='overflow: hidden; color:red'", "title='The hidden story'", "data-x='a hidden b'", "class='layout-with-sidebar'", "class='right-sidebar'", "class='share-price'", "id='search-results'", "class='social-policy'", "class='sidebar'", "data-id='menu'", "id='comment'"):
        assert html_text.main_text(f"<body>{nav}<div {wrap}>{body}</div><footer>foot</footer></body>", {}) == f"{text} More of it."
    # Among other text such an element is read where the text goes on behind it, and links are never hidden by their targets.
    for part in ("<div class='share-price'>It fell</div>", "<p><a href='/hidden/gems'>It fell</a></p>", "<div style='float:left;overflow:hidden'>It fell</div>"):
        assert html_text.main_text(f"<body>{nav}<div><p>{text}</p>{part}<p>{text}</p></div></body>", {}) == f"{text} It fell {text}"
    for part in ("<div hidden>It fell</div>", "<div hidden='hidden'>It fell</div>", "<div style='color:red;display : none'>It fell</div>", "<div class='ad-banner'>It fell</div>", "<div id='comments'>It fell</div>"):
        assert html_text.main_text(f"<body>{nav}<div><p>{text}</p>{part}<p>{text}</p></div></body>", {}) == f"{text} {text}"
    # Comments longer than the text, and names that only end so, behind it.
    assert html_text.main_text(f"<body>{nav}<p>{text}</p><div class='comments'>{'I liked this a lot. ' * 9}</div></body>", {}) == text
    assert html_text.main_text(f"<body>{nav}<p>{text}</p><div class='site-footer'>All rights reserved</div></body>", {}) == text


def test_region_is_the_best_run():
    rng = random.Random(1)
    for _ in range(50):
        cut = [(("w", "a", False, False, "") if rng.random() < 0.6 else ("<t", "", False, True, "")) for _ in range(25)]
        weights = {"w w": 0.7, "t <t": -0.9}
        score = [0.7 if t[1] else -0.9 for t in cut]
        a, b = html_text.region(cut, weights)
        assert sum(score[a:b]) == pytest.approx(max(sum(score[i:j]) for i in range(26) for j in range(i, 26)))


def _toxic_rows(rng):
    rows, labels = [], []
    for i in range(500):
        w = prose(rng, rng.randrange(10, 120), 400)
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["Nasty", "vileness,", "VILENESS", "nasty.", f"scumb{rng.randrange(50)}"]))
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_finds_held_out_rows(spark):
    rows, labels = _toxic_rows(random.Random(6))
    docs = frame(spark, [*rows, (900, None), (901, ""), (None, rows[0][1]), (0, rows[0][1]), (902, "the nasty " * 40000)])
    marks = spark.createDataFrame([*labels, (None, 1, 1), (8, None, None), (7, 1, 0)], LABELS)
    got = toxicity.score(docs, marks).collect()
    assert len(got) == 505 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) for r in got)
    found = {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] is not None}
    right = [found[i] == int(i % 5 == 0) for i in range(500) if held(i) or i >= 400]
    assert np.mean(right) > 0.95
    assert found[900] == found[901] == 0 and found[902] == 1
    assert not any(held(n) for r in got for n in r["neighbours"])
    assert {r["score"] for r in toxicity.score(docs.limit(3), marks.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), marks).count() == 0


def test_copies_of_examples_without_telling_terms_are_found(spark):
    rng = random.Random(12)
    # No term is in three texts, so none tells the label by its count.
    rows = [(i, " ".join(f"{chr(97 + k)}{i:02d}{rng.randrange(9)}" for k in range(12))) for i in range(48)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(48)]
    known = [i for i in range(48) if zlib.crc32(str(i).encode()) % 4 in (0, 1)]
    docs = frame(spark, rows + [(1000 + i, rows[i][1]) for i in known])
    got = {r["doc_id"]: r for r in toxicity.score(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert len(known) > 10 and all(got[1000 + i]["neighbours"][:1] == [i] and got[1000 + i]["neighbours_toxic"][:1] == [int(i % 3 == 0)] for i in known)


def _plain_scores(rows, labels):
    """Scores by the definition: vectors over all terms of a text, all cosines, votes, the curve."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    count = lambda t: Counter(zlib.crc32(w[:4].encode()) % toxicity.BUCKETS for w in re.findall(r"\w+", (t or "").lower()))
    df = Counter(t for _, text in rows for t in count(text))
    idf = lambda t: math.log((len(rows) + 1) / (df[t] + 1)) + 1e-6

    def vector(text):
        v = {t: n**toxicity.COUNT_POWER * idf(t) ** toxicity.IDF_POWER for t, n in count(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / norm for t, x in v.items()}

    mark = dict(labels)
    own = [(i, vector(t)) for i, t in rows if i in mark and fold(i) in (0, 1) and t is not None]
    prior = sum(y for i, y in labels if fold(i) != 2) / sum(fold(i) != 2 for i, _ in labels)

    def vote(text):
        v = vector(text)
        near = sorted(((sum(x * e.get(t, 0) for t, x in v.items()), i) for i, e in own), reverse=True)
        near = [(c, i) for c, i in near if c > 0][: toxicity.NEIGHBOURS]
        weight = [1 / (0.05 + 1 - min(c, 1)) for c, _ in near]
        return (sum(w * mark[i] for w, (_, i) in zip(weight, near, strict=True)) + prior) / (sum(weight) + 1)

    fit = sorted((vote(t), mark[i]) for i, t in rows if i in mark and fold(i) == 3 and t is not None)
    toxic = sum(y for _, y in fit)
    times = [1 if y else max(1, round((1 - prior) / prior * toxic / (len(fit) - toxic))) for _, y in fit]
    curve = toxicity.monotone(np.repeat([v for v, _ in fit], times), np.repeat([float(y) for _, y in fit], times))
    return {i: (float(np.interp(vote(t), *curve)), vote(t)) for i, t in rows}


def test_scores_match_the_plain_version(spark):
    rng = random.Random(15)
    rows, labels = [], []
    for i in range(260):
        w = prose(rng, rng.randrange(5, 60), 300) + [f"{rng.choice('abcd')}{rng.random()}x" for _ in range(rng.randrange(6))]
        if i % 4 == 0:
            w += rng.choices(["nasty", "Nastily", "vile,", "VILEST"], k=rng.randrange(1, 5))
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        if i < 220:
            labels.append((i, int(i % 4 == 0 or rng.random() < 0.05)))
    rows += [(300, ""), (301, None), (302, "?!"), (303, "unknown zzyzx only")]
    want = _plain_scores(rows, labels)
    got = toxicity.score(frame(spark, rows), spark.createDataFrame([(i, 1, y) for i, y in labels], LABELS)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]][0], abs=1e-6), r["doc_id"]


@pytest.mark.parametrize("examples", [0, 5, 31, 300])
def test_block_bounds_leave_neighbours_exact(examples):
    rng = np.random.default_rng(4)
    dense = rng.random((examples, 60)) * (rng.random((examples, 60)) < np.where(np.arange(60) < 20, 0.6, 0.05))
    dense[2:4] = dense[:2]
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-9)[:, None]
    at, term = np.nonzero(dense)
    index = toxicity.Postings(at, term * 3, dense[at, term], examples)
    queries = rng.random((40, 60)) * (rng.random((40, 60)) < 0.2)
    queries[0] = 0
    row, term = np.nonzero(queries)
    term, weight = np.append(term * 3, 500), np.append(queries[row, term], 9.0)
    place, cosine, done = index.nearest(np.append(row, 39), term, weight, 40, toxicity.NEIGHBOURS)
    assert done <= 40 * index.blocks
    for q in range(40):
        every = dense @ queries[q]
        order = [i for i in np.lexsort((np.arange(examples), -np.round(every, 12))) if every[i] > 0][: toxicity.NEIGHBOURS]
        assert place[q][place[q] >= 0].tolist() == order and np.allclose(cosine[q][: len(order)], every[order])


def test_curve_rises():
    x, y = np.array([0, 0, 0.2, 0.4, 0.4, 0.9, 1.0]), np.array([0, 0, 1, 0, 0, 1, 1])
    knots, values = toxicity.monotone(x, y)
    assert values == sorted(values) and knots == sorted(knots) and len(set(knots)) == len(knots)
