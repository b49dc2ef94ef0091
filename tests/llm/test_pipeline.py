"""The pipeline's stages in order, on the smallest documents."""

from collections import Counter

import corpus_pipeline
from salesops.llm import packing
from salesops.llm.graph import stored
from tests.llm.helpers import bag, frame, jaccard, words

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stored(stage(spark, seen[-1], SF)))
        assert seen[-1].columns == columns, name
    good, near, cut, mixed = ([r.asDict() for r in d.collect()] for d in seen[1:])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in good}
    assert sum((d in ids) == bool(q) for d, q in labels.items()) > 0.95 * len(labels)
    bags = {r["doc_id"]: bag(r["text"]) for r in near}
    assert all(jaccard(bags[a], bags[b]) < 0.8 for a in bags for b in bags if a < b)
    left = {r["doc_id"] for r in near}
    good_bags = {r["doc_id"]: bag(r["text"]) for r in good}
    assert all(any(jaccard(good_bags[r["doc_id"]], good_bags[k]) >= 0.8 for k in good_bags if k < r["doc_id"]) for r in good if r["doc_id"] not in left)
    assert {r["doc_id"] for r in cut} <= left
    assert {(r["doc_id"], r["text"]) for r in mixed} <= {(r["doc_id"], r["text"]) for r in cut}
    assert abs(sum(len(words(r["text"])) for r in mixed) / sum(len(words(r["text"])) for r in cut) - 1.5) < 0.03
    rows = corpus_pipeline.run(spark, SF).collect()
    encode = packing._encoder(packing.vocabulary_paths()).tokenizer.encode
    want = Counter()
    for r in mixed:
        want[r["doc_id"]] += len(encode(r["text"], add_special_tokens=False).ids) + 1
    held = Counter()
    for r in rows:
        held[r["doc_id"]] += r["length"]
    assert held == want and sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))


def test_stages_take_odd_rows(spark):
    docs = frame(spark, [(1, None), (None, "a b c"), (2, ""), (3, "x " * 50), (3, "x " * 50), (4, "Some words. In a line.", None)])
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stored(stage(spark, at, SF))
            assert at.columns == docs.columns
        rows = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
        assert not empty or not rows
