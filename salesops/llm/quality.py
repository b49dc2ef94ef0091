"""Quality classifier with hierarchical empirical Bayes over sites.

1. Every text gets a dozen measures (word lengths, shares of distinct, repeated
   and upper-case words, of letters, digits and marks by kind, repeated
   five-word shingles, words a line, length), all from its whole word array.
2. A ridge logistic regression, fitted on a bounded sample of labelled rows,
   turns them into evidence: the log odds of good over bad, less the sample's base odds.
3. Grouped sums of the documents' probabilities give each host (``source``) and
   each path (``source`` and ``lang``) a rate.  Rates shrink by empirical Bayes: a host's
   towards the global rate, a path's towards its host's, by the strength that the
   spread between sites shows (method of moments); sparse sites move to their prior.
4. Posterior log odds = evidence + log odds of the path's rate.

Defined results: null and empty texts are bad (probability 0).  A null source
or lang is a site of its own.  Rows with a null or repeated doc_id are scored
like others; labels that contradict each other count as bad.  Without labels of both kinds every
text with words has probability 1.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesops.llm.bagminhash import shingles
from salesops.llm.graph import stored
from salesops.llm.tasks import map_arrow
from salesops.llm.text import chunks, words

#: Most labelled rows the classifier is fitted on.
SAMPLE = 20_000
RIDGE, STEPS = 1.0, 30
THRESHOLD = 0.5
#: Bounds of the prior's strength, in documents, and of a document's evidence.
STRENGTH = (2.0, 2000.0)
EVIDENCE = 12.0
#: Most sites whose rates are broadcast; beyond it they are joined by shuffle.
BROADCAST_SITES = 100_000

_UPPER, _LOWER, _DIGIT, _MARK, _BAR, _BANG, _LINE, _HIGH = range(8)
_KIND = np.full(256, -1, np.int8)
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("a") : ord("z") + 1] = _LOWER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = _MARK
_KIND[ord("|")], _KIND[ord("!")], _KIND[0x0A] = _BAR, _BANG, _LINE
_KIND[0x80:] = _HIGH

MEASURES = ("letters_up", "digits", "marks", "bars", "bangs", "high", "log_words", "word_length", "word_spread", "distinct", "next_same", "line_words", "shingles_again", "capital_words")


def _distinct(doc: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct values of each row."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return np.bincount(d[new], minlength=rows)


def measures(texts: pa.Array) -> np.ndarray:
    """Rows x MEASURES; rows without words have zeros."""
    n = len(texts)
    w = words(texts)
    h = w.hashes()
    count = np.diff(w.first)
    some = np.maximum(count, 1).astype(float)
    size = (w.end - w.start).astype(float)
    length = np.bincount(w.doc, size, n)
    chars = np.maximum(length, 1)
    row = np.repeat(w.doc, (w.end - w.start))
    # Bytes inside words, by kind and row; line ends lie between words and are counted from the gaps.
    inside = np.arange(len(row)) - np.repeat(np.cumsum(size).astype(np.int64) - size.astype(np.int64), size.astype(np.int64)) + np.repeat(w.start, size.astype(np.int64))
    kind = _KIND[w.data[inside]].astype(np.int64)
    ok = kind >= 0
    kinds = np.bincount(row[ok] * 8 + kind[ok], minlength=8 * n).reshape(n, 8).astype(float)
    lines = np.zeros(n)
    if len(w.start) > 1:
        gaps = np.append(0, np.cumsum(w.data == 0x0A))
        broken = (gaps[w.start[1:]] - gaps[w.end[:-1]] > 0) & (w.doc[1:] == w.doc[:-1])
        lines = np.bincount(w.doc[1:][broken], minlength=n).astype(float)
    mean = length / some
    spread = np.sqrt(np.maximum(np.bincount(w.doc, size * size, n) / some - mean * mean, 0))
    same = np.bincount(w.doc[1:][(h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
    doc, value = shingles(w, h)
    pieces = np.maximum(np.bincount(doc, minlength=n), 1)
    again = 1 - _distinct(doc, value, n) / pieces
    lead = _KIND[w.data[w.start]] == _UPPER if len(w.start) else np.zeros(0, bool)
    letters = np.maximum(kinds[:, _UPPER] + kinds[:, _LOWER], 1)
    out = np.stack([
        kinds[:, _UPPER] / letters, kinds[:, _DIGIT] / chars, kinds[:, _MARK] / chars, kinds[:, _BAR] / some, kinds[:, _BANG] / some, kinds[:, _HIGH] / chars,
        np.log1p(count), mean, spread, _distinct(w.doc, h, n) ** 1.0 / some, same / some, np.log1p(count / (lines + 1)), np.where(count > 0, again, 0), np.bincount(w.doc[lead], minlength=n) / some,
    ], axis=1)
    out[count == 0] = 0
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and coefficients (the last one is the constant) of a ridge logistic regression by Newton steps.

    Squares of the standardised measures join in, so that a measure may be bad at either end."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = _design(x, centre, scale)
    b = np.zeros(z.shape[1])
    ridge = np.full(len(b), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, b


def _design(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / scale, -6, 6)
    return np.concatenate([z, z * z / 4, np.ones((len(z), 1))], axis=1)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple | None:
    """Classifier from at most ``sample`` labelled rows drawn by a hash of doc_id; also the sample's base log odds."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = stored(marks.orderBy(F.xxhash64(F.lit(43), "doc_id"), "doc_id").limit(sample))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                x = measures(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("quality"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["quality", "x"])

    # The sample's bound makes its broadcast and the collected measures bounded as well.
    told = map_arrow(_texts(docs).where("text is not null").join(F.broadcast(drawn), "doc_id").select("text", "quality"), run, "quality int, x array<double>").toPandas()
    if told["quality"].nunique() < 2:
        return None
    x, y = np.stack(told["x"].to_numpy()), told["quality"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same sums whatever the order of arrival
    x, y = x[order], y[order]
    return (*fit(x, y), float(np.log(y.mean() / (1 - y.mean()))))


def evidence(docs: DataFrame, model: tuple | None, carry: list[str]) -> DataFrame:
    """Adds ``evidence`` (null without words) to the columns ``carry`` of ``docs``, which has ``text``."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                x = measures(part.column("text"))
                empty = x[:, MEASURES.index("log_words")] == 0
                if model is None:
                    value = np.full(len(x), EVIDENCE)
                else:
                    centre, scale, b, base = model
                    value = np.clip(_design(x, centre, scale) @ b - base, -EVIDENCE, EVIDENCE)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carry] + [pa.array(value, pa.float64(), mask=empty)], names=[*carry, "evidence"])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return map_arrow(docs, run, ", ".join(f"`{c}` {fields[c]}" for c in carry) + ", evidence double")


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def _chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _strength(sites: DataFrame) -> float:
    """Documents the prior counts for: from the spread of rates between sites beyond what their sizes explain."""
    r = sites.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("k"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n"), 2)).alias("sq"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r["n"] or r["k"] < 2:
        return STRENGTH[1]
    p = r["good"] / r["n"]
    within = p * (1 - p)
    between = ((r["sq"] - r["n"] * p * p) - (r["k"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(min(STRENGTH[1], max(STRENGTH[0], within / between - 1 if between > 0 else STRENGTH[1])))


def site_rates(scored: DataFrame, base: float) -> DataFrame:
    """source, lang and shrunken rate of each path; scored: source, lang, evidence."""
    good = F.sum(F.coalesce(_chance(F.col("evidence") + base), F.lit(0.0))).alias("good")
    paths = stored(scored.groupBy("source", "lang").agg(good, F.count("*").cast("double").alias("n")))
    hosts = paths.groupBy("source").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("good"), F.sum("n")).first()
    overall = (total[0] or 0.0) / max(total[1] or 0.0, 1.0)
    k, kp = _strength(hosts), _strength(paths)
    host = hosts.select(F.col("source").alias("host"), ((F.col("good") + k * overall) / (F.col("n") + k)).alias("host_rate"))
    return paths.join(host, F.col("source").eqNullSafe(F.col("host"))).select("source", "lang", ((F.col("good") + kp * F.col("host_rate")) / (F.col("n") + kp)).alias("rate"))


def posteriors(docs: DataFrame, labels: DataFrame, whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, evidence, site_rate, probability, kept; ``whole`` adds text and the struct ``rest`` of its other columns."""
    model = train(docs, labels)
    base = model[3] if model else 6.0
    rows = _texts(docs)
    sites = stored(site_rates(evidence(rows.select("text", "source", "lang"), model, ["source", "lang"]), base))
    small = sites.count() <= BROADCAST_SITES
    carry = []
    if whole:
        rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
        rows = docs.select(rest, F.col("text").cast("string").alias("text")).select("rest", "text", *(F.col(f"rest.{c}").cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("lang", "string"))))
        carry = ["rest", "text"]
    scored = evidence(rows, model, ["doc_id", "source", "lang", *carry])
    at = sites.select(F.col("source").alias("of"), F.col("lang").alias("in"), F.col("rate").alias("site_rate"))
    scored = scored.join(F.broadcast(at) if small else at, F.col("source").eqNullSafe(F.col("of")) & F.col("lang").eqNullSafe(F.col("in"))).drop("of", "in")
    chance = F.when(F.col("evidence").isNull(), 0.0).otherwise(_chance(F.col("evidence") + _odds(F.col("site_rate"))))
    return scored.withColumn("probability", chance).withColumn("kept", F.col("probability") >= THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    kept = posteriors(docs, labels, whole=True).where("kept")
    return kept.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
