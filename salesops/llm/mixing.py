"""Mixing sources to target weights by entropy balancing.

Sources share a budget of words by weight, none above a cap.  The capped shares
come from one threshold: each source takes the smaller of its cap and its
weight times the threshold, which rises until the shares add up to the budget.

Inside a source
every document gets a rate, a mean number of copies between 0 and ``CAP``.  The
rates minimise the entropy distance from one copy of each document, the sum of
rate * log(rate) + (CAP - rate) * log((CAP - rate) / (CAP - 1)), under the
source's word constraint; the convex dual has one multiplier per source, and its
solution tilts the rates exponentially: rate = CAP / (1 + (CAP - 1) *
exp(-multiplier * size / mean size)).  The multiplier is 0 only where the target
is the source's own words.  Newton steps on the log odds of the words taken run
for all sources at once, kept inside the bracket that the steps before left: a
step is one grouped sum over (source, size) counts, joined with the multipliers.

Whole copies come from the rates by a phase in [0, 1) hashed from the row:
copies = floor(rate + phase + shift).  The shift of each source is found by
grouped sums at many shifts at once, narrowing three times, so that the words taken
stay at or below the target, and a last correction adds one copy of the document
that brings them nearest to it.  No sort, window or list over a source is taken: a
source with a third of all rows is summed in parts like any other.

Sources' values (sizes, targets, multipliers, shifts) are small Spark tables, written
at each step; the driver gets numbers of rows and the threshold's sums only, so
there may be a source for every site.  Sums are taken in whole numbers and decimals, so
that reruns agree to the last digit.

Defined results: null and empty texts have size 0 and take 0 words.  A null
source is a source of its own, last in order.  Rows with a null doc_id or
repeating one are documents of their own.  A source without words has target 0.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesops.llm.graph import numbered, stored

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
#: Newton steps before halvings of the bracket take over, and the part of a target that words may miss it by.
NEWTON_STEPS, TOLERANCE = 12, 1e-7
SHIFTS, NARROWINGS = 64, 3
def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and phase of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.xxhash64(text).alias("key"))
    return rows.withColumn("phase", F.pmod(F.xxhash64(F.lit(17), "doc_id", "key"), F.lit(1 << 32)) / float(1 << 32))


def _joined(df: DataFrame, small: DataFrame) -> DataFrame:
    """Joins one row per source (column ``of``)."""
    return df.join(small, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def threshold(sources: DataFrame, budget: float, cap: float = CAP) -> float:
    """The number by which weights become shares, each at most ``cap`` times its source's size, that add up to ``budget``; sources: weight, source_size.

    Newton steps on the sum of the shares, which is made of straight pieces that flatten: from below, a step per capped group of sources."""
    least, last = 0.0, -1.0
    limit = F.col("source_size") * F.lit(float(cap))
    while least > last:
        last = least
        over = limit <= F.col("weight") * F.lit(last)
        r = sources.where("source_size > 0").agg(F.sum(F.when(over, limit)).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if not r["weight"]:
            break
        least = max(last, (budget - (r["taken"] or 0.0)) / r["weight"])
    return least


def targets(counted: DataFrame) -> DataFrame:
    """of (the source), source_size, mean size and target of every source; counted: source, size, n."""
    held = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    last = F.col("source").isNull()
    weights = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    ranked = stored(numbered(held, last, "source").withColumn("weight", weights))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    unit = threshold(ranked, BUDGET * total)
    share = F.least(F.col("source_size") * float(CAP), F.col("weight") * F.lit(unit))
    mean = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("n")).otherwise(1.0)
    return ranked.select(F.col("source").alias("of"), "source_size", mean.alias("mean"), share.alias("target"))


def _rate(multiplier: Column) -> Column:
    """Tilted rate of a row that carries fill, mean and size; a source at its cap takes all of it."""
    x = multiplier * F.col("size") / F.col("mean")
    return F.when(F.col("fill") >= 1, float(CAP)).when(F.col("fill") <= 0, 0.0).otherwise(CAP / (1 + (CAP - 1) * F.exp(-x)))


def _sum(value: Column) -> Column:
    """Sum whose order does not matter."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def _next(newton: bool) -> Column:
    """A Newton step on the log odds of the words taken, or where that leaves the bracket its middle (twice as far where it is open)."""
    value, low, high, goal, top, words, slope = (F.col(c) for c in ("multiplier", "low", "high", "target", "top", "words", "slope"))
    odds = lambda w: F.log(w / (top - w))
    inside = F.when(newton & (slope > 0) & (words > 0) & (words < top), value + (odds(goal) - odds(words)) * words * (top - words) / (slope * top))
    end = F.lit(float("inf"))
    other = F.when(low == -end, F.least(2 * high, high - 1)).when(high == end, F.greatest(2 * low, low + 1)).otherwise((low + high) / 2)
    return F.when((inside > low) & (inside < high), inside).otherwise(other)


def multipliers(counted: DataFrame, told: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """of and multiplier of every source; counted: source, size, n; told: of, target, mean, fill."""
    end = F.lit(float("inf"))
    begin = told.select("of", "target", "mean", "fill", F.lit(0.0).alias("multiplier"), (-end).alias("low"), end.alias("high"))
    whole = begin.where("fill <= 0 or fill >= 1").select("of", "multiplier")
    open_, found, done = stored(begin.where("fill > 0 and fill < 1")), whole, 0
    r, words = _rate(F.col("multiplier")), (F.col("n") * F.col("size")).cast("double")
    sums = (_sum(words * r).alias("words"), _sum(words * r * (1 - r / CAP) * F.col("size") / F.col("mean")).alias("slope"), (CAP * _sum(words)).alias("top"))
    while not open_.isEmpty():
        state = _joined(counted, open_).groupBy("source").agg(*sums, *(F.first(c).alias(c) for c in ("target", "mean", "fill", "multiplier", "low", "high")))
        under = F.col("words") < F.col("target")
        state = state.withColumn("low", F.when(under, F.col("multiplier")).otherwise(F.col("low"))).withColumn("high", F.when(under, F.col("high")).otherwise(F.col("multiplier")))
        state = state.withColumn("next", F.when(F.abs(F.col("target") - F.col("words")) > TOLERANCE * F.greatest("target", F.lit(1.0)), _next(F.lit(done < steps))))
        # A bracket without a number between its ends is as near as numbers come.
        state = stored(state.withColumn("next", F.when((F.col("next") > F.col("low")) & (F.col("next") < F.col("high")), F.col("next"))).withColumnRenamed("source", "of"))
        found = found.unionByName(state.where("next is null").select("of", "multiplier"))
        open_ = state.where("next is not null").select("of", "target", "mean", "fill", F.col("next").alias("multiplier"), "low", "high")
        done += 1
    return stored(found)


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, key (xxhash64 of the text), size, source_size, target, rate, copies, taken."""
    rows = stored(sized(docs))
    counted = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    told = stored(targets(counted).withColumn("fill", F.when(F.col("source_size") > 0, F.col("target") / (CAP * F.col("source_size"))).otherwise(0.0)))
    facts = told.join(multipliers(counted, told).withColumnRenamed("of", "in"), F.col("of").eqNullSafe(F.col("in"))).drop("in")
    rated = stored(_joined(rows, facts).withColumn("rate", _rate(F.col("multiplier"))).drop("multiplier", "fill", "mean"))

    def copies(shift: Column) -> Column:
        whole = F.floor(F.col("rate") + F.col("phase") + shift)
        return F.when(F.col("rate") >= CAP, CAP).when(F.col("rate") <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(CAP), whole))).cast("long")

    # Words taken only grow with the shift, so the last of the shifts that stays at or below the target is kept.
    shifts, step = stored(told.select("of", F.col("target").alias("goal"), F.lit(-1.0).alias("shift"))), 2.0 / SHIFTS
    for _ in range(NARROWINGS):
        tried = [F.sum(copies(F.col("shift") + i * step) * F.col("size")).alias(f"w{i}") for i in range(SHIFTS)]
        sums = _joined(rated, shifts).groupBy("source").agg(F.first("goal").alias("goal"), F.first("shift").alias("shift"), *tried)
        fits = sum((F.col(f"w{i}") <= F.col("goal")).cast("int") for i in range(SHIFTS))
        shifts = stored(sums.select(F.col("source").alias("of"), "goal", (F.col("shift") + F.greatest(fits - 1, F.lit(0)) * step).alias("shift")))
        step /= SHIFTS
    taken = stored(_joined(rated, shifts).withColumn("copies", copies(F.col("shift"))).drop("shift", "goal"))
    words = taken.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("words"), F.first("target").alias("goal"))
    left = words.select(F.col("source").alias("of"), (F.col("goal") - F.col("words")).alias("left"))
    # One more copy of the row whose size is nearest to what is left, where that comes nearer.
    more = _joined(taken, left).where(f"copies < {CAP} and size > 0 and abs(left - size) < abs(left) and rate > 0")
    who = F.struct(F.abs(F.col("left") - F.col("size")).alias("off"), F.col("doc_id"), F.col("key"))
    best = stored(more.groupBy("source").agg(F.min(who).alias("best")).select(F.col("source").alias("of"), F.col("best.doc_id").alias("of_id"), F.col("best.key").alias("of_key")))
    hit = F.col("source").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))
    fixed = taken.join(best, hit, "left").withColumn("copies", F.least(F.lit(CAP), F.col("copies") + F.col("of_key").isNotNull().cast("long")))
    return fixed.select("doc_id", "source", "key", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with its columns."""
    own = docs.columns
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    counts = mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("key").alias("__of")).agg(F.max("copies").cast("int").alias("__copies"))
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of")) & keyed["source"].eqNullSafe(F.col("__source"))
    return keyed.join(counts, same).withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*own)
