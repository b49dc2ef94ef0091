"""Document fingerprints by consistent weighted sampling.

1. A document's terms are its words, weighed by their counts.
2. For each of ``SAMPLES`` samples and each term, hashes of (sample, term) give
   r and c, both Gamma(2, 1), and beta, uniform in (0, 1).  With
   t = floor(ln(weight) / r + beta), the sample is the pair (term, t) of smallest
   c / exp(r * (t - beta + 1)).  Two documents have the same sample with a
   probability equal to their generalised Jaccard similarity, the sum of the smaller
   weights over the sum of the larger ones.
3. A fingerprint is eight hex digits of a hash of each sample's pair; the share of
   equal samples estimates the similarity.

``fingerprints`` is that for any table of texts.  ``with_neighbours`` also makes
each document's edited text, whose last quarter is replaced by the beginning of
the next document, and compares.  The order is found on narrow rows (doc_id, text
hash, length), range-partitioned and numbered inside the ranges; the first and last rows
of the ranges, one row a range, link them.  Then every text is shuffled once to its facts
and sends the beginning that the document before it asks for, a quarter of that
one's length at most.  Words, counts and samples are taken where the texts lie.
Rows alike in doc_id and text follow each other, so all but the last of them
are their own next ones: they are one row with a number, cut to one row a task
before the texts are shuffled.

The edited text shares the words of the part that is kept: these are split and
weighed once, and a term with the same count in both texts is sampled once.

Only DataFrame functions run.  A smallest value and its sample travel in one long:
the logarithm, in steps of 2**-24, above 32 bits of the pair's hash.

Defined results: null texts are empty.  Texts without words have the fingerprint of
zeros, likeness 1 to each other and 0 to others.  Equal texts have equal
fingerprints.  Null doc_ids come last; rows that repeat a doc_id follow each
other by text hash.  A single row is its own next one.  Extra columns are
ignored; an empty table gives no rows.  The words of one text are an array in one
task, the only part whose memory grows with a single text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.llm.graph import stored

SAMPLES = 42
#: Samples taken in one row of the aggregation; at eight, the generated method is too long for the JVM to compile.
AT_ONCE = 6
_GAPS = "\t\n\x0b\x0c\r"
_LOW32 = (1 << 32) - 1
_KEY = ["id", "key"]
#: Marks of the two texts that a term may belong to.
ONE, TWO = 1, 2


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """``width`` bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) * F.lit(2.0**-width)


def _sample(number: Column, term: Column, log_weight: Column) -> Column:
    """Rank of a term in one sample, in a long whose low 32 bits tell the pair (term, t)."""
    one, two = F.xxhash64(number, term), F.xxhash64(term, number)
    r = -F.log(_uniform(one, 43, 21) * _uniform(one, 22, 21))
    beta = _uniform(one, 0, 22)
    t = F.floor(log_weight / r + beta)
    rank = F.log(-F.log(_uniform(two, 43, 21) * _uniform(two, 22, 21))) - r * (t - beta + 1)
    # The rank lies between -60 and 4, so the whole stays positive.
    return F.shiftleft(F.floor((rank + 64) * float(1 << 24)), 32).bitwiseOR(two.bitwiseXOR(t).bitwiseAND(F.lit(_LOW32)))


def _spaced(text: Column) -> Column:
    """The text with a space for every character between words (each replacement is a search over bytes, unlike ``translate``)."""
    for gap in _GAPS:
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return text


def _words(text: Column) -> Column:
    """Words of a text and empty strings."""
    return F.split(_spaced(text), " ", -1)


def _sampled(words: DataFrame, keys: list[str], count: int) -> DataFrame:
    """``keys``, ``fingerprint`` and ``other``: fingerprints of the words marked ONE and TWO, null without words.

    words: ``keys``, word, marks.  Rows that lie together by some of the keys are not shuffled."""
    terms = words.where("word <> ''").select(*keys, F.xxhash64("word").alias("term"), "marks")
    inside = [F.sum(F.col("marks").bitwiseAND(m).cast("boolean").cast("int")).alias(f"n{m}") for m in (ONE, TWO)]
    weighed = terms.groupBy(*keys, "term").agg(*inside)
    # A term with the same weight in both texts has the same samples in both.
    same = F.col("n1") == F.col("n2")
    of = lambda weight, marks: F.struct(F.log(F.col(weight).cast("double")).alias("log_weight"), marks.alias("marks"))
    weights = F.array(F.when(F.col("n1") > 0, of("n1", F.when(same, ONE | TWO).otherwise(ONE))), F.when((F.col("n2") > 0) & ~same, of("n2", F.lit(TWO))))
    parts = F.array(*(F.lit(i) for i in range(-(-count // AT_ONCE))))
    drawn = weighed.select(*keys, "term", F.explode(weights).alias("w")).where("w is not null").select(*keys, "term", "w.*", F.explode(parts).alias("part"))
    drawn = drawn.select(*keys, "part", "marks", *(_sample(F.col("part") * AT_ONCE + i, F.col("term"), F.col("log_weight")).alias(f"s{i}") for i in range(AT_ONCE)))
    low = [F.min(F.when(F.col("marks").bitwiseAND(m) != 0, F.col(f"s{i}"))).alias(f"m{m}_{i}") for m in (ONE, TWO) for i in range(AT_ONCE)]
    taken = drawn.groupBy(*keys, "part").agg(*low)

    def digits(m: int) -> Column:
        return F.concat(*(F.lpad(F.lower(F.hex(F.col(f"m{m}_{i}").bitwiseAND(F.lit(_LOW32)))), 8, "0") for i in range(AT_ONCE)))

    held = taken.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", digits(ONE).alias("one"), digits(TWO).alias("two")))).alias("parts"))

    def whole(name: str) -> Column:
        return F.when(F.col("parts")[0][name].isNotNull(), F.substring(F.array_join(F.col("parts").getField(name), ""), 1, 8 * count))

    return held.select(*keys, whole("one").alias("fingerprint"), whole("two").alias("other"))


def empty(count: int = SAMPLES) -> str:
    """Fingerprint of texts without words."""
    return "0" * (8 * count)


def likeness(a: str, b: str, count: int = SAMPLES) -> Column:
    """Share of equal samples of the fingerprints in columns ``a`` and ``b``."""
    equal = F.filter(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring(F.col(a), i * 8 + 1, F.lit(8)) == F.substring(F.col(b), i * 8 + 1, F.lit(8)))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when((F.col(a) == empty(count)) | (F.col(b) == empty(count)), F.lit(0.0)).otherwise(F.size(equal) / F.lit(float(count)))


def fingerprints(rows: DataFrame, key: str, count: int = SAMPLES) -> DataFrame:
    """``key`` and ``fingerprint`` of each row with ``text``; ``key`` must tell rows apart and not be null."""
    words = rows.select(key, F.explode(_words(F.col("text").cast("string"))).alias("word"), F.lit(ONE).alias("marks"))
    return rows.select(key).join(_sampled(words, [key], count), key, "left").select(key, F.coalesce("fingerprint", F.lit(empty(count))).alias("fingerprint"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and id and key, which are not null and tell rows apart that are not alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("key"))


def _chain(narrow: DataFrame) -> DataFrame:
    """One row for alike rows, with the rows before and after it: id, key, doc_id, n, chars, next_id, next_key, prev_id, prev_key, prev_chars.

    The last row is followed by the first.  narrow: doc_id, id, key, chars."""
    alike = narrow.groupBy("doc_id", "id", "key").agg(F.count("*").alias("n"), F.max("chars").alias("chars"))
    last = F.col("doc_id").isNull()
    ranged = stored(alike.repartitionByRange(last, "id", "key").withColumn("range", F.spark_partition_id()))
    entry = F.struct(last.alias("last"), "id", "key", "chars")
    ends = ranged.groupBy("range").agg(F.min(entry).alias("head"), F.max(entry).alias("tail"))
    # One row a range.
    whole = Window.orderBy("range")
    rest = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", F.coalesce(F.lead("head").over(whole), F.first("head").over(rest)).alias("after"), F.coalesce(F.lag("tail").over(whole), F.last("tail").over(rest)).alias("before"))
    inside = Window.partitionBy("range").orderBy(last, "id", "key")
    rows = ranged.withColumn("next", F.lead(entry).over(inside)).withColumn("prev", F.lag(entry).over(inside)).join(ends, "range")
    rows = rows.withColumn("next", F.coalesce("next", "after")).withColumn("prev", F.coalesce("prev", "before"))
    return rows.select("id", "key", "doc_id", "n", "chars", F.col("next.id").alias("next_id"), F.col("next.key").alias("next_key"), F.col("prev.id").alias("prev_id"), F.col("prev.key").alias("prev_key"), F.col("prev.chars").alias("prev_chars"))


def with_neighbours(docs: DataFrame, count: int = SAMPLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = _keyed(docs)
    chain = stored(_chain(stored(rows.select("doc_id", *_KEY, F.char_length("text").cast("long").alias("chars")))))
    # Alike rows go on as one; all but one in a task stay behind before the shuffle.
    copy = F.row_number().over(Window.partitionBy(*_KEY).orderBy("key"))
    own = rows.select(*_KEY, "text").withColumn("copy", copy).where("copy = 1").drop("copy").join(chain, _KEY)
    quarter = F.floor(F.col("chars") / 4).cast("int")
    sent = own.select(F.col("prev_id").alias("id"), F.col("prev_key").alias("key"), F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")).alias("piece"))
    whole = F.length("text") - quarter
    carried = [*_KEY, "doc_id", "n", "chars", "next_id", "next_key"]
    cut = own.join(sent, _KEY).select(*carried, F.substring("text", F.lit(1), whole).alias("kept"), F.substring("text", whole + 1, quarter).alias("rest"), "piece", F.substring("text", F.lit(1), quarter).alias("first"))
    # Version 1 of a row is edited from the next row, version 2 from one alike.
    version = lambda number, times, new: F.struct(F.lit(number).alias("version"), times.cast("long").alias("times"), new.alias("new"))
    versions = lambda new: F.when(F.col("n") > 1, F.array(version(1, F.lit(1), new("piece")), version(2, F.col("n") - 1, new("first")))).otherwise(F.array(version(1, F.lit(1), new("piece"))))
    # The last word of the kept part may go on behind it.
    ends = cut.withColumn("broken", F.substring_index(_spaced(F.col("kept")), " ", -1)).withColumn("v", F.explode(versions(F.col)))
    marked = lambda text, marks: F.struct(_words(text).alias("words"), F.lit(marks).alias("marks"))
    pieces = F.array(marked(F.expr("left(kept, length(kept) - length(broken))"), ONE | TWO), marked(F.concat("broken", "rest"), ONE), marked(F.concat("broken", "v.new"), TWO))
    words = ends.select(*_KEY, "v.version", F.explode(pieces).alias("p")).select(*_KEY, "version", "p.marks", F.explode("p.words").alias("word"))
    found = _sampled(words, [*_KEY, "version"], count)
    found = found.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("version", F.struct("fingerprint", "other")))).alias("found"))
    facts = cut.select(*carried, versions(lambda new: F.sha2(F.concat("kept", new), 256)).alias("versions")).join(found, _KEY, "left").withColumn("v", F.explode("versions"))
    none = F.lit(empty(count))
    mine = F.col("found")[F.col("v.version")]
    both = stored(facts.select(
        *_KEY, "doc_id", F.col("chars").alias("n_chars"), "next_id", "next_key", "v.version", "v.times", F.col("v.new").alias("edited_sha256"),
        F.coalesce(mine["fingerprint"], none).alias("fingerprint"), F.coalesce(mine["other"], none).alias("edited_fingerprint")))
    # A row is asked for its fingerprint by the one before it; one alike is its own next.
    asked = both.where("version = 1").select(F.col("id").alias("next_id"), F.col("key").alias("next_key"), F.col("fingerprint").alias("next_fingerprint"))
    both = both.join(asked, ["next_id", "next_key"]).withColumn("next_fingerprint", F.when(F.col("version") == 2, F.col("fingerprint")).otherwise(F.col("next_fingerprint")))
    out = both.withColumn("near_edited", likeness("fingerprint", "edited_fingerprint", count)).withColumn("near_next", likeness("fingerprint", "next_fingerprint", count))
    return out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
