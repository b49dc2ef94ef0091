"""Documents to training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before kept
and calls one operator of ``salesops.llm``; all but the last return the columns
of ``documents``.  ``run`` applies them in order, each result written as
Parquet in the shared folder and read back as the next one's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesops.llm import mixing, near_dup, packing, quality, substring_dedup
from salesops.llm.graph import stored


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rejected documents go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the smallest doc_id of each class stays."""
    return near_dup.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words of repeated windows go."""
    return substring_dedup.cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each row as many times as the mix takes it."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: numbered sequences with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good_documents),
    ("minhash near-dedup", keep_one_of_each_group),
    ("substring dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the fitted classifier, the hashed rounding and the tokenizer; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
