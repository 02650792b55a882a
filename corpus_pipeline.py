"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before it kept and returns a DataFrame that
is written as Parquet and read again. All but the last return the columns of documents. SQL cannot say the first, third
and last stage, so there is no SQL text; the tests hold the stages against brute-force versions. Empty tables give empty
tables; further columns of documents, clashing names included, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafspark.llm import bpe, decontam, exact_dedup, quality, simhash
from leafspark.llm.shared import write_table

RANKS = "byte_bpe_multi_50k.tiktoken"


def without(docs: DataFrame, find) -> DataFrame:
    """docs but for the rows whose key find(keyed documents) lists.

    find takes (key, text) rows and returns a table with one column of keys. The key is the doc_id; a row without one has a
    number from its text above all identifiers, so it is dropped like others and, of similar rows, stays last. Rows that
    share a doc_id go together. The list is written first, so that Spark knows its size and broadcasts it only if small.
    """
    names = docs.columns
    ident, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    made = F.lit(1 << 62).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)))
    keyed = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("key", F.coalesce(F.col(ident).cast("long"), made))
    found = find(keyed.select("key", F.col(text).alias("text")))
    gone = write_table(found.toDF("gone").distinct(), "dropped")
    return keyed.join(gone, F.col("key") == F.col("gone"), "left_anti").drop("key").toDF(*names)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble (fitted on labelled rows that are not held out) scores at one half or more.

    A null text is scored as an empty one; rows without doc_id are scored like others."""
    return quality.keep_good(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each text the row with the smallest doc_id; null counts as the empty text, a row without doc_id goes before others."""
    return exact_dedup.survivors(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts (five-word shingles, 0.8 or more) the document with the smallest doc_id.

    Null and empty texts have no shingles; a row without doc_id goes if it is similar to one with a doc_id.
    """
    return without(docs, lambda keyed: simhash.similar_documents(keyed, "key").where("doc_id <> component_id").select("doc_id"))


def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to a benchmark item of its size; null and empty texts stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, lambda keyed: decontam.find_leaks(keyed, items, "key").select("doc_id"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token count and digests of each document that is left, decoded again; null counts as the empty text."""
    return bpe.round_trip(docs, bpe.rank_file(RANKS))


STAGES = [("quality", good_quality), ("exact_dedup", no_exact_copies), ("near_dedup", no_near_copies), ("decontamination", no_benchmark_passages), ("byte_bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
