"""From raw documents to token files: quality rules, near copies, benchmark leaks, the source mix, token ids.

Each stage takes what its predecessor kept, as Parquet in the shared folder, and all but the last
return the columns of documents. Labels and the benchmark are read from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import decontaminate, mixing, ngram_join, quality, token_files
from tracemill.llm.common import durable


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules (operator 9)."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 10)."""
    return ngram_join.keep_first(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item (operator 1)."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (operator 5)."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as ORC, and each document's place and checksum as read back (operator 4)."""
    return token_files.tokenize_and_read(docs)


STAGES = [
    ("quality rules", good_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_leaks),
    ("mixing sources", mixed),
    ("token ids", token_ids),
]

# No stage but the mix can be put in SQL; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
