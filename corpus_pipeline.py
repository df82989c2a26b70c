"""A corpus pipeline of five of the library's operators.

Each stage gets what its predecessor kept as a DataFrame of documents and returns what it keeps; all but the last
return the columns of documents. run() applies them in order, each stage's rows written to the shared folder and
read again, as a stage that reads its input twice needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hindcast.llm import decontamination, line_dedup, mixing, quality_rules, simhash
from hindcast.llm.common import scratch, table


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later occurrences of three-line windows go; documents of which no word is left go too."""
    return line_dedup.remove_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words, with size, source_size, target and taken."""
    return mixing.take_mixture(docs)


STAGES = [
    ("quality rules", drop_bad),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: XXH64 fingerprints are beyond SQL; the tests hold every stage and run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch(spark, f"stage-{k}")
            out.write.parquet(path)
            out = spark.read.parquet(path)
        docs = out
    return docs
