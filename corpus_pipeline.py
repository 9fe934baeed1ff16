"""From raw documents to a training mix: each stage keeps, cuts or copies documents for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semtab.llm.decontaminate import drop_leaks
from semtab.llm.language import held_out
from semtab.llm.line_dedup import dedup_lines
from semtab.llm.mixing import take_mix
from semtab.llm.quality import keep_good, learn_quality
from semtab.llm.simhash import drop_near_copies
from semtab.runtime import ship, stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the classifier finds good; labels of the held-out fold are not learnt from."""
    chain = learn_quality(docs, _table(spark, sf_dir, "labels"), ~held_out("doc_id", 2, 4))
    return keep_good(docs, chain, limit=0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that an earlier one has; the number of characters follows the text."""
    ship(spark)
    return dedup_lines(docs, min_lines=2, long_words=50).withColumn("n_chars", F.length("text").cast("long"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The leading document of each group of near copies: shingles of 4 words, 4 bits."""
    ship(spark)
    return drop_near_copies(docs, shingle_words=4, max_bits=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, _table(spark, sf_dir, "benchmark"), shingle_words=5, similarity=0.8)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return take_mix(docs, weights=(1, 2, 3), share=1.0, cap=3.0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]

#: SQL can't express the classifier, fingerprints and sampling; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next one reads it."""
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
