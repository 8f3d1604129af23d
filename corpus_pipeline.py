"""A training corpus from ``documents``: quality, exact and near copies, leaks, packing.

Each stage reads what the one before it wrote and calls one operator of ``docloom.llm``. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import byte_cnn, decontaminate, exact_dedup, ngram_join, packing
from docloom.llm.common import doc_key, kept_rows, stored, table
from docloom.llm.queries import QUALITY_CUT, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows of its input."""
    net = byte_cnn.train(docs, table(spark, sf_dir, "labels"))
    return byte_cnn.accepted(docs, net, QUALITY_CUT)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest ``doc_id`` stays."""
    kept = exact_dedup.deduplicate(docs).where("kept")
    # a key that rows share is named twice: kept_rows then takes one of them
    times = F.explode(F.sequence(F.lit(1), F.least("alike", F.lit(2)).cast("int")))
    return kept_rows(docs, kept.select(doc_key().alias("doc"), "tag", times))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest ``doc_id`` stays, of rows that
    share that ``doc_id`` the one whose text has the smallest hash."""
    kept = ngram_join.near_duplicates(docs).where("doc_id <=> class_id and tag = class_tag")
    return kept_rows(docs, kept.select(doc_key().alias("doc"), "tag"))


def leaked_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training sequence."""
    return packing.pack(docs, tokenizer_path(), end_id=0)


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("leaked_tests", leaked_tests),
    ("packed", packed),
]

#: No SQL: a trained network, MinHash classes and a tokenizer are in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stored(stage(spark, out, sf_dir), f"stage-{name}")
    return out
