"""Catalog tables derived from the given ``documents`` table. Every document is in each of them.

* :func:`catalog` - what a scan of the disk sees now.
* :func:`stored_index` - what the last run stored: some files have since been touched, resized
  or moved (so their old path is gone and the new one is unknown), some rows differ in case
  only, and some lie under a root that is not scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import paths
from docloom.operators import delta as D
from docloom.operators import filters
from docloom.session import spread

ROOT = "/Corpus"
OTHER_ROOT = "/Offline"
BACKUP_ROOT = "/Backups/Documents"

# excluded by name, by its dot, not at all, and by a part of its name
_SUB_FOLDERS = {0: "/Node_Modules", 1: "/.git/x", 2: "/Year 2024", 4: "/x$Recycle.Bin2"}
_EXTENSIONS = (".pdf", ".docx", ".xlsx", ".txt", ".md", ".csv", ".PDF", ".zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(key: Column, cases: dict[int, str], other: str) -> Column:
    out = F.lit(other)
    for value, text in cases.items():
        out = F.when(key == value, text).otherwise(out)
    return out


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ext = F.get(F.array(*[F.lit(e) for e in _EXTENSIONS]), (i % 8).cast("int"))
    sub = _choose(i % 13, _SUB_FOLDERS, "")
    prefix = F.when(i % 17 == 0, "~$").when(i % 19 == 0, ".").otherwise("")
    name = F.concat(prefix, F.col("lang"), F.lit(" report "), i.cast("string"), ext)
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (i * 37).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.lit(ROOT).alias("root"),
        F.concat(F.lit(ROOT + "/"), F.col("source"), sub, F.lit("/"), name).alias("file_path"),
        name.alias("file_name"),
        F.col("n_chars").alias("file_size"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minutes).alias("modified_date"),
        F.col("text").alias("content"),
    )


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, path = F.col("doc_id"), F.col("file_path")
    old_path = (
        F.when((i % 7 == 0) & (i % 2 == 0), F.concat(F.lit(f"{ROOT}/Old/"), F.col("file_name")))
        .when(i % 7 == 0, F.concat(F.lit(f"{OTHER_ROOT}/"), F.col("file_name")))
        .when(i % 3 == 0, F.upper(path))
        .otherwise(path)
    )
    hour, second = F.expr("interval 1 hour"), F.expr("interval 1 second")
    date = F.col("modified_date")
    return (
        catalog(spark, sf_dir)
        .withColumn("file_path", old_path)
        .withColumn(
            "modified_date",
            F.when(i % 5 == 0, date - hour).when(i % 9 == 4, date - second).otherwise(date),
        )
        .withColumn("file_size", F.col("file_size") + F.when(i % 23 == 0, 1).otherwise(0))
        .withColumn("norm_path", paths.norm_path(F.col("file_path")))
        .withColumn("_id", paths.document_id(F.col("norm_path")))
    )


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with its keys and the result of the file rules, without the texts."""
    listing = catalog(spark, sf_dir).drop("content")
    return D.with_keys(listing, filters.accepted(F.col("file_path"), F.col("root")))


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the search sees them."""
    docs = catalog(spark, sf_dir).withColumn("file_type", paths.file_type(F.col("file_name")))
    return spread(docs, "doc_id")


def search_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog(spark, sf_dir).drop("content")
    return docs.withColumn("file_type", paths.file_type(F.col("file_name")))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every ``benchmark`` item as a query, in eight forms and each asked twice;
    and one query per item without a required word."""
    i, text = F.col("item_id"), F.col("text")
    every_word_excluded = F.regexp_replace("text", r"([^\s]+)", "-$1")
    query = (
        F.when(i % 8 == 1, F.concat(F.lit("pdf "), text))
        .when(i % 8 == 2, F.concat(text, F.lit(" NOT (qqq)")))
        .when(i % 8 == 3, F.concat(F.lit("md OR txt OR docx "), text))
        .when(i % 8 == 4, F.concat(F.lit("report the -"), i.cast("string"), F.lit(" "), text))
        .when(i % 8 == 5, F.concat(F.lit("csv xlsx "), every_word_excluded))
        .when(i % 8 == 6, every_word_excluded)
        .otherwise(text)
    )
    wordless = F.concat(
        F.when(i % 3 == 0, F.lit("")).otherwise(F.lit("docx md ")),
        F.lit("NOT "), F.regexp_extract("text", r"[^\s]+", 0), F.lit("zz -report"), i.cast("string"),
    )
    items = table(spark, sf_dir, "benchmark")
    log = items.select(i.alias("query_id"), query.alias("query"))
    again = log.select((F.col("query_id") + 1_000_000).alias("query_id"), "query")
    return log.unionByName(again).unionByName(
        items.select((i + 2_000_000).alias("query_id"), wordless.alias("query"))
    )
