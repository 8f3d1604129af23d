"""Progress records of ingest runs: a small table, one folder per record tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.display import progress_text
from docloom.operators.filters import is_fresh

RECORD = (
    "is_running boolean, scanned bigint, indexed bigint, skipped bigint, ignored bigint, "
    "error bigint, deleted bigint, unparsed bigint, status_message string, at timestamp"
)
_COUNTERS = ("scanned", "indexed", "skipped", "ignored", "error", "deleted")


def no_counters(spark: SparkSession) -> DataFrame:
    """One row of counters that are all zero."""
    row = spark.sql("SELECT 1 AS one")
    return row.select(*[F.lit(0).cast("bigint").alias(c) for c in _COUNTERS])


def record(counters: DataFrame, is_running: bool, unparsed: int = 0) -> DataFrame:
    """A one-row record from run counters; ``unparsed`` files are kept with an empty text."""
    return counters.select(
        F.lit(is_running).alias("is_running"),
        *[F.col(c).cast("bigint").alias(c) for c in _COUNTERS],
        F.lit(unparsed).cast("bigint").alias("unparsed"),
        progress_text(F.col("scanned"), F.col("indexed"), F.col("skipped")).alias(
            "status_message"
        ),
        F.current_timestamp().alias("at"),
    )


def write(path: str, tag: str, row: DataFrame) -> None:
    """Write one record; the same tag again replaces it."""
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/tag={tag}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD + ", tag string").parquet(path)


def latest(records: DataFrame) -> DataFrame:
    """The newest record - what a reader of the status sees."""
    whole = F.struct(*[c for c in records.columns])
    return records.agg(F.max_by(whole, "at").alias("r")).select("r.*")


def totals(records: DataFrame) -> DataFrame:
    """Counters summed over all records (micro-batches)."""
    return records.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTERS])


def running(records: DataFrame, now) -> DataFrame:
    """The newest record with its running flag dropped once it is stale."""
    return latest(records).withColumn(
        "is_running", is_fresh(F.col("is_running"), F.col("at"), now)
    )
