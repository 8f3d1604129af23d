"""The batch ingest: listing -> rules -> delta -> extraction -> one commit -> counters."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import paths
from docloom.operators import delta as D
from docloom.operators import filters
from docloom.operators.extract import extract_listed
from docloom.operators.mirror import with_backup
from docloom.schema import DOCUMENT
from docloom.session import new_table_path, run_folder
from docloom.sources import files, progress
from docloom.sources.catalog import Catalog, cluster


BYTES_PER_TASK, FILES_PER_TASK = 64 << 20, 5_000
COUNTERS = ("scanned", "indexed", "skipped", "ignored", "error", "deleted")


def document_rows(
    extracted: DataFrame,
    backup_root: str | None = None,
    backup_excluded: Sequence[str] = C.BACKUP_EXCLUDED_EXTENSIONS,
) -> DataFrame:
    """Listing rows with text to rows of the catalog schema."""
    path = F.col("file_path")
    name = paths.file_name(path)
    rows = (
        extracted.withColumn("file_name", name)
        .withColumn("file_extension", paths.file_extension(name))
        .withColumn("file_type", paths.file_type(name))
        .withColumn("file_directory", paths.file_directory(path))
    )
    return with_backup(rows, backup_root, backup_excluded).select(*DOCUMENT.names)


def read_tasks(spark: SparkSession, files: int, size: int) -> int:
    """Number of tasks for reading so many files of so many bytes."""
    by_size = max(size // BYTES_PER_TASK, files // FILES_PER_TASK)
    return max(by_size, min(spark.sparkContext.defaultParallelism, files), 1)


def summary(statuses: DataFrame) -> Row:
    """The run counters, and the bytes of what is to be read: one pass over narrow rows."""
    size = F.sum(F.when(F.col("status") == D.INDEXED, F.col("file_size")))
    return statuses.agg(*D.counter_columns(), F.coalesce(size, F.lit(0)).alias("bytes")).first()


def one_row(spark: SparkSession, counters: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([tuple(counters[c] for c in COUNTERS)], ", ".join(f"{c} bigint" for c in COUNTERS))


def run_ingest(
    spark: SparkSession,
    catalog_path: str,
    roots: Sequence[str],
    force: bool = False,
    backup_root: str | None = None,
    backup_excluded: Sequence[str] = C.BACKUP_EXCLUDED_EXTENSIONS,
    folder_names: Sequence[str] = C.EXCLUDED_FOLDER_NAMES,
    path_parts: Sequence[str] = C.EXCLUDED_PATH_PARTS,
    tag: str | None = None,
) -> DataFrame:
    """Bring the catalog in step with the files below ``roots``; returns the run counters.

    The file texts are read once, by the tasks, and only for new and changed files. Rows under
    a root that is missing now are kept.
    """
    tag = tag or uuid.uuid4().hex
    with run_folder(spark):  # what the run keeps in between goes with it
        catalog = Catalog(spark, catalog_path).ensure()
        records = f"{catalog_path}/progress"  # one record a run, replaced as the run goes on
        progress.write(records, tag, progress.record(progress.no_counters(spark), True))
        present = files.existing_roots(spark, roots)
        listing = files.walk(spark, present, folder_names, path_parts)
        ok = filters.accepted(
            F.col("file_path"), F.col("root"), names=folder_names, parts=path_parts
        )
        scan = D.with_keys(listing, ok | F.col("unreadable"))
        # Narrow rows, used several times below: a table instead of as many joins.
        statuses = _kept(spark, D.delta(scan, D.metadata(catalog.read()), present, force), "statuses")
        blind = statuses.where("unreadable")
        if blind.limit(1).count():
            statuses = _kept(spark, D.protect(statuses, blind), "protected")
        seen = summary(statuses).asDict()
        # what is known before any file is opened: nothing is indexed or deleted yet
        progress.write(records, tag, progress.record(one_row(spark, seen | {"indexed": 0, "deleted": 0}), True))

        bad = unparsed = 0
        if seen["indexed"] or seen["deleted"]:
            read = Observation(f"read-{tag}")
            todo = statuses.where(F.col("status") == D.INDEXED)
            # Tasks follow the bytes and files to read, not the size of these narrow rows; rows meet
            # in key ranges now, so that their texts need no shuffle later.
            todo = cluster(todo, read_tasks(spark, seen["indexed"], seen["bytes"]))
            extracted = extract_listed(todo).observe(
                read, F.count_if(~F.col("readable")).alias("bad"), F.count_if(~F.col("parsed")).alias("unparsed")
            )
            puts = document_rows(extracted.where("readable"), backup_root, backup_excluded)
            catalog.apply(puts, statuses.where(F.col("status") == D.GHOST), tag, clustered=True)
            if seen["indexed"]:  # files that vanished between listing and reading
                bad, unparsed = read.get["bad"] or 0, read.get["unparsed"] or 0
        seen |= {k: seen[k] + by * bad for k, by in (("scanned", -1), ("indexed", -1), ("error", 1))}
        counters = one_row(spark, seen)
        progress.write(records, tag, progress.record(counters, False, unparsed))
        return counters


def _kept(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = new_table_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
