"""Delta detection: what a scan changed compared with the index of the last run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import paths

IGNORED, SKIPPED, INDEXED, ERROR = "ignored", "skipped", "indexed", "error"
GHOST, KEPT = "ghost", "kept"


def latest_per_key(df: DataFrame, key: str, order: str, *more: str) -> DataFrame:
    """One row per key, the one with the largest ``order`` (then the largest of ``more``).

    An aggregate with a partial step: a key that holds a large part of all rows shrinks to one
    row per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in (key, order, *more)]
    packed = F.struct(order, *more, *rest)
    best = df.groupBy(key).agg(F.max(packed).alias("r"))
    return best.select(key, "r.*").select(*df.columns)


def with_keys(listing: DataFrame, accepted: Column) -> DataFrame:
    """Adds ``norm_path``, ``_id`` and the filter result; one row per key."""
    keyed = listing.withColumn("norm_path", paths.norm_path(F.col("file_path")))
    keyed = keyed.withColumn("_id", paths.document_id(F.col("norm_path")))
    # A path listed under two roots is accepted when either root accepts it.
    return latest_per_key(
        keyed.withColumn("accepted", accepted), "_id", "accepted", "modified_date", "file_path"
    )


def metadata(index: DataFrame) -> DataFrame:
    """The narrow part of the index a delta needs; rows without a path are dropped."""
    return index.where(F.col("file_path").isNotNull()).select(
        F.col("_id"),
        paths.norm_path(F.col("file_path")).alias("norm_path"),
        "modified_date",
        "file_size",
    )


def delta(
    scan: DataFrame,
    index_metadata: DataFrame,
    roots: Sequence[str],
    force: bool = False,
    whole_scan: bool = True,
) -> DataFrame:
    """Classify every scanned and every indexed key in one join.

    ``scan`` comes from :func:`with_keys`. Result: the scan columns plus ``status``:

    * scanned rows: ``ignored``, ``error`` (could not be read), ``skipped`` (size and time as
      in the index) or ``indexed`` (new or changed; with ``force`` every accepted row),
    * rows only in the index: ``ghost`` when they lie under a scanned root, else ``kept`` - a
      root that was not scanned or is unreachable loses nothing, and :func:`protect` keeps what
      lies below unreadable folders. ``force`` cleans up nothing.

    Ignored files count as seen, so they are joined as well. One full outer join on the key
    yields both answers with a single shuffle of narrow rows; keys are hashes, so its
    partitions are even. A micro-batch is no whole scan: ``whole_scan=False`` joins left and
    finds no ghosts.
    """
    old = index_metadata.select(
        F.col("_id"),
        F.col("norm_path").alias("old_path"),
        F.col("modified_date").alias("old_date"),
        F.col("file_size").alias("old_size"),
        F.lit(True).alias("in_index"),
    )
    joined = scan.withColumn("in_scan", F.lit(True)).join(
        old, "_id", "full_outer" if whole_scan else "left"
    )
    same = F.col("modified_date").eqNullSafe(F.col("old_date")) & F.col("file_size").eqNullSafe(
        F.col("old_size")
    )
    dead = F.lit(False) if force else paths.under_any(F.col("old_path"), norm_roots(roots))
    unchanged = F.lit(False) if force else (F.col("in_index").isNotNull() & same)
    status = (
        F.when(F.col("in_scan").isNull(), F.when(dead, GHOST).otherwise(KEPT))
        .when(~F.col("accepted"), IGNORED)
        .when(F.col("file_size").isNull() | F.col("modified_date").isNull(), ERROR)
        .when(unchanged, SKIPPED)
        .otherwise(INDEXED)
    )
    return joined.withColumn("status", status).withColumn(
        "norm_path", F.coalesce("norm_path", "old_path")
    ).drop("old_path", "old_date", "old_size", "in_index", "in_scan")


def norm_roots(roots: Sequence[str]) -> list[str]:
    """Roots as prefixes of normalised paths: by the very expression that folds the paths."""
    if not roots:
        return []
    row = SparkSession.active().sql("SELECT 1 AS one")
    return list(row.select(*[paths.norm_path(F.lit(r)).alias(f"r{i}") for i, r in enumerate(roots)]).first())


def protect(statuses: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Statuses in which no row below an unreadable folder is a ghost.

    ``unreadable`` has ``norm_path`` of folders. Ghosts, narrow rows, look for each of their
    folders among them by an equi-join.
    """
    ghost = statuses.where(F.col("status") == GHOST).select("_id", F.explode(paths.ancestors(F.col("norm_path"))).alias("folder"))
    safe = ghost.join(unreadable.select(F.col("norm_path").alias("folder")).distinct(), "folder", "left_semi")
    safe = safe.select("_id").distinct().withColumn("safe", F.lit(True))
    status = F.when(F.col("safe") & (F.col("status") == GHOST), KEPT).otherwise(F.col("status"))
    return statuses.join(safe, "_id", "left").withColumn("status", status).drop("safe")


def ghosts(scan: DataFrame, index_metadata: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Indexed rows under the scanned roots whose path was not seen: an anti join on keys."""
    under = paths.under_any(F.col("norm_path"), norm_roots(roots))
    return index_metadata.where(under).join(scan.select("_id"), "_id", "left_anti")


def apply_changes(old: DataFrame, changes: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """The index after an upsert of ``changes`` and a delete of the keys in ``dead``.

    Both key sets go into one anti join, so the wide old rows are moved at most once; Spark
    broadcasts the keys when their measured size allows it, and then they are not moved at all.
    """
    gone = changes.select("_id")
    if dead is not None:
        gone = gone.unionByName(dead.select("_id"))
    return old.join(gone, "_id", "left_anti").unionByName(changes)


def counter_columns(status: str = "status") -> list[Column]:
    """The run counters; ignored and failed files are not counted as scanned."""
    s = F.col(status)
    return [
        F.count_if(s.isin(SKIPPED, INDEXED)).alias("scanned"),
        F.count_if(s == INDEXED).alias("indexed"),
        F.count_if(s == SKIPPED).alias("skipped"),
        F.count_if(s == IGNORED).alias("ignored"),
        F.count_if(s == ERROR).alias("error"),
        F.count_if(s == GHOST).alias("deleted"),
    ]


def run_counters(statuses: DataFrame, status: str = "status") -> DataFrame:
    return statuses.agg(*counter_columns(status))


def document_count(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("n"))
