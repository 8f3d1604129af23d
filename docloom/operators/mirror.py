"""Backup plans: what to copy, what to delete, and where a document's backup lies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import paths
from docloom.operators.filters import is_backed_up_type

COPY, SKIP, DELETE, EXTRA = "COPY", "SKIP", "DELETE", "EXTRA"


def mirror_plan(
    source: DataFrame,
    target: DataFrame,
    mirror: bool = True,
    tolerance_sec: int = C.MIRROR_TIME_TOLERANCE_SEC,
    excluded_folders: Sequence[str] = (),
) -> DataFrame:
    """Compare two listings ``(rel_path, mtime, bytes)``.

    A file is copied when the target lacks it or holds an older one. ``mirror=True`` deletes
    what only the target has and treats times within ``tolerance_sec`` as equal;
    ``mirror=False`` compares strictly and leaves such files alone (``EXTRA``). Folders named
    in ``excluded_folders`` take no part on either side. The copying itself is a storage
    tool's work.
    """
    if excluded_folders:
        keep = ~F.exists(
            F.split(F.lower("rel_path"), "/"),
            lambda part: part.isin(*[f.lower() for f in excluded_folders]),
        )
        source, target = source.where(keep), target.where(keep)
    s = source.select("rel_path", F.col("mtime").alias("src_mtime"), F.col("bytes").alias("b"))
    t = target.select("rel_path", F.col("mtime").alias("dst_mtime"), F.col("bytes").alias("tb"))
    lag = F.col("src_mtime") - F.col("dst_mtime")
    allowed = F.lit(tolerance_sec if mirror else 0)
    newer = lag > F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), allowed)
    action = (
        F.when(F.col("src_mtime").isNull(), DELETE if mirror else EXTRA)
        .when(F.col("dst_mtime").isNull() | newer, COPY)
        .otherwise(SKIP)
    )
    return s.join(t, "rel_path", "full_outer").select(
        "rel_path",
        action.alias("action"),
        "src_mtime",
        "dst_mtime",
        F.coalesce("b", "tb").alias("bytes"),
    )


def with_backup(
    documents: DataFrame,
    backup_root: str | None,
    excluded: Sequence[str] = C.BACKUP_EXCLUDED_EXTENSIONS,
) -> DataFrame:
    """Adds ``is_backed_up`` and ``backup_path``; without a backup root nothing is backed up."""
    if not backup_root:
        backed, where = F.lit(False), F.lit(None).cast("string")
    else:
        backed = is_backed_up_type(F.col("file_extension"), excluded)
        where = F.when(backed, paths.backup_destination(F.col("file_path"), backup_root))
    return documents.withColumn("is_backed_up", backed).withColumn("backup_path", where)
