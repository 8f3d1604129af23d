"""Which indexed documents still lack their derived artifact (a preview)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import paths

MISSING, SKIPPED, TODO = "missing", "skipped", "todo"


def artifact_backlog(index: DataFrame, listing: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Adds ``status`` to the index rows.

    ``missing``: the file is gone from the listing. ``skipped``: the artifact exists, or the
    type has none. ``todo``: the rest. ``listing`` has ``norm_path``; ``artifacts`` has
    ``artifact_key``. Only keys are joined.
    """
    on_disk = listing.select("norm_path").distinct().withColumn("on_disk", F.lit(True))
    made = artifacts.select("artifact_key").distinct().withColumn("made", F.lit(True))
    supported = F.lower("file_type").isin(*C.ARTIFACT_FILE_TYPES)
    status = (
        F.when(F.col("on_disk").isNull(), MISSING)
        .when(F.col("made").isNotNull() | ~F.coalesce(supported, F.lit(False)), SKIPPED)
        .otherwise(TODO)
    )
    return (
        index.withColumn("artifact_key", paths.artifact_key(F.col("norm_path")))
        .join(on_disk, "norm_path", "left")
        .join(made, "artifact_key", "left")
        .withColumn("status", status)
        .drop("on_disk", "made")
    )


def artifact_counters(backlog: DataFrame) -> DataFrame:
    s = F.col("status")
    return backlog.agg(
        F.count_if(s == TODO).alias("todo"),
        F.count_if(s == SKIPPED).alias("skipped"),
        F.count_if(s == MISSING).alias("missing"),
    )
