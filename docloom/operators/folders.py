"""Immediate sub-folders of a folder, from a listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import paths


def folder_listing(
    listing: DataFrame, parent: str, hidden: Sequence[str] = C.HIDDEN_FOLDERS
) -> DataFrame:
    """``(name, path)`` one level below ``parent``; hidden and dot folders are left out.

    Sorted by name without regard to case. ``distinct`` combines before its shuffle, so a
    folder that holds most files costs no more than another.
    """
    prefix = parent.rstrip("/") + "/"
    path = paths.slashed(F.col("file_path"))
    tail = F.substr(path, F.lit(len(prefix) + 1))
    name = F.col("name")
    return (
        listing.where(path.startswith(prefix) & tail.contains("/"))
        .select(F.substring_index(tail, "/", 1).alias("name"))
        .distinct()
        .where(~F.lower(name).isin(*hidden) & ~name.startswith("."))
        .select(name, F.concat(F.lit(prefix), name).alias("path"))
        .orderBy(F.lower(name), name)
    )
