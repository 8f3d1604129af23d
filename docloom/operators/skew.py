"""Joins that stay even when one key holds a large part of all rows.

A key is *hot* when it has more than ``HOT_SHARE`` of all rows and more than ``min_rows``. At
most ``1 / HOT_SHARE`` keys can be hot, whatever the size of the data, so the list of hot keys
may be broadcast. The rows of a hot key are spread over salts by another column; the other
side of the join repeats its rows for that key once per salt. Keys that are not hot have one
salt and are left as they are. The result is that of the plain join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1e-4
HOT_MIN_ROWS = 1_000_000


def hot_threshold(total_rows: int, min_rows: int = HOT_MIN_ROWS) -> int:
    """Rows a key may have before it is split."""
    return max(int(total_rows * HOT_SHARE), min_rows)


def hot_keys(counts: DataFrame, on: Sequence[str], rows: str, threshold: int) -> DataFrame:
    """``(*on, salts)`` of the hot keys, from a table of row counts per key."""
    salts = F.ceil(F.col(rows) / threshold).cast("int").alias("salts")
    return counts.where(F.col(rows) > threshold).select(*on, salts)


def add_salt(df: DataFrame, hot: DataFrame, on: Sequence[str], spread_by: str) -> DataFrame:
    """Adds ``salt`` to the side that holds the many rows."""
    salt = F.pmod(F.xxhash64(spread_by), F.coalesce("salts", F.lit(1))).cast("int")
    marked = df.join(F.broadcast(hot), list(on), "left")
    return marked.withColumn("salt", salt).drop("salts")


def repeat_for_salts(df: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    """Repeats the rows of the other side, once per salt of their key."""
    every = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    marked = df.join(F.broadcast(hot), list(on), "left")
    return marked.withColumn("salt", F.explode(every)).drop("salts")


def salted_join(
    many: DataFrame,
    few: DataFrame,
    on: Sequence[str],
    spread_by: str,
    how: str = "inner",
    min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """``many.join(few, on, how)`` with the hot keys of ``many`` spread; ``how`` is inner, left
    or left_semi. ``many`` should be a stored table: it is counted first."""
    threshold = hot_threshold(many.count(), min_rows)
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"))
    hot = hot_keys(counts, on, "rows", threshold)
    left = add_salt(many, hot, on, spread_by)
    right = repeat_for_salts(few, hot, on)
    return left.join(right, [*on, "salt"], how).drop("salt")
