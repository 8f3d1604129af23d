"""Keep the text index in step with the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import new_table_path, run_folder
from docloom.sources.catalog import MAX_FILTER_KEYS, Catalog
from docloom.sources.rank_tables import RankTables, write_ranks
from docloom.sources.text_index import StoredIndex, stamp_of, update_index, write_index


def search_columns(rows: DataFrame, *more: str) -> DataFrame:
    """Catalog rows as the search sees them: ``_id`` as ``doc_id``, without the text."""
    return rows.select(
        F.col("_id").alias("doc_id"), "file_name", "file_type", "file_path", "file_size",
        "modified_date", *more,
    )


def current_index(catalog: Catalog, index_root: str) -> StoredIndex | None:
    """The index at ``index_root``, if it was built to its end."""
    store, done = catalog.rows._store(f"{index_root}/info/_SUCCESS")
    return StoredIndex(catalog.spark, index_root) if store.exists(done) else None


def refresh_index(catalog: Catalog, index_root: str) -> StoredIndex:
    """Bring the index in step with the catalog.

    The first call tokenises everything. Later ones compare what the index knows of each document
    with the narrow columns of the catalog, by key, and tokenise only what is new or changed.
    """
    old = current_index(catalog, index_root)
    if old is None:
        return write_index(search_columns(catalog.read(), "content"), index_root)
    now = search_columns(catalog.read())
    now = now.select("doc_id", stamp_of(now).alias("stamp"))
    before = old.stamps().withColumnRenamed("stamp", "known")
    differ = now.join(before, "doc_id", "full_outer").where(~F.col("stamp").eqNullSafe(F.col("known")))
    with run_folder(catalog.spark):
        path = new_table_path(catalog.spark, "changed")
        differ.write.parquet(path)
        differ = catalog.spark.read.parquet(path)
        dead = differ.where(F.col("stamp").isNull()).select("doc_id")
        fresh = differ.where(F.col("stamp").isNotNull()).select("doc_id")
        few = [r["doc_id"] for r in fresh.limit(MAX_FILTER_KEYS + 1).collect()]
        if not few and not dead.limit(1).count():
            return old
        if len(few) <= MAX_FILTER_KEYS:
            changed = search_columns(catalog.read(few), "content")
        else:
            changed = search_columns(catalog.read(), "content").join(fresh, "doc_id", "left_semi")
        return update_index(old, changed, dead)


def refresh_ranks(catalog: Catalog, index_root: str) -> RankTables:
    """The stored orders of the catalog as it is: one sort of narrow rows for each order. They are
    written beside the old ones, which readers keep until the new ones are complete."""
    return write_ranks(search_columns(catalog.read()), f"{index_root}/ranks/{uuid.uuid4().hex}")
