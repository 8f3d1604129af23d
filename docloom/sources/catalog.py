"""The catalog table: keyed upsert and delete on plain Parquet.

Layout below ``path``::

    rows/prefix=3f/...       the rows whose key starts with 3f
    commits/tag=<tag>/...    one row for each change that was applied

A change whose keys are new is appended. Partitions that hold a changed or deleted key are replaced,
without the old rows of those keys and with their new ones; all other files stay as they are. The
longer the prefix, the less a change of few rows rewrites: choose it for partitions of about a
gigabyte. A change that failed half way is applied again: a row replaces the row with its key.
One writer at a time, as in the scheduled ingest this serves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.schema import DOCUMENT
from docloom.session import new_table_path, run_folder
from docloom.sources.partitioned import PartitionedTable

#: Hex digits of the key that name a partition.
KEY_PREFIX_CHARS = 2
#: Changes of up to so many keys look them up by filter.
MAX_FILTER_KEYS = 1_000
#: Changed keys that are broadcast at a time: 48 MB, at 64 characters and their overhead each.
KEYS_AT_ONCE = 400_000

_COLUMNS = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in DOCUMENT)


def key_part(key: Column, parts: int) -> Column:
    """Number of the even key range ``key`` lies in. Keys are hex hashes, so ranges are even."""
    leading = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    return F.floor(leading * parts / (1 << 32)).cast("int")


def cluster(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Bring rows together by key range, as the catalog stores them.

    Done on narrow rows *before* their texts are read, it spares a shuffle of the texts. Each range is
    a task of its own; dealt by their hash, several would meet in one.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(parts, key_part(F.col("_id"), parts))


def in_rounds(keys_by_part: dict[str, int], most: int) -> Iterator[list[str]]:
    """The partitions in groups of at most ``most`` keys; one with more is a group of its own."""
    group, held = [], 0
    for part, keys in sorted(keys_by_part.items()):
        if group and held + keys > most:
            yield group
            group, held = [], 0
        group.append(part)
        held += keys
    if group:
        yield group


class Catalog:
    def __init__(self, spark: SparkSession, path: str, prefix_chars: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows = PartitionedTable(spark, f"{self.path}/rows", f"{_COLUMNS}, prefix string", key="_id")
        self._prefix_chars = prefix_chars

    @property
    def prefix_chars(self) -> int:
        """As the catalog was begun; only an empty one takes the length that is asked for."""
        there = self.rows.parts()
        return len(there[0]) if there else self._prefix_chars or KEY_PREFIX_CHARS

    def exists(self) -> bool:
        return self.rows.exists()

    def ensure(self) -> Catalog:
        """Create the empty catalog when there is none; an existing one is left alone."""
        self.rows.create()
        return self

    # -- write -----------------------------------------------------------------------------

    def applied(self, tag: str) -> bool:
        """Was this tag committed before? Makes the replay of a batch harmless."""
        store, path = self.rows._store(f"{self.path}/commits/tag={tag}/_SUCCESS")
        return store.exists(path)

    def apply(
        self,
        puts: DataFrame,
        dead: DataFrame | None = None,
        tag: str = "run",
        clustered: bool = False,
        keys_at_once: int = KEYS_AT_ONCE,
    ) -> None:
        """Upsert ``puts`` (one row per key) and delete the keys of ``dead``.

        ``clustered`` says that the rows already passed :func:`cluster`. Texts are written where
        they are made and are not shuffled: old rows are parted from changed keys by a broadcast of
        at most ``keys_at_once`` counted keys, partition group by partition group.
        """
        self.ensure()
        prefix = F.substring("_id", 1, self.prefix_chars).alias("prefix")
        puts = (puts if clustered else cluster(puts)).select(*DOCUMENT.names, prefix)
        if not self.rows.parts():
            self.rows.append(puts, ["_id"])
        else:
            with run_folder(self.spark):
                self._change(puts, dead, prefix, keys_at_once)
        done = self.spark.sql("SELECT current_timestamp() AS at")
        done.write.mode("overwrite").parquet(f"{self.path}/commits/tag={tag}")

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        path = new_table_path(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _change(self, puts: DataFrame, dead: DataFrame | None, prefix: Column, keys_at_once: int) -> None:
        puts = self._kept(puts, "puts")  # their texts are made once
        keys = puts.select("_id", "prefix")
        if dead is not None:
            keys = keys.unionByName(dead.select("_id", prefix))
        known = self._kept(self._among(keys), "known")  # narrow rows
        touched = {r["prefix"]: r["count"] for r in known.groupBy("prefix").count().collect()}
        for group in in_rounds(touched, keys_at_once):
            here = F.col("prefix").isin(*group)
            gone = known.where(here).select("_id")
            if sum(touched[p] for p in group) <= keys_at_once:
                gone = F.broadcast(gone)
            kept = self.rows.read_for_rewrite(group).join(gone, "_id", "left_anti")
            self.rows.replace(group, kept.unionByName(puts.where(here)), ["_id"])
        fresh = puts.where(~F.col("prefix").isin(*touched)) if touched else puts
        if fresh.limit(1).count():
            self.rows.append(fresh, ["_id"])

    def _among(self, keys: DataFrame) -> DataFrame:
        """Those of the keys that the catalog holds."""
        some = [r["_id"] for r in keys.select("_id").limit(MAX_FILTER_KEYS + 1).collect()]
        there = self.read(some) if len(some) <= MAX_FILTER_KEYS else self.read()
        return keys.distinct().join(there.select("_id"), "_id", "left_semi")

    def compact(self) -> None:
        """Write each partition anew as one sorted file, where many small changes left many."""
        parts = self.rows.parts()
        if parts:
            self.rows.replace(parts, self.rows.read(parts).repartition("prefix"), ["_id"])

    # -- read ------------------------------------------------------------------------------

    def read(self, ids: Sequence[str] | None = None) -> DataFrame:
        """The current rows; with ``ids`` (the keys of one page) only those: they reach the scan as
        prefix and key filters, so only their folders and row groups are read."""
        if not self.exists():
            return self.spark.createDataFrame([], DOCUMENT)
        if ids is None:
            return self.rows.read().select(*DOCUMENT.names)
        n = self.prefix_chars
        found = self.rows.read(sorted({i[:n] for i in ids}))
        return (found.where(F.col("_id").isin(*ids)) if ids else found).select(*DOCUMENT.names)
