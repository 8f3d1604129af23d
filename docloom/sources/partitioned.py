"""A plain Parquet table in folders by one column, changed a few folders at a time.

Rows are appended, or the rows of some partitions are replaced by Spark's dynamic partition
overwrite: files of other partitions stay as they are, and the new files of the replaced ones get
their place when all tasks are done. A job may read the partitions that it replaces. One writer at
a time; a reader that has listed the files of a partition just before it is replaced starts again.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of old files that one task rewrites.
BYTES_PER_TASK = 64 << 20


class PartitionedTable:
    """Rows of ``schema``, a list of columns as in SQL, the last of which is the partition. With
    ``key``, files carry a Bloom filter of that column, so a look-up of a few keys reads the row
    groups that have them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.options = {"partitionOverwriteMode": "dynamic"}
        if key:
            self.options[f"parquet.bloom.filter.enabled#{key}"] = "true"
            # as large as its keys need; else each file, however small, has a filter of a megabyte
            self.options["parquet.bloom.filter.adaptive.enabled"] = "true"
        self.part = schema.rsplit(",", 1)[1].split()[0]

    # -- folders ---------------------------------------------------------------------------

    def _store(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def exists(self) -> bool:
        store, path = self._store(self.path)
        return store.exists(path)

    def create(self) -> PartitionedTable:
        store, path = self._store(self.path)
        store.mkdirs(path)
        return self

    def parts(self) -> list[str]:
        """The partitions there are, as their folders name them."""
        store, path = self._store(self.path)
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{self.part}="))

    def _bytes(self) -> int:
        store, path = self._store(self.path)
        return store.getContentSummary(path).getLength()

    def _remove(self, parts: Iterable) -> None:
        for part in parts:
            store, path = self._store(f"{self.path}/{self.part}={part}")
            store.delete(path, True)

    # -- rows ------------------------------------------------------------------------------

    def read(self, parts: Sequence | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows if parts is None else rows.where(F.col(self.part).isin(*parts) if parts else F.lit(False))

    def read_for_rewrite(self, parts: Sequence, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
        """The rows of partitions in tasks of a good size. Tasks take whole files, so small files
        are put together without a shuffle."""
        share = len(parts) / max(len(self.parts()), 1)
        tasks = max(int(self._bytes() * share) // bytes_per_task, 1)
        return self.read(parts).coalesce(max(tasks, min(len(parts), self.spark.sparkContext.defaultParallelism)))

    def _write(self, rows: DataFrame, mode: str, sort: Sequence[str]) -> None:
        ordered = rows.sortWithinPartitions(self.part, *sort)
        writer = ordered.write.mode(mode).options(**self.options)
        writer.partitionBy(self.part).parquet(self.path)

    def append(self, rows: DataFrame, sort: Sequence[str] = ()) -> None:
        self._write(rows, "append", sort)

    def replace(self, parts: Sequence, rows: DataFrame, sort: Sequence[str] = ()) -> None:
        """``rows``, all of these partitions, in place of what the partitions hold. Each task sorts
        and writes what it has; nothing is shuffled here."""
        seen = Observation()
        written = rows.observe(seen, F.collect_set(F.col(self.part).cast("string")).alias("parts"))
        self._write(written, "overwrite", sort)
        # a partition that lost all of its rows is not among the written ones
        self._remove({str(p) for p in parts} - set(seen.get["parts"] or []))
