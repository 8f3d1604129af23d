"""Micro-batch ingest of new and changed files with Structured Streaming.

The source delivers the listing rows of files that arrived or changed since the last micro-batch,
as often as they change; the delta against the catalog passes over those that it knows. Deleted
files are found by the batch ingest, run on a schedule over the same catalog. State is the
catalog itself, keyed by path; there are no windows and no late data.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from docloom import constants as C
from docloom.operators import delta as D
from docloom.operators import filters
from docloom.operators.extract import extract_listed
from docloom.plans.indexing import refresh_index
from docloom.plans.ingest import document_rows, one_row, read_tasks, summary
from docloom.session import new_table_path, run_folder
from docloom.sources import files, progress
from docloom.sources.arrivals import arrivals
from docloom.sources.catalog import MAX_FILTER_KEYS, Catalog, cluster


def _known(catalog: Catalog, keyed: DataFrame) -> DataFrame:
    """What the catalog knows of the keys of one micro-batch.

    The keys of a usual batch (a few files) go to the scan as a filter, so the cost does not
    grow with the catalog. A very large batch is joined with it instead.
    """
    keys = [r["_id"] for r in keyed.select("_id").limit(MAX_FILTER_KEYS + 1).collect()]
    return D.metadata(catalog.read(keys if len(keys) <= MAX_FILTER_KEYS else None))


def ingest_batch(
    catalog: Catalog,
    root: str,
    stream: str,
    backup_root: str | None = None,
    index_root: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function: one commit and one progress record per micro-batch of listing
    rows. A batch without files leaves no trace.

    Which files count is decided on narrow rows, listed once; only new and changed files are opened,
    in as many tasks as their bytes need, and their texts are written where they are read. The
    record is written first, under the batch's tag: a batch that fails before its commit writes it
    again, one that fails after it has it. A batch that was committed is recognised by its tag and
    skipped, and a row replaces the row with the same key, so a replay changes nothing. With
    ``index_root`` the text index follows every commit.
    """
    spark = catalog.spark

    def kept(rows: DataFrame, name: str) -> DataFrame:
        path = new_table_path(spark, name)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def run(batch: DataFrame, batch_id: int) -> None:
        with run_folder(spark):
            changed = ingest(batch, f"{stream}-{batch_id}")
        if changed and index_root is not None:
            refresh_index(catalog, index_root)

    def ingest(batch: DataFrame, tag: str) -> bool:
        if catalog.applied(tag):
            return False
        accepted = filters.accepted(F.col("file_path"), F.col("root"))
        scan = kept(D.with_keys(batch, accepted), "scan")
        statuses = kept(D.delta(scan, _known(catalog, scan), [root], whole_scan=False), "statuses")
        seen = summary(statuses).asDict()
        if not any(seen.values()):
            return False
        progress.write(f"{catalog.path}/progress", tag, progress.record(one_row(spark, seen), is_running=True))
        if not seen["indexed"]:
            return False
        todo = statuses.where(F.col("status") == D.INDEXED)
        tasks = read_tasks(spark, seen["indexed"], seen["bytes"])
        texts = extract_listed(cluster(todo, tasks)).where("readable")
        catalog.apply(document_rows(texts, backup_root), tag=tag, clustered=True)
        return True

    return run


def start_ingest(
    spark: SparkSession,
    root: str,
    catalog_path: str,
    checkpoint: str,
    stream: str = "stream",
    available_now: bool = False,
    backup_root: str | None = None,
    index_root: str | None = None,
    interval: str = C.REFRESH_INTERVAL,
) -> StreamingQuery:
    """Start the stream. By default it looks for files every ``REFRESH_INTERVAL``; end it with
    :func:`finish_ingest`."""
    catalog = Catalog(spark, catalog_path).ensure()
    root = (files.existing_roots(spark, [root]) or [root])[0]
    writer = (
        arrivals(spark, root).writeStream.queryName(stream)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(ingest_batch(catalog, root, stream, backup_root, index_root))
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


@dataclass(frozen=True)
class Trigger:
    """One micro-batch as the listener saw it."""

    batch_id: int
    started: str
    seconds: float
    rows: int


class TriggerLog(StreamingQueryListener):
    """Keeps what each trigger of a stream did. Add it with ``spark.streams.addListener``."""

    def __init__(self, stream: str):
        self.stream, self.triggers = stream, list[Trigger]()
        self._news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        """Nothing is known yet."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.stream:
            with self._news:
                self.triggers.append(Trigger(p.batchId, p.timestamp, p.batchDuration / 1000, p.numInputRows))
                self._news.notify_all()

    def onQueryTerminated(self, event) -> None:
        """The closing record says so."""

    def wait_for_rows(self, batches: int, timeout: float) -> bool:
        """Waits until so many micro-batches had files."""

        def enough() -> bool:
            return len({t.batch_id for t in self.triggers if t.rows}) >= batches

        with self._news:
            return self._news.wait_for(enough, timeout)


def _reached(query: StreamingQuery) -> int:
    """The time up to which the stream has worked, in milliseconds."""
    done = query.lastProgress
    offset = done.sources[0].endOffset if done and done.sources else None
    return int(re.search(r"\d+", str(offset))[0]) if offset else 0


def finish_ingest(query: StreamingQuery, catalog_path: str, stop: bool = False, poll: float = 0.2) -> None:
    """Waits until the stream ends (as with ``available_now``), or with ``stop`` ends it once it
    has worked off the files there are now. Then writes the closing record: no longer running, and
    no counters of its own."""
    if stop:
        now = time.time() * 1000
        while query.isActive and _reached(query) < now:
            time.sleep(poll)
        query.stop()
    query.awaitTermination()
    closing = progress.record(progress.no_counters(SparkSession.active()), is_running=False)
    progress.write(f"{catalog_path.rstrip('/')}/progress", f"{query.name}-end", closing)
