"""Session helpers: local sessions for tests and bench, and the shared working folder."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Settings of the session the jobs rely on. A list of up to so many keys is checked against
#: the key range of every row group, which is what makes a page or a micro-batch of keys cheap.
RUNTIME_SETTINGS = {"spark.sql.parquet.pushdown.inFilterThreshold": "1000"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cpus: int | str = 8, app: str = "docloom", shuffle_partitions: int | None = None
) -> SparkSession:
    """A local session for tests and the bench. On a cluster the job's own session is used."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_own_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a plain local session, whose executor is the driver, may go without it; then the
    session gets a temporary folder of its own, which goes with the process.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_folders.get(context.applicationId)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


_run: ContextVar[str | None] = ContextVar("run_folder", default=None)


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path under the working folder, or the current run's folder in it, that no earlier run has
    used."""
    folder = _run.get() or work_folder(spark).rstrip("/")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediate tables of one job, which goes when the job's result is
    written. What the job returns must not read from it."""
    folder = f"{work_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    before = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: With it the shuffle files of a query go when the query ends.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs run inside go with each job; else they stay until the driver happens to
    collect its garbage, and those of one job add up with those of the next. A DataFrame that is run
    inside should not be run twice: write it and read it back."""
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Needed where it is neither installed on the executors nor submitted with ``--py-files``.
    The driver hands the archive to Spark, which distributes it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="docloom-package-"), "docloom"),
        "zip",
        os.path.dirname(package),
        os.path.basename(package),
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a table over all slots when it is read in fewer splits than there are slots.

    A large table already has many splits and stays where it is. A small one may sit in one
    row group and would keep a single core busy with all of its text.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


#: Bytes of rows that a worker is handed at a time, and of texts that it hands back at a time.
BATCH_BYTES = 4 << 20
#: After so many bytes a worker gives its free memory back.
TIDY_BYTES = 32 << 20


def map_batches(df: DataFrame, job: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers, over batches of bounded size, so that
    what a worker holds does not follow the rows of its task."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tidied(job(part for whole in batches for part in small_parts(whole)), lambda out: out.nbytes)

    return df.mapInArrow(run, schema)


def map_frames(df: DataFrame, job: Callable, schema) -> DataFrame:
    """:func:`map_batches` over pandas frames, for rows that are narrow when they come in."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _tidied(job(frames), lambda out: int(out.memory_usage(index=False, deep=True).sum()))

    return df.mapInPandas(run, schema)


def _tidied(results: Iterator, size: Callable) -> Iterator:
    """What a job yields; memory that is free is given back as the job goes on, and at its end."""
    passed = 0
    try:
        for out in results:
            passed += size(out)
            yield out
            if passed >= TIDY_BYTES:
                del out
                give_back_memory()
                passed = 0
    finally:
        give_back_memory()


def small_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``BATCH_BYTES``, were it made larger than that."""
    rows = max(batch.num_rows * BATCH_BYTES // max(batch.nbytes, 1), 1)
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def give_back_memory() -> None:
    """Spark keeps workers for later tasks, and what their allocators hold on to would count against
    the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
