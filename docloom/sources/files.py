"""File listings as DataFrames (``schema.LISTING``).

Times are UTC without a zone, in milliseconds, so a file found by the walk or by the ``binaryFile``
stream looks the same to the delta. In :func:`walk` tasks list the folders, level by level.
Excluded folders are never entered, and the listing itself lives in a table, so its size is not
bound by one machine. A folder that cannot be listed is a row of its own (``unreadable``), so that
nobody takes what lies below it for deleted.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import paths
from docloom.schema import LISTING
from docloom.session import new_table_path, ship_package

_ENTRY = (
    "root string, file_path string, is_dir boolean, file_size bigint, "
    "modified_date timestamp_ntz, created_date timestamp_ntz, unreadable boolean"
)
_ENTRY_COLUMNS = [
    "root", "file_path", "is_dir", "file_size", "modified_date", "created_date", "unreadable",
]
_ROWS_PER_BATCH = 10_000


def existing_roots(spark: SparkSession, roots: Sequence[str]) -> list[str]:
    """The roots that exist, as absolute paths. A missing root is skipped, never an error."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    kept = []
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        store = path.getFileSystem(conf)
        if store.exists(path):
            kept.append(absolute(root) if store.getScheme() == "file" else store.makeQualified(path).toString())
    return list(dict.fromkeys(kept))


def absolute(root: str) -> str:
    """A local root from the file system's root on, without ``.``, ``..`` and double slashes."""
    return os.path.normpath("/" + os.path.abspath(local_path(root)).lstrip("/"))


def open_store(path: str):
    """``(pyarrow file system, path inside it)`` for a path on a remote store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def local_path(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _local_children(folder: str) -> Iterator[tuple]:
    with os.scandir(local_path(folder)) as entries:
        for e in entries:
            raw = os.fsencode(e.path)
            path = raw.decode("utf-8", "replace")
            named = path.encode() == raw  # else no path in a table can name it
            if e.is_dir(follow_symlinks=False):
                yield path, True, None, None, None, not named
            elif not e.is_dir():  # a link to a folder is not followed
                try:
                    st = e.stat()
                    seen = (st.st_size, st.st_mtime_ns, st.st_ctime_ns) if named else (None,) * 3
                    yield path, False, *seen, False
                except OSError:  # seen, but cannot be read: becomes an error row
                    yield path, False, None, None, None, False


def _remote_children(folder: str) -> Iterator[tuple]:
    from pyarrow import fs

    store, inner = open_store(folder)
    prefix = folder[: len(folder) - len(inner.rstrip("/"))] if inner else folder
    for info in store.get_file_info(fs.FileSelector(inner, recursive=False)):
        is_dir = info.type == fs.FileType.Directory
        yield prefix + info.path, is_dir, info.size, info.mtime_ns, None, False


def _entries(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_ENTRY_COLUMNS)
    out["file_size"] = out["file_size"].astype("Int64")
    for c in ("modified_date", "created_date"):
        ns = pd.to_numeric(out[c]).astype("Int64")
        out[c] = pd.to_datetime(ns // 1_000_000, unit="ms")
    return out


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for root, folder in zip(batch["root"], batch["file_path"]):
            children = _remote_children if is_remote(folder) else _local_children
            rows: list[tuple] = []
            try:
                for child in children(folder):
                    rows.append((root, *child))
                    if len(rows) >= _ROWS_PER_BATCH:
                        yield _entries(rows)
                        rows = []
            except FileNotFoundError:
                pass  # gone since its parent was listed; other errors make Spark try again
            except (NotADirectoryError, PermissionError):
                rows.append((root, folder, True, None, None, None, True))
            if rows:
                yield _entries(rows)


def is_excluded_folder(
    folder: Column,
    names: Sequence[str] = C.EXCLUDED_FOLDER_NAMES,
    parts: Sequence[str] = C.EXCLUDED_PATH_PARTS,
    dot_folders: bool = False,
) -> Column:
    """Is this one folder to be pruned, with everything below it?"""
    path = F.lower(paths.slashed(folder))
    name = F.substring_index(path, "/", -1)
    out = F.lit(False) if dot_folders else name.startswith(".")
    if names:
        out = out | name.isin(*[n.lower() for n in names])
    return out | paths.contains_part(path, parts)


def _listing_tasks(spark: SparkSession, folders: int) -> int:
    """A few tasks per slot, more when each would get over a thousand folders."""
    return min(folders, max(4 * spark.sparkContext.defaultParallelism, folders // 1000))


def walk(
    spark: SparkSession,
    roots: Sequence[str],
    names: Sequence[str] = C.EXCLUDED_FOLDER_NAMES,
    parts: Sequence[str] = C.EXCLUDED_PATH_PARTS,
    dot_folders: bool = False,
) -> DataFrame:
    """List all files below the roots, one job per folder level. Folders that cannot be listed
    are rows too: ``unreadable``, without size and time.

    ``dot_folders`` enters folders whose name starts with a dot as well (a mirror of all files).

    Every level is a table in the working folder: a lost executor repeats its own folders, and
    no listing passes the driver. Overlapping roots list a file once per root; the ingest
    keeps one row per key.
    """
    roots = [r.rstrip("/") or "/" for r in existing_roots(spark, roots)]
    if not roots:
        return spark.createDataFrame([], LISTING).withColumn("unreadable", F.lit(False))
    ship_package(spark)
    base = new_table_path(spark, "walk")
    frontier = spark.createDataFrame([(r, r) for r in roots], "root string, file_path string")
    folders = len(roots)
    levels: list[str] = []
    while True:
        level = f"{base}/level={len(levels)}"
        (
            frontier.repartition(_listing_tasks(spark, folders), "file_path")
            .mapInPandas(_list_folders, _ENTRY)
            .write.parquet(level)
        )
        levels.append(level)
        found = spark.read.schema(_ENTRY).parquet(level)
        frontier = found.where(
            F.col("is_dir")
            & ~F.col("unreadable")
            & ~is_excluded_folder(F.col("file_path"), names, parts, dot_folders)
        ).select("root", "file_path")
        folders = frontier.count()
        if not folders:
            break
    listed = spark.read.schema(_ENTRY).parquet(*levels)
    listed = listed.where(
        ~F.col("is_dir")
        | F.col("unreadable") & ~is_excluded_folder(F.col("file_path"), names, parts, dot_folders)
    )
    return listed.select(*[f.name for f in LISTING], "unreadable")


def listing_of_binary(files: DataFrame, root: str, *keep: str) -> DataFrame:
    """Columns of a ``binaryFile`` DataFrame under the names of a listing."""
    # as UTC wall-clock time, whatever the zone of the session
    seconds = (F.unix_millis("modificationTime") / 1000).cast("decimal(18,6)")
    since_epoch = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return files.select(
        F.lit(root).alias("root"),
        paths.slashed(F.col("path")).alias("file_path"),
        F.col("length").alias("file_size"),
        (F.lit("1970-01-01").cast("timestamp_ntz") + since_epoch).alias("modified_date"),
        F.lit(None).cast("timestamp_ntz").alias("created_date"),
        *keep,
    )
