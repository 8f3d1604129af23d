"""Files that arrive or change below a folder, as a streaming data source.

An offset is a point in time: a micro-batch has the files whose state is from the time between its
two offsets. The time of a file is when the file system last saw it change (for a local file also
when a folder above it was renamed or moved, so files keep their old dates and arrive all the same);
in an object store it is the time of the upload. A file that changes again is therefore delivered
again, a file that is still being written once more when it is closed. A folder that got another
entry may deliver its other files again: the delta passes over what has not changed.

The driver lists only the first folders, until there are enough for all tasks; tasks list all that is
below. Rows are narrow, as in the listing of the batch ingest; nothing is opened here.
"""

from __future__ import annotations

import datetime
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from docloom import constants as C
from docloom.session import ship_package
from docloom.sources.files import is_remote, local_path, open_store

#: Folders that are handed out are at least so many, if there are; partitions at most so many.
MIN_FOLDERS, MAX_PARTITIONS = 64, 1024
#: The driver looks at so many entries of a folder; one with more is left to a task as a whole.
MAX_ENTRIES = 20_000
#: Clocks of file systems lag behind by less; clocks of stores may differ by less.
LOCAL_LAG, REMOTE_LAG = 0.05, 5.0

_EPOCH = datetime.datetime(1970, 1, 1)


@dataclass
class Entry:
    path: str
    is_dir: bool
    size: int | None
    modified_ns: int | None
    changed_ns: int


def entries(folder: str) -> Iterator[Entry]:
    """What is in a folder; nothing if it has gone or cannot be read."""
    if is_remote(folder):
        from pyarrow import fs

        store, inner = open_store(folder)
        prefix = folder[: len(folder) - len(inner.rstrip("/"))] if inner else folder
        for info in store.get_file_info(fs.FileSelector(inner, recursive=False, allow_not_found=True)):
            is_dir = info.type == fs.FileType.Directory
            yield Entry(prefix + info.path, is_dir, info.size, info.mtime_ns, 0 if is_dir else info.mtime_ns or 0)
        return
    try:
        with os.scandir(local_path(folder)) as found:
            for e in found:
                path = os.fsencode(e.path).decode("utf-8", "replace")
                if path.encode() != os.fsencode(e.path):
                    continue  # no path in a table can name it: the batch ingest reports it
                is_dir = e.is_dir(follow_symlinks=False)
                if not is_dir and e.is_dir():
                    continue  # a link to a folder is not followed
                try:
                    st = e.stat(follow_symlinks=not is_dir)
                except OSError:
                    continue  # gone meanwhile; one that cannot be read is found by the batch ingest
                yield Entry(path, is_dir, st.st_size, st.st_mtime_ns, st.st_ctime_ns)
    except (FileNotFoundError, NotADirectoryError, PermissionError):
        return


def is_pruned(path: str) -> bool:
    """A folder that is never entered: by its name, as in the batch ingest."""
    name = path.rsplit("/", 1)[1].lower()
    return name.startswith(".") or name in {n.lower() for n in C.EXCLUDED_FOLDER_NAMES}


@dataclass
class Folders(InputPartition):
    """Folders to list: ``(path, with all below, time of the folders above)``."""

    folders: list[tuple[str, bool, int]]
    start: int
    end: int


class ArrivalReader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root.rstrip("/") or "/"

    def initialOffset(self) -> dict:
        return {"time": 0}

    def latestOffset(self) -> dict:
        if is_remote(self.root):
            return {"time": int((time.time() - REMOTE_LAG) * 1000)}
        now = int(time.time() * 1000)
        time.sleep(LOCAL_LAG)  # what is stamped with an earlier time is there when tasks look
        return {"time": now}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        if start["time"] >= end["time"]:
            return []
        listed: list[tuple[str, bool, int]] = []
        whole: list[tuple[str, bool, int]] = []
        frontier = [(self.root, 0)]
        while frontier and len(frontier) + len(whole) < MIN_FOLDERS:
            below: list[tuple[str, int]] = []
            for folder, above in frontier:
                seen, inside = 0, []
                for e in entries(folder):
                    seen += 1
                    if e.is_dir and not is_pruned(e.path):
                        inside.append((e.path, max(above, e.changed_ns)))
                    if seen > MAX_ENTRIES:
                        break
                if seen > MAX_ENTRIES:
                    whole.append((folder, True, above))
                else:
                    listed.append((folder, False, above))
                    below += inside
            frontier = below
        whole += [(folder, True, above) for folder, above in frontier]
        every = whole + listed
        n = min(len(every), MAX_PARTITIONS)
        return [Folders(every[i::n], start["time"], end["time"]) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        todo = list(partition.folders)
        while todo:
            folder, below, above = todo.pop()
            for e in entries(folder):
                if e.is_dir:
                    if below and not is_pruned(e.path):
                        todo.append((e.path, True, max(above, e.changed_ns)))
                elif partition.start <= max(above, e.changed_ns) // 1_000_000 < partition.end:
                    yield self.root, e.path, e.size, _date(e.modified_ns), None

    def commit(self, end: dict) -> None:
        """Nothing is kept."""


def _date(ns: int | None) -> datetime.datetime | None:
    return None if ns is None else _EPOCH + datetime.timedelta(milliseconds=ns // 1_000_000)


class Arrivals(DataSource):
    """``spark.readStream.format("arrivals").option("root", folder)``: rows of a listing."""

    @classmethod
    def name(cls) -> str:
        return "arrivals"

    def schema(self) -> str:
        return "root string, file_path string, file_size bigint, modified_date timestamp_ntz, created_date timestamp_ntz"

    def streamReader(self, schema) -> ArrivalReader:
        return ArrivalReader(self.options["root"])


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(Arrivals)
    return spark.readStream.format("arrivals").option("root", root).load()
