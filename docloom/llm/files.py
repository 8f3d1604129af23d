"""Files that tasks write themselves, in the storage a URI names.

A file gets its final name when it is complete, and the name follows from the task's partition:
a task that runs again, on another executor or twice at once, writes the same bytes to the same
name. Readers go by the list of files that the finished job returned, so what a lost executor left
behind is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def storage(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@contextmanager
def new_file(folder: str, name: str) -> Iterator:
    """A stream into ``folder/name``; the name appears when the block ends without an error."""
    where, path = storage(folder)
    where.create_dir(path, recursive=True)
    attempt = f"{path}/_attempt-{uuid.uuid4().hex}"
    with where.open_output_stream(attempt) as out:
        yield out
    where.move(attempt, f"{path}/{name}")


def open_file(folder: str, name: str):
    where, path = storage(folder)
    return where.open_input_file(f"{path}/{name}")
