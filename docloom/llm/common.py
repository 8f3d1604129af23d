"""What the operators share: reading tables, shared storage, byte arrays and streamed groups.

Document keys. ``doc_id`` may be null; inside an operator a null becomes the smallest long, so it
sorts before every other id, and results turn it back into null. Rows that share a ``doc_id`` are
told apart by ``tag``, a hash of their text; equal rows stay equal rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.session import give_back_memory, new_table_path, ship_package

NULL_ID = -(2**63)
#: Tokens that numpy works on at a time, so that its arrays stay in the processor's cache.
SLICE = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder all executors share, and read from there. This cuts its
    lineage: a lost executor costs the tasks it ran, not the job."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def doc_id_of(key: str = "doc") -> Column:
    return F.nullif(F.col(key), F.lit(NULL_ID))


def keyed_texts(docs: DataFrame, *more: Column) -> DataFrame:
    """``(doc, tag, text, *more)``; every other column of ``docs`` is left out."""
    text = text_of()
    return docs.select(doc_key().alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"), *more)


def kept_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``(doc, tag)`` is among ``keys``; of rows that share
    both, the one whose columns hash least, as such rows are copies of each other."""
    doc, tag = "_kept_rows_doc", "_kept_rows_tag"
    keys = stored(keys.select(F.col("doc").alias(doc), F.col("tag").alias(tag)), "kept-keys")
    once = keys.groupBy(doc, tag).agg(F.count(F.lit(1)).alias("rows"))
    repeats = once.where("rows > 1").limit(1).count() > 0
    rows = docs.withColumns({doc: doc_key(), tag: F.xxhash64(text_of())}).join(keys, [doc, tag], "left_semi")
    if repeats:
        place = Window.partitionBy(doc, tag).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
        rows = rows.withColumn("_kept_rows_place", F.row_number().over(place)).where("_kept_rows_place = 1")
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


#: Bytes of rows that a worker is handed at a time.
BATCH_BYTES = 16 << 20


def map_arrow(df: DataFrame, job: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers, over batches of bounded size."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(_tidy(job), schema)


def _tidy(job: Callable) -> Callable:
    """``job``, after which the worker gives its free memory back: Spark keeps workers for later
    tasks, and what their allocators hold on to would count against the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from job(batches)
        finally:
            give_back_memory()

    return run


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the ``n + 1`` offsets of its rows, uncopied."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` tokens together, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def batch(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, from batches sorted by them. One group is held at a
    time: callers bound the size of their groups."""
    held: list[pa.RecordBatch] = []
    last = None
    for part in batches:
        if part.num_rows == 0:
            continue
        columns = [np.asarray(part.column(k)) for k in keys]
        changed = np.zeros(part.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), part.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def combined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches, put together to about ``rows`` rows."""
    held, n = [], 0
    for part in batches:
        held.append(part)
        n += part.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def column_array(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
