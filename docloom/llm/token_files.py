"""Token ids as Parquet files: one row per document, ids in a list column.

``write_tokens`` brings documents into ascending ``doc_id`` order, one range of ids per shard, and
writes a Parquet file per shard: ids dictionary-encoded (their vocabulary fits a dictionary page),
ids of documents, places and counts delta-encoded, row groups of a bounded number of tokens, small
data pages with page indexes. A reader that wants a few documents, or only the metadata, reads
only their row groups, pages and columns; ``spark.read.parquet`` on the folder does the same.

``start`` counts the ids of all documents before. A shard counts from its own beginning; the
manifest (one row per shard) says where each shard begins.

Defined cases: a null text is empty and yields its end id only; rows with equal ``doc_id`` are
each written, one after the other in the order of their texts' hashes; a null ``doc_id`` comes
first; an empty table gives no rows; only the metadata columns asked for are written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import (
    NULL_ID, batch, byte_column, keyed_texts, list_array, map_arrow, shuffle_partitions, slices,
)
from docloom.llm.files import new_file, open_file
from docloom.llm.tokenizing import encoder

#: Ids in a row group, and bytes in a data page.
GROUP_TOKENS, PAGE_BYTES = 4 << 20, 64 << 10
#: Bytes of text encoded at a time.
ENCODE_BYTES = 1 << 20

_IDS = "ids.list.element"
_SHARD = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
_SHARD_TYPE = "shard int, name string, n_docs long, n_tokens long, first long, last long"


@dataclass
class TokenFiles:
    folder: str
    shards: list[tuple[str, int, int, int]]
    """``(name, ids before it, first, last)`` of each file, in order."""


def _write(folder: str, path: str, end_id: int, metadata: Sequence[str]):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        enc = encoder(path)
        for part in batches:
            raw, offsets = byte_column(part.column("text"))
            for i, j in slices(offsets, ENCODE_BYTES):
                cut = offsets[i : j + 1]
                ids, offs = enc.encode(raw[cut[0] : cut[-1]], cut - cut[0])
                ids = np.insert(ids.astype(np.int32), offs[1:], end_id)
                yield part.slice(i, j - i), ids, np.diff(offs) + 1

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}.parquet"
        total = docs = 0
        first = last = None
        found = parts(batches)
        begin = next(found, None)
        if begin is None:
            return
        kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]
        kinds += [(c, begin[0].schema.field(c).type) for c in metadata] + [("ids", pa.list_(pa.int32()))]
        schema = pa.schema(kinds)
        deltas = {c: "DELTA_BINARY_PACKED" for c in ("doc_id", "start", "n_tokens")}
        with new_file(folder, name) as out, pq.ParquetWriter(
            out, schema, compression="zstd", compression_level=1, use_dictionary=[_IDS, *metadata],
            column_encoding=deltas, data_page_size=PAGE_BYTES, write_page_index=True,
            dictionary_pagesize_limit=1 << 20, data_page_version="2.0",
        ) as writer:
            held, n = [], 0

            def flush() -> None:
                writer.write_table(pa.Table.from_batches(held, schema), row_group_size=1 << 30)

            for part, ids, sizes in (x for y in ([begin], found) for x in y):
                doc = np.asarray(part.column("doc"))
                starts = total + np.cumsum(sizes) - sizes
                held.append(batch(
                    schema, pa.array(doc, pa.int64(), mask=doc == NULL_ID), starts, sizes,
                    *(part.column(c) for c in metadata), list_array(ids, sizes, pa.int32()),
                ))
                total, docs, n = total + len(ids), docs + len(doc), n + len(ids)
                first, last = int(doc[0]) if first is None else first, int(doc[-1])
                if n >= GROUP_TOKENS:
                    flush()
                    held, n = [], 0
            if held:
                flush()
        yield batch(_SHARD, [shard], [name], [docs], [total], [first], [last])

    return job


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, metadata: Sequence[str] = ()
) -> TokenFiles:
    """Writes ``docs`` to a new ``folder`` and returns its files. ``tokenizer`` is a path that
    every worker can open; ``metadata`` names more columns of ``docs`` to write."""
    spark = docs.sparkSession
    texts = keyed_texts(docs, *(F.col(f"`{c}`") for c in metadata))
    ordered = texts.repartitionByRange(shuffle_partitions(spark), "doc").sortWithinPartitions("doc", "tag")
    shards = map_arrow(ordered, _write(folder, tokenizer, end_id, metadata), _SHARD_TYPE).collect()
    shards.sort(key=lambda s: s["shard"])  # one row per file
    before = accumulate((s["n_tokens"] for s in shards), initial=0)
    return TokenFiles(folder, [(s["name"], b, s["first"], s["last"]) for s, b in zip(shards, before)])


def _read(folder: str, columns: Sequence[str], low: int | None, high: int | None, make, schema: pa.Schema):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for name, before in zip(part.column("name").to_pylist(), part.column("before").to_pylist()):
                with open_file(folder, name) as source:
                    file = pq.ParquetFile(source)
                    doc = file.schema_arrow.get_field_index("doc_id")
                    for g in range(file.num_row_groups):
                        stats = file.metadata.row_group(g).column(doc).statistics
                        if stats is not None and stats.has_min_max and not stats.null_count:
                            if low is not None and stats.max < low or high is not None and stats.min > high:
                                continue
                        for rows in file.iter_batches(2000, row_groups=[g], columns=list(columns)):
                            yield make(rows, before)

    return job


def read_tokens(
    spark: SparkSession, files: TokenFiles, schema: pa.Schema, schema_type: str, make,
    columns: Sequence[str], low: int | None = None, high: int | None = None,
) -> DataFrame:
    """Applies ``make(rows, ids_before)`` to the files' rows, reading ``columns`` only. With
    ``low`` or ``high``, files and row groups without a ``doc_id`` in the range are not read."""
    wanted = [
        (n, b) for n, b, first, last in files.shards
        if (low is None or last >= low) and (high is None or first <= high or first == NULL_ID)
    ]
    shards = spark.createDataFrame(wanted, "name string, before long")
    spread = shards.repartition(max(1, len(wanted)))  # a file a task
    return map_arrow(spread, _read(files.folder, columns, low, high, make, schema), schema_type)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digest(rows: pa.RecordBatch, before: int) -> pa.RecordBatch:
    ids = rows.column("ids")
    cuts = (np.asarray(ids.offsets) * 4).tolist()
    flat = memoryview(np.ascontiguousarray(np.asarray(ids.values).astype("<u4"))).cast("B")
    crc = [zlib.crc32(flat[a:b]) for a, b in zip(cuts, cuts[1:])]
    starts = np.asarray(rows.column("start")) + before
    return batch(_DIGEST, rows.column("doc_id"), starts, rows.column("n_tokens"), crc)


def token_digests(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files."""
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return read_tokens(spark, files, _DIGEST, kinds, _digest, ["doc_id", "start", "n_tokens", "ids"])


_METADATA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def token_metadata(spark: SparkSession, files: TokenFiles, low: int | None = None, high: int | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens)`` of the documents in a range, without reading any ids."""

    def make(rows: pa.RecordBatch, before: int) -> pa.RecordBatch:
        return batch(_METADATA, rows.column("doc_id"), np.asarray(rows.column("start")) + before, rows.column("n_tokens"))

    out = read_tokens(spark, files, _METADATA, "doc_id long, start long, n_tokens long", make, ["doc_id", "start", "n_tokens"], low, high)
    if low is not None:
        out = out.where(F.col("doc_id") >= low)
    return out if high is None else out.where(F.col("doc_id") <= high)
