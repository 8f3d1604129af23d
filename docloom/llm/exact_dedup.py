"""Exact duplicates through a minimal perfect hash over the digests seen so far.

``build_history`` makes a :class:`History` of a table of documents: the distinct SHA-256 digests
of their normalised texts (A-Z lower-cased, all else unchanged), dealt to shards of about 4,096
digests. Each shard holds a minimal perfect hash (hash and displace): a bucket's seed sends every
digest of the shard to a slot of its own, with no free slots. A slot holds the full digest, the
winner (the largest ``doc_id``) and how many rows it stands for.

``lookup`` sends narrow ``(doc_id, digest)`` rows to their shard and compares all 32 bytes of the
slot's digest: equal bytes are a repeat of history, any other digest is a nonmember, as a perfect
hash gives some slot for every digest. Nonmembers are grouped among themselves. A shard that gets
many rows (a digest that a third of all rows share) is read by as many tasks as its rows need.

Defined cases: a null text is empty; empty texts are equal to each other; a null ``doc_id`` is
smaller than every other; of rows with equal ``doc_id`` and equal text one is kept; an empty
table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import batch, byte_column, column_array, doc_id_of, keyed_texts, map_arrow, stored
from docloom.llm.hashing import mix
from docloom.session import ship_package

SHARD_DIGESTS = 4096
DIGESTS_PER_BUCKET = 4
#: Rows that one lookup task takes of a shard.
LOOKUP_ROWS = 50_000

_DIGESTS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("digest", pa.binary())])
_SHARD = pa.schema([
    ("shard", pa.int64()), ("n", pa.int32()), ("seeds", pa.binary()), ("digests", pa.binary()),
    ("winners", pa.binary()), ("sizes", pa.binary()),
])
_SHARD_TYPE = "shard long, n int, seeds binary, digests binary, winners binary, sizes binary"
_FOUND = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("digest", pa.binary()), ("winner", pa.int64()), ("size", pa.int64())])
_FOUND_TYPE = "doc long, tag long, digest binary, winner long, size long"


@dataclass
class History:
    shards: int
    slots: DataFrame


def _digest_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        raw, offsets = byte_column(pc.ascii_lower(part.column("text")))
        view = memoryview(np.ascontiguousarray(raw))
        cuts = offsets.tolist()
        digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(cuts, cuts[1:])]
        yield batch(_DIGESTS, part.column("doc"), part.column("tag"), digests)


def digests(docs: DataFrame) -> DataFrame:
    """``(doc, tag, digest)``, stored: narrow rows that the later steps read again."""
    return stored(map_arrow(keyed_texts(docs), _digest_job, "doc long, tag long, digest binary"), "digests")


def _halves(digest_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digest_rows.view("<u8").reshape(len(digest_rows), 4)
    return words[:, 0], words[:, 1]


def slot_of(digest_rows: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slots of digests, given as rows of 32 bytes."""
    a, b = _halves(digest_rows)
    seed = seeds[(a % np.uint64(len(seeds))).astype(np.int64)].astype(np.uint64)
    return (mix(b + mix(seed + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def perfect_hash(digest_rows: np.ndarray) -> np.ndarray:
    """Seeds, one per bucket, that send ``n`` distinct digests to ``n`` distinct slots."""
    n = len(digest_rows)
    buckets = max(1, -(-n // DIGESTS_PER_BUCKET))
    a, b = _halves(digest_rows)
    bucket = (a % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    seeds, free = np.zeros(buckets, np.uint32), np.ones(n, bool)
    for k in np.argsort(bounds[:-1] - bounds[1:], kind="stable"):  # large buckets first
        own = b[order[bounds[k] : bounds[k + 1]]]
        if not len(own):
            break
        tried = 0
        while True:
            trial = np.arange(tried, tried + 256, dtype=np.uint64)
            slots = (mix(own[:, None] + mix(trial + np.uint64(1))[None, :]) % np.uint64(n)).astype(np.int64)
            fits = free[slots].all(0)
            if len(own) > 1:
                ordered = np.sort(slots, 0)
                fits &= (ordered[1:] != ordered[:-1]).all(0)
            if fits.any():
                hit = int(np.argmax(fits))
                seeds[k] = tried + hit
                free[slots[:, hit]] = False
                break
            tried += 256
    return seeds


def _as_rows(column: pa.Array) -> np.ndarray:
    raw, _ = byte_column(column)
    return np.frombuffer(raw.tobytes(), np.uint8).reshape(-1, 32)


def _build_shard(part: pa.Table) -> pa.Table:
    rows = _as_rows(column_array(part, "digest"))
    seeds = perfect_hash(rows)
    place = np.argsort(slot_of(rows, seeds, len(rows)))
    winners, sizes = (np.asarray(part.column(c))[place].astype("<i8") for c in ("winner", "size"))
    shard = part.column("shard")[0].as_py()
    return pa.Table.from_batches([
        batch(_SHARD, [shard], [len(rows)], [seeds.astype("<u4").tobytes()], [rows[place].tobytes()], [winners.tobytes()], [sizes.tobytes()])
    ])


def build_history(digest_rows: DataFrame) -> History:
    """A history of ``(doc, digest)`` rows. Equal digests are counted in their tasks first."""
    spark = digest_rows.sparkSession
    ship_package(spark)
    distinct = stored(
        digest_rows.groupBy("digest").agg(F.max("doc").alias("winner"), F.count(F.lit(1)).alias("size")),
        "distinct-digests",
    )
    shards = max(1, -(-distinct.count() // SHARD_DIGESTS))
    dealt = distinct.withColumn("shard", _shard_of(shards))
    return History(shards, stored(dealt.groupBy("shard").applyInArrow(_build_shard, _SHARD_TYPE), "history"))


def _shard_of(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("long")


def _look_up(rows: pa.Table, slots: pa.Table) -> pa.Table:
    mine = _as_rows(column_array(rows, "digest")) if rows.num_rows else np.zeros((0, 32), np.uint8)
    winner = np.zeros(len(mine), np.int64)
    size = np.zeros(len(mine), np.int64)
    member = np.zeros(len(mine), bool)
    if slots.num_rows and len(mine):
        seeds, digests_, winners, sizes = (
            np.frombuffer(slots.column(c)[0].as_py(), k)
            for c, k in (("seeds", "<u4"), ("digests", np.uint8), ("winners", "<i8"), ("sizes", "<i8"))
        )
        slot = slot_of(mine, seeds, len(winners))
        member = (digests_.reshape(-1, 32)[slot] == mine).all(1)
        winner, size = winners[slot], sizes[slot]
    out = batch(
        _FOUND, column_array(rows, "doc"), column_array(rows, "tag"), column_array(rows, "digest"),
        pa.array(winner, pa.int64(), mask=~member), pa.array(size, pa.int64(), mask=~member),
    )
    return pa.Table.from_batches([out])


def lookup(digest_rows: DataFrame, history: History) -> DataFrame:
    """``(doc, tag, digest, winner, size)``: winner and size are null for nonmembers."""
    ship_package(digest_rows.sparkSession)
    rows = digest_rows.withColumn("shard", _shard_of(history.shards))
    counts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    parts = counts.select("shard", F.ceil(F.col("rows") / LOOKUP_ROWS).cast("int").alias("parts"))
    crowded = parts.where("parts > 1")  # at most one shard for every LOOKUP_ROWS rows
    rows = rows.join(crowded, "shard", "left").withColumn(
        "part", F.pmod(F.xxhash64("doc", "tag"), F.coalesce("parts", F.lit(1))).cast("int")
    )
    slots = history.slots.join(crowded, "shard", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    )
    return (
        rows.drop("parts").groupBy("shard", "part")
        .cogroup(slots.drop("parts").groupBy("shard", "part"))
        .applyInArrow(_look_up, _FOUND_TYPE)
    )


def decide(digest_rows: DataFrame, history: History) -> DataFrame:
    """``(doc, tag, digest, keep, group_size, kept, alike)`` for every row: members follow the winner
    of history, nonmembers the largest ``doc`` among themselves. ``alike`` rows share ``doc`` and ``tag``."""
    found = stored(lookup(digest_rows, history), "lookups")
    others = found.where("winner is null")
    own = others.groupBy("digest").agg(F.max("doc").alias("own_winner"), F.count(F.lit(1)).alias("own_size"))
    grouped = others.join(own, "digest").select("doc", "tag", "digest", F.col("own_winner").alias("winner"), F.col("own_size").alias("size"))
    rows = found.where("winner is not null").unionByName(grouped)
    by_tag = Window.partitionBy("digest", "doc").orderBy("tag")
    place = F.row_number().over(by_tag)
    alike = F.count(F.lit(1)).over(by_tag.rangeBetween(Window.currentRow, Window.currentRow))
    return rows.select(
        "doc", "tag", "digest", F.col("winner").alias("keep"), F.col("size").alias("group_size"),
        ((F.col("doc") == F.col("winner")) & (place == 1)).alias("kept"), alike.alias("alike"),
    )


def deduplicate(docs: DataFrame, history_docs: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, tag, keep_id, group_size, kept, digest, alike)``. Without
    ``history_docs`` the table is its own history, so that every digest is a member."""
    own = digests(docs)
    history = build_history(own if history_docs is None else digests(history_docs))
    out = decide(own, history)
    return out.select(
        doc_id_of().alias("doc_id"), "tag", doc_id_of("keep").alias("keep_id"), "group_size", "kept", "digest", "alike"
    )
