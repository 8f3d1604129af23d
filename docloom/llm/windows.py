"""Windows of consecutive tokens that occur more than once, in a whole table of texts.

A suffix matters only through its first ``window`` tokens, so every window stands for the suffix
that starts with it. Sending each suffix with its tokens would multiply the text, so suffixes
travel in *runs*:

1. The key of a window is the least hash of the ``gram``-token pieces in it. Equal windows have
   equal keys, and neighbouring windows mostly share one, so a document falls into runs of windows
   with one key. A run carries its key, a hash of all its tokens and its place: about one record
   for every ``(window - gram) / 2`` tokens.
2. Records meet by key, packed into blocks. A key that occurs once ends here: none of its windows
   repeats. Of runs with equal tokens all but the first are repeats as a whole. Only where runs
   with one key differ, or where a run may repeat inside itself, are tokens needed: such runs are
   *asked* for. What was found goes, packed again, to the bucket of its document; there it becomes
   one row of the document, neighbouring repeats united.
3. The asked runs' tokens are cut from the texts and meet by key again; there the operator orders
   their suffixes by its own method and says which windows have an earlier copy.

A key with many different runs (a common phrase among differing texts) is found in a sample
beforehand. Its windows are dealt again, by the least hash of longer pieces: fewer of those lie
inside the phrase as a whole, and windows that do stay in runs that are equal in all texts. What is
still frequent with the longest pieces, a few windows on either side of the phrase, travels alone,
by the hash of the whole window, so that it spreads over all tasks. The sample decides this layout
only, never the result. Equal runs are combined inside each task before they are sent, so a text
with thousands of copies sends few records; of equal rows one is looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import (
    batch, byte_column, column_array, combined, keyed_texts, map_arrow, shuffle_partitions, slices, stored,
)
from docloom.llm.hashing import grams, mix, prime_hashes, sliding_min

#: Bytes of text looked at together, so that arrays stay in the cache.
SLICE = 1 << 17
#: Windows that one run may hold; a longer one (a periodic text) is cut into several.
MOST_IN_RUN = 4096
#: Records that a task gathers before it combines and sends them.
FLUSH = 1 << 20
#: One of so many documents is looked at for frequent keys; a key with so many different runs
#: there is frequent; at most so many keys of a length of pieces are kept (a list of 0.8 MB).
SAMPLE, FREQUENT, MOST_FREQUENT = 64, 16, 100_000
#: Tokens of asked runs that are ordered together.
REFINE_TOKENS = 4 << 20

RECORD = np.dtype([("key", "u8"), ("run", "u8"), ("doc", "i8"), ("tag", "i8"), ("start", "u4"), ("n", "u2"), ("loops", "u1")])
_SENT = "bucket int, block binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])
_MET_ARROW = pa.schema([("place", pa.int32()), ("block", pa.binary())])
_MET = "place int, block binary"
_FOUND = "doc long, tag long, asked array<struct<start: int, n: int, key: long>>, spans array<struct<start: int, n: int>>"
_TOKENS_ARROW = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("tokens", pa.binary())])
_SPANS_ARROW = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


@dataclass(frozen=True)
class Tokens:
    """How texts become tokens. ``split`` gives ``(exact, hashes, offsets)`` of a batch of texts:
    the tokens as they are compared, their hashes, and where each text's tokens start."""

    window: int
    gram: int
    split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    kind: str
    #: Whether a window's copy earlier in the same document counts.
    within: bool

    @property
    def pieces(self) -> list[int]:
        """Lengths of the pieces whose least hash is a key, each for the frequent keys before."""
        rest = self.window - self.gram
        return sorted({self.gram, self.window - rest // 2, self.window - rest // 6} - {self.window})


def _keys(tokens: Tokens, hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the least hash of its pieces, and whether that piece stands at its start."""
    gram = tokens.pieces[level]
    pieces = grams(hashes, gram)
    if level:
        pieces = mix(pieces + np.uint64(level))
    keys = sliding_min(pieces, tokens.window - gram + 1)
    return keys, pieces[: len(keys)] == keys


def _around(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the windows at ``at``, and the place of each window among them."""
    opens = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    n = np.diff(np.append(opens, len(at)))
    first = at[opens]
    sizes = n + window - 1
    begin = np.cumsum(sizes) - sizes
    near = np.arange(sizes.sum()) + np.repeat(first - begin, sizes)
    return near, at + np.repeat(begin - first, n)


def runs(tokens: Tokens, hashes: np.ndarray, offsets: np.ndarray, frequent: list[np.ndarray]):
    """``(row, start, n, key, run, loops)`` arrays: the runs of a batch, starts relative to rows.
    ``frequent`` has the frequent keys of each length of pieces."""
    window = tokens.window
    empty = np.zeros(0, np.int64)
    nothing = (empty,) * 3 + (empty.astype(np.uint64),) * 2 + (empty.astype(bool),)
    keys, at_start = _keys(tokens, hashes, 0)
    if not len(keys):
        return nothing
    lengths = np.diff(offsets)
    row_of = np.repeat(np.arange(len(lengths)), lengths)[: len(keys)]
    valid = np.arange(len(keys)) + window <= offsets[1:][row_of]
    single = np.zeros(len(keys), bool)
    for level, of_level in enumerate(frequent):
        hot = valid & np.isin(keys, of_level)
        if not hot.any():
            break
        at = np.flatnonzero(hot)
        near, place = _around(at, window)
        if level + 1 < len(tokens.pieces):
            longer, starting = _keys(tokens, hashes[near], level + 1)
            keys[at] = mix(mix(keys[at]) ^ longer[place])
            at_start[at] = starting[place]
        else:
            keys[at] = mix(grams(hashes[near], window)[place] + np.uint64(1))
            single = hot
    opens = valid & single
    opens[0] |= valid[0]
    opens[1:] |= valid[1:] & (~valid[:-1] | single[:-1] | (keys[1:] != keys[:-1]))
    starts = np.flatnonzero(opens)
    if not len(starts):
        return nothing
    run_of = np.cumsum(opens)[valid] - 1
    n = np.bincount(run_of, minlength=len(starts))
    if n.max() > MOST_IN_RUN:
        parts = -(-n // MOST_IN_RUN)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        place = (np.arange(parts.sum()) - first) * MOST_IN_RUN
        n = np.minimum(np.repeat(n, parts) - place, MOST_IN_RUN)
        starts = np.repeat(starts, parts) + place
    # the least piece stands at a window's start, and the run goes on past it: it has it twice
    before = np.concatenate([[0], np.cumsum(at_start)])
    loops = before[starts + n - 1] - before[starts] > 0
    run = prime_hashes(hashes, starts, starts + n + window - 1)
    row = row_of[starts]
    return row, starts - offsets[row], n, keys[starts], run, loops


def _records(tokens: Tokens, part: pa.RecordBatch, frequent: list[np.ndarray]) -> Iterator[np.ndarray]:
    raw, offsets = byte_column(part.column("text"))
    docs, tags = np.asarray(part.column("doc")), np.asarray(part.column("tag"))
    for i, j in slices(offsets, SLICE):
        cut = offsets[i : j + 1]
        _, hashes, offs = tokens.split(raw[cut[0] : cut[-1]], cut - cut[0])
        row, start, n, key, run, loops = runs(tokens, hashes, offs, frequent)
        out = np.empty(len(row), RECORD)
        out["key"], out["run"], out["doc"], out["tag"] = key, run, docs[i:j][row], tags[i:j][row]
        out["start"], out["n"], out["loops"] = start, n, loops
        yield out


def classes(tokens: Tokens, records: np.ndarray):
    """Sorts records, takes one of equal rows, and says which repeat an earlier equal run:
    ``(sorted, repeats)``."""
    order = np.lexsort((records["start"], records["tag"], records["doc"], records["run"], records["key"]))
    r = records[order]
    again = np.ones(len(r), bool)
    again[:1] = False
    for name in ("start", "doc", "tag", "run", "key"):
        again[1:] &= r[name][1:] == r[name][:-1]
    if again.any():
        r = r[~again]
    new = np.ones(len(r), bool)
    new[1:] = (r["key"][1:] != r["key"][:-1]) | (r["run"][1:] != r["run"][:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = r["doc"] > r["doc"][first]
    if tokens.within:  # rows that share a doc_id and a start are at the same place
        later |= r["start"] > r["start"][first]
    return r, later


def _pack(records: np.ndarray) -> bytes:
    """Columns one after the other, keys as differences, compressed."""
    key = records["key"].copy()
    key[1:] -= records["key"][:-1]
    docs, place = np.unique(np.stack([records["doc"], records["tag"]], 1), axis=0, return_inverse=True)
    parts = [key, records["run"], docs.astype("<i8"), place.ravel().astype("<u4"), records["start"], records["n"], records["loops"]]
    head = struct.pack("<II", len(records), len(docs))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(p).tobytes() for p in parts))


def _unpack(block: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, m = struct.unpack_from("<II", raw)
    at = 8
    out = np.empty(n, RECORD)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(raw, kind, count, at)
        at += got.nbytes
        return got

    out["key"] = np.cumsum(take("<u8", n), dtype=np.uint64)
    out["run"] = take("<u8", n)
    docs = take("<i8", 2 * m).reshape(m, 2)
    place = take("<u4", n)
    out["doc"], out["tag"] = docs[place, 0], docs[place, 1]
    out["start"], out["n"], out["loops"] = take("<u4", n), take("<u2", n), take("u1", n)
    return out


def _blocks(schema: pa.Schema, records: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One block for each bucket."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order].astype(np.int32)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    pairs = [(int(bucket[a]), _pack(records[a:b])) for a, b in zip(cuts, cuts[1:]) if b > a]
    for k in range(0, len(pairs), 256):
        yield batch(schema, *zip(*pairs[k : k + 256]))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blocks of one bucket after the other, from batches sorted by it."""
    held: list[bytes] = []
    last = None
    for part in batches:
        for bucket, block in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if held and bucket != last:
                yield held
                held = []
            held.append(block)
            last = bucket
    if held:
        yield held


def _send(tokens: Tokens, buckets: int, frequent: list[np.ndarray]):
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        records, later = classes(tokens, np.concatenate(held))
        # a run known to be a repeat needs no partners: it goes to the bucket of its document
        bucket = np.where(later, mix(records["doc"].astype(np.uint64)), mix(records["key"])) % np.uint64(buckets)
        records["loops"] |= later.astype(np.uint8) << 1
        yield from _blocks(_SENT_ARROW, records, bucket)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in batches:
            for records in _records(tokens, part, frequent):
                held.append(records)
                n += len(records)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return job


def _meet(tokens: Tokens, places: int):
    def found(blocks: list[bytes]) -> np.ndarray:
        """The runs that repeat, and those that are asked for (``loops`` is 1)."""
        records = np.concatenate([_unpack(b) for b in blocks])
        done = records["loops"] >= 2
        r, later = classes(tokens, records[~done])
        new_key = np.ones(len(r), bool)
        new_key[1:] = r["key"][1:] != r["key"][:-1]
        new_run = new_key.copy()
        new_run[1:] |= r["run"][1:] != r["run"][:-1]
        of = np.cumsum(new_key) - 1
        differ = np.bincount(of, weights=new_run) > 1
        # without ``within`` a run that loops cannot help itself
        asked = ~later & (differ[of] | ((r["loops"] > 0) & tokens.within))
        out = np.concatenate([records[done], r[later], r[asked]])
        out["loops"] = 0
        out["loops"][len(out) - np.count_nonzero(asked) :] = 1
        return out

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        records = np.concatenate(held)
        yield from _blocks(_MET_ARROW, records, mix(records["doc"].astype(np.uint64)) % np.uint64(places))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for blocks in _by_bucket(batches):
            held.append(found(blocks))
            n += len(held[-1])
            if n >= FLUSH:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return job


def united(group: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(group, start, n)`` of the spans that remain when those of a group that touch are one;
    spans come by group and start."""
    end = np.maximum.accumulate((group << 33) + start + n)
    opens = np.ones(len(group), bool)
    opens[1:] = (group << 33)[1:] + start[1:] > end[:-1]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(group)) - 1 if len(first) else first
    return group[first], start[first], end[last] - (group[first] << 33) - start[first]


def _gather():
    """One row for each document from what was found of it."""

    def lists(of: np.ndarray, docs: int, **columns: np.ndarray) -> pa.ListArray:
        offsets = np.searchsorted(of, np.arange(docs + 1)).astype(np.int32)
        kinds = {k: pa.int64() if k == "key" else pa.int32() for k in columns}
        values = [pa.array(v.astype(kinds[k].to_pandas_dtype()), kinds[k]) for k, v in columns.items()]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, list(columns)))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _by_bucket(batches):
            r = np.concatenate([_unpack(b) for b in blocks])
            r = r[np.lexsort((r["start"], r["tag"], r["doc"]))]
            new = np.ones(len(r), bool)
            new[1:] = (r["doc"][1:] != r["doc"][:-1]) | (r["tag"][1:] != r["tag"][:-1])
            of, first = np.cumsum(new) - 1, np.flatnonzero(new)
            wanted = r["loops"] == 1
            a = r[wanted]
            group, start, n = united(of[~wanted], r["start"][~wanted].astype(np.int64), r["n"][~wanted].astype(np.int64))
            columns = [
                pa.array(r["doc"][first]), pa.array(r["tag"][first]),
                lists(of[wanted], len(first), start=a["start"], n=a["n"], key=a["key"]),
                lists(group, len(first), start=start, n=n),
            ]
            whole = pa.RecordBatch.from_arrays(columns, ["doc", "tag", "asked", "spans"])
            for k in range(0, len(first), 1000):
                yield whole.slice(k, 1000)

    return job


def _count_keys(tokens: Tokens, frequent: list[np.ndarray]):
    schema = pa.schema([("key", pa.int64()), ("run", pa.int64())])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [np.stack([r["key"], r["run"]], 1) for r in _records(tokens, part, frequent)]
            if found:
                pairs = np.unique(np.concatenate(found), axis=0).view(np.int64)
                yield batch(schema, pairs[:, 0], pairs[:, 1])

    return job


def frequent_keys(texts: DataFrame, tokens: Tokens) -> list[np.ndarray]:
    """The frequent keys of each length of pieces, as far as there are any."""
    sample = texts.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
    frequent: list[np.ndarray] = []
    for _ in tokens.pieces:
        pairs = map_arrow(sample, _count_keys(tokens, frequent), "key long, run long").distinct()
        counts = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        rows = counts.where(F.col("rows") >= FREQUENT).orderBy(F.desc("rows"), "key").limit(MOST_FREQUENT).collect()
        if not rows:
            break
        frequent.append(np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64)))
    return frequent


def packed_texts(texts: DataFrame) -> DataFrame:
    """``(doc, tag, packed)``: compressed texts, for a shuffle of less than half their bytes."""
    schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("packed", pa.binary())])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for part in batches:
            raw, offsets = byte_column(part.column("text"))
            texts = [small.compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield batch(schema, part.column("doc"), part.column("tag"), texts)

    return map_arrow(texts, job, "doc long, tag long, packed binary")


def unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _cut(tokens: Tokens):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part in batches:
            docs, tags = part.column("doc").to_pylist(), part.column("tag").to_pylist()
            for i, packed in enumerate(part.column("packed").to_pylist()):
                if last == (docs[i], tags[i]):
                    continue  # equal rows come one after the other, and one of them will do
                last = (docs[i], tags[i])
                raw = np.frombuffer(unpacked(packed), np.uint8)
                exact, _, _ = tokens.split(raw, np.array([0, len(raw)]))
                asked = part.column("asked")[i].values
                start, n, key = (np.asarray(asked.field(k)) for k in ("start", "n", "key"))
                cut = [exact[a : a + b + tokens.window - 1].tobytes() for a, b in zip(start.tolist(), n.tolist())]
                yield batch(_TOKENS_ARROW, np.full(len(start), docs[i]), np.full(len(start), tags[i]), start, n, key, cut)

    return job


def flagged_spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Single windows as spans of consecutive windows."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    opens = np.ones(len(doc), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(doc)) - 1
    n = start[last] - start[first] + 1 if len(first) else start[:0]
    return batch(_SPANS_ARROW, doc[first], tag[first], start[first].astype(np.int32), n.astype(np.int32))


@dataclass
class Asked:
    """Asked runs of several keys. ``tokens`` holds all of them; suffix ``i`` is the window at
    ``at[i]``, of group ``group[i]``, at ``(doc[i], tag[i], start[i])`` in its text."""

    tokens: np.ndarray
    at: np.ndarray
    group: np.ndarray
    doc: np.ndarray
    tag: np.ndarray
    start: np.ndarray


def _asked(part: pa.Table, kind: str) -> Asked:
    raw, offsets = byte_column(column_array(part, "tokens"))
    exact = np.frombuffer(raw.tobytes(), kind)
    offsets = offsets // exact.dtype.itemsize
    key, n = np.asarray(part.column("key")), np.asarray(part.column("n")).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    doc, tag, start = (np.asarray(part.column(k)) for k in ("doc", "tag", "start"))
    return Asked(exact, offsets[:-1][of] + place, group[of], doc[of], tag[of], start[of].astype(np.int64) + place)


def _refine(tokens: Tokens, order: Callable[[Asked], np.ndarray]):
    size = np.dtype(tokens.kind).itemsize

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0

        def work(part: pa.Table) -> pa.RecordBatch:
            asked = _asked(part, tokens.kind)
            repeats = order(asked)
            return flagged_spans(asked.doc[repeats], asked.tag[repeats], asked.start[repeats])

        for part in combined(batches, 1):
            held.append(part)
            n += byte_column(column_array(part, "tokens"))[1][-1] // size
            if n < REFINE_TOKENS:
                continue
            whole = pa.concat_tables(held).combine_chunks()
            key = np.asarray(whole.column("key"))
            last = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if last:
                yield work(whole.slice(0, last))
            held, n = [whole.slice(last)], 0
        if held:
            whole = pa.concat_tables(held).combine_chunks()
            if whole.num_rows:
                yield work(whole)

    return job


def repeated_windows(docs: DataFrame, tokens: Tokens, order: Callable[[Asked], np.ndarray]) -> DataFrame:
    """``(doc, tag, spans)`` for each text with repeats: ``spans`` lists ``(start, n)``, ``n``
    consecutive windows from ``start`` on that have an earlier copy; spans may overlap.

    ``order`` is the operator's method: of asked runs it gives the indices of the suffixes whose
    window has an earlier copy.
    """
    spark = docs.sparkSession
    texts = keyed_texts(docs)
    parts = shuffle_partitions(spark)
    frequent = frequent_keys(texts, tokens)
    sent = map_arrow(texts, _send(tokens, 8 * parts, frequent), _SENT)
    met = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
    places = map_arrow(met, _meet(tokens, 2 * parts), _MET).repartition(parts, "place").sortWithinPartitions("place")
    found = stored(map_arrow(places, _gather(), _FOUND), "windows")

    asked = found.where(F.size("asked") > 0).select("doc", "tag", "asked")
    asked_texts = packed_texts(texts).join(asked.hint("merge"), ["doc", "tag"])
    runs_ = map_arrow(asked_texts, _cut(tokens), "doc long, tag long, start int, n int, key long, tokens binary")
    by_key = runs_.repartition(parts, "key").sortWithinPartitions("key")
    refined = map_arrow(by_key, _refine(tokens, order), "doc long, tag long, start int, n int")
    spans = found.select("doc", "tag", F.inline("spans")).unionByName(refined)
    return spans.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def covered(starts: np.ndarray, n: np.ndarray, window: int, length: int) -> np.ndarray:
    """A mask of the tokens that the windows of the spans cover."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n - 1 + window, -1)
    return np.cumsum(steps[:-1]) > 0
