"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, scored from sorted hash arrays.

**Counting.** Tasks read texts, combine equal n-grams of some million tokens and send each with its
count to the bucket of its hash, packed. One job per level, from ``order`` down to 1, then works
bucket by bucket: equal n-grams are added up, the bucket's sorted array is written to the shared
folder, and what the next lower level needs is sent on, added up beforehand: for the n-gram without
its first word that one more word stands before it (its continuation count), for the n-gram without
its last word what follows it. Buckets are ranges of a hash of the whole n-gram, so a frequent word
or word pair spreads over all of them; nothing but one row of sums per bucket reaches the driver.

**Arrays.** A bucket's file holds the sorted 64-bit hashes of its n-grams and their adjusted counts,
below ``order`` also what follows each n-gram: the sum of adjusted counts and how many n-grams have
1, 2 and more. Probabilities are computed from these at lookup, with the discounts of the level.
Workers map the files into memory, look up the sorted distinct hashes of a slice of text bucket by
bucket, and so touch only pages that the slice needs; a worker's map is no copy. Files of a store
that cannot be mapped are read bucket by bucket.

**Model.** ``p(w|c) = (max(a(cw) - D, 0) + (D1 N1 + D2 N2 + D3 N3) p(w|c')) / sum a(c.)``: ``a`` is
the count at the highest level and for n-grams that begin a text, else the number of different words
before the n-gram; the discounts follow from how many n-grams have ``a`` of 1 to 4; ``c'`` is ``c``
without its first word. The lowest level interpolates with one part in ``V + 1``, so probabilities of all
known words and one unknown add up to 1. A text is its words with A-Z lower-cased, then an end.

Defined cases: a null text is empty and scores its end; a null ``doc_id`` is learned from; every
repeated row is counted and scored; other columns are left out; with nothing to learn from every
token has probability 1 (``V`` is 0); an empty table gives no rows. Words are told apart by 64-bit
hashes of their bytes, n-grams by 64-bit hashes of those: two of a billion n-grams share one with a
chance of 3 %. A text is held whole in one task.
"""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batch, byte_column, map_arrow, shuffle_partitions, slices, stored, text_of
from docloom.llm.files import new_file, open_file
from docloom.llm.hashing import mix
from docloom.llm.words import BLANK, distinct_words, word_spans
from docloom.session import new_table_path

#: Words of an n-gram.
ORDER = 2
#: Rows whose remainder is ``HELD_FOLD`` are not learned from.
FOLDS, HELD_FOLD = 7, 2
#: Tokens that a task combines before it sends their n-grams.
FLUSH = 3 << 20
#: Maps of files that a worker keeps open.
OPEN_FILES = 512

#: No word holds a blank.
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(mark)) for mark in (b" begin", b" end"))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: What is known of an n-gram: its count, the different words before it, and of the n-grams that
#: go on from it the sum of adjusted counts and how many have 1, 2 and more.
FIELDS = ("raw", "before", "total", "n1", "n2", "n3")
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.binary()), ("sums", pa.list_(pa.int64()))])
_SENT_TYPE = "bucket int, block binary, sums array<bigint>"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_FOLD, F.lit(False))


# -- tokens and n-grams ------------------------------------------------------------------------


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts, and where each text's tokens start."""
    raw = _LOWER[raw]
    starts, ends, first = word_spans(raw, offsets, BLANK)
    ids, words = distinct_words(raw, starts, ends)
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    rows = len(offsets) - 1
    tokens = np.empty(len(starts) + rows, np.uint64)
    tokens[first[1:] + np.arange(rows)] = END
    row_of = np.repeat(np.arange(rows), np.diff(first))
    tokens[np.arange(len(starts)) + row_of] = known[ids]
    return tokens, first[:-1] + np.arange(rows)


def columns(tokens: np.ndarray, begins: np.ndarray, order: int) -> list[np.ndarray]:
    """The words of the n-gram that ends at each token, the first word first."""
    out = [tokens]
    for _ in range(order - 1):
        before = np.empty_like(tokens)
        before[1:] = out[0][:-1]
        before[begins] = BEGIN
        out.insert(0, before)
    return out


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    h = mix(words[0] + _FACTOR)
    for w in words[1:]:
        h = mix(h * _FACTOR + w)
    return h


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so the files of a level are sorted one after the other, too."""
    return ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


@dataclass
class Grams:
    """Distinct n-grams sorted by hash, and what is known of each."""

    hashes: np.ndarray
    words: list[np.ndarray]
    known: dict[str, np.ndarray]

    @classmethod
    def summed(cls, words: list[np.ndarray], known: dict[str, np.ndarray]) -> Grams:
        h = gram_hash(words)
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        at = order[first]
        sums = {k: np.add.reduceat(v[order], first) if len(h) else v[:0] for k, v in known.items()}
        return cls(h[first], [w[at] for w in words], sums)

    def field(self, name: str) -> np.ndarray:
        return self.known[name] if name in self.known else np.zeros(len(self.hashes), np.int64)

    @staticmethod
    def joined(parts: list[Grams], order: int) -> Grams:
        words = [np.concatenate([p.words[i] for p in parts]) for i in range(order)]
        names = [f for f in FIELDS if any(f in p.known for p in parts)]
        return Grams.summed(words, {f: np.concatenate([p.field(f) for p in parts]) for f in names})

    def adjusted(self, top: bool) -> np.ndarray:
        """The counts that the model works with."""
        if top:
            return self.field("raw")
        return np.where(self.words[0] == BEGIN, self.field("raw"), self.field("before")) if len(self.words) > 1 else self.field("before")


# -- records on their way ----------------------------------------------------------------------


def _narrow(values: np.ndarray) -> np.ndarray:
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _write(arrays: list[np.ndarray]) -> bytes:
    """A head and the arrays, each from a multiple of eight bytes on, as maps are searched in place."""
    head = struct.pack("<Q", len(arrays)) + b"".join(struct.pack("<QQ", a.itemsize, len(a)) for a in arrays)
    return head + b"".join(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8) for a in arrays)


def _read(data) -> list[np.ndarray]:
    n = struct.unpack_from("<Q", data)[0]
    heads = [struct.unpack_from("<QQ", data, 8 + 16 * i) for i in range(n)]
    at, out = 8 + 16 * n, []
    for size, length in heads:
        out.append(np.frombuffer(data, f"<u{size}", length, at))
        at += -(-size * length // 8) * 8
    return out


def pack(grams: Grams, rows: slice) -> bytes:
    """Words as places in a list of the distinct ones, sorted by the first word."""
    words = [w[rows] for w in grams.words]
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    place = place.reshape(len(words), -1)
    order = np.argsort(place[0].astype(np.uint16) if len(distinct) <= 1 << 16 else place[0], kind="stable")
    names = [f for f in FIELDS if f in grams.known]
    parts = [np.array([FIELDS.index(f) for f in names], np.uint8), distinct]
    head = place[0][order]
    parts.append(_narrow(np.diff(head, prepend=0)))
    parts += [_narrow(p[order]) for p in place[1:]]
    parts += [_narrow(grams.known[f][rows][order]) for f in names]
    return zstandard.ZstdCompressor(level=1).compress(_write(parts))


def unpack(block: bytes, order: int) -> Grams:
    parts = _read(zstandard.ZstdDecompressor().decompress(block))
    distinct = parts[1]
    places = [np.cumsum(parts[2].astype(np.int64)), *parts[3 : 2 + order]]
    known = {FIELDS[i]: v.astype(np.int64) for i, v in zip(parts[0].tolist(), parts[2 + order :])}
    return Grams(np.zeros(0, np.uint64), [distinct[p] for p in places], known)


def _blocks(grams: Grams, buckets: int) -> Iterator[pa.RecordBatch]:
    bucket = bucket_of(grams.hashes, buckets)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch(_SENT, [int(bucket[a])], [pack(grams, slice(a, b))], [None])


def _count(order: int, buckets: int):
    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        words = [np.concatenate([h[i] for h in held]) for i in range(order)]
        yield from _blocks(Grams.summed(words, {"raw": np.ones(len(words[0]), np.int64)}), buckets)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in batches:
            raw, offsets = byte_column(part.column("text"))
            for i, j in slices(offsets):
                cut = offsets[i : j + 1]
                tokens, begins = tokens_of(raw[cut[0] : cut[-1]], cut - cut[0])
                held.append(columns(tokens, begins, order))
                n += len(tokens)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return job


def below(grams: Grams, adjusted: np.ndarray) -> Grams:
    """What n-grams say about the shorter ones inside them, added up."""
    real = adjusted > 0
    words, a = [w[real] for w in grams.words], adjusted[real]
    ones = np.ones(len(a), np.int64)
    after = Grams.summed(words[1:], {"raw": grams.field("raw")[real], "before": ones})
    classes = {"n1": a == 1, "n2": a == 2, "n3": a > 2}
    ahead = Grams.summed(words[:-1], {"total": a} | {k: v.astype(np.int64) for k, v in classes.items()})
    return Grams.joined([after, ahead], len(words) - 1)


def _level(level: int, order: int, buckets: int, folder: str):
    """One bucket of one level at a time, from rows sorted by bucket."""

    def done(bucket: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        grams = Grams.joined([unpack(b, level) for b in blocks], level)
        a = grams.adjusted(level == order)
        sums = [level, bucket, int((a > 0).sum()), *(int((a == k).sum()) for k in (1, 2, 3, 4)), int((a > 2).sum()), int(a.sum())]
        sums.append(int(grams.field("raw").sum()))
        arrays = [grams.hashes, a.astype(np.uint32) if len(a) and a.max() < 1 << 32 else a.astype(np.uint64)]
        if level == 1:
            arrays.append(grams.field("raw").astype(np.uint64))
        if level < order:
            arrays += [grams.field("total").astype(np.uint64), *(grams.field(f).astype(np.uint32) for f in ("n1", "n2", "n3"))]
        with new_file(folder, file_name(level, bucket)) as out:
            out.write(_write(arrays))
        yield batch(_SENT, [bucket], [None], [sums])
        if level > 1:
            yield from _blocks(below(grams, a), buckets)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None
        for part in batches:
            if part.num_rows == 0:
                continue
            for bucket, block, sums in zip(*(part.column(k).to_pylist() for k in ("bucket", "block", "sums"))):
                if sums is not None:  # of a higher level, on the way to the driver
                    yield batch(_SENT, [bucket], [None], [sums])
                    continue
                if held and bucket != last:
                    yield from done(last, held)
                    held = []
                held.append(block)
                last = bucket
        if held:
            yield from done(last, held)

    return job


def file_name(level: int, bucket: int) -> str:
    return f"level{level}-{bucket:06d}.grams"


# -- model -------------------------------------------------------------------------------------


@dataclass
class Level:
    #: Discounts of counts 1, 2 and more.
    discounts: tuple[float, float, float]
    #: Buckets that have a file.
    buckets: np.ndarray = field(repr=False)


@dataclass
class Model:
    folder: str
    order: int
    n_buckets: int
    levels: list[Level]
    #: Tokens learned from, and different ones among them.
    tokens: int
    types: int
    #: At the lowest level: sum of adjusted counts, n-grams with 1, 2 and more.
    lowest: tuple[int, int, int, int]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """From how many n-grams have counts 1 to 4; fixed values where there are too few to tell."""
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < x <= k for x, k in zip(d, (1, 2, 3))):
            return d
    return (0.5, 1.0, 1.5)


def train(docs: DataFrame, order: int = ORDER, folder: str | None = None) -> Model:
    """The model of all rows of ``docs``. Its files stay in ``folder``."""
    spark = docs.sparkSession
    folder = folder or new_table_path(spark, "ngrams")
    buckets = shuffle_partitions(spark)
    rows = map_arrow(docs.select(text_of().alias("text")), _count(order, buckets), _SENT_TYPE)
    for level in range(order, 0, -1):
        rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")
        rows = map_arrow(rows, _level(level, order, buckets, folder), _SENT_TYPE)
    sums = stored(rows.select("sums"), "ngram-sums")
    names = ["level", "bucket", "grams", "n1", "n2", "n3", "n4", "n_more", "adjusted", "raw"]
    sums = sums.select(*(F.col("sums")[i].alias(k) for i, k in enumerate(names)))
    totals = [F.sum(k).alias(k) for k in names[2:]]
    by_level = {r["level"]: r for r in sums.groupBy("level").agg(F.collect_set("bucket").alias("buckets"), *totals).collect()}
    levels = []
    for level in range(1, order + 1):
        r = by_level.get(level)
        counts = [r[k] for k in ("n1", "n2", "n3", "n4")] if r else [0] * 4
        levels.append(Level(discounts(*counts), np.array(sorted(r["buckets"]) if r else [], np.int64)))
    low = by_level.get(1)
    lowest = (low["adjusted"], low["n1"], low["n2"], low["n_more"]) if low else (0, 0, 0, 0)
    return Model(folder, order, buckets, levels, low["raw"] if low else 0, low["grams"] if low else 0, lowest)


class Arrays:
    """The files of a model in a worker."""

    def __init__(self, model: Model):
        self.model = model
        self.open: OrderedDict[tuple[int, int], list[np.ndarray]] = OrderedDict()

    def file(self, level: int, bucket: int) -> list[np.ndarray]:
        key = (level, bucket)
        if key not in self.open:
            name = file_name(level, bucket)
            where = urlparse(self.model.folder)
            if where.scheme in ("", "file"):
                data = np.memmap(f"{where.path}/{name}", np.uint8, "r")
            else:
                with open_file(self.model.folder, name) as f:
                    data = f.read()
            self.open[key] = _read(data)
            while len(self.open) > OPEN_FILES:
                self.open.popitem(last=False)
        self.open.move_to_end(key)
        return self.open[key]

    def look_up(self, level: int, grams: np.ndarray) -> list[np.ndarray]:
        """What the files know of n-grams, zeros for those they lack: a row per field."""
        wanted, place = np.unique(grams, return_inverse=True)
        width = 1 if level == self.model.order else 5
        width += level == 1
        out = [np.zeros(len(wanted), np.int64) for _ in range(width)]
        bucket = bucket_of(wanted, self.model.n_buckets)
        there = self.model.levels[level - 1].buckets
        for b in np.intersect1d(bucket, there).tolist():
            i, j = np.searchsorted(bucket, [b, b + 1])
            hashes, *known = self.file(level, b)
            at = np.minimum(np.searchsorted(hashes, wanted[i:j]), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == wanted[i:j])
            for o, k in zip(out, known):
                o[i + hit] = k[at[hit]]
        return [o[place] for o in out]


def probabilities(arrays: Arrays, tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(p, count)`` of each token: its probability after the words before it, its count."""
    model = arrays.model
    words = columns(tokens, begins, model.order)

    def discounted(level: int, a: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *model.levels[level - 1].discounts])
        return np.maximum(a - d[np.minimum(a, 3)], 0)

    total, *classes = model.lowest
    a, raw = arrays.look_up(1, gram_hash(words[-1:]))[:2]
    spare = float(np.dot(classes, model.levels[0].discounts))
    p = (discounted(1, a) + spare / (model.types + 1)) / total if total else np.full(len(a), 1 / (model.types + 1))
    for level in range(2, model.order + 1):
        total, *classes = arrays.look_up(level - 1, gram_hash(words[-level:-1]))[-4:]
        a = arrays.look_up(level, gram_hash(words[-level:]))[0]
        spare = np.dot(model.levels[level - 1].discounts, np.stack(classes))
        p = np.where(total > 0, (discounted(level, a) + spare * p) / np.maximum(total, 1), p)
    return p, raw


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORED_TYPE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(model: Model):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)
        for part in batches:
            raw, offsets = byte_column(part.column("text"))
            for i, j in slices(offsets):
                cut = offsets[i : j + 1]
                tokens, begins = tokens_of(raw[cut[0] : cut[-1]], cut - cut[0])
                p, count = probabilities(arrays, tokens, begins)
                base = np.log10((count + 1) / (model.tokens + model.types + 1))
                yield batch(
                    _SCORED, part.column("doc_id").slice(i, j - i), part.column("held_out").slice(i, j - i),
                    np.diff(np.append(begins, len(tokens))), np.add.reduceat((count > 0).astype(np.int64), begins),
                    np.add.reduceat(base, begins), np.add.reduceat(np.log10(p), begins),
                )

    return job


def score(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of ``docs`` its tokens, how many the model has seen, ``score``: the log10
    probability of the text, ``base_score``: that of single words, and its perplexity."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), held_out().alias("held_out"))
    scored = map_arrow(rows, _score(model), _SCORED_TYPE)
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long")).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    )
