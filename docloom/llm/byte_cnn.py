"""A quality classifier: a convolutional network over bytes, in numpy.

Every text is read as UTF-8 bytes in chunks of ``CHUNK`` bytes that overlap by half and cover the
whole document. ``FILTERS`` learned filters of ``WIDTH`` bytes slide over it; a chunk keeps the
largest response of each (max-pooling, then a rectifier). The mean and the maximum over all chunks
go through a logistic layer to one probability that the label is 1.

Training (``train``) takes a bounded sample of labelled rows, and of each the whole text: the
``SAMPLE_DOCS`` labelled documents with the smallest hash of their id, less those of more than
``SAMPLE_BYTES`` UTF-8 bytes. Rows whose ``crc32(doc_id as text) mod 5`` is 0 are held out and never
seen. Labels, language, source and id are not inputs. Scoring reads every byte of every text, one
task per input split, without a shuffle.

Defined cases: a null text is empty; an empty text is one chunk of padding and gets the score that
follows; rows with equal ``doc_id`` are scored each, and the least of their texts is the one that
may be learned from; a null ``doc_id`` is not held out (it has no remainder) and has no label;
without any label in the sample every score is 0.5, and with one kind of label the network learns
that one; an empty table gives an empty result; columns other than ``doc_id``, ``text`` and the
label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batch, byte_column, doc_id_of, keyed_texts, map_arrow, slices, text_of

FILTERS, WIDTH, CHUNK = 8, 6, 256
BLOCK = CHUNK // 2
#: Labelled rows to learn from, and the longest text among them: together they bound the sample.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 1 << 16
STEPS, BATCH, RATE, DECAY = 400, 64, 0.01, 1e-5
FOLDS = 5


@dataclass
class Network:
    taps: np.ndarray  # (WIDTH, 256, FILTERS): a filter's weight for each byte at each of its places
    bias: np.ndarray  # (FILTERS,)
    mean: np.ndarray  # (FILTERS,)
    top: np.ndarray  # (FILTERS,)
    offset: float

    @classmethod
    def fresh(cls, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        taps = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        return cls(taps, np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    remainder = F.crc32(F.col(doc_id).cast("string")) % FOLDS
    return F.coalesce(remainder == 0, F.lit(False))


def all_chunks(raw: bytes) -> list[bytes]:
    """The chunks of a whole text, with the filters' overhang."""
    size = CHUNK + WIDTH - 1
    return [raw[s : s + size].ljust(size, b"\0") for s in range(0, max(1, len(raw) - BLOCK), BLOCK)]


def fit(chunks: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network:
    """``steps`` of Adam on the logistic loss. ``chunks`` (all documents' chunks, one after the other) is
    ``(n, CHUNK + WIDTH - 1)`` bytes, ``counts`` the chunks of each document."""
    net = Network.fresh(seed)
    if not len(labels):
        return net
    rng = np.random.default_rng(seed)
    net.offset = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    net.mean += rng.normal(0, 0.1, FILTERS).astype(np.float32)
    net.top += rng.normal(0, 0.1, FILTERS).astype(np.float32)
    firsts = np.cumsum(counts) - counts
    params = {"taps": net.taps, "bias": net.bias, "mean": net.mean, "top": net.top, "offset": np.array([net.offset], np.float32)}
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v = {k: np.zeros_like(x) for k, x in params.items()}
    step = 0
    while step < steps:
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            n = counts[docs]
            rows = np.repeat(firsts[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x = chunks[rows]
            response = sum(params["taps"][k][x[:, k : k + CHUNK]] for k in range(WIDTH))
            place = response.argmax(1)  # (chunks, FILTERS)
            peak = np.take_along_axis(response, place[:, None, :], 1)[:, 0] + params["bias"]
            pooled = np.maximum(peak, 0)
            heads = np.cumsum(n) - n
            mean = np.add.reduceat(pooled, heads) / n[:, None]
            top = np.maximum.reduceat(pooled, heads)
            z = mean @ params["mean"] + top @ params["top"] + params["offset"][0]
            error = ((1 / (1 + np.exp(-z)) - labels[docs]) / len(docs)).astype(np.float32)
            of = np.repeat(np.arange(len(docs)), n)
            back = error[of, None] * params["mean"] / n[of, None]
            back += error[of, None] * params["top"] * (pooled == top[of])
            back *= peak > 0
            grads = {
                "mean": error @ mean, "top": error @ top, "offset": np.array([error.sum()]),
                "bias": back.sum(0), "taps": np.zeros_like(params["taps"]),
            }
            filters = np.broadcast_to(np.arange(FILTERS), place.shape)
            for k in range(WIDTH):
                bytes_ = np.take_along_axis(x, place + k, 1)
                np.add.at(grads["taps"][k], (bytes_, filters), back)
            step += 1
            for key, p in params.items():
                g = grads[key] + DECAY * p
                m[key] = 0.9 * m[key] + 0.1 * g
                v[key] = 0.999 * v[key] + 0.001 * g * g
                p -= (RATE * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.offset = float(params["offset"][0])
    return net


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE_DOCS, steps: int = STEPS
) -> Network:
    """Fits the network to the whole texts of ``sample`` labelled rows, or of all when there are fewer."""
    own = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    known = own.where("id is not null and label is not null").where(~held_out("id"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    # a bounded list: it may be broadcast
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    found = docs.select(F.col("doc_id").alias("id"), text_of().alias("text")).join(F.broadcast(chosen), "id")
    found = found.where(F.octet_length("text") <= SAMPLE_BYTES)
    found = found.groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"))

    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("chunks", pa.binary()), ("n", pa.int32())])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            picked = [all_chunks(t.encode()) for t in part.column("text").to_pylist()]
            yield batch(schema, part.column("id").cast(pa.int64()), part.column("label"), [b"".join(p) for p in picked], [len(p) for p in picked])

    rows = map_arrow(found.select("id", "label", "text"), job, "id long, label int, chunks binary, n int").toArrow()
    rows = rows.sort_by([("id", "ascending"), ("chunks", "ascending")])
    flat = np.frombuffer(b"".join(rows.column("chunks").to_pylist()), np.uint8).reshape(-1, CHUNK + WIDTH - 1)
    return fit(flat, np.asarray(rows.column("n")), np.asarray(rows.column("label")).astype(np.float32), steps)


class Scorer:
    """The trained network over whole batches; two neighbouring bytes are looked up at once."""

    def __init__(self, net: Network):
        self.net = net
        pairs = net.taps.reshape(WIDTH // 2, 2, 256, FILTERS)
        low, high = pairs[:, 0], pairs[:, 1]
        self.pairs = (high[:, :, None, :] + low[:, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS)

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        # every text is followed by the filters' overhang of zeros, and has one byte at least
        room = np.maximum(lengths, 1) + WIDTH - 1
        begins = np.cumsum(room) - room
        padded = np.zeros(room.sum() + WIDTH, np.uint8)
        padded[np.arange(len(raw)) + np.repeat(begins - offsets[:-1], lengths)] = raw
        double = padded[:-1].astype(np.uint16) | padded[1:].astype(np.uint16) << np.uint16(8)
        size = int(room.sum())
        response = self.pairs[0][double[:size]]
        for k in range(1, WIDTH // 2):
            response += self.pairs[k][double[2 * k : 2 * k + size]]
        blocks = -(-np.maximum(lengths, 1) // BLOCK)
        of = np.repeat(np.arange(n), blocks)
        heads = np.cumsum(blocks) - blocks
        starts = np.repeat(begins - heads * BLOCK, blocks) + np.arange(len(of)) * BLOCK
        # the overhang after a text is no place of a filter: it gets a response of its own group
        ends = begins + np.maximum(lengths, 1)
        cuts = np.sort(np.concatenate([starts, ends]))
        peaks = np.maximum.reduceat(response, cuts, axis=0)[np.searchsorted(cuts, starts)]
        pooled = peaks.copy()  # a chunk is two neighbouring blocks; one block alone is a chunk
        inner = np.flatnonzero(of[1:] == of[:-1])
        pooled[inner] = np.maximum(peaks[inner], peaks[inner + 1])
        last = heads + blocks - 1
        chunk = np.ones(len(of), bool)
        chunk[last[blocks > 1]] = False
        pooled = np.maximum(pooled[chunk] + self.net.bias, 0)
        count = np.maximum(blocks - 1, 1)
        first = np.cumsum(count) - count
        mean = np.add.reduceat(pooled, first, axis=0) / count[:, None]
        top = np.maximum.reduceat(pooled, first, axis=0)
        z = mean @ self.net.mean + top @ self.net.top + self.net.offset
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def _scores(scorer: Scorer, text: pa.Array) -> np.ndarray:
    raw, offsets = byte_column(text)
    found = [np.zeros(0)]
    for i, j in slices(offsets):
        for k in range(i, j, 4096):
            cut = offsets[k : min(k + 4096, j) + 1]
            found.append(scorer.score(raw[cut[0] : cut[-1]], cut - cut[0]))
    return np.concatenate(found)


_SCORED = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("score", pa.float64())])


def _score(net: Network):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for part in batches:
            yield batch(_SCORED, part.column("doc"), part.column("tag"), _scores(scorer, part.column("text")))

    return job


def score(docs: DataFrame, net: Network) -> DataFrame:
    """``(doc_id, tag, score)`` of every row: the probability that its label is 1."""
    out = map_arrow(keyed_texts(docs), _score(net), "doc long, tag long, score double")
    return out.select(doc_id_of().alias("doc_id"), "tag", "score")


def accepted(docs: DataFrame, net: Network, cut: float) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``cut``; nothing is shuffled."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for part in batches:
            text = part.column(part.schema.get_field_index("text")).fill_null("")
            yield part.filter(pa.array(_scores(scorer, text) >= cut))

    return map_arrow(docs, job, docs.schema)
