"""Sequence packing as vector bin packing with a dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces of documents) and loss-bearing
tokens. ``pack_examples`` fills one sequence after the other. Of the waiting examples that fit in
all three, it places the one whose demand has the largest dot product with what the sequence has
left, both as shares of the limits: an example is drawn to the sequence that has most of what it
needs, so that no limit runs out while others stay unused. When none fits whole and examples may
be cut, one is cut so that it fills the sequence to the last token.

``pack`` does this for a table of documents. Documents are tokenised, cut into full sequences
while they last, and the pieces are dealt by a hash to groups of bounded documents and bytes,
each packed in one task: a few huge documents fill many groups. The last sequence of a group is cut where its length is a power of
two, which needs no padding.

Defined cases: a null text is empty and yields its end token only; every row is packed, rows with
equal ``doc_id`` too; an empty table gives an empty result; columns other than ``doc_id``,
``text`` and the loss column are ignored. Every token lies in exactly one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import (
    batch, byte_column, column_array, doc_id_of, grouped, keyed_texts, map_arrow, shuffle_partitions,
    slices, text_of,
)
from docloom.llm.tokenizing import encoder

#: Documents, and bytes of their texts, that are packed together. Sequences close within a group.
GROUP, GROUP_BYTES = 2048, 8 << 20
#: Bytes of text encoded at a time.
ENCODE_BYTES = 1 << 20


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


_PIECES = pa.schema([
    ("doc", pa.int64()), ("tag", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()),
    ("length", pa.int64()), ("loss", pa.int64()), ("ids", pa.binary()),
])
_PIECES_TYPE = "doc long, tag long, doc_tokens long, start long, length long, loss long, ids binary"


def id_bytes(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Ids, one list after the other, as binary values of four bytes an id."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * 4, out=offsets[1:])
    data = pa.py_buffer(np.ascontiguousarray(ids.astype("<u4", copy=False)))
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), data])


def _tokenise(path: str, end_id: int, limits: Limits):
    """Whole sequences of a document, and what is left of it."""
    step = min(limits.tokens, limits.loss)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in batches:
            raw, offsets = byte_column(part.column("text"))
            docs, tags, masked = (np.asarray(part.column(c)) for c in ("doc", "tag", "masked"))
            for i, j in slices(offsets, ENCODE_BYTES):
                cut = offsets[i : j + 1]
                ids, offs = enc.encode(raw[cut[0] : cut[-1]], cut - cut[0])
                ids = np.insert(ids, offs[1:], np.uint32(end_id))
                sizes = np.diff(offs) + 1
                pieces = -(-sizes // step)
                of = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * step
                length = np.minimum(sizes[of] - start, step)
                loss = np.where(masked[i:j][of], 0, length)
                yield batch(_PIECES, docs[i:j][of], tags[i:j][of], sizes[of], start, length, loss, id_bytes(ids, length))

    return job


def pack_examples(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool = True):
    """``(example, start, length, bin, offset)`` arrays: the pieces of ``n`` examples with so many
    tokens, of which the last ``loss`` bear loss, packed into bins. With ``cut`` an example may be
    split; its rest waits as an example of its own."""
    rest, rest_loss = tokens.astype(np.int64).copy(), loss.astype(np.int64).copy()
    done = np.zeros(len(tokens), np.int64)
    # an example that is a sequence of its own needs no weighing
    full = np.flatnonzero((rest == limits.tokens) & (rest_loss <= limits.loss))
    none = np.zeros(len(full), np.int64)
    whole = (full, none, rest[full], np.arange(len(full)), none)
    rest[full] = 0
    # examples by demand: those of equal demand are alike, so each demand is weighed once
    classes: dict[tuple[int, int], list[int]] = {}
    for e in np.argsort(-rest, kind="stable").tolist():
        if rest[e]:
            classes.setdefault((int(rest[e]), int(rest_loss[e])), []).append(e)
    demands = np.array(list(classes), np.float64).reshape(-1, 2)
    waiting = [classes[k][::-1] for k in classes]
    alive = np.ones(len(waiting), bool)
    scale = np.array([limits.tokens, limits.loss], np.float64)
    out: list[tuple[int, int, int, int, int]] = []
    bin_, left = len(full), int(sum(len(w) for w in waiting))

    def take(c: int) -> int:
        nonlocal left
        e = waiting[c].pop()
        left -= 1
        alive[c] = bool(waiting[c])
        return e

    def put_back(e: int) -> None:
        nonlocal demands, alive, left
        key = np.array([rest[e], rest_loss[e]], np.float64)
        same = np.flatnonzero((demands == key).all(1))
        if len(same):
            waiting[same[0]].append(e)
            alive[same[0]] = True
        else:
            demands, alive = np.vstack([demands, key]), np.append(alive, True)
            waiting.append([e])
        left += 1

    while left:
        room, segments, offset = scale.copy(), limits.segments, 0
        while left and segments and room[0] > 0:
            fits = alive & (demands <= room).all(1)
            if fits.any():
                # the last segment should fill what is left; before it, the heuristic decides
                score = np.where(fits, (demands / scale) @ (room / scale), -1.0)
                e = take(int(np.argmax(score)))
                n = int(rest[e])
            elif cut and room[1] > 0:
                e = take(int(np.flatnonzero(alive)[0]))
                bearing = int(max(0, rest_loss[e] - room[1]))
                free = int(rest[e] - rest_loss[e])
                n = int(min(room[0], rest[e] - bearing if bearing else rest[e], free + room[1]))
            else:
                break
            lost = int(max(0, n - (rest[e] - rest_loss[e])))
            out.append((e, int(done[e]), n, bin_, offset))
            done[e] += n
            rest[e] -= n
            rest_loss[e] -= lost
            room -= (n, lost)
            offset += n
            segments -= 1
            if rest[e]:
                put_back(e)
        bin_ += 1
    return tuple(np.concatenate([a, np.array(b, np.int64)]) for a, b in zip(whole, zip(*out) if out else ((),) * 5))


def split_at_powers(pieces, limits: Limits):
    """Cuts every bin that isn't full into bins whose lengths are powers of two."""
    example, start, length, bin_, offset = pieces
    used = np.bincount(bin_, weights=length).astype(np.int64) if len(bin_) else np.zeros(0, np.int64)
    short = np.flatnonzero((used < limits.tokens) & (used & (used - 1) != 0))
    if not len(short):
        return pieces
    out, new = [], len(used)
    chosen = np.isin(bin_, short)
    for b in short.tolist():
        own = np.flatnonzero(bin_ == b)
        edge, size = 0, 1 << (int(used[b]).bit_length() - 1)
        at = b
        while size:
            if int(used[b]) & size:
                for k in own.tolist():  # what of each piece lies in [edge, edge + size)
                    lo, hi = max(edge, int(offset[k])), min(edge + size, int(offset[k] + length[k]))
                    if lo < hi:
                        out.append((example[k], start[k] + lo - offset[k], hi - lo, at, lo - edge))
                edge += size
                at, new = new, new + 1
            size >>= 1
    kept = tuple(x[~chosen] for x in pieces)
    return tuple(np.concatenate([a, np.array(b, np.int64)]) for a, b in zip(kept, zip(*out)))


_PLACED = pa.schema([
    ("doc", pa.int64()), ("tag", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()),
    ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
_PLACED_TYPE = "doc long, tag long, doc_tokens long, start long, length long, sequence_id long, offset long, ids binary"


def _pack_group(limits: Limits, cut: bool):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["group"]):
            doc, tag, doc_tokens, start, length, loss = (
                np.asarray(group.column(c)) for c in ("doc", "tag", "doc_tokens", "start", "length", "loss")
            )
            pieces = pack_examples(length, loss, limits, cut)
            if cut:
                pieces = split_at_powers(pieces, limits)
            example, at, n, bin_, offset = pieces
            raw, begins = byte_column(column_array(group, "ids"))
            ids = np.ascontiguousarray(raw).view("<u4")
            begins = (begins[:-1] // 4)[example] + at
            flat = np.concatenate([ids[:0], *(ids[p : p + k] for p, k in zip(begins.tolist(), n.tolist()))])
            sequence = (int(group.column("group")[0].as_py()) << 32) + bin_
            yield batch(
                _PLACED, doc[example], tag[example], doc_tokens[example], start[example] + at, n,
                sequence, offset, id_bytes(flat, n),
            )

    return job


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), cut: bool = True,
    masked: Column | None = None, group: int = GROUP,
) -> DataFrame:
    """One row per piece: ``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)``; ``ids``
    are its token ids as little-endian unsigned 32-bit integers, in one binary value. ``tokenizer`` is a path that every worker can open. ``masked`` marks documents whose tokens
    bear no loss (context of instruction data). Without ``cut`` a remainder is never split."""
    spark = docs.sparkSession
    flag = F.lit(False) if masked is None else F.coalesce(masked, F.lit(False))
    texts = keyed_texts(docs, flag.alias("masked"))
    pieces = map_arrow(texts, _tokenise(tokenizer, end_id, limits), _PIECES_TYPE)
    size = F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0))
    rows, bytes_ = docs.agg(F.count(F.lit(1)), size).first()
    groups = max(1, -(-rows // group), -(-bytes_ // GROUP_BYTES))  # a token has a byte at least
    # by piece, so that a very long document is spread as well
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc", "tag", "start"), F.lit(groups)).cast("long"))
    dealt = dealt.repartition(max(1, min(groups, 4 * shuffle_partitions(spark))), "group").sortWithinPartitions("group", "doc", "tag", "start")
    placed = map_arrow(dealt, _pack_group(limits, cut), _PLACED_TYPE)
    return placed.select(
        doc_id_of().alias("doc_id"), "start", "length", "doc_tokens", "sequence_id", "offset", "ids"
    )
