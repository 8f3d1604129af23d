"""Repeated byte strings across all texts, by a depth-limited radix sort of suffixes.

``remove_repeats`` takes every whole text as UTF-8 bytes and removes each byte that lies in a
``threshold``-byte string with an earlier start: a smaller ``doc_id``, or an earlier place in the
same document. Strings are judged on the input, never cross documents and may overlap.

Suffixes are dealt by :mod:`docloom.llm.windows`. Those that may repeat are then ordered through
their first ``threshold`` bytes only, by most-significant-digit passes of eight bytes: a pass
splits every group by its next digit, and a suffix alone in its group is done. The groups left
after the last digit are exactly the repeated strings.

Defined cases: a null text is empty; texts below the threshold keep all bytes; an empty table
gives an empty result; columns other than ``doc_id`` and ``text`` are ignored, whatever their
names. A null ``doc_id`` sorts first. Rows that share a ``doc_id`` are at the same place in the
order, so neither makes the other a repeat at the same start; each row gives one result row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batch, doc_id_of, keyed_texts, list_array, map_arrow
from docloom.llm.hashing import byte_tokens
from docloom.llm.windows import Asked, Tokens, covered, packed_texts, repeated_windows, unpacked

THRESHOLD = 100
DIGIT = 8

_KEPT = pa.schema([
    ("doc", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int32())),
    ("ends", pa.list_(pa.int32())), ("kept", pa.binary()),
])
_KEPT_TYPE = "doc long, n_bytes long, starts array<int>, ends array<int>, kept binary"


def radix_groups(tokens: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that are equal through ``depth`` bytes: ``(suffixes, group)`` of those that have
    an equal one in their starting group, in group order. Every suffix has ``depth`` bytes."""
    padded = np.concatenate([tokens, np.zeros(DIGIT, np.uint8)])
    digits = np.ndarray((len(tokens) + 1,), ">u8", padded.data, strides=(1,))
    left = np.arange(len(at))
    for d in range(0, depth, DIGIT):
        digit = digits[at[left] + d].astype(np.uint64)
        if depth - d < DIGIT:
            digit >>= np.uint64(8 * (DIGIT - depth + d))
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        new = np.ones(len(left), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        of = np.cumsum(new) - 1
        several = np.bincount(of, minlength=1)[of] > 1 if len(of) else new
        left, group = left[several], of[several]
    return left, group


def _repeats(threshold: int):
    def order(asked: Asked) -> np.ndarray:
        left, group = radix_groups(asked.tokens, asked.at, asked.group, threshold)
        by_place = np.lexsort((asked.start[left], asked.doc[left], group))
        left, group = left[by_place], group[by_place]
        new = np.ones(len(left), bool)
        new[1:] = group[1:] != group[:-1]
        first = left[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(left) else left
        later = (asked.doc[left] > asked.doc[first]) | (asked.start[left] > asked.start[first])
        return left[later]

    return order


def _as_bytes(raw: np.ndarray, offsets: np.ndarray):
    return raw, byte_tokens(raw), offsets


def _remove(threshold: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sizes, counts, starts, ends, kept = [], [], [], [], []
            spans = part.column("spans")
            for i, packed in enumerate(part.column("packed").to_pylist()):
                raw = unpacked(packed)
                sizes.append(len(raw))
                own = spans[i].values if spans[i].is_valid else None
                if own is None or not len(own):
                    counts.append(0)
                    kept.append(raw)
                    continue
                bytes_ = np.frombuffer(raw, np.uint8)
                mask = covered(np.asarray(own.field("start")), np.asarray(own.field("n")), threshold, len(raw))
                edges = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
                starts.append(np.flatnonzero(edges == 1))
                ends.append(np.flatnonzero(edges == -1))
                counts.append(len(starts[-1]))
                kept.append(bytes_[~mask].tobytes())
            flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends)]
            lists = [list_array(x.astype(np.int32), np.array(counts), pa.int32()) for x in flat]
            yield batch(_KEPT, part.column("doc"), sizes, *lists, kept)

    return job


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, n_bytes, spans array<struct<start, end>>, kept binary)``: what is removed of
    each text, as maximal byte ranges, and the bytes that stay."""
    tokens = Tokens(threshold, max(1, min(32, threshold // 3)), _as_bytes, "u1", within=True)
    spans = repeated_windows(docs, tokens, _repeats(threshold))
    texts = packed_texts(keyed_texts(docs)).join(spans, ["doc", "tag"], "left")
    out = map_arrow(texts, _remove(threshold), _KEPT_TYPE)
    ranges = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    return out.select(doc_id_of().alias("doc_id"), "n_bytes", ranges.alias("spans"), "kept")
