"""Repeated word sequences across documents, by prefix-partitioned suffix trees.

``remove_repeats`` splits every whole text into words (runs of bytes other than blank, tab, line
feed, vertical tab, form feed and carriage return) and removes each word that lies in a window of
``threshold`` words which also starts in a document with a smaller ``doc_id``. Windows are judged
on the input and never cross documents.

Suffixes are dealt by :mod:`docloom.llm.windows`. In a task, prefixes of variable length split
them further: a prefix that too many suffixes share grows by a word until its group fits in
memory. Each group's suffix tree is built from the top: a node's edge runs as far as all its
suffixes agree, then they part by their next word. Internal nodes at ``threshold`` words are the
repeats; the smallest ``doc_id`` below such a node is where it counts as original.

Defined cases: a null text has no words; texts below the threshold keep all words; an empty table
gives an empty result; columns other than ``doc_id`` and ``text`` are ignored, whatever their
names. A null ``doc_id`` sorts first. Rows that share a ``doc_id`` are one document for the order,
so neither makes the other a repeat; each row gives one result row. Words are compared by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batch, byte_column, doc_id_of, keyed_texts, list_array, map_arrow, slices
from docloom.llm.windows import Asked, Tokens, covered, packed_texts, repeated_windows, unpacked
from docloom.llm.words import BLANK, word_ids, word_spans

THRESHOLD = 50
#: Suffixes of which subtrees are built at a time.
MEMORY_SUFFIXES = 1 << 19
#: Bytes of packed texts whose words are cut at a time.
CUT_BYTES = 1 << 20

_KEPT = pa.schema([
    ("doc", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())),
    ("ends", pa.list_(pa.int32())), ("kept", pa.binary()),
])
_KEPT_TYPE = "doc long, n_words long, starts array<int>, ends array<int>, kept binary"


def _parted(group: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, group)``: suffixes parted by a word, in group order."""
    order = np.lexsort((word, group))
    g, w = group[order], word[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
    return order, np.cumsum(new) - 1


def prefix_groups(tokens: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int, most: int):
    """Splits suffixes by prefixes as long as it takes: ``(suffixes, group, prefix length)`` with
    at most ``most`` suffixes a group, unless their first ``depth`` words are all equal. Groups of
    one are left out: a single suffix has no internal node."""
    left, length = np.arange(len(at)), 0
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    base = 0
    while len(left):
        size = np.bincount(group)[group]
        ready = (size <= most) | (length >= depth)
        keep = ready & (size > 1)
        if keep.any():
            _, own = np.unique(group[keep], return_inverse=True)
            done.append((left[keep], own + base, np.full(keep.sum(), length)))
            base += own.max() + 1
        left, group = left[~ready], group[~ready]
        if len(left):
            order, group = _parted(group, tokens[at[left] + length])
            left = left[order]
            length += 1
    if not done:
        return left, left, left
    return tuple(np.concatenate(x) for x in zip(*done))


def deep_nodes(tokens: np.ndarray, at: np.ndarray, group: np.ndarray, reach: np.ndarray, depth: int):
    """Builds the subtrees of several groups side by side: ``(suffixes, node)`` below the internal
    nodes that are ``depth`` words deep. ``reach`` is how many words of a group's suffixes are
    known to agree."""
    left = np.argsort(group, kind="stable")
    group, reach = group[left], reach[left]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    base = 0
    while len(left):
        new = np.ones(len(left), bool)
        new[1:] = group[1:] != group[:-1]
        heads = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        # the edge: how far every suffix goes along with the first of its node
        agree = np.full(len(left), depth)
        alive = np.flatnonzero(reach < depth)
        word = reach[alive].copy()
        ref, own = at[left[heads[of[alive]]]], at[left[alive]]
        while len(alive):
            same = tokens[own + word] == tokens[ref + word]
            agree[alive[~same]] = word[~same]
            word += 1
            go = same & (word < depth)
            alive, word, ref, own = alive[go], word[go], ref[go], own[go]
        edge = np.minimum.reduceat(agree, heads)[of]
        deep = edge >= depth
        if deep.any():
            _, node = np.unique(group[deep], return_inverse=True)
            out.append((left[deep], node + base))
            base += node.max() + 1
        left, group, edge = left[~deep], of[~deep], edge[~deep]
        if not len(left):
            break
        order, child = _parted(group, tokens[at[left] + edge])
        left, edge = left[order], edge[order]
        inner = np.bincount(child)[child] > 1
        left, group, reach = left[inner], child[inner], edge[inner] + 1
    if not out:
        return left[:0], left[:0]
    return tuple(np.concatenate(x) for x in zip(*out))


def _repeats(threshold: int, most: int):
    def order(asked: Asked) -> np.ndarray:
        suffixes, group, reach = prefix_groups(asked.tokens, asked.at, asked.group, threshold, most)
        found = []
        # whole groups, as many at a time as fit
        place = np.argsort(group, kind="stable")
        suffixes, group, reach = suffixes[place], group[place], reach[place]
        begin = 0
        while begin < len(suffixes):
            end = int(np.searchsorted(group, group[min(begin + most, len(group)) - 1], side="right"))
            s = suffixes[begin:end]
            below, node = deep_nodes(asked.tokens, asked.at[s], group[begin:end], reach[begin:end], threshold)
            below = s[below]
            least = np.full(node.max() + 1 if len(node) else 0, np.iinfo(np.int64).max)
            np.minimum.at(least, node, asked.doc[below])
            found.append(below[asked.doc[below] > least[node]])
            begin = end
        return np.concatenate([np.zeros(0, np.int64), *found])

    return order


def _as_words(raw: np.ndarray, offsets: np.ndarray):
    starts, ends, first = word_spans(raw, offsets, BLANK)
    hashes = word_ids(raw, starts, ends)
    return hashes, hashes, first


def _remove(threshold: int):
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            _, offsets = byte_column(part.column("packed"))
            for i, j in slices(offsets, CUT_BYTES):
                yield part.slice(i, j - i)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few(batches):
            sizes, counts, cut_starts, cut_ends, kept = [], [], [], [], []
            spans = part.column("spans")
            for i, packed in enumerate(part.column("packed").to_pylist()):
                text = unpacked(packed)
                words = text.split()
                sizes.append(len(words))
                own = spans[i].values if spans[i].is_valid else None
                if own is None or not len(own):
                    counts.append(0)
                    kept.append(b" ".join(words))
                    continue
                mask = covered(np.asarray(own.field("start")), np.asarray(own.field("n")), threshold, len(words))
                edges = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
                cut_starts.append(np.flatnonzero(edges == 1))
                cut_ends.append(np.flatnonzero(edges == -1))
                counts.append(len(cut_starts[-1]))
                kept.append(b" ".join([words[k] for k in np.flatnonzero(~mask).tolist()]))
            flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (cut_starts, cut_ends)]
            lists = [list_array(x.astype(np.int32), np.array(counts), pa.int32()) for x in flat]
            yield batch(_KEPT, part.column("doc"), sizes, *lists, kept)

    return job


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, most: int = MEMORY_SUFFIXES) -> DataFrame:
    """``(doc_id, n_words, spans array<struct<start, end>>, kept binary)``: what is removed of
    each text, as maximal ranges of words, and the kept words joined by one space."""
    tokens = Tokens(threshold, max(1, min(16, threshold // 3)), _as_words, "u8", within=False)
    spans = repeated_windows(docs, tokens, _repeats(threshold, most))
    texts = packed_texts(keyed_texts(docs)).join(spans, ["doc", "tag"], "left")
    out = map_arrow(texts, _remove(threshold), _KEPT_TYPE)
    ranges = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    return out.select(doc_id_of().alias("doc_id"), "n_words", ranges.alias("spans"), "kept")
