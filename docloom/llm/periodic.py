"""Runs of periodic text: stretches of words that repeat with a smallest period.

Suffixes of a text that share their first ``l`` words form a class. Classes are united by
decreasing ``l``, the longest common prefix of neighbours in suffix order, as Kruskal's method
unites by increasing weight; union-find keeps them, and each class holds its positions in order.
When two classes are united at ``l``, positions that become neighbours at a distance ``d <= l``
seed a run: the words from the first position on repeat with period ``d``, up to ``l`` words past
the second. They would have met earlier had a smaller period been there, so ``d`` is the smallest;
and the stretch ends there, as the two suffixes differ after ``l`` words. It is the whole run if
the words before the two positions differ.

A run of at least ``ratio`` periods and ``least`` words has seeds with a common prefix of a known
least length, so only texts in which that many words occur twice are sorted, and only suffixes that
share that many are united. Which those are is decided by hashes, which leave out no equal words;
suffixes are then sorted by the words themselves, doubling the sorted prefix, where only suffixes
that are not yet told apart are sorted again.

Defined cases: a null or empty text has no words and no runs; a null ``doc_id`` stays null; equal
rows give equal rows, other columns are left out; an empty table gives no rows; runs that touch or
overlap are all reported. A text is held whole in one task, with four bytes for each of its words
and each doubling.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import byte_column, map_arrow, slices, text_of
from docloom.llm.hashing import grams, mix
from docloom.llm.words import BLANK, distinct_words, word_hashes, word_spans

#: A run has so many words, and so many periods.
LEAST, RATIO = 24, 3

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())])
_OUT_TYPE = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def least_prefix(least: int, ratio: int) -> int:
    """The shortest common prefix of two suffixes that can seed a run."""
    return min(max(least - q, (ratio - 1) * q) for q in range(1, least + 1))


def sorted_suffixes(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of some texts, one after the other, and ranks by their first 1, 2, 4, ... words.

    ``ids`` are the words, different ones in different texts; ``ends`` is where each word's text ends.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    place = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = ids[order][1:] != ids[order][:-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    levels = []
    size = np.diff(np.append(np.flatnonzero(new), n))
    active = order[np.repeat(size > 1, size)]
    length = 1
    while len(active):
        levels.append(rank.copy())
        after = active + length
        there = after < ends[active]
        second = np.where(there, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        first = rank[active].astype(np.int64)
        by = np.argsort(first * (n + 1) + second, kind="stable")
        active, first, second = active[by], first[by], second[by]
        group = np.ones(len(active), bool)
        group[1:] = first[1:] != first[:-1]
        split = group.copy()
        split[1:] |= second[1:] != second[:-1]
        place = np.arange(len(active))
        within = place - np.maximum.accumulate(np.where(group, place, 0))
        moved = first + np.maximum.accumulate(np.where(split, place, 0)) - (place - within)
        rank[active] = moved
        size = np.diff(np.append(np.flatnonzero(split), len(active)))
        active = active[np.repeat(size > 1, size)]
        length *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def common_prefixes(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``i`` and ``j`` share."""
    shared = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + shared, j + shared
        inside = np.maximum(a, b) < len(levels[k])
        last = len(levels[k]) - 1
        shared[inside & (levels[k][np.minimum(a, last)] == levels[k][np.minimum(b, last)])] += 1 << k
    return shared


def seeds(i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """``(position, distance, common prefix)`` of positions that become neighbours within it.

    ``i`` and ``j`` are neighbours in suffix order; they are united by decreasing ``shared``.
    """
    places, number = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = number[: len(i)], number[len(i) :]
    order = np.argsort(-shared, kind="stable")
    at = places.tolist()
    parent = list(range(len(at)))
    held = [[p] for p in at]
    found = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y, l in zip(a[order].tolist(), b[order].tolist(), shared[order].tolist()):
        x, y = root(x), root(y)
        if len(held[x]) < len(held[y]):
            x, y = y, x
        large, small = held[x], held[y]
        parent[y] = x
        cuts = [bisect_left(large, p) for p in small]
        last = len(small) - 1
        for k, (p, cut) in enumerate(zip(small, cuts)):
            if cut and (k == 0 or cuts[k - 1] < cut) and p - large[cut - 1] <= l:
                found.append((large[cut - 1], p - large[cut - 1], l))
            if cut < len(large) and (k == last or cuts[k + 1] > cut) and large[cut] - p <= l:
                found.append((p, large[cut] - p, l))
        if len(small) * 16 < len(large):
            for p in small:
                insort(large, p)
        else:
            large.extend(small)
            large.sort()
        held[y] = []
    return np.array(found, np.int64).reshape(-1, 3)


def runs_of(ids: np.ndarray, ends: np.ndarray, least: int, ratio: int) -> np.ndarray:
    """``(start, length, period)`` of all runs, sorted; ``ids`` and ``ends`` as above."""
    order, levels = sorted_suffixes(ids, ends)
    i, j = order[:-1], order[1:]
    if levels:  # neighbours that differ in their first word share nothing
        same = levels[0][i] == levels[0][j]
        i, j = i[same], j[same]
    else:
        i = j = order[:0]
    shared = common_prefixes(levels, i, j)
    enough = shared >= least_prefix(least, ratio)
    start, period, l = seeds(i[enough], j[enough], shared[enough]).T
    before = np.concatenate([[-1], ids])  # the word before a position; texts have no words in common
    whole = (start == 0) | (before[start] != before[start + period])
    length = l + period
    whole &= (length >= least) & (length >= ratio * period)
    found = np.stack([start[whole], length[whole], period[whole]], 1)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _find(least: int, ratio: int):
    gram = least_prefix(least, ratio)

    def repeating_rows(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Texts in which ``gram`` words occur twice."""
        pieces = grams(hashes, gram)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(pieces)]
        whole = np.flatnonzero(np.arange(len(pieces)) + gram <= first[1:][row])
        key = mix(pieces[whole] ^ mix(row[whole].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        again = np.flatnonzero(key[order][1:] == key[order][:-1])
        return np.unique(row[whole[order[again]]])

    def work(raw: np.ndarray, offsets: np.ndarray):
        starts, ends, first = word_spans(raw, offsets, BLANK)
        rows = repeating_rows(word_hashes(raw, starts, ends), first)
        found = np.zeros((0, 3), np.int64)
        if len(rows):
            n = np.diff(first)[rows]
            of = np.repeat(np.arange(len(rows)), n)
            word = np.arange(n.sum()) + (first[rows] - np.cumsum(n) + n)[of]
            ids, distinct = distinct_words(raw, starts[word], ends[word])
            found = runs_of(of * len(distinct) + ids, np.cumsum(n)[of], least, ratio)
            found[:, 0] = word[found[:, 0]]
        kept = np.ones(len(starts), bool)
        if len(found):
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, found[:, 0] + found[:, 2], 1)
            np.add.at(edge, found[:, 0] + found[:, 1], -1)
            kept = np.cumsum(edge[:-1]) == 0
        of_row = np.searchsorted(first, found[:, 0], side="right") - 1
        found[:, 0] -= first[of_row]
        counts = np.bincount(of_row, minlength=len(offsets) - 1)
        text, cut = joined(raw, offsets, starts, ends, first, kept)
        return np.diff(first), found, np.concatenate([[0], np.cumsum(counts)]), text, cut

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            raw, offsets = byte_column(part.column("text"))
            for i, j in slices(offsets):
                cut = offsets[i : j + 1]
                n, found, bounds, text, ends = work(raw[cut[0] : cut[-1]], cut - cut[0])
                runs = pa.StructArray.from_arrays([pa.array(c) for c in found.T], fields=list(_RUN))
                runs = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs)
                texts = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(text)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(i, j - i), pa.array(n), runs, texts], schema=_OUT)

    return job


def joined(raw, offsets, starts, ends, first, kept) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by single spaces: all bytes, and where texts end.

    The byte before a word is a blank of its text, unless it is the text's first word; that byte
    becomes the space before a kept word that is not the first one kept.
    """
    mask = ~BLANK[raw]
    mask[mask] = np.repeat(kept, ends - starts)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[kept]
    follows = np.zeros(len(row), bool)
    follows[1:] = row[1:] == row[:-1]
    mask[starts[kept][follows] - 1] = True
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(mask, out=at[1:])
    return np.where(BLANK[raw], np.uint8(0x20), raw)[mask], at[offsets]


def find_runs(docs: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for each row of ``docs``: all runs of at least
    ``least`` words and ``ratio`` periods by start and period, and the text without the words that
    only repeat a run's first period."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = map_arrow(rows, _find(least, ratio), _OUT_TYPE)
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
