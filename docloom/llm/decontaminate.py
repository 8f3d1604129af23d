"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits of the lower-cased text. A document is compared with a test
item by tiles: matches of at least ``shortest`` words, taken longest first, no word of either side
in two tiles. So a passage counts as leaked when its parts stand in any order, or with other words
between them. Coverage is the share of the item's words in tiles; ``threshold`` decides.

1. The items' ``shortest``-word grams are seeds. The set is small for one block of items, which is
   handed to every task (a block is limited to ``BLOCK_GRAMS`` grams; more items make more blocks,
   one after the other). Documents are never shuffled, so no source, item or passage is hot.
2. A document's grams are looked up among the seeds. Every tile lies within seed matches, so an
   item whose seeds touch too few of its words for the threshold cannot reach it and goes.
3. What is left is tiled by running Karp-Rabin: rolling hashes of the unmarked windows of both
   sides say how long the longest match is; matches of that length are checked word by word and
   marked, and the search goes on below it, down to ``shortest``.

Defined cases: a null text is empty; a document or item without words matches nothing; an item of
fewer than ``shortest`` words counts when all of it stands in the document in one piece; rows with
equal ``doc_id`` are judged one by one; ties between equally long tiles go to the earliest place
in the item, then in the document; empty tables give an empty result; columns other than ``doc_id``
and ``text`` (``item_id`` and ``text`` of the benchmark) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batch, byte_column, doc_id_of, doc_key, keyed_texts, map_arrow, slices, text_of
from docloom.llm.hashing import grams
from docloom.llm.words import NOT_ALNUM, word_hashes, word_spans

SHORTEST = 5
THRESHOLD = 0.5
#: Grams of test items that a task holds at a time (16 bytes each).
BLOCK_GRAMS = 1 << 22

_FOUND = pa.schema([
    ("doc", pa.int64()), ("tag", pa.int64()), ("item", pa.int64()), ("n_tiles", pa.int32()), ("covered", pa.int32()),
    ("item_words", pa.int32()), ("coverage", pa.float64()),
    ("tiles", pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())]))),
])
_FOUND_TYPE = (
    "doc long, tag long, item long, n_tiles int, covered int, item_words int, coverage double, "
    "tiles array<struct<item_start: int, doc_start: int, words: int>>"
)


@dataclass
class Block:
    """Some test items: their words one after the other, and by gram length their seeds."""

    items: np.ndarray
    words: np.ndarray
    offsets: np.ndarray
    #: length -> (hashes, sorted; item of each; place in the item)
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[int], texts: list[str], shortest: int) -> "Block":
        raw, offsets = byte_column(pc.utf8_lower(pa.array(texts, pa.string())))
        starts, ends, first = word_spans(raw, offsets, NOT_ALNUM)
        words = word_hashes(raw, starts, ends)
        found: dict[int, list] = {}
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            if b > a:  # an item shorter than the shortest tile is its own seed
                n = int(min(shortest, b - a))
                g = grams(words[a:b], n)
                found.setdefault(n, []).append((g, np.full(len(g), i), np.arange(len(g))))
        seeds = {}
        for n, parts in found.items():
            h, owner, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            seeds[n] = h[order], owner[order], place[order]
        return cls(np.array(items, np.int64), words, first, seeds)


def _ranges(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``lo, lo + 1, ...`` of each of some ranges, and the number of its range."""
    of = np.repeat(np.arange(len(n)), n)
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(of)), of


def _open_windows(words: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    h = grams(words, length)
    if not len(h):
        return h, np.zeros(0, np.int64)
    blocked = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(blocked[length:] == blocked[:-length])
    return h[at], at


def _longest(item, doc, free_item, free_doc, shortest: int, most: int) -> int:
    """The longest unmarked match, of at most ``most`` words; 0 below ``shortest``. Part of a match
    is a match, so its length is found by halving: at each length the rolling hashes of the
    windows of both sides are compared as sets."""

    def shared(length: int) -> bool:
        hi, _ = _open_windows(item, free_item, length)
        hd, _ = _open_windows(doc, free_doc, length)
        return len(hi) > 0 and len(hd) > 0 and bool(np.isin(hi, hd).any())

    most = min(most, len(item), len(doc))
    if most < shortest or not shared(shortest):
        return 0
    low, high, step = shortest, most, shortest
    while low < high:  # first by doubling: most matches are short
        probe = min(high, max(low + step, low + 1))
        if shared(probe):
            low, step = probe, 2 * step
        else:
            high = probe - 1
            break
    while low < high:
        probe = (low + high + 1) // 2
        low, high = (probe, high) if shared(probe) else (low, probe - 1)
    return low


def tile(item: np.ndarray, doc: np.ndarray, shortest: int, free_doc: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word arrays: ``(item place, doc place, words)`` of each tile.

    Memory is that of the words, however often they repeat: pairs of places are never listed. Of the
    longest matches the first place in the item takes the first free place in the document that
    has its words; hashes only propose, the words themselves decide."""
    free_item = np.ones(len(item), bool)
    free_doc = np.ones(len(doc), bool) if free_doc is None else free_doc.copy()
    tiles: list[tuple[int, int, int]] = []
    length = max(len(item), shortest)
    while length := _longest(item, doc, free_item, free_doc, shortest, length):
        hi, ai = _open_windows(item, free_item, length)
        hd, ad = _open_windows(doc, free_doc, length)
        order = np.argsort(hd, kind="stable")
        hd, ad = hd[order], ad[order]
        lo, hi_end = np.searchsorted(hd, hi, "left"), np.searchsorted(hd, hi, "right")
        next_free: dict[int, int] = {}  # of each group of equal windows; a marked place stays marked
        for k in np.flatnonzero(lo < hi_end).tolist():
            a, group, end = int(ai[k]), int(lo[k]), int(hi_end[k])
            if not free_item[a : a + length].all():
                continue
            at = next_free.get(group, group)
            while at < end:
                b = int(ad[at])
                if not free_doc[b : b + length].all():
                    at += 1
                    continue
                if (item[a : a + length] == doc[b : b + length]).all():
                    free_item[a : a + length] = False
                    free_doc[b : b + length] = False
                    tiles.append((a, b, length))
                break
            next_free[group] = at
        length -= 1
    return tiles


def _leaks(block: Block, shortest: int, threshold: float, words: np.ndarray, first: np.ndarray) -> list[tuple]:
    """``(row, item, tiles, covered, item words)`` of a batch of documents given as word hashes.

    A seed that repeats counts once: first the distinct seeds of a document say which items it may
    reach, and how many of their words; places are looked up for those items alone."""
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = []
    for n, (hashes, owner, place) in block.seeds.items():
        g = grams(words, n)
        at = np.flatnonzero(np.isin(g, hashes)) if len(g) else np.zeros(0, np.int64)
        at = at[at + n <= first[1:][row_of[at]]]
        if not len(at):
            continue
        distinct = np.unique(np.stack([row_of[at].astype(np.uint64), g[at]], 1), axis=0)
        rows, seeds = distinct[:, 0].astype(np.int64), distinct[:, 1]
        lo = np.searchsorted(hashes, seeds, "left")
        s, of = _ranges(lo, np.searchsorted(hashes, seeds, "right") - lo)
        key = rows[of] * len(block.items) + owner[s]
        order = np.argsort(key, kind="stable")
        key, s = key[order], s[order]
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        bounds = np.searchsorted(at, first)
        for a, b in zip(cuts, cuts[1:]):
            row, item = divmod(int(key[a]), len(block.items))
            own = block.words[block.offsets[item] : block.offsets[item + 1]]
            need = threshold * len(own) - 1e-9
            if (b - a) * n < need:
                continue
            steps = np.zeros(len(own) + 1, np.int64)
            steps[place[s[a:b]]] += 1
            np.subtract.at(steps, place[s[a:b]] + n, 1)
            if np.count_nonzero(np.cumsum(steps)[:-1]) < need:
                continue
            # of the document only the words in seed matches can be in tiles; a marked word stands
            # for what lies between them
            spots = at[bounds[row] : bounds[row + 1]]
            spots = spots[np.isin(g[spots], hashes[s[a:b]])]
            edge = np.zeros(first[row + 1] - first[row] + 1, np.int64)
            np.add.at(edge, spots - first[row], 1)
            np.subtract.at(edge, spots - first[row] + n, 1)
            inside = np.flatnonzero(np.cumsum(edge[:-1])) + first[row]
            gaps = np.flatnonzero(np.diff(inside) > 1) + 1
            doc = np.insert(words[inside], gaps, 0)
            where = np.insert(inside, gaps, -1)
            tiles = tile(own, doc, n, where >= 0)
            covered = sum(t[2] for t in tiles)
            if covered >= need:
                tiles = sorted((i, int(where[d] - first[row]), m) for i, d, m in tiles)
                out.append((row, item, tiles, covered, len(own)))
    return sorted(out, key=lambda x: x[:2])


def _found(block: Block, shortest: int, threshold: float, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """``(first row of the slice, its end, row, item, tiles, covered, item words)`` of each leak."""
    for i, j in slices(offsets):
        cut = offsets[i : j + 1]
        own = raw[cut[0] : cut[-1]]
        starts, ends, first = word_spans(own, cut - cut[0], NOT_ALNUM)
        for leak in _leaks(block, shortest, threshold, word_hashes(own, starts, ends), first):
            yield i, j, *leak


def _find(block: Block, shortest: int, threshold: float):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            raw, offsets = byte_column(pc.utf8_lower(part.column("text")))
            docs, tags = np.asarray(part.column("doc")), np.asarray(part.column("tag"))
            found = list(_found(block, shortest, threshold, raw, offsets))
            if found:
                begin, _, row, item, tiles, covered, size = zip(*found)
                row = np.array(begin) + np.array(row)
                as_rows = [[dict(item_start=a, doc_start=b, words=n) for a, b, n in t] for t in tiles]
                share = [c / s for c, s in zip(covered, size)]
                yield batch(_FOUND, docs[row], tags[row], block.items[list(item)], [len(t) for t in tiles], covered, size, share, as_rows)

    return job


def _blocks(benchmark: DataFrame, shortest: int, most: int) -> Iterator[Block]:
    """Blocks of whole items, in the order of their ids, that hold ``most`` grams or little more."""
    items, texts, n = [], [], 0
    ordered = benchmark.select(doc_key("item_id").alias("item"), text_of().alias("text")).orderBy("item", "text")
    for row in ordered.toLocalIterator():  # one partition at a time
        items.append(row["item"])
        texts.append(row["text"])
        n += row["text"].count(" ") + 1
        if n >= most:
            yield Block.of(items, texts, shortest)
            items, texts, n = [], [], 0
    if items:
        yield Block.of(items, texts, shortest)


def leaks(
    docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, threshold: float = THRESHOLD,
    block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """One row per document and item it leaks: ``(doc_id, tag, item_id, n_tiles, covered,
    item_words, coverage, tiles)``. Clean documents have no row."""
    texts = keyed_texts(docs)
    found = None
    for block in _blocks(benchmark, shortest, block_grams):
        part = map_arrow(texts, _find(block, shortest, threshold), _FOUND_TYPE)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], _FOUND_TYPE)
    return found.select(
        doc_id_of().alias("doc_id"), "tag", doc_id_of("item").alias("item_id"), "n_tiles", "covered",
        "item_words", "coverage", "tiles",
    )


def clean(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, threshold: float = THRESHOLD, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item; nothing is shuffled."""
    for block in _blocks(benchmark, shortest, block_grams):
        docs = map_arrow(docs, _keep_clean(block, shortest, threshold), docs.schema)
    return docs


def _keep_clean(block: Block, shortest: int, threshold: float):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            text = part.column(part.schema.get_field_index("text")).fill_null("")
            raw, offsets = byte_column(pc.utf8_lower(text))
            keep = np.ones(part.num_rows, bool)
            for i, _, row, *_ in _found(block, shortest, threshold, raw, offsets):
                keep[i + row] = False
            yield part.filter(pa.array(keep))

    return job
