"""Exact dedup and the n-gram Jaccard join against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from docloom.llm import exact_dedup, ngram_join
from docloom.llm.common import kept_rows
from docloom.llm.components import connected_components
from docloom.llm.ngram_join import bands_and_rows, jaccard_links
from llm_rows import ODD, frame

LOW = -(2**63)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def place(d):
    return LOW if d is None else d


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(UPPER)].append(place(d))
    out = []
    for t, ids in groups.items():
        best = max(ids)
        kept = False
        for d in ids:
            out.append((d, best, len(ids), d == best and not kept, hashlib.sha256(t.encode()).digest()))
            kept |= d == best
    return sorted(out)


def exact_found(df):
    return sorted((place(r.doc_id), place(r.keep_id), r.group_size, r.kept, bytes(r.digest)) for r in df.collect())


def test_exact_copies(odd_docs, docs, doc_rows):
    assert exact_found(exact_dedup.deduplicate(odd_docs)) == exact(ODD)
    assert exact_found(exact_dedup.deduplicate(docs)) == exact(doc_rows)


def test_exact_against_history(spark):
    old = frame(spark, [(1, "A"), (2, "a"), (3, "b")])
    new = frame(spark, [(10, "a"), (11, "c"), (12, "C"), (13, "d"), (None, None)])
    got = {place(r.doc_id): (place(r.keep_id), r.group_size, r.kept) for r in exact_dedup.deduplicate(new, old).collect()}
    assert got == {10: (2, 2, False), 11: (12, 2, False), 12: (12, 2, True), 13: (13, 1, True), LOW: (LOW, 1, True)}


def test_crowded_shards_are_split(odd_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LOOKUP_ROWS", 2)
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 3)
    assert exact_found(exact_dedup.deduplicate(odd_docs)) == exact(ODD)


def test_perfect_hash_has_no_free_slot():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 333, 4096):
        rows = rng.integers(0, 256, (n, 32)).astype(np.uint8)
        seeds = exact_dedup.perfect_hash(rows)
        assert sorted(exact_dedup.slot_of(rows, seeds, n).tolist()) == list(range(n))


def test_exact_of_no_rows(no_docs):
    assert exact_dedup.deduplicate(no_docs).count() == 0


def gram_set(text, n=5):
    w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near(rows, threshold=0.8):
    """``(doc, class, links)`` of every row."""
    sets = [(place(d), gram_set(t)) for d, t in rows]
    links = [
        [j for j, (_, b) in enumerate(sets) if i != j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9]
        for i, (_, a) in enumerate(sets)
    ]
    out = []
    for i, (d, _) in enumerate(sets):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((d, min(sets[j][0] for j in seen), len(links[i])))
    return sorted(out)


def near_found(df):
    return sorted((place(r.doc_id), place(r.class_id), r.n_links) for r in df.collect())


def test_near_copies(odd_docs, docs, doc_rows):
    assert near_found(ngram_join.near_duplicates(odd_docs)) == near(ODD)
    assert near_found(ngram_join.near_duplicates(docs)) == near(doc_rows)


@pytest.mark.parametrize("block", [3, 512])
def test_a_large_group_of_near_copies(spark, block):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words = list(base)
        for k in rng.integers(0, 120, i % 4):
            words[k] = f"x{i}"
        rows.append((i, " ".join(words[: 120 - i % 9])))
    rows += [(100 + i, " ".join(f"y{i}_{k}" for k in range(50))) for i in range(10)]
    assert near_found(ngram_join.near_duplicates(frame(spark, rows), block=block)) == near(rows)


def drifting(n, words, step=1):
    """Texts of which each drops ``step`` words of the one before and adds as many."""
    return [(i, " ".join(f"w{k}" for k in range(step * i, step * i + words))) for i in range(n)]


@pytest.mark.parametrize("block", [7, 512])
def test_a_chain_is_met_by_buckets(spark, block):
    rows = drifting(150, 120, 2) + [(1000 + i, t + " and an end") for i, t in drifting(3, 60)]
    assert near_found(ngram_join.near_duplicates(frame(spark, rows), block=block)) == near(rows)


def test_pairs_of_a_chain_meet_once(spark, monkeypatch):
    """What is verified follows the pairs that share a band, not the square of the chain."""
    rows = drifting(600, 100)
    places = []
    real = ngram_join._places

    def seen(members, shared):
        places.append(real(members, shared))
        return places[-1]

    monkeypatch.setattr(ngram_join, "_places", seen)
    links = sum(r.n_links for r in ngram_join.near_duplicates(frame(spark, rows)).collect()) // 2
    met, bands = {}, {}
    for r in places[0].collect():
        met.setdefault((r.band, r.place), []).append(r.node)
        bands[r.node] = np.array(r.bands)
    due = []
    for (band, _), nodes in met.items():
        for i, a in enumerate(nodes):
            due += [frozenset((a, b)) for b in nodes[:i] if not (bands[a][:band] == bands[b][:band]).any()]
    names = list(bands)
    want = {frozenset((a, b)) for i, a in enumerate(names) for b in names[:i] if (bands[a] == bands[b]).any()}
    assert len(due) == len(set(due)) and set(due) == want
    assert links <= len(due) < 5 * links  # all pairs of the chain: 30 times the links


def test_near_copies_of_no_rows(no_docs):
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.6, 0.99), (0.9, 0.95)):
        bands, rows = bands_and_rows(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 96


def test_jaccard_matrix():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30, 25)).astype(np.uint64) for _ in range(20)]
    want = [[i != j and len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert (jaccard_links(sets, None, 0.5, columns=7) == np.array(want)).all()
    assert (jaccard_links(sets[:8], sets[8:], 0.5) == np.array(want)[:8, 8:]).all()


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)]
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: c for x, c in label.items() if x in got}
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}


@pytest.mark.parametrize("hub", [0, 500, 9999])
def test_components_of_a_hub(spark, hub):
    """A node with more links than a task may be handed, be it the least, a middle or the largest."""
    links = [(hub, i) for i in range(1, 1200) if i != hub] + [(i, i + 2000) for i in range(1, 1200)] + [(7000, 7001)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    nodes = {x for e in links for x in e}
    least = min(nodes - {7000, 7001})
    assert got == {x: 7000 if x in (7000, 7001) else least for x in nodes}


def test_kept_rows_keep_one_of_equal_rows(spark, odd_docs):
    from docloom.llm.common import keyed_texts

    keys = keyed_texts(odd_docs).select("doc", "tag")
    kept = kept_rows(odd_docs, keys)
    assert kept.columns == odd_docs.columns
    rows = [(place(r.doc_id), r.text or "") for r in kept.collect()]
    assert sorted(rows) == sorted({(place(d), t or "") for d, t in ODD})
