"""Suffix-array and substring dedup against brute force."""

import re

import numpy as np
import pytest

from llm_rows import ODD, frame
from docloom.llm import suffix_sort, suffix_tree, windows
from docloom.llm.suffix_sort import radix_groups
from docloom.llm.suffix_tree import deep_nodes, prefix_groups

LOW = -(2**63)


def place(d):
    return LOW if d is None else d


def spans(mask):
    edges = np.flatnonzero(np.diff([0, *map(int, mask), 0]))
    return [tuple(map(int, x)) for x in zip(edges[::2], edges[1::2])]


def repeated_bytes(rows, t):
    """Per row: removed byte ranges. A window is a repeat if it starts anywhere earlier."""
    first = {}
    texts = [(place(d), (x or "").encode()) for d, x in rows]
    for d, b in texts:
        for s in range(len(b) - t + 1):
            w = b[s : s + t]
            first[w] = min(first.get(w, (d, s)), (d, s))
    out = []
    for d, b in texts:
        mask = np.zeros(len(b), bool)
        for s in range(len(b) - t + 1):
            if first[b[s : s + t]] < (d, s):
                mask[s : s + t] = True
        out.append((d, len(b), spans(mask), bytes(np.frombuffer(b, np.uint8)[~mask])))
    return sorted(out)


def repeated_words(rows, t):
    texts = [(place(d), re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode())) for d, x in rows]
    first = {}
    for d, w in texts:
        for s in range(len(w) - t + 1):
            k = tuple(w[s : s + t])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in texts:
        mask = np.zeros(len(w), bool)
        for s in range(len(w) - t + 1):
            if first[tuple(w[s : s + t])] < d:
                mask[s : s + t] = True
        out.append((d, len(w), spans(mask), b" ".join(x for x, m in zip(w, mask) if not m)))
    return sorted(out)


def found(df, count):
    return sorted((place(r["doc_id"]), r[count], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect())


@pytest.mark.parametrize("t", [100, 7])
def test_bytes_of_odd_texts(spark, odd_docs, t):
    assert found(suffix_sort.remove_repeats(odd_docs, t), "n_bytes") == repeated_bytes(ODD, t)


@pytest.mark.parametrize("t", [50, 4])
def test_words_of_odd_texts(spark, odd_docs, t):
    assert found(suffix_tree.remove_repeats(odd_docs, t, most=64), "n_words") == repeated_words(ODD, t)


def test_given_documents(docs, doc_rows):
    assert found(suffix_sort.remove_repeats(docs), "n_bytes") == repeated_bytes(doc_rows, 100)
    assert found(suffix_tree.remove_repeats(docs), "n_words") == repeated_words(doc_rows, 50)


def thue_morse(n, swap=False):
    return "".join("ab"[bin(i).count("1") % 2 ^ swap] for i in range(n))


def test_regular_texts_are_told_apart(spark):
    """Sums modulo a power of two give this word and its complement one hash."""
    from docloom.llm.hashing import byte_tokens, prime_hashes, span_hashes

    one, other = thue_morse(2048), thue_morse(2048, True)
    tokens = byte_tokens(np.frombuffer((one + other).encode(), np.uint8))
    at = np.array([0, 2048])
    assert len(set(span_hashes(tokens, at, at + 2048).tolist())) == 1
    assert len(set(prime_hashes(tokens, at, at + 2048).tolist())) == 2
    rows = [(1, one), (2, other), (3, " ".join(f"w{i}" for i in range(60)) + " " + one), (4, " ".join(f"w{i}" for i in range(60)) + " " + other)]
    df = frame(spark, rows)
    assert found(suffix_sort.remove_repeats(df, 100), "n_bytes") == repeated_bytes(rows, 100)
    assert found(suffix_tree.remove_repeats(df, 50), "n_words") == repeated_words(rows, 50)


def test_prime_hashes_are_sums_modulo_the_prime():
    from docloom.llm import hashing

    p, rng = 2**61 - 1, np.random.default_rng(3)
    a, b = (rng.integers(0, p, 500).astype(np.uint64) for _ in range(2))
    a[:2], b[:2] = p - 1, [p - 1, 0]
    assert hashing._times(a, b).tolist() == [x * y % p for x, y in zip(a.tolist(), b.tolist())]
    tokens = rng.integers(0, 2**64, 300, dtype=np.uint64)
    starts, ends = rng.integers(0, 150, 50), rng.integers(150, 301, 50)
    whole = hashing.prime_hashes(np.concatenate([tokens, tokens]), np.concatenate([starts, starts + 300]), np.concatenate([ends, ends + 300]))
    assert (whole[:50] == whole[50:]).all()
    alone = [int(hashing.prime_hashes(tokens[s:e], np.array([0]), np.array([e - s]))[0]) for s, e in zip(starts, ends)]
    assert alone == whole[:50].tolist()


def settled_rows(spark, rows, monkeypatch, module, *args):
    """Records that meet, and asked runs that are cut."""
    counts = {}
    kept, cut = windows.stored, windows._cut

    def stored(df, name):
        out = kept(df, name)
        counts["met"] = out.count()
        return out

    monkeypatch.setattr(windows, "stored", stored)
    made = spark.sparkContext.accumulator(0)

    def counted(tokens):
        job = cut(tokens)

        def run(batches):
            for part in job(batches):
                made.add(part.num_rows)
                yield part

        return run

    monkeypatch.setattr(windows, "_cut", counted)
    module.remove_repeats(frame(spark, rows), *args).count()
    monkeypatch.undo()
    return counts["met"], made.value


@pytest.mark.parametrize("module, args", [(suffix_sort, (100,)), (suffix_tree, (50,))])
def test_equal_rows_are_looked_at_once(spark, monkeypatch, module, args):
    text = " ".join(f"w{i % 97}x{i % 89}" for i in range(400))

    def rows(n):
        return [(None, text)] * n + [(3, "some more " + text + " and an end")]

    few, many = (settled_rows(spark, rows(n), monkeypatch, module, *args)[1] for n in (20, 80))
    assert few == many > 0


def test_a_common_passage_sends_few_windows_of_each_text(spark, monkeypatch):
    rng = np.random.default_rng(5)
    passage = " ".join(f"common{i}" for i in range(60))

    def rows(n):
        words = [f"u{x}" for x in rng.integers(0, 10**6, 40)]
        return [(i, " ".join(rng.permutation(words)) + f" {i} " + passage + f" {i * 7} " + " ".join(rng.permutation(words))) for i in range(n)]

    texts = rows(300)
    with monkeypatch.context() as m:
        m.setattr(windows, "SAMPLE", 1)
        assert found(suffix_sort.remove_repeats(frame(spark, texts)), "n_bytes") == repeated_bytes(texts, 100)
    monkeypatch.setattr(windows, "SAMPLE", 1)
    met, _ = settled_rows(spark, texts, monkeypatch, suffix_sort, 100)
    assert met < 100 * len(texts)  # each text has some 400 windows of the passage


def test_frequent_keys_change_the_layout_only(docs, doc_rows, monkeypatch):
    monkeypatch.setattr(windows, "SAMPLE", 1)
    monkeypatch.setattr(windows, "FREQUENT", 2)
    assert found(suffix_sort.remove_repeats(docs), "n_bytes") == repeated_bytes(doc_rows, 100)
    assert found(suffix_tree.remove_repeats(docs), "n_words") == repeated_words(doc_rows, 50)


def test_no_rows(no_docs):
    assert suffix_sort.remove_repeats(no_docs).count() == 0
    assert suffix_tree.remove_repeats(no_docs).count() == 0


def test_many_copies(spark):
    rows = [(i, "the same text again and again, in every one of the rows, " * 4 + str(i % 3)) for i in range(60)]
    assert found(suffix_sort.remove_repeats(frame(spark, rows), 100), "n_bytes") == repeated_bytes(rows, 100)


def test_radix_groups_are_equal_suffixes():
    rng = np.random.default_rng(0)
    tokens = rng.integers(97, 99, 400).astype(np.uint8)
    at = np.arange(380)
    group = rng.integers(0, 3, 380)
    left, of = radix_groups(tokens, at, np.sort(group), 11)
    group = np.sort(group)
    want = {}
    for s in at:
        want.setdefault((group[s], tokens[s : s + 11].tobytes()), []).append(int(s))
    want = sorted(sorted(v) for v in want.values() if len(v) > 1)
    got = {}
    for s, g in zip(left.tolist(), of.tolist()):
        got.setdefault(g, []).append(s)
    assert sorted(sorted(v) for v in got.values()) == want


@pytest.mark.parametrize("most", [3, 1000])
def test_deep_nodes_are_equal_suffixes(most):
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 300).astype(np.uint64)
    at = np.arange(290)
    group = np.sort(rng.integers(0, 2, 290))
    s, g, reach = prefix_groups(tokens, at, group, 9, most)
    below, node = deep_nodes(tokens, at[s], g, reach, 9)
    want = {}
    for x in at:
        want.setdefault((group[x], tokens[x : x + 9].tobytes()), []).append(int(x))
    want = sorted(sorted(v) for v in want.values() if len(v) > 1)
    got = {}
    for x, n in zip(s[below].tolist(), node.tolist()):
        got.setdefault(n, []).append(x)
    assert sorted(sorted(v) for v in got.values()) == want


def test_what_windows_find_travels_in_blocks_and_becomes_one_row_of_a_document():
    import pyarrow as pa

    from docloom.llm import windows as W

    n, docs = 500, 40  # every window of many copies travels alone, under a key of its own
    records = np.zeros(n * docs, W.RECORD)
    records["doc"], records["start"] = np.repeat(np.arange(docs), n), np.tile(np.arange(n), docs)
    records["key"] = records["run"] = np.tile(np.arange(n) * 7919, docs)
    records["n"] = 1
    part = pa.RecordBatch.from_pydict({"bucket": [0], "block": [W._pack(records[np.argsort(records["key"], kind="stable")])]})
    met = list(W._meet(W.Tokens(100, 32, None, "u1", within=True), 8)(iter([part])))
    assert sum(b.num_rows for b in met) <= 8
    by_place = pa.Table.from_batches(met).sort_by("place").to_batches()
    found = [row for b in W._gather()(iter(by_place)) for row in b.to_pylist()]
    assert sorted(r["doc"] for r in found) == list(range(1, docs))  # the first copy repeats nothing
    assert all(r["spans"] == [{"start": 0, "n": n}] and r["asked"] == [] for r in found)
    group, start, size = W.united(np.array([0, 0, 0, 1, 1]), np.array([0, 2, 9, 0, 1]), np.array([5, 2, 1, 1, 1]))
    assert list(zip(group, start, size)) == [(0, 0, 5), (0, 9, 1), (1, 0, 2)]
