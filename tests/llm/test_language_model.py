"""The Kneser-Ney model against one counted with dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import kneser_ney
from docloom.llm.kneser_ney import Grams, discounts, pack, unpack
from docloom.llm.queries import QUERIES
from llm_rows import ODD, SF_DIR, frame

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER)), "end"]


def is_held_out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


class Plain:
    """The same model, one n-gram at a time."""

    def __init__(self, texts, order):
        self.order = order
        self.raw = Counter()
        grams = Counter()
        for t in texts:
            ws = ["begin"] * (order - 1) + words(t)
            self.raw.update(ws[order - 1 :])
            grams.update(tuple(ws[i : i + order]) for i in range(len(ws) - order + 1))
        self.n, self.v = sum(self.raw.values()), len(self.raw)
        self.a = {order: dict(grams)}
        counts = grams
        for level in range(order - 1, 0, -1):
            before, shorter = Counter(), Counter()
            for g, c in counts.items():
                before[g[1:]] += 1
                shorter[g[1:]] += c
            self.a[level] = {g: shorter[g] if level > 1 and g[0] == "begin" else before[g] for g in before}
            counts = shorter
        self.d, self.after = {}, {}
        for level, a in self.a.items():
            of = Counter(a.values())
            self.d[level] = discounts(*(of[k] for k in (1, 2, 3, 4)))
            self.after[level] = defaultdict(lambda: [0, 0, 0, 0])
            for g, c in a.items():
                x = self.after[level][g[:-1]]
                x[0] += c
                x[min(c, 3)] += 1

    def p(self, context, w):
        p = 1 / (self.v + 1)
        for level in range(1, self.order + 1):
            c = tuple(context[len(context) - level + 1 :])
            total, *classes = self.after[level].get(c, [0, 0, 0, 0])
            if total:
                a = self.a[level].get((*c, w), 0)
                cut = self.d[level][min(a, 3) - 1] if a else 0
                p = (max(a - cut, 0) + sum(d * n for d, n in zip(self.d[level], classes)) * p) / total
        return p

    def score(self, text):
        ws = ["begin"] * (self.order - 1) + words(text)
        k = self.order - 1
        return sum(math.log10(self.p(ws[i - k : i], ws[i])) for i in range(k, len(ws)))


def key(r):
    return (-(2**63) if r[0] is None else r[0], *r[1:])


def check(rows, df, order):
    plain = Plain([t for d, t in rows if not is_held_out(d)], order)
    want = sorted(
        ((d, is_held_out(d), len(words(t)), sum(w in plain.raw for w in words(t)), plain.n,
          sum(math.log10((plain.raw[w] + 1) / (plain.n + plain.v + 1)) for w in words(t)), plain.score(t)) for d, t in rows),
        key=key,
    )
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for i in (5, 6):
        assert np.allclose([r[i] for r in got], [r[i] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_odd_texts(spark, odd_docs, order):
    learned = odd_docs.where(~kneser_ney.held_out())
    check(ODD, kneser_ney.score(odd_docs, kneser_ney.train(learned, order)), order)


def test_query_on_given_documents(spark, doc_rows):
    check(doc_rows, QUERIES["op13_lm_scoring"](spark, SF_DIR), kneser_ney.ORDER)


def test_small_batches_and_files_read_whole(spark, docs, doc_rows, monkeypatch):
    monkeypatch.setattr(kneser_ney, "FLUSH", 1000)
    model = kneser_ney.train(docs.where(~kneser_ney.held_out()), 3)
    check(doc_rows, kneser_ney.score(docs, model), 3)


def test_probabilities_add_up(spark, docs, doc_rows):
    model = kneser_ney.train(docs, 3)
    arrays = kneser_ney.Arrays(model)
    plain = Plain([t for _, t in doc_rows], 3)
    known = np.array([kneser_ney.END if w == "end" else kneser_ney.xxhash.xxh3_64_intdigest(w) for w in plain.raw], np.uint64)
    unknown = np.uint64(12345)
    some = words(doc_rows[3][1])[:2]
    before = np.array([kneser_ney.xxhash.xxh3_64_intdigest(w) for w in some], np.uint64)
    each = np.append(known, unknown)
    tokens = np.stack([np.full(len(each), before[0]), np.full(len(each), before[1]), each], 1).ravel()
    p, count = kneser_ney.probabilities(arrays, tokens, np.arange(0, len(tokens), 3))
    assert abs(p[2::3].sum() - 1) < 1e-9 and (p > 0).all()
    assert count[2::3].sum() == plain.n and count[-1] == 0


def test_nothing_to_learn_from(spark, odd_docs, no_docs):
    model = kneser_ney.train(no_docs)
    assert (model.tokens, model.types) == (0, 0)
    assert all(r["score"] == 0 for r in kneser_ney.score(odd_docs, model).collect())
    assert kneser_ney.score(no_docs, model).count() == 0


def test_repeated_rows_and_long_text(spark):
    rows = [(3, "to be or not to be"), (3, "to be or not to be"), (None, None), (None, None), (9, "word " * 40000 + "end")]
    df = frame(spark, rows)
    check(rows, kneser_ney.score(df, kneser_ney.train(df.where(~kneser_ney.held_out()), 2)), 2)


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    ws = [rng.integers(0, 50, 4000).astype(np.uint64) for _ in range(3)]
    g = Grams.summed(ws, {"raw": np.ones(4000, np.int64), "total": np.arange(4000)})
    back = Grams.joined([unpack(pack(g, slice(0, 1500)), 3), unpack(pack(g, slice(1500, None)), 3)], 3)
    assert (back.hashes == g.hashes).all() and all((a == b).all() for a, b in zip(back.words, g.words))
    assert all((back.known[k] == g.known[k]).all() for k in g.known)


def test_discounts_of_few_counts():
    assert discounts(0, 0, 0, 0) == (0.5, 1.0, 1.5)
    assert discounts(100, 40, 20, 10) == (1 - 2 * (100 / 180) * 0.4, 2 - 3 * (100 / 180) * 0.5, 3 - 4 * (100 / 180) * 0.5)
