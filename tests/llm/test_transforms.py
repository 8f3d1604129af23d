"""Periodic runs and fill-in-the-middle against brute force."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from docloom.llm import fill_middle, periodic
from docloom.llm.fill_middle import RankIndex, boundaries
from docloom.llm.queries import QUERIES
from llm_rows import ODD, SF_DIR, frame


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def plain_runs(w, least=24, ratio=3):
    """Every stretch that keeps a period and cannot be extended, kept if the period is its smallest."""
    out = []
    for q in range(1, len(w) // ratio + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, ratio * q) and smallest_period(w[i : i + length]) == q:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone)


def key(r):
    return tuple((x is not None, x) for x in r)


def found(df):
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed.encode()) for r in df.collect()), key=key)


def wanted(rows, least=24, ratio=3):
    out = []
    for d, t in rows:
        w = words(t)
        runs = plain_runs(w, least, ratio)
        out.append((d, len(w), runs, collapsed(w, runs)))
    return sorted(out, key=key)


PERIODIC = [
    (1, "a b c " * 8), (2, "a b c " * 7 + "a b"), (3, "x " * 23), (4, "x " * 24), (5, "u v " * 20 + "u u v " * 20 + "end"),
    (6, ("a " * 30 + "b ") * 4), (7, " ".join(f"w{i % 9}" for i in range(200))), (8, "same line here\n" * 9 + "same line"),
    (9, "  " * 30 + " "), (None, "n u l l " * 10), (10, "p q " * 12 + "p " * 24 + "q p " * 12),
]


def test_runs_of_odd_texts(spark, odd_docs):
    short = [(d, t) for d, t in ODD if d != 13]
    assert found(periodic.find_runs(odd_docs.where("doc_id is null or doc_id <> 13"))) == wanted(short)
    assert found(periodic.find_runs(frame(spark, PERIODIC))) == wanted(PERIODIC)


@pytest.mark.parametrize("least, ratio", [(24, 3), (2, 2), (5, 2), (9, 4)])
def test_runs_of_random_words(least, ratio):
    rng = np.random.default_rng(least)
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(1, 5)):
            parts += list(rng.integers(0, rng.integers(1, 4), rng.integers(1, 6))) * int(rng.integers(1, 14))
        w = [int(x) for x in parts]
        got = periodic.runs_of(np.array(w), np.full(len(w), len(w)), least, ratio)
        assert [tuple(r) for r in got.tolist()] == plain_runs(w, least, ratio)


def test_runs_of_several_texts_at_once():
    rng = np.random.default_rng(7)
    texts = [list(map(int, rng.integers(0, 2, 60))) for _ in range(20)]
    ends = np.cumsum([len(t) for t in texts])
    ids = np.concatenate([np.array(t) + 2 * k for k, t in enumerate(texts)])
    got = periodic.runs_of(ids, np.repeat(ends, 60), 6, 2)
    want = [(s + 60 * k, n, q) for k, t in enumerate(texts) for s, n, q in plain_runs(t, 6, 2)]
    assert [tuple(r) for r in got.tolist()] == want


def test_long_periodic_text(spark):
    n = 60000
    rows = [(1, "again " * n), (2, " ".join(f"w{i % 7001}" for i in range(n)))]
    got = found(periodic.find_runs(frame(spark, rows)))
    assert [r[2] for r in got] == [[(0, n, 1)], [(0, n, 7001)]]
    assert got[0][3] == b"again" and len(got[1][3].split()) == 7001


def test_no_rows(spark, no_docs):
    assert periodic.find_runs(no_docs).count() == 0
    assert fill_middle.transform(no_docs).count() == 0


def test_periodic_query(spark, doc_rows):
    want = []
    for d, t in doc_rows:
        w, h = words(t), zlib.crc32(str(d).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs)).hexdigest()
        want.append((d, len(runs), *best, milli, *digests))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r[c] for c in names) for r in QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in got) >= len(got) / 20


# -- fill-in-the-middle


def plain_middle(d, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return d, len(t), "plain", None, None, t
    if h4 % 100 < 20:
        return d, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return d, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


MARKED = [(20, "has <P> in it"), (21, "has <S>"), (22, "<M>"), (23, "<<P<S<M P> S> M> >"), (24, "𝄞é日" * 999), (25, "<" * 50), (26, "P>" * 50)]


def test_middle_of_odd_texts(spark):
    rows = ODD + MARKED + [(100 + i, "<S<P<M>"[: i % 7] * 3 + "é" * (i % 5) + ">x" * (i % 3)) for i in range(300)]
    rows = [(d, t) for d, t in rows]
    out = fill_middle.transform(frame(spark, rows)).withColumn("back", fill_middle.restored())
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()
    want = [plain_middle(d, t) + (t or "",) for d, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_marks(spark):
    rows = [(i, f"text {i} [a] (.*) " * 5) for i in range(50)]
    marks = ("[P]", "(S)", "*M*")
    out = fill_middle.transform(frame(spark, rows), plain_percent=0, marks=marks).withColumn("back", fill_middle.restored(marks=marks))
    assert sorted((r.doc_id, r.back) for r in out.collect()) == rows


@pytest.mark.parametrize("error", [0, 1, 126])
def test_rank_index_is_exact(error, monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 4096)
    rng = np.random.default_rng(error)
    for letters in ("ab", "aé日𝄞", "a" * 40 + "日", "日𝄞"):
        text = "".join(rng.choice(list(letters), 5000)) + "日" * 1000 + "a" * 1000
        raw = np.frombuffer(text.encode(), np.uint8)
        index, offsets = RankIndex.of(raw, error), np.append(boundaries(raw), len(raw))
        assert len(index) == len(text) + 1 == len(offsets)
        assert (index.offsets_of(np.arange(len(offsets))) == offsets).all()
        assert np.abs(index.residual).max() <= error + 1
    assert len(RankIndex.of(np.frombuffer(b"a" * 100_000, np.uint8)).first) == -(-100_001 // 4096)


def test_rank_index_of_nothing():
    assert RankIndex.of(np.zeros(0, np.uint8)).offsets_of(np.array([0])).tolist() == [0]
