"""Packing and token files: exact round trips with the tokenizer library."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docloom.llm import packing, token_files
from docloom.llm.common import byte_column
from docloom.llm.packing import Limits, pack_examples, split_at_powers
from docloom.llm.queries import tokenizer_path
from docloom.llm.tokenizing import Encoder
from llm_rows import ODD, frame

LOW = -(2**63)

TRICKY = [
    "don't you're  it's 'hello' a.b 'em x\n\ny \n z", "  lead", "trail  ", "", "\n", "a b c", "a 　b",
    "<|endoftext|> a", "a'b ab'll can't.'t", ".' s", "12ab ab12 1.2 .5", "é.è é's ’s x’s", "!? .a", "日本 語。x",
    " ", "x\ty", "a.\nb", "a.\n\nb", "a .b", "$ 5 $5", "x'  'y", "\x00 a", "a\u0085b", "é x", "A_b -c",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_tokenizers_ids(doc_rows, name):
    path = tokenizer_path(name)
    enc = Encoder(path)
    texts = TRICKY + [t for _, t in doc_rows]
    for _ in range(2):  # pieces known and unknown
        ids, offsets = enc.encode(*byte_column(pa.array(texts)))
        got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        assert got == [ids_of(enc.tokenizer, t) for t in texts]


def rows_in_order(rows):
    return sorted(rows, key=lambda r: LOW if r[0] is None else r[0])


def check_files(spark, df, rows, tokenizer, folder, end=2):
    files = token_files.write_tokens(df, folder, tokenizer_path(), end)
    got = sorted(map(tuple, token_files.token_digests(spark, files).collect()), key=lambda r: r[1])
    at, want = 0, []
    assert [g[0] for g in got] == [r[0] for r in rows_in_order(rows)]
    pool = defaultdict(list)
    for d, t in rows:
        pool[d].append(np.array(ids_of(tokenizer, t) + [end], "<u4"))
    for doc, start, n, crc in got:
        assert start == at
        assert (n, crc) in [(len(x), zlib.crc32(x.tobytes())) for x in pool[doc]]
        at += n
    assert at == sum(len(x) for xs in pool.values() for x in xs)
    return files


def test_token_files(spark, odd_docs, docs, doc_rows, tokenizer, tmp_path):
    check_files(spark, odd_docs, ODD, tokenizer, str(tmp_path / "odd"))
    files = check_files(spark, docs, doc_rows, tokenizer, str(tmp_path / "docs"))
    some = token_files.token_metadata(spark, files, 20, 30)
    assert sorted(r.doc_id for r in some.collect()) == list(range(20, 31))
    # Spark reads the same folder, and the files are laid out as said
    table = spark.read.parquet(*[f"{tmp_path}/docs/{s[0]}" for s in files.shards])
    assert table.where("doc_id between 20 and 30").select("doc_id").count() == 11
    group = pq.ParquetFile(tmp_path / "docs" / files.shards[0][0]).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index


def test_token_files_with_metadata_and_row_groups(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP_TOKENS", 1)
    files = token_files.write_tokens(docs, f"file://{tmp_path}/m", tokenizer_path(), 2, ["lang", "source"])
    table = pq.read_table(tmp_path / "m" / files.shards[0][0])
    assert {"lang", "source"} <= set(table.column_names)


def test_token_files_of_no_rows(spark, no_docs, tmp_path):
    files = token_files.write_tokens(no_docs, str(tmp_path / "none"), tokenizer_path(), 2)
    assert token_files.token_digests(spark, files).count() == 0


def check_packing(placed, rows, tokenizer, limits, end=0):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in placed.collect():
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    want = sorted(((d, [*ids_of(tokenizer, t), end]) for d, t in rows), key=repr)
    # rows that share an id and a length are told apart by their ids only
    assert sum(r.length for p in pieces.values() for r in p) == sum(len(x) for _, x in want)
    for (doc, n), own in pieces.items():
        texts = [x for d, x in want if d == doc and len(x) == n]
        assert sorted((r.start, r.length) for r in own) and len(texts) >= 1
        if len(texts) == 1:
            own.sort(key=lambda r: r.start)
            assert [i for r in own for i in np.frombuffer(r.ids, "<u4")] == texts[0]
            assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        else:
            assert sum(r.length for r in own) == n * len(texts)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        used = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert used <= limits.tokens and len(own) <= limits.segments
        assert all(len(r.ids) == 4 * r.length for r in own)
        assert used == limits.tokens or used & (used - 1) == 0


def test_packing(odd_docs, docs, doc_rows, tokenizer):
    check_packing(packing.pack(odd_docs, tokenizer_path(), 0), ODD, tokenizer, Limits())
    check_packing(packing.pack(docs, tokenizer_path(), 0, group=50), doc_rows, tokenizer, Limits())


def test_a_few_long_documents_are_many_groups(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 50_000)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20_000))) for i in range(3)]
    placed = packing.pack(frame(spark, rows), tokenizer_path(), 0)
    check_packing(placed, rows, tokenizer, Limits())
    assert len({r.sequence_id >> 32 for r in placed.collect()}) >= 8


def test_packing_without_cuts_and_with_context(docs):
    from pyspark.sql import functions as F

    limits = Limits(tokens=256, segments=3, loss=100)
    placed = packing.pack(docs, tokenizer_path(), 0, limits, cut=False, masked=F.col("doc_id") % 2 == 0)
    rows = placed.collect()
    used, loss, segments = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
        segments[r.sequence_id] += 1
        loss[r.sequence_id] += r.length if r.doc_id % 2 else 0
    assert max(used.values()) <= 256 and max(loss.values()) <= 100 and max(segments.values()) <= 3


def test_packing_no_rows(no_docs):
    assert packing.pack(no_docs, tokenizer_path(), 0).count() == 0


def test_regular_words_keep_their_own_ids(tokenizer):
    """A Thue-Morse word and its complement, alone and in one batch."""
    words = ["".join("ab"[bin(i).count("1") % 2 ^ swap] for i in range(n)) for n in (1024, 2048) for swap in (0, 1)]
    encoder = Encoder(tokenizer_path())
    ids, offsets = encoder.encode(*byte_column(pa.array(words)))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [ids_of(tokenizer, w) for w in words]


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_every_limit(seed):
    rng = np.random.default_rng(seed)
    limits = Limits(tokens=64, segments=int(rng.integers(1, 6)), loss=int(rng.integers(5, 65)))
    tokens = rng.integers(1, 64, 200)
    loss = np.minimum(rng.integers(0, 64, 200), tokens)
    if seed % 2:
        loss = np.minimum(loss, limits.loss)
    example, start, length, bin_, offset = split_at_powers(pack_examples(tokens, loss, limits, cut=True), limits)
    for e in range(200):
        own = sorted(zip(start[example == e].tolist(), length[example == e].tolist()))
        assert sum(n for _, n in own) == tokens[e] and own[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    bears = np.zeros(bin_.max() + 1, int)
    for e, s, n, b in zip(example, start, length, bin_):
        bears[b] += max(0, min(n, s + n - (tokens[e] - loss[e])))
    assert bears.max() <= limits.loss
    assert np.bincount(bin_, weights=length).max() <= 64 and np.bincount(bin_).max() <= limits.segments


def test_dot_product_prefers_what_is_left():
    # loss-bearing tokens are scarce, so the example made of them is placed first, and what
    # bears no loss fills the rest of its sequence
    pieces = pack_examples(np.array([60, 40, 40]), np.array([10, 0, 40]), Limits(tokens=100, segments=4, loss=40), cut=False)
    bins = dict(zip(pieces[0].tolist(), pieces[3].tolist()))
    assert bins[2] == bins[1] != bins[0]
