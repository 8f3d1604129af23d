"""Each stage of the pipeline, and the pipeline, against brute force on odd rows."""

import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm import byte_cnn
from docloom.llm.common import table
from docloom.llm.packing import Limits
from docloom.llm.queries import QUALITY_CUT, tokenizer_path
from llm_rows import ODD, SF_DIR, frame
from test_duplicates import UPPER, gram_set, place
from test_text import plain_tiles
from test_tokens import check_packing

ITEM = " ".join(f"item{i}" for i in range(20))
#: Texts with nothing in common under one id, near copies of them, copies in other case, a leak.
ROWS = ODD + [(d, " ".join(f"{name}{i}" for i in range(60))) for d, name in ((None, "a"), (None, "b"), (13, "c"), (13, "d"))] + [
    (None, " ".join(f"a{i}" for i in range(59))), (40, " ".join(f"b{i}" for i in range(58))), (41, " ".join(f"C{i}" for i in range(60))),
    (13, " ".join(f"d{i}" for i in range(59))), (None, "x y z " + ITEM), (None, "Same Letters"), (None, "SAME letters"), (42, ITEM + " v"),
]


def words(t):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())


def exact(rows, tags):
    best = {}
    for d, t in rows:
        key = (t or "").translate(UPPER)
        best[key] = min(best.get(key, (-place(d), tags[t or ""], d, t)), (-place(d), tags[t or ""], d, t), key=lambda x: x[:2])
    return [x[2:] for x in best.values()]


def near(rows, tags):
    rows = sorted({(place(d), tags[t or ""]): (d, t) for d, t in rows}.items())  # the representative comes first
    sets = [gram_set(t) for _, (_, t) in rows]
    seen, kept = set(), []
    for i, (_, row) in enumerate(rows):
        if i in seen:
            continue
        kept.append(row)
        todo = [i]
        while todo:
            a = todo.pop()
            seen.add(a)
            todo += [j for j, b in enumerate(sets) if j not in seen and sets[a] and b and len(sets[a] & b) >= 0.8 * len(sets[a] | b) - 1e-9]
    return kept


def clean(rows, items):
    def leaks(w, v):
        seeds = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return any(tuple(v[i : i + 5]) in seeds for i in range(len(v) - 4)) and sum(n for _, _, n in plain_tiles(v, w, 5)) >= 0.5 * len(v)

    return [(d, t) for d, t in rows if not any(leaks(words(t), v) for v in items)]


def found(df):
    return sorted(((place(r.doc_id), r.text or "") for r in df.collect()))


def wanted(rows):
    return sorted((place(d), t or "") for d, t in rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("odd"))
    frame(spark, ROWS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(1, 14)], "doc_id long, quality int").write.parquet(f"{out}/labels.parquet")
    return out


@pytest.fixture(scope="module")
def tags(spark):
    df = spark.createDataFrame([(t,) for t in {t or "" for _, t in ROWS}], "text string")
    return {r.text: r.tag for r in df.select("text", F.xxhash64("text").alias("tag")).collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())




def test_stages(spark, folder, tags, tokenizer):
    docs = table(spark, folder, "documents")
    assert found(corpus_pipeline.exact_copies(spark, docs, folder)) == wanted(exact(ROWS, tags))
    assert found(corpus_pipeline.near_copies(spark, docs, folder)) == wanted(near(ROWS, tags))
    assert found(corpus_pipeline.leaked_tests(spark, docs, folder)) == wanted(clean(ROWS, [words(ITEM)]))
    check_packing(corpus_pipeline.packed(spark, docs, folder), ROWS, tokenizer, Limits())


def test_unrelated_texts_of_one_id_all_stay(spark, tags):
    rows = [(d, " ".join(f"{d}x{k}w{i}" for i in range(30))) for d in (None, 13) for k in range(5)]
    assert found(corpus_pipeline.near_copies(spark, frame(spark, rows), SF_DIR)) == wanted(rows)


def test_run(spark, folder, tags, tokenizer):
    docs = table(spark, folder, "documents")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.quality(spark, docs, folder).collect()]
    assert len(left) > 5
    left = clean(near(exact(left, tags), tags), [words(ITEM)])
    check_packing(corpus_pipeline.run(spark, folder), left, tokenizer, Limits())
