"""Fragments: golden cases and invariants over the given documents."""

import re

from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions.highlight import fragments, highlights, result_snippet


def run(spark, text, terms, escape=False):
    df = spark.createDataFrame([(text,)], "x string")
    return df.select(result_snippet(F.col("x"), terms, escape)).first()[0]


def test_best_fragments_in_text_order(spark):
    text = "One alpha here. Nothing. Beta and alpha! Then beta.\nAlpha beta alpha beta"
    assert run(spark, text, ["alpha", "beta"]) == (
        "<mark>Beta</mark> and <mark>alpha</mark>! ... "
        "<mark>Alpha</mark> <mark>beta</mark> <mark>alpha</mark> <mark>beta</mark>"
    )


def test_only_whole_tokens_are_marked(spark):
    text = "report report.pdf reports report-2 3.14 14"
    assert run(spark, text, ["report", "14"]) == (
        "<mark>report</mark> report.pdf reports <mark>report</mark>-2 3.14 <mark>14</mark>"
    )


def test_escape_before_marking(spark):
    assert run(spark, "<b> x & y", ["x"], escape=True) == "&lt;b&gt; <mark>x</mark> &amp; y"


def test_late_hit_and_long_word(spark):
    text = "w" * 450 + " " + "filler words " * 200 + "needle at the end"
    assert "<mark>needle</mark>" in run(spark, text, ["needle"])
    pieces = spark.createDataFrame([(text,)], "x string").select(fragments(F.col("x"))).first()[0]
    assert max(map(len, pieces)) <= C.FRAGMENT_CHARS
    assert re.sub(r"\s+", "", "".join(pieces)) == re.sub(r"\s+", "", text)


def test_no_hit_falls_back(spark):
    assert run(spark, "short", ["none"]) == "short..."
    assert run(spark, "", ["none"]) == C.NO_PREVIEW
    assert run(spark, "text", []) == "text..."


def test_invariants_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    terms = ["thing", "que", "und"]
    array = F.array(*[F.lit(t) for t in terms])
    rows = docs.select("text", highlights(F.col("text"), array).alias("h")).collect()
    assert any(r.h for r in rows)
    for r in rows:
        assert len(r.h) <= C.FRAGMENTS
        for fragment in r.h:
            marked = re.findall(f"{C.MARK_OPEN}(.*?){C.MARK_CLOSE}", fragment)
            assert marked and {m.lower() for m in marked} <= set(terms)
            assert fragment.replace(C.MARK_OPEN, "").replace(C.MARK_CLOSE, "") in r.text
