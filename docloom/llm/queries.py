"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import (
    byte_cnn, decontaminate, exact_dedup, fill_middle, html_text, kneser_ney, ngram_join, packing, periodic, suffix_sort,
    suffix_tree, token_files, warc,
)
from docloom.llm.common import stored, table, text_of
from docloom.session import new_table_path


def _removed(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("tag", "class_tag")


#: A score from here on is taken as label 1.
QUALITY_CUT = 0.3


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = byte_cnn.score(docs, byte_cnn.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", byte_cnn.held_out().alias("held_out"), "score",
        (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = html_text.extract(pages, html_text.learn(pages))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_table_path(spark, "warc")
    files = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    records = warc.read_archives(spark, folder, files, "record_id string, record_type string, payload binary, refers_to string")
    records = records.where("record_type in ('response', 'revisit')").select(
        "record_id", "record_type", "refers_to",
        # of the payloads as they are read back; a revisit has none of its own
        F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(F.col("record_type") == "response", F.sha1("payload")).alias("payload_digest"),
    )
    records = stored(records, "warc-records")
    first = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest")
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(first, "refers_to", "left")
    return records.where("record_type = 'response'").unionByName(revisits).select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_sort.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", _removed().alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", _removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return placed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(
        table(spark, sf_dir, "documents"), new_table_path(spark, "tokens"), tokenizer_path(),
        end_id=2, metadata=["lang", "source"],
    )
    return token_files.token_digests(spark, files)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    return out.select("doc_id", "keep_id", "group_size", "kept", sha)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, items).drop("tag", "tiles")


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """For one in ten ids the text with its words repeating from some word on, else the text."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.element_at(ws, (i + 1).cast("int"))), " ")).otherwise("")

    # as the argument of a function the words are made once, not for each place
    tail = F.element_at(F.transform(F.array(words), repeated), 1)
    return F.when(h % 10 == 0, tail).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic.find_runs(docs.select("doc_id", repeated_tail(text_of(), F.col("doc_id")).alias("text")))
    runs = F.col("runs")
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")

    def denser(best: Column, run: Column) -> Column:  # runs come by start and period: the first of equals stays
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), F.aggregate(runs, none, denser).alias("best"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
    return out.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words",
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"),
    )


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(~kneser_ney.held_out()))
    return kneser_ney.score(docs, model).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_html_extraction": op3_html_extraction,
    "op4_warc": op4_warc,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_token_files": op8_token_files,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_lm_scoring": op13_lm_scoring,
}
_OP9 = """
WITH t AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

_OP4 = """
WITH t AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
    SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM t
), w AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS winner FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN winner END AS refers_to
FROM w
"""

_OP12 = """
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
           sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), d AS (
    SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
           ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
    FROM t
), f AS (
    SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM d
), p AS (
    SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1, n - b) AS suf FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

ORACLE: dict[str, str] = {"op4_warc": _OP4, "op9_exact_dedup": _OP9, "op12_fill_in_middle": _OP12}
