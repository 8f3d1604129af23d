"""Inverted index and its statistics, as DataFrames.

Fields of the index: ``content`` and ``file_name`` (text), ``file_type`` and ``file_path``
(keyword: the raw value is the one term) and ``_all`` (one ``*`` per document, so that a query
without a required term is an ordinary lookup as well).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.tokens import term_counts, tokens

TEXT_FIELDS = ("content", "file_name")
KEYWORD_FIELDS = ("file_type", "file_path")
ALL_FIELD, ALL_TERM = "_all", "*"
POSTING_COLUMNS = ("doc_id", "field", "term", "tf", "dl")


def field_tokens(docs: DataFrame, fields: Sequence[str] = TEXT_FIELDS, *more: str) -> DataFrame:
    """``(doc_id, field, tokens, *more)``, one row per document and text field."""
    per_field = F.array(
        *[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("tokens")) for f in fields]
    )
    return docs.select("doc_id", F.inline(per_field), *more)


def _counted(tokenised: DataFrame, counted: Column, *more: str) -> DataFrame:
    return tokenised.select(
        "doc_id",
        "field",
        F.size("tokens").cast("bigint").alias("dl"),
        term_counts(counted).alias("counts"),
        *more,
    )


def field_counts(docs: DataFrame, fields: Sequence[str] = TEXT_FIELDS, *more: str) -> DataFrame:
    """``(doc_id, field, dl, counts, *more)`` - the terms of a field still packed in one row."""
    return _counted(field_tokens(docs, fields, *more), F.col("tokens"), *more)


def unpack(counts: DataFrame) -> DataFrame:
    """Packed counts to one row per ``(doc_id, field, term)``."""
    return counts.select("doc_id", "field", "dl", F.inline("counts")).select(*POSTING_COLUMNS)


def text_postings(docs: DataFrame, fields: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    """``(doc_id, field, term, tf, dl)`` of all text fields - a narrow, shuffle-free pass."""
    return unpack(field_counts(docs, fields))


def counts_of_terms(
    docs: DataFrame, terms: Sequence[str], fields: Sequence[str] = TEXT_FIELDS
) -> DataFrame:
    """:func:`field_counts` with the counts of a few terms only; ``dl`` counts all tokens."""
    wanted = F.filter("tokens", lambda t: t.isin(*terms)) if terms else F.slice("tokens", 1, 0)
    return _counted(field_tokens(docs, fields), wanted)


def keyword_counts(docs: DataFrame, *more: str) -> DataFrame:
    """Keyword fields and the ``_all`` entry, in the shape of :func:`field_counts`."""
    one = F.lit(1).cast("bigint")
    values = [F.struct(F.lit(f).alias("field"), F.col(f).alias("term")) for f in KEYWORD_FIELDS]
    whole = F.struct(F.lit(ALL_FIELD).alias("field"), F.lit(ALL_TERM).alias("term"))
    entry = F.struct(F.col("term"), one.alias("tf"))
    return (
        docs.select("doc_id", F.inline(F.array(*values, whole)), *more)
        .where(F.col("term").isNotNull())
        .select("doc_id", "field", one.alias("dl"), F.array(entry).alias("counts"), *more)
    )


def index_counts(docs: DataFrame, *more: str) -> DataFrame:
    """All that is indexed of every document, packed by field, with further columns of it."""
    return field_counts(docs, TEXT_FIELDS, *more).unionByName(keyword_counts(docs, *more))


def term_stats(postings: DataFrame) -> DataFrame:
    """Document frequency per ``(field, term)``; counts combine before the shuffle."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def field_stats(lengths: DataFrame) -> DataFrame:
    """Per text field: documents with at least one token, and their mean token count.

    ``lengths`` has ``field`` and ``dl``, one row per document and field.
    """
    return (
        lengths.where(F.col("field").isin(*TEXT_FIELDS) & (F.col("dl") > 0))
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    )


def field_lengths(docs: DataFrame, fields: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    return field_tokens(docs, fields).select("field", F.size("tokens").alias("dl"))
