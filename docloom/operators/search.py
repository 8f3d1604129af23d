"""Keyword search for one query: predicates, relevance, sort orders, pages.

The query string is known to the driver, so its terms are literals: they reach the postings
scan as filters, and the table of query terms is as long as the query string.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions.display import page_columns
from docloom.functions.querytext import classify
from docloom.functions.tokens import tokens
from docloom.session import work_folder

SORTS = ("relevance", "date_desc", "date_asc", "name_asc", "size_desc")
#: Pages that end beyond this row are cut out of a distributed sort (see :func:`page`).
TOP_ROWS_LIMIT = 10_000
#: Scores are ranked by so many decimals, beyond which the order of additions shows, and shown
#: with fewer.
RANK_DIGITS, SHOWN_DIGITS = 9, 6


@dataclass(frozen=True)
class Request:
    """A classified query. ``must`` and ``must_not`` keep the tokens of each term."""

    file_types: tuple[str, ...] = ()
    must: tuple[tuple[str, ...], ...] = ()
    must_not: tuple[tuple[str, ...], ...] = ()
    must_not_raw: tuple[str, ...] = ()
    sort: str = "relevance"

    @property
    def order(self) -> str:
        """The sort in effect: relevance needs a required term, else newest first."""
        sort = self.sort if self.sort in SORTS else "relevance"
        return "date_desc" if sort == "relevance" and not self.must else sort

    @property
    def all_tokens(self) -> list[str]:
        return sorted({t for term in self.must + self.must_not for t in term})


@cache
def _request_columns() -> tuple[Column, ...]:
    """Built once: a service compiles many queries with the same expression."""
    parts = classify(F.col("query"))
    return (
        parts["file_types"].alias("file_types"),
        F.transform(parts["must_terms"], tokens).alias("must"),
        F.transform(parts["must_not_terms"], tokens).alias("must_not"),
        parts["must_not_terms"].alias("must_not_terms"),
    )


def compile_query(spark: SparkSession, query: str, sort: str = "relevance") -> Request:
    """Classify one query string with the same expression a table of queries uses.

    Evaluated on a one-row relation, so the driver handles only the query string.
    """
    row = spark.sql("SELECT :q AS query", args={"q": query}).select(*_request_columns()).first()
    return Request(
        tuple(row["file_types"]),
        tuple(tuple(t) for t in row["must"]),
        tuple(tuple(t) for t in row["must_not"]),
        tuple(row["must_not_terms"]),
        sort,
    )


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, n: Column, avgdl: Column, df: Column) -> Column:
    """BM25 of one term in one field, with the constant factor ``k1 + 1``."""
    k1, b = C.BM25_K1, C.BM25_B
    return idf(n, df) * (k1 + 1) * tf / (tf + k1 * (1 - b + b * dl / avgdl))


def score_postings(found: DataFrame, term_stats: DataFrame, field_stats: DataFrame) -> DataFrame:
    """Adds ``bm25`` to postings. ``field_stats`` has one row per text field (two rows)."""
    return (
        found.join(term_stats, ["field", "term"])
        .join(F.broadcast(field_stats), "field")
        .withColumn(
            "bm25", bm25(F.col("tf"), F.col("dl"), F.col("n"), F.col("avgdl"), F.col("df"))
        )
        .drop("df", "n", "avgdl")
    )


def _clause_hits(index, terms: Sequence[tuple[str, ...]], scored: bool) -> DataFrame:
    """``(doc_id, score)`` of documents in which every term matches.

    A term matches through any of its tokens in any text field. Its score is the best field:
    the token scores of a field are added, times the boost. All of it is one aggregate per
    document with a column per term and field, so there is one shuffle, of partial sums.
    """
    vocabulary = sorted({t for term in terms for t in term})
    found = index.lookup(vocabulary)
    if scored:
        # at most two rows (fields) per query token
        stats = F.broadcast(index.term_stats(vocabulary))
        found = score_postings(found, stats, index.field_stats())
    else:
        found = found.withColumn("bm25", F.lit(0.0))

    distinct = list(dict.fromkeys(terms))
    columns, per_term = [], []
    for i, term in enumerate(distinct):
        fields = []
        for name, boost in C.FIELD_BOOSTS.items():
            weight = F.lit(0.0)  # a token that stands twice in a term counts twice
            for t in sorted(set(term)):
                weight = F.when(F.col("term") == t, float(term.count(t))).otherwise(weight)
            in_term = (F.col("field") == name) & F.col("term").isin(*sorted(set(term)))
            alias = f"{name}_{i}"
            # null when no token of the term is in the field
            columns.append(F.sum(F.when(in_term, F.col("bm25") * weight * boost)).alias(alias))
            fields.append(F.col(alias))
        per_term.append(F.greatest(*fields))
    hits = found.groupBy("doc_id").agg(*columns)
    score = F.lit(0.0)
    for term, best in zip(distinct, per_term):
        hits = hits.where(best.isNotNull())
        score = score + best * terms.count(term)
    return hits.select("doc_id", score.alias("score"))


def hits(docs: DataFrame, index, request: Request) -> DataFrame:
    """All documents that match, whole: ``(doc columns..., score)``.

    ``docs`` holds ``doc_id``, ``file_name``, ``file_type``, ``file_path``, ``file_size`` and
    ``modified_date``; the text itself is not needed here. ``score`` is null unless the result
    is sorted by it - other orders read no statistics.
    """
    index = index.for_terms(request.all_tokens) if request.all_tokens else index
    base = docs
    if request.file_types:
        base = base.where(F.col("file_type").isin(*request.file_types))
    if request.must_not_raw:
        base = base.where(~F.col("file_path").isin(*request.must_not_raw))
    scored = request.order == "relevance"
    if request.must:
        if any(not term for term in request.must):  # a term without tokens matches nothing
            base = base.where(F.lit(False))
        terms = [t for t in request.must if t]
        if terms:
            base = base.join(_clause_hits(index, terms, scored), "doc_id")
    excluded = sorted({t for term in request.must_not for t in term})
    if excluded:
        base = base.join(index.lookup(excluded).select("doc_id"), "doc_id", "left_anti")
    if not scored or "score" not in base.columns:
        return base.withColumn("score", F.lit(None).cast("double"))
    bonus = 1.0 if request.file_types else 0.0  # a type filter is a constant-score clause
    return base.withColumn("score", F.round(F.col("score") + bonus, RANK_DIGITS))


def scored_hits(index, request: Request) -> DataFrame:
    """``(doc_id, score)`` of all documents that match a query with a required word, from a stored
    index alone: types and excluded paths are postings as well, so the documents themselves are
    looked up for the rows of a page only."""
    terms = [t for t in request.must if t]
    if len(terms) < len(request.must):  # a term without tokens matches nothing
        return index.lookup([]).select("doc_id", F.lit(0.0).alias("score"))
    found = _clause_hits(index, terms, True)
    if request.file_types:
        found = found.join(index.with_keyword("file_type", request.file_types), "doc_id", "left_semi")
    excluded = sorted({t for term in request.must_not for t in term})
    if excluded:
        found = found.join(index.lookup(excluded).select("doc_id"), "doc_id", "left_anti")
    if request.must_not_raw:
        found = found.join(index.with_keyword("file_path", request.must_not_raw), "doc_id", "left_anti")
    bonus = 1.0 if request.file_types else 0.0
    return found.withColumn("score", F.round(F.col("score") + bonus, RANK_DIGITS))


def sort_columns(order: str) -> list[Column]:
    """Sort keys; missing values come last in both directions, ``doc_id`` breaks ties."""
    keys = {
        "relevance": F.col("score").desc_nulls_last(),
        "date_desc": F.col("modified_date").desc_nulls_last(),
        "date_asc": F.col("modified_date").asc_nulls_last(),
        "name_asc": F.col("file_name").asc_nulls_last(),
        "size_desc": F.col("file_size").desc_nulls_last(),
    }
    return [keys[order], F.col("doc_id").asc()]


def page(
    found: DataFrame, order: str, number: int = 1, size: int = C.PAGE_SIZE, top_rows: int | None = None
) -> DataFrame:
    """One page of the sorted hits with their ``rank`` (1 = best). A page is the feature here.

    Pages near the top are a take-ordered: every task keeps ``offset + size`` rows. A page
    further down is cut out of a distributed sort by global position, so no task holds all
    rows in front of it.
    """
    number = max(int(number), 1)
    offset = (number - 1) * size
    keys = sort_columns(order)
    if offset + size <= (TOP_ROWS_LIMIT if top_rows is None else top_rows):
        rows = found.orderBy(*keys).offset(offset).limit(size)
        # numbered over at most one page of rows
        number_in_page = F.row_number().over(Window.orderBy(*keys)).cast("bigint")
        return rows.withColumn("rank", number_in_page + offset)
    return _deep_page(found, keys, offset, size)


def _deep_page(found: DataFrame, keys: list[Column], offset: int, size: int) -> DataFrame:
    work_folder(found.sparkSession)
    part = F.shiftright(F.col("at"), 33)
    # Stored before positions are counted: a sort that runs twice may cut its ranges anew.
    ordered = found.orderBy(*keys).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # one row per sort partition: the window runs over that short list only
    before = sizes.select(
        "part",
        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"),
    )
    position = F.col("before") + F.col("at") - F.shiftleft(F.col("part"), 33) + 1
    return (
        ordered.withColumn("part", part)
        .join(F.broadcast(before), "part")
        .withColumn("rank", position)
        .where(F.col("rank").between(offset + 1, offset + size))
        .drop("at", "part", "before")
    )


def total_hits(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"))


def page_summary(found: DataFrame, number: int = 1, size: int = C.PAGE_SIZE) -> DataFrame:
    return summary_of(total_hits(found), number, size)


def summary_of(total: DataFrame, number: int = 1, size: int = C.PAGE_SIZE) -> DataFrame:
    """The summary of a page from the one row ``(total)``."""
    return total.select(*page_columns(F.col("total"), F.lit(max(number, 1)), size))


def fetch(top: DataFrame, docs: DataFrame, *columns: str, size: int = C.PAGE_SIZE) -> DataFrame:
    """Wide columns of the rows of one page of at most ``size`` rows.

    The page is evaluated first (its narrow rows). Its keys then reach the scan of the wide table
    as a filter, which skips the row groups without any of them.
    """
    rows = top.take(size + 1)
    if len(rows) > size:
        raise ValueError(f"more than a page of {size} rows")
    keys = [r["doc_id"] for r in rows]
    page_rows = top.sparkSession.createDataFrame(rows, top.schema)
    wide = docs.select("doc_id", *columns).where(F.col("doc_id").isin(*keys) if keys else F.lit(False))
    return wide.join(F.broadcast(page_rows), "doc_id")
