"""The result page of a search: ranked rows with everything a reader is shown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import display, paths
from docloom.functions.highlight import result_snippet
from docloom.operators import search as S
from docloom.plans.indexing import search_columns
from docloom.session import new_table_path
from docloom.sources.catalog import Catalog
from docloom.sources.rank_tables import RankTables

# --- fixed values: shown when a row has none ------------------------------------------------
UNNAMED, UNKNOWN_TYPE = "Unnamed File", "doc"


@dataclass(frozen=True)
class ResultPage:
    rows: DataFrame
    summary: DataFrame


def page_number(text: str | int | None) -> int:
    """A page parameter as given by a user; anything but a positive number is page 1."""
    try:
        return max(int(text), 1)
    except (TypeError, ValueError):
        return 1


def cards(page: DataFrame, request: S.Request, escape: bool = False) -> DataFrame:
    """Display columns of one page. ``page`` has ``rank``, the search columns, ``created_date``
    and ``content``; only required terms are marked in the snippet."""
    path = F.coalesce("file_path", F.lit(""))
    marked = sorted({t for term in request.must for t in term})
    kind = F.lower(F.coalesce("file_type", F.lit(UNKNOWN_TYPE)))

    def date(column: str):
        return display.display_date(display.iso_timestamp(F.col(column)))

    return page.select(
        "rank",
        "doc_id",
        F.round("score", S.SHOWN_DIGITS).alias("score"),
        display.html_escape(F.coalesce("file_name", F.lit(UNNAMED))).alias("title"),
        display.html_escape(path).alias("path"),
        kind.alias("file_type"),
        display.mime_type(kind).alias("mime"),
        date("modified_date").alias("modified"),
        date("created_date").alias("created"),
        display.link("openfile", path).alias("open_file"),
        display.link("openopus", path).alias("open_folder"),
        display.link("openexplorer", path).alias("open_explorer"),
        paths.artifact_key(paths.norm_path(path)).alias("artifact_key"),
        result_snippet(F.col("content"), marked, escape).alias("snippet"),
    ).orderBy("rank")


def search_page(
    catalog: Catalog,
    index,
    query: str,
    sort: str = "relevance",
    page: str | int | None = 1,
    size: int = C.PAGE_SIZE,
    escape: bool = False,
    ranks: RankTables | None = None,
) -> ResultPage:
    """One result page over the catalog. An empty query shows nothing.

    By relevance the index alone decides the page. Other orders of a query without words are read
    from the stored orders ``ranks``, if there are any; else they read the narrow columns of the
    catalog. The search runs once: the narrow hits are kept for the page and its summary. All else
    is read for the rows of the page only.
    """
    number = page_number(page)
    spark = catalog.spark
    request = S.compile_query(spark, query.strip(), sort)
    if ranks is not None and query.strip() and not (request.must or request.must_not or request.must_not_raw):
        top = ranks.page(request.order, request.file_types, number, size).withColumn("score", F.lit(None).cast("double"))
        total = spark.sql("SELECT 1 AS one").select(F.lit(ranks.total(request.file_types)).cast("bigint").alias("total"))
    else:
        found = _hits(catalog, index, query.strip(), request)
        path = new_table_path(spark, "hits")
        found.write.parquet(path)
        found = spark.read.schema(found.schema).parquet(path)
        top = S.page(found, request.order, number, size).select("doc_id", "rank", "score")
        total = S.total_hits(found)
    rows = top.collect()  # one page of narrow rows
    wide = search_columns(catalog.read([r["doc_id"] for r in rows]), "created_date", "content")
    full = wide.join(F.broadcast(spark.createDataFrame(rows, top.schema)), "doc_id")
    return ResultPage(cards(full, request, escape), S.summary_of(total, number, size))


def _hits(catalog: Catalog, index, query: str, request: S.Request) -> DataFrame:
    """Key, score and the column that the order needs."""
    if query and request.order == "relevance":
        return S.scored_hits(index, request)
    meta = search_columns(catalog.read())
    found = S.hits(meta if query else meta.where(F.lit(False)), index, request)
    return found.select("doc_id", "score", "modified_date", "file_name", "file_size")
