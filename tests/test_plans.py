"""Plans: no cross joins, pruned scans, no shuffle where none is needed."""

import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import postings as P
from docloom.operators import search as S
from docloom.operators.extract import extract_listed
from docloom.plans import tables as T
from docloom.plans.ingest import document_rows
from docloom.plans.registry import QUERIES
from docloom.schema import LISTING
from docloom.session import new_table_path
from docloom.sources.catalog import cluster
from docloom.sources.text_index import write_index

RUNS_JOBS = {"extract_text", "stream_ingest", "stream_replay", "progress_totals", "progress_latest",
             "extract_long_text", "catalog_after_compact", "stream_changed_files", "stream_triggers"}  # return a plain read of the catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS_JOBS))
def test_no_cross_join(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["delta_status", "delta_ghosts", "run_counters", "mirror_plan",
                                  "backup_manifest", "folder_listing", "artifact_backlog"])
def test_texts_are_not_read(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and not any(re.search(r"\btext\b|\bcontent\b", s) for s in schemas)


def test_counts_need_no_shuffle(spark, sf_dir):
    docs = T.catalog(spark, sf_dir)
    assert "Exchange" not in plan(P.text_postings(docs))


def test_delta_shuffles_each_side_once(spark, sf_dir):
    text = plan(QUERIES["delta_status"](spark, sf_dir))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2


def test_texts_are_not_shuffled_after_extraction(spark):
    listing = spark.createDataFrame([], LISTING).withColumn("_id", F.sha2("file_path", 256))
    text = plan(document_rows(extract_listed(cluster(listing, 16))))
    above = text[: text.index("MapInPandas")]
    assert "Exchange" not in above and "Exchange" in text


def test_search_page_plan(spark, sf_dir):
    docs, meta = T.search_docs(spark, sf_dir), T.search_meta(spark, sf_dir)
    index = write_index(docs, new_table_path(spark, "index"))
    request = S.compile_query(spark, "pdf report")
    text = plan(S.page(S.hits(meta, index, request), request.order))
    assert "TakeOrderedAndProject" in text and "avgdl" in text
    by_date = S.compile_query(spark, "pdf report", "date_asc")
    text = plan(S.page(S.hits(meta, index, by_date), by_date.order))
    assert "avgdl" not in text and "term_stats" not in text


def test_relevance_reads_no_documents(spark, sf_dir):
    index = write_index(T.search_docs(spark, sf_dir), new_table_path(spark, "index"))
    request = S.compile_query(spark, "pdf report NOT thing")
    text = plan(S.page(S.scored_hits(index, request), request.order))
    assert "documents.parquet" not in text and "modified_date" not in text
    assert "TakeOrderedAndProject" in text
