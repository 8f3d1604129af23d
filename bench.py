"""Headline timings as one JSON line.

Each entry is the median of three warm runs over the tables in ``$BENCH_SF_DIR`` on
``local[$BENCH_CPUS]``. The stored index is built first and timed as ``postings_build``.
"""

from __future__ import annotations

import json
import os
import statistics
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def main() -> None:
    from docloom.functions.highlight import result_snippet
    from docloom.operators import search as S
    from docloom.operators.batch_search import search_batch
    from docloom.plans import tables as T
    from docloom.plans.ingest import run_ingest
    from docloom.plans.file_trees import write_tree
    from docloom.plans.registry import FLAGSHIP, QUERIES
    from docloom.session import local_session, new_table_path, spread
    from docloom.sources import progress
    from docloom.sources.text_index import update_index, write_index
    from pyspark.sql import functions as F

    spark = local_session(CPUS, "bench")
    docs, meta = T.search_docs(spark, SF_DIR), T.search_meta(spark, SF_DIR)
    queries: dict[str, float] = {}

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def timed(name, job, runs=RUNS, warm=True) -> None:
        if warm:
            job()
        seconds = []
        for _ in range(runs):
            start = time.perf_counter()
            job()
            seconds.append(time.perf_counter() - start)
        queries[name] = round(statistics.median(seconds), 3)

    indexes = []
    timed("postings_build", lambda: indexes.append(write_index(docs, new_table_path(spark, "index"))))
    index = indexes[-1]
    timed("tokens", lambda: run(QUERIES["tokens"](spark, SF_DIR)))
    timed("term_stats", lambda: run(QUERIES["term_stats"](spark, SF_DIR)))

    def search():
        request = S.compile_query(spark, FLAGSHIP)
        top = S.page(S.scored_hits(index, request), request.order)
        S.fetch(top.select("doc_id", "rank", "score"), meta, "file_name", "file_path", "modified_date").collect()

    timed("search_one", search)
    log = T.query_log(spark, SF_DIR)
    n_queries = log.select("query").distinct().count()  # each distinct query is answered once
    timed("search_batch", lambda: run(search_batch(log, index, meta, 10)))
    timed("delta", lambda: run(QUERIES["delta_status"](spark, SF_DIR)))
    timed("upsert", lambda: run(QUERIES["index_after_upsert"](spark, SF_DIR)))
    timed("mirror_plan", lambda: run(QUERIES["mirror_plan"](spark, SF_DIR)))
    snippets = spread(docs.select("doc_id", "content"), "doc_id").select(
        "doc_id", result_snippet(F.col("content"), ["thing", "ertion"])
    )
    timed("highlight_all", lambda: run(snippets))

    root = write_tree(spark, SF_DIR)
    catalog = new_table_path(spark, "catalog")
    timed("ingest_first", lambda: run_ingest(spark, catalog, [root]), runs=1, warm=False)
    indexed = progress.latest(progress.read(spark, f"{catalog}/progress")).first()["indexed"]
    timed("ingest_unchanged", lambda: run_ingest(spark, catalog, [root]), runs=1, warm=False)
    one_percent = docs.where("doc_id % 100 = 7")
    none = docs.limit(0).select("doc_id")
    timed("index_refresh", lambda: update_index(index, one_percent, none), warm=False)

    print(
        json.dumps(
            {
                "metric": "sum of median seconds over headline jobs",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "batch_queries": n_queries,
                "ms_per_batch_query": round(1000 * queries["search_batch"] / n_queries, 2),
                "indexed_files": indexed,
                "ingest_files_per_sec": round(indexed / queries["ingest_first"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
