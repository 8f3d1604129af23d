"""Search against brute force in Python, and its invariants."""

import glob
import math
import os
import re
from collections import Counter
from itertools import chain

import pytest
from pyspark.sql import functions as F

from docloom.functions.tokens import tokens
from docloom.operators import search as S
from docloom.operators.batch_search import search_batch
from docloom.plans import tables as T
from docloom.session import new_table_path, work_folder
from docloom.sources import rank_tables
from docloom.sources.rank_tables import write_ranks
from docloom.sources.text_index import ScannedIndex, write_index


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    docs = T.search_docs(spark, sf_dir).persist()
    meta = docs.drop("content")
    stored = write_index(docs, new_table_path(spark, "index"), buckets=5, hot_min_rows=50)
    rows = docs.select(
        "doc_id", "file_type", "file_path", "modified_date",
        tokens(F.col("content")).alias("content"), tokens(F.col("file_name")).alias("file_name"),
    ).collect()
    return docs, meta, stored, rows


class Brute:
    """The scoring rules, document by document."""

    boosts = {"content": 3.0, "file_name": 5.0}

    def __init__(self, rows):
        self.rows = rows
        self.tf = {(r.doc_id, f): Counter(r[f]) for r in rows for f in self.boosts}
        self.n, self.avg, self.df = {}, {}, {}
        for f in self.boosts:
            lengths = [len(r[f]) for r in rows if r[f]]
            self.n[f], self.avg[f] = len(lengths), sum(lengths) / len(lengths)
            self.df[f] = Counter(chain.from_iterable(set(r[f]) for r in rows))

    def term(self, r, term):
        best = None
        for f, boost in self.boosts.items():
            tf, dl = self.tf[r.doc_id, f], len(r[f])
            found = [t for t in term if tf[t]]
            if found:
                s = 0.0
                for t in found:
                    idf = math.log(1 + (self.n[f] - self.df[f][t] + 0.5) / (self.df[f][t] + 0.5))
                    s += boost * 2.2 * idf * tf[t] / (tf[t] + 1.2 * (0.25 + 0.75 * dl / self.avg[f]))
                best = s if best is None else max(best, s)
        return best

    def hits(self, request):
        out = {}
        for r in self.rows:
            if request.file_types and r.file_type not in request.file_types:
                continue
            if r.file_path in request.must_not_raw:
                continue
            if any(self.term(r, t) is not None for t in request.must_not):
                continue
            scores = [self.term(r, t) for t in request.must]
            if None not in scores:
                out[r.doc_id] = sum(scores) + (1.0 if request.file_types else 0.0)
        return out


QUERIES = [
    "thing", "report thing", "pdf report", "the report -ertion", "er-re thing NOT und",
    "the the THE", "-", "zzzzunknown", "report zzzzunknown", "pdf", "-thing", "", "md txt -report",
    "que OR les", "report.pdf 12",
]


@pytest.mark.parametrize("text", QUERIES)
def test_scanned_and_stored_equal_brute_force(spark, corpus, text):
    docs, meta, stored, rows = corpus
    request = S.compile_query(spark, text)
    want = Brute(rows).hits(request)
    for index in (ScannedIndex(docs), stored):
        got = {r.doc_id: r.score for r in S.hits(meta, index, request).collect()}
        assert got.keys() == want.keys()
        if request.order == "relevance" and index is stored:
            alone = {r.doc_id: r.score for r in S.scored_hits(stored, request).collect()}
            assert alone == got
        if request.order == "relevance":
            for k, v in want.items():
                assert got[k] == pytest.approx(v, abs=2e-6)
        else:
            assert set(got.values()) <= {None}


def test_raw_term_excludes_a_whole_path(spark, corpus):
    docs, meta, stored, rows = corpus
    # a path with spaces is no single word, so the predicate is checked on a request
    request = S.Request(must_not_raw=(rows[0].file_path,))
    got = {r.doc_id for r in S.hits(meta, stored, request).collect()}
    assert len(got) == len(rows) - 1


def test_order_rules():
    assert S.Request().order == "date_desc"
    assert S.Request(must=(("a",),)).order == "relevance"
    assert S.Request(must=(("a",),), sort="bogus").order == "relevance"
    assert S.Request(sort="name_asc").order == "name_asc"


@pytest.mark.parametrize("order", ["relevance", "date_desc", "date_asc", "name_asc", "size_desc"])
def test_pages_concatenated_are_the_full_sort(spark, corpus, order, monkeypatch):
    _, meta, stored, _ = corpus
    found = S.hits(meta, stored, S.compile_query(spark, "report", order))
    full = [r.doc_id for r in found.orderBy(*S.sort_columns(order)).collect()]
    pages = [S.page(found, order, n, 70).orderBy("rank").collect() for n in (1, 2, 3, 4)]
    assert [r.doc_id for p in pages for r in p] == full
    assert [r["rank"] for p in pages for r in p] == list(range(1, len(full) + 1))
    # the same pages, cut from the distributed sort
    monkeypatch.setattr(S, "TOP_ROWS_LIMIT", 0)
    deep = [S.page(found, order, n, 70).orderBy("rank").collect() for n in (1, 3, 4)]
    assert [[(r["rank"], r.doc_id) for r in p] for p in deep] == [
        [(r["rank"], r.doc_id) for r in pages[i]] for i in (0, 2, 3)
    ]


@pytest.mark.parametrize("order", rank_tables.ORDERS)
def test_stored_orders_are_the_sorts(spark, corpus, order):
    _, meta, _, _ = corpus
    ranks = write_ranks(meta, new_table_path(spark, "ranks"), rows_per_part=30)
    for types in ((), ("md", "docx"), ("none",)):
        wanted = meta.where(F.col("file_type").isin(*types)) if types else meta
        full = [r.doc_id for r in wanted.orderBy(*S.sort_columns(order)).collect()]
        assert ranks.total(types) == len(full)
        for number in (1, 5):
            got = sorted((r["rank"], r.doc_id) for r in ranks.page(order, types, number, 17).collect())
            assert got == [(i + 1, d) for i, d in enumerate(full)][(number - 1) * 17 : number * 17]


def test_a_page_of_types_reads_its_part_only(spark, corpus):
    _, meta, _, _ = corpus
    ranks = write_ranks(meta, new_table_path(spark, "ranks"), rows_per_part=30)
    text = ranks.page("date_desc", ("pdf",), 1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in text and "PartitionFilters: [isnotnull(sort" in text
    assert re.search(r"PartitionFilters: \[[^]]*part#\d+ (=|IN) \(?\d+\)", text)


def test_missing_sort_keys_come_last(spark):
    df = spark.createDataFrame(
        [(1, "b", None, None), (2, None, "2024-01-01", 5), (3, "x" * 257, "2024-01-02", 1), (4, "B", None, 9)],
        "doc_id int, file_name string, at string, file_size long",
    ).select("*", F.col("at").cast("timestamp_ntz").alias("modified_date"))

    def ids(order):
        return [r.doc_id for r in S.page(df, order).orderBy("rank").collect()]

    assert ids("name_asc") == [4, 1, 3, 2]
    assert ids("date_asc") == [2, 3, 1, 4]
    assert ids("date_desc") == [3, 2, 1, 4]
    assert ids("size_desc") == [4, 2, 3, 1]
    assert ids("date_asc") == [r.doc_id for r in S.page(df, "date_asc", 0).orderBy("rank").collect()]


def test_total_and_summary(spark, corpus):
    _, meta, stored, rows = corpus
    found = S.hits(meta, stored, S.compile_query(spark, ""))
    assert S.total_hits(found).first()[0] == len(rows)
    assert S.page_summary(found, 1).first().total_pages == math.ceil(len(rows) / 100)


def test_stored_lookup_reads_its_buckets_only(corpus):
    _, _, stored, _ = corpus
    plan = stored.lookup(["thing"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert "EqualTo(term,thing)" in plan


def single(spark, meta, stored, text, k):
    request = S.compile_query(spark, text)
    rows = S.page(S.hits(meta, stored, request), request.order, 1, k).collect()
    return sorted((r["rank"], r.doc_id, r.score) for r in rows)


@pytest.mark.parametrize("limits", [{}, {"hot_min_rows": 20}, {"hot_min_rows": 20, "broadcast_bytes": 0},
                                    {"sub_buckets": 3}, {"leads_per_task": 1, "hot_min_rows": 20}])
def test_batch_equals_single(spark, corpus, limits):
    _, meta, stored, _ = corpus
    asked = QUERIES + QUERIES[::-1]
    table = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = search_batch(table, stored, meta, 7, **limits).collect()
    for i, text in enumerate(asked):
        mine = sorted((r["rank"], r.doc_id, r.score) for r in got if r.query_id == i)
        want = single(spark, meta, stored, text, 7)
        assert [x[:2] for x in mine] == [x[:2] for x in want], text
        for a, b in zip(mine, want):
            assert a[2] == (None if b[2] is None else pytest.approx(b[2], abs=2e-6))


def test_batch_excludes_by_whole_path(spark):
    docs = spark.createDataFrame(
        [(1, "a.txt", "txt", "/a.txt", "x y"), (2, "b.txt", "txt", "/b.txt", "x z")],
        "doc_id long, file_name string, file_type string, file_path string, content string",
    ).withColumn("modified_date", F.lit("2024-01-01").cast("timestamp_ntz"))
    index = write_index(docs, new_table_path(spark, "index"))
    table = spark.createDataFrame([(0, "x -/a.txt"), (1, "x -/A.txt"), (2, "NOT /b.txt")], "query_id long, query string")
    got = sorted((r.query_id, r.doc_id) for r in search_batch(table, index, docs).collect())
    # "/a.txt" also has the tokens "a.txt"; the name "a.txt" is excluded by either form
    assert got == [(0, 2), (1, 2), (2, 1)]


def test_queries_without_words_have_few_candidates(spark, corpus):
    _, meta, stored, rows = corpus
    asked = ["pdf", "", "docx md", "-zzzzunknown", "pdf NOT 8", "-8 -9"]
    table = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    search_batch(table, stored, meta, 3).collect()
    newest = max(glob.glob(f"{work_folder(spark)}/candidates-*"), key=os.path.getmtime)
    per_query = {r.query_id: r["count"] for r in spark.read.parquet(newest).groupBy("query_id").count().collect()}
    m = {t: sum(r.df for r in stored.term_stats([t]).collect()) for t in "89"}
    # k + m of each of its lists
    assert per_query == {0: 3, 1: 3, 2: 6, 3: 3, 4: 3 + m["8"], 5: 3 + m["8"] + m["9"]}


def test_an_update_leaves_old_postings_where_they_are(spark, tmp_path, monkeypatch):
    from docloom.operators import postings as P
    from docloom.sources import partitioned, text_index

    words = F.array_join(F.transform(F.sequence(F.lit(0), F.col("doc_id") % 40), lambda i: F.concat(F.lit("w"), i)), " ")
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.lit("txt").alias("file_type"), F.concat(F.lit("f"), "id").alias("file_name"),
        F.concat(F.lit("/r/f"), "id").alias("file_path"),
    ).withColumn("content", words)
    changed = docs.where("doc_id % 5 = 0").withColumn("content", F.concat(F.lit("other "), "content"))
    gone, plans = docs.where("doc_id % 7 = 0 and doc_id % 5 > 0").select("doc_id"), []
    now = docs.where("doc_id % 5 > 0 and doc_id % 7 > 0").unionByName(changed)
    replace = partitioned.PartitionedTable.replace

    def seen(self, parts, rows, sort=()):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        replace(self, parts, rows, sort)

    monkeypatch.setattr(partitioned.PartitionedTable, "replace", seen)
    want = sorted(map(tuple, P.unpack(P.index_counts(now)).collect()))
    for limit in (text_index.BROADCAST_BYTES, 0):
        monkeypatch.setattr(text_index, "BROADCAST_BYTES", limit)
        index = text_index.write_index(docs, str(tmp_path / f"i{limit}"), buckets=4)
        plans.clear()
        after = text_index.update_index(index, changed, gone)
        assert sorted(map(tuple, after.postings().drop("bucket").select(*P.POSTING_COLUMNS).collect())) == want
        assert after.all_term_stats().count() == len({r[1:3] for r in want})
        broadcast = "LeftAnti, (doc_id" in plans[0] and "strategy=broadcast" in plans[0]
        kept_in_place = plans[0].index("LeftAnti") < plans[0].index("RepartitionByExpression")
        assert (broadcast and kept_in_place) == (limit > 0), plans[0]


def test_tasks_of_a_batch_follow_its_look_ups(spark, corpus):
    from docloom.operators.batch_search import _check_tasks

    _, meta, stored, _ = corpus
    of_query = ["query_id", "const_lead"]
    candidates = spark.createDataFrame([(0, i, False) for i in range(50)] + [(1, 7, True)], "query_id long, doc_id long, const_lead boolean")
    checks = spark.createDataFrame([(0, i, False) for i in range(4)] + [(1, 0, False)], "query_id long, term_no long, const_lead boolean")
    assert _check_tasks(candidates, checks, of_query, 100, 30) == 10  # 200 look-ups, 100 postings
    assert _check_tasks(candidates, checks, of_query, 100, 300) is None
    table = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    want = sorted(search_batch(table, stored, meta, 7).collect())
    few = search_batch(table, stored, meta, 7, rows_per_task=100)
    assert sorted(few.collect()) == want
    assert "RepartitionByExpression [doc_id" in few._jdf.queryExecution().optimizedPlan().toString()


def test_queries_without_words_go_deeper_only_where_they_lack_documents(spark, corpus):
    _, meta, stored, rows = corpus
    asked = ["-the", "pdf txt -the -8 -que", "-report", "NOT 7 -9", "pdf", "", "md -zzzzunknown -report"]
    table = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    before = set(glob.glob(f"{work_folder(spark)}/candidates-*"))
    got = search_batch(table, stored, meta, 3, first_depth=4).collect()
    tried = spark.read.parquet(*set(glob.glob(f"{work_folder(spark)}/candidates-*")) - before)
    tried = {r.query_id: r["count"] for r in tried.groupBy("query_id").count().collect()}
    for i, text in enumerate(asked):
        mine = sorted((r["rank"], r.doc_id, r.score) for r in got if r.query_id == i)
        assert mine == single(spark, meta, stored, text, 3), text
    assert tried[2] == len(rows) and not [r for r in got if r.query_id == 2]  # all have that word
    assert max(tried[i] for i in (3, 4, 5)) <= 4  # found in the first round
    for limits in ({"broadcast_bytes": 0}, {"broadcast_bytes": 0, "hot_min_rows": 20}):
        assert sorted(search_batch(table, stored, meta, 3, first_depth=4, **limits).collect()) == sorted(got)


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}


def test_an_index_leaves_no_shuffle_files(spark, corpus, monkeypatch):
    from docloom.operators import postings as P
    from docloom.sources import text_index

    docs, _, stored, _ = corpus
    want = sorted(map(tuple, stored.postings().select(*P.POSTING_COLUMNS).collect()))
    for rounds, buckets in ((1, 5), (3, 5), (4, 2)):
        monkeypatch.setattr(text_index, "ROUNDS", rounds, raising=False)
        there, path = shuffle_files(spark), new_table_path(spark, "index")
        index = write_index(docs, path, buckets=buckets, hot_min_rows=50)
        assert not shuffle_files(spark) - there
        assert sorted(map(tuple, index.postings().select(*P.POSTING_COLUMNS).collect())) == want
        assert len(os.listdir(f"{path}/postings")) >= buckets
