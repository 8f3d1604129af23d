"""The same search for a whole table of queries, in one job.

Conjunctive queries are driven by their rarest clause: only documents of that clause become
candidates, and the other clauses are checked for the candidates alone. So the work follows
the rarest word of a query, not its most common one. A query that is asked many times is answered
once. A query without a required word takes the newest documents of its types that its exclusions
leave: the newest are tried first, and ever older ones only for the queries that still lack some. When
its exclusions can hit at most ``m`` documents, the first ``k + m`` of that order hold its answer.
No query is cut short and no candidate is dropped; a hot term is spread over many tasks by
document, and by query where many queries lead with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import constants as C
from docloom.functions.querytext import classify
from docloom.functions.tokens import term_counts, tokens
from docloom.operators import postings as P
from docloom.operators.search import RANK_DIGITS, SHOWN_DIGITS, bm25
from docloom.operators.skew import (
    HOT_MIN_ROWS,
    add_salt,
    hot_keys,
    hot_threshold,
    repeat_for_salts,
    salted_join,
)
from docloom.session import new_table_path, shuffles_removed, spread

#: A table is broadcast only when its counted size is below this.
BROADCAST_BYTES = 64 << 20
#: Queries with the same leading term that one task answers.
LEADS_PER_TASK = 10_000
#: Look-ups and postings that one task joins.
ROWS_PER_TASK = 2_000_000
#: Parts of a list of documents that are cut before the list is.
SUB_BUCKETS = 64
#: Documents of a list that are tried first for queries without a required word, and how many times
#: as many each next round reaches.
FIRST_DEPTH, DEEPER = 1_000, 16
KEY_BYTES = 128  # a document key in a broadcast: 64 hex characters and its overhead
_TERM = ("field", "term")


def _clause(
    number: Column, kind: str, fields: dict[str, float], terms: Column, times: Column
) -> Column:
    """Entries ``(clause, kind, field, term, weight, times)`` of one clause."""

    def entries(name: str, boost: float) -> Column:
        return F.transform(
            terms,
            lambda t: F.struct(
                number.cast("int").alias("clause"),
                F.lit(kind).alias("kind"),
                F.lit(name).alias("field"),
                t["term"].alias("term"),
                (t["tf"] * F.lit(boost)).cast("double").alias("weight"),
                times.cast("bigint").alias("times"),
            ),
        )

    return F.concat(*[entries(name, boost) for name, boost in fields.items()])


def _single(term: Column) -> Column:
    return F.array(F.struct(term.alias("term"), F.lit(1).cast("bigint").alias("tf")))


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, has_must, n_clauses, clause, kind, field, term, weight, times)``, one row
    per term a query looks up, for a table ``(query_id, query)``.

    Clause 0 is the type filter, or the whole collection when nothing is required. Equal terms
    of a query are one clause that counts ``times``.
    """
    one = F.lit(1)
    parsed = queries.select("query_id", classify(F.col("query")).alias("c")).select(
        "query_id",
        F.array_distinct("c.file_types").alias("types"),
        # equal words in any case have equal tokens
        term_counts(F.transform("c.must_terms", F.lower)).alias("must"),
        F.array_distinct("c.must_not_terms").alias("must_not"),
    )
    n_must, n_types = F.size("must"), F.size("types")
    has_must, has_types = n_must > 0, n_types > 0
    must = F.flatten(
        F.transform(
            "must",
            lambda m, i: _clause(
                i + 1, "must", C.FIELD_BOOSTS, term_counts(tokens(m["term"])), m["tf"]
            ),
        )
    )
    types = F.flatten(
        F.transform("types", lambda t: _clause(F.lit(0), "const", {"file_type": 1.0}, _single(t), one))
    )
    everything = _clause(
        F.lit(0), "const", {P.ALL_FIELD: 1.0}, _single(F.lit(P.ALL_TERM)), one
    )
    excluded = F.flatten(
        F.transform(
            "must_not",
            lambda t: F.concat(
                _clause(
                    F.lit(-1), "not", dict.fromkeys(P.TEXT_FIELDS, 0.0), term_counts(tokens(t)), one
                ),
                _clause(F.lit(-1), "not", {"file_path": 0.0}, _single(t), one),
            ),
        )
    )
    no_entry = F.slice(everything, 1, 0)
    only_exclusions = ~has_must & ~has_types
    return parsed.select(
        "query_id",
        has_must.alias("has_must"),
        (n_must + F.when(has_must & ~has_types, 0).otherwise(1)).alias("n_clauses"),
        F.concat(
            must,
            F.when(has_types, types).when(only_exclusions, everything).otherwise(no_entry),
            excluded,
        ).alias("entries"),
    ).select("query_id", "has_must", "n_clauses", F.inline("entries"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result that is used several times, and read it back."""
    path = new_table_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _leads(required: DataFrame) -> DataFrame:
    """``(query_id, clause)``: the clause with the fewest postings, which leads its query.

    A clause without any posting makes its query empty; such queries end here.
    """
    per_clause = required.groupBy("query_id", "n_clauses", "clause").agg(F.sum("df").alias("rows"))
    return (
        per_clause.groupBy("query_id", "n_clauses")
        .agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("rows", "clause")).alias("rarest"))
        .where(F.col("found") == F.col("n_clauses"))
        .select("query_id", F.col("rarest.clause").alias("clause"))
    )


def _term_score() -> Column:
    """Points of one looked-up term: BM25 for text, 1 for a constant clause, 0 for exclusions."""
    text = bm25(F.col("tf"), F.col("dl"), F.col("n"), F.col("avgdl"), F.col("df"))
    return (
        F.when(F.col("kind") == "const", F.lit(1.0))
        .when(F.col("kind") == "must", F.col("weight") * text)
        .otherwise(F.lit(0.0))
    )


def _check_tasks(candidates: DataFrame, checks: DataFrame, of_query: list[str], postings: int, rows_per_task: int) -> int | None:
    """Number of tasks for the look-ups of all candidates, from counts: what a task sorts does not
    follow the data. None where the session's number of partitions is enough."""
    spark = candidates.sparkSession
    looked_up = checks.groupBy(*of_query).agg(F.count(F.lit(1)).alias("checks"))
    pairs = candidates.groupBy(*of_query).agg(F.count(F.lit(1)).alias("rows")).join(looked_up, of_query)
    rows = (pairs.agg(F.sum(F.col("rows") * F.col("checks"))).first()[0] or 0) + postings
    tasks = -(-rows // rows_per_task)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return df.repartition(tasks, *keys) if tasks else df


def _matches(points: DataFrame, tasks: int | None = None) -> DataFrame:
    """The documents that meet every clause and no exclusion, with their score.

    One shuffle, by query and document: the sums per clause and field, the best field of each
    clause and the total are all computed inside that partitioning.
    """
    keys = ["query_id", "doc_id", "has_must", "n_clauses"]
    fields = [*C.FIELD_BOOSTS, "file_type", "file_path", P.ALL_FIELD]
    in_field = [F.sum(F.when(F.col("field") == f, F.col("points"))) for f in fields]
    per_clause = (
        (points.repartition(tasks, "query_id", "doc_id") if tasks else points.repartition("query_id", "doc_id"))
        .groupBy(*keys, "clause", "times")
        .agg(F.greatest(*in_field).alias("points"))
    )
    return (
        per_clause.groupBy(*keys)
        .agg(
            F.count_if(F.col("clause") >= 0).alias("met"),
            F.count_if(F.col("clause") < 0).alias("hit_exclusion"),
            F.round(F.sum(F.col("points") * F.col("times")), RANK_DIGITS).alias("total"),
        )
        .where((F.col("met") == F.col("n_clauses")) & (F.col("hit_exclusion") == 0))
        .select("query_id", "doc_id", "has_must", "total")
    )


def _first_of_lists(lists: DataFrame, meta: DataFrame, depth: int, sub_buckets: int) -> DataFrame:
    """``(list, doc_id, place)``: the first ``depth`` documents of the date order of each list, at most
    as many as the list's ``most``.

    Lists are cut in two steps, so that no task reads the starts of all tasks: by list and
    sub-bucket of documents, where each task before has cut its rows already, then by list.
    """
    # every document stands in two lists
    both = F.explode(F.array(F.lit(P.ALL_TERM), F.col("file_type")))
    rows = meta.where(F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", "modified_date", both.alias("list"), F.pmod(F.xxhash64("doc_id"), F.lit(sub_buckets)).alias("sub"))
    rows = rows.join(F.broadcast(lists), "list")
    newest_first = [F.col("modified_date").desc_nulls_last(), F.col("doc_id")]
    for part in (["list", "sub"], ["list"]):
        place = F.row_number().over(Window.partitionBy(*part).orderBy(*newest_first))
        # as a literal the limit cuts the rows of every task before they meet
        rows = rows.withColumn("place", place).where((F.col("place") <= depth) & (F.col("place") <= F.col("most")))
    return rows.select("list", "doc_id", "place")


def _newest(
    required: DataFrame, terms: DataFrame, postings: DataFrame, meta: DataFrame, k: int, small: bool,
    hot_min_rows: int, broadcast_bytes: int, sub_buckets: int, first_depth: int,
) -> DataFrame:
    """``(query_id, doc_id)`` of the queries without a required word: the newest ``k`` documents of each
    of their lists that they don't exclude, which is in the first ``k + m`` of the list, ``m`` being
    the most that their exclusions can hit.

    Round by round ever older documents are tried, for the lists of which a query still lacks some.
    Each document is a row with the excluded terms that it has, so what is kept and shuffled follows
    the documents of a round, not their number times the words of the queries.
    """
    spark = required.sparkSession
    is_not = F.col("kind") == "not"
    per_query = terms.where(~F.col("has_must")).groupBy("query_id").agg(
        (F.sum(F.when(is_not, F.col("df")).otherwise(0)) + k).alias("need"),
        F.collect_set(F.when(is_not, F.col("term_no"))).alias("excluded"),
    )
    wanted = required.where(~F.col("has_must")).select("query_id", F.col("term").alias("list")).distinct()
    wanted = _stored(wanted.join(per_query, "query_id"), "lists")
    columns = wanted.columns
    numbers = wanted.select(F.explode("excluded").alias("term_no")).distinct()
    unwanted = postings.join(F.broadcast(numbers) if small else numbers, "term_no", "left_semi")
    found = spark.createDataFrame([], T.StructType([required.schema["query_id"], T.StructField("list", T.StringType()), meta.schema["doc_id"]]))
    above, depth = 0, first_depth
    while wanted.limit(1).count():
        depth = min(depth, 2**31 - 1)
        most = wanted.groupBy("list").agg(F.max("need").alias("most"))  # a row per file type
        docs = _stored(_first_of_lists(most, meta, depth, sub_buckets).where(F.col("place") > above), "newest")
        keys = docs.select("doc_id").distinct()
        if docs.count() * KEY_BYTES <= broadcast_bytes:
            keys = F.broadcast(keys)
        words = unwanted.join(keys, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("term_no").alias("words"))
        docs = _stored(docs.join(words, "doc_id", "left"), "newest")
        pairs = docs.join(F.broadcast(wanted), "list") if small else salted_join(docs, wanted, ["list"], "doc_id", min_rows=hot_min_rows)
        hit = F.coalesce(F.arrays_overlap("words", "excluded"), F.lit(False)).alias("hit")
        tried = pairs.where(F.col("place") <= F.col("need")).select("query_id", "list", "doc_id", "place", hit)
        nth = F.row_number().over(Window.partitionBy("query_id", "list").orderBy("place"))
        left = _stored(tried, "candidates").where(~F.col("hit")).withColumn("nth", nth).where(F.col("nth") <= k)
        found = _stored(found.unionByName(left.select("query_id", "list", "doc_id")), "found")
        # who goes on: a list that has more documents, for a query that lacks some and may use them
        longer = docs.where(F.col("place") == depth).select("list").distinct()
        have = found.groupBy("query_id", "list").agg(F.count(F.lit(1)).alias("have"))
        wanted = wanted.where(F.col("need") > depth).join(longer, "list", "left_semi").join(have, ["query_id", "list"], "left")
        wanted = _stored(wanted.where(F.coalesce("have", F.lit(0)) < k).select(*columns), "lists")
        above, depth = depth, depth * DEEPER
    return found.select("query_id", "doc_id").distinct()


def search_batch(
    queries: DataFrame,
    index,
    meta: DataFrame,
    k: int = 10,
    hot_min_rows: int = HOT_MIN_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    leads_per_task: int = LEADS_PER_TASK,
    sub_buckets: int = SUB_BUCKETS,
    rows_per_task: int = ROWS_PER_TASK,
    first_depth: int = FIRST_DEPTH,
) -> DataFrame:
    """Top ``k`` documents of every query: ``(query_id, rank, doc_id, score)``.

    ``index`` is a stored index; ``meta`` has ``doc_id``, ``file_type`` and ``modified_date``.
    Queries with a required term rank by score, the others by date (newest first); ``doc_id``
    breaks ties.
    """
    distinct = _stored(queries.groupBy("query").agg(F.min("query_id").alias("first")), "queries")
    once = distinct.select(F.col("first").alias("query_id"), "query")
    top = _answers(once, index, meta, k, hot_min_rows, broadcast_bytes, leads_per_task, sub_buckets, rows_per_task, first_depth)
    asked = queries.join(distinct, queries["query"].eqNullSafe(distinct["query"]))
    asked = asked.select(queries["query_id"].alias("asking"), F.col("first").alias("query_id"))
    return asked.join(top, "query_id").drop("query_id").withColumnRenamed("asking", "query_id").select(
        "query_id", "rank", "doc_id", "score"
    )


def _answers(queries, index, meta, k, hot_min_rows, broadcast_bytes, leads_per_task, sub_buckets, rows_per_task, first_depth) -> DataFrame:
    entries = _stored(query_terms(queries), "terms")
    size = entries.agg(F.sum(F.octet_length("term") + F.lit(128))).first()[0] or 0
    small = size <= broadcast_bytes  # the whole table of query terms, counted

    # The asked-for terms that exist, with their frequency: the index statistics are read once.
    # Each gets a number, so that no later shuffle carries or compares words.
    asked = index.all_term_stats().join(entries.select(*_TERM).distinct(), list(_TERM), "left_semi")
    asked = _stored(asked.withColumn("term_no", F.monotonically_increasing_id()), "asked")
    known = F.broadcast(asked) if small else asked
    if small:
        terms = entries.join(known, list(_TERM))
    else:  # a common word may stand in most queries
        terms = _stored(
            salted_join(entries, asked, _TERM, "query_id", min_rows=hot_min_rows), "terms"
        )

    # Only postings of asked-for terms are read on; joining on the bucket as well lets Spark
    # skip the folders of all other buckets.
    found = index.with_bucket(known.where("df > 0").select(*_TERM, "term_no"))
    postings = (
        index.postings()
        .join(F.broadcast(found) if small else found, ["bucket", *_TERM])
        .select("doc_id", "term_no", "tf", "dl")
    )

    # Candidates: the documents of the clause that leads. The postings of a hot term are spread
    # over its salts by document.
    required = terms.where(F.col("kind") != "not")
    ranked = required.where("has_must")
    lead = ranked.join(_leads(ranked), ["query_id", "clause"]).select(
        "query_id", "has_must", "n_clauses", (F.col("kind") == "const").alias("const_lead"), "term_no"
    )
    term = ["term_no"]
    hot = hot_keys(asked, term, "df", hot_threshold(index.total_postings, hot_min_rows))
    led = lead.groupBy("term_no").agg(F.count(F.lit(1)).alias("rows"))
    crowded = hot_keys(led, term, "rows", leads_per_task)  # a few terms among all queries
    by_doc = add_salt(postings.select("doc_id", "term_no"), hot, term, "doc_id")
    by_doc = repeat_for_salts(by_doc.withColumnRenamed("salt", "doc_salt"), crowded, term)
    by_query = add_salt(lead, crowded, term, "query_id").withColumnRenamed("salt", "query_salt")
    by_query = repeat_for_salts(by_query, hot, term).withColumnRenamed("salt", "doc_salt")
    candidates = _stored(
        by_doc.withColumnRenamed("salt", "query_salt")
        .join(by_query, ["term_no", "doc_salt", "query_salt"])
        .select("query_id", "doc_id", "has_must", "n_clauses", "const_lead")
        .distinct(),
        "candidates",
    )
    newest = _newest(required, terms, postings, meta, k, small, hot_min_rows, broadcast_bytes, sub_buckets, first_depth)

    # Check and score: every candidate looks up the other terms of its query by document. A
    # constant clause that leads is met by every candidate and needs no look-up.
    of_query = ["query_id", "const_lead"]
    by_lead = lead.select(*of_query).distinct()
    checks = terms.drop("has_must", "n_clauses", "term").join(by_lead, "query_id")
    checks = checks.where(~(F.col("const_lead") & (F.col("kind") == "const")))
    rows = spread(candidates, "doc_id")  # a short table may lie in one or two files
    if candidates.count() * KEY_BYTES <= broadcast_bytes:
        few = F.broadcast(candidates.select("doc_id").distinct())
        postings = postings.join(few, "doc_id", "left_semi")
    read = asked.agg(F.sum("df")).first()[0] or 0
    tasks = _check_tasks(candidates, checks, of_query, read, rows_per_task)
    if small:
        to_check = rows.join(F.broadcast(checks), of_query)
    else:
        to_check = salted_join(candidates, checks, of_query, "doc_id", min_rows=hot_min_rows)
    columns = ["query_id", "doc_id", "has_must", "n_clauses", "clause", "field", "times", "points"]
    checked = (
        _dealt(to_check, tasks, "doc_id", "term_no")
        .join(_dealt(postings, tasks, "doc_id", "term_no"), ["doc_id", "term_no"])
        .join(F.broadcast(index.field_stats()), "field", "left")  # one row per text field
        .withColumn("points", _term_score())
    )
    met = (
        candidates.where("const_lead")
        .withColumn("clause", F.lit(0))
        .withColumn("field", F.lit(P.ALL_FIELD))
        .withColumn("times", F.lit(1).cast("bigint"))
        .withColumn("points", F.lit(1.0))
    )
    points = checked.select(*columns).unionByName(met.select(*columns))
    # a query without a required word has no score
    dated = newest.select("query_id", "doc_id", F.lit(False).alias("has_must"), F.lit(None).cast("double").alias("total"))
    return top_k(_matches(points, tasks).unionByName(dated), meta, k)


def top_k(matched: DataFrame, meta: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per query. Spark keeps ``k`` rows per query and task before its shuffle,
    so a query that matches most documents moves few rows."""
    by_score = F.when(F.col("has_must"), F.col("total")).desc_nulls_last()
    order = Window.partitionBy("query_id").orderBy(
        by_score, F.col("modified_date").desc_nulls_last(), F.col("doc_id")
    )
    # dates decide only where no score does, so only those matches look them up
    no_date = F.lit(None).cast("timestamp_ntz").alias("modified_date")
    columns = ["query_id", "doc_id", "has_must", "total"]
    scored = matched.where("has_must").select(*columns, no_date)
    dated = matched.where(~F.col("has_must")).join(meta.select("doc_id", "modified_date"), "doc_id")
    return (
        scored.unionByName(dated.select(*columns, "modified_date")).withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(
            "query_id",
            F.col("rank").cast("bigint").alias("rank"),
            "doc_id",
            F.when(F.col("has_must"), F.round("total", SHOWN_DIGITS)).alias("score"),
        )
    )
