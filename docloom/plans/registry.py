"""All registered queries: name -> job over the given tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import display, paths
from docloom.functions.highlight import passages, result_snippet
from docloom.functions.querytext import classify
from docloom.functions.tokens import term_counts, tokens
from docloom.operators import artifacts, batch_search, delta, extract, filters, folders, mirror
from docloom.operators import postings as P
from docloom.operators import search as S
from docloom.plans import oracle as O
from docloom.plans import results
from docloom.plans import tables as T
from docloom.plans.file_trees import with_bytes, write_long_texts, write_tree
from docloom.plans.ingest import run_ingest
from docloom.session import new_table_path, spread
from docloom.schema import DOCUMENT
from docloom.sources import files, progress
from docloom.sources.catalog import Catalog
from docloom.sources.rank_tables import write_ranks
from docloom.sources.text_index import ScannedIndex, update_index, write_index
from docloom.streaming.ingest import TriggerLog, finish_ingest, ingest_batch, start_ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(job: Query) -> Query:
        key = name or job.__name__
        QUERIES[key] = job
        if sql:
            ORACLE[key] = sql
        return job

    return add


# ---- catalog columns and filters ------------------------------------------------------------


@query(
    "WITH " + O.INDEX + """,
both_sides AS (
  SELECT doc_id, 'scan' AS side, file_path, modified_date FROM catalog
  UNION ALL SELECT doc_id, 'index' AS side, file_path, modified_date FROM stored),
cut AS (SELECT *, regexp_extract(file_path, '[^/]*$') AS file_name FROM both_sides)
SELECT doc_id, side, file_name,
       left(file_path, length(file_path) - length(file_name) - 1) AS file_directory,
       lower(regexp_extract(file_name, '\\.[^.]*$')) AS file_extension,
       substr(lower(regexp_extract(file_name, '\\.[^.]*$')), 2) AS file_type,
       lower(file_path) AS norm_path, sha256(lower(file_path)) AS id,
       md5(lower(file_path)) AS artifact_key,
       '/Backups/Documents/' || substr(file_path, 2) AS backup_path,
       strftime(modified_date, '%Y-%m-%dT%H:%M:%S') AS iso_date
FROM cut"""
)
def catalog_paths(spark, sf_dir):
    cols = ["doc_id", "side", "file_path", "modified_date"]
    scan = T.catalog(spark, sf_dir).withColumn("side", F.lit("scan")).select(*cols)
    index = T.stored_index(spark, sf_dir).withColumn("side", F.lit("index")).select(*cols)
    path = F.col("file_path")
    name = paths.file_name(path)
    norm = paths.norm_path(path)
    return scan.unionByName(index).select(
        "doc_id",
        "side",
        name.alias("file_name"),
        paths.file_directory(path).alias("file_directory"),
        paths.file_extension(name).alias("file_extension"),
        paths.file_type(name).alias("file_type"),
        norm.alias("norm_path"),
        paths.document_id(norm).alias("id"),
        paths.artifact_key(norm).alias("artifact_key"),
        paths.backup_destination(path, T.BACKUP_ROOT).alias("backup_path"),
        display.iso_timestamp(F.col("modified_date")).alias("iso_date"),
    )


@query("WITH " + O.CATALOG + f"\nSELECT doc_id, file_path FROM catalog WHERE {O.ACCEPTED}")
def catalog_filtered(spark, sf_dir):
    """Two overlapping roots: what both list stays once."""
    whole = T.catalog(spark, sf_dir).drop("content")
    inner_root = f"{T.ROOT}/src1"
    inner = whole.where(F.col("file_path").startswith(inner_root + "/"))
    listing = whole.unionByName(inner.withColumn("root", F.lit(inner_root)))
    keyed = delta.with_keys(listing, filters.accepted(F.col("file_path"), F.col("root")))
    return keyed.where("accepted").select("doc_id", "file_path")


@query("WITH " + O.INDEX + "\nSELECT norm_path, modified_date, file_size FROM stored")
def metadata_scan(spark, sf_dir):
    index = delta.metadata(T.stored_index(spark, sf_dir))
    return index.select("norm_path", "modified_date", "file_size")


# ---- delta, upsert, counters ------------------------------------------------------------------


def _statuses(spark, sf_dir, force=False):
    index = delta.metadata(T.stored_index(spark, sf_dir))
    return delta.delta(T.scan(spark, sf_dir), index, [T.ROOT], force)


@query("WITH " + O.STATUS + "\nSELECT id, norm_path, status FROM statuses")
def delta_status(spark, sf_dir):
    return _statuses(spark, sf_dir).select(F.col("_id").alias("id"), "norm_path", "status")


@query("WITH " + O.STATUS + "\nSELECT norm_path FROM statuses WHERE status = 'ghost'")
def delta_ghosts(spark, sf_dir):
    index = delta.metadata(T.stored_index(spark, sf_dir))
    return delta.ghosts(T.scan(spark, sf_dir), index, [T.ROOT]).select("norm_path")


def _after(spark, sf_dir, force):
    cols = ["_id", "file_size", "modified_date"]
    statuses = _statuses(spark, sf_dir, force)
    changes = statuses.where(F.col("status") == delta.INDEXED).select(*cols)
    dead = statuses.where(F.col("status") == delta.GHOST)
    new = delta.apply_changes(T.stored_index(spark, sf_dir).select(*cols), changes, dead)
    return new.withColumnRenamed("_id", "id")


@query(
    "WITH " + O.STATUS + """
SELECT id, file_size, modified_date FROM statuses WHERE status = 'indexed'
UNION ALL
SELECT id, file_size, modified_date FROM stored
WHERE id NOT IN (SELECT id FROM statuses WHERE status IN ('indexed', 'ghost'))"""
)
def index_after_upsert(spark, sf_dir):
    return _after(spark, sf_dir, False)


@query(
    "WITH " + O.INDEX + f""",
ok AS (SELECT * FROM catalog WHERE {O.ACCEPTED})
SELECT id, file_size, modified_date FROM ok
UNION ALL
SELECT id, file_size, modified_date FROM stored WHERE id NOT IN (SELECT id FROM ok)"""
)
def index_after_force(spark, sf_dir):
    return _after(spark, sf_dir, True)


@query(
    "WITH " + O.STATUS + """
SELECT count(*) FILTER (status IN ('skipped', 'indexed')) AS scanned,
       count(*) FILTER (status = 'indexed') AS indexed,
       count(*) FILTER (status = 'skipped') AS skipped,
       count(*) FILTER (status = 'ignored') AS ignored,
       count(*) FILTER (status = 'error') AS error,
       count(*) FILTER (status = 'ghost') AS deleted
FROM statuses"""
)
def run_counters(spark, sf_dir):
    return delta.run_counters(_statuses(spark, sf_dir))


@query("WITH " + O.INDEX + "\nSELECT count(*) AS n FROM stored")
def document_count(spark, sf_dir):
    return delta.document_count(T.stored_index(spark, sf_dir))


@query("""
WITH log AS (
  SELECT user_id, CASE event_type WHEN 'click' THEN 'indexed' WHEN 'view' THEN 'skipped'
                    WHEN 'error' THEN 'error' ELSE 'ignored' END AS status FROM events)
SELECT user_id, count(*) FILTER (status IN ('skipped', 'indexed')) AS scanned,
       count(*) FILTER (status = 'indexed') AS indexed,
       count(*) FILTER (status = 'skipped') AS skipped,
       format('Checking documents: {:,} scanned ({:,} updated, {:,} skipped)',
              count(*) FILTER (status IN ('skipped', 'indexed')),
              count(*) FILTER (status = 'indexed'), count(*) FILTER (status = 'skipped'))
         AS message
FROM log GROUP BY user_id""")
def counter_text(spark, sf_dir):
    """Counters and message per user of an event log read as a run log."""
    kind = F.col("event_type")
    s = (
        F.when(kind == "click", delta.INDEXED)
        .when(kind == "view", delta.SKIPPED)
        .when(kind == "error", delta.ERROR)
        .otherwise(delta.IGNORED)
    )
    counts = (
        T.table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.count_if(s.isin(delta.SKIPPED, delta.INDEXED)).alias("scanned"),
            F.count_if(s == delta.INDEXED).alias("indexed"),
            F.count_if(s == delta.SKIPPED).alias("skipped"),
        )
    )
    message = display.progress_text(F.col("scanned"), F.col("indexed"), F.col("skipped"))
    return counts.withColumn("message", message)


@query("""
SELECT event_id, (event_type <> 'error'
  AND epoch_us(TIMESTAMP '2024-01-02 00:00:00') - epoch_us(ts) < 120000000) AS is_running
FROM events""")
def running_fresh(spark, sf_dir):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    fresh = filters.is_fresh(F.col("event_type") != "error", F.col("ts"), now)
    return T.table(spark, sf_dir, "events").select("event_id", fresh.alias("is_running"))


# ---- mirror, backup, artifacts ----------------------------------------------------------------


def _mirror(spark, sf_dir, strict):
    def side(df):
        norm = paths.norm_path(F.col("file_path"))
        return df.select(
            F.substr(norm, F.lit(2)).alias("rel_path"),
            F.col("modified_date").alias("mtime"),
            F.col("file_size").alias("bytes"),
        )

    source, target = side(T.catalog(spark, sf_dir)), side(T.stored_index(spark, sf_dir))
    return mirror.mirror_plan(source, target, mirror=not strict)


@query(O.mirror(strict=False))
def mirror_plan(spark, sf_dir):
    return _mirror(spark, sf_dir, strict=False)


@query(O.mirror(strict=True))
def mirror_plan_strict(spark, sf_dir):
    return _mirror(spark, sf_dir, strict=True)


@query(
    "WITH " + O.CATALOG + """
SELECT doc_id, file_extension NOT IN ('.csv', '.zip') AS is_backed_up,
       CASE WHEN file_extension NOT IN ('.csv', '.zip')
         THEN '/Backups/Documents' || file_path END AS backup_path
FROM catalog"""
)
def backup_manifest(spark, sf_dir):
    docs = T.catalog(spark, sf_dir).withColumn(
        "file_extension", paths.file_extension(F.col("file_name"))
    )
    out = mirror.with_backup(docs, T.BACKUP_ROOT, ["CSV", ".zip"])
    return out.select("doc_id", "is_backed_up", "backup_path")


_BACKLOG = "WITH " + O.INDEX + """,
made AS (SELECT md5(norm_path) AS k FROM stored JOIN documents USING (doc_id) WHERE lang = 'en'),
backlog AS (
  SELECT doc_id, CASE WHEN norm_path NOT IN (SELECT lower(file_path) FROM catalog) THEN 'missing'
      WHEN md5(norm_path) IN (SELECT k FROM made)
        OR file_type NOT IN ('pdf','docx','doc','xlsx','xls','pptx','ppt','txt','md','csv','rtf')
        THEN 'skipped' ELSE 'todo' END AS status
  FROM stored)"""


def _backlog(spark, sf_dir):
    index = T.stored_index(spark, sf_dir).select(
        "doc_id", "norm_path", paths.file_type(F.col("file_name")).alias("file_type")
    )
    listing = T.catalog(spark, sf_dir).select(
        paths.norm_path(F.col("file_path")).alias("norm_path")
    )
    # artifacts were made for the English documents
    english = T.table(spark, sf_dir, "documents").where(F.col("lang") == "en").select("doc_id")
    made = index.join(english, "doc_id", "left_semi").select(
        paths.artifact_key(F.col("norm_path")).alias("artifact_key")
    )
    return artifacts.artifact_backlog(index, listing, made)


@query(_BACKLOG + "\nSELECT doc_id, status FROM backlog")
def artifact_backlog(spark, sf_dir):
    return _backlog(spark, sf_dir).select("doc_id", "status")


@query(
    _BACKLOG + """
SELECT count(*) FILTER (status = 'todo') AS todo, count(*) FILTER (status = 'skipped') AS skipped,
       count(*) FILTER (status = 'missing') AS missing FROM backlog"""
)
def artifact_counters(spark, sf_dir):
    return artifacts.artifact_counters(_backlog(spark, sf_dir))


def _folders_sql(parent: str) -> str:
    return "WITH " + O.CATALOG + f"""
SELECT DISTINCT name, '{parent}/' || name AS path
FROM (SELECT split_part(substr(file_path, {len(parent) + 2}), '/', 1) AS name FROM catalog
      WHERE file_path LIKE '{parent}/%/%')
WHERE left(name, 1) <> '.' AND lower(name) NOT IN {O._list(C.HIDDEN_FOLDERS)}"""


@query(_folders_sql("/Corpus"))
def folder_listing(spark, sf_dir):
    return folders.folder_listing(T.catalog(spark, sf_dir), "/Corpus")


@query(_folders_sql("/Corpus/src0"))
def folder_listing_nested(spark, sf_dir):
    return folders.folder_listing(T.catalog(spark, sf_dir), "/Corpus/src0")


# ---- tokens and index statistics --------------------------------------------------------------


@query("WITH " + O.POSTINGS + "\nSELECT doc_id, field, term, tf, dl FROM post JOIN dl USING (doc_id, field)",
       name="tokens")
def tokens_query(spark, sf_dir):
    return P.text_postings(T.search_docs(spark, sf_dir))


@query(
    f"""WITH toks AS (SELECT conv_id, turn, unnest({O.tokens('text')}) AS term FROM conversations)
SELECT conv_id, turn, term, count(*) AS tf FROM toks GROUP BY ALL"""
)
def tokens_conversations(spark, sf_dir):
    turns = spread(T.table(spark, sf_dir, "conversations"), "conv_id")
    counts = turns.select("conv_id", "turn", tokens(F.col("text")).alias("tokens"))
    return counts.select("conv_id", "turn", F.inline(term_counts(F.col("tokens"))))


@query("WITH " + O.POSTINGS + "\nSELECT field, term, count(*) AS df FROM post GROUP BY ALL")
def term_stats(spark, sf_dir):
    return P.term_stats(P.text_postings(T.search_docs(spark, sf_dir)))


@query(
    "WITH " + O.POSTINGS + """
SELECT field, count(*) AS n, round(sum(dl)::DOUBLE / count(*), 6) AS avgdl FROM dl GROUP BY field"""
)
def field_stats(spark, sf_dir):
    stats = P.field_stats(P.field_lengths(T.search_docs(spark, sf_dir)))
    return stats.select("field", "n", F.round("avgdl", 6).alias("avgdl"))


# ---- one query ----------------------------------------------------------------------------------


@query(
    "WITH " + O.SCORED + """
SELECT doc_id, round(s * 3.0, 4) AS score FROM scored WHERE field = 'content' AND term = 'thing'"""
)
def bm25_single_term(spark, sf_dir):
    index = ScannedIndex(T.search_docs(spark, sf_dir)).for_terms(["thing"])
    found = index.lookup(["thing"]).where(F.col("field") == "content")
    scored = S.score_postings(found, index.term_stats(["thing"]), index.field_stats())
    score = F.round(F.col("bm25") * C.FIELD_BOOSTS["content"], 4)
    return scored.select("doc_id", score.alias("score"))


FLAGSHIP = "pdf report thing NOT ertion"
_FLAGSHIP_SQL = O.hits([["report"], ["thing"]], ["pdf"], ["ertion"], ["ertion"])
WIDE = "report er-re NOT (thing) md OR txt OR csv"
_WIDE_SQL = O.hits([["report"], ["er", "re"]], ["md", "txt", "csv"], ["thing"], ["thing"])


def _hits(spark, sf_dir, text, sort="relevance"):
    docs = T.search_docs(spark, sf_dir)
    request = S.compile_query(spark, text, sort)
    return S.hits(T.search_meta(spark, sf_dir), ScannedIndex(docs), request), request.order


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", S.SHOWN_DIGITS))


def _page(spark, sf_dir, text, sort="relevance", number=1, columns=("doc_id",)):
    found, order = _hits(spark, sf_dir, text, sort)
    return _shown(S.page(found, order, number)).select("rank", *columns)


@query(O.page(_FLAGSHIP_SQL, "relevance", columns="doc_id, score, file_name"))
def search_relevance(spark, sf_dir):
    return _page(spark, sf_dir, FLAGSHIP, columns=("doc_id", "score", "file_name"))


@query(_WIDE_SQL + "\nSELECT doc_id, score FROM found")
def search_all_hits(spark, sf_dir):
    """Every hit with its score, no page; a term of two tokens and several types."""
    return _shown(_hits(spark, sf_dir, WIDE)[0]).select("doc_id", "score")


@query(O.page(O.hits([]), "date_desc"))
def search_match_all(spark, sf_dir):
    return _page(spark, sf_dir, "")


@query(O.page(O.hits([], ["pdf", "docx"]), "date_desc"))
def search_type_only(spark, sf_dir):
    return _page(spark, sf_dir, ".PDF docx")


@query(O.page(O.hits([], [], ["thing", "report2", "de"], ["thing", "report2", "de"]), "date_desc"))
def search_exclude_only(spark, sf_dir):
    return _page(spark, sf_dir, "-thing NOT report2 -(de)")


@query(O.page(_WIDE_SQL, "date_desc"))
def search_sort_date_desc(spark, sf_dir):
    return _page(spark, sf_dir, WIDE, "date_desc")


@query(O.page(_WIDE_SQL, "date_asc"))
def search_sort_date_asc(spark, sf_dir):
    return _page(spark, sf_dir, WIDE, "date_asc")


@query(O.page(_WIDE_SQL, "name_asc"))
def search_sort_name_asc(spark, sf_dir):
    return _page(spark, sf_dir, WIDE, "name_asc")


@query(O.page(_WIDE_SQL, "size_desc"))
def search_sort_size_desc(spark, sf_dir):
    return _page(spark, sf_dir, WIDE, "size_desc")


@query(O.page(O.hits([["report"]]), "relevance", 2))
def search_page_2(spark, sf_dir):
    return _page(spark, sf_dir, "report", number=2)


@query(
    O.hits([["report"]]) + """
SELECT count(*) AS total, greatest(ceil(count(*) / 100), 1)::BIGINT AS total_pages,
       101::BIGINT AS start_doc, least(200, count(*)) AS end_doc, 1::BIGINT AS prev_page,
       CASE WHEN count(*) > 200 THEN 3 ELSE 2 END::BIGINT AS next_page,
       least(100, count(*) - least(200, count(*))) AS next_count,
       format('Found {:,} matching document(s)', count(*)) AS found_text
FROM found"""
)
def page_summary(spark, sf_dir):
    found, _ = _hits(spark, sf_dir, "report")
    summary = S.page_summary(found, 2)
    return summary.withColumn("found_text", display.found_text(F.col("total")))


@query(
    O.page(_FLAGSHIP_SQL, "relevance", columns="doc_id, left(content, 300) || '...' AS snippet")
)
def search_page_content(spark, sf_dir):
    """Late materialisation: the texts of one page only."""
    top = _page(spark, sf_dir, FLAGSHIP, columns=("doc_id",))
    rows = S.fetch(top, T.catalog(spark, sf_dir), "content")
    return rows.select("rank", "doc_id", display.snippet(F.col("content")).alias("snippet"))


_CARD_COLUMNS = """replace(replace(file_name, '&', '&amp;'), '''', '&#x27;') AS title,
         file_path AS path, file_type, 'application/pdf' AS mime,
         strftime(modified_date, '%b %d, %Y, %I:%M %p') AS modified, '' AS created,
         'openfile://' || replace(url_encode(file_path), '%2F', '/') AS open_file,
         'openopus://' || replace(url_encode(file_path), '%2F', '/') AS open_folder,
         'openexplorer://' || replace(url_encode(file_path), '%2F', '/') AS open_explorer,
         md5(lower(file_path)) AS artifact_key"""


@query(
    O.snippets(
        _FLAGSHIP_SQL + f""",
ranked AS (SELECT *, row_number() OVER (ORDER BY full_score DESC, doc_id) AS rank FROM found),
shown AS (SELECT rank, score, content, doc_id, {_CARD_COLUMNS} FROM ranked WHERE rank <= 100)""",
        ["report", "thing"],
        source="shown",
        columns="f.rank, f.score, f.title, f.path, f.file_type, f.mime, f.modified, f.created, "
        "f.open_file, f.open_folder, f.open_explorer, f.artifact_key, ",
    )
)
def result_cards(spark, sf_dir):
    """A whole result page: rank, score, names, dates, links and marked snippets."""
    request = S.compile_query(spark, FLAGSHIP)
    docs = T.search_docs(spark, sf_dir)
    found = S.hits(T.search_meta(spark, sf_dir), ScannedIndex(docs), request)
    wide = docs.withColumn("created_date", F.lit(None).cast("timestamp_ntz"))
    page = S.fetch(S.page(found, request.order), wide, "content", "created_date")
    return results.cards(page, request)


# ---- a table of queries -------------------------------------------------------------------------


@query(O.BATCH)
def search_batch(spark, sf_dir):
    index = write_index(T.search_docs(spark, sf_dir), new_table_path(spark, "index"))
    log = T.query_log(spark, sf_dir)
    return batch_search.search_batch(log, index, T.search_meta(spark, sf_dir), 10)


def _updated_index(spark, sf_dir):
    """The index of an older state, brought to the present one: a document in seven is new, one in
    five had another text, one in eleven is gone."""
    docs = T.search_docs(spark, sf_dir)
    i = F.col("doc_id")
    older = F.when(i % 5 == 0, F.concat(F.lit("older thing report "), "content")).otherwise(F.col("content"))
    index = write_index(docs.where(i % 7 != 0).withColumn("content", older), new_table_path(spark, "index"))
    now = docs.where(i % 11 != 0)
    changed = now.where((i % 7 == 0) | (i % 5 == 0))
    gone = docs.where((i % 11 == 0) & (i % 7 != 0)).select("doc_id")
    return update_index(index, changed, gone)


def _present(sql: str) -> str:
    return sql.replace("FROM parts)", "FROM parts WHERE i % 11 <> 0)")


@query(_present("WITH " + O.POSTINGS) + "\nSELECT field, term, count(*) AS df FROM post GROUP BY ALL")
def term_stats_after_update(spark, sf_dir):
    index = _updated_index(spark, sf_dir)
    return index.all_term_stats().where(F.col("field").isin(*P.TEXT_FIELDS)).select("field", "term", "df")


@query(O.page(_present(_FLAGSHIP_SQL), "relevance", columns="doc_id, score"))
def search_after_update(spark, sf_dir):
    """From the updated index alone."""
    request = S.compile_query(spark, FLAGSHIP)
    found = S.scored_hits(_updated_index(spark, sf_dir), request)
    return _shown(S.page(found, request.order)).select("rank", "doc_id", "score")


def _deep(sql: str) -> str:
    return sql + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY file_name, doc_id) AS rank FROM found)
SELECT rank, doc_id FROM ranked WHERE rank > 300 AND rank <= 310"""


@query(_deep(O.hits([["report"]])))
def search_deep_page(spark, sf_dir):
    """A page cut out of the distributed sort by position."""
    found, order = _hits(spark, sf_dir, "report", "name_asc")
    return S.page(found, order, 31, 10, top_rows=0).select("rank", "doc_id")


def _ranks(spark, sf_dir):
    meta = T.search_meta(spark, sf_dir)
    # small parts, as many as a large collection has
    return write_ranks(meta, new_table_path(spark, "ranks"), rows_per_part=max(meta.count() // 12, 1))


@query(O.page(O.hits([], ["pdf", "docx"]), "date_desc", 2))
def search_type_only_stored(spark, sf_dir):
    """The second page of two types, from the stored order by date."""
    return _ranks(spark, sf_dir).page("date_desc", ["pdf", "docx"], 2)


@query(O.page(O.hits([]), "name_asc"))
def search_names_stored(spark, sf_dir):
    """All documents by name, from the stored order."""
    return _ranks(spark, sf_dir).page("name_asc")


@query(O.page(O.hits([], ["md"]), "size_desc"))
def search_sizes_stored(spark, sf_dir):
    return _ranks(spark, sf_dir).page("size_desc", ["md"])


@query(
    "WITH " + O.CATALOG + """,
moved AS (SELECT *, replace(file_path, ' ', '_') AS path FROM catalog)
SELECT doc_id FROM moved WHERE path <> (SELECT min(path) FROM moved)"""
)
def search_exclude_path(spark, sf_dir):
    """An exclusion that is a whole path, and nothing but that document's path."""
    docs = T.search_docs(spark, sf_dir).withColumn("file_path", F.translate("file_path", " ", "_"))
    first = docs.agg(F.min("file_path")).first()[0]
    meta = docs.drop("content")
    request = S.compile_query(spark, f"-{first}")
    # the tokens of the path are no word of any text; the path itself decides
    return S.hits(meta, ScannedIndex(docs.withColumn("file_name", F.lit("qqq"))), request).select("doc_id")


@query(
    "WITH " + O.CATALOG + """
SELECT doc_id, lower('/corpus/' || source || '/kept/' || stem || ext_raw) AS norm_path
FROM catalog JOIN parts ON doc_id = i"""
)
def paths_folded(spark, sf_dir):
    """``.``, ``..``, double slashes, backslashes and letter case in paths."""
    docs = T.catalog(spark, sf_dir)
    source = F.regexp_extract("file_path", "^/Corpus/([^/]*)", 1)
    i = F.col("doc_id") % 4
    folders = (
        F.when(i == 0, F.concat(F.lit("/Corpus//"), source, F.lit("/./kept/x/../")))
        .when(i == 1, F.concat(F.lit("\\Corpus\\"), source, F.lit("\\KEPT\\")))
        .when(i == 2, F.concat(F.lit("/../Corpus/a/../"), source, F.lit("/kept//")))
        .otherwise(F.concat(F.lit("file:///corpus/"), F.upper(source), F.lit("/Kept/")))
    )
    return docs.select("doc_id", paths.norm_path(F.concat(folders, "file_name")).alias("norm_path"))


def _classify_sql() -> str:
    source = "(SELECT * FROM query_log UNION ALL SELECT conv_id * 1000 + turn + 10000000, text FROM conversations)"
    return "WITH " + O.QUERY_LOG + "," + O.classified(source, "query_id", "query") + """
SELECT query_id, array_to_string(types, '|') AS file_types,
       array_to_string(must, '|') AS must_terms, array_to_string(must_not, '|') AS must_not_terms
FROM parsed"""


@query(_classify_sql())
def query_classify(spark, sf_dir):
    """The query log and every conversation turn, classified as query strings."""
    turns = T.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 10_000_000).alias("query_id"),
        F.col("text").alias("query"),
    )
    log = T.query_log(spark, sf_dir).unionByName(turns)
    parsed = log.select("query_id", classify(F.col("query")).alias("c"))
    return parsed.select(
        "query_id",
        *[
            F.array_join(F.col(f"c.{c}"), "|").alias(c)
            for c in ("file_types", "must_terms", "must_not_terms")
        ],
    )


# ---- fragments and display ----------------------------------------------------------------------

_TERMS = ["thing", "ertion", "que"]


def _snippets(spark, sf_dir, escape):
    docs = spread(T.catalog(spark, sf_dir).select("doc_id", "content"), "doc_id")
    return docs.select("doc_id", result_snippet(F.col("content"), _TERMS, escape).alias("snippet"))


_ALL_DOCS = "WITH found AS (SELECT doc_id, text AS content FROM documents)"


@query(O.snippets(_ALL_DOCS, _TERMS))
def highlight(spark, sf_dir):
    """Fragments of every document; documents without a hit show their start."""
    return _snippets(spark, sf_dir, False)


@query(O.snippets(_ALL_DOCS, _TERMS, escape=True))
def highlight_escaped(spark, sf_dir):
    return _snippets(spark, sf_dir, True)


@query(O.passage_snippets(_ALL_DOCS, _TERMS))
def highlight_passages(spark, sf_dir):
    """Fragments of every document, ranked by passage score."""
    docs = spread(T.catalog(spark, sf_dir).select("doc_id", "content"), "doc_id")
    return docs.select("doc_id", result_snippet(F.col("content"), _TERMS, pick=passages).alias("snippet"))


@query("SELECT doc_id, left(text, 300) || '...' AS snippet FROM documents")
def snippet(spark, sf_dir):
    return T.catalog(spark, sf_dir).select(
        "doc_id", display.snippet(F.col("content")).alias("snippet")
    )


@query(r"""
WITH lines AS (
  SELECT doc_id, regexp_split_to_array(left(text, 500),
    '\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS ls FROM documents)
SELECT doc_id, array_to_string(list_transform(
    (CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END)[:18], lambda s: left(s, 45)), chr(10)) AS lines
FROM lines""")
def text_preview(spark, sf_dir):
    lines = display.preview_lines(F.col("content"))
    return T.catalog(spark, sf_dir).select("doc_id", F.array_join(lines, "\n").alias("lines"))


@query("SELECT doc_id, length(left(text, 1000000)) AS n_chars, md5(left(text, 1000000)) AS digest FROM documents")
def content_cap(spark, sf_dir):
    capped = display.content_cap(F.col("content"))
    return T.catalog(spark, sf_dir).select(
        "doc_id",
        F.length(capped).cast("bigint").alias("n_chars"),
        F.md5(capped).alias("digest"),
    )


@query(
    "WITH " + O.CATALOG + """
SELECT doc_id, CASE file_type
    WHEN 'pdf' THEN 'application/pdf'
    WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    WHEN 'xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
    WHEN 'txt' THEN 'text/plain; charset=utf-8' WHEN 'md' THEN 'text/markdown; charset=utf-8'
    WHEN 'csv' THEN 'text/csv; charset=utf-8' ELSE 'application/octet-stream' END AS mime
FROM catalog"""
)
def mime_types(spark, sf_dir):
    mime = display.mime_type(paths.file_type(F.col("file_name")))
    return T.catalog(spark, sf_dir).select("doc_id", mime.alias("mime"))


@query(f"SELECT page_id, {O.escaped('html')} AS escaped FROM pages")
def html_escape(spark, sf_dir):
    pages = T.table(spark, sf_dir, "pages")
    return pages.select("page_id", display.html_escape(F.col("html")).alias("escaped"))


_QUOTED = "replace(url_encode(replace({}, chr(92), '/')), '%2F', '/')"


@query(
    "WITH " + O.CATALOG + f""",
all_paths AS (
  SELECT 'catalog' AS kind, doc_id AS key, file_path AS p FROM catalog
  UNION ALL SELECT 'page', page_id, url || chr(92) || '~*é+ ' FROM pages),
quoted AS (SELECT *, {_QUOTED.format('p')} AS q FROM all_paths)
SELECT kind, key, 'openfile://' || q AS open_file, 'openopus://' || q AS open_folder,
       'openexplorer://' || q AS open_explorer, replace(p, chr(92), '/') AS unquoted
FROM quoted"""
)
def link_columns(spark, sf_dir):
    docs = T.catalog(spark, sf_dir).select(
        F.lit("catalog").alias("kind"), F.col("doc_id").alias("key"), F.col("file_path").alias("p")
    )
    pages = T.table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"),
        F.col("page_id").alias("key"),
        F.concat("url", F.lit("\\~*é+ ")).alias("p"),
    )
    p = F.col("p")
    return docs.unionByName(pages).select(
        "kind",
        "key",
        display.link("openfile", p).alias("open_file"),
        display.link("openopus", p).alias("open_folder"),
        display.link("openexplorer", p).alias("open_explorer"),
        display.url_unquote(display.url_quote(p)).alias("unquoted"),
    )


@query("""
WITH texts AS (
  SELECT event_id, ts, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'bad' || event_id || 'Text'
           ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS t FROM events)
SELECT event_id,
       CASE WHEN t IS NULL THEN '' WHEN t LIKE 'bad%' THEN split_part(t, 'T', 1)
            ELSE strftime(ts, '%b %d, %Y, %I:%M %p') END AS shown,
       CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso
FROM texts""")
def display_dates(spark, sf_dir):
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", F.lit(None).cast("string"))
        .when(kind == "view", F.concat(F.lit("bad"), F.col("event_id"), F.lit("Text")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    return T.table(spark, sf_dir, "events").select(
        "event_id",
        display.display_date(text).alias("shown"),
        display.iso_timestamp(F.col("ts")).alias("iso"),
    )


# ---- real files -----------------------------------------------------------------------------------

_NO_CONTROL = r"regexp_replace(content, '[\x00-\x08\x0B-\x1F]', '', 'g')"
_EXTRACTED = "WITH " + O.CATALOG + rf""",
texts AS (
  SELECT substr(file_path, length('/Corpus/') + 1) AS rel_path, file_size, file_type,
    CASE
      WHEN file_type IN ('txt', 'md')
        THEN replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))
      WHEN file_type = 'docx' THEN array_to_string(list_filter(
        string_split({_NO_CONTROL}, chr(10)), lambda s: s <> ''), chr(10))
      WHEN file_type = 'xlsx' THEN array_to_string(list_filter(
        string_split({_NO_CONTROL}, chr(10)), lambda s: s <> ''), ' ')
      ELSE '' END AS content
  FROM catalog WHERE {O.ACCEPTED})
SELECT rel_path, file_type, content FROM texts"""


def _catalog_texts(catalog: Catalog, root: str) -> DataFrame:
    rel = paths.relative_to(F.col("file_path"), root)
    return catalog.read().select(rel.alias("rel_path"), "file_type", "content")


@query(_EXTRACTED)
def extract_text(spark, sf_dir):
    """Batch ingest of real files: listing, rules, delta, extraction, commit."""
    root = write_tree(spark, sf_dir)
    path = new_table_path(spark, "catalog")
    run_ingest(spark, path, [root, root + "-missing"])
    return _catalog_texts(Catalog(spark, path), root)


@query(_EXTRACTED)
def stream_ingest(spark, sf_dir):
    """The same files through the stream, in two arrivals, the second with dates a month back; the
    result is that of the batch ingest."""
    root, path, state = None, new_table_path(spark, "catalog"), new_table_path(spark, "stream")
    for part, age in ((0, 0), (1, 30)):
        root = write_tree(spark, sf_dir, root, part, age)
        stream = start_ingest(spark, root, path, state, available_now=True)
        finish_ingest(stream, path)
    return _catalog_texts(Catalog(spark, path), root)


@query(_EXTRACTED)
def stream_changed_files(spark, sf_dir):
    """Files that arrive with an older text, change and so arrive again; the catalog has the new
    texts. One in three does not change."""
    path, state = new_table_path(spark, "catalog"), new_table_path(spark, "stream")
    older = F.when(F.col("doc_id") % 3 == 0, F.col("content")).otherwise(F.concat(F.lit("older "), "content"))
    root = write_tree(spark, sf_dir, content=older)
    for _ in range(2):
        finish_ingest(start_ingest(spark, root, path, state, available_now=True), path)
        write_tree(spark, sf_dir, root, where=F.col("doc_id") % 3 != 0)
    finish_ingest(start_ingest(spark, root, path, state, available_now=True), path)
    return _catalog_texts(Catalog(spark, path), root)


@query(_EXTRACTED)
def stream_triggers(spark, sf_dir):
    """The files through a running stream that looks every second, in two arrivals, each of them
    seen by a trigger of its own."""
    path, state = new_table_path(spark, "catalog"), new_table_path(spark, "stream")
    log = TriggerLog("stream-triggers")
    spark.streams.addListener(log)
    try:
        root = write_tree(spark, sf_dir, part=0)
        stream = start_ingest(spark, root, path, state, "stream-triggers", interval="1 second")
        for part in (0, 1):
            if not log.wait_for_rows(1 + part, timeout=600):
                raise TimeoutError("no trigger saw the files")
            if part == 0:
                write_tree(spark, sf_dir, root, part=1)
        finish_ingest(stream, path, stop=True)
    finally:
        spark.streams.removeListener(log)
    return _catalog_texts(Catalog(spark, path), root)


def _replayed(spark, sf_dir) -> tuple[Catalog, str]:
    """A catalog after the same micro-batch came twice, and its files once more as another one."""
    root = write_tree(spark, sf_dir)
    catalog = Catalog(spark, new_table_path(spark, "catalog")).ensure()
    # listed by tasks, into a table: a file source would hold the state of each file on the driver
    listed = files.walk(spark, [root], names=(), parts=()).withColumn("root", F.lit(root))
    listed = listed.withColumn("created_date", F.lit(None).cast("timestamp_ntz")).drop("unreadable")
    batch = listed.where(~paths.file_name(F.col("file_path")).startswith("."))
    run = ingest_batch(catalog, root, "stream")
    for batch_id in (0, 0, 1):
        run(batch, batch_id)
    return catalog, root


@query(_EXTRACTED)
def stream_replay(spark, sf_dir):
    return _catalog_texts(*_replayed(spark, sf_dir))


@query("WITH " + O.CATALOG + f""",
seen AS (SELECT {O.ACCEPTED} AS ok FROM catalog
         WHERE left(file_name, 1) <> '.' AND sub_dir <> '/.git/x')
SELECT 2 * count(*) FILTER (ok) AS scanned, count(*) FILTER (ok) AS indexed,
       count(*) FILTER (ok) AS skipped, 2 * count(*) FILTER (NOT ok) AS ignored,
       0::BIGINT AS error, 0::BIGINT AS deleted
FROM seen""")
def progress_totals(spark, sf_dir):
    """The counters of all micro-batches: a replay counts once."""
    catalog, _ = _replayed(spark, sf_dir)
    return progress.totals(progress.read(spark, f"{catalog.path}/progress"))


@query("WITH " + O.CATALOG + f""",
n AS (SELECT count(*) FILTER ({O.ACCEPTED}) AS ok, count(*) FILTER (NOT {O.ACCEPTED}) AS bad FROM catalog
      WHERE sub_dir NOT IN ('/Node_Modules', '/.git/x', '/x$Recycle.Bin2'))
SELECT false AS is_running, ok AS scanned, ok AS indexed, 0::BIGINT AS skipped, bad AS ignored,
       0::BIGINT AS error, 0::BIGINT AS deleted, 0::BIGINT AS unparsed,
       format('Checking documents: {{:,}} scanned ({{:,}} updated, 0 skipped)', ok, ok) AS status_message
FROM n""")
def progress_latest(spark, sf_dir):
    """What the status shows after a run."""
    root = write_tree(spark, sf_dir)
    path = new_table_path(spark, "catalog")
    run_ingest(spark, path, [root])
    return progress.latest(progress.read(spark, f"{path}/progress")).drop("at", "tag")


DOCS_PER_FILE = 1000


@query(f"""
WITH t AS (
  SELECT doc_id // {DOCS_PER_FILE} AS file_no, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS content
  FROM documents GROUP BY ALL)
SELECT file_no || '.txt' AS rel_path, length(content) AS n_chars, md5(content) AS content_md5 FROM t""")
def extract_long_text(spark, sf_dir):
    """A thousand documents in each file, millions of characters: texts are kept whole."""
    root = write_long_texts(spark, sf_dir, DOCS_PER_FILE)
    path = new_table_path(spark, "catalog")
    run_ingest(spark, path, [root])
    return _catalog_texts(Catalog(spark, path), root).select(
        "rel_path", F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("content_md5")
    )


@query(
    "WITH " + O.CATALOG + """
SELECT id, file_path, CASE WHEN doc_id % 5 = 0 THEN 'new ' ELSE '' END || content AS content
FROM catalog WHERE doc_id % 11 <> 0"""
)
def catalog_after_compact(spark, sf_dir):
    """All rows, then a change of some and a delete of others, each partition put together."""
    rows = T.catalog(spark, sf_dir)
    keyed = rows.withColumn("_id", paths.document_id(paths.norm_path(F.col("file_path"))))
    for field in DOCUMENT.fields:
        if field.name not in keyed.columns:
            keyed = keyed.withColumn(field.name, F.lit(None).cast(field.dataType))
    catalog = Catalog(spark, new_table_path(spark, "catalog"))
    catalog.apply(keyed.where("doc_id % 7 <> 0"), tag="one")
    changed = keyed.where("doc_id % 5 = 0").withColumn("content", F.concat(F.lit("new "), "content"))
    catalog.apply(changed.unionByName(keyed.where("doc_id % 7 = 0 and doc_id % 5 <> 0")), tag="two")
    catalog.apply(keyed.limit(0), keyed.where("doc_id % 11 = 0"), tag="three")
    catalog.compact()
    return catalog.read().select(F.col("_id").alias("id"), "file_path", "content")


@query(r"""
WITH texts AS (
  SELECT doc_id, list_filter(list_transform(
      string_split(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g'), chr(10)),
      lambda s: regexp_replace(s, '^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$', '', 'g')), lambda s: s <> '') AS ts
  FROM documents)
SELECT '/decks/' || doc_id || '.pptx' AS file_path,
       coalesce(ts[1], doc_id || '.pptx') AS title,
       coalesce(ts[2], '') AS subtitle, coalesce(ts[3], '') AS callout
FROM texts""")
def slide_cards(spark, sf_dir):
    """Title, subtitle and callout of one slide deck per document."""
    docs = spread(T.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        F.concat(F.lit("/decks/"), F.col("doc_id"), F.lit(".pptx")).alias("file_path"),
        F.lit(".pptx").alias("file_extension"),
        F.col("text").alias("content"),
    )
    return extract.slide_card(with_bytes(docs))
