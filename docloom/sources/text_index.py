"""The text index behind a search, either stored or computed from the documents on the fly.

Both kinds answer the same three calls: ``lookup(terms)``, ``term_stats(terms)`` and
``field_stats()``.

A stored index is four plain Parquet tables. ``docs`` holds the term counts of each document, by a
hash of its key; ``postings`` and ``term_stats`` are partitioned by a hash bucket of the term and
sorted by term inside the files, so a lookup of a few terms reads a few buckets and, in them, the row
groups whose term range fits; ``field_stats`` has a row per field. A change replaces the partitions
that it touches: the buckets with a term of a changed document, old or new, without its old postings
and with its new ones; statistics are counted again from those. ``docs`` is written last, so a
change that failed half way is found and applied again.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import postings as P
from docloom.operators.skew import HOT_MIN_ROWS, add_salt, hot_keys, hot_threshold
from docloom.session import new_table_path, run_folder, shuffles_removed
from docloom.sources.partitioned import PartitionedTable

#: Default number of buckets: one per so many postings, within limits.
ROWS_PER_BUCKET, MIN_BUCKETS, MAX_BUCKETS = 20_000_000, 16, 8192
#: Postings that one task sorts and writes, and the bytes of files with about so many.
ROWS_PER_TASK, BYTES_PER_TASK = 2_000_000, 8 << 20
#: Rounds in which the postings of a new index are shuffled, a share of the buckets in each.
ROUNDS = 4
#: Keys of changed documents are broadcast below this size.
BROADCAST_BYTES, KEY_BYTES = 64 << 20, {"bigint": 32, "int": 32}

#: Parts of the table of documents for each bucket of terms.
DOC_PARTS_PER_BUCKET = 1

_INFO = "buckets int, total_postings bigint, id_type string"


def _schemas(id_type: str) -> dict[str, str]:
    """Schemas by table, so that opening an index reads no file footers."""
    return {
        "postings": f"doc_id {id_type}, field string, term string, tf bigint, dl bigint, bucket int",
        "term_stats": "field string, term string, df bigint, bucket int",
        "docs": f"doc_id {id_type}, field string, dl bigint, counts array<struct<term: string, tf: bigint>>, "
        "stamp bigint, part int",
        "field_stats": "field string, n bigint, total_dl bigint",
    }


def bucket_of(term: Column, buckets: int) -> Column:
    """A checksum both Spark and the driver know, so a lookup needs no job to find it."""
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


class CountedIndex:
    """Index facts of a few terms, from a table ``(doc_id, field, dl, counts)``."""

    def __init__(self, counts: DataFrame):
        self.counts = counts

    def for_terms(self, terms: Sequence[str]) -> CountedIndex:
        return self

    def lookup(self, terms: Sequence[str]) -> DataFrame:
        wanted = F.col("term").isin(*terms) if terms else F.lit(False)
        return P.unpack(self.counts).where(wanted)

    def term_stats(self, terms: Sequence[str]) -> DataFrame:
        return P.term_stats(self.lookup(terms))

    def field_stats(self) -> DataFrame:
        return P.field_stats(self.counts)


class ScannedIndex:
    """Search without a stored index: ``docs`` (``doc_id`` and the text fields) are scanned once
    per query. What the query needs of them - field lengths and the counts of its own terms -
    is kept as a narrow table, which then serves the statistics and the lookups."""

    def __init__(self, docs: DataFrame):
        self.docs = docs

    def for_terms(self, terms: Sequence[str]) -> CountedIndex:
        path = new_table_path(self.docs.sparkSession, "counts")
        P.counts_of_terms(self.docs, list(terms)).write.parquet(path)
        return CountedIndex(self.docs.sparkSession.read.parquet(path))


class StoredIndex:
    """The index written by :func:`write_index` and kept up by :func:`update_index`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        info = spark.read.schema(_INFO).parquet(f"{self.path}/info").first()  # one row
        self.buckets, self.total_postings, self.id_type = info["buckets"], info["total_postings"], info["id_type"]
        # Listed once: files and schemas are then known to every search.
        self._rows = {name: t.read() for name, t in self.tables().items()}
        self._fields = spark.read.schema(_schemas(self.id_type)["field_stats"]).parquet(f"{self.path}/field_stats")

    def tables(self) -> dict[str, PartitionedTable]:
        schemas = _schemas(self.id_type)
        return {n: PartitionedTable(self.spark, f"{self.path}/{n}", schemas[n]) for n in ("postings", "term_stats", "docs")}

    def _of_terms(self, terms: Sequence[str]) -> Column:
        wanted = sorted(set(terms))
        if not wanted:
            return F.lit(False)
        buckets = sorted({zlib.crc32(t.encode("utf-8")) % self.buckets for t in wanted})
        in_bucket = F.col("bucket").isin(*buckets) & F.col("term").isin(*wanted)
        return in_bucket & F.col("field").isin(*P.TEXT_FIELDS)

    def for_terms(self, terms: Sequence[str]) -> StoredIndex:
        return self

    def postings(self) -> DataFrame:
        """All postings, with their ``bucket``."""
        return self._rows["postings"]

    def counts(self) -> DataFrame:
        return self._rows["docs"].drop("stamp", "part")

    def stamps(self) -> DataFrame:
        """``(doc_id, stamp)`` of the documents as they were indexed."""
        return self._rows["docs"].where(F.col("field") == P.ALL_FIELD).select("doc_id", "stamp")

    def with_bucket(self, terms: DataFrame) -> DataFrame:
        return terms.withColumn("bucket", bucket_of(F.col("term"), self.buckets))

    def with_keyword(self, field: str, values: Sequence[str]) -> DataFrame:
        """``doc_id`` of the documents with one of the values in a keyword field."""
        buckets = sorted({zlib.crc32(v.encode("utf-8")) % self.buckets for v in values})
        wanted = F.col("bucket").isin(*buckets) & F.col("term").isin(*sorted(set(values)))
        return self.postings().where(wanted & (F.col("field") == field)).select("doc_id")

    def all_term_stats(self) -> DataFrame:
        return self._rows["term_stats"].drop("bucket")

    def lookup(self, terms: Sequence[str]) -> DataFrame:
        return self.postings().where(self._of_terms(terms)).drop("bucket")

    def term_stats(self, terms: Sequence[str]) -> DataFrame:
        return self._rows["term_stats"].where(self._of_terms(terms)).drop("bucket")

    def field_stats(self) -> DataFrame:
        return self._fields.select("field", "n", (F.col("total_dl") / F.col("n")).alias("avgdl"))


def stamp_of(docs: DataFrame) -> Column:
    """What tells one state of a document from another: all of its columns but the text."""
    return F.xxhash64(*sorted(c for c in docs.columns if c not in ("doc_id", "content")))


def _doc_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Counts and stamp of each document, as they fall out of the scan."""
    counts = P.index_counts(docs, "stamp") if "stamp" in docs.columns else P.index_counts(docs.withColumn("stamp", stamp_of(docs)), "stamp")
    return counts.withColumn("part", _doc_part(buckets))


def _doc_part(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets * DOC_PARTS_PER_BUCKET)).cast("int")


def write_index(
    docs: DataFrame,
    path: str,
    buckets: int | None = None,
    hot_min_rows: int = HOT_MIN_ROWS,
) -> StoredIndex:
    """Tokenise ``docs`` once and store postings and statistics under ``path``.

    1. The counts of every document are kept as they fall out of the scan, one row per
       document and field: no shuffle, and the texts are read only here.
    2. Statistics are aggregated from that table.
    3. Postings are shuffled once into their final place, ``(bucket, salt)``: a term that holds
       a third of all rows is spread over many tasks and files. Each of a few rounds takes its share
       of the buckets, and its shuffle files go before the next: they hold a part of the postings.

    An index is complete once its ``info`` table is; what a failed build left at ``path`` is
    replaced.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    schemas = _schemas(id_type)
    docs_path = f"{path}/docs"
    with shuffles_removed(spark):
        with run_folder(spark):  # what is counted goes once it is parted
            counted = f"{new_table_path(spark, 'counts')}"
            _doc_rows(docs, 1).drop("part").write.parquet(counted)
            counts = spark.read.schema(schemas["docs"].removesuffix(", part int")).parquet(counted)
            total = counts.agg(F.sum(F.size("counts"))).first()[0] or 0
            if buckets is None:
                buckets = min(max(total // ROWS_PER_BUCKET, MIN_BUCKETS), MAX_BUCKETS)
            parted = counts.withColumn("part", _doc_part(buckets)).sortWithinPartitions("part", "doc_id")
            parted.coalesce(_tasks_of(spark, buckets)).write.mode("overwrite").partitionBy("part").parquet(docs_path)
        counts = spark.read.schema(schemas["docs"]).parquet(docs_path)
        stats = P.term_stats(P.unpack(counts)).withColumn("bucket", bucket_of(F.col("term"), buckets))
        _write_stats(stats, f"{path}/term_stats")
        rounds = min(ROUNDS, buckets)
        for i in range(rounds):
            here = P.unpack(counts).where(bucket_of(F.col("term"), buckets) % rounds == i)
            dealt = _dealt(here, spark, path, id_type, buckets, total, hot_min_rows)
            ordered = dealt.sortWithinPartitions("bucket", "term", "doc_id")
            ordered.write.mode("append" if i else "overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        return _finish(spark, path, id_type, buckets)


def _tasks_of(spark: SparkSession, buckets: int) -> int:
    return max(buckets, spark.sparkContext.defaultParallelism)


def _write_stats(stats: DataFrame, path: str) -> None:
    ordered = stats.repartition("bucket").sortWithinPartitions("bucket", "term")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _dealt(postings, spark, path, id_type, buckets, total, hot_min_rows) -> DataFrame:
    """Postings in their final place, hot terms of the stored statistics spread by document."""
    stats = spark.read.schema(_schemas(id_type)["term_stats"]).parquet(f"{path}/term_stats")
    hot = hot_keys(stats.drop("bucket"), ["field", "term"], "df", hot_threshold(total, hot_min_rows))
    # a bucket is the work of several tasks, by term
    shares = max(total // (buckets * ROWS_PER_TASK), 1)
    return (
        add_salt(postings, hot, ["field", "term"], "doc_id")
        .withColumn("bucket", bucket_of(F.col("term"), buckets))
        .repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(shares)), "salt")
        .drop("salt")
    )


def _finish(spark: SparkSession, path: str, id_type: str, buckets: int) -> StoredIndex:
    """The statistics of the fields and the closing row, from the stored documents."""
    docs = spark.read.schema(_schemas(id_type)["docs"]).parquet(f"{path}/docs")
    text = F.col("field").isin(*P.TEXT_FIELDS) & (F.col("dl") > 0)
    sums = docs.groupBy("field").agg(
        F.count_if(text).alias("n"), F.sum(F.when(text, F.col("dl")).otherwise(0)).alias("total_dl"), F.sum(F.size("counts")).alias("rows")
    ).collect()  # a row per field
    lengths = [(r["field"], r["n"], r["total_dl"]) for r in sums if r["n"]]
    spark.createDataFrame(lengths, "field string, n bigint, total_dl bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/field_stats")
    info = [(buckets, sum(r["rows"] for r in sums), id_type)]
    spark.createDataFrame(info, _INFO).coalesce(1).write.mode("overwrite").parquet(f"{path}/info")
    return StoredIndex(spark, path)


def update_index(index: StoredIndex, changed: DataFrame, gone: DataFrame, hot_min_rows: int = HOT_MIN_ROWS) -> StoredIndex:
    """The index after a change, in place: only ``changed`` is tokenised, and only the partitions
    that hold a term of a changed document are read and written. Old rows are parted from changed
    documents by a broadcast of their keys, counted before, and stay in the order in which they are
    stored; only the rows of changed documents are shuffled. More keys than that are joined.

    ``changed`` holds new and changed documents, ``gone`` the ``doc_id`` of deleted ones.
    """
    spark, tables, buckets = index.spark, index.tables(), index.buckets
    with run_folder(spark):

        def kept(rows: DataFrame, name: str) -> DataFrame:
            path = new_table_path(spark, name)
            rows.write.parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        new = kept(_doc_rows(changed, buckets), "counts")
        keys = kept(changed.select("doc_id").unionByName(gone.select("doc_id")).distinct(), "keys")
        few = keys.count() * KEY_BYTES.get(index.id_type, 128) <= BROADCAST_BYTES
        keys = F.broadcast(keys) if few else keys
        old = kept(tables["docs"].read().join(keys, "doc_id", "left_semi"), "old")
        in_bucket = bucket_of(F.col("term"), buckets).alias("bucket")

        def buckets_of(counts: DataFrame) -> set[int]:
            return {r["bucket"] for r in P.unpack(counts).select(in_bucket).distinct().collect()}

        before, after = buckets_of(old), buckets_of(new)
        fresh = P.unpack(new).withColumn("bucket", in_bucket)
        if before:
            touched = sorted(before)
            here = fresh.where(F.col("bucket").isin(*touched))

            def dealt(rows: DataFrame) -> DataFrame:
                rows = rows.select(*P.POSTING_COLUMNS)
                return _dealt(rows, spark, index.path, index.id_type, buckets, index.total_postings, hot_min_rows)

            if few:
                rest = tables["postings"].read_for_rewrite(touched, BYTES_PER_TASK).join(keys, "doc_id", "left_anti")
                both = rest.unionByName(dealt(here))
            else:
                both = dealt(tables["postings"].read(touched).join(keys, "doc_id", "left_anti").unionByName(here))
            tables["postings"].replace(touched, both, ["term", "doc_id"])
        added = sorted(after - before)
        if added:
            tables["postings"].append(fresh.where(F.col("bucket").isin(*added)), ["term", "doc_id"])
        every = sorted(before | after)
        if every:
            counted = tables["postings"].read(every).groupBy("field", "term", "bucket").agg(F.count(F.lit(1)).alias("df"))
            counted = counted.select("field", "term", "df", "bucket")
            tables["term_stats"].replace(every, counted.repartition("bucket"), ["term"])
        parts = sorted(r["part"] for r in old.select("part").distinct().collect())
        if parts:
            rest = tables["docs"].read_for_rewrite(parts).join(keys, "doc_id", "left_anti")
            tables["docs"].replace(parts, rest.unionByName(new.where(F.col("part").isin(*parts))), ["doc_id"])
        more = new.where(~F.col("part").isin(*parts)) if parts else new
        tables["docs"].append(more, ["doc_id"])
    return _finish(spark, index.path, index.id_type, buckets)
