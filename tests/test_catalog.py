"""The catalog table, the batch ingest and the stream over it."""

import glob
import hashlib
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import paths
from docloom.plans.ingest import document_rows, run_ingest
from docloom.schema import DOCUMENT
from docloom.sources import progress
from docloom.sources.arrivals import ArrivalReader
from docloom.sources.catalog import Catalog, in_rounds
from docloom.sources.files import listing_of_binary
from docloom.sources.partitioned import PartitionedTable
from docloom.streaming.ingest import TriggerLog, finish_ingest, ingest_batch, start_ingest
from test_files import put


def docs(spark, pairs):
    """Catalog rows from ``(path, content)``."""
    df = spark.createDataFrame(pairs, "file_path string, content string")
    listing = df.select(
        paths.document_id(paths.norm_path(F.col("file_path"))).alias("_id"), "file_path", "content",
        F.length("content").cast("long").alias("file_size"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("modified_date"),
        F.lit(None).cast("timestamp_ntz").alias("created_date"),
    )
    return document_rows(listing)


def contents(catalog):
    return {r.file_path: r.content for r in catalog.read().collect()}


def sha(n):
    return hashlib.sha256(str(n).encode()).hexdigest()


def files_of(path, prefix=None):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/rows/prefix={prefix or '*'}/*.parquet")}


def test_upsert_delete_replay_compact(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "cat"))
    assert not catalog.exists() and catalog.read().count() == 0
    catalog.ensure().ensure()
    assert catalog.exists() and catalog.read().schema == DOCUMENT and catalog.read().count() == 0

    catalog.apply(docs(spark, [("/a.txt", "1"), ("/b.txt", "1"), ("/c.txt", "1")]), tag="one")
    catalog.apply(docs(spark, [("/A.txt", "2"), ("/d.txt", "2")]), tag="two")
    dead = docs(spark, [("/b.txt", "")])
    catalog.apply(docs(spark, [("/a.txt", "3")]), dead, tag="three")
    want = {"/a.txt": "3", "/c.txt": "1", "/d.txt": "2"}
    assert contents(catalog) == want
    assert catalog.applied("one") and catalog.applied("three") and not catalog.applied("four")

    ids = [r._id for r in docs(spark, [("/a.txt", ""), ("/c.txt", ""), ("/b.txt", "")]).collect()]
    assert {r.file_path for r in catalog.read(ids).collect()} == {"/a.txt", "/c.txt"}
    assert catalog.read([]).count() == 0

    # a change that is applied again changes nothing
    catalog.apply(docs(spark, [("/a.txt", "3")]), dead, tag="three")
    assert contents(catalog) == want
    catalog.compact()
    assert contents(catalog) == want and len(files_of(catalog.path)) == len(catalog.rows.parts())
    catalog.apply(docs(spark, [("/b.txt", "back")]), tag="four")
    assert contents(catalog) == want | {"/b.txt": "back"}
    gone = docs(spark, [(p, "") for p in ("/a.txt", "/b.txt", "/c.txt", "/d.txt")])
    catalog.apply(docs(spark, []), gone, tag="five")
    assert contents(catalog) == {} and catalog.rows.parts() == []


def test_a_change_rewrites_its_partitions_only(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "cat"), prefix_chars=1)
    catalog.apply(docs(spark, [(f"/f{i}.txt", str(i)) for i in range(200)]), tag="one")
    assert catalog.prefix_chars == 1 and Catalog(spark, catalog.path).prefix_chars == 1
    before = files_of(catalog.path)
    one = docs(spark, [("/f7.txt", "new")])
    touched = one.first()._id[0]
    catalog.apply(one, tag="two")
    after = files_of(catalog.path)
    changed = {f for f in before.keys() ^ after.keys()} | {f for f in before.keys() & after.keys() if before[f] != after[f]}
    assert changed and all(f"prefix={touched}/" in f for f in changed)
    # new keys are added beside the files there are
    catalog.apply(docs(spark, [("/more.txt", "more")]), tag="three")
    assert after.items() <= files_of(catalog.path).items()
    want = {f"/f{i}.txt": str(i) for i in range(200)} | {"/f7.txt": "new", "/more.txt": "more"}
    assert contents(catalog) == want


def test_changed_keys_in_rounds(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "cat"), prefix_chars=1)
    catalog.apply(docs(spark, [(f"/f{i}.txt", str(i)) for i in range(60)]), tag="one")
    changed = docs(spark, [(f"/f{i}.txt", "new") for i in range(0, 60, 2)])
    dead = docs(spark, [(f"/f{i}.txt", "") for i in range(1, 60, 4)])
    catalog.apply(changed, dead, tag="two", keys_at_once=5)  # some groups hold more: joined by shuffle
    assert contents(catalog) == {
        f"/f{i}.txt": "new" if i % 2 == 0 else str(i) for i in range(60) if i % 4 != 1
    }
    assert list(in_rounds({"a": 3, "b": 3, "c": 9, "d": 1}, 5)) == [["a"], ["b"], ["c"], ["d"]]
    assert list(in_rounds({"a": 3, "b": 2, "c": 1}, 5)) == [["a", "b"], ["c"]]


def test_old_texts_are_not_shuffled(spark, tmp_path, monkeypatch):
    """With Spark's own broadcasts off, no exchange of a change carries an old text."""
    catalog = Catalog(spark, str(tmp_path / "cat"), prefix_chars=1)
    catalog.apply(docs(spark, [(f"/f{i}.txt", str(i)) for i in range(40)]), tag="one")
    plans = []
    replace = type(catalog.rows).replace

    def seen(table, parts, rows, sort=()):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return replace(table, parts, rows, sort)

    monkeypatch.setattr(type(catalog.rows), "replace", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        catalog.apply(docs(spark, [("/f3.txt", "new")]), docs(spark, [("/f4.txt", "")]), tag="two")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans and all("Exchange hashpartitioning" not in p and "BroadcastExchange" in p for p in plans)


def test_a_few_keys_read_their_row_groups(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "t"), "_id string, n bigint, prefix string", key="_id").create()
    table.options |= {"parquet.block.size": "20000", "parquet.block.size.row.check.min": "100", "parquet.page.size": "2000"}
    # keys in no order: the least and greatest key of every row group say nothing
    table.append(spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("_id"), F.col("id").alias("n"), F.lit("x").alias("prefix")).coalesce(1), ["n"])
    wanted = table.read(["x"]).where(F.col("_id") == sha(77))

    def scanned(df):
        df.collect()
        found = re.search(r"Location: .*", df._jdf.queryExecution().executedPlan().treeString())
        assert found
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return leaf.metrics().get("numOutputRows").get().value()

    assert scanned(table.read(["x"])) == 5000
    assert 0 < scanned(wanted) < 2500
    assert [r.n for r in wanted.collect()] == [77]


def tree(root):
    put(root, "a.txt", b"alpha")
    put(root, "sub dir/B.md", b"beta")
    put(root, "sub dir/c.csv", b"no document")
    put(root, ".git/d.md", b"hidden")
    put(root, "e.pdf", b"%PDF")


def counters(df):
    return df.first().asDict()


def zero(**kw):
    return dict.fromkeys(("scanned", "indexed", "skipped", "ignored", "error", "deleted"), 0) | kw


def test_ingest_runs(spark, tmp_path):
    root, other = str(tmp_path / "root"), str(tmp_path / "other")
    path = str(tmp_path / "cat")
    tree(root)
    put(other, "o.txt", b"other")
    roots = [root, other, str(tmp_path / "missing")]
    catalog = Catalog(spark, path)

    first = run_ingest(spark, path, roots, backup_root="/bk")
    assert counters(first) == zero(scanned=4, indexed=4, ignored=1)
    got = contents(catalog)
    assert got == {
        f"{root}/a.txt": "alpha", f"{root}/sub dir/B.md": "beta", f"{root}/e.pdf": "",
        f"{other}/o.txt": "other",
    }
    row = catalog.read().where("file_name = 'B.md'").first()
    assert (row.file_type, row.file_extension, row.file_size) == ("md", ".md", 4)
    assert row.is_backed_up and row.backup_path == f"/bk{root}/sub dir/B.md"
    assert row.file_directory == f"{root}/sub dir" and len(row._id) == 64

    # nothing changed
    assert counters(run_ingest(spark, path, roots)) == zero(scanned=4, skipped=4, ignored=1)

    # changed, new, deleted; one root unreachable
    put(root, "a.txt", b"alpha two")
    put(root, "new.txt", b"new")
    os.rename(f"{root}/e.pdf", f"{root}/e.gone")
    os.rename(other, other + "-away")
    third = run_ingest(spark, path, roots)
    assert counters(third) == zero(scanned=3, indexed=2, skipped=1, ignored=2, deleted=1)
    assert contents(catalog) == {
        f"{root}/a.txt": "alpha two", f"{root}/sub dir/B.md": "beta", f"{root}/new.txt": "new",
        f"{other}/o.txt": "other",
    }

    # force: all again, nothing deleted
    os.rename(f"{root}/new.txt", f"{root}/new.gone")
    assert counters(run_ingest(spark, path, roots, force=True)) == zero(scanned=2, indexed=2, ignored=3)
    assert f"{root}/new.txt" in contents(catalog)
    assert len(contents(catalog)) == 4

    records = progress.read(spark, f"{path}/progress")
    assert records.count() == 4
    last = progress.latest(records).first()
    assert last.scanned == 2 and last.status_message == "Checking documents: 2 scanned (2 updated, 0 skipped)"
    assert progress.running(records, F.current_timestamp()).first().is_running is False


def test_stream_equals_batch(spark, tmp_path):
    root = str(tmp_path / "root")
    tree(root)
    put(root, "SHOUT.TXT", b"loud")
    for i in range(45):
        put(root, f"many/f{i}.txt", f"text {i}".encode())

    def run_stream():
        q = start_ingest(
            spark, root, str(tmp_path / "s"), str(tmp_path / "chk"), available_now=True
        )
        q.awaitTermination()

    run_stream()
    run_ingest(spark, str(tmp_path / "b"), [root])
    streamed, batch = Catalog(spark, str(tmp_path / "s")), Catalog(spark, str(tmp_path / "b"))
    assert contents(streamed) == contents(batch) and len(contents(batch)) == 49
    records = progress.read(spark, str(tmp_path / "s" / "progress"))
    assert records.count() == 1  # all that was there
    assert progress.totals(records).first().indexed == 49
    assert progress.running(records, F.current_timestamp()).first().is_running is True

    # the batch ingest over the streamed catalog finds nothing to do
    again = run_ingest(spark, str(tmp_path / "s"), [root])
    assert counters(again) == zero(scanned=49, skipped=49, ignored=1)

    # a new file arrives; a second start delivers only that
    put(root, "late.txt", b"late")
    run_stream()
    assert contents(streamed)[f"{root}/late.txt"] == "late"

    # replay of a committed batch, and of known files under a new tag: nothing changes
    before, there = contents(streamed), files_of(streamed.path)
    listing = listing_of_binary(spark.read.format("binaryFile").load(f"{root}/many"), root)
    replay = ingest_batch(streamed, root, "stream")
    replay(listing, 0)
    replay(listing, 1000)
    assert contents(streamed) == before and files_of(streamed.path) == there


def test_stream_takes_files_that_change(spark, tmp_path):
    root, path, state = (str(tmp_path / x) for x in ("r", "cat", "state"))

    def run():
        finish_ingest(start_ingest(spark, root, path, state, available_now=True), path)
        return {os.path.relpath(p, root): t for p, t in contents(Catalog(spark, path)).items()}

    put(root, "sub/a.txt", b"first")
    put(root, "b.txt", b"stays")
    assert run() == {"sub/a.txt": "first", "b.txt": "stays"}
    put(root, "sub/a.txt", b"second, longer")
    assert run() == {"sub/a.txt": "second, longer", "b.txt": "stays"}
    # a folder moved in with its old files, and a hidden one
    put(str(tmp_path), "away/deep/c.txt", b"moved")
    for f in ("away/deep/c.txt", "away/deep", "away"):
        os.utime(tmp_path / f, (1_000_000_000, 1_000_000_000))
    put(root, ".hid/d.txt", b"hidden")
    assert run() == {"sub/a.txt": "second, longer", "b.txt": "stays"}
    os.rename(tmp_path / "away", f"{root}/sub/in")
    assert run() == {"sub/a.txt": "second, longer", "b.txt": "stays", "sub/in/deep/c.txt": "moved"}
    before = progress.read(spark, f"{path}/progress").count()
    assert len(run()) == 3 and progress.read(spark, f"{path}/progress").count() == before


def test_a_running_stream_looks_at_each_interval(spark, tmp_path):
    root, path, state = (str(tmp_path / x) for x in ("r", "cat", "state"))
    put(root, "a.txt", b"one")
    log = TriggerLog("looks")
    spark.streams.addListener(log)
    try:
        query = start_ingest(spark, root, path, state, "looks", interval="500 milliseconds")
        assert log.wait_for_rows(1, timeout=120)
        put(root, "b.txt", b"two")
        assert log.wait_for_rows(2, timeout=120)
        put(root, "c.txt", b"three")
        finish_ingest(query, path, stop=True)
    finally:
        spark.streams.removeListener(log)
    assert not query.isActive
    assert sorted(contents(Catalog(spark, path)).values()) == ["one", "three", "two"]
    triggers = [t for t in log.triggers if t.rows]
    assert len(triggers) >= 2 and triggers == sorted(triggers, key=lambda t: t.batch_id)
    assert progress.latest(progress.read(spark, f"{path}/progress")).first().is_running is False


def test_arrivals_are_listed_once_in_each_window(tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    for i in range(12):
        for j in range(3):
            put(root, f"d{i}/e{j}/f.txt")
    put(root, "top.txt")
    put(root, ".git/x.txt")
    reader = ArrivalReader(root)
    time.sleep(0.02)  # offsets are whole milliseconds
    end = reader.latestOffset()

    def found(start, end):
        return sorted(os.path.relpath(r[1], root) for p in reader.partitions(start, end) for r in reader.read(p))

    want = sorted(["top.txt", *(f"d{i}/e{j}/f.txt" for i in range(12) for j in range(3))])
    assert found(reader.initialOffset(), end) == want and found(end, end) == []
    assert len(reader.partitions(reader.initialOffset(), end)) > 12
    for limits in ({"MIN_FOLDERS": 1}, {"MAX_ENTRIES": 5}, {"MAX_PARTITIONS": 2}, {"MIN_FOLDERS": 1000}):
        with monkeypatch.context() as m:
            for k, v in limits.items():
                m.setattr(f"docloom.sources.arrivals.{k}", v)
            assert found(reader.initialOffset(), end) == want
    time.sleep(0.02)
    put(root, "d3/e1/f.txt", b"again")
    assert found(end, reader.latestOffset()) == ["d3/e1/f.txt"]


@pytest.mark.parametrize("form", ["{0}//", "{1}/./docs", "{1}/x/../docs", "file:{0}", "{0}/"])
def test_roots_in_any_form_lose_deleted_files(spark, tmp_path, form):
    root, path = str(tmp_path / "docs"), str(tmp_path / "cat")
    os.makedirs(tmp_path / "x")
    put(root, "a.txt")
    gone = put(root, "b.txt")
    given = form.format(root, tmp_path)
    assert counters(run_ingest(spark, path, [given])) == zero(scanned=2, indexed=2)
    os.rename(gone, tmp_path / "b.away")
    assert counters(run_ingest(spark, path, [given])) == zero(scanned=1, skipped=1, deleted=1)


def test_unreadable_folders_keep_their_documents(spark, tmp_path):
    from docloom.operators import delta as D

    index = docs(spark, [(p, "") for p in ("/r/blind/a.txt", "/r/blind/deep/b.txt", "/r/blinded/c.txt", "/r/d.txt")])
    listing = spark.createDataFrame(
        [("/r", "/r/Blind", None, True)], "root string, file_path string, file_size long, unreadable boolean"
    ).withColumn("modified_date", F.lit(None).cast("timestamp_ntz"))
    scan = D.with_keys(listing, F.col("unreadable"))
    statuses = D.delta(scan, D.metadata(index), ["/r"])
    got = {r.norm_path: r.status for r in D.protect(statuses, statuses.where("unreadable")).collect()}
    assert got == {
        "/r/blind": "error", "/r/blind/a.txt": "kept", "/r/blind/deep/b.txt": "kept",
        "/r/blinded/c.txt": "ghost", "/r/d.txt": "ghost",
    }


def test_a_folder_without_a_name_loses_nothing(spark, tmp_path):
    root, path = str(tmp_path / "r"), str(tmp_path / "cat")
    put(root, "a.txt")
    put(root, "caf\ufffd/b.txt")
    run_ingest(spark, path, [root])
    os.rename(root + "/caf\ufffd", os.fsencode(root) + b"/caf\xe9")
    assert counters(run_ingest(spark, path, [root])) == zero(scanned=1, skipped=1, error=1)
    assert len(contents(Catalog(spark, path))) == 2


def test_stream_takes_files_with_old_dates(spark, tmp_path):
    root, path, state = (str(tmp_path / x) for x in ("r", "cat", "state"))

    def run():
        start_ingest(spark, root, path, state, available_now=True).awaitTermination()
        return sorted(os.path.basename(p) for p in contents(Catalog(spark, path)))

    put(root, "new.txt")
    assert run() == ["new.txt"]
    old = put(root, "old.txt")
    os.utime(old, (1_000_000_000, 1_000_000_000))
    put(root, "newer.txt")
    assert run() == ["new.txt", "newer.txt", "old.txt"]


def test_runs_leave_no_tables_behind(spark, tmp_path):
    from docloom.session import work_folder

    root = str(tmp_path / "r")
    tree(root)
    before = set(os.listdir(work_folder(spark)))
    run_ingest(spark, str(tmp_path / "cat"), [root]).collect()
    stream = start_ingest(spark, root, str(tmp_path / "s"), str(tmp_path / "chk"), available_now=True)
    finish_ingest(stream, str(tmp_path / "s"))
    left = {x for x in set(os.listdir(work_folder(spark))) - before if not x.startswith(("rdd-", "."))}
    assert not {x for x in left if x.startswith("run-")} and len(left) <= 1  # Spark's own checkpoint folder
    records = progress.read(spark, str(tmp_path / "s" / "progress"))
    assert progress.latest(records).first().is_running is False


def test_whole_texts_in_batch_and_stream(spark, tmp_path):
    root = str(tmp_path / "r")
    text = "word " * 210_000 + "last"
    put(root, "long.txt", text.encode())
    run_ingest(spark, str(tmp_path / "a"), [root])
    start_ingest(spark, root, str(tmp_path / "b"), str(tmp_path / "s"), available_now=True).awaitTermination()
    for name in "ab":
        assert list(contents(Catalog(spark, str(tmp_path / name))).values()) == [text]


def test_filters_of_keys_are_as_large_as_their_files_need(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.apply(docs(spark, [(f"/r/{i}.txt", "text") for i in range(50)]), tag="one")
    files = files_of(catalog.path)
    assert files and max(os.path.getsize(f) for f in files) < 100_000
    assert catalog.read([sha(f"/r/{i}.txt") for i in range(3)]).count() == 3


def test_each_key_range_is_a_task_of_its_own(spark, tmp_path):
    from docloom.sources.catalog import cluster

    rows = docs(spark, [(f"/r/{i}.txt", "text") for i in range(600)])
    tasks = {r["task"]: r["count"] for r in cluster(rows, 12).groupBy(F.spark_partition_id().alias("task")).count().collect()}
    assert len(tasks) == 12 and max(tasks.values()) < 90  # dealt by hash, some would have two or three ranges
