"""Skew-safe joins, delta, mirror, folders: small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import delta, filters, folders, mirror, skew
from docloom.operators.artifacts import artifact_backlog, artifact_counters


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_is_the_plain_join(spark, how):
    other = (F.col("id") % 40).cast("string")
    many = spark.range(3000).select(
        F.col("id").alias("v"), F.when(F.col("id") % 3 == 0, "hot").otherwise(other).alias("k")
    )
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("1", 3), ("7", 4)], "k string, w int")
    got = skew.salted_join(many, few, ["k"], "v", how, min_rows=100)
    want = many.join(few, "k", how)
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_hot_key_is_spread(spark):
    many = spark.range(1000).select(F.col("id").alias("v"), F.lit("hot").alias("k"))
    hot = skew.hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", 100)
    salted = skew.add_salt(many, hot, ["k"], "v")
    sizes = [r["count"] for r in salted.groupBy("salt").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200
    assert skew.hot_threshold(10**13) * 10_000 >= 10**13  # so at most 10,000 hot keys


def listing(spark, data, root="/r"):
    df = spark.createDataFrame(data, "file_path string, file_size long, at string")
    return df.select(
        F.lit(root).alias("root"), "file_path", "file_size",
        F.col("at").cast("timestamp_ntz").alias("modified_date"),
    )


T1, T2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


def keyed(spark, data):
    return delta.with_keys(
        listing(spark, data), filters.accepted(F.col("file_path"), F.col("root"))
    )


SCAN = [
    ("/r/same.txt", 1, T1),
    ("/r/Size.txt", 2, T1),
    ("/r/time.txt", 1, T2),
    ("/r/new.md", 1, T1),
    ("/r/x.zip", 1, T1),
    ("/r/~tmp.md", 1, T1),
    ("/r/_under.txt", 1, T1),
    ("/r/.git/a.md", 1, T1),
    ("/r/sub/Node_Modules/deep/a.md", 1, T1),
    ("/r/bad.txt", None, T1),
]
INDEX = [
    ("/r/same.txt", 1, T1),
    ("/R/SIZE.txt", 1, T1),
    ("/r/time.txt", 1, T1),
    ("/r/Gone.txt", 1, T1),
    ("/other/kept.txt", 1, T1),
    ("/rest/kept.txt", 1, T1),
    ("/r/x.zip", 1, T1),
]


def index(spark):
    return delta.metadata(keyed(spark, INDEX))


def test_delta_statuses(spark):
    got = delta.delta(keyed(spark, SCAN), index(spark), ["/r"])
    assert dict(rows(got, "norm_path", "status")) == {
        "/r/same.txt": "skipped", "/r/size.txt": "indexed", "/r/time.txt": "indexed",
        "/r/new.md": "indexed", "/r/x.zip": "ignored", "/r/~tmp.md": "ignored",
        "/r/_under.txt": "indexed", "/r/.git/a.md": "ignored",
        "/r/sub/node_modules/deep/a.md": "ignored", "/r/bad.txt": "error",
        "/r/gone.txt": "ghost", "/other/kept.txt": "kept", "/rest/kept.txt": "kept",
    }
    counters = delta.run_counters(got).first().asDict()
    assert counters == {"scanned": 5, "indexed": 4, "skipped": 1, "ignored": 4, "error": 1, "deleted": 1}
    gone = delta.ghosts(keyed(spark, SCAN), index(spark), ["/R/"])
    assert rows(gone, "norm_path") == [("/r/gone.txt",)]


def test_force_indexes_all_and_deletes_none(spark):
    got = delta.delta(keyed(spark, SCAN), index(spark), ["/r"], force=True)
    status = dict(rows(got, "norm_path", "status"))
    assert status["/r/same.txt"] == "indexed" and status["/r/gone.txt"] == "kept"


def test_same_key_keeps_the_newest(spark):
    got = keyed(spark, [("/r/A.txt", 1, T1), ("/r/a.txt", 2, T2), ("/r/a.TXT", 3, T1)])
    assert rows(got, "file_path", "file_size") == [("/r/a.txt", 2)]


def test_excluded_part_matches_either_separator(spark):
    df = spark.createDataFrame(
        [("C:\\Windows\\a.txt",), ("/x/system volume information/a.txt",), ("/x/windowsill/a.txt",)],
        "p string",
    )
    got = [r[0] for r in df.select(filters.has_excluded_part(F.col("p"))).collect()]
    assert got == [True, True, False]


def test_root_itself_is_not_tested(spark):
    df = spark.createDataFrame([("/home/.git/build/a.txt", "/home/.git/build")], "p string, r string")
    assert df.select(filters.in_excluded_folder(F.col("p"), F.col("r"))).first()[0] is False


def mirror_sides(spark):
    def side(data):
        df = spark.createDataFrame(data, "rel_path string, at string, bytes long")
        return df.select("rel_path", F.col("at").cast("timestamp_ntz").alias("mtime"), "bytes")

    src = side([
        ("same", T1, 1), ("new", T1, 2), ("newer", T2, 3), ("older", T1, 4),
        ("near", "2024-01-01 00:00:02", 5), ("far", "2024-01-01 00:00:03", 6),
        ("DropboxBackup/x", T1, 7),
    ])
    dst = side([
        ("same", T1, 1), ("newer", T1, 3), ("older", T2, 4), ("near", T1, 5), ("far", T1, 6),
        ("extra", T1, 8), ("a/.dropbox.cache/y", T1, 9),
    ])
    return src, dst


def test_mirror_plan(spark):
    src, dst = mirror_sides(spark)
    folders_out = ("dropboxbackup", ".dropbox.cache")
    got = dict(rows(mirror.mirror_plan(src, dst, excluded_folders=folders_out), "rel_path", "action"))
    assert got == {
        "same": "SKIP", "new": "COPY", "newer": "COPY", "older": "SKIP", "near": "SKIP",
        "far": "COPY", "extra": "DELETE",
    }
    strict = dict(rows(mirror.mirror_plan(src, dst, mirror=False), "rel_path", "action"))
    assert strict["near"] == "COPY" and strict["extra"] == "EXTRA" and strict["older"] == "SKIP"


def test_backup_columns(spark):
    docs = spark.createDataFrame([("/a/x.txt", ".txt"), ("/a/x.csv", ".csv")], "file_path string, file_extension string")
    assert rows(mirror.with_backup(docs, "/bk"), "is_backed_up", "backup_path") == [
        (False, None), (True, "/bk/a/x.txt"),
    ]
    assert rows(mirror.with_backup(docs, None), "is_backed_up", "backup_path") == [(False, None)] * 2


def test_artifact_backlog(spark):
    idx = spark.createDataFrame(
        [("/a.pdf", "pdf"), ("/b.PDF", "PDF"), ("/c.epub", "epub"), ("/d.txt", "txt"), ("/e.md", None)],
        "norm_path string, file_type string",
    )
    on_disk = idx.where("norm_path <> '/d.txt'").select("norm_path")
    made = idx.where("norm_path = '/a.pdf'").select(F.md5("norm_path").alias("artifact_key"))
    got = artifact_backlog(idx, on_disk, made)
    assert dict(rows(got, "norm_path", "status")) == {
        "/a.pdf": "skipped", "/b.PDF": "todo", "/c.epub": "skipped", "/d.txt": "missing", "/e.md": "skipped",
    }
    assert artifact_counters(got).first().asDict() == {"todo": 1, "skipped": 3, "missing": 1}


def test_folder_listing(spark):
    paths = ["/r/b/x.txt", "/r/A/y/z.txt", "/r/.hid/x", "/r/Windows/x", "/r/top.txt", "/rr/no/x"]
    df = spark.createDataFrame([(p,) for p in paths], "file_path string")
    assert [tuple(r) for r in folders.folder_listing(df, "/r/").collect()] == [("A", "/r/A"), ("b", "/r/b")]


def test_running_state_goes_stale(spark):
    df = spark.createDataFrame(
        [(True, "2024-01-01 00:00:00"), (True, "2024-01-01 00:00:01"), (False, "2024-01-01 00:01:59")],
        "r boolean, at string",
    )
    now = F.lit("2024-01-01 00:02:00").cast("timestamp")
    fresh = filters.is_fresh(F.col("r"), F.col("at").cast("timestamp"), now)
    assert [r[0] for r in df.select(fresh).collect()] == [False, True, False]
