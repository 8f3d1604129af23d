"""Listings and text extraction on real files."""

import io
import os
import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import paths
from docloom.operators import extract, office
from docloom.plans.file_trees import docx_bytes, pptx_bytes, xlsx_bytes
from docloom.sources import files


def put(root, rel, data=b"x"):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


@pytest.fixture()
def tree(tmp_path):
    root = str(tmp_path / "build")  # an excluded name, but it is the root
    for rel in ("a.txt", "with space/b.md", "UPPER.PDF", "_under.txt", "~x.md", ".hid.md",
                ".git/c.md", "x/node_modules/d/e.md", "x/y/z/deep.txt", "x/Bin/f.md"):
        put(root, rel)
    os.symlink(root, os.path.join(root, "x", "loop"))
    os.symlink(os.path.join(root, "a.txt"), os.path.join(root, "link.txt"))
    return root


def rel(df, root):
    return sorted(r[0] for r in df.select(paths.relative_to(F.col("file_path"), root)).collect())


def test_walk_prunes_and_skips_missing_roots(spark, tree):
    listed = files.walk(spark, [tree, tree + "/none"])
    assert rel(listed, tree) == sorted(
        ["a.txt", "with space/b.md", "UPPER.PDF", "_under.txt", "~x.md", ".hid.md",
         "x/y/z/deep.txt", "link.txt"]
    )
    row = listed.where(F.col("file_path").endswith("/a.txt")).first()
    st = os.stat(os.path.join(tree, "a.txt"))
    assert row.root == tree and row.file_size == 1 and row.created_date is not None
    at = row.modified_date.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    assert at // timedelta(microseconds=1) == st.st_mtime_ns // 1_000_000 * 1000
    assert files.walk(spark, [tree + "/none"]).count() == 0


def test_overlapping_roots_list_twice(spark, tree):
    listed = files.walk(spark, [tree, tree + "/x"])
    assert listed.where(F.col("file_path").endswith("deep.txt")).count() == 2


def test_stream_rows_are_listed_alike(spark, tree):
    root = tree + "/with space"
    a = files.listing_of_binary(spark.read.format("binaryFile").load(root), root)
    b = files.walk(spark, [root])
    cols = ["root", "file_path", "file_size", "modified_date"]
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert "content" not in a.columns


LONG = ("é" * 999_999 + "\n" + "tail").encode()
BYTES = {
    "ok.txt": ("a\r\nb\rc\né".encode(), "a\nb\nc\né"),
    "bad.md": (b"a\xffb\xc3", "ab"),
    "raw.rtf": (b"{\\rtf1 x}", "{\\rtf1 x}"),
    "no.markdown": (b"text", ""),
    "no.pdf": (b"%PDF", ""),
    "long.txt": (LONG, LONG.decode()),
    "mark.txt": ("a\ufffdb\ue000\ue0001".encode() + b"\xff\xe2\x82", "a\ufffdb\ue000\ue0001"),
    "p.docx": (docx_bytes("one\n\n two & <three>"), "one\n two & <three>"),
    "q.xlsx": (xlsx_bytes("a\nb c\n\nd"), "a b c d"),
    "broken.docx": (b"PK\x03\x04 not a zip", ""),
    "legacy.doc": (b"\xd0\xcf\x11\xe0", ""),
    "really.doc": (docx_bytes("zip inside"), "zip inside"),
    "deck.pptx": (pptx_bytes("t"), ""),
    "empty.txt": (b"", ""),
}


def test_both_extractions_agree(spark, tmp_path):
    root = str(tmp_path / "t")
    for name, (data, _) in BYTES.items():
        put(root, name, data)
    listed = extract.extract_listed(files.walk(spark, [root]))
    got = {r[0]: r[1] for r in listed.select(paths.file_name(F.col("file_path")), "content").collect()}
    assert got == {k: v[1] for k, v in BYTES.items()}
    assert listed.where(~F.col("readable")).count() == 0

    binary = spark.read.format("binaryFile").load(root)
    name = paths.file_name(F.col("path"))
    rows = binary.select(name.alias("n"), paths.file_extension(name).alias("file_extension"), "content")
    from_binary = {r.n: r.content for r in extract.extract_binary(rows).collect()}
    # Spark's file sources pass over files without bytes
    assert from_binary | {"empty.txt": ""} == got


def test_vanished_file_is_no_failure(spark, tmp_path):
    root = str(tmp_path / "t")
    gone = put(root, "gone.txt")
    put(root, "here.txt", b"here")
    listing = files.walk(spark, [root])
    os.rename(gone, gone + ".away")
    got = extract.extract_listed(listing).select("content", "readable").collect()
    assert sorted(map(tuple, got)) == [("", False), ("here", True)]


def test_docx_breaks_tabs_and_links():
    w = office._W.strip("{}")
    xml = (
        f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/>'
        '<w:br w:type="page"/><w:t>c</w:t><w:noBreakHyphen/></w:r><w:hyperlink><w:r><w:t>link</w:t>'
        "</w:r></w:hyperlink><w:ins><w:r><w:t>left out</w:t></w:r></w:ins></w:p></w:body></w:document>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(office.DOCUMENT_PART, xml)
    assert office.docx_text(out.getvalue()) == "a\tb\nc-link"


def test_slide_texts_and_card(spark):
    data = pptx_bytes("Title\n\n  Sub  \nCall\nmore")
    assert office.slide_texts(data)[:3] == [(1, 0, "Title"), (1, 1, "Sub"), (1, 2, "Call")]
    assert (2, 0, "more") in office.slide_texts(data)
    rows = spark.createDataFrame(
        [("/d/a.pptx", ".pptx", bytearray(data)), ("/d/" + "n" * 50 + ".pptx", ".pptx", bytearray(b"junk")),
         ("/d/c.txt", ".txt", bytearray(b"x"))],
        "file_path string, file_extension string, content binary",
    )
    card = {r.file_path: tuple(r)[1:] for r in extract.slide_card(rows).collect()}
    assert card == {
        "/d/a.pptx": ("Title", "Sub", "Call"),
        "/d/" + "n" * 50 + ".pptx": ("n" * 50 + ".pptx", "", ""),
    }


def test_slides_without_shapes_use_text_nodes():
    a = office._A.strip("{}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(office.SLIDE_PART.format(1), f'<x xmlns:a="{a}"><a:t> one </a:t><a:t> </a:t><a:t>two</a:t></x>')
    assert office.slide_texts(out.getvalue()) == [(1, 0, "one"), (1, 1, "two")]


def test_content_cap_constant():
    assert C.CONTENT_CAP == 1_000_000


def test_remote_paths_keep_their_store(tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    put(root, "a.txt", b"x\r\ny\xff")
    put(root, "sub/b.docx", docx_bytes("doc"))
    listed = {p: (d, n) for p, d, n, *_ in files._remote_children(f"file://{root}")}
    assert listed[f"file://{root}/a.txt"] == (False, 5) and listed[f"file://{root}/sub"][0]
    monkeypatch.setattr(files, "is_remote", lambda path: True)
    assert extract._read_text(f"file://{root}/a.txt", ".txt") == "x\ny"
    assert extract._read_text(f"file://{root}/sub/b.docx", ".docx") == "doc"
    assert [files.is_remote(p) for p in ("s3a://b/k",)] == [True]


def test_remote_detection():
    paths_ = ["s3a://b/k", "hdfs://n:1/a", "/a/b", "file:/a", "file:///a", "C:/x"]
    assert [files.is_remote(p) for p in paths_] == [True, True, False, False, False, False]
    assert [files.local_path(p) for p in ("file:/a", "file:///a", "/a")] == ["/a"] * 3


def test_folders_that_cannot_be_named_are_rows(spark, tree):
    os.makedirs(os.fsencode(tree) + b"/caf\xe9/inner")
    with open(os.fsencode(tree) + b"/caf\xe9.txt", "wb") as f:
        f.write(b"x")
    listed = files.walk(spark, [tree])
    blind = listed.where("unreadable").collect()
    assert [(r.file_path, r.file_size) for r in blind] == [(tree + "/caf\ufffd", None)]
    assert listed.where(F.col("file_path").endswith("caf\ufffd.txt")).first().file_size is None


def test_a_folder_that_turned_into_a_file_is_unreadable(spark, tmp_path):
    path = put(str(tmp_path), "f.txt")
    import pandas as pd

    rows = next(files._list_folders(iter([pd.DataFrame({"root": ["r"], "file_path": [path]})])))
    assert rows[["file_path", "unreadable"]].values.tolist() == [[path, True]]


def test_roots_are_made_absolute(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "docs")
    put(root, "a.txt")
    monkeypatch.chdir(tmp_path)
    given = ["docs", "./docs", root + "//", f"{tmp_path}/x/../docs", f"file://{root}/"]
    os.makedirs(tmp_path / "x")
    assert files.existing_roots(spark, given) == [root]


def test_workers_hold_a_few_megabytes_of_a_task(spark, tmp_path):
    import pyarrow as pa

    from docloom.operators.extract import _extract_batches
    from docloom.session import BATCH_BYTES, map_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    seen = map_batches(rows, sizes, "n long, size long").collect()
    assert sum(r["n"] for r in seen) == 400 and max(r["size"] for r in seen) <= BATCH_BYTES + 200_000

    names = [str(tmp_path / f"{i}.txt") for i in range(9)]
    for name in names:
        with open(name, "w") as f:
            f.write("y" * (BATCH_BYTES // 2))
    listed = pa.RecordBatch.from_pydict({"file_path": [*names, str(tmp_path / "gone.txt")], "file_extension": [".txt"] * 10})
    out = list(_extract_batches(iter([listed])))
    assert [n for b in out for n in b["file_path"].to_pylist()] == listed["file_path"].to_pylist()
    assert max(b.nbytes for b in out) < 2 * BATCH_BYTES
    assert [r for b in out for r in b["readable"].to_pylist()] == [True] * 9 + [False]


def test_replayed_batches_are_listed_by_tasks(spark, sf_dir, monkeypatch):
    from docloom.plans import registry

    seen = []
    monkeypatch.setattr(registry, "ingest_batch", lambda catalog, root, stream: lambda batch, no: seen.append((batch, no, root)))
    registry._replayed(spark, sf_dir)
    assert [no for _, no, _ in seen] == [0, 0, 1] and len({id(batch) for batch, _, _ in seen}) == 1
    batch, _, root = seen[0]
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "level=" in plan  # what tasks have listed
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    want = files.listing_of_binary(found, root)
    assert batch.columns == want.columns
    assert sorted(batch.collect(), key=str) == sorted(want.collect(), key=str)
    assert batch.where(F.col("file_path").contains("Node_Modules")).count()


def test_progress_totals_list_the_files_once_for_all_batches(spark, sf_dir, monkeypatch):
    from docloom.plans import registry

    walk, calls = files.walk, []
    monkeypatch.setattr(files, "walk", lambda *a, **b: calls.append(a) or walk(*a, **b))
    row = registry.progress_totals(spark, sf_dir).first()
    assert len(calls) == 1 and row.indexed == row.skipped > 0 and row.scanned == 2 * row.indexed and row.ignored > 0
