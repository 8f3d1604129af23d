"""Files to result page: ingest, index refresh, search, command line."""

import glob
import os

from pyspark.sql import functions as F

from docloom.__main__ import main
from docloom.plans.indexing import current_index, refresh_index, search_columns
from docloom.plans.ingest import run_ingest
from docloom.plans.results import page_number, search_page
from docloom.session import new_table_path
from docloom.sources.catalog import Catalog
from docloom.sources.text_index import write_index
from test_files import put


def tables(index):
    def rows(df):
        return sorted(map(tuple, df.collect()), key=repr)

    posts = index.postings().select("doc_id", "field", "term", "tf", "dl")
    stats = index.all_term_stats().select("field", "term", "df")
    return rows(posts), rows(stats), rows(index.field_stats())


def names(result):
    return [os.path.basename(r.path) for r in result.rows.collect()]


def test_ingest_index_search(spark, tmp_path):
    root, path = str(tmp_path / "files"), str(tmp_path / "cat")
    put(root, "alpha & omega.txt", b"Needle in a haystack. The needle again!")
    put(root, "beta.md", b"a needle, once, in a much longer text about hay and more hay")
    put(root, "needle.txt", b"nothing here")
    put(root, "other.md", b"no match")
    run_ingest(spark, path, [root])
    catalog, index_root = Catalog(spark, path), f"{path}/index"
    assert current_index(catalog, index_root) is None
    index = refresh_index(catalog, index_root)

    result = search_page(catalog, index, "needle")
    assert names(result) == ["alpha &amp; omega.txt", "beta.md"]  # needle.txt is one token
    first = result.rows.first()
    assert first.snippet == "<mark>Needle</mark> in a haystack. ... The <mark>needle</mark> again!"
    assert first.open_file.endswith("/alpha%20%26%20omega.txt") and first.created != ""
    assert result.summary.first().total == 2
    assert names(search_page(catalog, index, "md needle")) == ["beta.md"]
    assert names(search_page(catalog, index, "needle.txt")) == ["needle.txt"]
    assert names(search_page(catalog, index, "needle", page="x", size=1)) == ["alpha &amp; omega.txt"]
    assert names(search_page(catalog, index, "needle", page=2, size=1)) == ["beta.md"]
    assert names(search_page(catalog, index, "  ")) == []
    assert names(search_page(catalog, index, "txt", sort="name_asc")) == ["alpha &amp; omega.txt", "needle.txt"]

    # changes reach the index; the updated index is the one built from scratch
    put(root, "other.md", b"now a needle and a needle")
    put(root, "new.txt", b"fresh needle")
    os.rename(f"{root}/beta.md", f"{root}/beta.gone")
    run_ingest(spark, path, [root])
    updated = refresh_index(catalog, index_root)
    assert updated.path == index.path
    docs = search_columns(catalog.read(), "content")
    scratch = write_index(docs, new_table_path(spark, "scratch"))
    assert tables(updated) == tables(scratch)
    assert set(names(search_page(catalog, updated, "needle"))) == {
        "alpha &amp; omega.txt", "other.md", "new.txt",
    }
    files = sorted(glob.glob(f"{index_root}/*/*/*.parquet"))
    refresh_index(catalog, index_root)  # nothing to do
    assert sorted(glob.glob(f"{index_root}/*/*/*.parquet")) == files
    catalog.compact()
    put(root, "after.txt", b"needle after compaction")
    run_ingest(spark, path, [root])
    assert tables(refresh_index(catalog, index_root)) == tables(
        write_index(search_columns(catalog.read(), "content"), new_table_path(spark, "scratch"))
    )


def test_page_number():
    assert [page_number(x) for x in ("3", 0, "-1", "x", None, "")] == [3, 1, 1, 1, 1, 1]


def test_command_line(spark, tmp_path, capsys):
    root, path = str(tmp_path / "files"), str(tmp_path / "cat")
    put(root, "a.txt", b"needle one")
    put(root, "private/b.txt", b"needle two")
    assert main(["search", "--catalog", path, "needle"]) == 1
    assert main(["ingest", "--catalog", path, "--dir", root, "--exclude-folder", "private"]) == 0
    assert main(["search", "--catalog", path, "--sort", "date_desc", "needle", "one"]) == 0
    out = capsys.readouterr().out
    assert "<mark>needle</mark>" in out and "b.txt" not in out
    assert main(["status", "--catalog", path]) == 0
    assert "Checking documents: 1 scanned" in capsys.readouterr().out
    put(str(tmp_path / "bk"), "extra.txt")
    put(root, ".hidden/c.bin")
    plan = str(tmp_path / "plan")
    assert main(["mirror", "--source", root, "--target", str(tmp_path / "bk"), "--output", plan]) == 0
    got = {r.rel_path: r.action for r in spark.read.parquet(plan).collect()}
    assert got == {"a.txt": "COPY", "private/b.txt": "COPY", ".hidden/c.bin": "COPY", "extra.txt": "DELETE"}
    assert main(["mirror", "--source", root, "--target", str(tmp_path / "bk")]) == 0
    assert spark.range(1).select(F.lit(1)).count() == 1
