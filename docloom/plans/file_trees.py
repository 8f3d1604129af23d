"""Fixture: real files made from the given tables by Spark tasks, as input for the ingest jobs."""

from __future__ import annotations

import io
import os
import re
import time
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import paths
from docloom.operators import office
from docloom.plans.tables import ROOT, catalog
from docloom.session import map_batches, new_table_path, spread
from docloom.sources import files

_NOT_XML = re.compile("[\x00-\x08\x0b-\x1f]")


def _lines(text: str) -> list[str]:
    return _NOT_XML.sub("", text).split("\n")


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + xml)
    return out.getvalue()


def docx_bytes(text: str) -> bytes:
    """One paragraph per line, and a table cell that is no body paragraph."""
    w = office._W.strip("{}")
    body = "".join(f"<w:p><w:r><w:t>{escape(s)}</w:t></w:r></w:p>" for s in _lines(text))
    cell = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return _zip(
        {office.DOCUMENT_PART: f'<w:document xmlns:w="{w}"><w:body>{body}{cell}</w:body></w:document>'}
    )


def xlsx_bytes(text: str) -> bytes:
    s = office._S.strip("{}")
    items = "".join(f"<si><t>{escape(x)}</t></si>" for x in _lines(text))
    return _zip({office.STRINGS_PART: f'<sst xmlns="{s}">{items}</sst>'})


def pptx_bytes(text: str) -> bytes:
    """The lines of the text as shapes: all on the first slide of the deck, the last one again on the
    second. The parts are named the other way round, as in a deck whose slides were moved."""
    p, a = office._P.strip("{}"), office._A.strip("{}")

    def slide(lines: list[str]) -> str:
        shapes = "".join(
            f"<p:sp><p:txBody><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:txBody></p:sp>"
            for x in lines
        )
        return (
            f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld>'
            "</p:sld>"
        )

    lines = _lines(text)
    r, rels = office._R.strip("{}"), office._L.strip("{}")
    deck = f'<p:presentation xmlns:p="{p}" xmlns:r="{r}"><p:sldIdLst><p:sldId r:id="rId7"/><p:sldId r:id="rId3"/></p:sldIdLst></p:presentation>'
    links = "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in (("rId3", "slides/slide1.xml"), ("rId7", "/ppt/slides/slide2.xml")))
    return _zip({
        office.DECK_PART: deck, office.DECK_LINKS: f'<Relationships xmlns="{rels}">{links}</Relationships>',
        office.SLIDE_PART.format(1): slide(lines[-1:]), office.SLIDE_PART.format(2): slide(lines),
    })


_BUILDERS = {".docx": docx_bytes, ".xlsx": xlsx_bytes, ".pptx": pptx_bytes}


def _file_bytes(extension: str, text: str) -> bytes:
    build = _BUILDERS.get(extension)
    return build(text) if build else text.encode("utf-8")


def with_bytes(docs: DataFrame) -> DataFrame:
    """``(file_path, file_extension, content)`` with the bytes of a file of that type."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = pa.array([_file_bytes(e.as_py(), t.as_py()) for e, t in zip(b["file_extension"], b["content"])], pa.binary())
            yield pa.RecordBatch.from_arrays([b["file_path"], b["file_extension"], data], ["file_path", "file_extension", "content"])

    rows = docs.select("file_path", "file_extension", "content")
    return map_batches(rows, build, "file_path string, file_extension string, content binary")


def _write(path: str, data: bytes, age: int) -> None:
    if files.is_remote(path):
        store, inner = files.open_store(path)
        store.create_dir(os.path.dirname(inner), recursive=True)
        with store.open_output_stream(inner) as f:
            f.write(data)
        return
    path = files.local_path(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    if age:
        then = time.time() - age * 86400
        os.utime(path, (then, then))


def write_tree(
    spark: SparkSession,
    sf_dir: str,
    root: str | None = None,
    part: int | None = None,
    age_days: int = 0,
    where: Column | None = None,
    content: Column | None = None,
) -> str:
    """Write one file per document below a new folder of the working folder; returns it. With
    ``part`` (0 or 1) only every other document, with ``where`` only some; ``content`` is what to
    write in place of their texts; ``age_days`` dates the files back.

    A repeated task writes the same bytes to the same path.
    """
    root = root or new_table_path(spark, "tree")
    docs = catalog(spark, sf_dir)
    if part is not None:
        docs = docs.where(F.col("doc_id") % 2 == part)
    if where is not None:
        docs = docs.where(where)
    if content is not None:
        docs = docs.withColumn("content", content)
    rows = docs.select(
        F.concat(F.lit(root), F.substr(F.col("file_path"), F.lit(len(ROOT) + 1))).alias("file_path"),
        paths.file_extension(F.col("file_name")).alias("file_extension"),
        "content",
    )
    _write_rows(spread(rows, "file_path"), age_days)
    return root


def _write_rows(rows: DataFrame, age_days: int = 0) -> None:
    """Files of ``(file_path, file_extension, content)``: made and written one at a time."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, extension, text in zip(b["file_path"], b["file_extension"], b["content"]):
                _write(path.as_py(), _file_bytes(extension.as_py(), text.as_py()), age_days)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    map_batches(rows, write, "n bigint").agg(F.sum("n")).first()


def write_long_texts(spark: SparkSession, sf_dir: str, docs_per_file: int) -> str:
    """A text file for each so many ids: the texts of their documents, one after the other."""
    root = new_table_path(spark, "long")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    file_no = F.floor(F.col("doc_id") / docs_per_file).alias("file_no")
    text = F.coalesce("text", F.lit("")).alias("text")
    together = docs.groupBy(file_no).agg(F.sort_array(F.collect_list(F.struct("doc_id", text))).alias("docs"))
    rows = together.select(
        F.concat(F.lit(root + "/"), F.col("file_no"), F.lit(".txt")).alias("file_path"),
        F.lit(".txt").alias("file_extension"),
        F.array_join(F.transform("docs", lambda d: d["text"]), "\n").alias("content"),
    )
    _write_rows(rows)
    return root
