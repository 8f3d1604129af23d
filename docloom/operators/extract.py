"""Text extraction as Spark jobs: only the rows that need it, spread over all tasks.

* :func:`extract_listed` - rows of a listing; each task opens the files of its rows. Used by
  the batch ingest after the delta, so unchanged files are never read.
* :func:`extract_binary` - rows that carry their bytes (a ``binaryFile`` stream). Plain text
  is decoded by Spark; only office bytes cross to Python.

Both give the same, whole text: bytes that are no UTF-8 are dropped, and nothing is cut. PDF needs a library that is not part of Spark; such rows keep an
empty text, like every type without a reader. A file that cannot be parsed has empty text, stays
in the catalog and is counted.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import paths
from docloom.operators import office
from docloom.session import BATCH_BYTES, map_batches, map_frames, ship_package
from docloom.sources import files

# --- fixed values: readers by extension (``.markdown`` has none) ---------------------------
TEXT_EXTENSIONS = (".txt", ".md", ".rtf")
DOCX_EXTENSIONS = (".docx", ".doc")
XLSX_EXTENSIONS = (".xlsx", ".xls")
OFFICE_EXTENSIONS = DOCX_EXTENSIONS + XLSX_EXTENSIONS

_FLUSH_CHARS = BATCH_BYTES  # texts of about this size leave a task as one batch


#: What damaged files raise. Anything else, such as a lack of memory, fails the task.
DAMAGE = (
    zipfile.BadZipFile, ET.ParseError, zlib.error, EOFError, KeyError, ValueError, NotImplementedError,
)


def office_text(extension: str, data: bytes) -> str | None:
    """Text of an office file, None when it cannot be parsed."""
    read = office.docx_text if extension in DOCX_EXTENSIONS else office.xlsx_text
    try:
        return read(data)
    except DAMAGE:
        return None
    except RuntimeError as e:  # what zipfile raises for an encrypted part
        if "encrypted" in str(e):
            return None
        raise


def decode_text(content: Column) -> Column:
    """UTF-8 bytes to text as a Spark expression: bad bytes dropped, line ends as ``\\n``.

    Spark can only turn invalid bytes into U+FFFD. A genuine U+FFFD is put into two characters
    before and taken out of them afterwards, so that only the bad bytes are removed.
    """
    mark, genuine, escaped = F.lit("\ue000"), F.lit("\ue0001"), F.lit("\ue0000")
    text = F.replace(F.replace(content.cast("string"), mark, escaped), F.lit("\ufffd"), genuine)
    clean = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    whole = F.replace(F.replace(clean, genuine, F.lit("\ufffd")), escaped, mark)
    return F.regexp_replace(whole, "\r\n?", "\n")


@F.pandas_udf(T.StringType())
def _office_udf(extension: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series(
        ["" if d is None else office_text(e, d) or "" for e, d in zip(extension, data)], dtype=object
    )


def extract_binary(rows: DataFrame) -> DataFrame:
    """Replaces the bytes in ``content`` by text; needs ``file_extension``."""
    ship_package(rows.sparkSession)
    ext, data = F.col("file_extension"), F.col("content")
    is_office = ext.isin(*OFFICE_EXTENSIONS)
    # other rows hand a null to Python, so their bytes stay in the JVM
    from_office = _office_udf(ext, F.when(is_office, data))
    return rows.withColumn(
        "content",
        F.when(ext.isin(*TEXT_EXTENSIONS), decode_text(data))
        .when(is_office, from_office)
        .otherwise(F.lit("")),
    )


def _open(path: str):
    if files.is_remote(path):
        store, inner = files.open_store(path)
        return store.open_input_stream(inner)
    return open(files.local_path(path), "rb")


def _read_text(path: str, extension: str) -> str | None:
    with _open(path) as raw:
        if extension in OFFICE_EXTENSIONS:
            return office_text(extension, raw.read())
        if hasattr(raw, "readable") and not isinstance(raw, io.BufferedIOBase):
            raw = io.BufferedReader(raw)
        return io.TextIOWrapper(raw, encoding="utf-8", errors="ignore").read()


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def read(part: pa.RecordBatch, texts: list[str], ok: list[bool], parsed: list[bool]) -> pa.RecordBatch:
        names = [*part.schema.names, "content", "readable", "parsed"]
        more = [pa.array(texts, pa.string()), pa.array(ok, pa.bool_()), pa.array(parsed, pa.bool_())]
        return pa.RecordBatch.from_arrays([*part.columns, *more], names)

    for batch in batches:
        texts, ok, parsed, start, size = [], [], [], 0, 0
        for path, ext in zip(batch.column("file_path").to_pylist(), batch.column("file_extension").to_pylist()):
            try:
                text = _read_text(path, ext) if ext in TEXT_EXTENSIONS + OFFICE_EXTENSIONS else ""
                ok.append(True)
            except OSError:  # gone or unreadable since it was listed
                text = ""
                ok.append(False)
            parsed.append(text is not None)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= _FLUSH_CHARS:
                yield read(batch.slice(start, len(texts)), texts, ok, parsed)
                texts, ok, parsed, start, size = [], [], [], start + len(texts), 0
        if texts:
            yield read(batch.slice(start), texts, ok, parsed)


def _extract_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same over pandas frames, part by part."""
    for frame in frames:
        start = 0
        listed = pa.RecordBatch.from_pydict({c: pa.array(list(frame[c]), pa.string()) for c in ("file_path", "file_extension")})
        for out in _extract_batches(iter([listed])):
            stop = start + out.num_rows
            yield frame.iloc[start:stop].assign(**{c: out[c].to_pylist() for c in ("content", "readable", "parsed")})
            start = stop


def extract_listed(rows: DataFrame) -> DataFrame:
    """Adds ``content``, ``readable`` and ``parsed`` to listing rows by opening ``file_path`` in the
    tasks."""
    if "file_extension" not in rows.columns:
        rows = rows.withColumn(
            "file_extension", paths.file_extension(paths.file_name(F.col("file_path")))
        )
    schema = T.StructType(
        rows.schema.fields
        + [T.StructField("content", T.StringType()), T.StructField("readable", T.BooleanType()),
           T.StructField("parsed", T.BooleanType())]
    )
    return map_frames(rows, _extract_frames, schema)


_SLIDES = pa.schema([("file_path", pa.string()), ("slide_no", pa.int32()), ("pos", pa.int32()), ("text", pa.string())])


def _slides_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for path, data in zip(batch.column("file_path"), batch.column("content")):
            try:
                out.extend((path.as_py(), *slide) for slide in office.slide_texts(data.as_py()))
            except DAMAGE:  # a damaged deck has no slide texts
                continue
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SLIDES.types)], schema=_SLIDES)


def slide_texts(rows: DataFrame) -> DataFrame:
    """``(file_path, slide_no, pos, text)`` of all slides of every ``.pptx`` row."""
    decks = rows.where(F.col("file_extension") == ".pptx").select("file_path", "content")
    return map_batches(decks, _slides_of, "file_path string, slide_no int, pos int, text string")


def slide_card(rows: DataFrame) -> DataFrame:
    """Title, subtitle and callout of every deck: the first three texts of its first slide.

    A deck without text takes its file name as title.
    """
    first = slide_texts(rows).where(F.col("slide_no") == 1)
    picked = first.groupBy("file_path").agg(
        *[
            F.max(F.when(F.col("pos") == i, F.col("text"))).alias(name)
            for i, name in enumerate(("title", "subtitle", "callout"))
        ]
    )
    decks = rows.where(F.col("file_extension") == ".pptx").select("file_path")
    name = paths.file_name(F.col("file_path"))
    return decks.join(picked, "file_path", "left").select(
        "file_path",
        F.coalesce("title", name).alias("title"),
        F.coalesce("subtitle", F.lit("")).alias("subtitle"),
        F.coalesce("callout", F.lit("")).alias("callout"),
    )


__all__ = [
    "decode_text", "extract_binary", "extract_listed", "slide_card", "slide_texts",
]
