"""Texts shown to a reader: dates, escapes, links, snippets, counters, page facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import constants as C

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
)


def iso_timestamp(ts: Column) -> Column:
    """ISO text with ``T``; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def display_date(text: Column) -> Column:
    """``Jan 05, 2024, 01:07 PM``; text that is no ISO date is cut at ``T``; null becomes ''."""
    local = F.regexp_replace(text, r"(?<=\d{2}:\d{2}.{0,16})(?:Z|[+-]\d{2}:?\d{2})$", "")
    parsed = F.when(text.rlike(_ISO), local.try_cast("timestamp_ntz"))
    shown = F.date_format(parsed, "MMM dd, yyyy, hh:mm a")
    return F.coalesce(shown, F.substring_index(text, "T", 1), F.lit(""))


def html_escape(text: Column) -> Column:
    for plain, escaped in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
    ):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def url_quote(path: Column) -> Column:
    """Percent-encode a path: ``/`` and ``~`` stay, a space is ``%20``, ``\\`` becomes ``/``."""
    quoted = F.url_encode(F.replace(path, F.lit("\\"), F.lit("/")))
    for form, percent in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(form), F.lit(percent))
    return quoted


def url_unquote(text: Column) -> Column:
    """Undo :func:`url_quote`; text that is not valid percent-encoding is kept."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def link(scheme: str, path: Column) -> Column:
    """``openfile://...``, ``openopus://...`` or ``openexplorer://...``."""
    return F.concat(F.lit(scheme + "://"), url_quote(path))


def mime_type(file_type: Column) -> Column:
    pairs = [F.lit(x) for pair in C.MIME_TYPES.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), F.lower(file_type))
    return F.coalesce(found, F.lit(C.DEFAULT_MIME_TYPE))


def content_cap(text: Column, chars: int = C.CONTENT_CAP) -> Column:
    return F.left(text, F.lit(chars))


def snippet(content: Column) -> Column:
    """What is shown when no fragment matches: the start of the text, always with ``...``."""
    start = F.concat(F.left(content, F.lit(C.SNIPPET_CHARS)), F.lit("..."))
    return F.when(F.length(content) > 0, start).otherwise(F.lit(C.NO_PREVIEW))


def preview_lines(content: Column) -> Column:
    """The lines drawn on a preview card."""
    breaks = r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"
    lines = F.split(F.left(content, F.lit(C.PREVIEW_CHARS)), breaks)
    # A break at the very end closes the last line and opens no new one.
    lines = F.when(
        F.get(lines, F.size(lines) - 1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)
    ).otherwise(lines)
    return F.transform(
        F.slice(lines, 1, C.PREVIEW_LINES), lambda s: F.left(s, F.lit(C.PREVIEW_LINE_CHARS))
    )


def found_text(total: Column) -> Column:
    return F.concat(F.lit("Found "), F.format_number(total, 0), F.lit(" matching document(s)"))


def progress_text(scanned: Column, indexed: Column, skipped: Column) -> Column:
    """The message of a running ingest."""
    return F.concat(
        F.lit("Checking documents: "), F.format_number(scanned, 0), F.lit(" scanned ("),
        F.format_number(indexed, 0), F.lit(" updated, "), F.format_number(skipped, 0),
        F.lit(" skipped)"),
    )


def page_columns(total: Column, page: Column, size: int = C.PAGE_SIZE) -> list[Column]:
    """Paging facts of a result with ``total`` hits."""
    page = page.cast("bigint")
    total = total.cast("bigint")
    end = F.least(page * size, total)
    return [
        total.alias("total"),
        F.greatest(F.ceil(total / size), F.lit(1)).cast("bigint").alias("total_pages"),
        F.when(total > 0, (page - 1) * size + 1).otherwise(0).cast("bigint").alias("start_doc"),
        end.alias("end_doc"),
        F.greatest(page - 1, F.lit(1)).cast("bigint").alias("prev_page"),
        F.when(end < total, page + 1).otherwise(page).cast("bigint").alias("next_page"),
        F.least(F.lit(size), total - end).cast("bigint").alias("next_count"),
    ]
