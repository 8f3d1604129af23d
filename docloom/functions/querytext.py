"""Query strings to file types, required terms and excluded terms - as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import constants as C

# NOT ( words )  ->  NOT words. No word boundary in front, so "cannot(x)" is split as well.
_NOT_GROUP = r"(?i)NOT[\s\p{Z}]*\([\s\p{Z}]*([^)]+)[\s\p{Z}]*\)"
# A unit is either NOT with the word it takes, or one word. Read left to right, so that a
# NOT taken by an earlier NOT does not take a word itself.
_UNIT = r"(?i:NOT)[\s\p{Z}]+[^\s\p{Z}]+|[^\s\p{Z}]+"
_NOT_UNIT = r"^(?i:NOT)[\s\p{Z}]+(?=[^\s\p{Z}])"


def query_units(query: Column) -> Column:
    flat = F.regexp_replace(query, _NOT_GROUP, " NOT $1 ")
    return F.regexp_extract_all(flat, F.lit(_UNIT), F.lit(0))


def _is_excluding(unit: Column) -> Column:
    return unit.rlike(_NOT_UNIT) | (unit.startswith("-") & (F.length(unit) > 1))


def _as_type(unit: Column) -> Column:
    return F.ltrim(F.lower(unit), F.lit("."))


def classify(query: Column) -> Column:
    """``struct<file_types, must_terms, must_not_terms>`` of a query string.

    ``AND`` and ``OR`` are noise words, so every plain word is required. A final ``NOT`` is
    ignored. Quotes have no meaning.
    """
    units = query_units(query)
    parens = F.lit("()")
    excluding = F.filter(units, _is_excluding)
    excluded = F.transform(
        excluding,
        lambda u: F.when(
            u.rlike(_NOT_UNIT),
            # an empty word after NOT is no exclusion; marked null here, removed below
            F.nullif(F.btrim(F.regexp_replace(u, _NOT_UNIT, ""), parens), F.lit("")),
        ).otherwise(F.btrim(F.substr(u, F.lit(2)), parens)),
    )
    words = F.filter(
        units, lambda u: ~_is_excluding(u) & ~F.upper(u).isin("AND", "OR", "NOT")
    )
    return F.struct(
        F.filter(F.transform(words, _as_type), lambda t: t.isin(*C.QUERY_FILE_TYPES))
        .alias("file_types"),
        F.filter(words, lambda u: ~_as_type(u).isin(*C.QUERY_FILE_TYPES)).alias("must_terms"),
        F.filter(excluded, lambda t: t.isNotNull()).alias("must_not_terms"),
    )
