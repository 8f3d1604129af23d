"""Tokens of a text and their counts, computed inside the row (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{M}\p{N}_]"
_BETWEEN_LETTERS = r"(?<=\p{L})[.'’:·](?=\p{L})"
_BETWEEN_DIGITS = r"(?<=\p{N})[.,;'](?=\p{N})"

#: Letters, digits and ``_`` run together; some punctuation joins two letters or two digits.
#: Possessive quantifiers keep the matcher iterative, so a token may be any length.
TOKEN_PATTERN = f"{_WORD}++(?:(?:{_BETWEEN_LETTERS}|{_BETWEEN_DIGITS}){_WORD}++)*+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in text order. Null text has no tokens."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(token_array: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array.

    Sorts the array and measures the runs. The counts of a document never depend on another
    row, so no ``groupBy`` (and no shuffle of every token) is needed.
    """

    def runs(sorted_tokens: Column) -> Column:
        n = F.size(sorted_tokens)
        first_of_run = F.filter(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda i: (i < n)
            & ((i == 0) | (F.get(sorted_tokens, i) != F.get(sorted_tokens, i - 1))),
        )
        return let(
            first_of_run,
            lambda starts: F.transform(
                starts,
                lambda at, k: F.struct(
                    F.get(sorted_tokens, at).alias("term"),
                    (F.coalesce(F.get(starts, k + 1), n) - at).cast("bigint").alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(token_array), runs)
