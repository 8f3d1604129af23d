"""Marked fragments of a text, computed inside the row.

Rule: a sentence ends at a newline or at ``.``, ``!`` or ``?`` before white space; a sentence
longer than a fragment is cut at white space (or hard, inside one over-long word). Fragments
are ranked by how many different query tokens they hold, then by position; the best ones are
shown in text order. The whole text is searched. :func:`passages` ranks them as a search engine's
highlighter does instead: by the frequency of their tokens, their length and their place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions.display import html_escape, snippet
from docloom.functions.tokens import TOKEN_PATTERN, let, tokens

# --- fixed values: the usual constants of passage scoring -----------------------------------
PASSAGE_K1, PASSAGE_B, PASSAGE_PIVOT = 1.2, 0.75, 87.0
SCORE_DIGITS = 9

_CUT, _OPEN, _CLOSE = "\ue001", "\ue002", "\ue003"


def fragments(content: Column) -> Column:
    """The text as an array of trimmed pieces of at most ``FRAGMENT_CHARS`` characters."""
    n = C.FRAGMENT_CHARS
    marked = F.regexp_replace(content, r"([.!?])[ \t\r\n]+|\n", f"$1{_CUT}")
    piece = rf"(?s)[^ \t\r\n].{{0,{n - 1}}}(?:[ \t\r\n]|$)|[^ \t\r\n]{{{n}}}"
    per_sentence = F.transform(
        F.split(marked, _CUT),
        lambda s: F.transform(
            F.regexp_extract_all(s, F.lit(piece), F.lit(0)),
            lambda p: F.rtrim(p, F.lit(" \t\r\n")),
        ),
    )
    return F.flatten(per_sentence)


def mark_tokens(text: Column, terms: Column, escape: bool = False) -> Column:
    """Wrap every token of ``text`` that is in the array ``terms``."""
    wrapped = F.regexp_replace(text, TOKEN_PATTERN, f"{_OPEN}$0{_CLOSE}")
    parts = F.split(wrapped, f"[{_OPEN}{_CLOSE}]")

    def render(part: Column) -> Column:
        shown = html_escape(part) if escape else part
        hit = F.concat(F.lit(C.MARK_OPEN), shown, F.lit(C.MARK_CLOSE))
        return F.when(F.array_contains(terms, F.lower(part)), hit).otherwise(shown)

    return F.array_join(F.transform(parts, render), "")


def _best(scored: Column, terms: Column, escape: bool) -> Column:
    """The first of ``(rank, pos, text)`` by rank, marked, in text order."""
    best = F.slice(F.sort_array(scored), 1, C.FRAGMENTS)
    in_order = F.sort_array(
        F.transform(best, lambda s: F.struct(s["pos"].alias("pos"), s["text"].alias("text")))
    )
    return F.transform(in_order, lambda s: mark_tokens(s["text"], terms, escape))


def highlights(content: Column, terms: Column, escape: bool = False) -> Column:
    """Array of the best marked fragments; empty when no token occurs."""
    scored = F.transform(
        fragments(content),
        lambda p, i: F.struct(
            (-F.size(F.array_intersect(tokens(p), terms))).alias("rank"),
            i.alias("pos"),
            p.alias("text"),
        ),
    )
    return _best(F.filter(scored, lambda s: s["rank"] < 0), terms, escape)


def passages(content: Column, terms: Column, escape: bool = False) -> Column:
    """Array of the best marked fragments by passage score.

    A token weighs the more the rarer it is in the text; in a fragment its frequency saturates, the
    sooner the shorter the fragment; early fragments count a little more. A fragment's place is
    the number of characters in the fragments before it.
    """
    k1, b, pivot = PASSAGE_K1, PASSAGE_B, PASSAGE_PIVOT

    def times(found: Column, term: Column) -> Column:
        return F.size(F.filter(found, lambda t: t == term)).cast("double")

    def weights(found: Column) -> Column:
        like_documents = F.length(content) / pivot + 1.5
        return F.transform(
            terms, lambda t: F.struct(t.alias("term"), ((k1 + 1) * F.log(1 + like_documents / (times(found, t) + 0.5))).alias("weight"))
        )

    def scored(weighted: Column, pieces: Column) -> Column:
        def score(piece: Column, start: Column) -> Column:
            damp = k1 * (1 - b + b * F.length(piece) / pivot)
            points = let(
                tokens(piece),
                lambda found: F.aggregate(
                    weighted, F.lit(0.0),
                    lambda sum_, w: let(times(found, w["term"]), lambda n: sum_ + w["weight"] * n / (n + damp)),
                ),
            )
            return F.round(points * (1 + 1 / F.log(start + pivot)), SCORE_DIGITS)

        lengths = F.transform(pieces, F.length)
        # running sums in one pass over the lengths
        starts = F.aggregate(
            lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
        )
        return let(
            starts,
            lambda at: F.transform(
                pieces,
                lambda p, i: F.struct((-score(p, F.get(at, i))).alias("rank"), i.alias("pos"), p.alias("text")),
            ),
        )

    return let(
        let(tokens(content), weights),
        lambda weighted: let(
            fragments(content),
            lambda pieces: _best(F.filter(scored(weighted, pieces), lambda s: s["rank"] < 0), terms, escape),
        ),
    )


def result_snippet(
    content: Column, terms: Sequence[str] | Column, escape: bool = False, pick=highlights
) -> Column:
    """Fragments joined by `` ... ``, or the start of the text when nothing is marked. ``pick`` is
    the rule: :func:`highlights` or :func:`passages`."""
    if not isinstance(terms, Column):
        terms = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    plain = snippet(content)
    plain = html_escape(plain) if escape else plain
    return let(
        pick(content, terms, escape),
        lambda found: F.when(
            F.size(found) > 0, F.array_join(found, C.FRAGMENT_JOINER)
        ).otherwise(plain),
    )
