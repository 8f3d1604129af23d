"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Every word class and every tag has a weight:
words score positive where they look like running text and negative in links, menus and the like,
tags score negative. One linear scan finds the contiguous region with the largest sum, which is
the content. Of that region, text inside page furniture (menus, headers and footers, sidebars,
notices, adverts, forms, reader comments) is left out, the rest becomes blocks.

Weights are learned (``learn``) from labelled pages: in a bounded sample, pages that mark their
content with ``article`` or ``main`` say which words and tags lie inside it. A weight is the
smoothed log-odds of its class. The mark is one more weighted feature: the log-odds that running
text of this page stands inside its marks is added to words inside and taken from those outside. It
fades where much running text stands outside; then the classes alone decide, as on pages without
marks, and a small mark on such a page (a teaser card) counts against its words. Besides the best
region of the page, each mark that holds a fair part of the running text, or lies on a page whose
marks hold most of it, gives the best region within itself, so that several articles are all read.

Defined cases: null html is an empty page with empty text; markup that is cut off, unclosed or
wrongly nested is read as far as it goes; a page without words has empty text; of equally good
regions the first and shortest is taken; rows with equal ``page_id`` are read each; a null
``page_id`` or ``url`` stays null; columns other than ``page_id``, ``url`` and ``html`` are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batch, map_arrow

#: Pages that weights are learned from, by the smallest hash of their id.
SAMPLE_PAGES = 2000
#: Weight of the log-odds that running text stands inside the marks, and the most it may add.
MARK_WEIGHT, MOST_MARK = 4.0, 6.0
#: A mark with this part of a page's running text is no teaser.
FAIR_PART = 0.1

# --- fixed values: elements of HTML --------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template noscript iframe object svg math canvas audio video title head select textarea button datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav footer aside form menu dialog search fieldset".split())
LANDMARK = frozenset(("article", "main"))
CLOSES_P = BLOCK - frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"))
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored "
    "nav navbar navigation menu breadcrumb breadcrumbs toolbar sidebar aside rail widget footer header masthead "
    "topbar cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended comment comments disqus discussion replies reply respond "
    "pagination pager skip copyright disclaimer".split()
)

#: Of these, words that sections of an article are named after too: alone they prove nothing.
AMBIGUOUS_NAMES = frozenset(
    "advertising alert banner breadcrumb comment consent copyright discussion disclaimer masthead menu navigation notice "
    "notices overlay promotion rail recommended related reply replies response share sharing skip social sponsor "
    "subscription".split()
)
#: Words that say nothing beside another: ``comment-list`` is ``comment``.
SHELL_NAMES = frozenset(
    "area bar block body bottom box btn button buttons col column container entry form global group icon icons inner "
    "item items js left link links list main mobile outer page post primary right row secondary section site slot top "
    "unit wp wrap wrapper".split()
)
#: Whole names of ambiguous words that prove furniture.
FURNITURE_WHOLE = frozenset(
    "comment-area comment-block comment-body comment-form comment-list comment-section comment-thread comments-thread "
    "copyright-notice recommended-articles recommended-posts related-articles related-content related-links "
    "related-posts related-stories reply-form reply-list share-bar share-box share-button share-buttons share-icons "
    "share-links social-bar social-buttons social-icons social-links social-media-links social-share skip-link skip-links "
    "skip-to-content".split()
)
#: Elements whose whole class name proves furniture, and words that do so at the end of a name.
PROVING = frozenset("div section ul ol li aside p".split())
PROVING_ENDS = frozenset(
    "ad ads advert adverts advertisement comment comments disqus newsletter notice notices replies reply sponsor "
    "sponsored".split()
)
#: At its start they say that the thing isn't there, or is elsewhere.
DENYING = frozenset("has hide no not show with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_MARKUP = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
#: A name and its value. Quoted values are consumed whole, so no name is found inside one.
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++)))?""")
_NAME = re.compile(r"[a-z]+")
_LINKED = frozenset(("a",))
#: Attributes that may tell of furniture.
_TELLING = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
#: Elements whose names say nothing.
_UNNAMED = HEADINGS | frozenset(("body", "html", "article", "main"))
#: Names that inside the content tell of its own head.
_HEADS = frozenset(("header", "masthead", "banner"))


def named_furniture(name: str, inside: bool) -> bool | None:
    """Whether a class or an id names furniture; None where the words of the element must tell."""
    words = _NAME.findall(name)
    known = FURNITURE_NAMES.intersection(words)
    if inside:
        known -= _HEADS
    if not known:
        return False
    if "-".join(words) in FURNITURE_WHOLE:
        return True
    if any(w not in FURNITURE_NAMES and w not in SHELL_NAMES for w in words):
        return False if inside else None  # a name about something else, such as share-prices
    return True if known - AMBIGUOUS_NAMES else None


def proven_furniture(name: str, inside: bool) -> bool:
    """Whether a class of a plain element is a name of furniture as a whole, such as ``notice`` or
    ``user-comments``."""
    words = _NAME.findall(name)
    if not words or inside and words[-1] in _HEADS:
        return False
    if len(words) == 1:
        return words[0] in FURNITURE_NAMES
    return words[-1] in PROVING_ENDS and words[0] not in DENYING


#: What holds neither a mark nor most of a page's running text is furniture.
NAMED = "named"


def is_furniture(tag: str, attributes: str, inside: bool) -> bool | str | None:
    """Whether an element holds page furniture: ``NAMED`` if only the content itself could say
    otherwise, None where its words must tell (``confirm``). A
    ``header`` inside the content is part of it. Headings aren't judged by names, nor paragraphs by
    ids: those are often made from their own words."""
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    found: bool | str | None = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in _TELLING:
            continue
        value = "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in FURNITURE_ROLES:
            return True
        if name in ("class", "id") and tag not in _UNNAMED and not (name == "id" and tag == "p"):
            for part in value.split():
                sure = named_furniture(part, inside)
                if sure:
                    return True
                if name == "class" and tag in PROVING and proven_furniture(part, inside):
                    found = NAMED
                elif sure is None and not found:
                    found = None
    return found


@dataclass
class Page:
    """A page as units in order: ``kind`` is the class of a text's words or of a tag."""

    kinds: list[str] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)  # words of a text, 1 for a tag
    texts: list[str | None] = field(default_factory=list)  # a text, or None for a tag
    breaks: list[bool] = field(default_factory=list)  # whether a tag ends a block
    inside: list[int] = field(default_factory=list)  # number of the outermost article or main, or 0
    furniture: list[bool] = field(default_factory=list)
    suspects: list[tuple[int, int, bool]] = field(default_factory=list)  # may be furniture; named so

    def add(self, kind, count, text, ends, inside, furniture) -> None:
        self.kinds.append(kind)
        self.counts.append(count)
        self.texts.append(text)
        self.breaks.append(ends)
        self.inside.append(inside)
        self.furniture.append(furniture)


def read(page: str) -> Page:
    out = Page()
    # tag, furniture, landmark, skipped, first unit of one that may be furniture or -1, named so
    stack: list[tuple[str, bool, bool, bool, int, bool]] = []
    furniture = landmarks = skipped = links = marks = 0
    block = "body"
    at = 0

    def pop() -> None:
        nonlocal furniture, landmarks, skipped, links
        tag, f, mark, s, suspect, named = stack.pop()
        if suspect >= 0:
            out.suspects.append((suspect, len(out.kinds), named))
        furniture -= f
        landmarks -= mark
        skipped -= s
        links -= tag in _LINKED

    def text(raw: str) -> None:
        if skipped or not raw:
            return
        words = len(raw.split())
        kind = ("furniture" if furniture else block) + (" link" if links else "")
        out.add("w " + kind, words, entities.unescape(raw), False, marks if landmarks else 0, furniture > 0)

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            while stack:
                pop()
            return out
        text(page[at : m.start()])
        at = m.end()
        if m.group(1) is not None:
            text(m.group(1))
        tag = m.group(3) or m.group(6)
        if tag is None:
            continue
        tag = tag.lower()
        attributes = m.group(4) or m.group(7) or ""
        ends = tag in BLOCK
        if m.group(2) or m.group(5):
            if any(x[0] == tag for x in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            if ends:
                block = "body"
            if not skipped:
                out.add("/" + tag, 1, None, ends, marks if landmarks else 0, furniture > 0)
            continue
        if tag in CLOSES_P and any(x[0] == "p" for x in stack):
            # an open paragraph ends here, and with it what is open inside it
            while stack[-1][0] != "p":
                pop()
            pop()
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            pop()
        if tag == "body":
            while stack and stack[-1][0] == "head":
                pop()
        if ends:
            block = tag
        if not skipped:
            out.add(tag, 1, " " if tag == "br" else None, ends, marks if landmarks else 0, furniture > 0)
        if tag in VOID or attributes.endswith("/"):
            continue
        s = tag in SKIPPED
        f = is_furniture(tag, attributes, landmarks > 0)
        open_ = f is None or f == NAMED
        stack.append((tag, f is True, tag in LANDMARK, s, len(out.kinds) if open_ else -1, f == NAMED))
        furniture += f is True
        marks += tag in LANDMARK and not landmarks
        landmarks += tag in LANDMARK
        skipped += s
        links += tag in _LINKED
        if tag in RAW:
            shut = re.compile(f"</{tag}\\b", re.I).search(page, at)
            at = shut.start() if shut else len(page)


@dataclass
class Weights:
    """Log-odds of each kind: inside the marked content against outside of it."""

    by_kind: dict[str, float] = field(default_factory=dict)

    def of(self, kind: str) -> float:
        if kind in self.by_kind:
            return self.by_kind[kind]
        if not kind.startswith("w "):
            return -0.5
        return -1.0 if "furniture" in kind or "link" in kind else 1.0


def confirm(page: Page, weights: Weights) -> None:
    """Marks as furniture what is named so, and what may be such and scores like it: links rather than
    running text. What holds a mark isn't, nor what holds most of the running text of a page
    without marks."""
    if not page.suspects:
        return
    score = [0.0, *accumulate(weights.of(kind) * n for kind, n in zip(page.kinds, page.counts))]
    held = [0, *accumulate(inside > 0 for inside in page.inside)]
    plain = ("w " + kind for kind in BLOCK | {"body"})
    running = frozenset(plain) - {"w furniture"}
    text = [0, *accumulate(n if kind in running else 0 for kind, n in zip(page.kinds, page.counts))]
    for begin, end, named in sorted(page.suspects, key=lambda s: (s[0], -s[1])):
        if begin == end or page.furniture[begin] or not named and score[end] - score[begin] > 0:
            continue
        if named and not held[-1] and 2 * (text[end] - text[begin]) > text[-1]:
            continue
        if not page.inside[begin] and held[end] > held[begin]:
            continue
        for k in range(begin, end):
            page.furniture[k] = True
            if page.kinds[k].startswith("w ") and "furniture" not in page.kinds[k]:
                page.kinds[k] = "w furniture" + (" link" if page.kinds[k].endswith(" link") else "")


def count_kinds(page: Page) -> Counter:
    """``(kind, inside)`` counts of a page that marks its content; of others none."""
    counts: Counter = Counter()
    if any(page.inside):
        for kind, n, inside in zip(page.kinds, page.counts, page.inside):
            counts[kind, inside > 0] += n
    return counts


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Weights:
    """Weights from the ``sample`` pages with the smallest hash of their id and url."""
    chosen = pages.select("page_id", "url", "html").orderBy(F.xxhash64("page_id", "url"), F.xxhash64("html")).limit(sample)
    schema = pa.schema([("kind", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for part in batches:
            for page in part.column("html").to_pylist():
                total += count_kinds(read(page or ""))
        if total:
            yield batch(schema, [k for k, _ in total], [i for _, i in total], list(total.values()))

    rows = map_arrow(chosen.select("html"), job, "kind string, inside boolean, n long")
    counts = rows.groupBy("kind").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"),
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o"),
    ).where("i + o >= 20")
    weights = {}
    for kind, i, o in counts.collect():  # one row per kind of word or tag
        odds = math.log((i + 1) / (o + 1))
        # words say what a region is, tags only how it is cut: they never score positive
        weights[kind] = max(-3.0, min(3.0, odds)) if kind.startswith("w ") else max(-1.0, min(-0.01, odds))
        if "furniture" in kind:
            weights[kind] = min(weights[kind], -0.5)
    return Weights(weights)


def best_region(scores: list[float]) -> tuple[int, int]:
    """``[begin, end)`` of the contiguous part with the largest positive sum."""
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for k, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, begin, end = total, start, k + 1
    return begin, end


def mark_weights(page: Page, weights: Weights) -> tuple[list[float], list[bool]]:
    """What standing outside (0) or inside the k-th mark adds to a word, and which marks are read
    for themselves."""
    mass = [0.0] * (max(page.inside, default=0) + 1)  # of running text
    for kind, n, inside in zip(page.kinds, page.counts, page.inside):
        if kind.startswith("w "):
            mass[inside] += max(0.0, weights.of(kind)) * n
    if len(mass) == 1:
        return [0.0], [False]
    total = sum(mass)
    odds = MARK_WEIGHT * math.log((total - mass[0] + 1) / (mass[0] + 1))
    odds = max(-MOST_MARK, min(MOST_MARK, odds))
    fair = [m > 0 and m >= FAIR_PART * total for m in mass]
    own = [-max(0.0, odds)] + [max(0.0, odds) if f else odds for f in fair[1:]]
    return own, [False] + [f or odds > 0 for f in fair[1:]]


def unit_scores(page: Page, weights: Weights, marks: list[float]) -> list[float]:
    scores = []
    for kind, n, inside in zip(page.kinds, page.counts, page.inside):
        score = weights.of(kind) + marks[inside]
        if not kind.startswith("w "):
            score = max(-1.0, min(0.0, score))
        elif "furniture" in kind:
            score = min(0.0, score)
        scores.append(score * n)
    return scores


def chosen_units(page: Page, scores: list[float], read_alone: list[bool]) -> bytearray:
    """1 for the units of the best region and of the best regions within marks."""
    chosen = bytearray(len(scores))
    begin, end = best_region(scores)
    chosen[begin:end] = b"\1" * (end - begin)
    k = 0
    for mark, run in groupby(page.inside):
        n = sum(1 for _ in run)
        if read_alone[mark]:
            begin, end = best_region(scores[k : k + n])
            chosen[k + begin : k + end] = b"\1" * (end - begin)
        k += n
    if not any(chosen):  # nothing but links: what is marked as content is that
        for k, inside in enumerate(page.inside):
            chosen[k] = inside > 0 and not page.furniture[k]
    return chosen


def blocks(page: Page, weights: Weights) -> list[str]:
    confirm(page, weights)
    marks, read_alone = mark_weights(page, weights)
    scores = unit_scores(page, weights, marks)
    chosen = chosen_units(page, scores, read_alone)
    found, held, total, outside = [], [], 0.0, False

    def end_block() -> None:
        nonlocal held, total, outside
        # where the marks tell, a block outside them that scores negative is only passed over
        if not (outside and total < 0):
            found.append("".join(held))
        held, total, outside = [], 0.0, False

    for k, taken in enumerate(chosen):
        if page.breaks[k] or not taken:
            end_block()
        elif page.texts[k] and not page.furniture[k]:
            held.append(page.texts[k])
            if page.texts[k].strip():
                total += scores[k]
                outside = outside or marks[0] < 0 and not page.inside[k]
    end_block()
    return [b for b in (" ".join(x.split()) for x in found) if b]


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """``(page_id, url, text)`` of every page."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = ["\n\n".join(blocks(read(page or ""), weights)) for page in part.column("html").to_pylist()]
            yield batch(_TEXT, part.column("page_id"), part.column("url"), texts)

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_arrow(own, job, "page_id long, url string, text string")
