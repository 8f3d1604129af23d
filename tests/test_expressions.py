"""Column expressions on hand-written values."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.functions import display, paths
from docloom.functions.querytext import classify
from docloom.functions.tokens import term_counts, tokens


def values(spark, expression, inputs):
    """The expression over a column ``x``, one result per input, in order."""
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


VECTORS = [
    ("pdf patient", ["pdf"], ["patient"], []),
    ("quality NOT IUH", [], ["quality"], ["IUH"]),
    ("pdf quality disparities", ["pdf"], ["quality", "disparities"], []),
    ("xlsx pathology", ["xlsx"], ["pathology"], []),
    ("NOT (foo bar) baz", [], ["bar", "baz"], ["foo"]),
    ("a OR b", [], ["a", "b"], []),
    ("a AND NOT b", [], ["a"], ["b"]),
    ("-draft report", [], ["report"], ["draft"]),
    ("-(draft)", [], [], ["draft"]),
    (".PDF", ["pdf"], [], []),
    ("pdf docx x", ["pdf", "docx"], ["x"], []),
    ("a NOT", [], ["a"], []),
    ("NOT pdf report", [], ["report"], ["pdf"]),
    ("vitamin c", ["c"], ["vitamin"], []),
    ("-", [], ["-"], []),
    ("NOT ()", [], [], []),
    ("cannot(x) y", [], ["can", "y"], ["x"]),
    ('"exact phrase"', [], ['"exact', 'phrase"'], []),
    ("(a) b", [], ["(a)", "b"], []),
    ("NOT -x", [], [], ["-x"]),
    # beyond the listed ones
    ("", [], [], []),
    ("  not  NOT x y ", [], ["x", "y"], ["NOT"]),
    ("NOT NOT NOT a", [], [], ["NOT", "a"]),
    ("and or NOTE nota", [], ["NOTE", "nota"], []),
    ("x -() not ((y))", [], ["x", ")"], ["", "y"]),  # the group ends at the first ")"
]


def test_query_vectors(spark):
    got = values(spark, classify, [v[0] for v in VECTORS])
    for (text, types, must, must_not), row in zip(VECTORS, got):
        assert (row.file_types, row.must_terms, row.must_not_terms) == (types, must, must_not), text


def test_token_vector(spark):
    text = "quality_report.pdf report2.pdf O'Neil's 3.14 1,000 a.b.c covid-19 Don’t x. -"
    expected = [
        "quality_report.pdf", "report2", "pdf", "o'neil's", "3.14", "1,000", "a.b.c", "covid",
        "19", "don’t", "x",
    ]
    assert values(spark, tokens, [text, None, "", "- ."]) == [expected, [], [], []]


_PIECES = list("aZé_9٣'’.:;,·- \n\t") + ["ß", "İ", "e\u0301", "漢", "🙂", "١٢", "x.y", "1,2"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(_PIECES), max_size=25).map("".join), max_size=40))
def test_tokens_equal_the_plain_pattern(spark, texts):
    import regex

    plain = regex.compile(
        r"(?:[\p{L}\p{M}\p{N}_]|(?<=\p{L})[.'’:·](?=\p{L})|(?<=\p{N})[.,;'](?=\p{N}))+"
    )
    assert values(spark, tokens, texts) == [plain.findall(t.lower()) for t in texts]


def test_very_long_tokens(spark):
    chain = ",".join(["1"] * 50_000)
    word = "x" * 200_000
    assert values(spark, tokens, [chain, word]) == [[chain], [word]]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "cc", "é", "A"]), max_size=30), max_size=20))
def test_term_counts_equal_counter(spark, lists):
    texts = [" ".join(x) for x in lists]
    got = values(spark, lambda x: term_counts(tokens(x)), texts)
    for text, counts in zip(texts, got):
        assert {c.term: c.tf for c in counts} == dict(Counter(text.lower().split()))


@pytest.mark.parametrize(
    "path, norm",
    [
        ("/A/b.TXT", "/a/b.txt"),
        ("/a//b/./c/../d.txt", "/a/b/d.txt"),
        ("C:\\Docs\\..\\X\\y.PDF", "c:/x/y.pdf"),
        ("/../a", "/a"),
        ("/a/b/", "/a/b"),
        ("file:/a/b.txt", "/a/b.txt"),
        ("file:///a/b.txt", "/a/b.txt"),
        ("s3a://Bucket/a/../b.txt", "s3a://bucket/b.txt"),
        ("/a/..b/c...d", "/a/..b/c...d"),
    ],
)
def test_norm_path(spark, path, norm):
    assert values(spark, paths.norm_path, [path]) == [norm]


def test_extensions(spark):
    names = ["a.tar.gz", "a.PDF", ".bashrc", ".a.b", "a", "a.", "..x", "a.b c", "x.y\nz"]
    assert values(spark, paths.file_extension, names) == [
        ".gz", ".pdf", "", ".b", "", ".", "", ".b c", ".y\nz",
    ]
    assert values(spark, paths.file_type, names)[:3] == ["gz", "pdf", ""]
    assert paths.normalise_extensions(["CSV", ".Zip"]) == [".csv", ".zip"]
    assert values(spark, paths.normalise_extension, ["CSV", ".Zip"]) == [".csv", ".zip"]


def test_path_parts_and_destination(spark):
    p = ["/a/B c/d.txt", "D:\\x\\y.pdf"]
    assert values(spark, paths.file_name, p) == ["d.txt", "y.pdf"]
    assert values(spark, paths.file_directory, p) == ["/a/B c", "D:/x"]
    got = values(spark, lambda x: paths.backup_destination(x, "/bk/"), p)
    assert got == ["/bk/a/B c/d.txt", "/bk/x\\y.pdf"]


def test_display_dates(spark):
    texts = ["2024-01-05T13:07:00", "badTdate", "", None, "2024-01-05", "2024-13-45T01:00:00",
             "2024-01-05T00:07:00.123456", "2024-01-05T13:07:00+02:00"]
    assert values(spark, display.display_date, texts) == [
        "Jan 05, 2024, 01:07 PM", "bad", "", "", "Jan 05, 2024, 12:00 AM", "2024-13-45",
        "Jan 05, 2024, 12:07 AM", "Jan 05, 2024, 01:07 PM",
    ]


def test_iso_timestamp_drops_zero_fraction(spark):
    ts = ["2024-01-05 13:07:00", "2024-01-05 13:07:00.5"]
    got = values(spark, lambda x: display.iso_timestamp(x.cast("timestamp_ntz")), ts)
    assert got == ["2024-01-05T13:07:00", "2024-01-05T13:07:00.500000"]


def test_url_quote(spark):
    raw = ["a b/c~*é+.pdf", "D:\\x y\\100%.txt"]
    quoted = ["a%20b/c~%2A%C3%A9%2B.pdf", "D%3A/x%20y/100%25.txt"]
    assert values(spark, display.url_quote, raw) == quoted
    assert values(spark, display.url_unquote, quoted) == ["a b/c~*é+.pdf", "D:/x y/100%.txt"]
    assert values(spark, display.url_unquote, ["50%", "a+b"]) == ["50%", "a+b"]


def test_html_escape(spark):
    assert values(spark, display.html_escape, ["<a href=\"x\">&'"]) == [
        "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    ]


def test_snippet_and_preview(spark):
    assert values(spark, display.snippet, ["ab", "", None, "x" * 400]) == [
        "ab...", C.NO_PREVIEW, C.NO_PREVIEW, "x" * 300 + "...",
    ]
    text = "a\r\nb\n\n" + "c" * 60 + "\r" + "\n".join("l%d" % i for i in range(40))
    want = [s[:45] for s in text[:500].splitlines()[:18]]
    assert values(spark, display.preview_lines, [text, "x\n", ""]) == [want, ["x"], []]


def test_mime_types(spark):
    assert values(spark, display.mime_type, ["pdf", "JPG", "zip", None]) == [
        "application/pdf", "image/jpeg", "application/octet-stream", "application/octet-stream",
    ]


@pytest.mark.parametrize(
    "total, page, want",
    [
        (0, 1, (0, 1, 0, 0, 1, 1, 0)),
        (100, 1, (100, 1, 1, 100, 1, 1, 0)),
        (250, 2, (250, 3, 101, 200, 1, 3, 50)),
        (250, 3, (250, 3, 201, 250, 2, 3, 0)),
    ],
)
def test_page_columns(spark, total, page, want):
    row = spark.range(1).select(*display.page_columns(F.lit(total), F.lit(page))).first()
    assert tuple(row) == want
