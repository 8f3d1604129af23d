"""Quality network, main text, archives and decontamination."""

import hashlib
import html.parser
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import byte_cnn, decontaminate, html_text, warc
from docloom.llm.common import byte_column, table
from docloom.llm.decontaminate import tile
from docloom.llm.html_text import Weights, best_region, blocks, read
from llm_rows import ODD, SF_DIR, frame

# --- quality ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def network(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return byte_cnn.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), steps=150)


def test_accuracy_on_held_out_rows(spark, network):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = byte_cnn.score(docs, network).join(labels, "doc_id").where(byte_cnn.held_out()).collect()
    assert len(rows) > 50
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


def test_score_is_the_network_written_out(network):
    texts = ["", "a", "x" * 127, "y" * 128, "z" * 129, "Abc!! " * 60, "é|" * 500]
    raw, offsets = byte_column(pa.array(texts))
    got = byte_cnn.Scorer(network).score(raw, offsets)
    for text, score in zip(texts, got):
        b = text.encode() or b"\0"
        padded = np.frombuffer(b + bytes(byte_cnn.WIDTH), np.uint8)
        response = np.array([sum(network.taps[k][padded[i + k]] for k in range(byte_cnn.WIDTH)) for i in range(len(b))])
        chunks = [response[s : s + byte_cnn.CHUNK].max(0) for s in range(0, max(1, len(b) - byte_cnn.BLOCK), byte_cnn.BLOCK)]
        pooled = np.maximum(np.array(chunks) + network.bias, 0)
        z = pooled.mean(0) @ network.mean + pooled.max(0) @ network.top + network.offset
        assert abs(1 / (1 + np.exp(-z)) - score) < 1e-4


def test_scores_of_odd_rows(spark, odd_docs, no_docs, network):
    rows = byte_cnn.score(odd_docs, network).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert byte_cnn.score(no_docs, network).count() == 0
    kept = byte_cnn.accepted(odd_docs, network, 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == len(ODD)


def test_training_never_sees_held_out_rows(spark, docs):
    known = table(spark, SF_DIR, "labels")
    flipped = known.withColumn("quality", F.when(byte_cnn.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = byte_cnn.train(docs, known, steps=5), byte_cnn.train(docs, flipped, steps=5)
    assert (a.taps == b.taps).all() and a.offset == b.offset
    ids = [r.doc_id for r in known.where(byte_cnn.held_out()).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)


def test_training_without_labels(spark, docs, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    net = byte_cnn.train(docs, none)
    assert {r.score for r in byte_cnn.score(odd_docs, net).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 1), (8, 0)], "doc_id long, quality int")
    byte_cnn.train(odd_docs, odd, steps=2)


def test_training_reads_whole_texts_and_each_id_once(spark, monkeypatch):
    size = byte_cnn.CHUNK + byte_cnn.WIDTH - 1
    for n in (0, 1, 127, 128, 129, 255, 256, 257, 5000):
        raw = bytes(np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8))
        chunks = byte_cnn.all_chunks(raw)
        assert all(len(c) == size for c in chunks)
        assert b"".join(c[: byte_cnn.BLOCK] for c in chunks[:-1]) + chunks[-1].rstrip(b"\0") == raw

    seen = []
    monkeypatch.setattr(byte_cnn, "fit", lambda chunks, counts, labels, steps: seen.append((len(chunks), counts.tolist(), labels.tolist())))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:3]
    texts = [(ids[0], "a" * 1000), (ids[0], "a" * 1000), (ids[0], "b"), (ids[1], "c" * 300), (ids[2], "d" * (byte_cnn.SAMPLE_BYTES + 1))]
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    byte_cnn.train(frame(spark, texts), labels)
    assert sorted(seen[0][1]) == [2, 7] and seen[0][0] == 9 and seen[0][2] == [1, 1]


# --- main text ----------------------------------------------------------------------------

PRIOR = Weights()


def text(page, weights=PRIOR):
    return "\n\n".join(blocks(read(page), weights))


def test_article_without_furniture():
    page = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div>
    <main><article><header><h1>A &amp; B</h1></header><p>First <b>bold</b>  line<br>goes on.</p>
    <div class="ad">Buy now</div><script>var x = "</p><p>no</p>";</script><!-- no <p>comment</p> -->
    <ul><li>one<li>two</ul><form><input> Name <button>Send</button></form><p>Last&nbsp;&lt;tag&gt;</p></article>
    <aside>Related</aside><section id="comments"><p>I agree.</p></section></main><footer>&copy; us</footer></body></html>"""
    assert text(page) == "A & B\n\nFirst bold line goes on.\n\none\n\ntwo\n\nLast <tag>"


@pytest.mark.parametrize("attributes", [
    'style="overflow:hidden"', "style='overflow-x: hidden'", 'title="The hidden truth"', 'data-id="related"', 'data-hidden',
    'data-x="class=ad"', "data-class=ad", 'alt=\'id="menu"\'', 'aria-hidden="false"', 'data-role="navigation"',
])
def test_attributes_that_only_look_like_furniture(attributes):
    assert text(f"<body {attributes}><article {attributes}><div {attributes}>One two.</div><p {attributes}>Three.</p></article>") == "One two.\n\nThree."
    assert text(f"<div {attributes}>One two three.</div><p {attributes}>Four five six.</p>") == "One two three.\n\nFour five six."


@pytest.mark.parametrize("attributes", ["hidden", 'HIDDEN=""', 'x="1"hidden', "aria-hidden = true", "role=menu", 'title=">" class="x ad"', "style=a:b/hidden id='cookie-notice'"])
def test_attributes_of_furniture(attributes):
    assert text(f"<article><p>One two three.</p><div {attributes}>Four</div></article>") == "One two three."


def test_page_without_marks(spark):
    page = "<body><div class='menu'><a href=x>a b c d</a></div><div><p>Some running text that goes on.<p>And more of it.</div><div class=footer>foot foot</div>"
    assert text(page) == "Some running text that goes on.\n\nAnd more of it."
    weights = html_text.learn(table(spark, SF_DIR, "pages"))
    assert weights.by_kind["w p"] > 0 > weights.by_kind["w furniture link"]
    assert text(page, weights) == "Some running text that goes on.\n\nAnd more of it."


@pytest.mark.parametrize("page", ["", "<", "<<<>>>", "<p", "<p class='x", "a < b and c > d", "<script>", "</p></div>", "<!-- open", "<p>a<p>b", "<a href='>'>x</a>", "&#0;&#xD800;&bogus;", "<article>" * 500])
def test_broken_pages(page):
    text(page)


def test_broken_pages_keep_their_words():
    assert text("<article><p>unclosed <b>bold") == "unclosed bold"
    assert text("<p>a<p>b") == "a\n\nb"
    assert text("a < b") == "a < b"


@pytest.mark.parametrize("tag, attributes", [
    ("h2", 'id="related-work"'), ("h3", 'id="social-policy"'), ("h2", 'class="comments"'), ("p", 'id="notice-period"'), ("p", 'id="comments"'),
    ("section", 'id="discussion"'), ("div", 'class="share-prices"'), ("section", 'id="copyright"'), ("div", 'class="entry social-history"'),
])
def test_names_made_from_words_of_the_content(tag, attributes):
    own = some("own", 12)
    assert text(f"<article><p>First one.</p><{tag} {attributes}>{own}</{tag}><p>Last one.</p></article>") == f"First one.\n\n{own}\n\nLast one."


@pytest.mark.parametrize("name", ["comments", "share-buttons", "related-posts", "ad", "ad_slot-3", "comment-list", "newsletter box", "x sidebar"])
def test_names_of_furniture_inside_the_content(name):
    for attribute in ("id", "class"):
        assert text(f'<article><p>First one.</p><div {attribute}="{name}"><p>{some("own", 12)}</p></div><p>Last one.</p></article>') == "First one.\n\nLast one."


NOT_CONTENT = [
    "comment", "user-comments", "reader-comments", "notice", "notices", "site-notice", "related", "discussion", "reply",
    "replies", "share", "copyright", "sponsor", "alert", "user_comment", "x notice",
]


@pytest.mark.parametrize("name", NOT_CONTENT)
def test_running_text_of_furniture_goes(name):
    own = some("own", 40)
    for tag in ("div", "p", "section"):
        thing = f'<{tag} class="{name}">{own}</{tag}>'
        assert text(f"<article><p>First one.</p>{thing}<p>Last one.</p></article>") == "First one.\n\nLast one."
        main = some("main", 60)
        assert text(f"<body><div><p>{main}</p></div>{thing}<div><p>{main}</p></div></body>") == f"{main}\n\n{main}"


@pytest.mark.parametrize("attributes", ['class="no-comments"', 'class="has-notices"', 'class="related-work"', 'class="notice-period"', 'id="user-comments-1"'])
def test_running_text_of_other_names_stays(attributes):
    own = some("own", 40)
    assert own in text(f"<article><p>First one.</p><div {attributes}><p>{own}</p></div><p>Last one.</p></article>")


def test_articles_of_links_alone():
    assert text("<body><nav><a href=x>a b</a></nav><article><p><a href=y>The one link</a></p></article></body>") == "The one link"


class Plain(html.parser.HTMLParser):
    """The blocks of ``article``, read by another parser, without ``nav``, ``footer`` and ``.ad``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data(" ")
            return
        if tag in ("p", "h1", "div", "article", "ul", "li") :
            self.blocks.append("")
        if tag not in ("meta",):
            self.open.append((tag, ("class", "ad") in attrs or tag in ("nav", "footer", "script", "style", "title")))

    def handle_endtag(self, tag):
        names = [t for t, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]
        if tag in ("p", "h1", "div", "article", "ul", "li"):
            self.blocks.append("")

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(bad for _, bad in self.open):
            self.blocks[-1] += data

    @classmethod
    def text(cls, page):
        p = cls()
        p.feed(page)
        p.close()
        return "\n\n".join(b for b in (" ".join(x.split()) for x in p.blocks) if b)


def test_given_pages_by_another_parser(spark, learned):
    pages = table(spark, SF_DIR, "pages")
    got = {r.page_id: r.text for r in html_text.extract(pages, learned).collect()}
    assert got == {r.page_id: Plain.text(r.html or "") for r in pages.collect()}


def test_words_confirm_what_a_name_leaves_open():
    links = "<ul>" + "<li><a href=x>two words</a>" * 8 + "</ul>"
    for name in ("related", "navigation", "social"):
        assert text(f'<article><p>First one.</p><div class="{name}">{links}</div><p>Last one.</p></article>') == "First one.\n\nLast one."
    own = some("own", 30)
    for name in ("has-sidebar", "layout-menu-left", "related"):
        assert text(f'<body><div class="{name}"><article><p>{own}</p></article></div>') == own
        assert text(f'<body><div class="{name}"><p>{own}</p></div>') == own


def some(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.fixture(scope="module")
def learned(spark):
    return html_text.learn(table(spark, SF_DIR, "pages"))


@pytest.mark.parametrize("gap", ["<p>{}</p>", "<div class='ad'>{}</div>", "<ul><li><a href=x>{}</a></ul>"])
def test_separated_articles_are_all_read(learned, gap):
    a, b, out = some("a", 200), some("b", 30), gap.format(some("out", 60))
    for weights in (PRIOR, learned):
        assert text(f"<body><article><p>{a}</p></article>{out}<article><p>{b}</p></article></body>", weights) == f"{a}\n\n{b}"


def test_teasers_alone_are_articles(learned):
    main = [some(x, 80) for x in "abc"]
    card = "<article><h3><a href=x>more to read</a></h3><p>a short teaser</p></article>"
    for page in ("<div>{main}</div>" + card * 3, card * 3 + "<div>{main}</div>", card + "<div>{main}</div>" + card * 2):
        for weights in (PRIOR, learned):
            assert text("<body>" + page.format(main="".join(f"<p>{p}</p>" for p in main)), weights) == "\n\n".join(main)


def test_an_article_beside_much_other_text(learned):
    a, other = some("a", 100), some("c", 400)
    for weights in (PRIOR, learned):
        got = text(f"<article><p>{a}</p></article><nav><a href=x>{some('n', 700)}</a></nav><div><p>{other}</p></div>", weights)
        assert a in got and "n1 " not in got


def test_nothing_inside_a_marked_article_is_cut(learned):
    inner = f"<p>{some('a', 50)}</p><ul>" + "<li><a href=x>link words</a>" * 30 + "</ul>" + "<figure><img></figure>" * 200 + "<p>The end.</p>"
    for weights in (PRIOR, learned):
        want = "\n\n".join([some("a", 50), *["link words"] * 30, "The end."])
        assert text(f"<body><p>Before it.</p><article>{inner}</article><p>After it.</p>", weights) == want


def test_best_region_by_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-2, -1, 0, 1, 2]) for _ in range(rng.randrange(0, 12))]
        best = max([sum(scores[a:b]) for a in range(len(scores) + 1) for b in range(a, len(scores) + 1)])
        a, b = best_region(scores)
        assert sum(scores[a:b]) == max(best, 0)


def test_pages_of_any_kind(spark):
    rows = [(1, "u", None), (None, None, "<p>x</p>"), (2, "u", ""), (2, "u", "<p>" + "long " * 50000 + "</p>"), (3, "v", "<p>same</p>"), (3, "v", "<p>same</p>")]
    pages = frame(spark, rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.url or "", r.text) for r in html_text.extract(pages, html_text.learn(pages)).collect()))
    assert got == sorted([(1, "u", ""), (0, "", "x"), (2, "u", ""), (2, "u", ("long " * 50000).strip()), (3, "v", "same"), (3, "v", "same")])
    assert html_text.extract(pages.limit(0), html_text.learn(pages.limit(0))).count() == 0


# --- archives -----------------------------------------------------------------------------

BIG = "<p>" + "same payload " * 100 + "</p>"
PAGES = [
    (1, "http://a/é?x=1 2", BIG), (2, None, BIG), (3, "http://c", "small"), (4, "http://d", "small"), (5, "e", None),
    (None, "null id", BIG), (6, "f", ""), (7, "g", BIG + "!"), (7, "g", BIG + "!"), (8, "h\r\ni", "x" * 300000),
]


def want_records():
    out = []
    for p, _, h in PAGES:
        b = (h or "").encode()
        same = [q if q is not None else -(2**63) for q, _, x in PAGES if (x or "") == (h or "")]
        own = p if p is not None else -(2**63)
        repeat = len(b) >= 1000 and own != max(same)
        out.append((str(p), len(b), hashlib.sha1(b).hexdigest(), "revisit" if repeat else "response", str(max(same) if repeat else None)))
    return sorted(out)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_archives_round_trip(spark, tmp_path, scheme):
    pages = frame(spark, PAGES, "page_id long, url string, html string")
    folder = f"{scheme}{tmp_path}/w"
    files = warc.write_archives(pages, folder, file_bytes=2000)
    assert len(files) > 3
    for listed in (files, None):
        rows = warc.read_archives(spark, folder, listed).where("record_type <> 'warcinfo'").select(
            warc.page_of("record_id").alias("p"), warc.page_of("refers_to").alias("r"), "*"
        ).collect()
        assert sorted((str(r.p), r.payload_bytes, r.payload_digest, r.record_type, str(r.r)) for r in rows) == want_records()
        for r in rows:
            if r.record_type == "response":
                assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
            else:
                assert r.payload == b""


def test_archives_filters_and_partitions(spark, tmp_path):
    pages = frame(spark, PAGES, "page_id long, url string, html string")
    files = warc.write_archives(pages, str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w"), files).where("record_type = 'response' and payload_bytes > 1000")
    assert sorted(r.payload_bytes for r in found.collect()) == [len(BIG.encode()), len(BIG) + 1, len(BIG) + 1, 300000]
    narrow = warc.read_archives(spark, str(tmp_path / "w"), files, "record_type string")
    assert narrow.where("record_type = 'revisit'").count() == 2
    reader = warc.WarcReader(narrow.schema, {"path": str(tmp_path / "w"), "target": "1"})
    assert len(reader.partitions()) == len(files)


def test_foreign_archives(spark, tmp_path):
    """Members without lengths in their headers, and a plain file."""
    import gzip

    rec = lambda i, body: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    bodies = ["one", "two" * 40000, ""]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(rec(i, b)) for i, b in enumerate(bodies)))
    (tmp_path / "b.warc").write_bytes(b"".join(rec(i, b) for i, b in enumerate(bodies)))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.payload.decode() for r in rows) == sorted(bodies * 2)
    only = warc.read_archives(spark, str(tmp_path)).where("record_id = 'urn:x:2'").collect()
    assert [r.payload for r in only] == [b"", b""]


def test_archives_of_no_rows(spark, tmp_path):
    pages = frame(spark, [], "page_id long, url string, html string")
    files = warc.write_archives(pages, str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none"), files).count() == 0


# --- decontamination ----------------------------------------------------------------------


def plain_tiles(item, doc, shortest):
    """Greedy string tiling by trying every pair of places."""
    mi, md, tiles = [0] * len(item), [0] * len(doc), []
    while True:
        best, found = shortest, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not mi[i + k] and not md[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        if not found:
            return sorted(tiles)
        for i, j in sorted(found):
            if not any(mi[i : i + best]) and not any(md[j : j + best]):
                mi[i : i + best] = md[j : j + best] = [1] * best
                tiles.append((i, j, best))


def test_tiles_by_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        k, m = rng.choice([2, 3, 6]), rng.choice([1, 2, 3])
        item = [rng.randrange(k) for _ in range(rng.randrange(0, 25))]
        doc = [rng.randrange(k) for _ in range(rng.randrange(0, 40))]
        assert sorted(tile(np.array(item, np.uint64), np.array(doc, np.uint64), m)) == plain_tiles(item, doc, m)


def test_repeated_words_need_little_memory():
    import tracemalloc

    for item, doc in ((["a"] * 5000, ["a"] * 100_000), (["a", "b"] * 600, (["a"] + ["b", "a"] * 150 + ["c"]) * 60),
                      (["a"] * 1200, (["a"] * 700 + ["z"]) * 40)):
        number = {w: np.uint64(i + 1) for i, w in enumerate(dict.fromkeys(item + doc))}
        a, b = (np.array([number[w] for w in x], np.uint64) for x in (item, doc))
        tracemalloc.start()
        tiles = tile(a, b, 5)
        block = decontaminate.Block.of([1], [" ".join(item)], 5)
        docs = decontaminate.Block.of([1], [" ".join(doc)], 5)
        found = decontaminate._leaks(block, 5, 0.5, docs.words, docs.offsets)
        assert tracemalloc.get_traced_memory()[1] < 100e6
        tracemalloc.stop()
        assert sum(t[2] for t in tiles) >= len(item) - 5 and len(found) == 1
        for i, d, n in tiles:
            assert (a[i : i + n] == b[d : d + n]).all()
        places = [{k for t in tiles for k in range(t[side], t[side] + t[2])} for side in (0, 1)]
        assert len(places[0]) == len(places[1]) == sum(t[2] for t in tiles)


def test_longer_tiles_by_brute_force():
    rng = random.Random(2)
    for _ in range(25):
        k = rng.choice([1, 2, 4])
        piece = [rng.randrange(k) for _ in range(12)]
        item = [rng.randrange(k + 1) for _ in range(5)] + piece * rng.randrange(1, 4)
        doc = [x for _ in range(4) for x in (*piece[rng.randrange(6) :], rng.randrange(k + 2))] * 2
        assert sorted(tile(np.array(item, np.uint64), np.array(doc, np.uint64), 3)) == plain_tiles(item, doc, 3)


ITEM = [f"w{i}" for i in range(40)]


def test_leaks(spark, odd_docs, no_docs):
    other = [f"o{i}" for i in range(200)]
    rows = [
        (1, " ".join(other[:50] + ITEM + other[50:])),
        (2, " ".join(ITEM[20:] + other[:90] + ITEM[:20]).upper()),  # reordered, other case
        (3, " ".join(ITEM[:19] + other)),  # under half
        (4, " ".join(x for p in zip(ITEM[::4], ITEM[1::4], ITEM[2::4], ITEM[3::4], other) for x in p)),  # short pieces
        (5, None), (6, ""), (7, "alpha beta gamma"), (8, "alpha x beta gamma"), (1, "same id"),
        (9, ", ".join(ITEM)), (9, ", ".join(ITEM)),
    ]
    items = [(70, " ".join(ITEM)), (71, "Alpha, beta: gamma!"), (72, None), (73, ""), (None, " ".join(other[100:140]))]
    bench = frame(spark, items, "item_id long, text string")
    docs = frame(spark, rows)
    want = [(1, 70), (1, None), (2, 70), (3, None), (7, 71), (9, 70), (9, 70)]
    for most in (1, 1 << 20):
        got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, block_grams=most).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    parts = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert parts[2, 70].n_tiles == 2 and parts[2, 70].coverage == 1.0
    assert [tuple(t) for t in parts[2, 70].tiles] == [(0, 110, 20), (20, 0, 20)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 4, 5, 6, 8]
    assert decontaminate.leaks(odd_docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(no_docs, bench).count() == 0
    assert decontaminate.leaks(odd_docs, bench).count() == 0


def test_leaks_in_given_documents(spark, docs, doc_rows):
    import re

    words = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t.lower())
    items = [(r.item_id, words(r.text)) for r in table(spark, SF_DIR, "benchmark").collect()]
    want = set()
    for d, t in doc_rows:
        w = words(t)
        seeds = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for item, v in items:
            if any(tuple(v[i : i + 5]) in seeds for i in range(len(v) - 4)):
                if sum(n for _, _, n in plain_tiles(v, w, 5)) >= 0.5 * len(v):
                    want.add((d, item))
    got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, table(spark, SF_DIR, "benchmark")).collect()]
    assert want and sorted(got) == sorted(want)
