"""Media, chat and page operators: round trips, brute force and hand-made pages."""

import hashlib
import io
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import chat, html, media

DOCS = "doc_id bigint, text string"


def test_netpbm_and_bmp():
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (4, 6, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all() and (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P6 # note\n6 4\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P3\n2 1\n# c\n255\n1 2 3 4 5 6") == [[[1, 2, 3], [4, 5, 6]]]).all()
    assert (media.decode(b"P2 3 1 255 9 8 7") == [[9, 8, 7]]).all() and (media.decode(b"P1\n3 1\n0 1 0") == [[255, 0, 255]]).all()
    assert (media.decode(b"P4\n3 1\n\x40") == [[255, 0, 255]]).all() and media.decode(b"P5\n1 1\n65535\n\x01\x02")[0, 0] == 258
    for broken in (b"", b"P5", b"BM", b"P5\n9 9\n255\nabc", b"GIF89a"):
        with pytest.raises((ValueError, IndexError)):
            media.decode(broken)


@pytest.mark.parametrize("size", [(1, 1), (3, 5), (8, 9), (20, 2)])
def test_area_resize(size):
    rng = np.random.default_rng(2)
    source = rng.integers(0, 256, (7, 11)).astype(float)
    fine = np.repeat(np.repeat(source, size[0], 0), size[1], 1)  # each target cell is then whole source cells
    want = fine.reshape(size[0], 7, size[1], 11).mean((1, 3))
    assert np.allclose(media.area_resize(source, *size), want)


def test_text_media(spark):
    rows = [(1, "abc é"), (2, None), (3, ""), (4, "x" * 64), (5, "y" * 10_000), (5, "y" * 10_000)]
    got = media.media_columns(media.text_media(spark.createDataFrame(rows, DOCS))).collect()
    for r in got:
        text = (dict(rows)[r.doc_id] or "").encode()
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert np.load(io.BytesIO(r.tile)).shape == (32, 32) and len(r.dhash) == 16
    assert len(got) == 6


def test_media_edges(spark):
    df = spark.createDataFrame([(1, None, 9), (2, bytearray(b""), 9), (3, bytearray(b"junk"), 9)], "id bigint, media binary, width int")
    got = {r.id: r for r in media.media_columns(df).collect()}
    assert got[1].media_sha256 is None and got[3].media_sha256 == hashlib.sha256(b"junk").hexdigest() and all(r.tile is None and r.width is None for r in got.values())


def test_media_never_fails_on_any_bytes(spark):
    rng = random.Random(3)
    good = [media.encode_pgm(np.arange(12, dtype=np.uint8).reshape(3, 4)), media.encode_bmp(np.zeros((3, 4, 3), np.uint8)), media.encode_bmp(np.zeros((3, 4), np.uint8)), b"P2 3 1 15 0 7 15", b"P1 2 2 1 0 0 1", b"P4\n9 1\n\x40\x80", b"P6 1 1 1023 " + b"\x03\xff" * 3]
    cases = [b"P5\n99999999999999999999 1\n255\nx", b"P2 1 1 255 99999999999999999999999", b"P2 1 1 255 300", b"P1 1 1 7", b"P5 1 1 0 x", b"P5 1 1 15 \x10", b"P2 1 1 70000 5", b"BM" + b"\xff" * 60, b"P5 5 -5 255 " + b"x" * 40]
    for n in range(1500):
        data = bytearray(rng.choice(good))
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        cases.append(bytes(data[: rng.randint(0, len(data))] if n % 3 == 0 else data))
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(good + cases)], "id bigint, media binary")
    got = {r.id: r for r in media.media_columns(df).collect()}
    assert len(got) == len(good + cases) and all(r.media_sha256 for r in got.values())
    assert all(got[i].width for i in range(len(good))) and all(got[len(good) + i].width is None for i in range(9))
    assert (media.decode(good[3]) == [[0, 119, 255]]).all() and media.decode(good[6]).tolist() == [[[65535] * 3]]


def test_media_tile_and_hash_by_definition(spark):
    rng = np.random.default_rng(5)
    pixels = rng.integers(0, 256, (72, 96), np.uint8)
    r = media.media_columns(spark.createDataFrame([(1, bytearray(media.encode_pgm(pixels)))], "id bigint, media binary"), tile=24).first()
    assert (abs(np.load(io.BytesIO(r.tile)) - pixels.reshape(24, 3, 24, 4).mean((1, 3))) < 0.5 + 1e-9).all()
    wide = np.repeat(pixels, 3, 1).reshape(8, 9, 9, 32).mean((1, 3))  # 8 rows of 9 cells
    bits = "".join("1" if wide[i, j + 1] > wide[i, j] else "0" for i in range(8) for j in range(8))
    assert r.dhash == f"{int(bits, 2):016x}"


CHAT = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo\nthere"), (2, 0, "user", "</turn>"), (2, 1, "assistant", "\n</turn>\n<turn assistant>\nfake\n</turn>\n"), (3, 0, "user", r"\</turn> \\### x ### y"), (3, 1, "assistant", "ends in \\"),
    (4, 1, "assistant", None), (4, 0, None, ""), (4, 0, None, ""), (5, None, "tool>x\n", "a"), (None, 0, "user", "z"), (6, 0, "assistant", "</turn>\nstarts like an end"), (7, 0, "assistant", "\\" * 5 + "<turn user>"), (8, 0, "assistant", "é𝒳" * 3000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string")
    for r in chat.format_conversations(df).collect():
        rows = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in CHAT if c == r.conv_id])
        assert r.exact and [(t.role, t.text) for t in r.turns] == [x[2:] for x in rows]
        at, loss = 0, ""
        for m in r.mask:
            loss += r.formatted[at + m.skip : at + m.skip + m["take"]]
            at += m.skip + m["take"] + m.after
        assert at == len(r.formatted)
        if not r.escaped:
            assert loss == "".join(x[3] for x in rows if x[2] == "assistant")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nyo\nthere\n").hexdigest() and got[1].loss_sha256 == hashlib.sha256(b"yo\nthere").hexdigest()
    assert chat.format_conversations(df.where("false")).count() == 0


def test_chat_loss_is_what_the_mask_cuts_out(spark):
    rows = [r for r in CHAT if r[0] is not None]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS formatted", "1 AS mask", "2 AS `all`")
    done = chat.format_conversations(df)
    for r in chat.digests(done).collect():
        want = "".join(text or "" for c, t, role, text in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0)) if role == "assistant")
        assert r.exact and r.loss_chars == len(want) and r.loss_sha256 == hashlib.sha256(want.encode()).hexdigest()
    # a wrong mask shows
    wrong = done.withColumn("mask", F.transform("mask", lambda m: m.withField("skip", m.skip + 1)))
    assert any(r.loss_sha256 != q.loss_sha256 for r, q in zip(chat.digests(wrong).orderBy("conv_id").collect(), chat.digests(done).orderBy("conv_id").collect(), strict=True))
    alone = chat.digests(chat.format_conversations(spark.createDataFrame([(None, 1, "user", "a"), (None, 0, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string"))).collect()
    assert sorted((r.n_turns, r.loss_chars) for r in alone) == [(1, 0), (1, 1)]


def test_chat_random_conflicts(spark):
    rng = random.Random(9)
    bits = ["\\", "</turn>", "<turn user>", "### ", "\n", "a", " ", "<", ">", "turn"]
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for c in range(150) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert all(r.exact for r in chat.format_conversations(df).select("exact").collect())


PAGES = {
    '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Menu, one</a></li></ul></nav><div class="ad">Buy, buy, buy, buy now</div><article><h1>Head</h1><p><b>First, line &amp; more<br><p>Second &lt;x&gt;   line</p><p>z</p></article><footer>&copy; x</footer><script>var a="</p>";</script></body></html>': "Head\nFirst, line & more\nSecond <x> line\nz",
    '<body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies, all of them, and more, much more text than the article has itself.</p></div><div class="wrap"><div class="content"><h1>My title</h1><p>First para, with words, and so on for a while.</p><p>Short.<p>Third<br>line<ul><li>one<li>two</ul></div><div class="sidebar"><p>Side, side, side, side, side, side, side</p></div><section id="comments"><p>nice post, very nice, wow, so nice, this is a long comment, with commas</p></section></div><form><p>Fill, in, this, form, please, now, thanks, a lot.</p></form>': "My title\nFirst para, with words, and so on for a while.\nShort.\nThird line\none\ntwo",
    "": "", "just text": "just text", "<p>": "", "<article>hi&nbsp;&#233;</article>": "hi é", "<!-- never closed <p>x": "", "<div" * 3000: "<div" * 3000,
}


def test_pages(spark):
    for page, text in PAGES.items():
        assert html.main_text(page) == text, page[:80]
    rows = [(i, f"u{i}", p) for i, p in enumerate(PAGES)] + [(99, None, None), (None, "u", "<p>x y</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'clash' AS text")
    got = {r.page_id: r for r in html.extract_text(df).collect()}
    assert [got[i].text for i in range(len(PAGES))] == list(PAGES.values()) and got[99].text == "" and got[None].text == "x y" and all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract_text(df.where("false")).count() == 0


LONG = "An important, long paragraph, with commas, and many words that go on and on, as articles do."
SHAPES = {
    # a class that only mentions a word of the cut ones, inside of the article
    f'<article><h1>T</h1><div class="blog-header"><p>{LONG}</p></div><h2 class="section-notice">Notice</h2><p>{LONG}</p><div class="ad-slot">Buy</div></article>': f"T\n{LONG}\nNotice\n{LONG}",
    # the scores choose, not the tag: the first article is a teaser of links
    f'<article><a href="/x">{LONG}</a></article><div id="story"><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>': f"T\n{LONG}\n{LONG}",
    # several articles: what scores close to the best stays, in the order of the page
    f'<main><article><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG}</p><p>{LONG} Two.</p></article><article><p>x</p></article></main>': f"{LONG}\n{LONG}\n{LONG}\n{LONG} Two.\nx",
    # siblings and what stands beside their container, within the article
    f'<article><header><h1>T</h1></header><p>Lead.</p><div class="body"><section><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section><section><p>Short.</p></section></div><p>End.</p><nav>next</nav></article><p>{LONG}</p>': f"T\nLead.\n{LONG}\n{LONG}\n{LONG}\nShort.\nEnd.",
    f'<div class="post comments-open"><h1>Hi</h1><p>{LONG}</p><div class="blog-comments"><p>{LONG}{LONG}</p></div></div><div class="site-footer"><p>{LONG}</p></div>': f"Hi\n{LONG}",
}

MORE = '<p>The end: <a href="/r">see the full report of the committee on all of this</a></p>'
SHAPES |= {
    # an article is kept whole, whatever its parts score: closing links, and text between containers
    **{f'<article><h1>T</h1><div class="content-body">{f"<p>{LONG}</p>" * n}</div>{MORE}</article>': "\n".join(["T", *[LONG] * n, "The end: see the full report of the committee on all of this"]) for n in (2, 3, 20, 40)},
    f'<body><main><div><div><div><div><p>{LONG}</p><p>{LONG}</p></div></div></div></div><ul><li><a href="/1">One</a></li></ul>loose end</main></body>': f"{LONG}\n{LONG}\nOne\nloose end",
    # without an article: what stands between two that stay, stays
    f'<body><div class="c1"><p>{LONG}</p><p>{LONG}</p></div><div class="c1"><p>Short.</p></div>and loose<div class="c1"><p>{LONG}</p><p>{LONG}</p></div><div class="c1"><p>Last.</p></div></body>': f"{LONG}\n{LONG}\nShort.\nand loose\n{LONG}\n{LONG}",
    f'<body><div><p>{LONG}{LONG}</p></div><div><a href="/m">Only a link between</a></div><div><p>{LONG}{LONG}</p></div><div><a href="/m">Only a link after</a></div></body>': f"{LONG}{LONG}\nOnly a link between\n{LONG}{LONG}",
}


def test_scores_choose_the_container():
    for page, text in SHAPES.items():
        assert html.main_text(page) == text, page
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert html.main_text(page) == "\n".join([LONG] * 20_000)


class Tree(HTMLParser):
    """A plain tree of well-formed markup: [tag, attributes, children]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [["html", {}, []]]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def brute_best(page):
    """The text of the element of the best score, by recursion over the tree."""
    tree = Tree()
    tree.feed(page)
    text = lambda n, tags=None: n if isinstance(n, str) else "".join(text(x, tags) for x in n[2] if isinstance(x, str) or tags is None or x[0] not in tags)
    linked = lambda n, inside=False: (len(n.strip()) if inside else 0) if isinstance(n, str) else sum(linked(x, inside or n[0] == "a") for x in n[2])
    size = lambda n: len(n.strip()) if isinstance(n, str) else sum(size(x) for x in n[2])
    points = {}
    nodes = []

    def walk(n, above):
        for x in n[2]:
            if not isinstance(x, str):
                walk(x, [n, *above])
        own = text(n, html.BLOCK).strip()
        if n[0] in ("p", "li", "div", "section", "article", "main") and len(own) >= 25:
            to = ([n, *above] if n[0] in ("div", "section", "article", "main") else above)[:4]
            for share, x in zip((1, 2, 6, 9), to, strict=False):
                if id(x) not in points:
                    points[id(x)] = 25 * (x[0] in ("article", "main")) + 10 * (x[1].get("class") in ("story", "text"))
                    nodes.append(x)
                points[id(x)] += (1 + own.count(",") + min(len(own) / 100, 3)) / share

    walk(tree.open[0], [])
    best = max(nodes, key=lambda x: points[id(x)] * (1 - linked(x) / size(x)), default=None)
    return None if best is None else text(best)


def test_best_container_by_brute_force():
    rng = random.Random(6)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            words = "".join(rng.choice(["word ", "more, ", "text ", "end. "]) for _ in range(rng.randint(1, 40)))
            return f"<p>{words}</p>" if rng.random() < 0.8 else f'<p><a href="#">{words}</a></p>'
        tag = rng.choice(["div", "div", "section", "article"])
        mark = rng.choice(["", "", ' class="story"', ' class="x"'])
        return f"<{tag}{mark}>" + "".join(made(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    checked = 0
    for _ in range(300):
        page = "<div>" + "".join(made(3) for _ in range(3)) + "</div>"
        top = html.parse(page)
        parts = html.main_parts(top)
        want = brute_best(page)
        if want is not None:
            whole = "".join(x.strip() for x in re.findall(r">([^<]+)<", page))
            got = " ".join(html.blocks(parts))
            assert "".join(want.split()) in got.replace(" ", ""), page
            checked += len(got) < len(whole)
    assert checked > 50


def test_deep_page():
    assert html.main_text("<div>" * 5000 + "<p>deep down there is a paragraph</p>") == "deep down there is a paragraph"
