import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import htmltext, jpeg, media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 40_000])
def test_payloads_round_trip(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    for payload in (media._padded(raw), media._padded(b"\xff" * n), media._padded(b"\x00" * n)):
        image = jpeg.read(jpeg.write(payload))
        assert jpeg.payload(image) == payload and len(payload) % 576 == 0 and payload
        assert jpeg.rgb(image).shape == (image.height, image.width, 3)


def test_many_blocks_need_several_runs():
    payload = bytes(range(256)) * (33000 * 63 * 6 // 4 // 256 + 1)
    assert jpeg.payload(jpeg.read(jpeg.write(payload))) == payload


class _Writer:
    """A plain progressive writer with general codes, as a check on the reader: bits one by one."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> k) & 1 for k in range(n - 1, -1, -1)]

    def number(self, v):
        size = abs(v).bit_length()
        return size, (v if v > 0 else v + (1 << size) - 1), size


def test_general_scans():
    """Signed values, zero runs, ends of bands over several blocks, refinement of old and new coefficients, DC in steps."""
    r = np.random.default_rng(5)
    blocks = [np.where(r.random(64) < 0.15, r.integers(-7, 8, 64), 0) for _ in range(6)]
    blocks[2][1:] = 0
    blocks[3][1:] = 0
    symbols = list(range(256))
    counts = [0] * 7 + [255] + [1] + [0] * 7  # 255 codes of eight bits, one of nine
    code = {s: (k, 8) if k < 255 else (510, 9) for k, s in enumerate(symbols)}
    dht = lambda kind: jpeg._segment(0xC4, bytes([kind, *counts, *symbols]))
    head = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0]) + bytes([3]) * 64)
    head += jpeg._segment(0xC2, bytes([8, 0, 16, 0, 24, 1, 1, 0x11, 0])) + dht(0) + dht(0x10)
    out, w, last = head, _Writer(), 0
    for b in blocks:  # DC without its last bit
        v = int(b[0]) >> 1
        size, extra, n = w.number(v - last)
        last = v
        w.put(*code[size])
        w.put(extra, n)
    out += jpeg._segment(0xDA, bytes([1, 1, 0, 0, 0, 1])) + jpeg._packed(np.array(w.bits, dtype=np.uint8))
    w = _Writer()
    for b in blocks:
        w.put(int(b[0]) & 1, 1)
    out += jpeg._segment(0xDA, bytes([1, 1, 0, 0, 0, 0x10])) + jpeg._packed(np.array(w.bits, dtype=np.uint8))
    w, run = _Writer(), 0

    def end():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            w.put(*code[n << 4])
            w.put(run - (1 << n), n)
            run = 0

    for b in blocks:  # AC without the last bit
        high = [int(np.sign(x)) * (abs(int(x)) >> 1) for x in b]
        zeros = 0
        for k in range(1, 64):
            if not high[k]:
                zeros += 1
                continue
            end()
            while zeros > 15:
                w.put(*code[0xF0])
                zeros -= 16
            size, extra, n = w.number(high[k])
            w.put(*code[zeros << 4 | size])
            w.put(extra, n)
            zeros = 0
        run += zeros > 0
    end()
    out += jpeg._segment(0xDA, bytes([1, 1, 0, 1, 63, 1])) + jpeg._packed(np.array(w.bits, dtype=np.uint8))
    w, run, pending = _Writer(), 0, []
    for b in blocks:  # the last bit: new ones of size one, corrections of old ones
        new = [k for k in range(1, 64) if abs(int(b[k])) == 1]
        k = 1
        for at in new:
            if run:
                n = run.bit_length() - 1
                w.put(*code[n << 4])
                w.put(run - (1 << n), n)
                for bit in pending:
                    w.put(bit, 1)
                run, pending = 0, []
            while True:
                zeros = [j for j in range(k, at) if abs(int(b[j])) <= 1]
                stop = zeros[15] if len(zeros) > 15 else at
                w.put(*(code[0xF0] if len(zeros) > 15 else code[len(zeros) << 4 | 1]))
                if len(zeros) <= 15:
                    w.put(int(b[at]) > 0, 1)
                for j in range(k, stop):
                    if abs(int(b[j])) > 1:
                        w.put(abs(int(b[j])) & 1, 1)
                k = stop + 1
                if stop == at:
                    break
        if k < 64:
            run += 1
            pending += [abs(int(b[j])) & 1 for j in range(k, 64) if abs(int(b[j])) > 1]
    if run:
        n = run.bit_length() - 1
        w.put(*code[n << 4])
        w.put(run - (1 << n), n)
        for bit in pending:
            w.put(bit, 1)
    out += jpeg._segment(0xDA, bytes([1, 1, 0, 1, 63, 0x10])) + jpeg._packed(np.array(w.bits, dtype=np.uint8)) + b"\xff\xd9"
    image = jpeg.read(out)
    assert (image.components[0].coefficients == np.array(blocks)).all()
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    d = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    d[0] /= np.sqrt(2)
    grid = np.zeros(64)
    grid[jpeg.ZIGZAG] = blocks[0] * 3
    want = np.clip(np.rint(d.T @ grid.reshape(8, 8) @ d) + 128, 0, 255)
    assert np.abs(jpeg.rgb(image)[:8, :8, 0].astype(int) - want).max() <= 1


def test_media_of_odd_rows(odd, none):
    rows = media.inspected(media.encoded(odd)).collect()
    want = sorted((r["doc_id"] or -1, hashlib.sha256(media._padded((r["text"] or "").encode())).hexdigest()) for r in odd.collect())
    assert sorted((r["doc_id"] or -1, r["payload_sha256"]) for r in rows) == want
    texts = {}
    for r in rows:
        assert texts.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
        assert r["payload_bytes"] % 576 == 0 and r["payload_bytes"] >= r["n_bytes"]
    one = next(r for r in rows if r["doc_id"] == 2)
    assert one["n_bytes"] == 0 and one["tail_crc32"] == zlib.crc32(b"\xff" * 32)
    tensor = media.tensors(media.encoded(odd).limit(1)).first()
    assert len(tensor["rgb"]) == 3 * tensor["height"] * tensor["width"]
    assert media.inspected(media.encoded(none)).collect() == []


@pytest.mark.parametrize("page,text", [
    ('<html><head><title>x</title></head><body class="has-sidebar"><header>Site</header><div id="menu"><a>m</a></div><div class="content-wrap with-sidebar">'
     '<div id="content"><h1>T &amp; t</h1><div>foo <b>bar</b> baz<ul><li>one<li>two</ul>tail</div><table><tr><td>a<td>b</table><div class="comments"><p>hello'
     ' comment</p></div><script>var t="</p>";</script><p>x&nbsp;y &lt;b&gt;<div class="cookie-notice">c</div></div></div><footer>f</footer></body>',
     "T & t\nfoo bar baz\none\ntwo\ntail\na\nb\nx y <b>"),
    ("plain text <b>only", "plain text only"), ("", ""), (None, ""), ("<", "<"), ("a < b <!-- c --> d <![CDATA[e & f]]>", "a < b d e & f"),
    ("<article><p>1<p>2<br>3<form>f</form></article><article class='comment'>c</article>", "1\n2 3"),
    ("<main><article><header><h1>T</h1></header><p hidden>h</p><p style='display:none'>n</p>b</article></main>", "T\nb"),
    ('<p title="a > b">t</p><p>u', "t\nu"), ("<div>" * 3000 + "deep", "deep"), ("<script>never ends <p>x", ""),
    ("<body><div role=banner>x</div><nav>n</nav><p>main words of it</p><aside>s</aside></body>", "main words of it"),
])
def test_main_text(page, text):
    assert "\n".join(htmltext.blocks(htmltext.parse(page or ""), frozenset(), frozenset())) == text


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.split(r"<[^>]*>", re.sub(r"</?b>|<br>", " ", article))
        assert got[r["page_id"]] == "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_templates_of_a_host_go(spark):
    page = "<body><div>Welcome to the site, dear reader</div><div><p>Text {k} of its own {k}.</p><p>Shared by two: {s}.</p></div><div>Imprint and such</div></body>"
    rows = [(k, f"https://User@Big.example:80/{k}", page.format(k=k, s=k // 2), 1) for k in range(12)]
    rows += [(100, "https://small.example/", page.format(k=0, s=0), 1), (101, None, None, 1), (102, "odd", "", 1), (0, "https://big.example/0", page.format(k=0, s=0), 1)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by[3] == "Text 3 of its own 3.\nShared by two: 1." and by[101] == by[102] == ""
    assert by[100].startswith("Welcome")
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltext.extract(none).collect() == []


def test_copies_are_no_templates(spark):
    copy = "<body><div>Visitor {k}</div><article><h1>Title of it</h1><p>Some text.</p><ul><li>a<li>b</ul></article><script>{k}</script></body>"
    plain = "<body><p>Copied text.</p><p>More of it.</p></body>"
    rows = [(k, "https://a.example/", copy.format(k=k)) for k in range(10)]
    rows += [(20 + k, "https://b.example/", plain) for k in range(6)] + [(30, "https://b.example/x", "<body><p>Other.</p></body>")]
    rows += [(40 + k, "https://c.example/", f"<body><div>Welcome</div><article><p>Text {k % 5}.</p></article></body>") for k in range(25)]
    rows += [(70 + k, "https://d.example/", f"<body><div>Welcome</div><p>Text {k % 5}.</p></body>") for k in range(25)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert {got[k] for k in range(10)} == {"Title of it\nSome text.\na\nb"}
    assert {got[20 + k] for k in range(6)} == {"Copied text.\nMore of it."} and got[30] == "Other."
    assert got[41] == got[71] == "Text 1."


@pytest.mark.parametrize("page,text", [
    ("<body><nav>n</nav><div><article><p>First part of it.</p></article><article><p>Second.</p></article></div><footer>f</footer></body>", "First part of it.\nSecond."),
    ("<body><main><h1>Title</h1><p>Lead</p><article><p>Long text of the article.</p></article></main><p>x</p></body>", "Title\nLead\nLong text of the article."),
    ("<body><header>Site</header><h1>Title</h1><article><header>By me</header><p>Text.</p></article></body>", "Title\nBy me\nText."),
    ("<body><header>Site</header><div class='post'>More than half of it.</div><div class='post'>Less than half.</div></body>", "More than half of it.\nLess than half."),
])
def test_no_part_is_lost(page, text):
    assert "\n".join(htmltext.blocks(htmltext.parse(page), frozenset(), frozenset())) == text


def test_recurring_parts_go(spark):
    page = "<body><h1>Own {k}</h1><div>Subscribe now</div><article>Teaser</article><article><p>Text {k}.</p></article></body>"
    rows = [(k, "https://a.example/", page.format(k=k)) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own 3\nText 3."


def test_templates_alone_decide(spark):
    """No tag, role or class tells the parts apart: a subtree goes for recurring on its host, whatever its addresses and ids."""
    page = (
        "<body id='p{k}'><div><span>The daily herald</span> <a href='/?from={k}'>Front page</a></div><div><p>Story {k} begins.</p><p>It goes on, {k}.</p></div>"
        "<div style='width:{k}px'><a href='/x/{k}' data-k={k}>Most read</a><span id=s{k}>Write to us</span></div></body>"
    )
    rows = [(k, f"https://{'ab'[k % 2]}.example/{k}", page.format(k=k)) for k in range(16)]
    rows += [(100, "https://alone.example/", page.format(k=100))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(frame).collect()}
    assert all(got[k] == f"Story {k} begins.\nIt goes on, {k}." for k in range(16))
    assert got[100].startswith("The daily herald") and got[100].endswith("Write to us")  # a host of one page has no template
    # the counts, per host, by hand
    count, pages = Counter(), Counter()
    for _, url, source in rows:
        found = {}
        htmltext.subtree_hashes(htmltext.parse(source), found)
        name = url.split("/")[2]
        pages[name] += 1
        count.update((name, h) for h in set(found.values()))
    want = {name: {h for (m, h), n in count.items() if m == name and n >= max(4, 0.5 * pages[name])} for name in pages}
    made = {r["host"]: set(r["templates"] or ()) for r in htmltext.host_templates(frame).collect()}
    assert made == want and len(want["a.example"]) == 6 and not want["alone.example"]
