"""WARC archives and main text of pages."""

import base64
import hashlib
import io
import random
import time
import zlib

import pytest

from civicgraph.llm import htmltext, warc

SCHEMA = "page_id long, url string, html string, records string"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, least=0):
    groups = {}
    for i, _, html, _ in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        known = [k for k in groups[html or ""] if k is not None]
        first = max(known) if known and len(groups[html or ""]) > 1 and len(payload) >= least else i
        revisit = first != i
        out.append((i, len(payload), digest(payload), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1", "<p>same</p>", "x"), (2, "http://a/2", "<p>same</p>", "x"), (9, None, "<p>same</p>", "x"),
        (3, "http://a/ä\r\nX: y", "<p>é</p>", None), (4, "u", None, "x"), (5, "u", "", "x"), (6, "u", "long " * 100_000, "x"),
        (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n", "x"), (9, "again", "<p>same</p>", "x"), (None, "u", "<p>same</p>", "x")]


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip(spark, least):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = warc.read_back(warc.write(df, min_bytes=least)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) \
        == brute(ROWS, least)
    assert {r.url for r in got if r.page_id == 3} == {"http://a/ä X: y"}


def test_empty_table(spark):
    assert warc.read_back(warc.write(spark.createDataFrame([], SCHEMA))).count() == 0


def test_members_are_read_incrementally():
    data = b"".join(warc.page_record(k, f"u{k}", b"x" * (k * 70_000), None) for k in range(5))

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7) if n > 0 else n)
    sizes = [size for _, _, size, _ in warc.read_records(Slow(data))]
    assert sizes == [k * 70_000 for k in range(5)]
    for cut in (3, len(data) // 2, len(data) - 1):
        with pytest.raises((warc.BadRecord, zlib.error)):
            list(warc.read_records(io.BytesIO(data[:cut])))


def test_changed_payload_is_noticed():
    member = zlib.decompress(warc.page_record(1, "u", b"payload", None), 31).replace(b"payload", b"Payload")
    packer = zlib.compressobj(wbits=31)
    with pytest.raises(warc.BadRecord):
        list(warc.read_records(io.BytesIO(packer.compress(member) + packer.flush())))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav>
<div class="cookie-notice">We use cookies to be nice to you and to everybody else here.</div><div class="ad">Buy!</div>
%s
<aside>Side story that is rather long, long enough to look like some text.</aside><form><input><label>Name</label></form>
<div id="comments"><p>Reader comment that goes on and on and on about nothing at all.</p></div>
<footer>&copy; me &middot; imprint</footer></body></html>"""


def test_article_is_taken_whole():
    inner = ("<h1>Title &amp; more</h1><p><b>First   paragraph\n of some length, with words.<br><p>Yes.</p>"
             "<p>Second &lt;one&gt; with <a href='x'>a link</a> in it &am</p><ul><li>Point</li><li>Other</li></ul>"
             "<div class='share'>Tweet</div><section class='comments'><p>Nice article, well done, thank you!</p></section>")
    want = "\n".join(["Title & more", "First paragraph of some length, with words.", "Yes.",
                      "Second <one> with a link in it &am", "Point", "Other"])
    assert htmltext.extract(PAGE % f"<article>{inner}</article>") == want
    assert htmltext.extract(PAGE % f"<main>{inner}</main>") == want


def test_names_say_what_an_element_is():
    kept = ("<div class='post has-sidebar with-comments'><header class='entry-header'><h1>Head</h1></header>"
            "<p>Body of the article, some words.</p><p class='shareholder'>More of it here.</p></div>")
    gone = ("<article class='comment'><p>A comment as an article.</p></article><div id='respondForm'><p>Reply</p></div>"
            "<div class='cookieBanner'>Cookies</div><p class='ad-slot'>Ad</p><div role='complementary'>Side</div><p hidden>No</p>")
    assert htmltext.extract(f"<body class='no-menu'><article>{kept}</article>{gone}</body>") == \
        "Head\nBody of the article, some words.\nMore of it here."


def test_article_without_a_mark_is_found_by_its_ratio():
    body = "".join(f"<p>{'Sentence of the story that carries on. ' * 4}{k}</p>" for k in range(5))
    links = "<div><ul>" + "".join(f"<li><a href='{k}'>go {k}</a></li>" for k in range(12)) + "</ul></div>"
    got = htmltext.extract(PAGE % f"{links}<div class='story'><h2>Head</h2>{body}<p>End.</p></div>{links}")
    assert got.split("\n")[0] == "Head" and got.endswith("End.") and len(got.split("\n")) == 7 and "go 3" not in got


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<nav>menu</nav>", ""), ("plain words only", "plain words only"),
    ("<article><p>cut off <b>here", "cut off here"), ("<article><p>a&nbsp;&#65;&quot;b", 'a A"b'), ("<p></p><br>", ""),
    ("<article><p>one<p>two<p>three</article>", "one\ntwo\nthree"), ("<article>" + "<div>" * 3000 + "deep", "deep")])
def test_odd_pages(html, text):
    assert htmltext.extract(html) == text


def test_table_of_pages(spark):
    rows = ROWS + [(20, "u", PAGE % "<article><p>Hello there</p></article>", None)]
    got = htmltext.main_text(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    one = got.where("page_id = 20").first()
    assert (one.text, one.n_chars) == ("Hello there", 11)
    assert {r.text for r in got.where("page_id in (4, 5)").collect()} == {""}
    assert htmltext.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("html", [
    "<html><head><title>t</title><body>{}</body></html>", "<head><title>t</title><meta name=x><style>p {{}}</style>{}",
    "<head><script>1 < 2</script><link rel=x><body class=page>{}", "<head><noscript><img src=x></noscript>\n<div>{}</div>"])
def test_pages_without_the_end_of_their_head(html):
    words = "This sentence of the article is long enough to be taken for its text, and it is one of two. "
    assert htmltext.extract(html.format(f"<p>{words}</p><p>{words}</p>")) == "\n".join([words.strip()] * 2)
    assert htmltext.extract(html.format("")) == ""


#: Markup that leaves ever more elements open, or never ends a tag.
CROOKED = ["<i>|</b>x", "<i>|<h1>x", "<td>|<li>x", "<div>|<p>x", "<div>x|</div>", "<a |", "<a b='c' |", "<!--|", "a<b |", "</a |",
           "<p>|<td>|</p>x", "<main><div>x</div></main>|", "<article>|<div>x</div>"]


@pytest.mark.parametrize("crooked", CROOKED)
def test_time_grows_with_the_page(crooked):
    """Eight times the page in far less than the 64 times of a quadratic reader; a floor keeps noise out."""
    def seconds(n):
        page = "".join(part * n for part in crooked.split("|"))
        began = time.process_time()
        htmltext.extract(page)
        return time.process_time() - began
    assert seconds(16_000) < 30 * max(seconds(2_000), .03)


def scanned(page):
    """The open elements by plain scans of the whole stack at every tag: what the lines of a page rest on."""
    class Plain(htmltext._Lines):
        def _close_implied(self, tag):
            closed = ("p", *htmltext._SIBLINGS.get(tag, ()))
            stop = htmltext._HOLDERS.get(tag, ())
            for place in range(len(self.open) - 1, -1, -1):
                name = self.open[place][0]
                if name in closed:
                    self._cut(place)
                elif name in stop or name in htmltext._WALL:
                    break

        def handle_endtag(self, tag):
            if tag in htmltext._BLOCK:
                self._end_line()
            self.tags += 1
            if tag == "a" and self.links:
                self.links -= 1
            for place in range(len(self.open) - 1, -1, -1):
                name = self.open[place][0]
                if name == tag:
                    return self._cut(place)
                if name in htmltext._WALL and tag not in htmltext._WALL and tag != "html":
                    return None
    parser = Plain()
    parser.feed(page)
    return parser.finish()


def test_open_elements_equal_plain_scans():
    dice = random.Random(11)
    names = sorted(htmltext._BLOCK | htmltext._NEVER) + "i b a span p td li tr table ul div dd dt dl head body".split() * 6
    for _ in range(3000):
        page = "".join(dice.choice((f"<{dice.choice(names)}>", f"</{dice.choice(names)}>", f"word{dice.random()} "))
                       for _ in range(dice.randint(1, 60)))
        parser = htmltext._Lines()
        parser.feed(page)
        assert parser.finish() == scanned(page), page
