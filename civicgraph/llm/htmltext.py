"""Main text of web pages by text-to-tag ratio over streaming parser events.

The standard library's parser reports tags and text as it meets them; no tree is
built. Block-level tags cut the page into lines, and each line keeps its text
length, the number of tags met on the way to it, the share of its text inside
links, and the container it stands in.
  * Lines inside elements that are never article text (navigation, page header
    and footer, asides, forms, scripts, styles, ...) or whose class, id or role
    names such a thing (advert, sidebar, comments, notice, ...) are left out.
    A header inside an article belongs to it.
  * Where the page marks its article (or main) element, the lines in it count.
  * The text-to-tag ratios of the remaining lines are smoothed by a Gaussian
    along the page. Lines over the threshold, one standard deviation of the
    smoothed ratios but no more than their mean, seed the content; the content
    regions are the containers of the seeds, with every line they hold. Within a
    marked article the other containers stay too unless links make most of them.

Defined results: null and empty pages, and pages without article text, give the
empty string; tags that never close and markup cut off at the end are read as
far as they go; character references are decoded, unknown ones kept as written.
"""

import math
import re
from bisect import bisect_right
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the smoothing in lines.
SIGMA = 1.0

# HTML element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg math object iframe canvas audio video head title".split())
_NEVER = _RAW | frozenset("nav footer aside form button select textarea menu dialog".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
_CONTAINER = frozenset("article body div main section td blockquote".split())
_ENDS_P = _BLOCK - {"html", "body"}
#: What keeps end tags and implied ends inside it from reaching further.
_WALL = _CONTAINER | _NEVER
_CLOSES_ITSELF = _BLOCK | _RAW
#: An item, cell or row closes those before it, up to the list or table that they stand in.
_SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"),
             "td": ("td", "th"), "th": ("td", "th")}
_HOLDERS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"),
            "th": ("tr", "table")}
#: What can stand in a head; anything else ends a head whose end tag is left out.
_IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: Parts of class, id and role values that name what is not the article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disqus dropdown footer gdpr header masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pagination pager popup promo promoted promotion recommended related replies respond "
    "share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar widget "
    "alert contentinfo complementary search dialog".split())
#: Those that take an article element out, too: comments and teasers are often articles of their own.
_ARTICLE_NAMES = frozenset("ad ads advert comment comments promo recommended related reply sponsored teaser".split())
#: Name parts that say what an element has or lacks, not what it is.
_ABOUT = frozenset("has with without no is can".split())


class _Lines(HTMLParser):
    """Collects (text, tags, linked characters, container, in article) per line.

    Where each element name is open is kept beside the open elements, so that a tag
    costs the same however many elements are open.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines = []
        self.open = []              # (tag, left out, container, in article)
        self.places = defaultdict(list)     # places in ``open`` by tag, and those of all walls
        self.walls = []
        self.text, self.linked, self.tags = [], 0, 0
        self.links = 0
        self.containers = 0

    def _state(self):
        return self.open[-1][1:] if self.open else (False, 0, False)

    def _end_line(self):
        if self.text:
            out, container, article = self._state()
            text = " ".join("".join(self.text).split())
            if text and not out:
                self.lines.append((text, self.tags, self.linked, container, article))
            self.text, self.linked, self.tags = [], 0, 0

    def _push(self, tag, *state):
        self.places[tag].append(len(self.open))
        if tag in _WALL:
            self.walls.append(len(self.open))
        self.open.append((tag, *state))

    def _cut(self, place):
        """Closes the element at a place and all inside it."""
        while len(self.open) > place:
            tag = self.open.pop()[0]
            self.places[tag].pop()
            if tag in _WALL:
                self.walls.pop()

    def _last(self, tag):
        places = self.places.get(tag)
        return places[-1] if places else -1

    def _close_head(self):
        if self.places["head"]:
            self._cut(self._last("head"))

    def handle_starttag(self, tag, attrs):
        if tag == "body" or self.open and self.open[-1][0] == "head" and tag not in _IN_HEAD:
            self._close_head()
        if tag in _BLOCK:
            self._end_line()
        if tag in _ENDS_P:
            self._close_implied(tag)
        self.tags += 1
        if tag in _VOID:
            if tag == "br":
                self.text.append(" ") if self.text else None
            return
        if tag == "a":
            self.links += 1
        out, container, article = self._state()
        if tag not in ("html", "body"):
            names = _ARTICLE_NAMES if tag in ("article", "main") else _NAMES - {"header"} if article else _NAMES
            out = out or tag in _NEVER or (tag == "header" and not article) or (attrs and self._names(attrs, names))
        if tag in _CONTAINER:
            self.containers += 1
            container = self.containers
        self._push(tag, bool(out), container, article or tag in ("article", "main"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in _CLOSES_ITSELF:
            self.handle_endtag(tag)

    @staticmethod
    def _names(attrs, names):
        """Whether a class, id or role is one of the names, or begins or ends with one."""
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                for word in re.sub("([a-z])([A-Z])", r"\1-\2", value).lower().split():
                    parts = [part for part in re.split("[^a-z]+", word) if part]
                    if parts and parts[0] not in _ABOUT and (parts[0] in names or parts[-1] in names):
                        return True
            if key == "hidden" or key == "aria-hidden" and value == "true" or \
                    key == "style" and value and re.search(r"display\s*:\s*none", value.lower()):
                return True
        return False

    def _close_implied(self, tag):
        """A block closes an open paragraph; an item or cell closes the one before."""
        closed = ("p", *_SIBLINGS.get(tag, ()))
        stop = max((self._last(name) for name in _HOLDERS.get(tag, ())), default=-1)
        for wall in reversed(self.walls):       # those passed over are closed below
            if wall <= stop or self.open[wall][0] not in closed:
                stop = max(stop, wall)
                break
        first = len(self.open)
        for name in closed:
            places = self.places.get(name)
            if places and places[-1] > stop:
                first = min(first, places[bisect_right(places, stop)])
        self._cut(first)

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self._end_line()
        self.tags += 1
        if tag == "a" and self.links:
            self.links -= 1
        place = self._last(tag)
        inside = self.walls[-1] if self.walls and tag not in _WALL and tag != "html" else -1
        if place > inside:          # an inline end tag closes nothing beyond its container
            self._cut(place)

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._close_head()
        if self.open and self.open[-1][1]:
            return
        self.text.append(data)
        if self.links:
            self.linked += len(data.strip())

    def finish(self):
        self.close()
        self._end_line()
        return self.lines


def _smooth(x, sigma=SIGMA):
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(x, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def extract(html):
    """The article's lines, joined by one line end."""
    if not html:
        return ""
    parser = _Lines()
    # no tag can end after the last ">": the parser reads what is left as text, but tries each "<" to the end
    whole = html.rfind(">") + 1
    parser.feed(html[:whole] + html[whole:].replace("<", "&lt;"))
    lines = parser.finish()
    marked = any(line[4] for line in lines)
    if marked:
        lines = [line for line in lines if line[4]]
    if not lines:
        return ""
    length = np.array([len(t) for t, *_ in lines], float)
    ratio = length / np.maximum(1, [tags for _, tags, *_ in lines])
    linked = np.array([n for _, _, n, *_ in lines], float)
    container = np.array([c for _, _, _, c, _ in lines])
    smooth = _smooth(ratio * (1 - np.minimum(1, linked / length)))
    seeds = set(container[smooth >= min(smooth.std(), smooth.mean())].tolist())
    if marked:
        mostly_text = np.bincount(container, linked) <= .5 * np.bincount(container, length)
        seeds.update(container[mostly_text[container]].tolist())
    return "\n".join(line[0] for line in lines if line[3] in seeds)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("html"))
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url")]
            texts = [extract(cell.as_py()) for cell in column]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
