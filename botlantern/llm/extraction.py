"""Main text of web pages by tree scoring.

A page is read into a tree (unclosed and misnested tags are mended as browsers do) with its text in
blocks. Subtrees that are no article are set aside: scripts, styles, menus, headers, footers, asides
and forms by tag or role; adverts, notices, sidebars, comments and the like by the words of class
and id; what is less sure (forms, widgets, headers) stays if it holds most of the page, and a header
if an article holds it. Attributes are read by whole names, the first of a name counting. An id with
other words than those of such things and of layout is a heading's slug and tells nothing, and inside an
article one of ambiguous words (rail, side, share) does not set prose aside. Each paragraph then gives its parent points for its length and commas, half of
them to the grandparent and a third to the next; a container's points are discounted by the share of
its text that is in links. The best container is taken, up to the article or main element around it,
with those siblings that score like it or are prose. All that is left in them is kept; outside an
article element, lists that are mostly links are not. If no article or main element is around the
best container, nothing but names and links tells what is no article: beside it and beside each
element around it, all that is not set aside and not mostly links stays, headings and text of the
elements themselves too.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed,
and those not empty are joined in page order by a blank line. Pages are read whole, each by itself, in
time in proportion to their length, however deeply they are nested.

Defined cases: a null or empty page, or one without text, gives an empty text. Markup that is cut
off at the end of a page is ignored. Null and repeated ids and urls are carried. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style textarea title template noscript iframe svg math object canvas audio video select".split())
#: Elements and roles that hold no article text.
ASIDE_TAGS = frozenset("nav footer aside form button dialog menu fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of names that tell of other things than an article, and beginnings of such words.
SURE_WORDS = frozenset("adsense outbrain taboola masthead pagination disqus gdpr consent cookie cookies comment comments commentlist commentform".split())
SURE_STEMS = ("advert", "sponsor", "promo", "navbar", "breadcrumb", "sidebar", "footer", "newsletter")
#: Words that tell of the same only where a name has no words but these, sure ones and those of layout.
PLAIN_WORDS = frozenset(
    "ad ads adv nav navigation menu menus pager topbar toolbar side aside rail foot banner popup reply replies respond discussion notice notices alert alerts modal "
    "overlay subscribe subscription signup share sharing social related recommended recommendations trending".split()
)
#: Words that tell of the same less surely: what bears them stays if it holds most of the page.
PERHAPS_WORDS = frozenset("widget widgets header head copyright legal login register popular tags tagcloud".split())
LAYOUT_WORDS = frozenset(
    "left right top bottom upper lower inner outer main primary secondary site page box block blocks container wrapper wrap section area list bar col column columns content body "
    "button buttons btn link links item items icon icons panel slot unit group row grid holder form title count thread threads post posts article articles story stories news js the my "
    "module region zone frame stack sticky fixed float mobile desktop small large default user users reader readers leave add new all more first last text for".split()
)
ARTICLE_WORDS = frozenset("article articlebody main content body entry story post text page".split())
#: A name of an article's container may hold words of other things, but not these.
NEVER_WORDS = frozenset("ad ads nav menu related cookie cookies comment comments commentlist commentform".split())
NEVER_STEMS = ("advert", "sidebar", "footer", "sponsor", "newsletter")
#: Elements that are named for links to them.
ANCHORS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Characters, not in links, of a part of an article that its name alone does not set aside.
PROSE = 100
PARAGRAPH = 25

_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?P<close>>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|(?P<text><?[^<]+|<)",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag closes an open one of these, up to the bounding elements.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Page:
    """The tree of a page as parallel lists in page order, and its text blocks."""

    def __init__(self, source: str):
        self.tags, self.parents, self.last, self.aside = ["body"], [-1], [0], [NOT]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self._stack, self._text, self._links, self._in_link = [0], [], 0, 0
        #: The places of each open tag in the stack, and those of all that are not inline.
        self._open_at: dict[str, list[int]] = {}
        self._block_at = [0]
        self._read(source)
        self._flush()
        for node in range(len(self.tags) - 1, 0, -1):
            up = self.parents[node]
            self.last[up] = max(self.last[up], self.last[node])

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.match(source, at)
            at = m.end()
            if (text := m["text"]) is not None:
                text = html.unescape(text)
                self._text.append(text)
                if self._in_link:
                    self._links += len(text)
            elif m["tag"] and m["close"]:
                tag = m["tag"].lower()
                if m["end"]:
                    self._close(tag)
                elif tag in RAW:
                    if tag not in ("script", "style", "textarea", "title", "template", "noscript", "iframe", "svg", "math") or not m["attrs"].rstrip().endswith("/"):
                        stop = _RAW_END[tag].search(source, at)
                        at = stop.end() if stop else end
                    if tag not in INLINE:
                        self._text.append(" ")
                else:
                    self._open(tag, m["attrs"])

    def _open(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body", "head"):
            return
        if tag in VOID:
            self._text.append(" ") if tag in INLINE else self._flush()
            return
        if tag in _CLOSES_P:
            self._pop_to({"p"}, {"td", "th", "table", "button", "object"})
        if tag in _CLOSES:
            self._pop_to(*_CLOSES[tag])
        if tag not in INLINE:
            self._flush()
        self._in_link += tag == "a"
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.last.append(len(self.tags) - 1)
        self.aside.append(_aside(tag, attrs))
        self._open_at.setdefault(tag, []).append(len(self._stack))
        if tag not in INLINE:
            self._block_at.append(len(self._stack))
        self._stack.append(len(self.tags) - 1)

    def _depth(self, tags: Iterable[str]) -> int:
        """The innermost open one of the tags, 0 for none."""
        return max((self._open_at[t][-1] for t in tags if self._open_at.get(t)), default=0)

    def _close(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            return
        depth = self._depth((tag,))
        if not depth and tag == "p":
            self._flush()
        elif depth > (self._block_at[-1] if tag in INLINE else 0):
            self._cut(depth)

    def _pop_to(self, wanted: set[str], bounds: set[str]) -> None:
        depth = self._depth(wanted)
        if depth > self._depth(bounds - wanted):
            self._cut(depth)

    def _cut(self, depth: int) -> None:
        if self._block_at[-1] >= depth:
            self._flush()
        while len(self._stack) > depth:
            tag = self.tags[self._stack.pop()]
            self._open_at[tag].pop()
            self._in_link -= tag == "a"
            if tag not in INLINE:
                self._block_at.pop()

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append((self._stack[self._block_at[-1]], text, min(self._links, len(text))))
        self._text, self._links = [], 0

    def ancestors(self, node: int) -> Iterator[int]:
        while node >= 0:
            yield node
            node = self.parents[node]

    def sums(self, blocks: list[tuple[int, str, int]]) -> tuple[list[int], list[int]]:
        """Characters and characters in links below each node."""
        sizes, links = [0] * len(self.tags), [0] * len(self.tags)
        for node, text, linked in blocks:
            sizes[node] += len(text)
            links[node] += linked
        for node in range(len(self.tags) - 1, 0, -1):
            sizes[self.parents[node]] += sizes[node]
            links[self.parents[node]] += links[node]
        return sizes, links


#: How surely a subtree is no article; what is named so may be prose of an article for all that.
NOT, PERHAPS, NAMED, SURELY = 0, 1, 2, 3


def attributes(source: str) -> dict[str, str]:
    """Names in lower case with their values; of a name that comes again the first counts."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _told(name: str, is_id: bool) -> tuple[int, bool]:
    """What one class or an id tells, and whether it can't be an article's container.

    Ids are slugs of headings as well as names: one that has a word besides those of layout tells nothing.
    """
    words = [w.lower() for w in _WORD.findall(name)]
    sure = [w for w in words if w in SURE_WORDS or w.startswith(SURE_STEMS)]
    plain = all(w in SURE_WORDS or w.startswith(SURE_STEMS) or w in PLAIN_WORDS or w in PERHAPS_WORDS or w in LAYOUT_WORDS or w.isdigit() for w in words)
    never = any(w in NEVER_WORDS or w.startswith(NEVER_STEMS) for w in words)
    if sure and (plain or not is_id):
        return SURELY, never
    if not plain:
        return NOT, False
    if any(w in PLAIN_WORDS for w in words):
        return NAMED if is_id else SURELY, never
    return PERHAPS if any(w in PERHAPS_WORDS for w in words) else NOT, False


def _aside(tag: str, attrs: str) -> int:
    if tag in ("form", "fieldset", "header", "button", "menu"):
        kind = PERHAPS
    else:
        kind = SURELY if tag in ASIDE_TAGS else NOT
    if not attrs or kind == SURELY:
        return kind
    found = attributes(attrs)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return SURELY
    if found.get("role", "").lower() in ASIDE_ROLES:
        return SURELY
    names = [(c, False) for c in found.get("class", "").split()] + ([(found["id"], True)] if found.get("id") and tag not in ANCHORS else [])
    told = [_told(*name) for name in names]
    never = any(n for _, n in told)
    article = any(w.lower() in ARTICLE_WORDS for name, _ in names for w in _WORD.findall(name))
    if not never and (article or tag in ("article", "main") or tag in ANCHORS):
        return kind
    return max([kind, *[t for t, _ in told]])


def main_text(source: str | None) -> str:
    """The article of a page: its blocks, joined by blank lines."""
    if not source:
        return ""
    page = Page(source)
    sizes, links = page.sums(page.blocks)
    whole = sizes[0]
    # Set aside what is no article; of what is so perhaps, not what holds most of the page.
    dropped, within = [False] * len(page.tags), [False] * len(page.tags)
    for node in range(1, len(page.tags)):
        up, tag = page.parents[node], page.tags[node]
        within[node] = within[up] or tag in ("article", "main")
        # An article's own header has its title.
        heavy = page.aside[node] == PERHAPS and (sizes[node] > 0.6 * whole or (tag == "header" and within[up]))
        # So do its sections, whatever the words of their headings.
        heavy |= page.aside[node] == NAMED and within[up] and sizes[node] - links[node] >= PROSE and links[node] < 0.25 * sizes[node]
        links_only = not within[node] and tag in ("ul", "ol", "dl", "table", "div", "section") and sizes[node] and links[node] > 0.7 * sizes[node] and 2 * sizes[node] < whole
        dropped[node] = dropped[up] or (page.aside[node] > NOT and not heavy) or links_only
    blocks = [(n, t, k) for n, t, k in page.blocks if not dropped[n]]

    (sizes, links), points = page.sums(blocks), [0.0] * len(page.tags)
    for node, text, _ in blocks:
        if len(text) < PARAGRAPH:
            continue
        worth = 1 + text.count(",") + min(len(text) / 100, 3)
        container = page.parents[node] if page.tags[node] in ("p", "pre", "td", "blockquote", "li", "h1", "h2", "h3", "h4", "h5", "h6") and node else node
        for up, share in zip(page.ancestors(container), (1, 2, 3), strict=False):
            points[up] += worth / share
    points = [p * (1 - links[n] / sizes[n]) if sizes[n] else 0.0 for n, p in enumerate(points)]
    best = max(range(len(points)), key=lambda n: (points[n], -n))
    if not points[best]:
        best = next((n for n, t in enumerate(page.tags) if t in ("article", "main") and sizes[n]), 0)
    for up in page.ancestors(best):
        if page.tags[up] in ("article", "main"):
            best = up
            break
    tops, around = {best}, set()
    if page.tags[best] in ("article", "main"):
        up = page.parents[best]
        bar = max(10.0, 0.2 * points[best])
        for node in range(up + 1, page.last[up] + 1):
            if page.parents[node] == up and node != best and not dropped[node] and sizes[node]:
                prose = page.tags[node] == "p" and links[node] < 0.25 * sizes[node] and sizes[node] > 80
                if points[node] >= bar or prose:
                    tops.add(node)
    else:
        around = set(page.ancestors(best)) - {best}
        for node in range(1, len(page.tags)):
            if page.parents[node] in around and node not in around and 2 * links[node] <= sizes[node]:
                tops.add(node)
    kept = [False] * len(page.tags)
    for node in range(len(page.tags)):
        kept[node] = node in tops or (node > 0 and kept[page.parents[node]])
    return "\n\n".join(t for n, t, k in blocks if kept[n] or (n in around and 2 * k <= len(t)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of each row of `pages` (page_id, url, html)."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string")


def extraction_digest(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).withColumn("n_chars", F.length("text").cast("long"))
