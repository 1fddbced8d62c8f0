"""The scorer against a plain recursive one on generated pages, and pages that are deep, long or odd."""

import random
import time

import pytest

from botlantern.llm.extraction import extraction_digest, main_text

WORDS = "tide mast river, stone quill ember, fathom crest willow anchor".split()
KINDS = {
    "": 0, "class=ad": 2, "class=comments": 2, "class=widget": 1, "id=content": 0, "role=navigation": 2, "class=plain": 0,
    "id=sidebar": 2, "id='comments-section'": 2, 'class="related-posts wide"': 2, "class = side": 2, "id=rail-transport": 0, 'id="side-effects"': 0, "id=cookie-recipes": 0, "id=popular-culture": 0,
    "class=commentary": 0, "id=rail": 3, "ID='share'": 3, "hidden": 2, "style='color:red; display: none'": 2, "aria-hidden=true": 2, "class=x class=comments": 0, "id=widget": 1,
}
#: Attributes that tell nothing, whatever stands in them.
NEUTRAL = ["", "data-hidden='false'", 'title="A hidden valley"', 'aria-label="Hidden costs, class=ad"', "width=200", "data-class=ad", "data-id='sidebar'", "aria-hidden=false", 'onclick="a>b"', "xstyle='display:none'", "role=note"]
TAG_KINDS = {"nav": 2, "footer": 2, "aside": 2, "form": 1, "header": 1}


class Node:
    def __init__(self, tag, attrs="", parts=()):
        self.tag, self.attrs, self.parts, self.up, self.points, self.more = tag, attrs, list(parts), None, 0.0, ("", "")
        self.kind = 2 if TAG_KINDS.get(tag) == 2 else max(TAG_KINDS.get(tag, 0), KINDS[attrs])
        # The name of an article's container stands against a doubt, not for a form.
        if attrs == "id=content":
            self.kind = TAG_KINDS.get(tag, 0)
        for p in self.parts:
            if isinstance(p, Node):
                p.up = self

    def html(self):
        inside = "".join(p.html() if isinstance(p, Node) else "".join(f"<a href=x>{t}</a>" if link else t for t, link in p) for p in self.parts)
        return inside if self.tag == "body" else f"<{self.tag} {self.more[0]} {self.attrs} {self.more[1]}>{inside}</{self.tag}>"

    def nodes(self):
        return [self] + [n for p in self.parts if isinstance(p, Node) for n in p.nodes()]

    def above(self):
        return [self] + (self.up.above() if self.up else [])

    def blocks(self):
        """(node, text, characters in links) in page order."""
        out = []
        for p in self.parts:
            if isinstance(p, Node):
                out += p.blocks()
            else:
                text = " ".join("".join(t for t, _ in p).split())
                if text:
                    out.append((self, text, min(len(text), sum(len(t) for t, link in p if link))))
        return out


def plain_main_text(body):
    def size(n, blocks):
        return sum(len(t) for b, t, _ in blocks if n in b.above())

    def links(n, blocks):
        return sum(k for b, _, k in blocks if n in b.above())

    everything = body.blocks()
    whole = size(body, everything)

    def set_aside(n):
        if n is body:
            return False
        article = any(a.tag in ("article", "main") for a in n.above())
        own, linked = size(n, everything), links(n, everything)
        heavy = n.kind == 1 and (own > 0.6 * whole or (n.tag == "header" and any(a.tag in ("article", "main") for a in n.up.above())))
        # An article's section whose name is a common word stays if it is prose.
        heavy |= n.kind == 3 and any(a.tag in ("article", "main") for a in n.up.above()) and own - linked >= 100 and linked < 0.25 * own
        lists = not article and n.tag in ("ul", "table", "div", "section") and own and linked > 0.7 * own and 2 * own < whole
        return set_aside(n.up) or (n.kind > 0 and not heavy) or bool(lists)

    blocks = [b for b in everything if not set_aside(b[0])]
    for n, text, _ in blocks:
        if len(text) >= 25:
            worth = 1 + text.count(",") + min(len(text) / 100, 3)
            container = n.up if n.tag in ("p", "li", "td", "h2") else n
            for share, a in enumerate(container.above()[:3], 1):
                a.points += worth / share
    order = body.nodes()
    score = {n: n.points * (1 - links(n, blocks) / size(n, blocks)) if size(n, blocks) else 0.0 for n in order}
    best = max(order, key=lambda n: (score[n], -order.index(n)))
    if not score[best]:
        best = next((n for n in order if n.tag in ("article", "main") and size(n, blocks)), body)
    best = next((a for a in best.above() if a.tag in ("article", "main")), best)
    tops, around = {best}, set()
    if best.tag in ("article", "main"):
        for n in best.up.parts:
            if isinstance(n, Node) and not set_aside(n) and size(n, blocks):
                prose = n.tag == "p" and links(n, blocks) < 0.25 * size(n, blocks) and size(n, blocks) > 80
                if score[n] >= max(10.0, 0.2 * score[best]) or prose:
                    tops.add(n)
    else:
        around = set(best.above()) - {best}
        tops |= {n for n in order if n.up in around and n not in around and 2 * links(n, blocks) <= size(n, blocks)}
    return "\n\n".join(t for n, t, k in blocks if tops & set(n.above()) or (n in around and 2 * k <= len(t)))


def generated(rng, depth=0):
    def run():
        return [(" ".join(rng.choices(WORDS, k=rng.randint(1, 25))) + " ", rng.random() < 0.15) for _ in range(rng.randint(1, 2))]

    parts = []
    for _ in range(rng.randint(1, 4)):
        roll = rng.random()
        if roll < 0.15 and (not parts or isinstance(parts[-1], Node)):
            parts.append(run())
        elif roll < 0.55 or depth > 3:
            tag = rng.choice(["p", "p", "p", "h2", "ul"])
            parts.append(Node(tag, "", [Node("li", "", [run()]) for _ in range(rng.randint(1, 3))] if tag == "ul" else [run()]))
        else:
            parts.append(generated(rng, depth + 1))
    if depth == 0:
        return Node("body", "", parts)
    tag = rng.choice("div div div section article main nav footer aside form header".split())
    node = Node(tag, rng.choice(list(KINDS)) if tag in ("div", "section") else "", parts)
    # The first attribute of a name counts, so "role=note" must not stand before a role.
    node.more = rng.choice([x for x in NEUTRAL if x.split("=")[0] not in node.attrs]), rng.choice(NEUTRAL)
    return node


def test_against_a_recursive_scorer():
    rng = random.Random(11)
    some = 0
    for _ in range(1500):
        page = generated(rng)
        want = plain_main_text(page)
        assert main_text(page.html()) == want, page.html()
        some += bool(want)
    assert some > 400


PROSE = "<p>The long tide came in slowly, and the mast of the ship stood against the grey sky for many hours.</p>"


def article(part):
    return f"<body><nav><a href=x>home</a></nav><article><h1>Title</h1>{PROSE}{PROSE}{part}</article><div id=sidebar width=200><p>ASIDE of no interest to anyone</p></div></body>"


@pytest.mark.parametrize(
    "part, kept",
    [
        ('<p title="A hidden valley">PART</p>', True), ('<section aria-label="Hidden costs"><p>PART</p></section>', True), (f'<section id="rail-transport"><h2>PART</h2>{PROSE}</section>', True),
        (f'<section id="side-effects">PART {PROSE}</section>', True), (f'<section id="rail"><p>PART</p>{PROSE}</section>', True), (f'<h2 id="related-work">PART</h2>{PROSE}', True), ('<h2 id="menu">PART</h2>', True),
        ('<div class="x" class="comments">PART</div>', True), (f'<section id="commentary">PART {PROSE}</section>', True), ("<div data-x='<p hidden>'>PART</div>", True),
        (f'<div class="comments"><p>PART</p>{PROSE}</div>', False), (f'<section id="comments">PART {PROSE}</section>', False), ('<div class="cookie-banner">PART</div>', False), ("<div hidden>PART</div>", False),
        ("<div HIDDEN=hidden>PART</div>", False), ('<div class="social-share">PART</div>', False), ("<div style=\"x:y; DISPLAY : none\">PART</div>", False), ('<div id="ad-slot-1">PART</div>', False),
    ],
)
def test_attributes_are_read_whole_and_slugs_tell_nothing(part, kept):
    text = main_text(article(part))
    assert ("PART" in text) == kept and "Title" in text and "ASIDE" not in text


def test_an_article_with_a_data_attribute():
    assert main_text(f'<article data-hidden="false">{PROSE}</article>') == PROSE[3:-4]


@pytest.mark.parametrize(
    "page",
    ["<div>word, " * 100_000, "<b>word " * 100_000 + "<hr>x" * 50_000, "<div>x" * 100_000 + "</section>" * 100_000, "<i><div>" + "<b>" * 100_000 + "x</i>" * 100_000, "<p>" * 100_000 + "</p>" * 100_000, "<a '\"x " * 200_000, "<article>" + "<p>The tide, the mast, and a long way to go.</p>" * 110_000],
    ids=["deep", "inline", "stray", "crossed", "paragraphs", "quotes", "five megabytes"],
)
def test_deep_and_long_pages_take_time_in_proportion(page):
    start = time.perf_counter()
    text = main_text(page)
    assert time.perf_counter() - start < 30
    if page.startswith("<article>"):
        assert text.count("\n\n") == 109_999


def test_tables_of_pages(spark):
    schema = "page_id long, url string, html string, text string"
    assert extraction_digest(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", "<p>One &amp; two</p>", "clash"), (1, "u", "<p>One &amp; two</p>", "clash"), (None, None, None, None)]
    got = sorted(map(tuple, extraction_digest(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(1, "u", "One & two", 9)] * 2 + [(None, None, "", 0)]
