"""Main text against a plain tree built with the standard parser, on pages by hand, and on broken and hostile markup."""

import re
import time
from html.parser import HTMLParser

import pytest

from mnemospark.llm import html_extract as h


class Tree(HTMLParser):
    """A tree of dicts; text stands in it as strings. Void and inline elements have no node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.here = {"tag": "", "up": None, "attrs": {}, "kids": []}
        self.raw = 0

    def handle_starttag(self, tag, attrs):
        if tag in h.RAW:
            self.raw += 1
        elif tag == "br":
            self.here["kids"].append(" ")
        elif tag in h.BLOCKS and tag not in h.VOID:
            for closed in [{"p"} if tag in h.BLOCKS else set(), {"li"} if tag == "li" else set()]:
                x = self.here
                while x["up"] is not None and x["tag"] not in closed and x["tag"] not in ("div", "article", "ul", "ol", "body"):
                    x = x["up"]
                if x["tag"] in closed:
                    self.here = x["up"]
            node = {"tag": tag, "up": self.here, "attrs": dict(attrs), "kids": []}
            self.here["kids"].append(node)
            self.here = node
        elif tag == "a":
            self.here["kids"].append(("link", True))

    def handle_endtag(self, tag):
        if tag in h.RAW:
            self.raw = max(0, self.raw - 1)
        elif tag == "a":
            self.here["kids"].append(("link", False))
        elif tag in h.BLOCKS:
            x = self.here
            while x is not None and x["tag"] != tag:
                x = x["up"]
            if x is not None:
                self.here = x["up"]

    def handle_data(self, data):
        if not self.raw:
            self.here["kids"].append(data)


def unwanted(x, inside):
    if x["tag"] in h.DROPPED or (x["tag"] == "header" and not inside):
        return True
    names = f"{x['attrs'].get('class') or ''} {x['attrs'].get('id') or ''}".lower().split()
    parts = [re.findall("[a-z]+|[0-9]+", n) for n in names]
    if x["tag"] not in h.CONTAINERS or x["tag"] == "main":
        return False
    bad, mild = set(h.UNWANTED), set(h.UNWANTED) | set(h.NEUTRAL)
    return any(bad & set(p) and (not inside or all(q in mild or q.isdigit() for q in p)) for p in parts)


def walk(x, inside=False):
    """All nodes below x that stay, in order, each with its blocks of text; marks x with its own sums."""
    x["blocks"], x["inside"] = [], inside or x["tag"] in ("article", "main")
    held, link, linked = "", False, 0
    flow = []

    def close():
        nonlocal held, linked
        text = " ".join(held.split())
        if text:
            flow.append((x, text, min(linked, len(text))))
        held, linked = "", 0

    for k in x["kids"]:
        if isinstance(k, tuple):
            link = k[1]
        elif isinstance(k, str):
            held += k
            linked += len(k) if link else 0
        else:
            close()
            link = False
            if not unwanted(k, x["inside"]):
                flow += walk(k, x["inside"])
    close()
    return flow


def below(x, y):
    while y is not None:
        if y is x:
            return True
        y = y["up"]
    return False


def reference(page):
    t = Tree()
    t.feed(page)
    t.close()
    flow = walk(t.top)
    if not flow:
        return ""
    nodes, seen = [], set()
    for x, *_ in flow:
        while x is not None:
            if id(x) not in seen:
                seen.add(id(x))
                nodes.append(x)
            x = x["up"]

    def value(x):
        points = chars = links = 0.0
        for y, text, linked in flow:
            if below(x, y):
                chars, links = chars + len(text), links + linked
                up, share = y["up"] or y, 1.0
                while up is not None and up is not x:
                    up, share = up["up"], share / 2
                if up is x and y["tag"] in h.PARAGRAPHS:
                    points += share * (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        return points * (1 - links / chars if chars else 1) * (1.25 if x["tag"] in ("article", "main") else 1)

    best = max((x for x in nodes if x["tag"] not in ("", "html")), key=value, default=t.top)
    if value(best) <= 0:
        best = t.top
    around, up = {}, best
    while up is not None:
        around[up["tag"]] = up
        up = up["up"]
    best = around.get("article") or around.get("main") or best
    kept = [best]
    if best["up"] is not None and best["tag"] not in ("article", "main"):
        for x in best["up"]["kids"]:
            if isinstance(x, dict) and x is not best and any(y is x for y in nodes):
                chars = sum(len(text) for y, text, _ in flow if below(x, y))
                links = sum(linked for y, _, linked in flow if below(x, y))
                if links < chars - links or value(x) >= value(best) / 5:
                    kept.append(x)
    return "\n".join(text for y, text, _ in flow if any(below(k, y) for k in kept))


def test_pages_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in h.main_text(rows).collect()}
    for r in rows.collect():
        assert got[r.page_id].text == reference(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)
        assert got[r.page_id].text


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><a href=x>home</a></header><div class="sidebar"><p>side, bar, text</p></div>
<div id="main-content"><h1>Head &amp; line</h1><p>First, with   <b>bold</b> and a <a href="y">link</a>, commas, more and more text to count.<br>next<p>Second paragraph, unclosed, with &eacute; and more words, many words.
<div class="ad">Buy</div><ul><li>point one<li>point two</ul><script>var a="</p>";</script></div><div class="comments"><p>reader says, hello, there, all</p></div><footer>&copy; x</footer></body></html>"""
MORE = [
    PAGE,
    "<body><h1>Title</h1><div><p>One, two, three, a long enough paragraph here.</p><p>Second.</p></div><div class=footer>f</div></body>",
    '<body><article><h2 id="related-work">Related work</h2><p class="alert-levels">Levels, of alert.</p><section id="related-work"><p>Text of work</p></section><div class="related-posts"><p>x</p></div><div class="ad-box 2">no</div></article></body>',
    "<body><div class=wrap><div class=top><h1>T</h1></div><div class=c><p>One, two, three.</p><p>More, words.</p></div><div><p>short tail</p></div><div><a href=a>all links here</a></div></div></body>",
    "<body><main><h1>T</h1><div><div><p>deep, deep, text</p></div></div><aside><p>a, b, c, d, e, f</p></aside></main><div><p>other, text, beside</p></div></body>",
    "<body><div><div><div><div><div><div><div><p>very, deep, text, that counts</p></div></div></div></div></div></div></div><p>beside</p></body>",
    "<body><table><tr><td>cell, one</td><td>cell two</td></tr></table><pre>code  here</pre></body>",
]


@pytest.mark.parametrize("page", MORE)
def test_pages_by_hand(page):
    assert h.extract(page) == reference(page)


def test_expected_text():
    assert h.extract(PAGE) == "Head & line\nFirst, with bold and a link, commas, more and more text to count. next\nSecond paragraph, unclosed, with é and more words, many words.\npoint one\npoint two"
    assert h.extract(MORE[1]).startswith("Title\nOne")
    assert h.extract(MORE[2]) == "Related work\nLevels, of alert.\nText of work"
    assert h.extract(MORE[3]) == "T\nOne, two, three.\nMore, words.\nshort tail"


def test_broken_markup():
    odd = {None: "", "": "", "<div": "<div", "<p>": "", "plain": "plain", "a <!-- b > c": "a", "<p>x</p> <!-- y": "x", "1 < 2 > 0": "1 < 2 > 0", "<b>x</i> &lt; &#233; &bogus;": "x < é &bogus;"}
    assert {k: h.extract(k) for k in odd} == odd


def test_hostile_markup():
    """Time grows with the page, not with its square."""
    t = time.time()
    assert h.extract("<div>" * 20000 + "<p>deep, text</p>") == "deep, text"
    assert h.extract("<p>x <b>z</b>" * 50000).count("\n") == 49999
    for page in ("<" * 200000, "<a " * 100000, "<!--" * 100000, "<script>" * 20000, "<svg>a" * 50000, '<a "' * 100000 + ">", "</p>" * 100000, "<li>" * 50000 + "x"):
        h.extract(page)
    assert time.time() - t < 30


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, `a.b` int"
    df = spark.createDataFrame([(1, "u", PAGE, "t", 1), (1, "u", PAGE, "t", 1), (2, None, None, None, None), (None, "v", "", "", 0)], schema)
    rows = h.main_text(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in rows) == [("1", len(h.extract(PAGE))), ("1", len(h.extract(PAGE))), ("2", 0), ("None", 0)]
    assert h.main_text(df.where("false")).count() == 0
