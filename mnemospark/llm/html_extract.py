"""Main text of web pages by tree scoring.

Block elements form a tree; inline markup is passed over. Each paragraph-like block has a point, one for each comma and up
to three for its length, less its share of characters in links; the container around it gets them in full, the next one a
half, then a quarter and so on up to the root. The best container is kept (the article around it, if there is one, else the
main element), and with it siblings that score a fifth of it or hold fewer characters in links than beside them. Menus,
headers, footers, sidebars, notices, adverts, forms, comments of readers, scripts and styles are left out by tag, by role
and by class and id. A name made of unwanted words and neutral ones like "box" decides alone. One with other words beside
an unwanted one decides with the evidence of what the element holds: its share of links, fields, short items, the heading
in it, and whether the name only repeats that heading, as anchors of sections do. Inside an article or main element a mild
name ("related", "social") needs evidence against it; a strong one ("comment", "advert", "sidebar") needs evidence for it.
Paragraphs go by whole and by strong names. Headings go with what they head, if they say nothing but "Comments" or the like.

All sums and marks go once up or once down the tree, so depth costs nothing.

Defined results: null or empty html, and pages without text, give an empty text; broken markup is read as far as it
goes, with no limit on depth or length; repeated rows are read each on their own; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>""",
    re.S,
)
OPEN = re.compile(r"<!--|<!\[CDATA\[")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "xmp", "select", "title"}
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = set("p pre td blockquote li dd div section article h1 h2 h3 h4 h5 h6".split())
DROPPED = set("nav footer aside form head menu dialog button fieldset".split())
#: Elements that a new one of the same list closes if it is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
VOID = set("hr br img input meta link area base col embed source track wbr".split())
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|aria-label|itemprop|itemtype|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Words in class and id that name what is no part of the text.
UNWANTED = (
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr "
    "notice notices alert alerts sidebar side widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead comment comments "
    "disqus replies respond share sharing social related recommended recommendations newsletter subscribe popup modal overlay login signup search toolbar pagination "
    "pager tags copyright"
).split()
#: Those of them that hardly ever name a part of the text, whatever stands beside them.
STRONG = "ad ads advert adverts advertisement advertising adsense adbox adsbygoogle sponsored gdpr sidebar nav navbar breadcrumb breadcrumbs comment comments commenter commenters disqus newsletter pagination".split()
#: Words that say nothing beside these.
NEUTRAL = "area article bar block body bottom box button buttons col column container content footer form group holder inner item items label left link links list main module outer page panel post posts right row section site slot story stories text title top unit wrap wrapper zone".split()
#: More of these, which say what shape a thing has or who made it.
SHAPES = "author avatar badge card cards center count counter default desktop feed follow for full grid head heading icon icons info large law list load media message meta mobile more network networks new news native policy primary rail reader readers rectangle reply secondary settings small sticky strip tablet this thread threads tile tiles tool tools user users us view web wide".split()
#: Words of layout that paragraphs and headings also carry.
LAYOUT = {"header", "side", "masthead", "head", "foot"}
#: Names that say that something is, or is not, elsewhere on the page, or what the text is filed under.
STATE = re.compile(r"(?:^|[-_])(?:has|with|without|no|not)[-_]|^(?:is|js|supports|show|hide|tag|category|topic|type|format|status)[-_]|[-_](?:open|closed|enabled|disabled|active|on|off)$")
#: What headings of such parts say, in English, German, French and Spanish.
SAYS = {
    "comments", "comment", "reader comments", "readers comments", "user comments", "leave a comment", "leave a reply", "post a comment", "add a comment", "join the conversation", "discussion", "responses", "replies",
    "related", "related posts", "related articles", "related stories", "related content", "recommended", "recommended for you", "you may also like", "you might also like", "more stories", "more from this author", "read more", "read next", "most read", "most popular", "trending",
    "advertisement", "sponsored", "sponsored content", "share", "share this", "share this article", "share this post", "follow us", "newsletter", "subscribe", "sign up", "tags", "cookies", "we use cookies",
    "kommentare", "anzeige", "werbung", "mehr zum thema", "das könnte sie auch interessieren", "commentaires", "publicité", "à lire aussi", "comentarios", "publicidad", "artículos relacionados", "te puede interesar",
}
WORD = re.compile(r"[^\W\d_]+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FIELDS = {"input", "textarea", "select", "button"}
#: Elements that hold others; only these are judged by class and id.
CONTAINERS = set("address aside center details div dl fieldset figure footer form header li main menu nav ol section table tbody td tfoot th thead tr ul".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none")
_UNWANTED, _STRONG, _NEUTRAL = set(UNWANTED) | set(STRONG), set(STRONG), set(NEUTRAL) | set(SHAPES)
#: How far a name goes.
STAYS, MILD, FIRM, OUT = range(4)


class Node:
    __slots__ = ("tag", "parent", "out", "inside", "points", "chars", "links", "order", "kept", "doubt", "names", "fields", "title")

    def __init__(self, tag, parent, out, order):
        self.tag, self.parent, self.out, self.order = tag, parent, out, order
        self.inside = parent is not None and parent.inside or tag in ("article", "main")
        self.points = self.chars = self.links = 0.0
        self.kept = False
        self.doubt, self.names, self.fields, self.title = STAYS, (), 0, None


@lru_cache(100_000)
def _words(name: str) -> tuple[str, ...]:
    """The words of one name: parted by signs, digits and capitals, and where an unwanted word and another known one are run together."""
    out = []
    for part in PART.findall(name):
        word = part.lower()
        if word not in _UNWANTED and word not in _NEUTRAL:
            known = _UNWANTED | _NEUTRAL
            cut = next((i for i in range(2, len(word) - 1) if word[:i] in known and word[i:] in known and (word[:i] in _UNWANTED or word[i:] in _UNWANTED)), 0)
            if cut:
                out += [word[:cut], word[cut:]]
                continue
        out.append(word)
    return tuple(out)


@lru_cache(100_000)
def _name(name: str) -> int:
    """OUT if a name says alone that its element is no part of the text, FIRM or MILD if it hints at it."""
    if STATE.search(name.lower()):
        return STAYS
    words = _words(name)
    if not any(w in _UNWANTED for w in words):
        return STAYS
    if all(w in _UNWANTED or w in _NEUTRAL or w.isdigit() or len(w) == 1 for w in words):
        return OUT
    return FIRM if any(w in _STRONG for w in words) else MILD


def _judge(tag: str, attributes: str, inside: bool) -> tuple[int, tuple[str, ...]]:
    """How far tag and attributes alone go against an element, and the words of the name that does."""
    if tag in DROPPED:
        return OUT, ()
    if tag == "header":
        return (STAYS if inside else OUT), ()
    worst, words = STAYS, ()
    for attribute, value in ATTRIBUTE.findall(attributes) if attributes else ():
        attribute, value = attribute.lower(), value.strip("\"'")
        if attribute == "hidden" or (attribute == "aria-hidden" and value == "true") or (attribute == "style" and HIDDEN.search(value)):
            return OUT, ()
        if attribute == "role" and value.lower() in ROLES:
            return OUT, ()
        if attribute in ("itemprop", "itemtype") and value.lower().rsplit("/", 1)[-1] in ("comment", "usercomments") and tag in CONTAINERS | {"article"}:
            return OUT, ()
        if attribute == "aria-label" and tag in CONTAINERS and " ".join(WORD.findall(value.lower())) in SAYS:
            return OUT, ()
        if attribute not in ("class", "id") or tag == "main" or tag in HEADINGS and attribute == "id":
            continue
        if tag not in CONTAINERS and tag not in PARAGRAPHS or tag == "article" and not (inside and attribute == "class"):
            continue
        for name in value.split():
            level, those = _name(name), _words(name)
            if tag not in CONTAINERS:
                strong = any(w in _STRONG for w in those)
                if LAYOUT & set(those) or level == MILD or tag in HEADINGS and not strong or level == FIRM and (tag in HEADINGS or tag == "article"):
                    level = STAYS
            elif level == OUT and inside and all(w in LAYOUT or w not in _UNWANTED for w in those):
                level = MILD  # what is named a header there mostly holds the title
            elif level == FIRM and attribute == "id" and tag == "section":
                level = MILD
            if level > worst:
                worst, words = level, those
    return worst, words


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """Nodes of the tree of blocks, and the blocks of text in order: their node, text, and characters in links."""
    root = Node("", None, False, 0)
    nodes, blocks = [root], []
    here, held, link, in_link = root, [], 0, 0
    open_tags: dict[str, int] = {}
    unclosed: set[str] = set()

    def close():
        nonlocal held, link
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text and not here.out:
                blocks.append((here, text, min(link, len(text))))
                if here.tag in HEADINGS:
                    up = here
                    while up is not None and up.title is None:  # the first heading in each element around it
                        up.title, up = text, up.parent
            held, link = [], 0

    def leave(tag: str):
        nonlocal here
        while here.parent is not None:
            gone, here = here, here.parent
            open_tags[gone.tag] -= 1
            if gone.tag == tag:
                return

    at, n = 0, len(page)
    stop = page.rfind(">") + 1  # no tag ends behind it, so none is looked for
    while at < n:
        m = TOKEN.search(page, at, stop) if at < stop else None
        piece = page[at : m.start()] if m else OPEN.split(page[at:], maxsplit=1)[0]
        if piece and not here.out:
            held.append(piece)
            if in_link:
                link += len(piece)
        if not m:
            break
        at = m.end()
        if m[0].startswith(("<!--", "<![CDATA[")) and not m[0].endswith(("-->", "]]>")):
            break  # never closed: nothing behind it is read
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in FIELDS and not ends and not here.out:
            here.fields += 1
        if tag in RAW:
            if not ends and not attributes.endswith("/"):
                close_tag = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if close_tag is None:  # nor will there be one further on
                    unclosed.add(tag)
                at = close_tag.end() if close_tag else (n if tag in ("script", "style") else at)
            continue
        if tag == "a":
            in_link = 0 if ends else 1
        elif tag == "br":
            held.append(" ")
        elif tag in BLOCKS or tag == "button":
            close()
            if ends:
                if open_tags.get(tag):
                    leave(tag)
                in_link = 0
            elif tag not in VOID:
                if open_tags.get("p") and tag != "p" or tag == "p" and here.tag == "p":
                    leave("p")
                for other in CLOSES.get(tag, ()):
                    if here.tag == other:
                        leave(other)
                level, words = (OUT, ()) if here.out else _judge(tag, attributes, here.inside)
                here = Node(tag, here, level == OUT, len(nodes))
                here.doubt, here.names = level, words
                open_tags[tag] = open_tags.get(tag, 0) + 1
                nodes.append(here)
                in_link = 0
    close()
    return nodes, blocks


def _says(title: str) -> str:
    return " ".join(WORD.findall(title.replace("\u2019", "'").replace("'", "").lower()))


def _weigh(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks that stay once elements of doubtful names are judged by what they hold."""
    if any(MILD <= x.doubt <= FIRM for x in nodes):
        n = len(nodes)
        chars, links, items, short, long = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        whole = [x.tag in ("main", "h1") for x in nodes]
        fields = [x.fields for x in nodes]
        for node, text, link in blocks:
            i = node.order
            chars[i] += len(text)
            links[i] += link
            if node.tag not in HEADINGS:
                items[i] += 1
                short[i] += len(text) < 40
                long[i] += len(text) >= 80 and "," in text and 4 * link < len(text)
        for x in reversed(nodes[1:]):
            for sums in (chars, links, items, short, long, fields, whole):
                sums[x.parent.order] += sums[x.order]
        for x in nodes[1:]:
            if x.doubt not in (MILD, FIRM) or whole[x.order] and not x.inside:
                continue
            i, title = x.order, x.title and _says(x.title)
            against = 3 * links[i] >= chars[i] or fields[i] > 0 or title in SAYS or (items[i] >= 3 and 4 * short[i] >= 3 * items[i] and not long[i])
            anchor = bool(title) and title not in SAYS and all(w in title.split() for w in x.names if not w.isdigit())
            if x.doubt == FIRM:
                x.out = not anchor or 3 * links[i] >= chars[i]
            else:
                x.out = against and not (anchor and long[i]) or not x.inside and not anchor and not long[i]
    for x in nodes[1:]:
        x.out = x.out or x.parent.out
    last: dict[int, Node] = {}  # a heading that says only what was dropped right behind it goes too
    said = {node.order for node, text, _ in blocks if node.tag in HEADINGS and _says(text) in SAYS}
    if said:
        for x in nodes[1:]:
            before = last.get(x.parent.order)
            if before is not None and before.order in said and x.out and not x.parent.out:
                before.out = True
            last[x.parent.order] = x
    return [block for block in blocks if not block[0].out]


def _value(x: Node) -> float:
    return x.points * (1 - x.links / x.chars if x.chars else 1) * (1.25 if x.tag in ("article", "main") else 1)


def _best(nodes: list[Node]) -> Node:
    """The container with the highest value, the first of equals; the outermost article around it, else the outermost main element."""
    best = max((x for x in nodes if x.tag not in ("", "html") and not x.out), key=lambda x: (_value(x), -x.order), default=nodes[0])
    if _value(best) <= 0:
        return nodes[0]
    around, up = {}, best
    while up is not None:
        around[up.tag] = up
        up = up.parent
    return around.get("article") or around.get("main") or best


def extract(page: str | None) -> str:
    nodes, blocks = parse(page or "")
    blocks = _weigh(nodes, blocks)
    if not blocks:
        return ""
    for node, text, link in blocks:
        if node.tag in PARAGRAPHS:
            (node.parent or node).points += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - link / len(text))
        node.chars += len(text)
        node.links += link
    for x in reversed(nodes[1:]):  # children come behind their parents
        x.parent.points += x.points / 2
        x.parent.chars += x.chars
        x.parent.links += x.links
    best = _best(nodes)
    best.kept = True
    if best.parent is not None and best.tag not in ("article", "main"):
        for x in nodes:
            if x.parent is best.parent and not x.out and (x.links < x.chars - x.links or _value(x) >= _value(best) / 5):
                x.kept = True
    for x in nodes[1:]:
        x.kept = x.kept or x.parent.kept
    return "\n".join(text for node, text, _ in blocks if node.kept)


def _run(batches):
    for b in batches:
        texts = [extract(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; nothing is exchanged."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
