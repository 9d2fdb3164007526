"""Main text of web pages by tree scoring.

A page is read into a tree of containers with text blocks.  Every block passes points (one, one for each
comma, one for each 100 characters up to three) to its container, half to the next one up, and a falling
share further up.  A container's points are discounted by its link density.  The best container is kept
with those siblings that score well enough; menus, headers, footers, sidebars, notices, adverts, forms and
comments are left out by their element, role or class wherever they stand; an element within a line, such as a
button or a hidden word, leaves the line whole.  Inside an article a paragraph, heading or item may bear a name of
its subject ("legal", "related") and stays; a container of that name goes.

Edge cases: null or empty html and pages without text give '' and 0; unclosed elements, comments and
quotes are closed at the next place that allows it, an unfinished tag at the very end is no text; white
space and character references are resolved in whole texts of any length; page order decides ties.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: element names of HTML by their role
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template svg annotation annotation-xml title textarea object canvas noembed noframes xmp".split())
SKIP = frozenset("nav footer aside button select dialog menu head option optgroup datalist".split())
FORM = frozenset("form fieldset".split())
KEEP = frozenset("article main".split())
BAD_ROLE = frozenset("navigation banner contentinfo complementary dialog alert alertdialog search form menu menubar toolbar tablist".split())
BAD_WORD = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist cookie"
    " cookies consent disqus discussion footer footnav gdpr header masthead menu menus modal nav navbar navigation newsletter notice"
    " notification alert overlay pager pagination popup promo promotion related recommended replies reply respond share sharing shares"
    " sidebar sidebars side aside social sponsor sponsored subscribe signup login search tags toolbar widget widgets skip topbar copyright"
    " outbrain taboola teaser sitemap legal disclaimer".split()
)
# names that a paragraph, heading or item of an article may have by its subject; containers of these names are parts of a page
SUBJECT = frozenset(
    "banner copyright disclaimer discussion footer header legal masthead overlay promotion recommended related replies reply respond search side aside sidebar"
    " sidebars sitemap skip tags teaser toolbar topbar widget widgets".split()
)
TALK = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
GOOD_WORD = frozenset("article body content entry hentry main page post story text blog prose column".split())
#: Depth beyond which elements have no level of their own; what they are named and left out by still counts.
DEEP = 400
# containers of which one block may be a link
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 pre li td th dd dt blockquote figcaption header hgroup figure".split())
# an open element is closed by the start of one of these
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPE = frozenset("table ul ol dl td th body html article section div main".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_STOP = re.compile(r"""[>"']""")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "parent", "depth", "bad", "doubt", "named", "keep", "bias", "points", "chars", "links", "order")

    def __init__(self, tag, parent, bad, doubt, bias, order):
        self.tag, self.parent, self.bad, self.doubt, self.bias, self.order = tag, parent, bad, doubt, bias, order
        self.depth = parent.depth + 1 if parent else 0
        self.named = False
        self.keep = tag in KEEP or parent is not None and parent.keep
        self.points = 0.0
        self.chars = self.links = 0


def _tag_end(html: str, at: int, unclosed: set) -> int:
    """Where the tag that opens before ``at`` ends: the first '>' outside quotes, else the first at all.

    ``unclosed`` collects quotes that do not come again in the page, so that no two tags look for them.
    """
    close = html.find(">", at)
    if close < 0:
        return -1
    i = at
    while m := _STOP.search(html, i):
        i = m.end()
        if m[0] == ">":
            return m.start()
        if html[m.start() - 1] in "= \t\n\r":
            i = 0 if m[0] in unclosed else html.find(m[0], i) + 1
            if not i:
                unclosed.add(m[0])
                return close
    return close


def _judge(tag: str, attrs: dict, inside_keep: bool) -> tuple[bool, bool | str, float]:
    """Whether an element is left out, whether it is unless it holds most of the page, and the points of its names."""
    if tag in SKIP or (tag == "header" and not inside_keep):
        return True, False, 0.0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in BAD_ROLE - {"form", "search"} or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True, False, 0.0
    if tag in ("html", "body"):
        return False, False, 0.0
    if tag in FORM or attrs.get("role", "").lower() in ("form", "search"):
        return False, True, 0.0
    names = {w.lower() for w in _WORDS.findall(attrs.get("class", "") + " " + attrs.get("id", ""))}
    told = names & BAD_WORD
    if told and tag not in KEEP and not (inside_keep and tag in LEAF and told <= SUBJECT):
        if not names & GOOD_WORD or names & {"comment", "comments", "ad", "ads"}:
            return False, "talk" if names & TALK else "name", 0.0
        if names & {"sidebar", "footer"}:  # "sidebar-content", or "content-with-sidebar"
            return False, True, 0.0
    return False, False, (25.0 if names & GOOD_WORD else 0.0) + (25.0 if tag in KEEP else 0.0)


def parse(html: str) -> list[tuple[Node, str, int]]:
    """Text blocks in page order: the element they stand in, the text, and how many of its characters are links."""
    root = Node("html", None, False, False, 0.0, 0)
    open_tags: dict[str, int] = {}
    unclosed: set[str] = set()
    stack, blocks, parts = [root], [], []
    order = links = in_link = 0

    def flush():
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                holder = stack[-1]
                while holder.tag not in BLOCK and holder.parent:
                    holder = holder.parent
                blocks.append((holder, text, min(links, len(text))))
            parts.clear()
        links = 0

    def close_to(depth: int):
        nonlocal in_link
        if any(x.tag in BLOCK for x in stack[depth:]):
            flush()
        for x in stack[depth:]:
            open_tags[x.tag] -= 1
            in_link -= x.tag == "a"
        del stack[depth:]

    i, n = 0, len(html)
    while i < n:
        lt = html.find("<", i)
        if lt < 0:
            lt = n
        if lt > i:
            if not stack[-1].bad:
                text = unescape(html[i:lt])
                parts.append(text)
                if in_link:
                    links += len(text.strip())
        if lt >= n:
            break
        nxt = html[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                i = n if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                i = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        m = _NAME.match(html, lt + 1 + closing)
        if not m:
            if closing:
                end = html.find(">", lt)
                i = n if end < 0 else end + 1
            else:
                if not stack[-1].bad:
                    parts.append("<")
                i = lt + 1
            continue
        tag = m[0].lower()
        end = _tag_end(html, m.end(), unclosed)
        if end < 0:
            break
        i = end + 1
        if closing:
            if not open_tags.get(tag):
                if tag == "p":
                    flush()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_to(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(html, i)
            i = n if close is None else close.end()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # a paragraph ends where a block starts, an item where its next one does
                if stack[k].tag == "p" or stack[k].tag in CLOSES.get(tag, ()):
                    close_to(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        raw = html[m.end() : end]
        attrs = {}
        if raw.strip(" /"):
            for a in _ATTR.finditer(raw):
                attrs.setdefault(a[1].lower(), unescape((a[2] or "").strip("\"'")))
        up = stack[-1]
        bad, doubt, bias = (True, False, 0.0) if up.bad else _judge(tag, attrs, up.keep)
        if raw.rstrip().endswith("/") and tag not in BLOCK:
            continue
        order += 1
        if up.depth >= DEEP and tag not in BLOCK and tag != "a" and bad == up.bad and not doubt:
            continue
        # nesting that no article has: later elements hang from one, or from the last that is in doubt
        keep = up.keep or tag in KEEP
        node = Node(tag, up if up.depth < DEEP or up.doubt else up.parent, bad, bool(doubt), bias, order)
        node.keep, node.named = keep, doubt if isinstance(doubt, str) else ""
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        in_link += tag == "a"
    flush()
    return blocks


def _settle(blocks: list, named: bool) -> list:
    """The blocks without those in elements in doubt that do not hold most of the page."""
    held: dict[int, list] = {}
    articles = 0
    for node, text, links in blocks:
        articles += len(text) * node.keep
        x = node
        while x is not None:
            if x.doubt and bool(x.named) == named:
                h = held.setdefault(id(x), [0, 0, 0, False])
                h[0] += len(text)
                h[1] += links
                h[2] += len(text) * node.keep
                h[3] |= node.tag == "h1"
            x = x.parent
    if not held:
        return blocks
    total = sum(len(t) for _, t, _ in blocks)

    def stays(x, node) -> bool:
        size, links, inside, title = held[id(x)]
        if not named:
            return size > 0.6 * total
        if links >= 0.5 * size:
            return False
        if size > (0.9 if x.named == "talk" and not title and not inside else 0.6) * total and inside >= 0.6 * articles:
            return True
        # an article that is most of the articles and much of the page overrides the name around it
        return node.keep and not x.keep and inside > 0.6 * articles and inside > 0.25 * total

    def whole(node) -> bool:
        x = node
        while x is not None:
            if id(x) in held and not stays(x, node):
                return False
            x = x.parent
        return True

    return [b for b in blocks if whole(b[0])]


def extract(html: str | None) -> str:
    """The main text: kept blocks joined by one newline."""
    if not html:
        return ""
    blocks = [b for b in parse(html.replace("\x00", "")) if not b[0].bad]
    # names first, then forms and names that say two things: left out unless they hold most of what is there
    for named in (True, False):
        blocks = _settle(blocks, named)
    if not blocks:
        return ""
    scored: dict[int, Node] = {}
    for node, text, links in blocks:
        points = (1.0 + text.count(",") + min(len(text) / 100.0, 3.0)) * (1.0 - links / len(text))
        up = node if node.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "td", "th", "dd", "dt", "blockquote", "figcaption") else node.parent or node
        level = 0
        while up is not None:
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up.chars += len(text)
            up.links += links
            scored[id(up)] = up
            up, level = up.parent, level + 1

    def score(x: Node) -> float:
        return (x.points + x.bias) * (1.0 - x.links / max(1, x.chars))

    inside = [x for x in scored.values()]
    best = max(inside, key=lambda x: (score(x), x.depth, -x.order))
    # an article or main element around the best container is the article as a whole
    up = best.parent
    while up is not None:
        if up.tag in KEEP:
            best = up
        up = up.parent
    top = score(best)
    keep = {id(best)}
    for x in inside:
        if x is not best and x.parent is best.parent and x.parent is not None and score(x) >= max(3.0, 0.2 * top) and x.links < 0.5 * x.chars:
            keep.add(id(x))
    # menus: containers of the article that are mostly links, but not one linked headline or item
    size: dict[int, list] = {}
    for node, text, links in blocks:
        x = node
        while x is not None:
            c = size.setdefault(id(x), [0, 0, 0])
            c[0] += len(text)
            c[1] += links
            c[2] += 1 + (x is node)
            x = x.parent
    title = -1  # the headings directly before the best container
    for k, (node, _, _) in enumerate(blocks):
        x = node
        while x is not None and x is not best:
            x = x.parent
        if x is best:
            title = k
            while title and blocks[title - 1][0].tag in ("h1", "h2", "h3") and blocks[title - 1][0].parent is best.parent:
                title -= 1
            break
    first = k
    out = []
    for k, (node, text, links) in enumerate(blocks):
        x, within, menu = node, False, False
        while x is not None and not within:
            within = id(x) in keep
            c = size[id(x)]
            menu |= not within and x.tag in BLOCK and x.tag not in LEAF and c[2] > 1 and c[1] >= 0.6 * c[0]
            x = x.parent
        if not within and node.parent is best.parent and node.tag in ("p", "h1", "h2", "blockquote", "pre"):
            within, menu = len(text) > 80 and links < 0.25 * len(text), False
        if within and not menu or title <= k < first:
            out.append(text)
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; a page is one row of work and nothing is shuffled."""

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    ids = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {ids['page_id']}, url string, text string, n_chars long")
