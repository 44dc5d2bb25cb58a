"""Main text of web pages, found by scoring the tree of their elements."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements by what they do to the page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
DROPPED = frozenset(
    "head nav header footer aside script style textarea title xmp iframe noembed noframes noscript template button select dialog "
    "menu svg object video audio canvas map input datalist label legend".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr br".split()
)
ROOTS = frozenset(["html", "body", "article", "main"])
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
CLOSING_STOPS = frozenset("ul ol dl table tbody thead tfoot div section article main body".split())
START_SCORE = {"article": 10.0, "main": 8.0, "section": 3.0, "div": 3.0, "td": 2.0, "pre": 2.0, "blockquote": 2.0, "ul": -2.0, "ol": -2.0, "dl": -2.0}
# Words of class, id and role names that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo "
    "promoted promotion recommended related respond share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored subscribe subscription "
    "toolbar widget widgets alert contentinfo complementary search form discussion replies adbox adslot adunit adwrap".split()
)
# Those of them that name parts of an article as well; what they mark goes only if it doesn't read like prose.
AMBIGUOUS = frozenset("discussion form header related search".split())
# Those of them that name what readers wrote.
COMMENTS = frozenset("comment comments commentlist disqus replies respond shoutbox".split())
# Fixed values: "has-sidebar" and the like say something about the rest of the page.
NEGATED = frozenset("has with no without not".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"</?[A-Za-z][^\s/>]*+(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_MARKS = re.compile(r"""\b(class|id|role|style|itemprop|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|\s(hidden)(?=[\s>/])""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _tokens(page: str) -> Iterator[tuple[str, str]]:
    """("text", piece), ("open" or "close", the tag as written). Every character is read a bounded number of times."""
    at, n, quotes = 0, len(page), True
    raw_ended: set[str] = set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:]
            return
        if lt > at:
            yield "text", page[at:lt]
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if end < 0:
                return
            at = end + 3
            continue
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            if end < 0:
                return
            at = end + 1
            continue
        closing = nxt == "/"
        first = page[lt + 2 : lt + 3] if closing else nxt
        if not (first.isascii() and first.isalpha()):
            if closing and first:
                end = page.find(">", lt)  # a bogus comment
                if end < 0:
                    return
                at = end + 1
            else:
                yield "text", "<"
                at = lt + 1
            continue
        m = _TAG.match(page, lt) if quotes else None
        if m:
            end = m.end()
        else:
            quotes = False  # a quote that never closes: from here on tags end at the next >
            end = page.find(">", lt) + 1
            if not end:
                return
        tag = page[lt:end]
        at = end
        yield "close" if closing else "open", tag
        if not closing:
            name = _NAME.match(tag)[1].lower()
            if name in RAW:
                stop = None if name in raw_ended else _RAW_END[name].search(page, at)
                if stop is None:
                    raw_ended.add(name)
                    return
                at = stop.start()


@dataclass
class _Node:
    tag: str
    parent: int
    dropped: bool
    doubtful: int = 0
    marked: bool = False
    score: float = 0.0
    scored: bool = False
    chars: int = 0
    linked: int = 0
    links: int = 0
    children: list[int] = field(default_factory=list)


def _marks(tag: str) -> tuple[bool, int, bool]:
    """(is hidden, names boilerplate: 0 not, 1 by ambiguous words only, 2 for sure, 3 readers' comments, names the article)."""
    hidden, doubtful, good = False, 0, False
    for m in _MARKS.finditer(tag):
        if m[5]:
            hidden = True
            continue
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        elif key == "itemprop":
            good |= value.lower() == "articlebody"
        else:
            for one in value.split():
                words = {w.lower() for w in _WORDS.findall(one)}
                if words.isdisjoint(NEGATED):
                    doubtful = max(doubtful, 3 * bool(words & COMMENTS), 2 * bool(words & BOILERPLATE - AMBIGUOUS), bool(words & AMBIGUOUS))
            good |= key == "role" and value.lower() == "main"
    return hidden, doubtful, good


def _read(page: str) -> tuple[list[_Node], list[tuple[int, str, int]]]:
    """The block elements, and the blocks of text in page order: (element, text, characters in links)."""
    nodes = [_Node("#root", -1, False)]
    blocks: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # name, block element, dropped
    opened: dict[str, int] = {}
    links = 0
    pieces: list[str] = []
    in_links: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                node = stack[-1][1]
                blocks.append((node, text, len(" ".join(entities.unescape("".join(in_links)).split()))))
            pieces.clear()
            in_links.clear()

    def pop() -> None:
        nonlocal links
        name = stack[-1][0]
        if name not in INLINE:
            flush()
        elif name == "a":
            links -= 1
        stack.pop()
        opened[name] -= 1

    for kind, tag in _tokens(page):
        if kind == "text":
            if not stack[-1][2]:
                pieces.append(tag)
                if links:
                    in_links.append(tag)
            continue
        name = _NAME.match(tag)[1].lower()
        if kind == "close":
            if name == "br":
                pieces.append(" ")
            elif opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name == "p":
                flush()
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in INLINE:
            if opened.get("p") and name not in VOID | {"option"} or name == "p" and opened.get("p"):
                while opened["p"]:  # a block ends the paragraph before it
                    pop()
            else:
                flush()
            ends = CLOSES.get(name)
            if ends and any(opened.get(x) for x in ends):
                i = len(stack) - 1
                while i and stack[i][0] not in ends and stack[i][0] not in CLOSING_STOPS:
                    i -= 1
                if stack[i][0] in ends:
                    while len(stack) > i:
                        pop()
            if name == "hr":
                continue
        elif name == "a" and opened.get("a"):
            while stack[-1][0] != "a" and stack[-1][0] in INLINE:
                pop()
            if stack[-1][0] == "a":
                pop()
        if name in VOID or tag.endswith("/>") and name not in RAW:
            continue
        hidden, doubtful, good = _marks(tag) if "=" in tag or "hidden" in tag else (False, 0, False)
        dropped = stack[-1][2] or name in DROPPED or hidden and name not in ROOTS
        if name in ROOTS or name in HEADINGS:
            doubtful = 0
        elif name == "form":
            doubtful = max(doubtful, 1)
        elif name in INLINE:
            dropped |= doubtful > 0
        node = stack[-1][1]
        if name not in INLINE:
            nodes.append(_Node(name, node, dropped, doubtful, marked=good or name in ("article", "main")))
            nodes[node].children.append(len(nodes) - 1)
            node = len(nodes) - 1
        elif name == "a":
            links += 1
            nodes[node].links += 1
        stack.append((name, node, dropped))
        opened[name] = opened.get(name, 0) + 1
    while len(stack) > 1:
        pop()
    flush()
    return nodes, blocks


def _points(text: str, linked: int) -> float:
    """What a block gives to its container: for its length and its commas, less its share in links; none if most of it is links."""
    density = linked / len(text)
    if density > 0.5:
        return 0.0
    return ((1.0 if len(text) >= 25 else 0.0) + text.count(",") + min(len(text) / 100.0, 3.0)) * (1 - density)


def _summed(nodes: list[_Node], values: list[float]) -> list[float]:
    """For each element the sum of its own value and those of all elements in it."""
    out = list(values)
    for i in range(len(nodes) - 1, 0, -1):
        out[nodes[i].parent] += out[i]
    return out


def _settle_doubts(nodes: list[_Node], blocks: list[tuple[int, str, int]]) -> None:
    """Drops what class words mark and forms, now that all text is scored. What ambiguous words mark stays if it holds half of the
    page's points or reads like prose inside an article, a form only if it holds half of them. What is marked for sure
    stays only if it holds half of them and no text but headings and links would be left; readers' comments never do."""
    own, chars, linked = ([0.0] * len(nodes) for _ in range(3))
    for node, text, in_links in blocks:
        own[node] += _points(text, in_links)
        chars[node] += len(text)
        linked[node] += in_links
    total, all_chars, all_linked = _summed(nodes, own), _summed(nodes, chars), _summed(nodes, linked)
    sure, gone, within, left = ([False] * len(nodes) for _ in range(4))
    for i, x in enumerate(nodes[1:], 1):
        half = total[i] > 0 and 2 * total[i] >= total[0]
        within[i] = x.tag == "article" or within[x.parent]
        prose = all_chars[i] >= 80 and all_linked[i] <= 0.2 * all_chars[i] and total[i] >= 2.0
        sure[i] = x.doubtful >= 2 or sure[x.parent]
        gone[i] = gone[x.parent] or x.doubtful == 1 and not (half or prose and within[i] and x.tag != "form")
        left[i] = not sure[i] and not gone[i] and x.tag not in HEADINGS and chars[i] > 2 * linked[i]
    empty = not any(left) and chars[0] <= 2 * linked[0]
    for i, x in enumerate(nodes[1:], 1):
        if nodes[x.parent].dropped or gone[i]:
            x.dropped = True
        elif x.doubtful >= 2 and not x.dropped:
            x.dropped = not (x.doubtful == 2 and empty and total[i] >= 2.0 and 2 * total[i] >= total[0])


def main_text(page: str | None) -> str:
    """The main text of one page; see :func:`extract_main_text`."""
    if not page:
        return ""
    nodes, found = _read(page)
    _settle_doubts(nodes, found)
    blocks = [b for b in found if not nodes[b[0]].dropped]
    if not blocks:
        return ""
    for node, text, linked in blocks:
        nodes[node].chars += len(text)
        nodes[node].linked += linked
        points = _points(text, linked)
        if not points:
            continue
        up = node if nodes[node].tag in ("div", "section", "article", "main", "body", "td", "#root", "html") else nodes[node].parent
        share = 1.0
        for _ in range(4):
            if up < 0:
                break
            if not nodes[up].scored:
                nodes[up].scored = True
                nodes[up].score += START_SCORE.get(nodes[up].tag, 0.0) + (10.0 if nodes[up].marked else 0.0)
            nodes[up].score += points * share
            up, share = nodes[up].parent, share / 2
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[nodes[i].parent]
        up.chars, up.linked, up.links = up.chars + nodes[i].chars, up.linked + nodes[i].linked, up.links + nodes[i].links
    worth = [x.score * (1 - x.linked / x.chars) if x.scored and x.chars else float("-inf") for x in nodes]
    best = max(range(len(nodes)), key=lambda i: (worth[i], -i))
    if worth[best] == float("-inf"):
        return ""
    up = best
    while up >= 0:  # the article that holds the best container, if there is one
        if nodes[up].marked:
            best = up
            if nodes[up].tag == "article":
                break
        up = nodes[up].parent
    kept = {best}
    if nodes[best].parent >= 0:
        least = max(10.0, 0.2 * worth[best])
        for i in nodes[nodes[best].parent].children:
            x = nodes[i]
            if x.dropped or not x.chars or nodes[best].marked and x.tag != nodes[best].tag:
                continue
            if worth[i] >= least or x.tag == "p" and x.chars > 80 and x.linked < 0.25 * x.chars:
                kept.add(i)
    inside = [False] * len(nodes)
    for i, x in enumerate(nodes):
        if i in kept:
            inside[i] = True
        elif x.parent >= 0 and inside[x.parent]:
            menu = x.tag in ("ul", "ol", "dl", "div", "section", "table") and x.links > 1 and x.linked > 0.6 * x.chars
            inside[i] = not (x.dropped or menu)
    return "\n".join(text for node, text, _ in blocks if inside[node])


@F.pandas_udf(StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype="object")


def extract_main_text(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """All columns of ``pages`` plus ``text`` and ``n_chars`` (code points).

    Each page becomes a tree of its block elements. Menus, headers, footers, sidebars, forms (but for one around the page), scripts
    and what class, id or role name as adverts, notices, comments and the like are left out. Every
    other block gives points for its length and commas to its container and, halved at each step, to
    the three above it, less the share of its characters in links. The container with the most
    points (the first of equal ones), its enclosing article if any, and siblings that score a fifth of it are kept, without
    lists of links inside them. Character references are decoded, white space within a block becomes
    one space, blocks are joined by one line feed in page order.

    Null, empty or wholly left-out pages give the empty text; pages of any length are read whole, in
    time linear in their length; repeated rows are treated one by one; columns of ``pages`` named
    like the results are replaced; an empty table stays empty.
    """
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    out = pages.select(*[pages[c] for c in kept], _main_texts(pages[html].cast("string")).alias("text"))
    return out.select(*kept, "text", F.length("text").cast("long").alias("n_chars"))
