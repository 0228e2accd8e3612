"""Main text of web pages by ratios of text and punctuation over tag paths."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's elements by role, and names that page templates give to what isn't the article.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "math", "canvas", "select", "textarea", "title", "head")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
CLOSED_BY_BLOCK = frozenset("p".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl article section main div body blockquote aside nav footer header form td th".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion "
    "related recommended replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget".split()
)
#: Readers' words, which may well be most of a page.
ANSWERS = frozenset("commentlist disqus replies reply respond".split())
#: Share of a page's text from which on an element's name says nothing about what it holds.
MOST = 0.6
#: Names that inside an article are those of its own heading.
HEADINGS = frozenset(("header", "masthead", "banner"))
PUNCTUATION = re.compile(r"[.,;:!?¿¡…。、，！？：；]")

#: Elements that a name alone doesn't make boilerplate: an article's own heading may well be called a header.
CONTENT_TAGS = frozenset("article main h1 h2 h3 h4 h5 h6 p".split())

_NAME_PARTS = re.compile(r"[a-z]+")
_COMMENTS = re.compile(r"(?:user|reader|blog|post|page)?comments?(?:list|box|form|section|area|thread|body|text|item|author|meta|wrap|wrapper|container|content)?")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>]*/>|[^>]*>.*?(?:</\1\s*>|(?=<body\b)|\Z))"
    r"""|<(/?)([a-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+(?:>|\Z)""",
    re.I | re.S,
)
#: Weight of an article's or main element's paths; share of the best plain score that a path needs.
WITHIN, SHARE = 8.0, 0.5
#: Weights of a path and its two neighbours in page order.
SMOOTH = (0.25, 0.5, 0.25)


class _Path:
    """An open element: its path, whether it is boilerplate (``plain``: neither itself nor anything about it), inside an article, and inside a link.

    ``bad``: by element, role or being hidden; ``named``: by its name only, which counts unless it holds most of the page's text."""

    __slots__ = ("tag", "path", "parent", "bad", "named", "size", "plain", "within", "link")

    def __init__(self, tag: str, name: str, parent: _Path | None, bad: bool, named: bool, paths: dict[tuple[int, str], int]):
        # a path is a number of its parent's and its own name, so a deep page costs no more than its elements
        self.tag, self.path = tag, paths.setdefault((parent.path if parent else 0, name), len(paths) + 1)
        self.parent, self.bad, self.named, self.size = parent, bad, named, 0
        self.plain = not (bad or named) and (parent is None or parent.plain)
        self.within = tag in ("article", "main") or (parent is not None and parent.within)
        self.link = tag == "a" or (parent is not None and parent.link)


def _open(tag: str, attributes: str, parent: _Path | None, paths: dict[tuple[int, str], int]) -> _Path:
    if not attributes or tag in ("html", "body", "p", "a"):
        name, found = tag, ()
    else:
        found = [(a.lower(), (x or y or z).lower()) for a, x, y, z in _ATTRIBUTE.findall(attributes)]
        name = ".".join([tag, *[v for a, v in found if a == "class"]])
    within = parent is not None and parent.within
    bad, named = tag in BOILERPLATE_TAGS or (tag == "header" and not within), False
    for a, v in found:
        if a in ("class", "id"):
            parts = [x for x in _NAME_PARTS.findall(v) if not (within and x in HEADINGS)]
            named |= tag not in CONTENT_TAGS and not BOILERPLATE_NAMES.isdisjoint(parts)
            bad |= any(map(_COMMENTS.fullmatch, parts)) or (tag not in CONTENT_TAGS and not ANSWERS.isdisjoint(parts))
        elif a == "role":
            bad |= v in BOILERPLATE_ROLES
        else:
            bad |= a == "hidden" or v == "true"
    return _Path(tag, name, parent, bad, named, paths)


def blocks(page: str) -> list[tuple[_Path, str, int]]:
    """Text blocks in page order: the element that holds each, its text, and how much of it is link text."""
    out, stack, parts, linked = [], [], [], 0
    holder, at = None, 0
    paths: dict[tuple[int, str], int] = {}
    root = _Path("", "", None, False, False, paths)
    opened: Counter[str] = Counter()
    every = [root]

    def push(tag: str, attributes: str) -> None:
        every.append(_open(tag, attributes, stack[-1] if stack else root, paths))
        stack.append(every[-1])
        opened[tag] += 1

    def pop(k: int, end: int | None = None) -> None:
        opened.subtract(x.tag for x in stack[k:end])
        del stack[k:end]

    def text(piece: str) -> None:
        nonlocal holder, linked
        if piece and not piece.isspace():
            top = stack[-1] if stack else root
            if holder is None:
                k = len(stack)
                while k and stack[k - 1].tag in INLINE:
                    k -= 1
                holder = stack[k - 1] if k else root
                holder = holder if holder.plain == top.plain else top
            linked += len(piece) * top.link
        parts.append(piece)

    def flush() -> None:
        nonlocal holder, linked
        if holder is not None:
            joined = "".join(parts)
            done = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if done:
                out.append((holder, done, min(linked, len(done))))
        parts.clear()
        holder, linked = None, 0

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag in INLINE:
            if m[2]:
                for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                    if stack[k].tag == tag:
                        pop(k, k + 1)
                        break
                    if stack[k].tag not in INLINE:
                        break
            elif tag not in VOID:
                push(tag, m[4])
            continue
        flush()
        if tag in VOID:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    pop(k)
                    break
        else:
            shut = SIBLINGS.get(tag, frozenset()) | CLOSED_BY_BLOCK
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in shut:
                    pop(k)
                    break
                if stack[k].tag in SCOPES:
                    break
            push(tag, m[4])
    if at < len(page):
        text(page[at:])
    flush()
    _settle(every, out)
    return out


def _settle(every: list[_Path], found: list[tuple[_Path, str, int]]) -> None:
    """What is boilerplate, once it is known how much text each element holds: a name on an element about most of the page's text says how the page
    is laid out, not what that is. ``every``: elements, parents first."""
    for holder, text, _ in found:
        holder.size += len(text)
    for e in reversed(every[1:]):
        if not e.bad:
            e.parent.size += e.size
    most = MOST * every[0].size
    for e in every[1:]:
        e.plain = e.parent.plain and not e.bad and not (e.named and e.size < most)


def main_text(page: str | None) -> str:
    """The blocks of a page whose tag paths score as content, joined by line breaks."""
    found = blocks(page or "")
    totals: dict[int, list[float]] = {}
    for holder, text, linked in found:
        if holder.plain:
            t = totals.setdefault(holder.path, [0, 0, 0, 0, holder.within])
            t[0] += len(text)
            t[1] += len(PUNCTUATION.findall(text))
            t[2] += linked
            t[3] += 1
    if not totals:
        return ""
    # ratios of text and of punctuation to nodes on the path, fused; link text counts against the path
    raw = [(math.log1p(n / k) + math.log1p(p / k)) * (1 - a / n) for n, p, a, k, _ in totals.values()]
    padded = [raw[0], *raw, raw[-1]]
    smooth = [sum(w * x for w, x in zip(SMOOTH, padded[i : i + 3], strict=True)) if v else 0.0 for i, v in enumerate(raw)]
    least = SHARE * max(smooth)
    kept = {path for (path, t), s in zip(totals.items(), smooth, strict=True) if s > 0 and s * (WITHIN if t[4] else 1.0) >= least}
    if any(totals[p][4] for p in kept):
        kept = {p for p in kept if totals[p][4]}
    return "\n".join(text for holder, text, _ in found if holder.plain and holder.path in kept)


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [main_text(x) for x in b["html"]]
        yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract_main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    ``pages``: ``page_id, url, html``; other columns are left. Returns ``page_id, url, text, n_chars``. A page is cut
    into blocks at block elements and line breaks; for each root-to-leaf tag path, lengths and punctuation of its blocks are
    related to their number, fused, smoothed along the page, and paths above a share of the best are content. Paths that
    run through menus, footers, forms and the like, by element, role or name, are none, but a name counts only on elements that hold less than MOST of
    the page's text, and readers' comments always; paths inside an article or main element are preferred. A page's links count against its paths, so lists of links fall out.

    Null or empty html, or a page without such text: an empty text. Broken markup is read as far as it goes. Null ids and
    urls stay; repeated rows are each extracted. No rows give no rows. Each page is worked on alone, on the scan's partitions.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInPandas(_extracted, "page_id long, url string, text string, n_chars long")
