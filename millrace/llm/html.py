"""HTML extraction by consensus host paths.

Each page is cut into blocks of text. A block hangs in containers (div, article, section, ...), and a
container has a generalised path: the tags and classes from the root, without ids and digits, as in
`body>div.post>article`. Each page votes for the path that holds its prose most closely; votes are
summed per host by Spark, and the pages of a host are extracted anew with the path that won. A page
on which that path holds less than FAIR_SHARE of the prose of its own best path uses its own.

Blocks in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments
never count, whatever container they hang in. Some classes (SOFT: legal, related, notice and the like) may also
name an article: their blocks count on a page that has nothing but headings besides them, if they are not links.
A page is read once from start to end: unclosed tags and quotes cost no second look. Containers nested deeper
than MOST_DEEP have the path of what holds them.

Votes are partial sums before the shuffle, one row per host, path and task, so a host with a third
of all pages is not gathered anywhere. Winners are one row per host; the join back is left to Spark,
which splits a hot host or sends the winners to all tasks if they are small.

A null html is empty and gives an empty text; a url that is null or has no host belongs to host "".
Ties between paths go to the longer path, then to the first by code point. Repeated rows count as
pages each. Columns other than id, url and html are left out, whatever their names.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.workspace import stored

# What HTML and common page templates call things.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div td table tbody tr ul ol dl blockquote figure".split())
SKIPPED = frozenset(
    "head title script style noscript template svg math iframe object canvas nav header footer aside form button "
    "select option textarea label fieldset dialog menu audio video".split()
)
BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption th td tr table thead tbody tfoot ul ol dl div "
    "section article main body html blockquote figure center hr details summary hgroup search".split()
)
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILERPLATE = re.compile(
    r"(?:^|[-_])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|"
    r"foot|sidebar\w*|side|aside|widget\w*|comments?|commentlist|disqus|respond|replies|reply|discussion|cookies?|"
    r"consent|gdpr|notices?|notification\w*|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"form|search|share|sharing|social|related|recommend\w*|toolbar|pagination|pager|copyright|legal|disclaimer)(?:$|[-_])"
)
#: Classes that name a part of an article though they look like boilerplate.
KEPT = re.compile(r"(?:^|[-_])(?:article|post|entry|story|page)[-_]?(?:header|head|title|body|content|text)(?:$|[-_])")

#: Classes that mostly name boilerplate but may name an article.
SOFT = re.compile(
    r"(?:^|[-_])(?:promo\w*|header|masthead|side|aside|discussion|notices?|notification\w*|alert|form|search|share|sharing|"
    r"social|related|recommend\w*|copyright|legal|disclaimer)(?:$|[-_])"
)

_OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_SPECIAL = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WHITE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
NEAR_ALL = 0.85
FAIR_SHARE = 0.5
MOST_DEEP = 200
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SEMANTIC = frozenset(("article", "main"))


@dataclass
class Open:
    tag: str
    path: str
    skipped: bool
    soft: bool = False


@dataclass
class Block:
    paths: tuple[str, ...]
    text: str
    linked: int = 0
    heading: bool = False


@dataclass
class Page:
    """Blocks outside boilerplate, and those inside soft classes, in page order."""

    blocks: list[Block] = field(default_factory=list)
    #: Places of soft blocks among the others.
    soft: list[tuple[int, Block]] = field(default_factory=list)

    def main(self) -> list[Block]:
        """The blocks that may be of the article."""
        prose = [(at, b) for at, b in self.soft if 2 * b.linked < len(b.text)]
        if not prose or not all(b.heading for b in self.blocks):
            return self.blocks
        both = [(at, 0, b) for at, b in enumerate(self.blocks)] + [(at - 0.5, 1, b) for at, b in prose]
        return [b for _, _, b in sorted(both, key=lambda x: x[:2])]


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), references.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _names(attributes: dict[str, str]) -> list[str]:
    return attributes.get("class", "").split()


def _boilerplate(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """`hard`, `soft`, or empty."""
    if tag == "header" and in_article:
        return ""  # the head of the article itself: its title
    if tag in SKIPPED or "hidden" in attributes or attributes.get("role", "").lower() in ROLES:
        return "hard"
    if attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return "hard"
    if tag in ("html", "body", "main", "article"):
        return ""
    names = [re.sub(r"([a-z])([A-Z])", r"\1-\2", x).lower() for x in (*_names(attributes), attributes.get("id", ""))]
    named = [x for x in names if BOILERPLATE.search(x) and not KEPT.search(x)]
    hard = any(BOILERPLATE.search(SOFT.sub("", x)) or not SOFT.search(x) for x in named)
    return "hard" if hard else "soft" if named else ""


def _tag_end(source: str, at: int, last: dict[str, int]) -> int:
    """Where the tag ends whose attributes begin at `at`; a quote that is never closed is no quote."""
    while m := _SPECIAL.search(source, at):
        if m[0] == ">":
            return m.start()
        at = source.index(m[0], m.end()) + 1 if m.start() < last[m[0]] else m.end()
    return -1


def parse(source: str) -> Page:
    page, stack = Page(), []
    opened: Counter[str] = Counter()
    trail: list[str] = []  # paths of the open containers
    last = {quote: source.rfind(quote) for quote in "\"'"}
    words: list[str] = []
    linked, in_link, in_title, at = 0, 0, 0, 0

    def close_block(heading: bool = False) -> None:
        nonlocal linked
        text = _WHITE.sub(" ", references.unescape("".join(words))).strip()
        if text:
            block = Block(tuple(trail), text, min(linked, len(text)), heading)
            if stack and stack[-1].soft:
                page.soft.append((len(page.blocks), block))
            else:
                page.blocks.append(block)
        words.clear()
        linked = 0

    def push(tag: str, path: str, skipped: bool) -> None:
        soft = kind == "soft" or bool(stack) and stack[-1].soft
        stack.append(Open(tag, path, skipped, soft))
        opened[tag] += 1
        if path:
            trail.append(path)

    def say(part: str) -> None:
        nonlocal linked
        if part and not (stack and stack[-1].skipped):
            words.append(part)
            linked += len(part) if in_link else 0

    while at < len(source):
        m = _OPENING.search(source, at)
        if m is None:
            say(source[at:])
            break
        if m[1] or m[2]:  # a comment, or a declaration
            say(source[at : m.start()])
            end = source.find("-->" if m[1] else ">", m.end())
            at = len(source) if end < 0 else end + (3 if m[1] else 1)
            continue
        tag, end = m[4].lower(), _tag_end(source, m.end(), last)
        if end < 0:  # no tag is closed from here on
            say(source[at:])
            break
        say(source[at : m.start()])
        inner, at = source[m.end() : end], end + 1
        hidden, kind = bool(stack) and stack[-1].skipped, ""
        if m[3]:  # an end tag
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCKS and not hidden:
                close_block(tag in HEADINGS)
            if opened[tag]:
                if not hidden:
                    close_block()
                while stack:
                    ended = stack.pop()
                    opened[ended.tag] -= 1
                    if ended.path:
                        trail.pop()
                    if ended.tag == tag:
                        break
            continue
        if tag in _RAW_END:
            raw = _RAW_END[tag].search(source, at)
            end = source.find(">", raw.end()) if raw else -1
            at = end + 1 if end >= 0 else len(source)
            continue
        if tag in VOID or inner.endswith("/"):
            if tag in ("br", "hr", "img"):
                say(" ")
            continue
        if tag == "a":
            in_link += 1
        if tag in BLOCKS and not hidden:
            close_block()
        if hidden:
            if tag in CONTAINERS or tag in SKIPPED:
                push(tag, "", True)
            continue
        attributes = _attributes(inner) if inner else {}
        kind = _boilerplate(tag, attributes, opened["article"] > 0)
        if tag in CONTAINERS or kind:
            if kind:
                close_block()
            if kind and tag not in CONTAINERS and tag not in SKIPPED:
                # a paragraph or span of boilerplate lasts until its end tag or the end of what holds it
                push(tag, "", kind == "hard")
                continue
            name = ".".join([tag, *sorted(_DIGITS.sub("", x.lower()) for x in _names(attributes))])
            above = trail[-1] if trail else ""
            path = "" if kind == "hard" or len(stack) >= MOST_DEEP else f"{above}>{name}" if above else name
            push(tag, path, kind == "hard")
    if not (stack and stack[-1].skipped):
        close_block()
    return page


def _prose(blocks: list[Block]) -> tuple[dict[str, int], int]:
    """Characters of prose by path, links counted against it, and of all blocks."""
    prose: dict[str, int] = {}
    total = 0
    for block in blocks:
        size = max(0, len(block.text) - 2 * block.linked)
        total += size
        for path in block.paths:
            prose[path] = prose.get(path, 0) + size
    return prose, total


def own_path(page: Page) -> str:
    """The path that holds the prose of a page most closely; empty if it has no text."""
    prose, total = _prose(page.main())
    if not prose:
        return ""
    semantic = [p for p, n in prose.items() if p.rsplit(">", 1)[-1].split(".")[0] in SEMANTIC and 2 * n >= total]
    near = semantic or [p for p, n in prose.items() if n >= NEAR_ALL * total]
    return min(near, key=lambda p: (-p.count(">"), p)) if near else min(prose, key=lambda p: (-prose[p], p))


def text_at(page: Page, path: str | None) -> str:
    """The text at a path, or at the page's own path if there is not a fair share of its prose."""
    blocks, best = page.main(), own_path(page)
    prose, _ = _prose(blocks)
    if path and path in prose and prose[path] >= FAIR_SHARE * prose.get(best, 0):
        best = path
    return "\n".join(b.text for b in blocks if not best or best in b.paths)


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path of each page that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [own_path(parse(x.as_py() or "")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["host", "path"])

    seen = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    return seen.mapInArrow(run, "host string, path string").where("path <> ''")


def winners(voted: DataFrame) -> DataFrame:
    """host, path with most votes; one row per host."""
    counts = voted.groupBy("host", "path").agg(F.count("*").alias("pages"))
    depth = F.size(F.split("path", ">"))
    # the smallest of (fewest, ...) reversed in sign: most pages, then deepest, then first by code point
    order = F.struct((-F.col("pages")).alias("a"), (-depth).alias("b"), F.col("path").alias("path"))
    return counts.groupBy("host").agg(F.min(order).alias("best")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, host, path (the winner of the host, or null) and the main text."""
    best = stored(winners(votes(pages, url, html)), "paths").select(F.col("host").alias("of"), "path")
    kind = pages.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, path = batch.column(4), batch.column(3)
            texts = [text_at(parse(s.as_py() or ""), p.as_py()) for s, p in zip(source, path)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(texts, pa.string())], ["key", "url", "host", "path", "text"]
            )

    seen = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html")
    )
    joined = seen.join(best, F.col("host") == F.col("of"), "left").select("key", "url", "host", "path", "html")
    return joined.mapInArrow(run, f"key {kind}, url string, host string, path string, text string").withColumnRenamed(
        "key", key
    )
