"""Main text of web pages by consensus paths of their hosts.

1. Each page is parsed tolerantly and its containers are scored: a block of text counts in full for the container
   it stands in and for all around it, less the text in links; a block that is mostly links counts nothing.
2. A page votes for each container that holds all it counted, by its generalised path: the tags and classes from the
   root down, digits made equal. Votes are summed per (host, path) and over all hosts; a host's winner is the longest
   path with at least MAJORITY of its votes plus as large a share of the general vote, so a path holds everything on
   nearly all pages of its host. Ties go to the alphabetically first path.
3. Each page is parsed again and the blocks below its host's path are its text. A page of which that path holds less
   than WHOLE falls back to its own smallest container that holds everything.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out by tag, role or
the words of a class or id, however much of the page they are; a header or footer element inside an article is one of
them. A word says nothing behind has, with, no and the like, before open, layout and the like (these tell a state of the
page), and header says nothing behind what it is the head of (entry-header). html, body, main, article and headings are
never left out by class or id. Only where they would leave a page no text at all are classes and ids not looked at. Only (host, path, votes) is shuffled for the vote, pre-aggregated. The winners that differ from the
general winner are broadcast if they are at most MAX_BROADCAST_ROWS rows; else the pages are joined by shuffle.
A null html or url counts as empty. Repeated pages are extracted row by row. An empty table gives no rows. Columns
named text or n_chars are replaced, others of any name are kept. Pages of any length and nesting are read whole in time
linear in their length; a container more than MAX_DEPTH deep counts as part of the one around it, and a step of a path
longer than MAX_STEP characters goes by its hash.
"""

from __future__ import annotations

import html as html_lib
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import fresh

MAX_BROADCAST_ROWS = 100_000
GENERAL_SHARE = 1.0
#: Share of a host's votes that its path needs.
MAJORITY = 0.8
#: Share of a page's counted text that its host's path must hold.
WHOLE = 0.9
MAX_DEPTH, MAX_STEP = 256, 200
#: How often a page is read at most to settle which embedded elements without a closing tag hide something.
READINGS = 6

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
#: The rest of a tag: a quote opens a value only after "="; one that is never closed is an ordinary character.
_TAG_END = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title".split())
#: Skipped up to their closing tag or that of the element around them; see _parse for those left open.
_EMBEDDED = frozenset("noscript template svg math iframe object select datalist option optgroup".split())
_SKIPPED = frozenset("nav header footer aside form button dialog menu head".split()) | _RAW | _EMBEDDED
_OPTIONS = frozenset({"option", "optgroup"})
_FRAME = frozenset(["", *"html body main article".split()])
#: Tags that an embedded element without a closing tag can't hold.
_HIDDEN_BY_NONE = frozenset("main article section div table h1 h2 h3".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_BLOCK_BREAK = frozenset({"br", "hr"})
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split())
_CONTAINERS = frozenset("article main section div td body html center".split())
_UNWANTED_WORD = re.compile(r"ads?|advert\w*|adsense|banners?|promo\w*|sponsor\w*|cookies?|consent|gdpr|newsletters?|subscri\w*|share|sharing|social|sidebars?|widgets?|related|recommend\w*|comments?|commentlist|disqus|replies|respond|footer|header|nav|navs|navbar|navi|navigation|menus?|menubar|breadcrumbs?|popups?|modal|notices?|alerts?|masthead|toolbar")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Words of a class behind which, or before which, an unwanted word tells a state of the page; and what a header is the head of.
_STATE_BEFORE = frozenset("has with without no not is".split())
_STATE_BEHIND = frozenset("open closed enabled disabled layout template".split())
_HEAD_OF = frozenset("entry post article story section content chapter".split())
#: Never left out for their class or id.
_KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
_UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_DIGITS = re.compile(r"\d+")


class _Element:
    __slots__ = ("at", "depth", "path", "skipped", "tag", "unwanted", "whole")

    def __init__(self, tag: str, path: str, depth: int, skipped: bool, unwanted: bool, at: int):
        self.tag, self.path, self.depth, self.skipped, self.unwanted, self.at, self.whole = tag, path, depth, skipped, unwanted, at, True


@lru_cache(maxsize=10_000)
def _names_unwanted(name: str) -> bool:
    """Whether a class or id has a word of what is left out."""
    words = [w.lower() for w in _NAME_WORD.findall(name)]
    for i, word in enumerate(words):
        if _UNWANTED_WORD.fullmatch(word) and not _STATE_BEFORE.intersection(words[:i]) and not _STATE_BEHIND.intersection(words[i + 1 : i + 2]):
            if word != "header" or not _HEAD_OF.intersection(words[:i]):
                return True
    return False


def blocks(page: str | None) -> list[tuple[str, str, int]]:
    """(container path, text, characters in links) of the page's wanted blocks, in page order.

    Classes and ids are not looked at where they would leave no text at all.
    """
    page, left_open = page or "", frozenset()
    for _ in range(READINGS):
        parts, more = _parse(page, True, left_open)
        if not more:
            break
        left_open |= more
    return parts or _parse(page, False, left_open)[0]


def _parse(page: str, by_class: bool, left_open: frozenset[int]) -> tuple[list[tuple[str, str, int]], frozenset[int]]:
    """The blocks, and the places of embedded elements without a closing tag that would hide containers, headings or
    the rest of the page's frame; the tags at left_open are not looked at."""
    more: set[int] = set()
    out: list[tuple[str, str, int]] = []
    text: list[str] = []
    linked = 0
    stack = [_Element("", "", 0, False, False, 0)]
    container, links = "", 0
    places: dict[str, list[int]] = {}  # tag -> its places in the stack
    boxes: list[int] = []  # places of containers
    unbroken: list[_Element] = []  # open embedded elements that are whole so far

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((container, joined, linked))
        text, linked = [], 0

    def pop_to(depth: int, closed: int = 0) -> None:
        nonlocal container, links
        above = stack[depth - 1].tag
        for place in range(depth, len(stack)):
            gone = stack[place]
            if gone.tag in _EMBEDDED and place != closed and (not gone.whole or above in _FRAME and gone.tag not in _OPTIONS):
                more.add(gone.at)  # and what it held counts as held by the element around it
            else:
                above = gone.tag
        while len(stack) > depth:
            gone = stack.pop()
            places[gone.tag].pop()
            if gone.tag in _CONTAINERS:
                boxes.pop()
            if gone.tag not in _INLINE:
                flush()
            if gone.tag == "a":
                links -= 1
        container = stack[-1].path

    at = 0
    match = _TOKEN.search(page)
    while match or at < len(page):
        start = match.start() if match else len(page)
        if start > at and not (stack[-1].skipped or stack[-1].unwanted):
            piece = html_lib.unescape(page[at:start])
            text.append(piece)
            if links > 0:
                linked += len(piece)
        if not match:
            break
        at, attributes = match.end(), ""
        tag = (match[2] or "").lower()
        if tag:
            rest = _TAG_END.match(page, at)
            if not rest:  # no ">" any more
                match, at = None, start
                stack[-1].skipped or stack[-1].unwanted or text.append(html_lib.unescape(page[at:]))
                break
            at, attributes = rest.end(), rest[1]
        if tag and match[1]:
            if places.get(tag):
                pop_to(places[tag][-1], places[tag][-1])
        elif tag in _BLOCK_BREAK:
            if not (stack[-1].skipped or stack[-1].unwanted):
                text.append(" ")
        elif tag and tag not in _VOID:
            if tag in _RAW and not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else len(page)
            elif start not in left_open and not (tag in _EMBEDDED and attributes.rstrip().endswith("/")):
                if tag in _CLOSES_P:
                    if places.get("p") and places["p"][-1] > (boxes[-1] if boxes else 0):
                        pop_to(places["p"][-1])
                if tag in _OPTIONS and stack[-1].tag == "option":
                    pop_to(len(stack) - 1, len(stack) - 1)
                if tag not in _INLINE:
                    flush()
                if tag in _HIDDEN_BY_NONE and stack[-1].skipped:
                    for element in unbroken:
                        element.whole = False
                    unbroken.clear()
                above = stack[-1]
                named = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
                classes = named.get("class", "")
                skipped = above.skipped or tag in _SKIPPED or named.get("role", "").lower() in _UNWANTED_ROLES
                unwanted = above.unwanted or by_class and bool(named) and tag not in _KEPT and any(map(_names_unwanted, (*classes.split(), *named.get("id", "").split())))
                path, depth = above.path, above.depth
                if tag in _CONTAINERS:
                    boxes.append(len(stack))
                    if depth < MAX_DEPTH:
                        step = ".".join([tag, *sorted({_DIGITS.sub("0", c.lower().replace("/", "|")) for c in classes.split()})])
                        path, depth = f"{path}/{step if len(step) <= MAX_STEP else f'{tag}.{xxhash.xxh3_128_hexdigest(step)}'}", depth + 1
                places.setdefault(tag, []).append(len(stack))
                stack.append(_Element(tag, path, depth, skipped, unwanted, start))
                if tag in _EMBEDDED:
                    unbroken.append(stack[-1])
                if tag == "a":
                    links += 1
                container = path
        match = _TOKEN.search(page, at)
    pop_to(1)
    flush()
    return out, frozenset(more)


def _above(path: str):
    """The path and all around it, up to the root (empty)."""
    while path:
        yield path
        path = path.rpartition("/")[0]
    yield ""


def _weights(parts: list[tuple[str, str, int]]) -> list[int]:
    """What each block counts: its text less that in links; on a page of links only, its text."""
    weights = [max(0, len(text) - 2 * linked) for _, text, linked in parts]
    return weights if any(weights) else [len(text) for _, text, _ in parts]


def _shares(parts: list[tuple[str, str, int]]) -> dict[str, float]:
    scores: dict[str, int] = {}
    for (path, _, _), weight in zip(parts, _weights(parts)):
        for above in _above(path) if weight else ():
            scores[above] = scores.get(above, 0) + weight
    return {path: score / scores[""] for path, score in scores.items()}


def containers(page: str | None) -> dict[str, float]:
    """path -> share of the page's counted text that stands in it or below."""
    return _shares(blocks(page))


def extract(page: str | None, path: str | None) -> str:
    """The text below the container path; below the page's own whole container if it hasn't nearly all in there."""
    parts = blocks(page)
    if not parts:
        return ""
    own = _shares(parts)
    if path is None or own.get(path, 0.0) < WHOLE:
        path = max((p for p, share in own.items() if share == 1), key=len)
    return " ".join(text for p, text, _ in parts if p == path or p.startswith(path + "/"))


def host_of(url: Column) -> Column:
    """Host name in lower case; empty for null or without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, vote): on how many of the host's pages the path holds everything."""

    @F.arrow_udf("array<string>")
    def whole(column: pa.Array) -> pa.Array:
        return pa.array([[p for p, share in containers(t.as_py()).items() if share == 1] for t in column], pa.list_(pa.string()))

    scored = pages.select(host_of(F.col(url)).alias("host"), F.explode(whole.asNondeterministic()(html)).alias("path"))
    return scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("vote"))


def winners(voted: DataFrame) -> tuple[str | None, DataFrame]:
    """The general winner, and (host, path) of the hosts whose winner is another."""
    general = voted.groupBy("path").agg(F.sum("vote").alias("all_votes"))
    total = general.agg(F.max("all_votes")).first()[0]  # the root's: all pages with text
    if not total:
        return None, voted.select("host", "path").limit(0)
    top = general.where(F.col("all_votes") >= MAJORITY * total).orderBy(F.desc(F.length("path")), "path").first()["path"]
    weighed = voted.join(general, "path").withColumn("weight", F.col("vote") + F.lit(GENERAL_SHARE) * F.col("all_votes") / F.lit(float(total)))
    most = weighed.withColumn("most", F.max("weight").over(Window.partitionBy("host"))).where(F.col("weight") >= MAJORITY * F.col("most"))
    longest = Window.partitionBy("host").orderBy(F.desc(F.length("path")), "path")
    own = most.withColumn("n", F.row_number().over(longest)).where((F.col("n") == 1) & (F.col("path") != F.lit(top)))
    return top, own.select("host", "path")


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """pages plus text and n_chars; columns of these names are replaced."""
    from ..session import stored

    voted = stored(votes(pages, url, html), "path-votes")
    top, own = winners(voted)

    @F.arrow_udf("string")
    def text(column: pa.Array, path: pa.Array) -> pa.Array:
        return pa.array([extract(t.as_py(), p.as_py()) for t, p in zip(column, path)], pa.string())

    held = [c for c in pages.columns if c not in ("text", "n_chars")]
    host, path, out = (fresh(c, pages) for c in ("host_key", "path_key", "main_text"))
    own = stored(own.select(F.col("host").alias(host), F.col("path").alias(path)), "host-paths")
    small = own.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    joined = pages.withColumn(host, host_of(F.col(url))).join(F.broadcast(own) if small else own, host, "left")
    found = joined.select(*held, text.asNondeterministic()(html, F.coalesce(path, F.lit(top).cast("string"))).alias(out))
    return found.select(*held, F.col(out).alias("text"), F.length(out).cast("long").alias("n_chars"))
