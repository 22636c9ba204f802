"""Main text of html pages by the template that a host's pages share.

The tokens of a page are its elements (start and end, told apart by the path to them) and its texts.
Tokens of a host with the same occurrence vector (as often on every page) are an equivalence class. Classes
on at least half of the pages and of two tokens and more are laid out on every page: tokens out of the
order of their class leave it, and of two classes that cross each other the smaller goes. What is left
is the template, with the slots between its tokens, which hold classes nested in it or a page's own text.

Of the template's elements, an article or main element or else the deepest one with 70 % of the text in
slots holds the article. Left out there are slots of links, the template's texts beyond an element that is
set apart, and what is set apart: menus, notices, adverts and the like, as tag, role and words in class or id
tell, since a slot alone does not say whether a page's own text is an advert.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.llm.url_filter import parts
from corpuslake.llm.workspace import Workspace

# html's elements by what they do to text.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "canvas", "object", "textarea", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split())
CLOSES = {  # a start tag ends open elements of these kinds
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
OPEN_TO = frozenset("ul ol dl table tbody thead article section div main body form nav aside footer header td th blockquote".split())
ASIDE = frozenset("nav footer aside form head button select option input fieldset menu dialog label iframe".split())
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert\w*|banner\w*|breadcrumb\w*|comment\w*|consent\w*|cookie\w*|disqus|footer\w*|"
    r"form|gdpr|hidden|login|masthead|menu\w*|modal\w*|nav\w*|newsletter\w*|notice\w*|alert\w*|pagination|pager|"
    r"popup\w*|promo\w*|related\w*|recommend\w*|respond|repl(?:y|ies)|share\w*|sharing|sidebar\w*|skip\w*|social\w*|"
    r"sponsor\w*|subscribe\w*|toolbar|widget\w*|header|topbar|reviews?)(?=$|[-_\s])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)"
    r"|<[!?/][^>]*(?:>|$)|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DIGITS = re.compile(r"\d+")

COMMON = 0.5  # share of a host's pages that template tokens are on
FIXED = 0.9  # a text is repeated if it is on such a share of a host's pages; a class is in order on as many of its own
SIZE = 2  # tokens of a class: two of an element, one for each word of a text
LINKED = 0.9  # a slot of links has such a share of its text in them
BROADCAST_HOSTS = 50_000  # templates that are broadcast up to so many, beyond it shuffled
BROADCAST_CLASSES = 5_000  # the same for layouts, which are larger
START, END, TEXT = 0, 1, 2
MOVED, CROSSED, SLOT = 0, 1, 2


class Text:
    """A block of text: path of the elements around it, the innermost one's place, whether it is set
    apart (menus, adverts and the like), its words, and how many of them are links."""

    __slots__ = ("path", "node", "apart", "pieces", "linked", "text")

    def __init__(self, path: tuple[str, ...], node: int):
        self.path, self.node, self.apart, self.pieces, self.linked, self.text = path, node, False, [], 0, ""


@lru_cache(maxsize=1 << 14)
def step(tag: str, attrs: str) -> tuple[str, int]:
    """Name of an element in a path, and whether it sets its content apart: 2 by its kind or as
    hidden, 1 by its class, its id or as a form, which holds only if most of the page's text is
    elsewhere. The page itself is never set apart, and main and article not by class or id."""
    apart = 0 if tag not in ASIDE else 1 if tag == "form" else 2
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return tag, apart
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    name = tag
    for key, sign in (("class", "."), ("id", "#")):
        if found.get(key):
            name += sign + _DIGITS.sub("", "-".join(found[key].split()).lower())
            if not apart and tag not in ("main", "article") and NAMES.search(found[key]):
                apart = 1
    style = found.get("style", "").replace(" ", "").lower()
    if found.get("role", "").lower() in ROLES or "display:none" in style \
            or "hidden" in found or found.get("aria-hidden") == "true":
        apart = 2
    return name, 0 if tag in ("html", "body") else apart


def set_apart(blocks: list[Text], nodes: list[tuple[int, int, bool]]) -> None:
    """Mark the blocks below elements that are set apart; ``nodes`` are (parent, how, whether in an
    article). An element with most of the text that is in no link, and with all there is in article
    and main elements, is not set apart by a name."""
    hard = [False] * len(nodes)
    for i, (parent, how, _) in enumerate(nodes):
        hard[i] = how == 2 or parent >= 0 and hard[parent]
    chars, within = [0] * len(nodes), [0] * len(nodes)
    total = articles = 0
    for b in blocks:
        if b.node >= 0 and hard[b.node]:
            continue
        n = max(len(b.text) - b.linked, 0)
        total += n
        if b.node >= 0:
            chars[b.node] += n
            if nodes[b.node][2]:
                within[b.node] += n
                articles += n
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i][0] >= 0:
            chars[nodes[i][0]] += chars[i]
            within[nodes[i][0]] += within[i]
    apart = hard
    for i, (parent, how, _) in enumerate(nodes):
        soft = how == 1 and not (2 * chars[i] > total and within[i] == articles)
        apart[i] = apart[i] or soft or parent >= 0 and apart[parent]
    for b in blocks:
        b.apart = b.node >= 0 and apart[b.node]


def read_blocks(html: str | None) -> list[Text]:
    """Blocks of a page in order."""
    return read_page(html)[0]


def read_page(html: str | None) -> tuple[list[Text], list[tuple[int, str, Text | None]]]:
    """Blocks of a page, and its marks (starts and ends of elements, texts; each with its path), in order.
    Block elements and their ends end a block; inline elements do
    not, and a line break is white space. Comments, scripts and the like are skipped; an element
    left open ends with its parent."""
    out: list[Text] = []
    stack: list[tuple[str, str, int]] = []  # block elements: tag, step, place in nodes
    nodes: list[tuple[int, int, bool]] = []
    paths: list[str] = []
    marks: list[tuple[int, str, Text | None]] = []

    def close(depth: int) -> None:
        marks.extend((END, paths[node], None) for _, _, node in reversed(stack[depth:]))
        del stack[depth:]

    block: Text | None = None
    links = 0
    for m in _TOKEN.finditer(html or ""):
        text, tag = m["text"], m["tag"]
        if text is not None:
            if block is None:
                if text.isspace():
                    continue
                block = Text(tuple(s[1] for s in stack), stack[-1][2] if stack else -1)
                out.append(block)
                marks.append((TEXT, paths[block.node] if block.node >= 0 else "", block))
            block.pieces.append(text)
            if links:
                block.linked += len(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            if block is not None:
                block.pieces.append(" ")
        elif tag in INLINE:
            if tag == "a":
                links = 0 if m["end"] else 1
        elif tag in VOID:
            if tag == "hr":
                block = None
        elif m["end"]:
            block, links = None, 0
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                close(depth)
        else:
            block, links = None, 0
            while stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                close(len(stack) - 1)  # these hold no blocks
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES.get(tag, ()):
                    close(i)
                    break
                if stack[i][0] in OPEN_TO:
                    break
            name, apart = step(tag, m["attrs"])
            parent = stack[-1][2] if stack else -1
            inside = parent >= 0 and nodes[parent][2]
            if tag == "header" and not inside:
                apart = 2
            nodes.append((parent, apart, inside or tag in ("article", "main")))
            stack.append((tag, name, len(nodes) - 1))
            paths.append(f"{paths[parent]}/{name}" if parent >= 0 else name)
            marks.append((START, paths[-1], None))
    close(0)
    for b in out:
        b.text = " ".join(unescape("".join(b.pieces)).split())
    out = [b for b in out if b.text]
    set_apart(out, nodes)
    return out, [m for m in marks if m[0] != TEXT or m[2].text]


def containers(blocks: list[Text]) -> dict[tuple[str, ...], tuple[int, int]]:
    """Characters below each path that are not set apart: all, and those in links."""
    sums: dict[tuple[str, ...], list[int]] = {}
    for b in blocks:
        if b.apart:
            continue
        n = len(b.text)
        path = b.path
        while path and path[-1].split(".")[0].split("#")[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td"):
            path = path[:-1]
        for k in range(len(path) + 1):
            own = sums.setdefault(path[:k], [0, 0])
            own[0] += n
            own[1] += min(b.linked, n)
    return {p: (a, c) for p, (a, c) in sums.items()}


def weigh(path: tuple[str, ...], chars: float, linked: float, root: float) -> tuple | None:
    """How well a container fits as the article; None if it does not. An article or main element
    goes before all others; else the deepest element with most of the text."""
    if not path or chars <= 0:
        return None
    if path[-1].split(".")[0].split("#")[0] in ("article", "main") and chars >= 0.25 * root:
        return 2, chars - linked, len(path), "/".join(path)
    if chars >= 0.7 * root:
        return 1, float(len(path)), len(path), "/".join(path)
    return None


def choose(sums: dict[tuple[str, ...], tuple[float, float]]) -> tuple[str, ...]:
    root = max((c for c, _ in sums.values()), default=0)
    options = [w for p, (c, k) in sums.items() if (w := weigh(p, c, k, root))]
    return tuple(max(options)[-1].split("/")) if options else ()


def token_of(path: str, text: str) -> int:
    """Token of a text at a path (an element for an empty one), as a signed 64-bit number."""
    raw = blake2b((path + "\0" + text).encode("utf-8", "replace"), digest_size=8).digest()
    return int.from_bytes(raw, "little", signed=True)


@lru_cache(maxsize=1 << 14)
def element_token(path: str) -> int:
    return token_of(path, "")


def occurrences(marks: list[tuple[int, str, Text | None]]) -> dict[int, tuple[str | None, list[int], list[int], int]]:
    """Tokens of a page: path (null for a text), places of their starts and of their ends, size."""
    found: dict[int, tuple[str | None, list[int], list[int], int]] = {}
    elements: dict[str, int] = {}
    for place, (kind, path, block) in enumerate(marks):
        if kind == TEXT:
            token = token_of(path, block.text)
            own = found.setdefault(token, (None, [], [], block.text.count(" ") + 1))
        else:
            token = elements.get(path)
            if token is None:
                token = elements[path] = element_token(path)
            own = found.setdefault(token, (path, [], [], 2))
        own[1 if kind != END else 2].append(place)
    return found


def tokens(pages: DataFrame) -> DataFrame:
    """host, page, token, path (null for a text), n (occurrences on the page), places of the first start and end,
    size, chars, linked. The page as a whole is the element without a path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, page, html in zip(*(batch[c].to_pylist() for c in ("host", "page", "html"))):
                blocks, marks = read_page(html)
                below = {"/".join(path): sums for path, sums in containers(blocks).items()}
                rows.append((host, page, token_of("", ""), "", 1, -1, len(marks), 2, *below.get("", (0, 0))))
                for token, (path, starts, ends, size) in occurrences(marks).items():
                    rows.append((host, page, token, path, len(starts), starts[0], ends[0] if ends else starts[0], size,
                                 *below.get(path, (0, 0))))
            columns = list(zip(*rows)) or [[]] * 10
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(),
                     pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["host", "page", "token", "path", "n", "start", "end", "size", "chars", "linked"])

    return pages.select("host", "page", "html").mapInArrow(
        run, "host string, page long, token long, path string, n int, start long, end long, size int, chars long, linked long")


def classes(pages: DataFrame) -> DataFrame:
    """One row per host of two pages and more: host, pages, classes (df, members). A class holds the tokens with one occurrence vector; vectors are
    compared by the sums of two hashes of (page, occurrences), so that a host's pages are never gathered."""
    rows = tokens(pages)
    part = lambda *names: F.sum(F.xxhash64(*names).bitwiseAND(0x7FFFFFFF))
    found = rows.groupBy("host", "token").agg(
        F.count("*").alias("df"), part("page", "n").alias("v1"), part("n", "page").alias("v2"),
        F.max("path").alias("path"), F.sum("start").alias("start"), F.sum("end").alias("end"), F.max("size").alias("size"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    found = found.join(sizes.where("pages > 1"), "host").where(F.col("df") >= COMMON * F.col("pages"))
    # At most 1 / COMMON times the tokens of an average page are left of a host.
    member = F.struct("token", "path", "start", "end", "size", "chars", "linked")
    grouped = found.groupBy("host", "pages", "df", "v1", "v2").agg(
        F.collect_list(member).alias("members"), F.sum("size").alias("size")).where(F.col("size") >= SIZE)
    return grouped.groupBy("host", "pages").agg(F.collect_list(F.struct("df", "members")).alias("classes"))


def rising(keys: list) -> list[int]:
    """Places of a longest strictly rising part of a list."""
    tails, ends, back = [], [], []
    for i, key in enumerate(keys):
        at = bisect_left(tails, key)
        tails[at:at + 1] = [key]
        ends[at:at + 1] = [i]
        back.append(ends[at - 1] if at else -1)
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def class_order(members: list[dict]) -> dict[tuple[int, int], int]:
    """Rank of each start, end and text of a class by its mean place; the pages of its tokens are the same."""
    places = []
    for m in members:
        places.append((m["start"], m["token"], START))
        if m["path"] is not None:
            places.append((m["end"], m["token"], END))
    return {(token, kind): rank for rank, (_, token, kind) in enumerate(sorted(places))}


def lay_out(found: dict, ordered: list[dict[tuple[int, int], int]]) -> tuple[set[int], set[tuple[int, int]]]:
    """A page seen by a host's classes: tokens out of order, and pairs of classes that cross.

    A class that occurs n times is in order if its tokens come in turn, n times over. An instance is
    nested if no token of a class around it comes before its own last one."""
    moved: set[int] = set()
    places: list[tuple[int, int, int, bool]] = []  # place, class, instance, whether it is the instance's last
    for c, ranks in enumerate(ordered):
        seen = []
        for (token, kind), rank in ranks.items():
            if token in found:
                seen += [(place, k, rank, token) for k, place in enumerate(found[token][1 if kind == START else 2])]
        seen.sort()
        kept = [seen[i] for i in rising([(k, rank) for _, k, rank, _ in seen])]
        if len(kept) < len(seen):
            good = {s[0] for s in kept}
            gone = {token for place, _, _, token in seen if place not in good}
            moved |= gone
            kept = [s for s in kept if s[3] not in gone]
        places += [(place, c, k, i + 1 == len(kept) or kept[i + 1][1] != k) for i, (place, k, _, _) in enumerate(kept)]
    crossed: set[tuple[int, int]] = set()
    stack: list[tuple[int, int]] = []
    for _, c, k, last in sorted(places):
        if (c, k) not in stack:
            stack.append((c, k))
        elif stack[-1] != (c, k):
            crossed |= {(min(c, d), max(c, d)) for d, _ in stack[stack.index((c, k)) + 1:]}
        if last:
            stack.remove((c, k))
    return moved, crossed


def layouts(known: DataFrame) -> DataFrame:
    """host, layout: order of the classes, repeated texts and elements of a host, as JSON that its pages are read with."""
    def layout(n_pages: int, groups: list[dict]) -> str:
        members = [(g, m) for g in groups for m in g["members"]]
        return json.dumps([
            [list(class_order(g["members"])) for g in groups],
            [m["token"] for g, m in members if m["path"] is None and g["df"] >= FIXED * n_pages],
            {m["path"]: m["token"] for _, m in members if m["path"] is not None}])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [layout(n, g) for n, g in zip(batch["pages"].to_pylist(), batch["classes"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(out, pa.string())], ["host", "layout"])

    return known.select("host", "pages", "classes").mapInArrow(run, "host string, layout string")


@lru_cache(maxsize=64)
def read_layout(layout: str) -> tuple[list[dict[tuple[int, int], int]], frozenset[int], dict[str, int]]:
    ordered, fixed, elements = json.loads(layout)
    return [{(token, kind): rank for rank, (token, kind) in enumerate(c)} for c in ordered], frozenset(fixed), elements


def facts(pages: DataFrame, known: DataFrame) -> DataFrame:
    """host, facts: what pages tell of the classes of their host, each with its number of pages. That tokens are out of
    order, that classes cross, and how much text of the pages' own is in slots below an element."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, html, layout in zip(*(batch[c].to_pylist() for c in ("host", "html", "layout"))):
                ordered, fixed, elements = read_layout(layout)
                blocks, marks = read_page(html)
                found = occurrences(marks)
                found[token_of("", "")] = ("", [-1], [len(marks)], 2)
                moved, crossed = lay_out(found, ordered)
                rows += [(host, MOVED, token, 0, 0, 0) for token in moved]
                rows += [(host, CROSSED, a, b, 0, 0) for a, b in crossed]
                own = [b for b in blocks if token_of("/".join(b.path), b.text) not in fixed] if fixed else blocks
                for path, (chars, linked) in containers(own).items():
                    token = elements.get("/".join(path))
                    if token is not None:
                        rows.append((host, SLOT, token, 0, chars, linked))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.string()] + [pa.int64()] * 5)],
                ["host", "kind", "a", "b", "chars", "linked"])

    told = pages.select("host", "html").join(known, "host").select("host", "html", "layout").mapInArrow(
        run, "host string, kind long, a long, b long, chars long, linked long")
    summed = told.groupBy("host", "kind", "a", "b").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    return summed.groupBy("host").agg(F.collect_list(F.struct("kind", "a", "b", "n", "chars", "linked")).alias("facts"))


def induce(n_pages: int, groups: list[dict], told: list[dict]) -> tuple[str | None, list[int], list[str]]:
    """Container, fixed texts and slots of links of a host, from its classes and what its pages tell of them."""
    by = {kind: [t for t in told if t["kind"] == kind] for kind in (MOVED, CROSSED, SLOT)}
    moved = {t["a"]: t["n"] for t in by[MOVED]}
    crossed = {(t["a"], t["b"]): t["n"] for t in by[CROSSED]}
    valid: dict[int, list[dict]] = {}
    for c, g in enumerate(groups):
        members = [m for m in g["members"] if moved.get(m["token"], 0) <= (1 - FIXED) * g["df"]]
        if sum(m["size"] for m in members) >= SIZE:
            valid[c] = members
    kept: list[int] = []
    for c in sorted(valid, key=lambda c: (-groups[c]["df"], -sum(m["size"] for m in valid[c]), c)):
        share = lambda d: crossed.get((min(c, d), max(c, d)), 0) / min(groups[c]["df"], groups[d]["df"])
        if not any(share(d) > 1 - FIXED for d in kept):
            kept.append(c)
    elements = [m for c in kept for m in valid[c] if m["path"] is not None]
    fixed = [m["token"] for c in kept for m in valid[c]
             if m["path"] is None and groups[c]["df"] >= FIXED * n_pages]
    slots = {t["a"]: (t["chars"], t["linked"]) for t in by[SLOT]}
    whole = max((m["chars"] for m in elements), default=0)
    own = max((slots.get(m["token"], (0, 0))[0] for m in elements), default=0)
    # Where most of the text is repeated, as in copies of an article, the slots do not tell where it is.
    sums = {tuple(m["path"].split("/")) if m["path"] else ():
            slots.get(m["token"], (0, 0)) if 2 * own > whole else (m["chars"], m["linked"]) for m in elements}
    path = choose(sums)
    links = [
        "/".join(p) for p, (chars, linked) in sums.items()
        if path and len(p) > len(path) and p[: len(path)] == path and chars and linked >= LINKED * chars]
    return "/".join(path) or None, fixed, links


def templates(pages: DataFrame, work: Workspace) -> DataFrame:
    """One row per host of two pages and more (one page cannot tell): host, container (path of the article), fixed
    (tokens of repeated texts), links (paths of slots of links in the container)."""
    known = work.keep(classes(pages), "classes")
    laid = work.keep(layouts(known), "layouts")
    told = work.keep(facts(pages, F.broadcast(laid) if laid.count() <= BROADCAST_CLASSES else laid), "facts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = [induce(n, g, t or []) for n, g, t in zip(*(batch[c].to_pylist() for c in ("pages", "classes", "facts")))]
            yield pa.RecordBatch.from_arrays(
                [batch["host"], pa.array([h[0] for h in hosts], pa.string()),
                 pa.array([h[1] for h in hosts], pa.list_(pa.int64())), pa.array([h[2] for h in hosts], pa.list_(pa.string()))],
                ["host", "container", "fixed", "links"])

    return known.join(told, "host", "left").select("host", "pages", "classes", "facts").mapInArrow(
        run, "host string, container string, fixed array<long>, links array<string>")


def inside(own: list[Text], fixed: frozenset[int]) -> list[Text]:
    """Blocks of an article without the template around it. Repeated texts go only beyond an element
    that is set apart, as seen from the page's first and last text of its own; where most of the
    text is repeated, as in copies of an article, none goes."""
    at = [i for i, b in enumerate(own) if not b.apart]
    told = [i for i in at if token_of("/".join(own[i].path), own[i].text) not in fixed] if fixed else at
    unique = sum(len(own[i].text) for i in told)
    if len(told) < len(at) and 2 * unique > sum(len(own[i].text) for i in at):
        walls = [i for i, b in enumerate(own) if b.apart]
        low = max((i for i in walls if i < told[0]), default=-1)
        high = min((i for i in walls if i > told[-1]), default=len(own))
        at = [i for i in at if low < i < high]
    return [own[i] for i in at]


def main_text(html: str | None, container: str | None, fixed: frozenset[int], links: list[str] = ()) -> str:
    """Blocks below the host's container (or the page's own, if there is no such element) that are
    neither set apart nor of the template around the article, nor in a slot of links (unless most is)."""
    blocks = read_blocks(html)
    path = tuple(container.split("/")) if container else ()
    if not path or not any(not b.apart and b.path[: len(path)] == path for b in blocks):
        path = choose(containers(blocks))
    own = inside([b for b in blocks if b.path[: len(path)] == path], fixed)
    slots = [tuple(p.split("/")) for p in links]
    rest = [b for b in own if not any(b.path[: len(p)] == p for p in slots)]
    if 2 * sum(len(b.text) for b in rest) > sum(len(b.text) for b in own):
        own = rest
    return " ".join(b.text for b in own)


def extract(pages: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty page, and one without an article, has an empty text. Pages without a host (null
    url, no ``://``) share a template of their own. Repeated rows are extracted one by one; null
    ids are kept; other columns are dropped.
    """
    work = work or Workspace(pages.sparkSession, "html")
    host, _ = parts(F.col("url"))
    pages = pages.select("page_id", "url", "html", host.alias("host"),
                         F.xxhash64("page_id", "url", F.length("html")).alias("page"))
    known = work.keep(templates(pages, work), "templates")
    near = F.broadcast(known) if known.count() <= BROADCAST_HOSTS else known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, c, frozenset(f or ()), s or ()) for h, c, f, s in zip(
                *(batch[c].to_pylist() for c in ("html", "container", "fixed", "links")))]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.join(near, "host", "left").select("page_id", "url", "html", "container", "fixed", "links").mapInArrow(
        run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


@query("op7_html_extraction")
def op7_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
