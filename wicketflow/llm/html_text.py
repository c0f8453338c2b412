"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its elements by their path (tags and classes from the body down), and its blocks of text
by path and content. Over the pages of a host, Spark counts each token's occurrence vector (its count in each page) as a
sum of hashes, so that tokens with equal vectors form a class without any vector being gathered. Classes with enough
tokens (or in all pages) and enough support are the candidates of the host's template; a token is valid if the element
around it is itself in the template, and so classes nest. What the template leaves open are its slots: all text that is
not itself part of the template.

The article is the text of the slots in the host's main element: from the root down, the one element a page that holds more
than half of the open, unlinked text of the element around it, as long as no open top heading is left out. All else goes,
by structure alone: menus, headers, footers and adverts lie outside it, however they are called. Within it, elements go
that by their meaning hold notices, adverts, forms, comments, scripts or styles.

Pages of a host that share the longest blocks, three quarters of their text, count once, so that copies of an article in
other surroundings don't make it template. Hosts with fewer than SUPPORT_PAGES different pages, and pages without their host's main element, are decided by their own tree:
slots in elements that by their meaning aren't article go; where marked elements (<article>, <main>) hold at least half
of what is left, only they are read. A wrapper that by its meaning isn't article still counts as article if it holds the
marked element with most of the page's text or, where nothing is marked, most of that text itself.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicketflow.llm.common import free_name, python_ready, refuse_taken, small_side, staged

#: Elements that begin and end a block of text; without an end tag; whose content is never text of a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp noembed svg math object canvas audio video".split())
#: Elements and roles that mark what isn't the article.
ASIDE = frozenset("head nav footer aside form label button select menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Words of a class or id that mark what isn't the article where they begin or end it; where they stand with
#: no others than their kind and words of layout; words of layout; words before a name that say it is somewhere else.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr menu menus nav navbar navigation breadcrumb breadcrumbs"
    " sidebar sidebars comments disqus newsletter popup modal overlay masthead topbar toolbar pagination pager".split()
)
WEAK = frozenset(
    "banner notice notices alert alerts side widget widgets comment reply replies respond share sharing social related recommended recommendations subscribe subscription"
    " signup login foot footer skip legal copyright disclaimer announcement".split()
)
LAYOUT = frozenset(
    "a box bar block area container wrap wrapper inner outer section list links link item items button buttons icon icons panel content group row col column left right top bottom"
    " main site page global text post posts story stories article articles more title heading thread first last primary secondary".split()
)
ELSEWHERE = frozenset("has no with without is".split())
#: An element within the first that ends when the second begins, unless an element of the third stands between.
ENDED_BY = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: A class has to stand in this share of a host's different pages, and in so many; one of fewer tokens, in all of them.
SUPPORT, SUPPORT_PAGES, CLASS_TOKENS = 0.5, 3, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>", re.S)
_UNCLOSED = re.compile(r"<!--(?!.*-->).*|<!\[CDATA\[(?!.*\]\]>).*", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART = re.compile(r"[a-z]+")


def _key(kind: str, within: int | str, text: str = "") -> int:
    raw = f"{kind}\0{within}\0{text}".encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


_ROOT = _key("element", "")


@dataclass
class Block:
    """A block's text, the number of its element's path, the letters of it in links, and what is around it."""

    text: str
    path: int
    linked: int
    #: The marked elements around it, and the innermost one that by its meaning isn't article, by number.
    marks: tuple[int, ...]
    aside: int


@dataclass
class Page:
    """A parsed page. Element paths and asides (elements that by their meaning aren't article) have numbers; number 0 is the
    root's path, or no aside, and what is around a path or an aside has a lower number than itself."""

    blocks: list[Block] = field(default_factory=list)
    #: Of each path: the path around it, its last element's tag and class, its key, and how often it occurs.
    up: list[int] = field(default_factory=lambda: [0])
    names: list[str] = field(default_factory=lambda: [""])
    keys: list[int] = field(default_factory=lambda: [_ROOT])
    counts: list[int] = field(default_factory=lambda: [1])
    numbers: dict[tuple[int, str], int] = field(default_factory=dict)
    #: Of each path: the innermost aside around its first element, or that itself; whether it is marked.
    around: list[int] = field(default_factory=lambda: [0])
    marked: list[bool] = field(default_factory=lambda: [False])
    #: Of each marked element: the innermost aside around it. Of each aside: its tag, the aside around it, how many there are.
    mark_aside: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=lambda: [""])
    aside_up: list[int] = field(default_factory=lambda: [0])
    aside_depth: list[int] = field(default_factory=lambda: [0])

    def add(self, e: _Element, up: _Element, name: str) -> None:
        """Gives e, whose tag and class are name, its path."""
        if (k := self.numbers.get((up.path, name))) is None:
            k = self.numbers[up.path, name] = len(self.up)
            self.up.append(up.path)
            self.names.append(name)
            self.keys.append(_key("element", self.keys[up.path], name))
            self.counts.append(0)
            self.around.append(e.aside)
            self.marked.append(not e.off and e.article > up.article)
        self.counts[k] += 1
        e.path = k

    def chain(self, aside: int) -> frozenset[int]:
        """The aside and those around it."""
        out = set()
        while aside:
            out.add(aside)
            aside = self.aside_up[aside]
        return frozenset(out)

    def free(self, held: frozenset[int]) -> list[bool]:
        """Of each aside: whether held has it and all around it."""
        out = [True]
        for k in range(1, len(self.tags)):
            out.append(k in held and out[self.aside_up[k]])
        return out


class _Element:
    """An open element. block: where the innermost element that makes blocks stands in the stack."""

    __slots__ = ("tag", "off", "link", "article", "path", "marks", "aside", "inline", "block")

    def __init__(self, tag: str, off: bool, link: bool, article: int) -> None:
        self.tag, self.off, self.link, self.article = tag, off, link, article
        self.path, self.marks, self.aside, self.inline, self.block = 0, (), 0, False, 0


def _named_aside(name: str) -> bool:
    """Whether one word of a class or id marks what isn't the article."""
    parts = _PART.findall(_CAMEL.sub("-", name).lower())
    if not parts or parts[0] in ELSEWHERE:
        return False
    return parts[0] in STRONG or parts[-1] in STRONG or any(p in WEAK for p in parts) and all(p in WEAK or p in STRONG or p in LAYOUT for p in parts)


def _open(tag: str, attributes: str, up: _Element) -> tuple[_Element, str]:
    """An element, and its tag and class."""
    name, off, article = tag, tag in ASIDE or tag == "header" and not up.article, up.article
    if attributes and not attributes.isspace():
        own = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        role, classes = own.get("role", "").lower(), own.get("class", "").split()
        names = [*classes, *own.get("id", "").split()]
        if classes:
            name = f"{tag}.{classes[0]}"
        if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
            off = True
        if tag not in ("html", "body", "article", "main"):
            off = off or role in ROLES or any(map(_named_aside, names)) or not up.article and tag in ("div", "section") and any("header" in _PART.findall(x.lower()) for x in names)
        elif tag == "article":
            off = off or bool({p for x in names for p in _PART.findall(x.lower())} & {"comment", "comments", "reply", "ad", "advert", "sponsored", "related", "promo"})
        if role == "main":
            article = max(article, 1)
        if "articlebody" in own.get("itemprop", "").lower():
            article = max(article, 2)
    if tag == "article":
        article = 2
    elif tag == "main":
        article = max(article, 1)
    return _Element(tag, off, up.link or tag == "a", article), name


def parse(source: str) -> Page:
    """The blocks of text of a page in order, and its elements. Text of asides within a block is left out of it.

    Time and memory grow with the page's length, however deep its elements are.
    """
    page = Page()
    stack = [_Element("", False, False, 0)]
    opened: dict[str, list[int]] = defaultdict(lambda: [0])  # where the open elements of a tag stand; 0: none
    words: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if words:
            if text := " ".join("".join(words).split()):
                own = stack[stack[-1].block]
                page.blocks.append(Block(text, own.path, min(linked, len(text)), own.marks, own.aside))
            words.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].inline:
            text = html.unescape(raw)
            words.append(text)
            if stack[-1].link:
                linked += len(text.strip())

    def close(at: int) -> None:
        while len(stack) > at:
            opened[stack.pop().tag].pop()

    at, n, lower = 0, len(source), source.lower()
    last = source.rfind(">") + 1
    if len(lower) != n:  # a letter whose lower case is longer
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in source)
    while True:
        m = _TOKEN.search(source, at, last) if at < last else None
        if not m or m.end() == last and _UNCLOSED.match(m[0]):  # after the last > there can be but the rest of an open comment
            rest = _UNCLOSED.search(source, m.start() if m else max(at, last))
            put(source[at : rest.start() if rest else n])
            if rest and rest[0].startswith("<![CDATA["):
                words.append(rest[0][9:])
            break
        put(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                words.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            depth = opened[tag][-1]
            if depth and (tag in BLOCKS or stack[-1].block <= depth):
                if stack[-1].block >= depth:
                    flush()
                close(depth)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = lower.find(f"</{tag}", at)
                at = n if end < 0 else (source.find(">", end) + 1 or n)
            if tag not in ("svg", "math", "canvas"):
                words.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                words.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if opened["p"][-1]:  # a paragraph holds no block
                close(opened["p"][-1])
        if tag in ENDED_BY:
            ends, between = ENDED_BY[tag]
            if (i := max(opened[x][-1] for x in ends)) > max(opened[x][-1] for x in between):
                close(i)
        up = stack[-1]
        e, name = _open(tag, m[3], up)
        e.aside, e.marks = up.aside, up.marks
        if e.off:
            e.aside = len(page.tags)
            page.tags.append(tag)
            page.aside_up.append(up.aside)
            page.aside_depth.append(page.aside_depth[up.aside] + 1)
        elif e.article > up.article:
            e.marks += (len(page.mark_aside),)
            page.mark_aside.append(e.aside)
        e.inline = tag not in BLOCKS and (e.off or up.inline)
        e.block = len(stack) if tag in BLOCKS else up.block
        page.add(e, up, name)
        if not m[3].endswith("/") or tag in BLOCKS:
            opened[tag].append(len(stack))
            stack.append(e)
    flush()
    return page


def _unlinked(blocks: list[Block]) -> int:
    return sum(len(b.text) - b.linked for b in blocks)


def _held(page: Page, slots: list[Block]) -> frozenset[int]:
    """The asides that hold the article, though by their meaning they aren't article."""
    total, free = _unlinked(slots), any(not b.aside for b in slots)
    in_mark, in_aside, count = Counter(), [0] * len(page.tags), [0] * len(page.tags)
    for b in slots:
        for m in b.marks:
            if b.aside == page.mark_aside[m]:
                in_mark[m] += len(b.text) - b.linked
        in_aside[b.aside] += len(b.text) - b.linked
        count[b.aside] += 1
    for k in range(len(page.tags) - 1, 0, -1):
        in_aside[page.aside_up[k]] += in_aside[k]
        count[page.aside_up[k]] += count[k]
    best = max(in_mark, key=lambda m: (in_mark[m], -m), default=None)
    if best is not None and in_mark[best]:
        return page.chain(page.mark_aside[best]) if 2 * in_mark[best] >= total or not free else frozenset()
    return frozenset(k for k in range(1, len(page.tags)) if (page.tags[k] == "form" or page.tags[k] not in ASIDE) and count[k] > 1 and 2 * in_aside[k] > total)


def _article(slots: list[Block], depth: int) -> list[Block]:
    """The slots of the marked elements at this depth if these hold at least half of the unlinked text, or else all."""
    marked = [b for b in slots if len(b.marks) > depth]
    if not marked or 2 * _unlinked(marked) < _unlinked(slots):
        return slots
    own: dict[int, list[Block]] = {}
    for b in marked:
        own.setdefault(b.marks[depth], []).append(b)
    return [b for part in own.values() for b in _article(part, depth + 1)]


@dataclass
class Template:
    """texts: the keys of a host's blocks of text that are template. main: the key of its main element (the root: none)."""

    texts: frozenset[int] = frozenset()
    main: int = _ROOT


def page_text(page: Page, template: Template) -> str:
    """The article of a page by its host's template."""
    slots = [b for b in page.blocks if not template.texts or _key("text", page.keys[b.path], b.text) not in template.texts]
    if template.main != _ROOT and template.main in page.keys:
        path = page.keys.index(template.main)
        inside, free = [False] * len(page.up), page.free(page.chain(page.around[path]))
        inside[path] = True
        for k in range(path + 1, len(page.up)):
            inside[k] = inside[page.up[k]]
        if within := [b for b in slots if inside[b.path] and free[b.aside]]:
            return "\n\n".join(b.text for b in within)
    free = page.free(_held(page, slots))
    return "\n\n".join(b.text for b in _article([b for b in slots if free[b.aside]], 0))


#: What an element is: an element, a top heading, a marked element, one that by its meaning isn't article.
_ELEMENT, _HEADING, _MARKED, _OFF = 1, 2, 4, 8


def page_key(page: Page) -> int:
    """A hash of the longest blocks that make up three quarters of a page's text: the same for copies in other surroundings."""
    order = sorted({b.text for b in page.blocks}, key=lambda t: (-len(t), t))
    left, own = 3 * sum(map(len, order)), []
    for t in order:
        if left <= 0:
            break
        own.append(t)
        left -= 4 * len(t)
    return _key("page", "", "\0".join(own))


def page_tokens(page: Page) -> list[tuple[int, int, int, int, int]]:
    """(token, up, kind, n, open) of a page's distinct tokens; kind: 0 for text; open: letters of unlinked text within."""
    inside, texts = [0] * len(page.up), Counter()
    for b in page.blocks:
        inside[b.path] += len(b.text) - b.linked
        texts[b.path, b.text] += 1
    for k in range(len(page.up) - 1, 0, -1):
        inside[page.up[k]] += inside[k]
    out = [(_ROOT, 0, _ELEMENT, 1, inside[0])]
    for k in range(1, len(page.up)):
        up = page.up[k]
        off = page.aside_depth[page.around[k]] > page.aside_depth[page.around[up]]
        kind = _ELEMENT | _HEADING * (page.names[k].partition(".")[0] == "h1") | _MARKED * page.marked[k] | _OFF * off
        out.append((page.keys[k], page.keys[up], kind, page.counts[k], inside[k]))
    out += [(_key("text", page.keys[k], t), page.keys[k], 0, n, n * len(t)) for (k, t), n in texts.items()]
    return out


def nested(own: list[dict], size: int) -> Template:
    """The template of a host from its candidates (token, up, kind, pages, total, open); size: its different pages."""
    children: dict[int, list[dict]] = {}
    for x in own:
        if x["token"] != _ROOT:
            children.setdefault(x["up"], []).append(x)
    root = next((x for x in own if x["token"] == _ROOT), None)
    if root is None:
        return Template()
    # a token is valid if it is reached from the root through elements of the template
    texts, order, todo = set(), [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        for x in children.get(e["token"], ()):
            if x["kind"]:
                todo.append(x)
            else:
                texts.add(x["token"])
    left: dict[int, int] = {}
    heading: dict[int, bool] = {}
    for e in reversed(order):  # inner elements before those around them
        k, inner = e["token"], [x for x in children.get(e["token"], ()) if x["kind"]]
        own_texts = sum(x["open"] for x in children.get(k, ()) if not x["kind"])
        fixed = own_texts + sum(x["open"] - left[x["token"]] for x in inner)
        left[k] = max(0, e["open"] - fixed)
        heading[k] = bool(e["kind"] & _HEADING and left[k] > 0) or any(heading[x["token"]] for x in inner if not x["kind"] & _OFF)
    at = root
    while not at["kind"] & _MARKED:
        one = [x for x in children.get(at["token"], ()) if x["kind"] and not x["kind"] & _OFF and x["total"] == x["pages"]]
        best = max(one, key=lambda x: (left[x["token"]], x["token"]), default=None)
        if best is None or 2 * left[best["token"]] <= left[at["token"]] or heading[at["token"]] and not heading[best["token"]]:
            break
        at = best
    return Template(frozenset(texts), at["token"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, texts, main): each host's template; pages: (host, html). Hosts without one have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, body in zip(*(c.to_pylist() for c in batch.columns)):
                page = parse(body or "")
                key = page_key(page)
                out.extend((host, key, *x) for x in page_tokens(page))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "page", "token", "up", "kind", "n", "open"])

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nested(*x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(t.texts) for t in found], pa.list_(pa.int64())), pa.array([t.main for t in found], pa.int64())], names=["host", "texts", "main"])

    vector = F.sum(F.pmod(F.xxhash64("page", "n"), F.lit(1 << 40)).cast("decimal(38,0)"))
    tokens = pages.mapInArrow(run, "host string, page long, token long, up long, kind long, n long, open long")
    once = tokens.groupBy("host", "page", "token", "up").agg(F.max("kind").alias("kind"), F.max("n").alias("n"), F.max("open").alias("open"))
    each = once.groupBy("host", "token", "up").agg(F.count("*").alias("pages"), F.sum("n").alias("total"), vector.alias("vector"), F.max("kind").alias("kind"), F.sum("open").alias("open"))
    each = staged(each.where(F.col("pages") >= SUPPORT_PAGES), "tokens")
    sizes = small_side(each.where(F.col("token") == F.lit(_ROOT)).select("host", F.col("pages").alias("size")), "hosts")  # the root stands in every page
    common = each.join(sizes, "host").where(F.col("pages") >= F.col("size") * SUPPORT)
    classes = common.groupBy("host", "size", "pages", "total", "vector").agg(F.collect_list(F.struct("token", "up", "kind", "pages", "total", "open")).alias("own"))
    large = classes.where((F.size("own") >= CLASS_TOKENS) | (F.col("pages") == F.col("size")))
    # a host's template has at most the tokens of two pages, since each of them stands in half of the pages
    flat = large.groupBy("host").agg(F.flatten(F.collect_list("own")).alias("own"), F.max("size").alias("size"))
    return flat.mapInArrow(nest, "host string, texts array<long>, main long")


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", body: str = "html", into: str = "text", broadcast_tokens: int = 500_000) -> DataFrame:
    """pages with into: the main text of each page, blocks joined by an empty line; "" for null, empty or textless pages.

    A null url, or one without a host, belongs to the host "". Hosts of fewer than SUPPORT_PAGES different pages have no
    template: their pages' own elements decide. Rows that repeat are all kept. Raises ValueError if pages has a column into.
    Templates of at most broadcast_tokens texts and hosts in all (some 20 bytes each) are broadcast; beyond, they are joined
    by host, a hot host being a skewed key that Spark splits.
    """
    refuse_taken(pages, into)
    python_ready(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    own, texts, main = (free_name(pages, x) for x in ("_host", "_texts", "_main"))
    known = staged(templates(pages.select(host.alias("host"), F.col(f"`{body}`").alias("html"))), "templates")
    total = known.agg(F.sum(F.size("texts") + F.lit(4)).alias("n")).first()["n"] or 0
    known = known.select(F.col("host").alias(own), F.col("texts").alias(texts), F.col("main").alias(main))
    rows = pages.withColumn(own, host).join(F.broadcast(known) if total <= broadcast_tokens else known, own, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Template] = {}
        for batch in batches:
            hosts, found, mains, bodies = batch.columns[0].to_pylist(), batch.columns[1], batch.columns[2].to_pylist(), batch.column(batch.schema.get_field_index(body)).to_pylist()
            out = []
            for i, (h, k, source) in enumerate(zip(hosts, mains, bodies)):
                if h not in kept:
                    if len(kept) > 1000:
                        kept.clear()
                    kept[h] = Template() if k is None else Template(frozenset(found[i].as_py()), k)
                out.append(page_text(parse(source), kept[h]) if source else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(out, pa.string())], names=[*batch.schema.names[3:], into])

    ordered = rows.select(own, texts, main, *[F.col(f"`{c}`") for c in pages.columns])
    return ordered.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(into, T.StringType(), False)]))
