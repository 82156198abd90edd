"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree. A style node is a sequence of children with their classes that an
element has on some pages, and an element node is a place in a style node, so pages share an element as far as
they agree in the layouts above it. The importance of an element is the entropy of what it shows, over the pages that
have it and with their number as base: of its styles, or of its texts if it is a leaf. It is 0 if all pages show the same, 1
if no two do, and 1 on a single page. The composite importance takes in what is below: with l styles, (1 - g^l) times its own
plus g^l times the mean over its styles, by pages, of the mean of their elements. An element is noisy if it and all below it
have a composite importance under a threshold. As one more paragraph is another layout already, elements are also merged by
their path alone, over all layouts, and judged by the entropy of their texts.

Pages count once for each distinct text of the region that holds their article (an ``article`` or ``main``
element, else the body), so no region as a whole is noisy. Noisy elements are removed from the pages of that host. Elements
whose name or class states what they are (menus, footers, forms, adverts, comments) have no importance at all, on any host.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, read

LEAST_PAGES = 10     # different pages of a host that a node must be on before it is removed
LOW = 0.2            # composite importance that a node must have
DECAY = 0.9          # what a further style of an element takes from the weight of what is below it
ROWS_AT_ONCE = 50_000
TOP, BY_PATH = 1, 0  # id of the element that holds a whole page; parent of elements merged by path alone
BROADCAST_HOSTS = 20_000

# Fixed values of HTML: elements by how they nest.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript template iframe textarea noembed noframes xmp object svg math canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul button select option label".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption legend option summary label button select".split())
SAME_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
SCOPES = frozenset("ul ol dl table select".split())
# Elements and words of classes that name what is not part of an article.
NOISE_TAGS = frozenset("nav aside footer form button select dialog menu head fieldset label".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs sidebar aside rail footer masthead header topbar cookie "
    "cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login "
    "comment comments commentlist disqus replies respond share sharing social related recommended widget "
    "pagination pager skip toolbar copyright legal disclaimer".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
REGION_TAGS = ("article", "main")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_OPENING = re.compile(r"<([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
_NUMBER = re.compile(r"&#(?:0*([0-9]*)|([xX])0*([0-9a-fA-F]*))(;?)")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    __slots__ = ("tag", "label", "path", "noise", "region", "parent")

    def __init__(self, tag: str, label: str, path: int, noise: bool, region: str | None, parent: _Node | None):
        self.tag, self.label, self.path, self.noise, self.region, self.parent = tag, label, path, noise, region, parent


def _digest(content: str) -> int:
    return int.from_bytes(hashlib.blake2b(content.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _decoded(text: str) -> str:
    """Character references decoded. Numbers beyond the last code point, of any length, give U+FFFD."""

    def short(found: re.Match) -> str:
        digits = found[3] if found[2] else found[1]
        if len(digits) > 8:
            return "\ufffd"
        return f"&#{found[2] or ''}{digits or 0}{found[4]}" if found[0][2:].strip("xX;") else found[0]

    return unescape(_NUMBER.sub(short, text) if "&#" in text else text)


class _Openings:
    """The opening tags of a source, each looked for once, in time in proportion to the source.

    A tag ends at the first > outside quotes. Where none follows, all quotes that the search came by are
    remembered, as every other tag that comes by them has no end either.
    """

    def __init__(self, html: str):
        self.html = html
        self.stops = [m.start() for m in _STOP.finditer(html)]
        self.failed: set[int] = set()
        self.failed_name = 0

    def at(self, position: int) -> tuple[str, str, int] | None:
        """(name, attributes, end) of the tag that opens at ``position``, or None if none does."""
        opened = _OPENING.match(self.html, position) if self.stops and self.failed_name <= position < self.stops[-1] else None
        if not opened:
            return None
        place, passed = opened.end(), []
        while (i := bisect_left(self.stops, place)) < len(self.stops) and self.stops[i] not in self.failed:
            stop = self.stops[i]
            if self.html[stop] == ">":
                return opened[1], self.html[opened.end() : stop], stop + 1
            passed.append(stop)
            closing = self.html.find(self.html[stop], stop + 1)
            if closing < 0:
                break
            place = closing + 1
        self.failed.update(passed)
        self.failed_name = opened.end()
        return None


def _attributes(source: str) -> dict[str, str]:
    if not source.strip(" /\n\t"):
        return {}
    return {k.lower(): _decoded((v or "").strip("\"'")) for k, v in _ATTRIBUTE.findall(source)}


def _is_noise(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    if tag in NOISE_TAGS or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    words = {w.lower() for n in ("class", "id") for w in _WORD.findall(attributes.get(n, ""))}
    if tag in REGION_TAGS or tag in ("body", "html"):
        words -= NOISE_WORDS - {"comment", "comments", "ad", "ads", "advert"} if tag in REGION_TAGS else words
    if inside:
        words.discard("header")
    return bool(
        words & NOISE_WORDS
        or attributes.get("role", "").lower() in NOISE_ROLES
        or "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or _HIDDEN.search(attributes.get("style", ""))
    )


def blocks_of(html: str) -> list[tuple[int, str, str | None]]:
    """(path, text, region) of each block of text that isn't noise by name, in page order.

    ``path`` is a digest of the elements from the body down, of the same size at any depth, and the time
    taken is in proportion to the source, however badly it is nested or closed. ``region`` is "article" or "main" for blocks inside such an element. Comments, scripts and
    markup are gone, character references decoded, white space made one space.
    """
    return [(node.path, text, region) for node, text, region in _parsed(html)]


def _parsed(html: str) -> list[tuple[_Node, str, str | None]]:
    """The blocks of text with the elements they stand in."""
    out: list[tuple[_Node, str, str | None]] = []
    stack = [_Node("", "", 0, False, None, None)]
    depths: dict[str, list[int]] = {}    # of the open elements of each name
    pieces: list[str] = []
    inline: list[str] = []      # open inline elements that are noise

    def flush() -> None:
        if pieces:
            text = " ".join(_decoded("".join(pieces)).split())
            if text and not stack[-1].noise:
                out.append((stack[-1], text, stack[-1].region))
            pieces.clear()

    def close(names: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        depth = max((depths[n][-1] for n in names if depths.get(n)), default=0)
        if depth and depth > max((depths[n][-1] for n in stop if depths.get(n)), default=0):
            flush()
            for node in stack[depth:]:
                depths[node.tag].pop()
            del stack[depth:]
            inline.clear()

    openings = _Openings(html)
    position, end = 0, len(html)
    while position < end:
        opening = openings.at(position)
        if opening is None:
            token = _TOKEN.match(html, position)
            position = token.end()
            ended = token.group(1)
            if ended is None:
                text = token.group(0)
                if not text.startswith(("<!", "<?", "</")) and not inline:
                    pieces.append(text)
                continue
            name = ended.lower()
            if name in BLOCK:
                flush()
                close({name})
            elif name in inline:
                del inline[inline.index(name) :]
            continue
        name, source, position = opening[0].lower(), *opening[1:]
        if name in RAW:
            if not source.endswith("/"):
                closing = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, position)
                position = closing.end() if closing else end
            pieces.append(" ")
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name not in BLOCK:
            if not inline and source and not source.endswith("/") and _is_noise("span", _attributes(source), True):
                inline.append(name)
            elif inline and name == inline[0]:
                inline.append(name)
            continue
        flush()
        if name in CLOSES_P:
            close({"p"}, BLOCK - {"p"})
        if name in SAME_CLOSES:
            close(SAME_CLOSES[name], SCOPES)
        if name in VOID:
            continue
        parent, attributes = stack[-1], _attributes(source)
        label = ".".join([name, *sorted(attributes.get("class", "").split())])
        region = parent.region
        if region != "article" and name in REGION_TAGS:
            region = name
        elif region is None and attributes.get("role", "").lower() == "main":
            region = "main"
        noise = parent.noise or _is_noise(name, attributes, parent.region is not None)
        depths.setdefault(name, []).append(len(stack))
        stack.append(_Node(name, label, _digest(f"{parent.path}/{label}"), noise, region, parent))
    flush()
    return out


def _in_region(blocks: list[tuple[_Node, str, str | None]]) -> list[tuple[_Node, str]]:
    """The blocks inside articles, else inside the main element, else all.

    Where the main element says more beside its articles than all articles say, these are teasers and
    it is the region. Ties go to the articles.
    """
    said = {region: sum(len(t) for _, t, r in blocks if r == region) for region in REGION_TAGS}
    for region in sorted(REGION_TAGS, key=lambda r: (-said[r], REGION_TAGS.index(r))):
        if said[region]:
            return [(p, t) for p, t, r in blocks if r == region]
    return [(p, t) for p, t, _ in blocks]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


class _Element:
    """An element of a page in the tree of its host; one without children is a leaf, with the texts ``texts``."""

    __slots__ = ("id", "parent", "beside", "children", "style", "texts")

    def __init__(self, id: int, parent: int | None, beside: int, children: int, style: int | None, texts: list[int]):
        self.id, self.parent, self.beside, self.children = id, parent, beside, children
        self.style, self.texts = style, texts


def _elements(blocks: list[tuple[_Node, str]]) -> Iterator[_Element]:
    """The elements that hold the blocks of a page, each after its parent. ``texts`` are numbers of blocks.

    An element's id tells the element above it, its style there and its place in that. Text beside other
    children is a leaf of its own.
    """
    inside: dict[_Node, list[_Node | int]] = {}
    for i, (node, _) in enumerate(blocks):
        child: _Node | int = i
        while node is not None:
            known = node in inside
            inside.setdefault(node, []).append(child)
            if known:
                break
            child, node = node, node.parent

    def is_leaf(child: _Node | int) -> bool:
        return isinstance(child, int) or (len(inside[child]) == 1 and isinstance(inside[child][0], int))

    def named(child: _Node | int) -> str:
        return "#" if isinstance(child, int) else f"#{child.label}" if is_leaf(child) else child.label

    todo: list[tuple[_Node | int, int, int | None, int]] = [(n, TOP, None, 1) for n in inside if n.parent is None]
    while todo:
        child, own, parent, beside = todo.pop()
        if is_leaf(child):
            yield _Element(own, parent, beside, 0, None, [child] if isinstance(child, int) else inside[child])
            continue
        below = inside[child]
        style = _digest("\n".join(named(c) for c in below))
        yield _Element(own, parent, beside, len(below), style, [])
        todo += [(c, _digest(f"{own}/{style}/{i}"), own, len(below)) for i, c in enumerate(below)]


def _kept(blocks: list[tuple[_Node, str]], low: set[int]) -> list[str]:
    """The texts outside the elements and paths of ``low``."""
    if not low:
        return [t for _, t in blocks]
    gone, dropped = set(low), set()
    for element in _elements(blocks):
        if element.parent in gone:
            gone.add(element.id)
        if element.id in gone:
            dropped.update(element.texts)
    return [t for i, (node, t) in enumerate(blocks) if i not in dropped and node.path not in low]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_tree(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """The merged elements of each host: (host, node, parent, beside, children, styles, m, importance).

    ``parent`` is ``BY_PATH`` for elements merged by path alone, ``beside`` the elements of the style that the
    node is one of, ``children`` those of all its styles (0: a leaf), ``m`` its pages and ``importance`` its own. A page
    counts once for each distinct text of its region, so copies change nothing. Pages are told apart by digests; a
    host of any size is summed before it is shuffled.
    """
    columns = ["host", "region", "node", "parent", "beside", "children", "shown"]

    def mark(texts: list[str]) -> int:
        return _digest("\n".join(texts))

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: set = set()
            for name, source in zip(batch[host], batch[html], strict=True):
                blocks = _in_region(_parsed(source or ""))
                paths: dict[int, list[str]] = {}
                for node, text in blocks:
                    paths.setdefault(node.path, []).append(text)
                region = mark([t for _, t in blocks])
                seen.update((name, region, path, BY_PATH, 1, 0, mark(texts)) for path, texts in paths.items())
                for e in _elements(blocks):
                    if e.parent is not None:    # the top itself is never removed
                        content = mark([blocks[i][1] for i in e.texts]) if e.style is None else e.style
                        seen.add((name, region, e.id, e.parent, e.beside, e.children, content))
                if len(seen) >= ROWS_AT_ONCE:
                    yield pd.DataFrame(list(seen), columns=columns)
                    seen.clear()
            yield pd.DataFrame(list(seen), columns=columns)

    found = pages.select(host, html).mapInPandas(
        shown, "host string, region long, node long, parent long, beside int, children int, shown long"
    )
    by_content = found.distinct().groupBy(*[c for c in columns if c != "region"]).agg(F.count("*").alias("c"))
    c, m = F.col("c"), F.col("m")
    merged = by_content.groupBy("host", "node", "parent", "beside").agg(
        F.sum("children").alias("children"), F.count("*").alias("styles"), F.sum(c).alias("m"), F.sum(c * F.log(c)).alias("s")
    )
    entropy = F.when(m > 1, (F.log(m) - F.col("s") / m) / F.log(m)).otherwise(F.lit(1.0))
    return merged.withColumn("importance", entropy).drop("s")


def noisy_elements(tree: DataFrame) -> DataFrame:
    """(host, node, m) of the elements of ``style_tree`` that are noisy, leaves first, then upwards.

    What an element adds to the composite importance of its parent is (its own) * m / beside, over the parent's pages.
    Only elements of which all children are noisy are looked at, so there is a round for each level of these alone.
    """
    weight = F.pow(F.lit(DECAY), F.col("styles"))
    own = F.when(F.col("children") == 0, F.col("importance")).otherwise((1 - weight) * F.col("importance"))
    able = materialize(tree.filter((F.col("m") > 1) & (F.col("parent") != BY_PATH) & (own < LOW)))
    columns = ["host", "node", "parent", "beside", "m", "value"]
    noisy = able.filter("children = 0").withColumn("value", F.col("importance")).select(*columns)
    inner = able.filter("children > 0")
    while not noisy.isEmpty():
        below = noisy.groupBy("host", F.col("parent").alias("node")).agg(
            F.count("*").alias("low_children"), F.sum(F.col("value") * F.col("m") / F.col("beside")).alias("below")
        )
        value = (1 - weight) * F.col("importance") + weight * F.col("below") / F.col("m")
        found = inner.join(below, ["host", "node"]).filter("low_children = children").withColumn("value", value)
        found = found.filter(F.col("value") < LOW).select(*columns)
        found = materialize(found.join(noisy.select("host", "node"), ["host", "node"], "left_anti").select(*columns))
        if found.isEmpty():
            break
        noisy = noisy.unionByName(found)
    return noisy.select("host", "node", "m")


def low_nodes(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(host, low): for each host that has any, its noisy elements and paths that enough pages have."""
    tree = materialize(style_tree(pages, host, html).filter("m > 1"))
    paths = tree.filter((F.col("parent") == BY_PATH) & (F.col("importance") < LOW)).select("host", "node", "m")
    low = noisy_elements(tree).unionByName(paths).filter(F.col("m") >= LEAST_PAGES)
    return low.groupBy("host").agg(F.collect_set("node").alias("low"))


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars): the main text of every page, from its whole source.

    A null or empty source gives an empty text; a null or odd address is a host of its own. Pages
    repeat as they do in the input. Blocks are joined by a line feed, and nothing is cut.
    """
    narrow = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("html"))
    narrow = narrow.withColumn("host", host_of(F.col("_url")))
    low = materialize(low_nodes(narrow))
    # few hosts have such nodes; beyond the bound a host of very many pages is split by the skew join
    judged = narrow.join(F.broadcast(low) if low.count() <= BROADCAST_HOSTS else low, "host", "left")

    @F.pandas_udf("string")
    def main_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, lows in batches:
            texts = []
            for source, low in zip(sources, lows, strict=True):
                gone = set(low) if low is not None else set()
                texts.append("\n".join(_kept(_in_region(_parsed(source or "")), gone)))
            yield pd.Series(texts, dtype="object")

    found = judged.select("_key", "_url", main_text("html", "low").alias("text"))
    return found.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def op4_page_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
