"""HTML main-text extraction with a site style tree.

Style tree: the pages of a host are merged by element path (block elements with their classes, digits
left out). A node has a presentation on each of its m pages (the sequence of its child elements,
repeats once) and content features (the texts of its blocks). What k of the m pages share has the
entropy log k; a node's own importance is 1 - mean(log k) / log(m + PRIOR_PAGES), over the pages for
the presentation and over the features for the content: near 0 if all pages agree, 1 if all differ.
PRIOR_PAGES stands for pages not seen that look otherwise, so few pages prove little. Composite
importance goes bottom-up: a node's own importance and, faded by FADE a level, that of all nodes
below it, weighted by their pages. A branch goes if no node in it reaches MIN_IMPORTANCE. MAX_DEPTH is the
depth at which browsers stop nesting, too: what is opened deeper is a child of the element there. A
page of which nothing would stay keeps its furniture.

Markup that names its own role is removed on every page, as a lone page has no entropy: menus,
footers, asides, forms, scripts, styles, headers outside the article, and elements with a class, id
or role that speaks of them. Words for adverts, consent and comments tell wherever a name begins or
ends with them (`ad-slot`, `user-comments`) unless another word of it tells of a state (`has-ads`,
`comments-open`); other words tell if all words of the name speak of noise or say nothing. A name
counts for nothing inside code, on an element that holds the main element or an article (unless it
says comment), and on headings inside an article; on sections there only comment words count.

What would take the article with it is not believed: on pages without article and main element a
name of layout or of a notice over more than half of the text, and a form over more than half of the
prose (pages of some servers lie in one form). If nothing stays, names other than those of adverts,
consent and comments are not believed.

Which part: the articles. One container outside of them is taken instead if it has more text than
they have and they are teasers: mostly links, headings alone, or several without the page's main
heading. Of what is outside, what is in the main element, if anything is; without articles the main
element, else all. A longer text beside a lone article, such as a discussion, does not replace it.

Blocks: text between the boundaries of block elements. Character references are decoded, white
space becomes one space, blocks are trimmed and joined by one line feed; empty ones vanish.

Cases: null, empty and text-free html gives ''. Truncated and misnested markup is read as far as it
goes. A null url belongs to no site. Repeated rows give repeated rows; pages with equal html count
once in the tree. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lettermill.llm.common import cut

PRIOR_PAGES = 4
MIN_IMPORTANCE = 0.2
FADE = 0.9
#: A block of so many characters is prose, whatever its element.
LONG_BLOCK = 80
MAX_DEPTH = 512
#: Furniture nodes of all hosts that may be broadcast (8 bytes each); beyond, the join is salted.
BROADCAST_NODES = 500_000
SALTS = 32

# Element names of HTML by role.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NOISE = frozenset("head nav header footer aside menu dialog script style noscript template iframe object svg canvas audio video button select textarea option label legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CODE = frozenset("pre code".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre td th tr tbody table figure figcaption caption".split())
# Words of a class, id or role that mark content which is none of the article's.
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising adsbygoogle adslot adunit sponsor sponsored promo promotion gdpr cookie cookies consent".split())
NOTICE_WORDS = frozenset("notice notices popup modal overlay".split())
FOREIGN_WORDS = COMMENT_WORDS | ADVERT_WORDS | NOTICE_WORDS
# Words beside which a name tells of a state or of another thing.
STATE_WORDS = frozenset("has have with without no non not is are show hide hidden shown enable enabled disable disabled open opened closed allow allowed free loaded ready hoc count counter policy page layout body wrapper theme".split())
# Words that mark parts of a layout, and words that say nothing beside them.
LAYOUT_WORDS = frozenset(
    "banner newsletter subscribe subscription sidebar rail menu nav navbar navigation breadcrumb breadcrumbs toolbar footer header masthead share sharing social related recommended widget login signup pagination pager skip complementary contentinfo".split()
)
NEUTRAL_WORDS = frozenset(
    "site page main global primary secondary top bottom left right inner outer box area list block wrap wrapper container section item group bar panel links link text content body post entry article form buttons button icons row col column bottoms number nr no the of".split()
)
#: Opening the key closes an open element of the value's names first.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSE_STOPS = ("ul", "ol", "dl", "table", "select")
P_STOPS = ("td", "th", "li", "div", "section", "article", "body")

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*\Z", re.DOTALL)
_NAMING = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+|[^\x00-\x7f]+")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(maxsize=1 << 14)
def _naming(attributes: str) -> tuple[str, frozenset[str], str]:
    """(label of the classes, noise words that a whole class, id or role consists of, role)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMING.finditer(attributes)}
    noise: set[str] = set()
    for token in " ".join(found.values()).split():
        words = {w.lower() for w in _WORDS.findall(token)}
        in_order = [w.lower() for w in _WORDS.findall(token) if not w.isdigit()]
        if not words & STATE_WORDS:
            noise |= (COMMENT_WORDS | ADVERT_WORDS) & {*in_order[:1], *in_order[-1:]}
        telling = words & (FOREIGN_WORDS | LAYOUT_WORDS)
        if telling and all(w in telling or w in NEUTRAL_WORDS or w.isdigit() for w in words):
            noise |= telling
    classes = sorted(set(re.sub(r"\d+", "", found.get("class", "")).split()))
    return ".".join(classes), frozenset(noise), found.get("role", "").lower()


@lru_cache(maxsize=1 << 16)
def _child(above: int, label: str) -> int:
    return _hash(f"{above}>{label}")


class _Named:
    """An element whose name says noise, inside others of its kind."""

    __slots__ = ("outer", "foreign", "comment", "form", "believed", "chars", "prose")

    def __init__(self, outer: _Named | None, words: frozenset[str], form: bool):
        self.outer, self.form, self.believed, self.chars, self.prose = outer, form, True, 0, 0
        self.foreign, self.comment = bool(words & (COMMENT_WORDS | ADVERT_WORDS)), bool(words & COMMENT_WORDS)


class Node:
    """An open or closed element; inline elements share the place of the block that holds them."""

    __slots__ = ("name", "block", "ids", "label", "layout", "silent", "named", "article", "main", "code", "parent")

    def __init__(self, name: str, block: bool, parent: Node | None):
        self.name, self.block, self.parent = name, block, parent
        if parent is None:
            self.ids, self.label, self.layout, self.silent, self.named, self.article, self.main, self.code = (), "", [], False, None, False, False, False
        else:
            self.ids, self.label, self.layout = parent.ids, parent.label, parent.layout
            self.silent, self.named, self.article, self.main, self.code = parent.silent, parent.named, parent.article, parent.main, parent.code


class Block:
    """A block's text, the element that it ends in, and how many of its characters are links'."""

    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def _opened(name: str, attributes: str, parent: Node) -> Node:
    node = Node(name, name in BLOCK, parent)
    classes, words, role = _naming(attributes) if "=" in attributes else ("", frozenset(), "")
    label = f"{name}.{classes}" if classes else name
    if not parent.layout or parent.layout[-1] != label:
        parent.layout.append(label)
    if node.block:
        node.label, node.layout = label, []
        if len(parent.ids) < MAX_DEPTH:
            node.ids = (*parent.ids, _child(parent.ids[-1] if parent.ids else 0, label))
    if name == "main" or role == "main" or (name == "article" and not parent.article):
        named = parent.named
        while named:
            named.believed = named.believed and named.comment
            named = named.outer
    node.main = parent.main or name == "main" or role == "main"
    node.article = parent.article or name == "article"
    node.silent = parent.silent or (name in NOISE and not (name == "header" and parent.article))
    node.code = parent.code or name in CODE
    if parent.code:
        words = frozenset()
    elif parent.article:
        words = frozenset() if name in HEADINGS else words & COMMENT_WORDS if name == "section" else words - {"header", "banner"}
    if name == "form" or (words and name not in ("html", "body", "main")):
        node.named = _Named(parent.named, words, name == "form")
    return node


def _same_noise(a: Node, b: Node) -> bool:
    return a.silent == b.silent and a.named is b.named


def parse(page: str | None) -> tuple[list[Block], list[Node]]:
    """The blocks of a page in page order, furniture included, and its block elements."""
    page = page or ""
    stack, out, held, links = [Node("", True, None)], [], [], []
    nodes: list[Node] = []
    is_open: defaultdict[str, int] = defaultdict(int)

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append(Block(text, stack[-1], sum(map(len, links))))
        held.clear()
        links.clear()

    def close(at: int) -> None:
        for node in stack[at:]:
            is_open[node.name] -= 1
        del stack[at:]

    def find(names: tuple[str, ...], stop: tuple[str, ...]) -> int:
        for x in names:
            if is_open[x]:
                break
        else:
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return i
            if stack[i].name in stop:
                return 0
        return 0

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        if is_open["a"]:
            links.append(held[-1])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
                if i := find((name,), ()):
                    close(i)
            elif is_open[name] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        if not _same_noise(stack[i], stack[i - 1]):
                            flush()
                        close(i)
                        break
                    if stack[i].block:
                        break
            continue
        if name in BLOCK:
            flush()
            if i := find(("p",), P_STOPS):
                close(i)
        if name in CLOSES and (i := find(CLOSES[name], CLOSE_STOPS)):
            flush()
            close(i)
        if name in VOID:
            if name == "br":
                held.append(" ")
            top = stack[-1]
            if not top.layout or top.layout[-1] != name:
                top.layout.append(name)
            continue
        opened = _opened(name, m[3], stack[-1])
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            if name == "title" or opened.silent:
                at = end.end() if end else n
                continue
        if not opened.block and not _same_noise(opened, stack[-1]):
            flush()
        if opened.block:
            nodes.append(opened)
        stack.append(opened)
        is_open[name] += 1
    flush()
    return out, nodes


def _is_noise(node: Node) -> bool:
    named = node.named
    while named and not named.believed:
        named = named.outer
    return node.silent or named is not None


def _names(block: Block) -> Iterator[_Named]:
    named = block.node.named
    while named:
        yield named
        named = named.outer


def _is_prose(block: Block) -> bool:
    return block.node.name in PROSE or len(block.text) >= LONG_BLOCK


def _disbelieve(found: list[Block]) -> None:
    """Without an article or main element, what most of the text or prose lies under is not believed; adverts and comments are."""
    loud = [b for b in found if not b.node.silent]
    if any(b.node.article or b.node.main for b in loud):
        return
    total, prose = sum(len(b.text) for b in loud), sum(len(b.text) for b in loud if _is_prose(b))
    for b in loud:
        for named in _names(b):
            named.chars += len(b.text)
            named.prose += len(b.text) * _is_prose(b)
            if not named.foreign and (2 * named.prose > prose if named.form else 2 * named.chars > total):
                named.believed = False


def _believe_less(found: list[Block]) -> None:
    """Where nothing would stay, only names of adverts, consent and comments are believed, and forms without prose."""
    for b in found:
        for named in _names(b):
            if not named.foreign and (not named.form or named.prose):
                named.believed = False


def _container(node: Node) -> Node:
    while node.parent is not None and (not node.block or node.name in PROSE):
        node = node.parent
    return node


def _article(node: Node) -> Node:
    """The outermost article around a node in one."""
    while node.parent is not None and node.parent.article:
        node = node.parent
    return node


def _teasers(articles: list[Block]) -> bool:
    """True if the articles point to texts rather than being one."""
    roots = {id(_article(b.node)) for b in articles}
    body = [b for b in articles if b.node.name not in HEADINGS]
    if 2 * sum(b.linked for b in articles) > sum(len(b.text) for b in articles) or not body:
        return True
    return len(roots) > 1 and not any(b.node.name == "h1" for b in articles)


def _main(kept: list[Block]) -> list[Block]:
    articles, outside = [b for b in kept if b.node.article], [b for b in kept if not b.node.article]
    if articles:
        chars: dict[int, int] = defaultdict(int)
        for b in outside:
            chars[id(_container(b.node))] += len(b.text)
        if max(chars.values(), default=0) <= sum(len(b.text) for b in articles) or not _teasers(articles):
            return articles
    return [b for b in outside if b.node.main] or outside


def main_text(page: str | None, furniture: frozenset[int] = frozenset()) -> str:
    """The page's main text without the branches that its site's tree calls furniture."""
    found, _ = parse(page)
    _disbelieve(found)
    kept = [b for b in found if not _is_noise(b.node)]
    if not kept:
        _believe_less(found)
        kept = [b for b in found if not _is_noise(b.node)]
    important = [b for b in kept if furniture.isdisjoint(b.node.ids)] if furniture else kept
    return "\n".join(b.text for b in _main(important or kept))


def tree_rows(page: str | None) -> Iterator[tuple[tuple[int, ...], str, int, int]]:
    """(ids from the root to the node, label, kind, value) of a page: one presentation (kind 0, value 0 if bare) a node, and its features (kind 1)."""
    found, nodes = parse(page)
    labels: dict[tuple[int, ...], str] = {}
    layouts, texts = defaultdict(set), defaultdict(set)
    for node in nodes:
        labels.setdefault(node.ids, node.label)
        layouts[node.ids].add(",".join(node.layout))
    for b in found:
        texts[b.node.ids].add(_hash(b.text))
    for ids, label in labels.items():
        shown = "|".join(sorted(x for x in layouts[ids] if x))
        yield ids, label, 0, _hash(shown) if shown else 0
        for value in texts[ids]:
            yield ids, label, 1, value


_ROWS = "host string, page bigint, path string, label string, kind int, value bigint"
#: Rows of the tree that a task hands on at a time.
FLUSH = 20_000


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    rows: list[tuple] = []
    for batch in batches:
        for host, page in zip(batch["host"], batch["html"], strict=True):
            page_hash = _hash(page)
            for ids, label, kind, value in tree_rows(page):
                rows.append((host, page_hash, ",".join(map(str, ids)), label, kind, value))
                if len(rows) >= FLUSH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
    yield pd.DataFrame(rows, columns=columns)


def _host(url_col: str):
    return F.lower(F.regexp_extract(F.col(url_col), "://([^/?#]*)", 1))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, ids, label, n_pages, importance, composite, branch): the tree's nodes over all pages of each host.

    `branch` is the largest composite importance in the branch that starts at the node.
    """
    rows = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html")).where("host <> '' and html is not null")
    rows = rows.mapInPandas(_features, _ROWS).distinct()
    counts = rows.groupBy("host", "path", "label", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    is_layout, n = F.col("kind") == 0, F.col("n")
    sums = counts.groupBy("host", "path").agg(
        F.min("label").alias("label"),
        F.sum(F.when(is_layout, n)).alias("n_pages"),
        F.sum(F.when(is_layout, n * F.ln(n))).alias("layout"),
        F.max(is_layout & (F.col("value") != 0)).alias("is_laid_out"),
        F.sum(F.when(~is_layout, F.ln(n))).alias("content"),
        F.count_if(~is_layout).alias("n_features"),
    )
    scale = F.ln(F.col("n_pages") + PRIOR_PAGES)
    content = 1 - F.col("content") / F.col("n_features") / scale
    layout = 1 - F.col("layout") / F.col("n_pages") / scale
    own = F.when(F.col("n_features") == 0, layout).when(F.col("is_laid_out"), (content + layout) / 2).otherwise(content)
    ids = F.split("path", ",").cast("array<bigint>")
    nodes = cut(sums.select("host", ids.alias("ids"), "label", "n_pages", own.alias("importance")))
    # every node hands its importance to all nodes above it and to itself
    up = nodes.select("host", F.posexplode("ids").alias("at", "id"), "ids", "label", "n_pages", "importance")
    up = up.withColumn("weight", F.col("n_pages") * F.pow(F.lit(FADE), F.size("ids") - 1 - F.col("at")))
    itself = F.when(F.size("ids") - 1 == F.col("at"), F.struct("ids", "label", "n_pages", "importance"))
    composite = F.sum(F.col("weight") * F.col("importance")) / F.sum("weight")
    judged = cut(up.groupBy("host", "id").agg(F.max(itself).alias("of"), composite.alias("composite")).select("host", "of.*", "composite"))
    branch = judged.select("host", F.explode("ids").alias("id"), "composite").groupBy("host", "id").agg(F.max("composite").alias("branch"))
    return judged.withColumn("id", F.element_at("ids", -1)).join(branch, ["host", "id"]).drop("id")


def _texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, furniture in batches:
        yield pd.Series([main_text(p, frozenset(() if f is None else f)) for p, f in zip(pages, furniture, strict=True)], dtype=object)


def furniture_of(tree: DataFrame) -> DataFrame:
    """(host, furniture): ids of the nodes at which the branches without importance start."""
    low = tree.where(F.col("branch") < MIN_IMPORTANCE).select("host", F.element_at("ids", -1).alias("id"), F.try_element_at("ids", F.lit(-2)).alias("above"))
    starts = low.join(low.select("host", F.col("id").alias("above")), ["host", "above"], "left_anti")
    return starts.groupBy("host").agg(F.collect_set("id").alias("furniture"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page."""
    low = cut(furniture_of(style_tree(pages, url_col, html_col)))
    n_nodes = low.agg(F.sum(F.size("furniture"))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.coalesce(_host(url_col), F.lit("")).alias("host"))
    if n_nodes <= BROADCAST_NODES:
        rows = rows.join(F.broadcast(low), "host", "left")
    else:
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    text = F.pandas_udf(_texts, StringType())
    return rows.select("page_id", "url", text("html", "furniture").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
