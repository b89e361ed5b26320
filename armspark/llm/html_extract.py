"""HTML extraction with a site style tree.

The pages of a host are merged by the path of each element (tag, class and id, digits as one sign). For each path the tree
keeps how many pages have it, the distinct presentations (the sequence of child elements) and the distinct contents (the text
below it). Presentation importance is the entropy of the presentations over the pages; a content that many pages
repeat has a high entropy over pages and so a low importance. With l presentations their weights are 1 - g^l and g^l. A path is low
if both its importance and that of its contents alone are below the threshold: the entropy of a few layouts falls as the host grows,
texts of their own do not. A branch of a page is removed if its path and all paths below it are low and no article is in it, then what the
markup itself names as a menu, header, footer, side bar, notice, advert, form or comment. Paragraphs, headings and the article itself are never removed for being repeated: many
sites carry one article twice.

Importance is summed over (host, path, value) first, so a host with a third of all pages is combined before the shuffle. Pages meet only
the short list of low paths of their host; Spark broadcasts that by its measured size or splits the host's pages.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

GAMMA, THRESHOLD, MIN_PAGES = 0.9, 0.5, 4

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe svg template".split())
_BLOCK = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEPS_OPEN = frozenset("ul ol dl table div section article main body html td th blockquote".split())
_NOISE_TAG = frozenset(
    "head nav footer aside form script style noscript iframe svg template button select input textarea object dialog menu".split()
)
# A name decides as a whole token or its leading part ("nav", "cookie-notice"), or behind a word of place ("main-nav"), not as any part
# ("has-sidebar") and not before a word of state ("comments-open").
_NOISE_NAME = re.compile(
    r"(?:^|\s)(?:(?:site|page|main|top|bottom|primary|secondary|global|post|entry|article)[_-]+)?"
    r"(?:ad|ads|adv|advert[a-z0-9]*|banner|sponsor[a-z0-9]*|promo[a-z0-9]*|menu|nav[a-z0-9]*|breadcrumbs?|sidebar|side|widget|footer|"
    r"site-header|page-header|masthead|topbar|toolbar|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|share|sharing|social|related|recommend[a-z0-9]*|comments?|replies|respond|disqus|pagination|pager|skip|hidden)(?=$|[\s_-])"
    r"(?![_-]+(?:open|opened|close|closed|on|off|active|inactive|visible|shown|hidden|enabled|disabled|collapsed|expanded)(?:$|\s))",
    re.I,
)
_PRUNABLE = frozenset("div section aside nav header footer form ul ol dl table figure details span center".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_DIGITS = re.compile(r"\d+")
_SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "path", "parts", "parent")

    def __init__(self, tag: str, names: str, path: int, parent: Node | None):
        self.tag, self.names, self.path, self.parent = tag, names, path, parent
        self.parts: list = []  # texts and nodes in page order


def _path(parent: int, key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), seed=parent) & 0x7FFFFFFFFFFFFFFF


def parse(html: str) -> Node:
    """Tree of a page; forgiving of tags left open, closed twice or cut off."""
    root = Node("", "", 0, None)
    top, at, size = root, 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            top.parts.append(html[at:])
            break
        if m.start() > at:
            top.parts.append(html[at : m.start()])
        at = m.end()
        if m["tag"] is None and m["tag2"] is None:
            if m[0].startswith("<![CDATA["):
                top.parts.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag, end, attrs = (m["tag"], m["end"], m["attrs"]) if m["tag"] is not None else (m["tag2"], m["end2"], m["attrs2"])
        tag = tag.lower()
        if end:
            node = top
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                top = node.parent
            continue
        if tag in _BLOCK or tag in _CLOSES:
            shut = _CLOSES.get(tag, frozenset()) | ({"p"} if tag in _BLOCK else set())
            node = top
            while node is not root and node.tag not in shut and node.tag not in _KEEPS_OPEN - shut:
                node = node.parent
            if node is not root and node.tag in shut:
                top = node.parent
        names = " ".join(
            v.strip("\"'") if k.lower() != "hidden" else "hidden" for k, v in _NAMED.findall(attrs) if k.lower() != "role" or v
        ) if attrs else ""
        node = Node(tag, names, _path(top.path, f"{tag} {_DIGITS.sub('#', names)}"), top)
        top.parts.append(node)
        if tag in _RAW:
            shut = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = shut.end() if shut else size
        elif tag not in _VOID and not attrs.endswith("/"):
            top = node
    return root


def features(root: Node) -> list[tuple[int, str, int, int]]:
    """(path, tag, presentation, content) per distinct path of a page; repeated paths count with all they hold."""
    found: dict[int, list] = {}
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node))
    below: dict[int, bytes] = {}
    for node in reversed(order):  # children before parents
        content, shown = xxhash.xxh64(), xxhash.xxh64()
        for part in node.parts:
            if isinstance(part, Node):
                content.update(below[id(part)])
                shown.update(f"{part.tag} {_DIGITS.sub('#', part.names)};".encode("utf-8", "surrogatepass"))
            elif part and not part.isspace():
                content.update(_SPACES.sub(" ", part).strip().encode("utf-8", "surrogatepass"))
        below[id(node)] = content.digest()
        if node is not root and node.tag in _BLOCK:
            entry = found.setdefault(node.path, [node.tag, xxhash.xxh64(), xxhash.xxh64()])
            entry[1].update(shown.digest())
            entry[2].update(content.digest())
    half = 0x7FFFFFFFFFFFFFFF
    return [(path, tag, s.intdigest() & half, c.intdigest() & half) for path, (tag, s, c) in found.items()]


def _all_low(node: Node, low: frozenset) -> bool:
    """Whether the paths of a branch are all low, and it holds no article or main element."""
    stack = [node]
    while stack:
        node = stack.pop()
        if node.tag in _BLOCK and (node.path not in low or node.tag in ("article", "main")):
            return False
        stack.extend(p for p in node.parts if isinstance(p, Node))
    return True


def _is_noise(node: Node, low: frozenset, in_article: bool) -> bool:
    if node.tag in _NOISE_TAG or (node.tag == "header" and not in_article):
        return True
    if node.names and node.tag not in ("html", "body", "main") and _NOISE_NAME.search(node.names):
        return True
    return node.tag in _PRUNABLE and node.path in low and _all_low(node, low)


def _articles(root: Node) -> tuple[set[int], set[int]]:
    """Ids of the outermost article or main elements that no noise surrounds, and of the elements around them.

    Names count as noise only while there is another article: the only one of a page is found whatever it and its wrappers are called.
    """
    found, stack = [], [(root, False)]
    while stack:
        node, named = stack.pop()
        for part in node.parts:
            if isinstance(part, Node) and part.tag not in _NOISE_TAG:
                noise = named or bool(part.tag not in ("html", "body", "main") and part.names and _NOISE_NAME.search(part.names))
                if part.tag in ("article", "main"):
                    found.append((part, noise))
                else:
                    stack.append((part, noise))
    chosen = [node for node, noise in found if not noise or len(found) == 1]
    around: set[int] = set()
    for node in chosen:
        up = node.parent
        while up is not None and id(up) not in around:
            around.add(id(up))
            up = up.parent
    return {id(node) for node in chosen}, around


def main_text(root: Node, low: frozenset = frozenset()) -> str:
    """Text of the kept branches: one line per block."""
    articles, around = _articles(root)
    blocks: list[str] = []
    line: list[str] = []

    def close():
        text = _SPACES.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            blocks.append(text)

    stack: list = [(root, not articles)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            if inside:
                line.append(unescape(item))
        else:
            begins = id(item) in articles
            if item is not root and not begins and id(item) not in around and _is_noise(item, low, inside and bool(articles)):
                if item.tag in _BLOCK:
                    close()
                continue
            inside = inside or begins
            if item.tag in _BLOCK:
                close()
                stack.append((None, inside))
            elif item.tag == "br" or item.tag in ("td", "th"):
                line.append(" ")
            stack.extend((part, inside) for part in reversed(item.parts))
    close()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, tag, pages, presentations, contents, content_importance, importance) of every element path of every host."""

    def run(batches):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0), batch.column(1)):
                host = host.as_py()
                rows += [(host, *f) for f in features(parse(html.as_py() or ""))]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "path", "tag", "shown", "content"]
            )

    seen = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(
        run, "host string, path long, tag string, shown long, content long"
    )
    sides = F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("shown").alias("value")), F.struct(F.lit(1).alias("side"), F.col("content").alias("value"))))
    counted = seen.select("host", "path", "tag", sides).groupBy("host", "path", "tag", "side", "value").agg(F.count("*").alias("c"))
    c = F.col("c").cast("double")
    is_shown = F.col("side") == 0
    sums = counted.groupBy("host", "path", "tag").agg(
        F.sum(F.when(is_shown, F.col("c"))).alias("pages"),
        F.count_if(is_shown).alias("presentations"),
        F.count_if(~is_shown).alias("contents"),
        F.sum(F.when(is_shown, c * F.log(c))).alias("shown_log"),
        F.sum(F.when(~is_shown, F.log(c))).alias("content_log"),
    )
    m = F.log(F.col("pages").cast("double"))
    by_shown = (m - F.col("shown_log") / F.col("pages")) / m
    by_content = 1.0 - F.col("content_log") / (m * F.col("contents"))
    constant = F.pow(F.lit(GAMMA), F.col("presentations").cast("double"))
    once = F.when(F.col("pages") < 2, F.lit(1.0))
    importance = once.otherwise((1.0 - constant) * by_shown + constant * by_content)
    by_content = once.otherwise(by_content).alias("content_importance")
    return sums.select("host", "path", "tag", "pages", "presentations", "contents", by_content, importance.alias("importance"))


def low_paths(tree: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, low): paths of repeated contents, those of paragraphs and headings too, as they decide on the branches around them."""
    low = tree.where(
        (F.col("importance") < threshold) & (F.col("content_importance") < threshold) & (F.col("pages") >= min_pages)
    )
    return low.groupBy("host").agg(F.collect_set("path").alias("low"))


def extract_pages(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    NULL or empty html: empty text. NULL url: the host without a name. Repeated pages are pages of their own. Hosts with fewer than
    ``min_pages`` pages are pruned by their markup alone. An empty table gives an empty result. Other columns are ignored.
    """
    rules = materialize(low_paths(style_tree(pages), threshold, min_pages), "site-rules")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(rules, "host", "left")

    def run(batches):
        for batch in batches:
            texts = []
            for html, low in zip(batch.column(2), batch.column(3)):
                texts.append(main_text(parse(html.as_py() or ""), frozenset(low.as_py() or ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.select(F.col("page_id").cast("long"), "url", "html", "low").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
