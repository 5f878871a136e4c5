"""Main text of pages by site style trees.

The pages of a host are merged into one tree: an element node stands for the
elements reached by one path of tags and classes, with the child sequences
(presentations) seen under it; a text node for what stands in it. A node whose
presentations and contents are the same on page after page has low entropy and is
site furniture. Contents are judged one by one, by the information of each, whose mean
is the entropy: of siblings with one path only the repeated ones are unimportant.
Within an article a repeated content goes only if its whole node is unimportant, so
that a recurring paragraph among others stays, and elements within a block's text
aren't judged there.
Branches of low importance, and elements whose tag or class says
what they are, are taken out of each page; the blocks that are left are the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import batch_of, discard, in_arrow, materialize, slices

#: An end tag or a start tag that the page's end cuts off swallows the rest, as in browsers.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: What never is main text, by tag and by words in class, id or role.
FURNITURE = frozenset("head script style title noscript template iframe textarea nav footer header aside form button select input label dialog menu svg object embed canvas audio video xmp".split())
_ANYWHERE = r"ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|side-?bar|foot(?:er)?|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|related|comments?|respond|replies|disqus|widget|pagination|pager|toolbar|login|signup"
_NAMED = re.compile(rf"(?:^|[\s_-])(?:{_ANYWHERE}|header|masthead|social)(?:$|[\s_-])", re.I)
_NAMED_IN_ARTICLE = re.compile(rf"(?:^|[\s_-])(?:{_ANYWHERE})(?:$|[\s_-])", re.I)
_IN_ARTICLE = frozenset(("article", "main"))
#: Names say nothing of these within an article: they are its text.
_TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li td th tr dt dd figcaption em strong b i a span code".split())
#: A <p> ends before these.
_ENDS_P = BLOCKS
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


@dataclass(frozen=True)
class StyleParams:
    """A content that at least ``pages`` distinct pages of its host have at one node is judged by
    its information, in [0, 1]; below ``least`` the branches with it go. Up to ``shared`` such
    contents (8 bytes each) go to every task; more are joined to pages by shuffle."""

    pages: int = 8
    least: float = 0.2
    shared: int = 2_000_000


class Node:
    """``key``: the path of tags and names; ``shape``: the kinds of its children; ``content``: path,
    shapes and texts of the whole branch; all as hashes that the host is part of."""

    __slots__ = ("tag", "key", "name", "parent", "children", "article", "size", "holds", "shape", "content")

    def __init__(self, tag: str, key: int, name: str, parent: Node | None) -> None:
        self.tag, self.key, self.name, self.parent = tag, key, name, parent
        self.children: list[Node | str] = []
        self.article = tag in _IN_ARTICLE or (parent is not None and parent.article)
        self.size, self.holds, self.shape, self.content = 0, False, 0, 0


def parse(html: str, host: str = "") -> Node:
    """A tree of elements and texts; any input gives one, in time about proportional to its
    length. References are decoded text by text. ``p``, list and table items end where the next
    begins; an end tag without a start is nothing."""
    root = Node("", hash64(host), "", None)
    at, now, size = 0, root, len(html)
    opened: Counter = Counter()

    def leave(to: Node) -> None:
        nonlocal now
        while now is not to:
            opened[now.tag] -= 1
            now = now.parent

    def add(text: str) -> None:
        now.children.append(unescape(text) if "&" in text else text)

    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag]:
                n = now
                while n.tag != tag:
                    n = n.parent
                leave(n.parent)
            continue
        if tag in _ENDS_P and opened["p"] and tag not in ("html", "body"):
            n = now
            while n is not root and n.tag not in ("article", "div", "section", "td", "th", "li", "body", "main", "table", "blockquote", "aside", "nav", "form", "button"):
                if n.tag == "p":
                    leave(n.parent)
                    break
                n = n.parent
        if tag in _SAME and any(opened[t] for t in _SAME[tag]):
            n, last = now, None
            while n is not root and n.tag not in ("ul", "ol", "dl", "table", "select", "menu", "tbody", "thead", "tfoot"):
                if n.tag in _SAME[tag]:
                    last = n
                n = n.parent
            if last is not None:
                leave(last.parent)
        name = ""
        if m[3] and "=" in m[3]:
            name = " ".join(v or w or x for k, v, w, x in _ATTRIBUTE.findall(m[3]) if k.lower() in ("class", "id", "role"))
        node = Node(tag, hash64(f"{now.key}/{tag}.{name}"), name, now)
        now.children.append(node)
        if tag in _IN_ARTICLE:
            n = node
            while n is not None and not n.holds:
                n.holds, n = True, n.parent
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            stop = end.start() if end else size
            if tag not in ("script", "style"):
                node.children.append(html[at:stop])
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            opened[tag] += 1
            now = node
    measure(root)
    return root


def measure(root: Node) -> None:
    """From the leaves up: of each element the characters of text below it (``size``), and the
    hashes of its shape and content."""
    order = [root]
    for n in order:
        order += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        shape, parts = [], []
        for c in n.children:
            if isinstance(c, Node):
                shape.append(c.tag)
                parts.append(str(c.content))
                n.size += c.size
            else:
                shape.append("#")
                if text := _SPACE.sub(" ", c).strip():
                    parts.append("#" + text)
                    n.size += len(text)
        n.shape = hash64(",".join(shape))
        n.content = hash64(f"{n.key}\0{n.shape}\0" + "\0".join(parts))


def is_furniture(node: Node, root: Node) -> bool:
    """By what the element says of itself. An element that holds an article is none by its
    name, nor is one that has most of the text of a page without an article. Within an
    article only what can't be its text is furniture."""
    if node.tag in ("html", "body", "article", "main", ""):
        return False
    if node.tag in FURNITURE and not (node.article and node.tag in ("header", "label")) and not (node.holds and node.tag in ("form", "label")):
        return True
    if not node.name or node.holds or node.article and node.tag in _TEXTUAL:
        return False
    if not root.holds and 2 * node.size > root.size:
        return False
    return bool((_NAMED_IN_ARTICLE if node.article else _NAMED).search(node.name))


def is_main(node: Node, root: Node) -> bool:
    """What is never cut as a whole, whatever its importance: the root nodes, and a node that
    has an article or most of the page's text below it."""
    return node.tag in ("html", "body", "") or node.holds or 2 * node.size > root.size


def judged(node: Node) -> bool:
    """All elements but the root nodes and articles themselves; within articles only blocks."""
    return node.tag not in ("html", "body", "", *_IN_ARTICLE) and (not node.article or node.tag in BLOCKS)


def seen_of(root: Node) -> Iterator[Node]:
    """The root and all elements that aren't furniture by themselves."""
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack += [c for c in n.children if isinstance(c, Node) and not is_furniture(c, root)]


def observe(html: str, host: str = "") -> tuple[int, list[tuple[int, int, int, bool]]]:
    """A hash of the page's text, and (hashes of the node key, its presentation, its content;
    whether it is in an article) for each element of the page that isn't furniture by
    itself; equal ones once."""
    out, texts = {}, [host]
    root = parse(html, host)
    for n in seen_of(root):
        texts += [c for c in n.children if isinstance(c, str)]
        if judged(n):
            out[(n.key, n.shape, n.content, n.article)] = None
    return hash64("\n".join(texts)), list(out)


def hash64(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def blocks_of(html: str, low: np.ndarray, host: str = "") -> str:
    """The page's text without furniture and the branches with a content in ``low`` (sorted):
    blocks joined by newlines. A page that would lose all of its text keeps those branches."""
    root = parse(html, host)
    cut: set[int] = set()
    if len(low):
        own = np.array([n.content for n in seen_of(root) if judged(n) and not is_main(n, root)], np.int64)
        at = np.minimum(np.searchsorted(low, own), len(low) - 1)
        cut = set(own[low[at] == own].tolist())
    return _blocks(root, cut) or (_blocks(root, set()) if cut else "")


def _blocks(root: Node, cut: set[int]) -> str:
    out: list[str] = []
    inline: list[str] = []

    def close() -> None:
        if inline:
            text = _SPACE.sub(" ", "".join(inline).replace("\xa0", " ")).strip()
            if text:
                out.append(text)
            inline.clear()

    stack: list[tuple[int, Node | str]] = [(0, root)]
    while stack:
        kind, n = stack.pop()
        if isinstance(n, str):
            inline.append(n)
        elif kind:
            close()
        elif is_furniture(n, root) or n.content in cut and judged(n) and not is_main(n, root):
            if n.tag in BLOCKS:
                close()
            continue
        elif n.tag == "br":
            inline.append(" ")
        else:
            if n.tag in BLOCKS:
                close()
                stack.append((1, n))
            stack += [(0, c) for c in reversed(n.children)]
    close()
    return "\n".join(out)


def importance(nodes: DataFrame) -> DataFrame:
    """``(node, shape, content)`` -> ``pages`` and ``importance`` of each style node: the
    greater of the normalised entropies of its presentations and of its contents
    (0: the same everywhere; 1: another one on every page). Counts are aggregated by
    value first and then by node, so a host with a third of all pages is as many
    partial sums as it has distinct values, not one task's rows."""

    def entropy(column: str) -> DataFrame:
        n = nodes.groupBy("node", column).agg(F.count(F.lit(1)).alias("c"))
        return n.groupBy("node").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("s")).select(
            "node", "m", F.when(F.col("m") > 1, (F.log(F.col("m").cast("double")) - F.col("s") / F.col("m")) / F.log(F.col("m").cast("double"))).otherwise(1.0).alias("e")
        )

    shape, content = entropy("shape"), entropy("content").select("node", F.col("e").alias("ec"))
    return shape.join(content, "node").select("node", F.col("m").alias("pages"), F.greatest("e", "ec").alias("importance"))


def information(nodes: DataFrame, pages: int = 1) -> DataFrame:
    """``(node, content, first)``, a row for each content of a node on each distinct page
    (the node's ``first`` row there says so) -> ``pages`` and ``information`` of each content that
    ``pages`` pages have at least: how unexpected it is on a page with the node, from 0 (all
    pages have it) to 1 (a single one). Only such contents meet their node again."""
    n = nodes.groupBy("node", "content").agg(F.count(F.lit(1)).alias("pages"), F.sum("first").alias("f"))
    with_node = n.groupBy("node").agg(F.sum("f").alias("m"))
    log = lambda c: F.log(F.col(c).cast("double"))
    return n.where(F.col("pages") >= pages).join(with_node, "node").select("node", "content", "pages", F.when(F.col("m") > 1, 1 - log("pages") / log("m")).otherwise(1.0).alias("information"))


_OBSERVED = pa.schema([("html_key", pa.int64()), ("page", pa.int64()), ("node", pa.list_(pa.int64())), ("shape", pa.list_(pa.int64())), ("content", pa.list_(pa.int64())), ("inside", pa.list_(pa.bool_())), ("first", pa.list_(pa.int32()))])
_OBSERVED_DDL = "html_key long, page long, node array<long>, shape array<long>, content array<long>, inside array<boolean>, first array<int>"
_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
_TEXT_DDL = "page_id long, url string, text string, n_chars long"


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def unimportant(pages: DataFrame, params: StyleParams = StyleParams()) -> tuple[DataFrame, DataFrame, list[str]]:
    """Pass one and the judgement: the contents of low information (``content``), what each page
    was seen to have (``html_key, content`` arrays), and the folders that hold them."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                rows = []
                for url, html, key in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if html:
                        page, found = observe(html, host_of(url))
                        starts = dict.fromkeys(x[0] for x in found)
                        first = [int(starts.pop(x[0], 0) is None) for x in found]
                        rows.append((key, page, *([x[i] for x in found] for i in range(4)), first))
                yield batch_of(_OBSERVED, **{f.name: [r[i] for r in rows] for i, f in enumerate(_OBSERVED)})

    observed, path = materialize(in_arrow(pages.select("url", "html", _html_key().alias("html_key")), look, _OBSERVED_DDL).dropDuplicates(["html_key", "page"]), "style-nodes")
    one = observed.dropDuplicates(["page"]).select(F.inline(F.arrays_zip("node", "shape", "content", "inside", "first")))
    seen, seen_path = materialize(one, "style-seen")
    repeated = information(seen, params.pages).where(F.col("information") < params.least).select("node", "content")
    varied = importance(seen.where("inside")).where(F.col("importance") >= params.least).select("node")
    low, low_path = materialize(repeated.join(varied, "node", "left_anti").select("content").distinct(), "style-low")
    return low, observed, [path, seen_path, low_path]


def _html_key() -> F.Column:
    return F.xxhash64("html", "url")


def extract(pages: DataFrame, params: StyleParams = StyleParams()) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``page_id, url, text, n_chars`` for every row.

    One pass observes the style nodes, an aggregation judges them, a second pass over
    the pages takes the branches with unimportant contents out. Pages of a host with equal texts count
    as one, so copies don't make a content unimportant. Contents of low information go to
    the second pass as one sorted array while they are ``params.shared`` at most (counted first);
    beyond that each page meets its own ones in a join by a hash of the page, whose hot
    keys (copies) hold no list longer than one page has elements. A null html
    gives an empty text; a page without a host is judged with others that have none.
    Rows keep their multiplicity, null and repeated page_ids too; other columns aren't read; no page gives no row.
    """
    spark = pages.sparkSession
    low, observed, paths = unimportant(pages, params)
    few = low.count() <= params.shared
    if few:
        known = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in low.toLocalIterator()], np.int64)))
        rows = pages.select("page_id", "url", "html")
        discard(spark, *paths)
    else:
        own = observed.select("html_key", F.explode("content").alias("content")).distinct().join(low, "content", "left_semi").groupBy("html_key").agg(F.collect_list("content").alias("low"))
        rows = pages.select("page_id", "url", "html", _html_key().alias("html_key")).join(own, "html_key", "left").select("page_id", "url", "html", "low")
        known = None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 2):
                own = [known.value] * len(part) if known is not None else [np.sort(np.array(x or [], np.int64)) for x in part.column(3).to_pylist()]
                texts = [blocks_of(html, x, host_of(url)) if html else "" for url, html, x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), own, strict=True)]
                yield batch_of(_TEXT, page_id=part.column(0), url=part.column(1), text=texts, n_chars=[len(t) for t in texts])

    return in_arrow(rows, cut, _TEXT_DDL)
