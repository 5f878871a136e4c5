"""A tolerant HTML tree and its block model, on the standard library's tokenizer."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field, replace
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_CONTENT = frozenset(("script", "style", "noscript", "template"))
BLOCK = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "table", "pre", "blockquote"))
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_WALLS = {"p": {"div", "article", "section", "td", "th", "li", "body", "blockquote"}, "li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)
    parent: Element | None = field(default=None, repr=False)

    def walk(self):
        yield self
        for c in self.children:
            if isinstance(c, Element):
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("")

    def handle_starttag(self, tag: str, attrs) -> None:
        closes = _CLOSES.get(tag) or ({"p"} if tag in BLOCK or tag in ("div", "article", "section") else None)
        if closes:
            n, walls = self.now, _WALLS.get(tag, _WALLS["p"])
            while n.parent is not None and n.tag not in walls:
                if n.tag in closes:
                    self.now = n.parent
                n = n.parent
        e = Element(tag, {k: v or "" for k, v in attrs}, [], self.now)
        self.now.children.append(e)
        if tag not in VOID:
            self.now = e

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.now.children.append(Element(tag, {k: v or "" for k, v in attrs}, [], self.now))

    def handle_endtag(self, tag: str) -> None:
        n = self.now
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.now = n.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def parse(html: str) -> Element:
    """Any text gives a tree; ``p``, list items and cells end where the next begins."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def parse_strict(html: str) -> Element:
    """Only well-formed XML; else ``xml.etree.ElementTree.ParseError``."""

    def convert(e: ET.Element, parent: Element | None) -> Element:
        out = Element(e.tag.rpartition("}")[2].lower(), dict(e.attrib), [], parent)
        if e.text:
            out.children.append(e.text)
        for c in e:
            out.children.append(convert(c, out))
            if c.tail:
                out.children.append(c.tail)
        return out

    return convert(ET.fromstring(html), None)


def squash(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def strip_content_free(e: Element) -> Element:
    e.children = [c for c in e.children if not (isinstance(c, Element) and c.tag in NOT_CONTENT)]
    for c in e.children:
        if isinstance(c, Element):
            strip_content_free(c)
    return e


def prune_empty_lists(e: Element) -> Element:
    for c in e.children:
        if isinstance(c, Element):
            prune_empty_lists(c)
    e.children = [c for c in e.children if not (isinstance(c, Element) and c.tag in ("ul", "ol", "li") and not squash(c.text()) and not any(x.tag == "img" for x in c.walk()))]
    return e


def serialize(e: Element) -> str:
    inner = "".join(escape(c, quote=False) if isinstance(c, str) else serialize(c) for c in e.children)
    if not e.tag:
        return inner
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in e.attrs.items())
    return f"<{e.tag}{attrs}>" if e.tag in VOID else f"<{e.tag}{attrs}>{inner}</{e.tag}>"


def _escape_markdown(s: str) -> str:
    return re.sub(r"([\\`*_])", r"\\\1", s)


def inline_markdown(e: Element | str) -> str:
    if isinstance(e, str):
        return _escape_markdown(re.sub(r"\s+", " ", e))
    inner = "".join(map(inline_markdown, e.children))
    if e.tag == "br":
        return "\n"
    if e.tag in ("strong", "b") and inner.strip():
        return f"**{inner.strip()}**"
    if e.tag in ("em", "i") and inner.strip():
        return f"*{inner.strip()}*"
    if e.tag == "code":
        return f"`{e.text()}`"
    if e.tag == "a" and e.attrs.get("href"):
        return f"[{inner.strip()}]({e.attrs['href']})"
    if e.tag == "img":
        return f"![{e.attrs.get('alt', '')}]({e.attrs.get('src', '')})"
    return inner


def _tidy(s: str) -> str:
    return "\n".join(squash(x) for x in s.split("\n")).strip()


def list_markdown(e: Element, depth: int = 0) -> str:
    lines, n = [], 0
    for item in e.children:
        if isinstance(item, Element) and item.tag == "li":
            n += 1
            inline = [c for c in item.children if not (isinstance(c, Element) and c.tag in ("ul", "ol"))]
            mark = f"{n}." if e.tag == "ol" else "-"
            lines.append(f"{'  ' * depth}{mark} {squash(''.join(map(inline_markdown, inline)))}".rstrip())
            lines += [list_markdown(c, depth + 1) for c in item.children if isinstance(c, Element) and c.tag in ("ul", "ol")]
    return "\n".join(x for x in lines if x.strip())


def table_rows(e: Element) -> list[list[str]]:
    """Cells of every row below, those of nested tables too, padded to the widest."""
    rows = [[squash(c.text()) for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")] for r in e.walk() if r.tag == "tr"]
    width = max(map(len, rows), default=0)
    if not width:
        raise ValueError("a table without cells")
    return [r + [""] * (width - len(r)) for r in rows]


@dataclass
class Block:
    kind: str
    markdown: str
    html: str
    level: int | None = None
    title: str | None = None
    rows: list[list[str]] | None = None


def blocks(e: Element) -> list[Block]:
    """Headings, paragraphs, lists, tables, preformatted and quoted text in order; other
    elements are entered, loose text is a block."""
    from folioforge.functions.tables import render_markdown, shape

    out: list[Block] = []
    loose: list[str] = []

    def flush() -> None:
        text = _tidy("".join(loose))
        if text:
            out.append(Block("text", text, escape(text, quote=False)))
        loose.clear()

    def enter(x: Element) -> None:
        for c in x.children:
            if isinstance(c, str):
                loose.append(inline_markdown(c))
            elif c.tag in NOT_CONTENT or c.tag in ("head", "title"):
                continue
            elif c.tag not in BLOCK:
                if any(y.tag in BLOCK for y in c.walk()):
                    flush()
                    enter(c)
                    flush()
                else:
                    loose.append(inline_markdown(c))
            else:
                flush()
                if c.tag[0] == "h":
                    title, level = squash(c.text()), int(c.tag[1])
                    if title:
                        out.append(Block("heading", f"{'#' * level} {_tidy(inline_markdown(c))}", serialize(c), level, title))
                elif c.tag in ("ul", "ol"):
                    md = list_markdown(c)
                    if md:
                        out.append(Block("list", md, serialize(c)))
                elif c.tag == "table":
                    try:
                        rows = table_rows(c)
                    except ValueError:
                        continue
                    out.append(Block("table", render_markdown(shape(rows)), serialize(c), rows=rows))
                elif c.tag == "pre":
                    out.append(Block("code", f"```\n{c.text().strip()}\n```", serialize(c)))
                else:
                    md = _tidy("".join(map(inline_markdown, c.children)))
                    if md:
                        out.append(Block("quote" if c.tag == "blockquote" else "text", "\n".join("> " + x for x in md.split("\n")) if c.tag == "blockquote" else md, serialize(c)))

    enter(e)
    flush()
    return out


def to_markdown(html: str) -> str:
    return "\n\n".join(b.markdown for b in blocks(strip_content_free(parse(html))))


def to_html(html: str) -> str:
    return "\n".join(b.html for b in blocks(strip_content_free(parse(html))))


def render_table_html(header: list[str], rows: list[list[str]]) -> str:
    cells = lambda tag, r: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in r) + "</tr>"
    return "<table>" + cells("th", header) + "".join(cells("td", r) for r in rows) + "</table>"


def split_html(html: str, max_rows: int | None = None, first_is_header: bool = True, parents: bool = False) -> list[dict]:
    """Text between headings and tables, with level, path of titles and nearest heading's
    segment; tables apart, by rows if a limit is given."""
    from folioforge.functions.tables import chunk_rows, render_markdown, shape

    out: list[dict] = []
    stack: list[tuple[int, str, int]] = []
    body: list[str] = []
    head: list[str] = []

    def add(content: str, kind: str) -> None:
        above = "\n\n".join(f"{'#' * lv} {t}" for lv, t, _ in stack[:-1]) if parents else ""
        here = len(out)
        parent = next((s for _, _, s in reversed(stack[:-1] if kind == "text" and head else stack) if s >= 0), None)
        out.append({"content": f"{above}\n\n{content}" if above else content, "type": kind, "level": stack[-1][0] if stack else 0, "path": [t for _, t, _ in stack[:-1]], "parent": parent, "index": here})
        if stack and stack[-1][2] < 0:
            stack[-1] = (*stack[-1][:2], here)

    def flush() -> None:
        text = "\n\n".join([*head, *body]).strip()
        if text:
            add(text, "text")
        head.clear()
        body.clear()

    for b in blocks(strip_content_free(parse(html))):
        if b.kind == "heading":
            flush()
            while stack and stack[-1][0] >= b.level:
                stack.pop()
            stack.append((b.level, b.title, -1))
            head.append(b.markdown)
        elif b.kind == "table":
            flush()
            table = shape(b.rows, first_is_header)
            for _, _, text in chunk_rows(table, render_markdown, max_rows) if max_rows else [(0, 0, render_markdown(table))]:
                add(text, "table")
        else:
            body.append(b.markdown)
    flush()
    return out


# --- links -----------------------------------------------------------------------------------


def classes(e: Element) -> list[str]:
    return list(dict.fromkeys(e.attrs.get("class", "").split()))


def has_rule(e: Element, rules: list[str]) -> bool:
    """Whether all words of one of the class rules are there."""
    own = set(classes(e))
    return any(r.split() and own.issuperset(r.split()) for r in rules)


def has_style(e: Element, parts: list[str]) -> bool:
    own = re.sub(r"\s+", "", e.attrs.get("style", "")).lower()
    return any(re.sub(r"\s+", "", p).lower() in own for p in parts)


def links(html: str, base: str, ignore: tuple[str, ...] = (), navigation: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> list[dict]:
    """Absolute http(s) links without fragment, the first of each, with classes (own and
    those around) and whether a navigation rule or text marks them."""
    out: dict[tuple[str, bool], dict] = {}

    def enter(e: Element, around: list[str], nav: bool) -> None:
        if has_rule(e, list(ignore)):
            return
        nav = nav or has_rule(e, list(navigation))
        around = list(dict.fromkeys([*around, *classes(e)]))
        if e.tag == "a" and e.attrs.get("href"):
            try:
                url = urljoin(base, e.attrs["href"].strip()).partition("#")[0]
            except ValueError:
                url = ""
            mine = nav or squash(e.text()) in texts
            if re.match(r"https?://[^/]", url, re.I) and (url, mine) not in out:
                out[url, mine] = {"url": url, "text": squash(e.text()), "classes": around, "is_navigation": mine}
        for c in e.children:
            if isinstance(c, Element):
                enter(c, around, nav)

    enter(parse(html), [], False)
    return list(out.values())


def cleanup(root: Element, ignore: list[str], styles: tuple[str, ...] = ()) -> Element:
    """Take out elements that a class rule or a part of their style marks."""
    for c in list(root.children):
        if isinstance(c, Element):
            if has_rule(c, ignore) or styles and has_style(c, list(styles)):
                root.children.remove(c)
            else:
                cleanup(c, ignore, styles)
    return root


def duplicate_signature(e: Element) -> str:
    """A digest of tag, text and sorted link targets: equal elements of several pages share it."""
    import hashlib

    targets = sorted(x.attrs["href"] for x in e.walk() if x.tag == "a" and x.attrs.get("href"))
    return hashlib.md5("\x1f".join([e.tag, squash(e.text()).lower(), *targets]).encode()).hexdigest()


def profile_urls(html: str, base: str, profile: str, *, attributes: tuple[str, ...] = ("href", "data-href", "data-url"), pattern: str = r"""(?:location(?:\.href)?\s*=|open\()\s*['"]([^'"]+)""", include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> list[str]:
    """URLs by a static profile: ``anchors``, ``attributes``, or ``onclick_regex`` (group 1 of
    the pattern). Filters are regular expressions; profiles that need a browser aren't here."""
    found: list[str] = []
    for e in parse(html).walk():
        if profile == "anchors":
            found += [e.attrs["href"]] if e.tag == "a" and e.attrs.get("href") else []
        elif profile == "attributes":
            found += [e.attrs[a] for a in attributes if e.attrs.get(a)]
        elif profile == "onclick_regex":
            found += re.findall(pattern, e.attrs.get("onclick", ""))
        else:
            raise ValueError(f"unknown static profile {profile!r}")
    urls = dict.fromkeys(urljoin(base, u.strip()).partition("#")[0] for u in found)
    return [u for u in urls if re.match("https?://", u) and (not include or any(re.search(p, u) for p in include)) and not any(re.search(p, u) for p in exclude)]


@dataclass(frozen=True)
class Profile:
    """A static link profile and its settings; they are checked when it is made."""

    kind: str = "anchors"
    attributes: tuple[str, ...] = ("href", "data-href", "data-url")
    pattern: str = r"""(?:location(?:\.href)?\s*=|open\()\s*['"]([^'"]+)"""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in ("anchors", "attributes", "onclick_regex"):
            raise ValueError(f"unknown static profile {self.kind!r}")
        if self.kind == "attributes" and not self.attributes:
            raise ValueError("a profile of attributes needs some")
        for p in (self.pattern, *self.include, *self.exclude):
            try:
                groups = re.compile(p).groups
            except re.error as e:
                raise ValueError(f"{p!r} is no regular expression: {e}") from e
            if p == self.pattern and self.kind == "onclick_regex" and groups < 1:
                raise ValueError("the pattern needs a group that has the link")

    def urls(self, html: str, base: str) -> list[str]:
        return profile_urls(html, base, self.kind, attributes=self.attributes, pattern=self.pattern, include=self.include, exclude=self.exclude)


#: Ready-made profiles.
PROFILES = {
    "links": Profile(),
    "data_links": Profile("attributes"),
    "script_links": Profile("onclick_regex"),
    "documents": Profile(include=(r"(?i)\.(?:pdf|docx?|pptx?|xlsx?|csv|json)(?:\?|$)",)),
}


def profile(name: str, **changes) -> Profile:
    """A ready-made profile with some settings changed."""
    if name not in PROFILES:
        raise ValueError(f"no profile {name!r}")
    return replace(PROFILES[name], **changes)


def composed_urls(html: str, base: str, profiles: list[Profile]) -> list[str]:
    """What several profiles find, in their order, each URL once."""
    return list(dict.fromkeys(u for p in profiles for u in p.urls(html, base)))


@dataclass(frozen=True)
class Navigation:
    """What marks the element that leads on: words of its class (or of one around it), parts of a style, its
    whole text; and texts that say forward or back."""

    classes: tuple[str, ...] = ()
    styles: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    forward: tuple[str, ...] = ("next",)
    backward: tuple[str, ...] = ("previous", "prev", "back")
    tags: tuple[str, ...] = ("a", "button")


def next_candidates(html: str, base: str, marks: Navigation) -> list[dict]:
    """Elements that may lead to the next state of a page, best first: 10 for a class or a style, 20 for the text, 100 for
    (or against) a text that says forward (or back), 80 for ``rel`` next, 60 for (or against) a label of next (or
    previous), 5 for a link. Of equal scores the shorter text, then the earlier element, comes first. Hidden and disabled
    elements are none. Clicking, and what a script makes visible, is up to a browser."""
    out = []
    forward, backward = ({squash(t).lower() for t in x} for x in (marks.forward, marks.backward))

    def enter(e: Element, by_class: bool, by_style: bool, hidden: bool) -> None:
        by_class = by_class or has_rule(e, list(marks.classes))
        by_style = by_style or bool(marks.styles) and has_style(e, list(marks.styles))
        hidden = hidden or "hidden" in e.attrs or has_style(e, ["display:none", "visibility:hidden", "pointer-events:none"])
        if e.tag in marks.tags and not hidden and "disabled" not in e.attrs and e.attrs.get("aria-disabled") != "true":
            label, href = e.attrs.get("aria-label", "").lower(), e.attrs.get("href", "").strip()
            text = squash(e.text() or e.attrs.get("aria-label", ""))
            by_text = text in {squash(t) for t in marks.texts}
            if by_class or by_style or by_text:
                score = 10 * by_class + 10 * by_style + 20 * by_text + 100 * (text.lower() in forward) - 100 * (text.lower() in backward)
                score += 80 * ("next" in e.attrs.get("rel", "").lower()) + 60 * ("next" in label) - 60 * ("prev" in label) + 5 * bool(href)
                out.append({"text": text, "url": urljoin(base, href) if href else None, "score": score})
        for c in e.children:
            if isinstance(c, Element):
                enter(c, by_class, by_style, hidden)

    enter(parse(html), False, False, False)
    return sorted(out, key=lambda x: (-x["score"], len(x["text"])))
