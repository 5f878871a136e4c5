"""Office files by the standard library: spreadsheets, documents, slides, legacy documents."""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections import defaultdict

from folioforge.functions.tables import Table, render_markdown, shape


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _find(e: ET.Element, name: str) -> ET.Element | None:
    return next((x for x in e.iter() if _local(x) == name), None)


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    out = {}
    for r in ET.fromstring(z.read(path)):
        target = r.get("Target", "")
        if r.get("TargetMode") != "External":
            steps = (target.lstrip("/") if target.startswith("/") else f"{folder}/{target}").split("/")
            clean: list[str] = []
            for s in steps:
                clean = clean[:-1] if s == ".." else [*clean, s]
            target = "/".join(clean)
        out[r.get("Id", "")] = target
    return out


# --- spreadsheets ------------------------------------------------------------------------------


def sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cells) of every sheet of an .xlsx file, in order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
    rels = _rels(z, "xl/workbook.xml")
    out = []
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter():
        if _local(s) != "sheet":
            continue
        rows: list[list[str]] = []
        for r in ET.fromstring(z.read(rels[_attr(s, "id") or ""])).iter():
            if _local(r) != "row":
                continue
            at = int(r.get("r", len(rows) + 1)) - 1
            rows += [[] for _ in range(at - len(rows))]
            row: list[str] = []
            for c in r:
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                col = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(row)
                row += [""] * (col - len(row))
                v, kind = next((x.text or "" for x in c if _local(x) == "v"), ""), c.get("t")
                if kind == "s" and v:
                    v = shared[int(v)]
                elif kind == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
                elif kind == "b":
                    v = "True" if v == "1" else "False"
                row.append(v)
            rows.append(row)
        out.append((s.get("name", ""), rows))
    return out


def sheet_blocks(rows: list[list[str]]) -> list[tuple[str, Table | str]]:
    """Text and table blocks: a blank row ends one; rows of a single filled cell are text,
    of two and more a table. Blank headers become ``col_i``."""
    out: list[tuple[str, Table | str]] = []
    now: list[list[str]] = []
    kind = ""

    def flush() -> None:
        if now and kind == "text":
            out.append(("text", "\n".join(next(c for c in r if c.strip()) for r in now)))
        elif now:
            width = max(map(len, now))
            used = [i for i in range(width) if any(i < len(r) and r[i].strip() for r in now)]
            t = shape([[r[i] if i < len(r) else "" for i in used] for r in now])
            t.header = [h.strip() or f"col_{i + 1}" for i, h in enumerate(t.header)]
            out.append(("table", t))
        now.clear()

    for r in [*rows, []]:
        filled = sum(bool(c.strip()) for c in r)
        mine = "" if not filled else "text" if filled == 1 else "table"
        if mine != kind:
            flush()
            kind = mine
        if mine:
            now.append(r)
    return out


def sheet_markdown(rows: list[list[str]]) -> str:
    return "\n\n".join(b if k == "text" else render_markdown(b) for k, b in sheet_blocks(rows))


# --- documents -----------------------------------------------------------------------------------


def _on(e: ET.Element | None) -> bool:
    return e is not None and (_attr(e, "val") or "true").lower() not in ("0", "false", "off", "no")


def to_roman(n: int) -> str:
    out = ""
    for v, s in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), ("M", "CM", "D", "CD", "C", "XC", "L", "XL", "X", "IX", "V", "IV", "I"), strict=True):
        out += s * (n // v)
        n %= v
    return out


def to_alpha(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def heading_level(text: str, bold: float) -> int | None:
    """The level that a bold line of 4 to 120 characters suggests: a number's depth + 1, 2 for
    a roman one, 2 for up to twelve words with a capital first and no stop last."""
    if not 4 <= len(text) <= 120 or bold < 0.75:
        return None
    if m := re.match(r"(\d+(?:\.\d+)*)[.)]?\s+\S", text):
        return min(6, max(2, m[1].count(".") + 2))
    if re.match(r"[IVXLCDM]+[.)]\s+\S", text):
        return 2
    if text[-1] not in ".!?" and len(text.split()) <= 12 and text[0].isupper():
        return 2
    return None


class _Styles:
    def __init__(self, z: zipfile.ZipFile) -> None:
        self.level: dict[str, int] = {}
        self.based: dict[str, str] = {}
        self.name: dict[str, str] = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")):
                key = _attr(s, "styleId")
                if _local(s) != "style" or not key:
                    continue
                for x in s.iter():
                    if _local(x) == "name":
                        self.name[key] = (_attr(x, "val") or "").lower()
                    elif _local(x) == "basedOn":
                        self.based[key] = _attr(x, "val") or ""
                    elif _local(x) == "outlineLvl":
                        self.level[key] = int(_attr(x, "val") or 9) + 1

    def heading(self, style: str | None) -> int | None:
        seen = set()
        while style and style not in seen:
            seen.add(style)
            if 1 <= self.level.get(style, 0) <= 6:
                return self.level[style]
            if m := re.match(r"heading (\d)", self.name.get(style, "")):
                return min(6, int(m[1]))
            if self.name.get(style) == "title":
                return 1
            style = self.based.get(style)
        return None


def _numbering(z: zipfile.ZipFile) -> dict[tuple[str, int], tuple[str, int]]:
    """(numId, level) -> (format, start)."""
    if "word/numbering.xml" not in z.namelist():
        return {}
    root = ET.fromstring(z.read("word/numbering.xml"))
    abstract = {}
    for a in root:
        if _local(a) == "abstractNum":
            for lv in a:
                if _local(lv) == "lvl":
                    fmt, start = _find(lv, "numFmt"), _find(lv, "start")
                    abstract[_attr(a, "abstractNumId"), int(_attr(lv, "ilvl") or 0)] = (_attr(fmt, "val") if fmt is not None else "decimal", int(_attr(start, "val") or 1) if start is not None else 1)
    out = {}
    for n in root:
        if _local(n) == "num":
            ref = _attr(_find(n, "abstractNumId"), "val")
            for (a, lv), v in abstract.items():
                if a == ref:
                    out[_attr(n, "numId"), lv] = v
            for o in n:
                if _local(o) == "lvlOverride" and (s := _find(o, "startOverride")) is not None:
                    key = (_attr(n, "numId"), int(_attr(o, "ilvl") or 0))
                    out[key] = (out.get(key, ("decimal", 1))[0], int(_attr(s, "val") or 1))
    return out


def docx_markdown(data: bytes) -> str:
    """Headings by style, outline or looks; lists with counters; bold, italic and links; tables; image signs."""
    z = zipfile.ZipFile(io.BytesIO(data))
    styles, numbers, rels = _Styles(z), _numbering(z), _rels(z, "word/document.xml")
    counters: dict[tuple[str, int], int] = {}
    body = _find(ET.fromstring(z.read("word/document.xml")), "body")
    out: list[str] = []

    def run(r: ET.Element) -> tuple[str, bool, bool]:
        props = next((x for x in r if _local(x) == "rPr"), None)
        text = ""
        for x in r:
            kind = _local(x)
            if kind == "t":
                text += x.text or ""
            elif kind == "tab":
                text += "\t"
            elif kind in ("br", "cr"):
                text += "\n"
            elif kind in ("drawing", "pict"):
                d = _find(x, "docPr")
                text += f"![{(_attr(d, 'descr') or _attr(d, 'name') or 'image') if d is not None else 'image'}]()"
        flag = lambda name: props is not None and _on(next((x for x in props if _local(x) == name), None))
        return text, flag("b"), flag("i")

    def paragraph(p: ET.Element) -> tuple[str, str, float]:
        """Markdown, plain text and share of bold characters."""
        parts: list[tuple[str, bool, bool, str]] = []
        for x in p:
            if _local(x) == "r":
                parts.append((*run(x), ""))
            elif _local(x) == "hyperlink":
                t = "".join(run(r)[0] for r in x.iter() if _local(r) == "r")
                parts.append((t, False, False, rels.get(_attr(x, "id") or "", "")))
            elif _local(x) in ("ins", "smartTag", "sdt"):
                parts += [(*run(r), "") for r in x.iter() if _local(r) == "r"]
        plain = "".join(t for t, _, _, _ in parts)
        heavy = sum(len(t.strip()) for t, b, _, _ in parts if b)
        md = ""
        for t, b, i, link in parts:
            core = t.strip()
            if core and (b or i or link):
                mark = "**" * b + "*" * i
                core = f"[{core}]({link})" if link else f"{mark}{core}{mark[::-1]}"
                t = t[: len(t) - len(t.lstrip())] + core + t[len(t.rstrip()) :]
            md += t
        return md.replace("****", "").strip(), plain.strip(), heavy / max(1, len(plain.strip()))

    for e in body if body is not None else ():
        if _local(e) == "tbl":
            rows = []
            for tr in e:
                if _local(tr) == "tr":
                    rows.append([" ".join(filter(None, (paragraph(p)[0] for p in tc.iter() if _local(p) == "p"))) for tc in tr if _local(tc) == "tc"])
            if rows:
                out.append(render_markdown(shape(rows)))
            continue
        if _local(e) != "p":
            continue
        md, plain, bold = paragraph(e)
        if not plain:
            continue
        style, outline, num = _find(e, "pStyle"), _find(e, "outlineLvl"), _find(e, "numPr")
        level = int(_attr(outline, "val") or 9) + 1 if outline is not None else styles.heading(_attr(style, "val") if style is not None else None)
        if level and level <= 6:
            out.append(f"{'#' * level} {plain}")
        elif num is not None:
            lv, key = _find(num, "ilvl"), _find(num, "numId")
            depth, key = int(_attr(lv, "val") or 0) if lv is not None else 0, _attr(key, "val") if key is not None else "0"
            fmt, start = numbers.get((key, depth), ("bullet", 1))
            counters[key, depth] = counters.get((key, depth), start - 1) + 1
            for k in [k for k in counters if k[0] == key and k[1] > depth]:
                del counters[k]
            n = counters[key, depth]
            mark = {"bullet": "-", "lowerRoman": to_roman(n).lower() + ".", "upperRoman": to_roman(n) + ".", "lowerLetter": to_alpha(n) + ".", "upperLetter": to_alpha(n).upper() + "."}.get(fmt, f"{n}.")
            out.append(f"{'  ' * depth}{mark} {md}")
        elif guess := heading_level(plain, bold):
            out.append(f"{'#' * guess} {plain}")
        else:
            out.append(md)
    return "\n\n".join(out)


# --- slides -----------------------------------------------------------------------------------------


def chart_table(title: str | None, categories: list[str], series: list[tuple[str, list[str]]]) -> str:
    """Categories by series as markdown; names that are missing are numbered."""
    n = max([len(categories), *(len(v) for _, v in series)], default=0)
    header = ["Category", *[name or f"Series {i + 1}" for i, (name, _) in enumerate(series)]]
    rows = [[(categories[i] if i < len(categories) else "") or f"Item {i + 1}", *[v[i] if i < len(v) else "" for _, v in series]] for i in range(n)]
    return (f"**{title}**\n\n" if title else "") + render_markdown(Table(header, rows))


def smartart_bullets(names: dict[str, str], edges: list[tuple[str, str]]) -> str:
    """Nested bullets, depth first from points that nothing leads to, each once."""
    below = defaultdict(list)
    for a, b in edges:
        below[a].append(b)
    targets, seen, out = {b for _, b in edges}, set(), []

    def visit(k: str, depth: int) -> None:
        if k in seen:
            return
        seen.add(k)
        if names.get(k):
            out.append(f"{'  ' * depth}- {names[k]}")
            depth += 1
        for b in below[k]:
            visit(b, depth)

    for k in names:
        if k not in targets:
            visit(k, 0)
    return "\n".join(out)


def _shape_texts(e: ET.Element) -> str:
    lines = []
    for p in e.iter():
        if _local(p) == "p":
            t = "".join(x.text or "" if _local(x) == "t" else "\n" if _local(x) == "br" else "" for x in p.iter() if _local(x) in ("t", "br")).strip()
            if t:
                props = next((x for x in p if _local(x) == "pPr"), None)
                lines.append("  " * int(props.get("lvl", 0) if props is not None else 0) + t)
    return "\n".join(lines)


def _chart(z: zipfile.ZipFile, part: str) -> str:
    root = ET.fromstring(z.read(part))
    values = lambda e: [v.text or "" for v in e.iter() if _local(v) == "v"] if e is not None else []
    title = _find(root, "title")
    series, categories = [], []
    for s in root.iter():
        if _local(s) == "ser":
            tx, cat, val = (next((x for x in s if _local(x) == k), None) for k in ("tx", "cat", "val"))
            categories = categories or values(cat)
            series.append((" ".join(values(tx)), values(val)))
    return chart_table("".join(t.text or "" for t in title.iter() if _local(t) == "t") if title is not None else None, categories, series)


def pptx_markdown(data: bytes, notes: bool = True) -> str:
    """``# Slide n: title``, then texts, tables, charts and diagrams in order, groups entered, notes."""
    z = zipfile.ZipFile(io.BytesIO(data))
    rels = _rels(z, "ppt/presentation.xml")
    out = []
    slides = [rels[_attr(s, "id") or ""] for s in ET.fromstring(z.read("ppt/presentation.xml")).iter() if _local(s) == "sldId"]
    for n, part in enumerate(slides, 1):
        own, title, parts = _rels(z, part), "", []

        def enter(tree: ET.Element) -> None:
            nonlocal title
            for e in tree:
                kind = _local(e)
                if kind == "grpSp":
                    enter(e)
                elif kind == "sp":
                    ph, text = _find(e, "ph"), _shape_texts(e)
                    if ph is not None and ph.get("type") in ("title", "ctrTitle") and not title:
                        title = text.replace("\n", " ")
                    elif text:
                        parts.append(text)
                elif kind == "pic":
                    d = _find(e, "cNvPr")
                    parts.append(f"![{(d.get('descr') or d.get('name') or 'image') if d is not None else 'image'}]()")
                elif kind == "graphicFrame":
                    if (t := _find(e, "tbl")) is not None:
                        parts.append(render_markdown(shape([[_shape_texts(c).replace("\n", " ") for c in r if _local(c) == "tc"] for r in t if _local(r) == "tr"])))
                    elif (c := _find(e, "chart")) is not None and own.get(_attr(c, "id") or "") in z.namelist():
                        parts.append(_chart(z, own[_attr(c, "id") or ""]))
                    elif (d := _find(e, "relIds")) is not None and own.get(_attr(d, "dm") or "") in z.namelist():
                        model = ET.fromstring(z.read(own[_attr(d, "dm") or ""]))
                        names = {p.get("modelId", ""): _shape_texts(p).replace("\n", " ") for p in model.iter() if _local(p) == "pt"}
                        parts.append(smartart_bullets(names, [(c.get("srcId", ""), c.get("destId", "")) for c in model.iter() if _local(c) == "cxn" and c.get("type", "parOf") == "parOf"]))

        tree = _find(ET.fromstring(z.read(part)), "spTree")
        if tree is not None:
            enter(tree)
        if notes:
            for target in own.values():
                if "notesSlide" in target and target in z.namelist():
                    body = [_shape_texts(s) for s in ET.fromstring(z.read(target)).iter() if _local(s) == "sp" and (p := _find(s, "ph")) is not None and p.get("type") == "body"]
                    if any(body):
                        parts.append("Notes:\n" + "\n".join(filter(None, body)))
        out.append("\n\n".join([f"# Slide {n}" + (f": {title}" if title else ""), *filter(None, parts)]))
    return "\n\n".join(out)


# --- legacy documents ---------------------------------------------------------------------------------


class OleError(ValueError):
    """No compound file, or one that can't be read."""


def ole_streams(data: bytes) -> dict[str, bytes]:
    """Streams by name of a compound file."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise OleError("no compound file")
    shift, mini = struct.unpack_from("<HH", data, 30)
    size = 1 << shift
    directory, _, cutoff, mini_fat, _, difat, n_difat = struct.unpack_from("<IIIIIII", data, 48)
    sector = lambda i: data[size * (i + 1) : size * (i + 2)]
    fat_sectors = [x for x in struct.unpack_from("<109I", data, 76) if x < 0xFFFFFFFA]
    for _ in range(n_difat):
        block = struct.unpack(f"<{size // 4}I", sector(difat))
        fat_sectors += [x for x in block[:-1] if x < 0xFFFFFFFA]
        difat = block[-1]
    fat = [x for s in fat_sectors for x in struct.unpack(f"<{size // 4}I", sector(s))]

    def chain(i: int, table: list[int], read) -> bytes:
        out, seen = [], set()
        while i < len(table) and i not in seen:
            seen.add(i)
            out.append(read(i))
            i = table[i]
        return b"".join(out)

    entries = chain(directory, fat, sector)
    raw_mini = chain(mini_fat, fat, sector)
    minis = list(struct.unpack(f"<{len(raw_mini) // 4}I", raw_mini))
    streams, root = {}, b""
    for at in range(0, len(entries), 128):
        e = entries[at : at + 128]
        n, kind = struct.unpack_from("<HB", e, 64)
        first, length = struct.unpack_from("<II", e, 116)
        name = e[: max(0, n - 2)].decode("utf-16-le", "replace")
        if kind == 5:
            root = chain(first, fat, sector)
        elif kind == 2:
            if length < cutoff:
                streams[name] = chain(first, minis, lambda i: root[i << mini : (i + 1) << mini])[:length]
            else:
                streams[name] = chain(first, fat, sector)[:length]
    return streams


def clean_doc_text(text: str) -> str:
    """Field codes go, their results stay; cell marks become tabs, paragraph marks lines."""
    out, depth, code = [], 0, []
    for c in text:
        if c == "\x13":
            depth += 1
            code.append(True)
        elif c == "\x14" and code:
            code[-1] = False
        elif c == "\x15" and code:
            code.pop()
            depth -= 1
        elif not any(code):
            out.append({"\x07": "\t", "\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x1e": "-", "\x1f": "", "\xa0": " "}.get(c, c if c >= " " or c in "\t\n" else ""))
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def doc_text(data: bytes, clean: bool = True) -> str:
    """The text of a legacy .doc by its piece table; encrypted and obfuscated files are refused."""
    streams = ole_streams(data)
    word = streams.get("WordDocument", b"")
    if len(word) < 0x1AA or struct.unpack_from("<H", word)[0] != 0xA5EC:
        raise OleError("no Word document")
    flags = struct.unpack_from("<H", word, 10)[0]
    if flags & 0x0100 or flags & 0x8000:
        raise OleError("the document is encrypted")
    table = streams.get("1Table" if flags & 0x0200 else "0Table", b"")
    at, length = struct.unpack_from("<II", word, 0x1A2)
    clx = table[at : at + length]
    i = 0
    while i < len(clx) and clx[i] == 1:
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    if i >= len(clx) or clx[i] != 2:
        raise OleError("no piece table")
    size = struct.unpack_from("<I", clx, i + 1)[0]
    plc = clx[i + 5 : i + 5 + size]
    n = (size - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", plc)
    parts = []
    for k in range(n):
        fc = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * k + 2)[0]
        count = ends[k + 1] - ends[k]
        if fc & 0x40000000:
            start = (fc & 0x3FFFFFFF) // 2
            parts.append(word[start : start + count].decode("cp1252", "replace"))
        else:
            parts.append(word[fc : fc + 2 * count].decode("utf-16-le", "replace"))
    text = "".join(parts)
    return clean_doc_text(text) if clean else text
