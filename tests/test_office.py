"""Office parsers on files built here."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest

from folioforge.functions import office

R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def rel(key, target, extra=""):
    return f'<Relationship Id="{key}" Target="{target}" {extra}/>'


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_xlsx():
    data = pack({
        "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="One" r:id="a"/><sheet name="Two" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format(rel("a", "worksheets/s1.xml") + rel("b", "worksheets/s2.xml")),
        "xl/sharedStrings.xml": "<sst><si><t>note</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>",
        "xl/worksheets/s1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3" t="inlineStr"><is><t>v|w</t></is></c></row><row r="4"><c r="A4"><v>1</v></c><c r="C4" t="b"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": "<worksheet><sheetData/></worksheet>",
    })
    found = office.sheets(data)
    assert [n for n, _ in found] == ["One", "Two"] and found[1][1] == []
    assert found[0][1] == [["note"], [], ["name", "", "v|w"], ["1", "", "True"]]
    assert office.sheet_markdown(found[0][1]) == "note\n\n| name | v\\|w |\n| --- | --- |\n| 1 | True |"


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text, props="", run=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def item(text, level):
    return p(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr>')


def test_docx():
    body = (
        p("Top", '<w:pStyle w:val="H1b"/>') + p("plain ", run="<w:b/>") + p("off.", run='<w:b w:val="0"/>') + item("one", 0) + item("in", 1) + item("in2", 1) + item("two", 0) + item("again", 1)
        + f'<w:p><w:hyperlink r:id="l"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>' + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr><w:tr><w:tc>" + p("1") + "</w:tc><w:tc/></w:tr></w:tbl>"
    )
    data = pack({
        "word/document.xml": f"<w:document {W} {R}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": RELS.format(rel("l", "http://x/", 'TargetMode="External"')),
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H1b"><w:name w:val="mine"/><w:basedOn w:val="H1"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerRoman"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
    })
    assert office.docx_markdown(data).split("\n\n") == ["# Top", "**plain**", "off.", "3. one", "  i. in", "  ii. in2", "4. two", "  i. again", "[link](http://x/)", "| a | b |\n| --- | --- |\n| 1 |  |"]


A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def shape(text, kind=""):
    mark = f'<p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr>' if kind else ""
    return f"<p:sp>{mark}<p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"


def test_pptx():
    tree = shape("Title", "title") + "<p:grpSp>" + shape("grouped") + "</p:grpSp>" + '<p:graphicFrame><c:chart xmlns:c="c" r:id="c1"/></p:graphicFrame>' + "<p:graphicFrame><a:tbl><a:tr><a:tc><a:p><a:r><a:t>h</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:graphicFrame>"
    data = pack({
        "ppt/presentation.xml": f'<p:presentation {A} {R}><p:sldIdLst><p:sldId r:id="s"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format(rel("s", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": f"<p:sld {A} {R}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/_rels/slide1.xml.rels": RELS.format(rel("c1", "../charts/c.xml") + rel("n", "../notesSlides/n.xml")),
        "ppt/charts/c.xml": "<c><ser><tx><v>Sales</v></tx><cat><v>Q1</v><v>Q2</v></cat><val><v>1</v><v>2</v></val></ser><ser><val><v>3</v></val></ser></c>",
        "ppt/notesSlides/n.xml": f"<p:notes {A}>{shape('say it', 'body')}{shape('3', 'sldNum')}</p:notes>",
    })
    text = office.pptx_markdown(data)
    assert text.startswith("# Slide 1: Title\n\ngrouped\n\n| Category | Sales | Series 2 |\n| --- | --- | --- |\n| Q1 | 1 | 3 |\n| Q2 | 2 |  |\n\n| h |\n| --- |")
    assert text.endswith("Notes:\nsay it") and "Notes" not in office.pptx_markdown(data, notes=False)


def compound(streams):
    """A compound file with 512-byte sectors, streams of 4096 bytes and more only."""
    sectors, fat, entries = [], [], []

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind) + b"\0" * 49 + struct.pack("<III", start, size, 0)

    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        n = -(-len(data) // 512)
        first = len(sectors)
        sectors += [data[i * 512 : (i + 1) * 512].ljust(512, b"\0") for i in range(n)]
        fat += [*range(first + 1, first + n), 0xFFFFFFFE]
        entries.append(entry(name, 2, first, len(data)))
    directory = len(sectors)
    raw = entry("Root Entry", 5, 0xFFFFFFFE, 0) + b"".join(entries)
    raw = raw.ljust(-(-len(raw) // 512) * 512, b"\0")
    n = len(raw) // 512
    sectors += [raw[i * 512 : (i + 1) * 512] for i in range(n)]
    fat += [*range(directory + 1, directory + n), 0xFFFFFFFE]
    at = len(sectors)
    fat = (fat + [0xFFFFFFFD]) + [0xFFFFFFFF] * (128 - len(fat) - 1)
    sectors.append(struct.pack("<128I", *fat))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<II", 0, 1)
    head += struct.pack("<IIIIIII", directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", at, *[0xFFFFFFFF] * 108) + b"".join(sectors)


def legacy(pieces, flags=0x0200):
    word, places = bytearray(0x400), []
    struct.pack_into("<H", word, 0, 0xA5EC)
    struct.pack_into("<H", word, 10, flags)
    ends = [0]
    for text, narrow in pieces:
        at = len(word)
        word += text.encode("cp1252" if narrow else "utf-16-le")
        places.append(b"\0\0" + struct.pack("<I", at * 2 | 0x40000000 if narrow else at) + b"\0\0")
        ends.append(ends[-1] + len(text))
        word += b"\0" * (len(word) % 2)
    plc = struct.pack(f"<{len(ends)}I", *ends) + b"".join(places)
    clx = b"\x01\x02\x00ab" + b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", word, 0x1A2, 0, len(clx))
    return compound({"WordDocument": bytes(word), "1Table": clx})


def test_doc():
    assert office.doc_text(legacy([("Héllo\r", True), ("мир\x07x", False)])) == "Héllo\nмир\tx"
    with pytest.raises(office.OleError, match="encrypted"):
        office.doc_text(legacy([("a", True)], 0x0300))
    with pytest.raises(office.OleError):
        office.doc_text(b"no file")
