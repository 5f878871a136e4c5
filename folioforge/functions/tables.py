"""Tables as text: CSV and markdown, to and from header and rows. Plain functions, for use in UDFs."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass


@dataclass
class Table:
    header: list[str]
    rows: list[list[str]]


def sniff_delimiter(text: str, fallback: str = ",") -> str:
    """Among comma, semicolon, tab and bar, by the first 2048 characters."""
    try:
        return csv.Sniffer().sniff(text[:2048], delimiters=",;\t|").delimiter
    except csv.Error:
        return fallback


def _fit(row: list[str], width: int) -> list[str]:
    return (row + [""] * width)[:width]


def shape(rows: list[list[str]], first_is_header: bool = True) -> Table:
    """The first row as header, rows padded or cut to it; else ``Column1`` ... over the greatest width."""
    if not rows:
        return Table([], [])
    if first_is_header:
        return Table(rows[0], [_fit(r, len(rows[0])) for r in rows[1:]])
    width = max(map(len, rows))
    return Table([f"Column{i + 1}" for i in range(width)], [_fit(r, width) for r in rows])


def parse_csv(text: str, delimiter: str = ",", first_is_header: bool = True) -> Table:
    return shape([r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if r], first_is_header)


def render_csv(table: Table, delimiter: str = ",") -> str:
    if not table.header:
        return ""
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="\n").writerows([table.header, *table.rows])
    return out.getvalue().rstrip("\n")


def escape_cell(cell: str) -> str:
    return cell.replace("|", "\\|").replace("\r\n", "<br>").replace("\n", "<br>")


def render_markdown(table: Table) -> str:
    if not table.header:
        return ""
    width = len(table.header)
    line = lambda cells: "| " + " | ".join(map(escape_cell, cells)) + " |"
    return "\n".join([line(table.header), "| " + " | ".join(["---"] * width) + " |", *[line(_fit(r, width)) for r in table.rows]])


_RULE = re.compile(r":?-+:?")


def _cells(line: str) -> list[str]:
    line = line.strip()
    return [c.strip() for c in line.removeprefix("|").removesuffix("|").split("|")]


def parse_markdown(text: str, first_is_header: bool = True) -> Table | None:
    """None unless a rule of dashes with as many cells follows the first line. Body lines
    without a bar are passed over; escaped bars aren't undone."""
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) < 2 or "|" not in lines[0]:
        return None
    head, rule = _cells(lines[0]), _cells(lines[1])
    if len(head) != len(rule) or not all(_RULE.fullmatch(c) for c in rule):
        return None
    return shape([head, *[_cells(x) for x in lines[2:] if "|" in x]], first_is_header)


def chunk_rows(table: Table, render, max_rows: int = 100, max_size: int | None = None, length=len) -> list[tuple[int, int, str]]:
    """Greedy packing: (first row, end row, text) of chunks of at most ``max_rows`` rows and
    ``max_size`` characters, a row at least. Sizes are kept as a running sum of each
    row's own, so a long table is rendered once."""
    if max_rows <= 0 or max_size is not None and max_size <= 0:
        raise ValueError("limits must be positive")
    out, start = [], 0
    head = length(render(Table(table.header, [])))
    size = head
    for i, row in enumerate(table.rows):
        mine = length(render(Table(table.header, [row]))) - head
        if i > start and (i - start >= max_rows or max_size is not None and size + mine > max_size):
            out.append((start, i, render(Table(table.header, table.rows[start:i]))))
            start, size = i, head
        size += mine
    if start < len(table.rows):
        out.append((start, len(table.rows), render(Table(table.header, table.rows[start:]))))
    return out


def inject_summaries(content: str, table_summary: str | None = None, chunk_summary: str | None = None) -> str:
    parts = [f"{name} Summary:\n{s}" for name, s in (("Table", table_summary), ("Chunk", chunk_summary)) if s]
    return "\n\n".join([*parts, "---", content]) if parts else content


def markdown_blocks(text: str) -> list[tuple[str, str]]:
    """(kind, text) of a markdown text in order: tables (a line with a bar, a rule starting
    with one, lines with bars) and what stands between them; the whole as it is
    where there is no table."""
    lines = text.split("\n")
    out: list[tuple[str, str]] = []
    plain: list[str] = []
    i = 0

    def flush() -> None:
        body = "\n".join(plain).strip()
        if body:
            out.append(("text", body))
        plain.clear()

    while i < len(lines):
        if "|" in lines[i] and i + 1 < len(lines) and re.match(r"\s*\|[\s:|-]*-[\s:|-]*$", lines[i + 1]):
            end = i + 2
            while end < len(lines) and "|" in lines[end]:
                end += 1
            flush()
            out.append(("table", "\n".join(lines[i:end])))
            i = end
        else:
            plain.append(lines[i])
            i += 1
    if not any(k == "table" for k, _ in out):
        return [("text", text)]
    flush()
    return out
