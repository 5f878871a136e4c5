"""Splitters: a row a document in, a row a chunk out.

Windows over token arrays, lines and row numbers are built-in expressions; splitters
that recurse or carry a buffer are plain functions run over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions import jsons, tables
from folioforge.functions.text import cosine, py_strip
from folioforge.session import bound_batches

# --- the base contract -----------------------------------------------------------------


def starts_of(chunks: Column, text: Column) -> Column:
    """Where each chunk is found from the end of the one before on, -1 if it isn't (as with overlaps)."""
    none = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, chunk: Column) -> Column:
        at = F.call_function("locate", chunk, text, acc["cursor"] + 1) - 1
        return F.struct(F.when(at >= 0, at + F.length(chunk)).otherwise(acc["cursor"]).alias("cursor"), F.concat(acc["at"], F.array(at)).alias("at"))

    return F.aggregate(chunks, none, step)["at"]


def emit(docs: DataFrame, chunks: Column, strategy: str, *, key: str = "doc_id", text: str = "text", starts: bool = True) -> DataFrame:
    """A row a chunk: ``segment_id`` (a digest of document, strategy and index), ``content``,
    ``chunk_index``, ``chunk_total``, ``start_index``, ``split_strategy``."""
    made = docs.withColumn("_c", chunks)
    at = starts_of(F.col("_c"), F.col(text)) if starts else F.transform("_c", lambda _: F.lit(-1))
    rows = made.select(key, F.size("_c").alias("chunk_total"), F.posexplode(F.arrays_zip("_c", at.alias("_at"))).alias("chunk_index", "_z"))
    return rows.select(
        F.md5(F.concat_ws("\x1f", F.col(key).cast("string"), F.lit(strategy), F.col("chunk_index").cast("string"))).alias("segment_id"), key, F.col("_z._c").alias("content"),
        "chunk_index", "chunk_total", F.col("_z._at").alias("start_index"), F.lit(strategy).alias("split_strategy"),
    )


def split_segments(segments: DataFrame, chunks: Column, strategy: str) -> DataFrame:
    """Segments split again: children carry their parent's id and inherit its level and path."""
    rows = emit(segments.withColumnRenamed("segment_id", "parent_id"), chunks, strategy, key="parent_id", text="content")
    return rows.join(segments.select(F.col("segment_id").alias("parent_id"), "level", "path"), "parent_id")


def python_chunks(split: Callable[[str], list[str]], c: Column) -> Column:
    """A plain function as an array-valued column, in Arrow batches of bounded bytes."""
    bound_batches()

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t) if t else [])

    return run(c)


# --- built-in splitters ------------------------------------------------------------------


def token_windows(docs: DataFrame, size: int = 4000, overlap: int = 200, *, tokens: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of ``size`` tokens (split at white space unless given) in steps of
    ``size - overlap``; the last is the one that reaches the end."""
    words = tokens if tokens is not None else F.filter(F.split(F.col(text), r"(?U)\s+"), lambda x: x != "")
    step = size - overlap
    made = docs.withColumn("_w", words).withColumn("_n", F.size("_w"))
    if step <= 0:
        made = made.withColumn("_n", F.when(F.col("_n") > size, F.raise_error(F.lit("the overlap must be less than the window")).cast("int")).otherwise(F.col("_n")))
        count = F.when(F.col("_n") > 0, 1).otherwise(0)
    else:
        count = F.when(F.col("_n") <= 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step).cast("int")) + 1)
    chunks = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(F.col("_w"), i * step + 1, size), " "))).otherwise(F.array().cast("array<string>"))
    return emit(made, chunks, "token", key=key, text=text, starts=False)


def regex_split(c: Column, pattern: str) -> Column:
    """Pieces between matches, empty ones dropped; captured groups are pieces too."""
    if re.compile(pattern).groups:
        return python_chunks(lambda t: [x for x in re.split(pattern, t) if x], c)
    return F.filter(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: x != "")


def qa_pairs(c: Column) -> Column:
    """Pieces at ``Q: ``, each with the sign before it; blank ones dropped."""
    return F.transform(F.filter(F.transform(F.split(c, "Q: "), py_strip), lambda x: x != ""), lambda x: F.concat(F.lit("Q: "), x))


def question_of(piece: Column) -> Column:
    return py_strip(F.substring_index(F.regexp_replace(piece, "^Q: ", ""), "\n", 1))


def row_chunks(rows: DataFrame, header: Column, line: Column, size: int, *, by: list[str], order: list) -> DataFrame:
    """Rendered table rows in chunks of ``size``, the header before each; rows [start, end)."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    numbered = rows.select(*by, n.alias("_n"), line.alias("_line")).withColumn("chunk_index", F.floor(F.col("_n") / size))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n")
    packed = numbered.groupBy(*by, "chunk_index").agg(body.alias("_body"), F.min("_n").alias("data_row_start"), (F.max("_n") + 1).alias("data_row_end"))
    return packed.select(*by, "chunk_index", F.concat(header, F.lit("\n"), "_body").alias("content"), "data_row_start", "data_row_end")


def look_ahead(vectors: DataFrame, window: int, order: str, by: list[str], column: str = "embedding") -> DataFrame:
    """Each vector replaced by the mean of itself and the next ``window - 1``."""
    if window <= 1:
        return vectors
    w = W.partitionBy(*by).orderBy(order).rowsBetween(0, window - 1)
    packed = vectors.withColumn("_v", F.collect_list(column).over(w))
    size = F.size(F.col(column))
    mean = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate("_v", F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / F.size("_v"))
    return packed.withColumn(column, mean).drop("_v")


def semantic_boundaries(vectors: DataFrame, *, by: list[str], order: str, mode: str = "fixed", threshold: float = 0.6, percentile: float = 90.0, window: int = 1, local: int = 50, least: int = 20, fallback: str = "global") -> DataFrame:
    """Cosine of neighbouring sentences, the threshold in force, and the running chunk id; two
    neighbours stay together when the cosine reaches the threshold. ``percentile``: of
    all cosines of the document; ``percentile_local``: of those ``local`` boundaries to
    either side, the global one (or the fixed) where they are fewer than ``least``."""
    seq = W.partitionBy(*by).orderBy(order)
    sim = look_ahead(vectors, window, order, by).withColumn("sim", cosine(F.col("embedding"), F.lead("embedding").over(seq)))
    sim = sim.withColumn("sim", F.when(F.lead(order).over(seq).isNotNull(), F.col("sim")))
    whole = W.partitionBy(*by)
    share = percentile / 100
    if mode == "fixed":
        limit = F.lit(threshold)
    elif mode == "percentile":
        limit = F.percentile("sim", share).over(whole)
    elif mode == "percentile_local":
        near = seq.rowsBetween(-local, local)
        other = F.percentile("sim", share).over(whole) if fallback == "global" else F.lit(threshold)
        limit = F.when(F.count("sim").over(near) >= least, F.percentile("sim", share).over(near)).otherwise(other)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    marked = sim.withColumn("threshold", limit)
    begins = F.when(F.lag("sim").over(seq) < F.lag("threshold").over(seq), 1).otherwise(0)
    return marked.withColumn("_b", begins).withColumn("chunk_id", F.sum("_b").over(seq)).drop("_b")


# --- splitters by plain functions ----------------------------------------------------------


def recursive(text: str, size: int = 4000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", " ", ""), length: Callable[[str], int] = len) -> list[str]:
    """Split at the first separator that occurs; pieces too long go on with the later ones;
    short ones are merged to ``size`` with ``overlap`` carried over."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    pieces = [p for p in (text.split(sep) if sep else list(text)) if p]
    out: list[str] = []
    fitting: list[str] = []
    for p in pieces:
        if length(p) <= size:
            fitting.append(p)
            continue
        out += merge(fitting, sep, size, overlap, length)
        fitting = []
        out += recursive(p, size, overlap, rest, length) if rest else [p]
    return out + merge(fitting, sep, size, overlap, length)


def merge(pieces: Iterable[str], sep: str, size: int, overlap: int, length: Callable[[str], int] = len) -> list[str]:
    out: list[str] = []
    now: list[str] = []
    total, gap = 0, length(sep)
    for p in pieces:
        n = length(p)
        if now and total + n + gap > size:
            out.append(sep.join(now).strip())
            while now and (total > overlap or total + n + gap > size):
                total -= length(now.pop(0)) + (gap if now else 0)
        total += n + (gap if now else 0)
        now.append(p)
    if now:
        out.append(sep.join(now).strip())
    return [x for x in out if x]


_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+(?=[\"'«“(\[]*[^\W_])")
_SHORT = re.compile(r"(?:^|[\s(])(?:Mr|Mrs|Ms|Dr|Prof|St|No|vs|etc|e\.g|i\.e|z\.B|bzw|Nr|т\.е|г|[A-ZА-Я])\.$")


def sentences(text: str) -> list[str]:
    """At a terminator and white space before a word, unless an abbreviation stands there."""
    out: list[str] = []
    for p in _SENTENCE.split(text):
        if out and _SHORT.search(out[-1]):
            out[-1] += " " + p
        elif p.strip():
            out.append(p.strip())
    return out


def pack_sentences(text: str, size: int = 4000, overlap: int = 200, length: Callable[[str], int] = len) -> list[str]:
    """Sentences packed with single spaces; the overlap is trailing sentences that fit. A
    sentence too long is packed by words, a word too long is cut."""
    units: list[str] = []
    for s in sentences(text):
        units += [s] if length(s) <= size else _words(s, size, length)
    out: list[str] = []
    now: list[str] = []
    for s in units:
        if now and length(" ".join([*now, s])) > size:
            out.append(" ".join(now))
            keep: list[str] = []
            for x in reversed(now):
                if length(" ".join([x, *keep])) > overlap:
                    break
                keep.insert(0, x)
            now = keep if length(" ".join([*keep, s])) <= size else []
        now.append(s)
    return out + ([" ".join(now)] if now else [])


def _words(sentence: str, size: int, length: Callable[[str], int]) -> list[str]:
    out: list[str] = []
    now = ""
    for w in sentence.split():
        pieces = [w] if length(w) <= size else [w[i : i + size] for i in range(0, len(w), size)]
        for p in pieces:
            if now and length(now + " " + p) > size:
                out.append(now)
                now = p
            else:
                now = f"{now} {p}" if now else p
    return out + ([now] if now else [])


def hierarchy(text: str, patterns: list[tuple[int, str]], exclude: tuple[str, ...] = (), parents: bool | int = False) -> list[dict]:
    """Sections by line patterns of a level. A title is group 1, else what follows the
    match, else the line. Returns dicts with content, title, level, path, index, parent."""
    rules = [(level, re.compile(p)) for level, p in patterns]
    skip = [re.compile(p) for p in exclude]
    root = {"title": "ROOT", "level": 0, "lines": [], "path": [], "parent": None, "index": 0}
    nodes, stack = [root], [root]
    for line in text.split("\n"):
        hit = None if any(p.search(line) for p in skip) else next(((lv, m) for lv, p in rules if (m := p.match(line))), None)
        if hit is None:
            stack[-1]["lines"].append(line)
            continue
        level, m = hit
        title = (m[1] if m.re.groups and m[1] else line[m.end() :]).strip() or line.strip()
        while len(stack) > 1 and stack[-1]["level"] >= level:
            stack.pop()
        node = {"title": title, "level": level, "lines": [line], "path": [n["title"] for n in stack[1:]], "parent": stack[-1]["index"], "index": len(nodes)}
        nodes.append(node)
        stack.append(node)
    blank = not "\n".join(root["lines"]).strip()
    out = []
    for n in nodes:
        body = "\n".join(n["lines"]).strip()
        if not body:
            continue
        if parents is not False:
            above, p = [], n["parent"]
            while p is not None:
                x = nodes[p]
                own = "\n".join(x["lines"]).strip()
                if own and (parents is True or parents == 0 or x["level"] >= parents):
                    above.insert(0, own)
                p = x["parent"]
            body = "\n".join([*above, body])
        out.append({"content": body, "title": n["title"], "level": n["level"], "path": n["path"], "index": n["index"], "parent": None if n["parent"] is None or n["parent"] == 0 and blank else n["parent"]})
    return out


MARKDOWN = [(i, rf"^{'#' * i}\s+(.*)$") for i in range(1, 7)]


def markdown_hierarchy(text: str, parents: bool | int = False) -> list[dict]:
    return hierarchy(text, MARKDOWN, parents=parents)


def markdown_tables(text: str, max_rows: int | None = None, max_size: int | None = None, first_is_header: bool = True) -> list[dict]:
    """Texts and tables in order; with a limit, tables by rows. A table without rows vanishes."""
    out = []
    for kind, body in tables.markdown_blocks(text):
        if kind == "text" or max_rows is None and max_size is None:
            out.append({"content": body, "type": kind, "start": -1, "end": -1})
            continue
        table = tables.parse_markdown(body, first_is_header)
        if table is not None:
            out += [{"content": c, "type": "table", "start": a, "end": b} for a, b, c in tables.chunk_rows(table, tables.render_markdown, max_rows or 100, max_size)]
    return out


def csv_table(text: str, max_rows: int = 100, max_size: int | None = None, delimiter: str | None = None, first_is_header: bool = True) -> list[dict]:
    d = delimiter or tables.sniff_delimiter(text)
    table = tables.parse_csv(text, d, first_is_header)
    return [{"content": c, "type": "table", "start": a, "end": b} for a, b, c in tables.chunk_rows(table, lambda t: tables.render_csv(t, d), max_rows, max_size)]


def explode_dicts(docs: DataFrame, split: Callable[[str], list[dict]], fields: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Run a plain splitter that returns dicts and give each a row with ``chunk_index``."""
    bound_batches()
    names = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", fields)]

    @F.pandas_udf(f"array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in re.split(r',(?![^<]*>)', fields))}>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{n: d[n] for n in names} for d in split(t)] if t else [])

    rows = docs.select(key, F.posexplode(run(text)).alias("chunk_index", "_s"))
    return rows.select(key, "chunk_index", "_s.*")


def json_split(docs: DataFrame, path: str = ".", *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row an element of the list at ``path``, leaves as a map of strings."""

    def split(t: str) -> list[dict]:
        return [{"content": c, "metadata": {k: jsons.scalar(v) for k, v in m.items()}} for c, m in jsons.split(t, path)]

    return explode_dicts(docs, split, "content string, metadata map<string,string>", key=key, text=text)


def detect_language(c: Column, detector: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """By script; a pluggable detector comes first for texts of 20 characters and more."""
    from folioforge.functions.text import script_of

    if detector is None:
        return script_of(c)
    found = F.pandas_udf(detector, "string")(F.substring(c, 1, 5000))
    return F.coalesce(F.when(F.length(c) >= 20, found), script_of(c))
