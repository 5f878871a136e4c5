"""File sources: each reads paths into ``source, content, metadata[, error]``.

``mode`` says what a file that fails does: ``DROPMALFORMED`` leaves it out,
``PERMISSIVE`` gives a row with its error, ``FAILFAST`` ends the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import html_dom, jsons, office, tables

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
_PART = "array<struct<content:string,metadata:map<string,string>>>"


def read_binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("source"), F.col("content").alias("data"))


def extract(files: DataFrame, parse: Callable[[bytes], list[tuple[str, dict]]], mode: str = "PERMISSIVE") -> DataFrame:
    """Run a parser over ``files(source, data)``, a file a time within Arrow batches: a row a part."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")

    @F.pandas_udf(f"struct<parts:{_PART},error:string>")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for d in data:
            try:
                rows.append(([{"content": c, "metadata": {k: str(v) for k, v in m.items()}} for c, m in parse(bytes(d))], None))
            except Exception as e:
                if mode == "FAILFAST":
                    raise RuntimeError(f"a file can't be read: {e}") from e
                rows.append(([], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["parts", "error"])

    parsed = files.withColumn("_r", run("data"))
    good = parsed.select("source", F.posexplode("_r.parts").alias("part", "p"), F.col("_r.error").alias("error")).select("source", "part", "p.content", "p.metadata", "error")
    if mode != "PERMISSIVE":
        return good
    none = F.lit(None)
    bad = parsed.where("_r.error is not null").select("source", F.lit(0).alias("part"), none.cast("string").alias("content"), none.cast("map<string,string>").alias("metadata"), F.col("_r.error").alias("error"))
    return good.unionByName(bad)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """A row a file with its whole text; files that vanish are passed over."""
    return spark.read.option("ignoreMissingFiles", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def json_files(spark: SparkSession, path: str, schema: str = ".", form: str = "json", mode: str = "DROPMALFORMED") -> DataFrame:
    """The text itself (schema ``.``), the value at a dot path, or its markdown."""

    def parse(data: bytes) -> list[tuple[str, dict]]:
        text = data.decode()
        value = json.loads(text)
        found, value = jsons.select(value, schema)
        if not found:
            raise KeyError(schema)
        if form == "markdown":
            return [(jsons.as_markdown(value), {"schema": schema})]
        return [(text if schema == "." else json.dumps(value, ensure_ascii=False), {"schema": schema})]

    return extract(read_binary(spark, path), parse, mode)


def csv_files(spark: SparkSession, path: str, form: str = "markdown", delimiter: str | None = None, mode: str = "FAILFAST") -> DataFrame:
    def parse(data: bytes) -> list[tuple[str, dict]]:
        text = data.decode("utf-8-sig")
        if not text.strip():
            raise ValueError("an empty file")
        d = delimiter or tables.sniff_delimiter(text)
        table = tables.parse_csv(text, d)
        return [(tables.render_markdown(table) if form == "markdown" else tables.render_csv(table, d), {"row_count": len(table.rows), "delimiter": d})]

    return extract(read_binary(spark, path), parse, mode)


def plain_table_files(spark: SparkSession, path: str, mode: str = "DROPMALFORMED") -> DataFrame:
    """CSV as markdown lines without escapes; ragged rows stay ragged."""
    import csv
    import io

    def parse(data: bytes) -> list[tuple[str, dict]]:
        rows = list(csv.reader(io.StringIO(data.decode())))
        line = lambda r: "| " + " | ".join(r) + " |"
        return [("\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]), {})]

    return extract(read_binary(spark, path), parse, mode)


def excel_files(spark: SparkSession, path: str, form: str = "markdown", delimiter: str = ",", summarizer: Callable[[str], str] | None = None, mode: str = "FAILFAST") -> DataFrame:
    """A row a sheet."""

    def parse(data: bytes) -> list[tuple[str, dict]]:
        out = []
        for name, rows in office.sheets(data):
            if form == "csv":
                text = tables.render_csv(tables.shape([r for r in rows if any(r)]), delimiter)
            else:
                text = office.sheet_markdown(rows)
            meta = {"sheet": name}
            if summarizer and text:
                try:
                    meta["summary"] = summarizer(text)
                except Exception as e:
                    meta["summary_error"] = str(e)
            out.append((text, meta))
        return out

    return extract(read_binary(spark, path), parse, mode)


def docx_files(spark: SparkSession, path: str, mode: str = "DROPMALFORMED") -> DataFrame:
    return extract(read_binary(spark, path), lambda d: [(office.docx_markdown(d), {"format": "docx"})], mode)


def pptx_files(spark: SparkSession, path: str, notes: bool = True, mode: str = "FAILFAST") -> DataFrame:
    return extract(read_binary(spark, path), lambda d: [(office.pptx_markdown(d, notes), {"format": "pptx"})], mode)


def doc_files(spark: SparkSession, path: str, clean: bool = True, mode: str = "FAILFAST") -> DataFrame:
    return extract(read_binary(spark, path), lambda d: [(office.doc_text(d, clean), {"format": "doc"})], mode)


def html_files(spark: SparkSession, path: str, form: str = "markdown", strict: bool = True, mode: str = "FAILFAST") -> DataFrame:
    def parse(data: bytes) -> list[tuple[str, dict]]:
        tree = (html_dom.parse_strict if strict else html_dom.parse)(data.decode())
        found = html_dom.blocks(html_dom.strip_content_free(tree))
        return [("\n\n".join(b.markdown for b in found) if form == "markdown" else "\n".join(b.html for b in found), {"format": "html"})]

    return extract(read_binary(spark, path), parse, mode)


def pluggable_files(spark: SparkSession, path: str, engine: Callable[[bytes], list[tuple[str, dict]]] | None, what: str, mode: str = "FAILFAST") -> DataFrame:
    """PDF text and tables, OCR and image description need an engine that isn't part of this
    library: without one this is an error, never a made-up result."""
    if engine is None:
        raise NotImplementedError(f"{what} needs an engine: pass a function from bytes to (text, metadata) parts")
    return extract(read_binary(spark, path), engine, mode)


def pdf_files(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]] | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Pages by a given extractor, page marks and repeated headers and footers removed."""
    engine = None if pages is None else lambda d: [(p, {"page": i}) for i, p in enumerate(pages(d), 1)]
    raw = pluggable_files(spark, path, engine, "PDF text", mode)
    rows = raw.select(F.col("source").alias("doc"), F.col("metadata")["page"].cast("int").alias("page"), F.col("content").alias("text"))
    return clean_pages(rows)


def route(files: DataFrame, kind: Column, mode: str = "PERMISSIVE") -> DataFrame:
    """Downloads ``(source, data, ...)`` by their kind to the parser for it."""
    parsers = {
        "text": lambda d: [(d.decode(), {})], "html": lambda d: [(html_dom.to_markdown(d.decode()), {})], "docx": lambda d: [(office.docx_markdown(d), {})], "doc": lambda d: [(office.doc_text(d), {})],
        "pptx": lambda d: [(office.pptx_markdown(d), {})], "excel": lambda d: [(office.sheet_markdown(r), {"sheet": n}) for n, r in office.sheets(d)], "json": lambda d: [(jsons.as_markdown(json.loads(d)), {})],
        "csv": lambda d: [(tables.render_markdown(tables.parse_csv(d.decode(), tables.sniff_delimiter(d.decode()))), {})],
    }
    keyed = files.withColumn("_kind", kind)
    out = None
    for name, parse in parsers.items():
        part = extract(keyed.where(F.col("_kind") == name), parse, mode).withColumn("routed", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# --- repeated headers and footers --------------------------------------------------------------------

PAGE_MARK = r"^\s*(?:\d{1,4}|\d{1,4}\s*/\s*\d{1,4}|-\s*\d{1,4}\s*-)\s*$"


def signature(line: Column) -> Column:
    """Lower case, digits removed, white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", ""), r"\s+", " "))


def _zones(pages: DataFrame) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = pages.select("doc", "page", F.size(lines).alias("n"), F.posexplode(lines).alias("pos", "line"))
    return rows.where("pos < 4 or pos >= n - 4").withColumn("sig", signature(F.col("line")))


def repeated_lines(pages: DataFrame) -> DataFrame:
    """``pages(doc, page, text)`` -> signatures of lines among the first and last four of a
    page that recur twice, on two pages and on a fifth of the document's pages."""
    total = pages.where("text rlike '[^ \\n]'").groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    found = _zones(pages).where("sig <> ''").groupBy("doc", "sig").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("page").alias("pages_with"))
    return found.join(total, "doc").where("pages >= 2 and uses >= 2 and pages_with >= 2 and pages_with / pages >= 0.2").select("doc", "sig", "uses", "pages_with")


def clean_pages(pages: DataFrame) -> DataFrame:
    """Documents of pages without page marks and repeated lines, joined by blank lines."""
    bad = repeated_lines(pages).select("doc", "sig")
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    edge = _zones(pages).select("doc", "page", "line").distinct().withColumn("edge", F.lit(True))
    marked = lines.where(~F.col("line").rlike(PAGE_MARK)).join(edge, ["doc", "page", "line"], "left").withColumn("sig", F.when(F.col("edge"), signature(F.col("line"))))
    kept = marked.join(bad, ["doc", "sig"], "left_anti")
    text = F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n"))
    by_page = kept.groupBy("doc", "page").agg(text.alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n\n")
    return by_page.groupBy("doc").agg(joined.alias("content"), F.count(F.lit(1)).alias("page_count"))
