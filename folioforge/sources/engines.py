"""Files that need an engine of the caller's: PDF tables and pages, converters run as commands, images.

An engine is a plain function (or, for a converter, a command line) that runs on the executors, a
file a time; nothing here makes up a result without one. Files and modes are those of ``files``.
"""

from __future__ import annotations

import base64
import subprocess
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.tables import Table, render_markdown
from folioforge.sources.files import extract, pluggable_files, read_binary

#: What a converter prints when it failed although its exit status is 0.
FAILURE_MARKS = ("traceback (most recent call last)", "fatal error", "conversion failed")


def pdf_tables(spark: SparkSession, path: str, engine: Callable[[bytes], list[list[list[str]]]] | None, summarize: Callable[[str], str] | None = None, mode: str = "FAILFAST") -> DataFrame:
    """A row a table, as markdown, by an engine that gives each table's rows (the first is the header)."""

    def parse(data: bytes) -> list[tuple[str, dict]]:
        out = []
        for i, rows in enumerate(engine(data)):
            text = render_markdown(Table(rows[0], rows[1:]))
            out.append((text, {"table": i, "rows": len(rows) - 1} | ({"summary": summarize(text)} if summarize else {})))
        return out

    return pluggable_files(spark, path, None if engine is None else parse, "PDF tables", mode)


def pdf_pages(spark: SparkSession, path: str, engine: Callable[[bytes], list[str]] | None, mode: str = "FAILFAST") -> DataFrame:
    """A row a file: its pages (markdown or HTML, as the engine gives) behind page comments. A file without any text is an error."""

    def parse(data: bytes) -> list[tuple[str, dict]]:
        pages = engine(data)
        if not any(p.strip() for p in pages):
            raise ValueError("no page has text")
        return [("\n\n".join(f"<!-- page: {i} -->\n{p.strip()}" for i, p in enumerate(pages, 1)), {"page_count": len(pages)})]

    return pluggable_files(spark, path, None if engine is None else parse, "PDF pages", mode)


@dataclass(frozen=True)
class Converter:
    """A command line tool that turns a file into markdown: variants are tried in order, with
    ``{input}`` and ``{output}`` replaced by the file and an empty folder. The largest ``.md`` file is the result."""

    variants: tuple[tuple[str, ...], ...]
    timeout: float = 600.0
    suffix: str = ".pdf"

    def __call__(self, data: bytes) -> list[tuple[str, dict]]:
        problems = []
        for n, argv in enumerate(self.variants):
            with tempfile.TemporaryDirectory() as folder:  # a task's own, gone with it
                source, output = Path(folder, f"input{self.suffix}"), Path(folder, "output")
                source.write_bytes(data)
                output.mkdir()
                try:
                    run = subprocess.run([a.format(input=source, output=output) for a in argv], capture_output=True, text=True, timeout=self.timeout)
                except (OSError, subprocess.TimeoutExpired) as e:
                    problems.append(f"{argv[0]}: {type(e).__name__}")
                    continue
                said = (run.stdout + run.stderr).lower()
                found = sorted(output.rglob("*.md"), key=lambda p: (-p.stat().st_size, str(p)))
                if run.returncode or not found or any(m in said for m in FAILURE_MARKS):
                    problems.append(f"{argv[0]}: exit {run.returncode}, {len(found)} results: {said[-200:]}")
                    continue
                return [(found[0].read_text(), {"variant": n, "result": found[0].name})]
        raise RuntimeError("; ".join(problems) or "no command given")


def converted_files(spark: SparkSession, path: str, converter: Converter | None, mode: str = "FAILFAST") -> DataFrame:
    return pluggable_files(spark, path, converter, "conversion to markdown", mode)


def image_files(spark: SparkSession, path: str, ocr: Callable[[bytes], str] | None = None, describe: Callable[[str], str] | None = None, mode: str = "FAILFAST") -> DataFrame:
    """``# stem``, ``## Summary`` by a model that gets the image as a data URL, ``## OCR`` by an engine; one of them is needed."""
    if ocr is None and describe is None:
        raise NotImplementedError("images need an OCR engine or a model that describes them")

    def parse(data: bytes) -> list[tuple[str, dict]]:
        parts = []
        if describe is not None:
            parts.append(f"## Summary\n\n{describe(data_url(data)).strip()}")
        if ocr is not None:
            parts.append(f"## OCR\n\n{ocr(data).strip()}")
        return [("\n\n".join(parts), {"format": "image"})]

    rows = extract(read_binary(spark, path), parse, mode)
    stem = F.udf(lambda s: PurePosixPath(s).stem)  # of a path, once a file
    return rows.withColumn("content", F.when(F.col("content").isNotNull(), F.concat(F.lit("# "), stem("source"), F.lit("\n\n"), "content")))


def data_url(data: bytes) -> str:
    """An image as a data URL; the kind by its first bytes."""
    kind = "jpeg" if data[:3] == b"\xff\xd8\xff" else "gif" if data[:4] == b"GIF8" else "webp" if data[8:12] == b"WEBP" else "png"
    return f"data:image/{kind};base64,{base64.b64encode(data).decode()}"


VISUAL_PROMPT = "Say in a few sentences what this {kind} of a slide shows. Slide title: {title}.\n\n{body}"


def summarize_visuals(visuals: DataFrame, model: Callable[[str, str | None], str]) -> DataFrame:
    """``visuals(title, kind, text, image)`` -> the same with ``summary`` and ``summary_error``. The model gets a prompt
    and, where there is an image, its data URL; one that fails leaves an error, not a failed job."""

    @F.pandas_udf("struct<summary:string,summary_error:string>")
    def run(title: pd.Series, kind: pd.Series, text: pd.Series, image: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k, body, data in zip(title, kind, text, image, strict=True):
            try:
                rows.append((model(VISUAL_PROMPT.format(kind=k, title=t or "none", body=body or "").strip(), data_url(bytes(data)) if data is not None else None), None))
            except Exception as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["summary", "summary_error"])

    return visuals.withColumn("_s", run("title", "kind", "text", "image")).select(*visuals.columns, "_s.*")
