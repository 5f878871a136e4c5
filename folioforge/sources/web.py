"""The web as tables: links of fetched pages, crawls as breadth-first joins, page blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions import html_dom
from folioforge.functions.text import in_scope, normalize_url, url_host
from folioforge.session import bound_batches, cut

_LINK = "array<struct<url:string,text:string,classes:array<string>,is_navigation:boolean>>"
_BLOCK = "array<struct<kind:string,markdown:string,html:string,level:int,title:string,rows:array<array<string>>>>"


def page_links(pages: DataFrame, *, ignore: tuple[str, ...] = (), navigation: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> DataFrame:
    """``pages(page_id, url, html)`` -> a row a distinct absolute link, in page order."""
    bound_batches()

    @F.pandas_udf(_LINK)
    def run(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([html_dom.links(h, u or "", ignore, navigation, texts) if h else [] for h, u in zip(html, url, strict=True)])

    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(run("html", "url")).alias("position", "link"))
    return rows.select("page_id", "page_url", "position", "link.*")


def merge_links(links: DataFrame) -> DataFrame:
    """One row a (url, is_navigation): that with the most classes, of equal ones the latest."""
    return links.groupBy("url", "is_navigation").agg(F.max_by(F.struct("classes", "text"), F.struct(F.size("classes"), "seq")).alias("m")).select("url", "is_navigation", "m.*")


def page_blocks(pages: DataFrame) -> DataFrame:
    """A row a block of each page."""
    bound_batches()

    @F.pandas_udf(_BLOCK)
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: [vars(b) for b in html_dom.blocks(html_dom.strip_content_free(html_dom.parse(h)))] if h else [])

    return pages.select("page_id", F.posexplode(run("html")).alias("position", "b")).select("page_id", "position", "b.*")


def render(c: Column, form: str = "markdown", strict: bool = False) -> Column:
    """A page as markdown or as HTML of its blocks. ``strict``: only well-formed XML; an
    error gives null."""
    if form not in ("markdown", "html"):
        raise ValueError(f"unknown form {form!r}")
    bound_batches()

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        def one(h: str | None) -> str | None:
            if h is None:
                return None
            try:
                tree = html_dom.parse_strict(h) if strict else html_dom.parse(h)
            except Exception:
                return None
            found = html_dom.blocks(html_dom.prune_empty_lists(html_dom.strip_content_free(tree)))
            return "\n\n".join(b.markdown for b in found) if form == "markdown" else "\n".join(b.html for b in found)

        return html.map(one)

    return run(c)


def drop_repeated_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks seen on an earlier page (by kind, text and links) go: the first by page and position stays."""
    w = W.partitionBy(F.md5(F.concat_ws("\x1f", "kind", "markdown"))).orderBy("page_id", "position")
    return blocks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Links of a host that one task follows; those of larger hosts are followed wave by wave.
LINKS_A_TASK = 2_000_000


def crawl(starts: DataFrame, links: DataFrame, depth: int, *, scope: str = "same_host", domains: tuple[str, ...] = (), max_pages: int | None = None, most: int = LINKS_A_TASK) -> DataFrame:
    """Breadth-first over ``links(page_url, url, is_navigation)`` from ``starts(url)``: each url
    once, at its least depth. Regular links cost a step, navigation links none. ``max_pages``
    keeps the first in order of depth and url.

    A crawl that stays on its host needs that host's links only: a task follows them all, up to ``most``, however
    long its chains of navigation are. Other scopes, larger hosts and hosts of very many starts go wave by wave."""
    step = links.select(normalize_url(F.col("page_url")).alias("u"), normalize_url(F.col("url")).alias("v"), F.col("is_navigation").cast("boolean").alias("nav")).where("u <> v").distinct()
    seen = starts.select(normalize_url(F.col("url")).alias("url"), normalize_url(F.col("url")).alias("start_url")).distinct().withColumn("depth", F.lit(0))
    if scope == "same_host":
        step = cut(step.where(in_scope(F.col("v"), F.col("u"))).withColumn("host", url_host(F.col("u"))))
        seen = cut(seen.withColumn("host", url_host(F.col("url"))))
        begun = seen.groupBy("host").agg(F.count(F.lit(1)).alias("starts"))
        size = step.groupBy("host").agg(F.count(F.lit(1)).alias("links")).join(begun, "host")
        large = cut(size.where((F.col("links") > most) | (F.col("links") * F.col("starts") > 10 * most)).select("host"))
        inside = step.join(large, "host", "left_anti").join(seen.select("host"), "host", "left_semi")
        whole = seen.join(large, "host", "left_anti").where("host is not null").groupBy("host").cogroup(inside.groupBy("host")).applyInArrow(_follow_all(depth), "url string, start_url string, depth int")
        # a start of no host has no links in scope
        found = whole.unionByName(seen.where("host is null").drop("host"))
        rest = seen.join(large, "host", "left_semi").drop("host")
        if not rest.isEmpty():
            found = found.unionByName(_waves(cut(rest), cut(step.join(large, "host", "left_semi").drop("host")), depth, scope, domains))
    else:
        found = _waves(cut(seen), cut(step), depth, scope, domains)
    return found if max_pages is None else found.orderBy("depth", "url", "start_url").limit(max_pages)


def _follow_all(depth: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """All crawls of a host over its links; urls are numbered, and links of a url lie together."""

    def run(starts: pa.Table, links: pa.Table) -> pa.Table:
        first = starts.column("url").unique().to_pylist()
        urls = pa.chunked_array([pa.array(first, pa.string()), *links.column("u").cast(pa.string()).chunks, *links.column("v").cast(pa.string()).chunks], pa.string()).combine_chunks().dictionary_encode()
        names, ids = urls.dictionary, urls.indices.to_numpy(zero_copy_only=False)
        u, v = ids[len(first) : len(first) + len(links)], ids[len(first) + len(links) :]
        nav = links.column("nav").to_numpy().astype(bool)
        sides = []
        for kind in (nav, ~nav):
            order = np.argsort(u[kind], kind="stable")
            sides.append((np.searchsorted(u[kind][order], np.arange(len(names) + 1)), v[kind][order]))
        (nav_at, nav_to), (at, to) = sides
        out = []
        for start in ids[: len(first)]:
            reached = {int(start): 0}
            wave = [int(start)]
            for d in range(depth + 1):
                level = list(wave)
                while wave:  # navigation links stay at the depth
                    x = wave.pop()
                    for y in nav_to[nav_at[x] : nav_at[x + 1]].tolist():
                        if y not in reached:
                            reached[y] = d
                            level.append(y)
                            wave.append(y)
                if d == depth:
                    break
                for x in level:
                    for y in to[at[x] : at[x + 1]].tolist():
                        if y not in reached:
                            reached[y] = d + 1
                            wave.append(y)
            out.append(pa.table({"url": names.take(pa.array(list(reached), pa.int64())), "start_url": pa.repeat(names[int(start)], len(reached)), "depth": pa.array(list(reached.values()), pa.int32())}))
        none = pa.table({"url": pa.array([], pa.string()), "start_url": pa.array([], pa.string()), "depth": pa.array([], pa.int32())})
        return pa.concat_tables([none, *out])

    return run


def _waves(seen: DataFrame, step: DataFrame, depth: int, scope: str, domains: tuple[str, ...]) -> DataFrame:
    """A wave is a join with the frontier; the visited are anti-joined, and each wave is written before the next."""
    wave = seen
    for d in range(depth + 1):
        while True:  # navigation links stay at the depth
            more = _follow(wave, step.where("nav"), seen, d, scope, domains)
            if more.isEmpty():
                break
            seen, wave = cut(seen.unionByName(more)), more
        if d == depth:
            break
        wave = _follow(seen.where(F.col("depth") == d), step.where("not nav"), seen, d + 1, scope, domains)
        seen = cut(seen.unionByName(wave))
    return seen


def _follow(wave: DataFrame, step: DataFrame, seen: DataFrame, depth: int, scope: str, domains: tuple[str, ...]) -> DataFrame:
    found = wave.join(step, F.col("url") == F.col("u")).where(in_scope(F.col("v"), F.col("start_url"), scope, domains))
    return cut(found.select(F.col("v").alias("url"), "start_url").distinct().join(seen.select("url", "start_url"), ["url", "start_url"], "left_anti").withColumn("depth", F.lit(depth)))


def fetch(urls: DataFrame, primary: Callable[[str], str], fallback: Callable[[str], str] | None = None, retries: int = 0) -> DataFrame:
    """Fetch ``urls(url)`` with given functions: html, the one that gave it, and the error if
    none did. A row that fails doesn't fail the job."""

    @F.pandas_udf("struct<html:string,backend:string,error:string>")
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for url in batch:
            row = (None, None, None)
            for name, call in (("primary", primary), ("fallback", fallback)):
                for _ in range(retries + 1 if call else 0):
                    try:
                        row = (call(url), name, None)
                        break
                    except Exception as e:
                        row = (None, name, f"{type(e).__name__}: {e}")
                if row[0] is not None:
                    break
            rows.append(row)
        return pd.DataFrame(rows, columns=["html", "backend", "error"])

    return urls.withColumn("_f", run("url")).select(*urls.columns, "_f.*")


def state_documents(states: DataFrame, mode: str = "separate_documents") -> DataFrame:
    """``states(url, state, content)`` -> a document a state, its source ``url#nav-state=i``, or
    one a page with a banner before each."""
    total = F.count(F.lit(1)).over(W.partitionBy("url"))
    numbered = states.withColumn("_i", F.row_number().over(W.partitionBy("url").orderBy("state"))).withColumn("_n", total)
    if mode == "separate_documents":
        return numbered.select(F.when(F.col("_n") > 1, F.concat("url", F.lit("#nav-state="), F.col("_i").cast("string"))).otherwise(F.col("url")).alias("source"), "content")
    banner = F.concat(F.lit("===== NAVIGATION STATE "), F.col("_i").cast("string"), F.lit("/"), F.col("_n").cast("string"), F.lit(" =====\n"), "content")
    joined = numbered.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("_i", banner.alias("c")))).alias("x"))
    return joined.select(F.col("url").alias("source"), F.array_join(F.transform("x", lambda s: s["c"]), "\n\n").alias("content"))
