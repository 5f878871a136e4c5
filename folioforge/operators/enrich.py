"""Enrichment by language models: titles and summaries, entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.models import Complete, complete

PROMPT = "Give a title, keywords and a summary of this text as lines 'Title: ...', 'Keywords: a, b', 'Summary: ...'.\n\n"


def parse_enrichment(answer: Column) -> Column:
    """``Title:``, ``Keywords:`` and ``Summary:`` lines in any case; Untitled, none and empty where missing."""
    line = lambda name: F.trim(F.regexp_extract(answer, rf"(?im)^\s*{name}:[ \t]*(.*)$", 1))
    words = F.filter(F.transform(F.split(line("keywords"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.coalesce(F.nullif(line("title"), F.lit("")), F.lit("Untitled")).alias("generated_title"), words.alias("keywords"), line("summary").alias("summary"))


def header(e: Column, content: Column) -> Column:
    return F.concat(F.lit("Title: "), e["generated_title"], F.lit("\nKeywords: "), F.array_join(e["keywords"], ", "), F.lit("\nSummary: "), e["summary"], F.lit("\n\n"), content)


def enrich(segments: DataFrame, model: Complete, least: int = 50) -> DataFrame:
    """Texts of more than ``least`` characters get title, keywords, summary and a header before
    their content; a row that the model fails on stays as it is, with its error."""
    wanted = (F.col("type") == "text") & (F.length("content") > least)
    asked = segments.withColumn("_a", F.when(wanted, complete(F.concat(F.lit(PROMPT), "content"), model)))
    e = F.when(F.col("_a.value").isNotNull(), parse_enrichment(F.col("_a.value")))
    rows = asked.withColumn("_e", e)
    return rows.select(*[c for c in segments.columns if c != "content"], F.coalesce(header(F.col("_e"), F.col("content")), F.col("content")).alias("content"), "_e.generated_title", "_e.keywords", "_e.summary", F.col("_a.error").alias("enrich_error"))


GRAPH_JSON = "struct<entities:array<struct<name:string,type:string,description:string>>,relations:array<struct<source:string,target:string,type:string,weight:double>>>"


def parse_graph(answers: DataFrame, column: str = "answer") -> tuple[DataFrame, DataFrame]:
    """``answers(segment_id, <column>)`` of JSON -> nodes and edges: id = name, type ``concept``,
    relation ``RELATED_TO`` and weight 1 where missing; what isn't JSON is passed over."""
    body = F.regexp_extract(column, r"(?s)(\{.*\})", 1)
    parsed = answers.select("segment_id", F.from_json(body, GRAPH_JSON, {"mode": "PERMISSIVE"}).alias("g"))
    nodes = parsed.select(F.col("segment_id").alias("source_segment_id"), F.explode("g.entities").alias("e")).where("e.name is not null and e.name <> ''")
    edges = parsed.select(F.col("segment_id").alias("source_segment_id"), F.explode("g.relations").alias("r")).where("r.source <> '' and r.target <> ''")
    return (
        nodes.select(F.col("e.name").alias("id"), F.coalesce("e.type", F.lit("concept")).alias("type"), F.col("e.name").alias("label"), F.col("e.description").alias("description"), "source_segment_id"),
        edges.select(F.col("r.source").alias("source_id"), F.col("r.target").alias("target_id"), F.coalesce("r.type", F.lit("RELATED_TO")).alias("relation_type"), F.coalesce("r.weight", F.lit(1.0)).alias("weight"), "source_segment_id"),
    )


def extract_graph(segments: DataFrame, model: Complete) -> tuple[DataFrame, DataFrame]:
    answers = segments.select("segment_id", complete(F.col("content"), model)["value"].alias("answer")).where("answer is not null")
    return parse_graph(answers)
