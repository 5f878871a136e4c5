"""Graphs as files: Parquet tables, and GML for exchange."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The GML text as rows ``part, key, line``: to be written in that order. Nodes are named by
    their id, so that no numbering over all of them is needed."""
    head = nodes.sparkSession.createDataFrame([(0, "", "graph [\n  directed 1\n  multigraph 1"), (3, "", "]")], "part int, key string, line string")
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  node [ id "), _quoted("id"), F.lit(" label "), _quoted("label"), F.lit(" type "), _quoted("type"), F.lit(" ]")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.col("edge_id").alias("key"), F.concat(F.lit("  edge [ source "), _quoted("source_id"), F.lit(" target "), _quoted("target_id"), F.lit(" relation "), _quoted("relation_type"), F.lit(" weight "), F.col("weight").cast("string"), F.lit(" ]")).alias("line"))
    return head.unionByName(n).unionByName(e)


def save_gml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One sorted text; part files in order make up the file."""
    gml_lines(nodes, edges).orderBy("part", "key").select("line").write.mode("overwrite").text(path)


def load_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a GML text with a node or an edge a line."""
    lines = spark.read.text(path)

    def value(name: str) -> Column:
        raw = F.regexp_extract("value", rf'(?:\[| ) ?{re.escape(name)} "([^"]*)"', 1)
        return F.replace(F.replace(raw, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))

    nodes = lines.where("trim(value) like 'node [%'").select(value("id").alias("id"), value("type").alias("type"), value("label").alias("label"))
    edges = lines.where("trim(value) like 'edge [%'").select(value("source").alias("source_id"), value("target").alias("target_id"), value("relation").alias("relation_type"), F.regexp_extract("value", r" weight (\S+) \]", 1).cast("double").alias("weight"))
    return nodes, edges
