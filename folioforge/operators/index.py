"""Indexing: what is embedded, payloads, keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.operators.models import Embedder, embed


def flatten(df: DataFrame, columns: list[str]) -> Column:
    """Columns as a map of strings: null is empty, a list is joined by comma and space, a
    struct or map is JSON."""
    kinds = {f.name: f.dataType for f in df.schema}
    parts = []
    for c in columns:
        kind = kinds[c]
        if isinstance(kind, T.ArrayType):
            v = F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
        elif isinstance(kind, (T.StructType, T.MapType)):
            v = F.to_json(c)
        else:
            v = F.col(c).cast("string")
        parts += [F.lit(c), F.coalesce(v, F.lit(""))]
    return F.create_map(*parts)


def embed_text(summary: Column, content: Column) -> Column:
    """The summary where there is one, else the content."""
    return F.coalesce(F.nullif(summary, F.lit("")), content)


def payload(segments: DataFrame, summary: str = "summary", with_content: bool = True, extra: list[str] | None = None) -> DataFrame:
    """``segment_id, text, payload``: what an index stores beside the vector."""
    has = F.nullif(F.col(summary), F.lit("")).isNotNull()
    rows = segments.withColumn("is_summary_embedding", has)
    names = [*(["content"] if with_content else []), "segment_id", "type", "original_format", "is_summary_embedding", *(extra or [])]
    flat = flatten(rows, names)
    parent = F.when(F.col("parent_id").isNotNull(), F.create_map(F.lit("parent_id"), F.col("parent_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select("segment_id", embed_text(F.col(summary), F.col("content")).alias("text"), F.map_concat(flat, parent).alias("payload"))


def index(segments: DataFrame, embedder: Embedder, vectors_path: str, store_path: str, parents: DataFrame | None = None, with_content: bool = True) -> None:
    """Write the document store (parents if given, else the segments) and the vectors. Each
    write is atomic, so a task lost on the way leaves nothing half done."""
    (parents if parents is not None else segments).write.mode("append").parquet(store_path)
    rows = payload(segments, with_content=with_content)
    rows.withColumn("embedding", embed(F.col("text"), embedder)).write.mode("append").parquet(vectors_path)


# --- keyed tables ---------------------------------------------------------------------------


def upsert(stored: DataFrame, new: DataFrame, key: str = "segment_id") -> DataFrame:
    """New rows replace stored ones of the same key; of equal new keys the row of the greatest hash stands."""
    one = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), F.xxhash64(F.to_json(F.struct(*new.columns)))).alias("_m")).select("_m.*")
    return stored.join(new.select(key), key, "left_anti").unionByName(one)


def get(stored: DataFrame, keys: DataFrame, key: str = "segment_id") -> DataFrame:
    """``keys(position, key)`` in order, nulls for what isn't there."""
    return keys.join(stored, key, "left").orderBy("position")


def delete(stored: DataFrame, keys: DataFrame, key: str = "segment_id") -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def keys_of(stored: DataFrame, prefix: str = "", key: str = "segment_id") -> DataFrame:
    return stored.where(F.startswith(F.col(key), F.lit(prefix))).select(key)


def to_documents(segments: DataFrame) -> DataFrame:
    """Segments as documents: the id, the content, and metadata with the segment's own fields."""
    own = F.create_map(F.lit("level"), F.col("level").cast("string"), F.lit("path"), F.array_join("path", "/"), F.lit("type"), F.col("type"), F.lit("original_format"), F.col("original_format"))
    ids = F.map_filter(F.create_map(F.lit("segment_id"), F.col("segment_id"), F.lit("parent_id"), F.col("parent_id")), lambda _, v: v.isNotNull() & (v != ""))
    free = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("level", "path", "type", "original_format", "segment_id", "parent_id"))
    return segments.select(F.col("segment_id").alias("id"), "content", F.map_concat(free, own, ids).alias("metadata"))


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of the greatest ``seq`` of each key."""
    w = W.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
