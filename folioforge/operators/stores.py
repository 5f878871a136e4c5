"""Stores by provider: vectors and graphs as Parquet tables of keyed rows, other providers registered by whoever has their client.

A store is a log: each write is a batch of its own in the shared file system, the newest row of a
key stands, and a deletion is a row that says so. A write that fails leaves nothing half done;
``compact`` writes the log as one batch again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.operators import retrieve
from folioforge.operators.models import Embedder, embed


@dataclass(frozen=True)
class KeyedTable:
    """Rows by a key in ``path``; ``schema`` has the key."""

    spark: SparkSession
    path: str
    schema: str
    key: str

    def _folder(self):
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(conf), p

    def drop(self) -> None:
        fs, p = self._folder()
        fs.delete(p, True)

    def _batches(self) -> list[str]:
        fs, p = self._folder()
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _log(self) -> DataFrame:
        full = T.StructType([*_parsed(self.schema).fields, T.StructField("_deleted", T.BooleanType()), T.StructField("_batch", T.StringType())])
        if not self._batches():
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", self.path).parquet(self.path)

    def _write(self, rows: DataFrame, deleted: bool) -> None:
        batch = f"{time.time_ns():020d}"
        rows.withColumn("_deleted", F.lit(deleted)).write.parquet(f"{self.path}/_batch={batch}")

    def put(self, rows: DataFrame) -> None:
        """Rows replace stored ones of the same key; of equal keys among them the greatest row stands."""
        names = [f.name for f in _parsed(self.schema).fields]
        one = rows.select(*names).groupBy(self.key).agg(F.max_by(F.struct(*names), F.xxhash64(F.to_json(F.struct(*names)))).alias("m")).select("m.*")
        self._write(one, False)

    def delete(self, keys: DataFrame) -> None:
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in _parsed(self.schema).fields if f.name != self.key]
        self._write(keys.select(self.key).distinct().select(self.key, *rest).select(*[f.name for f in _parsed(self.schema).fields]), True)

    def rows(self) -> DataFrame:
        """The newest row of each key that isn't deleted."""
        names = [f.name for f in _parsed(self.schema).fields]
        log = self._log().groupBy(self.key).agg(F.max_by(F.struct(*names, "_deleted"), "_batch").alias("m"))
        return log.where(~F.col("m._deleted")).select("m.*").drop("_deleted")

    def compact(self) -> None:
        old = self._batches()
        self._write(self.rows(), False)
        fs, _ = self._folder()
        for name in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


def _parsed(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


@dataclass(frozen=True)
class VectorStore:
    """Texts, payloads and their vectors, searched exactly by cosine."""

    table: KeyedTable
    embedder: Embedder

    def add(self, rows: DataFrame) -> None:
        """``rows(segment_id, text, payload)``, as ``index.payload`` gives them."""
        self.table.put(rows.withColumn("embedding", embed(F.col("text"), self.embedder)))

    def delete(self, keys: DataFrame) -> None:
        self.table.delete(keys)

    def search(self, queries: DataFrame, k: int = 4, where: Column | None = None, least: float | None = None) -> DataFrame:
        """``queries(query_id, query)`` -> ``query_id, rank, segment_id, score, text, payload``; ``where`` is over the stored columns."""
        asked = queries.select("query_id", embed(F.col("query"), self.embedder).alias("embedding"))
        stored = self.table.rows()
        hits = retrieve.vector_search(asked, stored, k, where=where, least=least, key="segment_id")
        return hits.join(stored.select("segment_id", "text", "payload"), "segment_id").select("query_id", "rank", "segment_id", "score", "text", "payload")


@dataclass(frozen=True)
class GraphStore:
    """Nodes by id and edges by edge id."""

    nodes: KeyedTable
    edges: KeyedTable


def _vectors(spark: SparkSession, path: str, embedder: Embedder, **_) -> VectorStore:
    return VectorStore(KeyedTable(spark, path, "segment_id string, text string, payload map<string,string>, embedding array<float>", "segment_id"), embedder)


def _graph(spark: SparkSession, path: str, **_) -> GraphStore:
    nodes = "id string, type string, label string, description string, source_segment_id string"
    edges = "edge_id string, source_id string, target_id string, relation_type string, weight double, source_segment_id string"
    return GraphStore(KeyedTable(spark, f"{path}/nodes", nodes, "id"), KeyedTable(spark, f"{path}/edges", edges, "edge_id"))


VECTOR_STORES: dict[str, Callable[..., VectorStore]] = {"parquet": _vectors}
GRAPH_STORES: dict[str, Callable[..., GraphStore]] = {"parquet": _graph}


def create_vector_store(spark: SparkSession, path: str, embedder: Embedder | None, provider: str = "parquet", cleanup: bool = False, **options) -> VectorStore:
    """A vector store; ``cleanup`` empties it first. Without an embedder, or for a provider that nobody registered, this is an error."""
    if embedder is None:
        raise ValueError("a vector store needs an embedder")
    if provider not in VECTOR_STORES:
        raise ValueError(f"no vector store {provider!r}: register it in VECTOR_STORES")
    store = VECTOR_STORES[provider](spark=spark, path=path, embedder=embedder, **options)
    if cleanup:
        store.table.drop()
    return store


def create_graph_store(spark: SparkSession, path: str, provider: str = "parquet", auth: tuple[str, str] | None = None, settings: dict[str, str] | None = None, **options) -> GraphStore:
    """A graph store. Credentials are those given, else those of ``settings`` (``user`` and ``password``), else none."""
    if provider not in GRAPH_STORES:
        raise ValueError(f"no graph store {provider!r}: register it in GRAPH_STORES")
    if auth is None and settings and settings.get("user"):
        auth = settings["user"], settings.get("password", "")
    return GRAPH_STORES[provider](spark=spark, path=path, auth=auth, **options)
