"""Shared plumbing: the cluster's scratch folder, materialised steps, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text a Python worker handles at a time; one longer text is taken alone.
SLICE_BYTES = 2 << 20
#: Bytes of a batch between the JVM and a Python worker at most, but for one longer row.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only
    for a local master on which none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def made_since(n: int | None = None) -> int | list[str]:
    """How many paths ``scratch`` gave so far; with such a number, the paths given since. What a lazy result still reads may only be deleted once that has been written elsewhere."""
    return len(_made) if n is None else _made[n:]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared file system."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: the lineage ends there,
    so a lost executor costs no recomputation. Returns the table and its path."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def text_column(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that other ones (of whatever name) don't travel."""
    return df.select(*[F.col(c) for c in columns])


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part have ``limit`` bytes at most,
    or are one text."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    offsets = text_offsets(col)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end


def text_offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows in them;
    a null has no bytes."""
    if col.null_count:
        col = col.fill_null("")
    offsets = text_offsets(col)
    data = col.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.record_batch([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class Memo(dict):
    """What a Python worker remembers from text to text, bounded in bytes: whoever adds
    says about how many (``charge``), and ``trim`` forgets all once they are more than ``limit``."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.held = limit, 0

    def charge(self, n_bytes: int) -> None:
        self.held += n_bytes

    def trim(self) -> bool:
        if self.held <= self.limit:
            return False
        self.clear()
        self.held = 0
        return True

    def __reduce__(self) -> tuple:
        return Memo, (self.limit,)  # what is remembered stays in its process


@lru_cache(1)
def _trim():
    """The C library's call that gives free memory back to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def release() -> None:
    """At the end of a task: workers live on for other stages, so give back what this one used."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of which the driver keeps no second copy in Python: it lies in a file there."""
    shared = spark.sparkContext.broadcast(value)
    shared.__dict__.pop("_value", None)  # loaded again if the driver itself asks for it
    return shared


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes; memory is given back at a task's end."""
    conf = df.sparkSession.conf
    if not 0 < _bytes(conf.get(_BATCH)) <= BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)


def _bytes(size: str) -> int:
    """A size as Spark's settings have it."""
    number = size.rstrip("bBkKmMgG")
    return int(number or 0) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[size[len(number) :].lower()[:1]]
