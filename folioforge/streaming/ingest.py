"""Streams: documents into segments as they arrive, keyed upserts, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators import split


def read_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def segment_stream(docs: DataFrame, out: str, checkpoint: str, size: int = 200, overlap: int = 20) -> StreamingQuery:
    """Token windows of new documents appended to Parquet; with the query's own checkpoint
    each document is written once, whatever fails in between."""
    segments = split.token_windows(docs, size, overlap)
    return segments.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_stream(rows: DataFrame, key: str, order: str, out: str, checkpoint: str) -> StreamingQuery:
    """Rows by key into a log: a micro-batch writes its own rows only, of each key that of the
    greatest ``order`` (of equal ones that of the greatest hash). A batch that runs again
    writes the same folder again. ``read_upserts`` is the table, ``compact_upserts`` shortens the log."""

    def batch(df: DataFrame, n: int) -> None:
        one = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(order), F.xxhash64(*df.columns))).alias("m")).select("m.*")
        one.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserts(spark: SparkSession, key: str, out: str) -> DataFrame:
    """Of each key the row of the latest batch."""
    log = spark.read.parquet(out)
    names = [c for c in log.columns if c != "batch"]
    return log.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("m")).select("m.*")


def compact_upserts(spark: SparkSession, key: str, out: str) -> None:
    """All batches as the latest one, written beside the log first."""
    conf, Path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(out).getFileSystem(conf)
    batches = sorted((s.getPath().getName() for s in fs.listStatus(Path(out)) if s.getPath().getName().startswith("batch=")), key=lambda n: int(n[6:]))
    read_upserts(spark, key, out).write.mode("overwrite").parquet(f"{out}/.compacted")
    for name in reversed(batches):
        fs.delete(Path(f"{out}/{name}"), True)
        if name == batches[-1]:
            fs.rename(Path(f"{out}/.compacted"), Path(f"{out}/{name}"))


def event_counts(events: DataFrame, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums by event type. The event time is cast to a zoned timestamp,
    which watermarks need."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key's first row within the watermark: repeats of pages and blocks go."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
