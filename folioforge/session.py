"""Session defaults."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What plans here rely on; everything else is the cluster's own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "folioforge", **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` overrides (dots written as two underscores)."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only on a local master
    that has none set."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """End the lineage by a checkpoint in the shared folder. The rows are kept until they are written,
    as a checkpoint would compute them twice otherwise."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch_root(df.sparkSession))
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        return df.checkpoint()
    kept = df.persist()
    out = kept.checkpoint()
    kept.unpersist()
    return out


#: Bytes of a batch between the JVM and a Python worker at most, but for one longer row: what a
#: function makes of a text (lists of dicts, blocks with their markup) is many times larger.
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches() -> None:
    """Bound batches by bytes, not by rows alone; for functions over texts of any length. A lower bound stays."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
        if not 0 < now <= BATCH_BYTES:
            spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
