"""The training corpus, stage by stage: toxic documents go, one document of each group of
near copies stays, documents with benchmark passages go, secrets are replaced, and
what is left is encoded (and decoded again as a proof).

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; between stages
the rows are written as Parquet and read again, so a lost executor repeats one
stage's tasks at most. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bbpe, decontam, minhash, secrets, toxicity
from folioforge.llm.common import discard, made_since, materialize, table
from folioforge.llm.queries import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples, a fifth held out, reject go. Each row is judged by
    its own text; null and empty texts score as labelled ones without a word do; without
    labels of both classes every row stays or none, by the share of toxic ones."""
    return toxicity.keep_clean(docs, toxicity.train(docs.where(~held_out()), table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the smallest id stays.
    Rows go for their own text; those without words, with a null id, or equal in id and text to a kept one stay."""
    return minhash.keep_one(docs, minhash.MinMaxParams(k=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go: all rows of their ids. Null and empty texts
    and null ids are clean; an empty benchmark leaves all."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    ids = found.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["_id"], "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every row stays, a null text as a null."""
    return secrets.redact(docs, secrets.train(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes, a row for each row; a null text is empty."""
    return bbpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]

#: No SQL: nearest examples, automata and the tokenizer have none; ``tests/llm/test_pipeline.py``
#: holds the stages' rows against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before = made_since()
        docs, new = materialize(stage(spark, docs, sf_dir), name)
        # what the stage's steps wrote isn't needed once its rows are
        discard(spark, *[p for p in made_since(before) if p != new], *([path] if path else []))
        path = new
    return docs
