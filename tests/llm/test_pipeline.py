"""Each stage of the pipeline against a brute-force version, row by row, on the smallest tables
with odd rows added; and on no rows at all."""

from __future__ import annotations

import hashlib
import re

import corpus_pipeline
import numpy as np
import pytest

from folioforge.llm import decontam, secrets, toxicity
from folioforge.llm.queries import held_out
from test_llm import brute_groups, reference

DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(30_000))


def odd_rows(texts):
    """Null and repeated ids, repeated rows, null, empty and long texts, a copy under an id that another text has, too."""
    return [(None, "no id at all here", "en", "s", 17), (None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, LONG, "en", "s", len(LONG)), (9004, LONG, "en", "s", len(LONG)),
            (9005, LONG, "en", "s", 1), (9005, "another text of the same id, which is no copy", "en", "s", 1), (9006, "the same row twice", "en", "s", 1), (9006, "the same row twice", "en", "s", 1), (9007, texts[0], "en", "s", 1), (9008, "the api_key = Zq8Lw3Xn5Vb7Kc2Md9 of it", "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    base = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = [r.text for r in base.orderBy("doc_id").where("text is not null").collect()]
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents"
    odd = spark.createDataFrame(odd_rows(texts), "doc_id long, text string, lang string, source string, n_chars long")
    for c, t in base.dtypes:
        odd = odd.withColumn(c, odd[c].cast(t))
    base.unionByName(odd).withColumn("_id", odd_column()).withColumn("score", odd_column()).write.parquet(path)
    return spark.read.parquet(path)


def odd_column():
    from pyspark.sql import functions as F

    return F.lit("x")


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def brute_toxic(index, text):
    """The vote of the nearest by the cosines with all examples."""
    feature, weight = index.features(toxicity.word_counts(text or ""))
    if not len(feature):
        return index.empty
    cosine = np.zeros(len(index.share))
    for f, w in zip(feature.tolist(), weight.tolist(), strict=True):
        at = slice(index.start[index.first[f]], index.start[index.first[f + 1]])
        np.add.at(cosine, index.place[at], w * index.value[at])
    some = np.sort(cosine[cosine > 0])[::-1]
    if not len(some):
        return index.empty
    place = np.flatnonzero((cosine > 0) & (cosine >= some[min(len(some), index.params.k) - 1] - 1e-6))
    s = index.vote(cosine[place], place)
    return 1 / (1 + np.exp(-(index.slope * np.log(s / (1 - s)) + index.shift)))


def test_drop_toxic(spark, docs):
    index = toxicity.train(docs.where(~held_out()), spark.read.parquet(f"{DIR}/labels.parquet"))
    want = [r for r in rows_of(docs) if brute_toxic(index, r[1]) < 0.5]
    got = corpus_pipeline.drop_toxic(spark, docs, DIR)
    assert rows_of(got) == want and got.columns == docs.columns and 0 < len(want) < docs.count()


def test_drop_near_copies(spark, docs):
    rows = sorted(rows_of(docs.where("doc_id is not null")), key=lambda r: (r[0], r[1] or ""))
    # classes by the smallest id: the positions of sorted rows are in the order of ids
    group = [g for _, g in brute_groups([t for _, t in rows], 5, 80)]
    kept = [r for r, g in zip(rows, group, strict=True) if r[0] == rows[g][0]]
    kept += rows_of(docs.where("doc_id is null"))
    got = corpus_pipeline.drop_near_copies(spark, docs, DIR)
    assert rows_of(got) == sorted(kept, key=repr) and got.columns == docs.columns and len(kept) < docs.count()


def test_drop_contaminated(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    code, p, dropped = {}, decontam.SeedParams(), set()
    number = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws], np.int64)
    items = [number(w) for _, t in items if (w := words(t))]
    for doc_id, text in rows_of(docs):
        if text == LONG or doc_id is None:
            continue
        own = number(words(text))
        if any(decontam.smith_waterman(own, item, p)[0] / (2 * len(item)) >= p.least for item in items if np.isin(item, own).mean() >= p.least):
            dropped.add(doc_id)
    got = corpus_pipeline.drop_contaminated(spark, docs, DIR)
    gone = {r[0] for r in rows_of(docs)} - {r[0] for r in rows_of(got)}
    assert gone <= dropped and len(gone) >= 0.9 * len(dropped) and dropped
    assert rows_of(got) == [r for r in rows_of(docs) if r[0] is None or r[0] not in gone] and got.columns == docs.columns


def test_redact_secrets(spark, docs):
    scanner = secrets.train(docs)
    want = sorted(((i, t and secrets.redact_text(t, scanner.spans(t))) for i, t in rows_of(docs)), key=repr)
    got = corpus_pipeline.redact_secrets(spark, docs, DIR)
    assert rows_of(got) == want and got.columns == docs.columns and want != rows_of(docs)
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None)


def test_encode(spark, docs):
    want = []
    for i, t in rows_of(docs):
        ids = reference().encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.encode(spark, docs, DIR).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_run(spark):
    """The stages, one after the other, each on what the last one kept."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema)
    want = sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DIR).collect()) == want and len(want) > 50


def test_nothing(spark, docs):
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DIR).count() == 0, name
