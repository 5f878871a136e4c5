"""Recursive trees of summaries: embed, cluster, summarise, level by level."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import script_of, summary_budget
from folioforge.operators.models import Embedder, embed, extractive_summary
from folioforge.session import cut

Cluster = Callable[[DataFrame], DataFrame]


#: Rows of a clustering that one task may hold (at most about 16 MB of reduced vectors).
IN_ONE_TASK = 50_000
SEED = 224


def reduce_vectors(x: np.ndarray, dim: int) -> np.ndarray:
    """The first ``dim`` principal components of unit vectors, so that distances are by angle."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    x = x - x.mean(0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    return x @ axes[:dim].T


def fit_mixture(x: np.ndarray, k: int, seed: int = SEED, rounds: int = 100) -> tuple[np.ndarray, float]:
    """A mixture of k Gaussians with full covariances: memberships and log-likelihood."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    centre = x[rng.integers(n)][None]
    for _ in range(1, k):  # far ones are likelier to be the next centre
        far = ((x[:, None] - centre[None]) ** 2).sum(2).min(1)
        centre = np.vstack([centre, x[rng.choice(n, p=far / far.sum()) if far.sum() > 0 else rng.integers(n)]])
    own = np.eye(k)[((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)]
    before = -np.inf
    for _ in range(rounds):
        size = own.sum(0) + 1e-9
        mean = own.T @ x / size[:, None]
        logs = np.empty((n, k))
        for j in range(k):
            off = x - mean[j]
            cover = (own[:, j, None] * off).T @ off / size[j] + 1e-6 * np.eye(d)
            root = np.linalg.cholesky(cover)
            logs[:, j] = np.log(size[j] / n) - 0.5 * (np.linalg.solve(root, off.T) ** 2).sum(0) - np.log(np.diag(root)).sum() - 0.5 * d * math.log(2 * math.pi)
        top = logs.max(1, keepdims=True)
        each = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        own, now = np.exp(logs - each[:, None]), float(each.sum())
        if now - before < 1e-3 * n:
            break
        before = now
    return own, now


def soft_clusters(x: np.ndarray, threshold: float, most: int) -> list[np.ndarray]:
    """For each row its clusters of a membership above ``threshold`` (the greatest one if none is),
    of the mixture of least BIC among those of 1 to ``most`` - 1 parts, fewer than there are rows."""
    n, d = x.shape
    best, least = np.ones((n, 1)), math.inf
    for k in range(1, max(2, min(most, n))):
        own, loglik = fit_mixture(x, k)
        bic = (k * (d + d * (d + 1) / 2) + k - 1) * math.log(n) - 2 * loglik
        if bic < least:
            best, least = own, bic
    return [found if len(found := np.flatnonzero(row > threshold)) else np.array([row.argmax()]) for row in best]


def _in_task(dim: int, threshold: float, most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment_id").reset_index(drop=True)
        x = np.stack(pdf["embedding"]).astype(float)
        found = [np.array([0])] * len(x) if len(x) <= dim + 1 else soft_clusters(reduce_vectors(x, min(dim, len(x) - 1)), threshold, most)
        return pd.DataFrame([(i, g, int(c)) for i, g, cs in zip(pdf["segment_id"], pdf["part"], found, strict=True) for c in cs], columns=["segment_id", "part", "cluster"])

    return run


def _spread(rows: DataFrame, dim: int, threshold: float, most: int) -> DataFrame:
    """The same search over rows that are too many for a task: components and mixtures by distributed fits."""
    n = rows.count()
    data = cut(rows.select("segment_id", array_to_vector("embedding").alias("x")))
    d = min(dim, len(data.head()["x"]))
    low = cut(PCA(k=d, inputCol="x", outputCol="features").fit(data).transform(data).select("segment_id", "features"))
    best, least = None, math.inf
    for k in range(2, most):
        model = GaussianMixture(k=k, seed=SEED, maxIter=100).fit(low)
        bic = (k * (d + d * (d + 1) / 2) + k - 1) * math.log(n) - 2 * model.summary.logLikelihood
        if bic < least:
            best, least = model, bic
    probability = best.transform(low).select("segment_id", F.posexplode(vector_to_array("probability")).alias("cluster", "p"))
    return probability.where(F.col("p") > threshold).select("segment_id", F.lit(0).alias("part"), "cluster")


def mixture_clusters(rows: DataFrame, dim: int = 10, threshold: float = 0.1, most: int = 50) -> DataFrame:
    """``(segment_id, embedding)`` -> ``(segment_id, cluster)``, soft, in two steps: clusters of all rows,
    then clusters within each of them. Vectors are reduced by principal components, anew in
    each step; the number of parts of a mixture is that of least BIC of all up to
    ``most`` - 1. Up to dim + 1 rows are one cluster. A step over more than ``IN_ONE_TASK`` rows
    (counted) is fitted over all executors, one over fewer in a task."""

    def step(part: DataFrame) -> DataFrame:
        """``part`` has one group or several; those that are too large go on their own."""
        sizes = {r[0]: r[1] for r in part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > IN_ONE_TASK).collect()}
        small = part.where(~F.col("part").isin(list(sizes))) if sizes else part
        out = small.groupBy("part").applyInPandas(_in_task(dim, threshold, most), f"segment_id {kind}, part int, cluster int")
        for g in sorted(sizes):
            out = out.unionByName(_spread(part.where(F.col("part") == g), dim, threshold, most).withColumn("part", F.lit(g)))
        return out

    kind = dict(rows.dtypes)["segment_id"]
    first = cut(step(rows.select("segment_id", "embedding", F.lit(0).alias("part"))))
    second = step(first.select("segment_id", F.col("cluster").alias("part")).join(rows, "segment_id"))
    return second.select("segment_id", (F.col("part") * most + F.col("cluster")).alias("cluster"))


def validate(summary: Column, children: Column, most: Column | int) -> Column:
    """``hard``: empty, no shorter than the children, or in another script; ``soft``: over budget."""
    other = script_of(summary) != script_of(children)
    hard = F.when(F.length(F.trim(summary)) == 0, "empty").when(F.length(summary) >= F.length(children), "not shorter").when(F.coalesce(other, F.lit(False)), "language")
    return F.struct(hard.alias("error"), (F.length(summary) > most).alias("exceeds_max_chars"))


SEPARATOR = "\n\n---\n\n"


def build(leaves: DataFrame, embedder: Embedder, levels: int = 3, *, cluster: Cluster | None = None, summarize: Callable[[str, int], str] = extractive_summary, ratio: float = 0.3, least: int = 200, most: int = 2000, strict: bool = False) -> DataFrame:
    """``leaves(segment_id, content)`` -> all segments with ``raptor_level``, ``child_ids``, the
    budget of their summary, its length as a share of the children's (``ratio``), and what ``validate`` says
    of it. Each level: embed, cluster, one summary a cluster; it
    ends at one summary or after ``levels``. ``strict``: a hard ``error`` fails the job."""
    cluster = cluster or mixture_clusters
    none = [F.lit(None).cast(t).alias(c) for c, t in (("budget", "int"), ("ratio", "double"), ("error", "string"), ("exceeds_max_chars", "boolean"))]
    now = cut(leaves.select("segment_id", "content", F.lit(0).alias("raptor_level"), F.array().cast("array<string>").alias("child_ids"), *none))
    out = now

    @F.pandas_udf("string")
    def short(text: pd.Series, budget: pd.Series) -> pd.Series:
        return pd.Series([summarize(t, int(b)) for t, b in zip(text, budget, strict=True)])

    for level in range(1, levels + 1):
        embedded = cut(now.withColumn("embedding", embed(F.col("content"), embedder)))
        grouped = cluster(embedded.select("segment_id", "embedding")).join(now, "segment_id")
        packed = grouped.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("segment_id", "content"))).alias("x"))
        made = packed.withColumn("_t", F.array_join(F.transform("x", lambda s: s["content"]), SEPARATOR)).withColumn("_b", summary_budget(F.length("_t"), ratio, least, most)).withColumn("_s", short("_t", "_b"))
        found = validate(F.col("_s"), F.col("_t"), F.col("_b"))
        error = found["error"]
        if strict:
            error = F.when(error.isNotNull(), F.raise_error(F.concat(F.lit(f"summary at level {level}: "), error)).cast("string"))
        made = made.select(
            F.md5(F.concat_ws(",", F.lit(str(level)), F.transform("x", lambda s: s["segment_id"]))).alias("segment_id"), F.col("_s").alias("content"), F.lit(level).alias("raptor_level"),
            F.transform("x", lambda s: s["segment_id"]).alias("child_ids"), F.col("_b").alias("budget"), F.bround(F.length("_s") / F.length("_t"), 4).alias("ratio"), error.alias("error"), found["exceeds_max_chars"].alias("exceeds_max_chars"),
        )
        now = cut(made.dropDuplicates(["segment_id"]))
        out = out.unionByName(now)
        if now.count() <= 1:
            break
    return out


def finalize(tree: DataFrame) -> DataFrame:
    """Parents of every segment, ``parent_id`` where there is exactly one, depth from the roots
    by least distance."""
    edges = cut(tree.select(F.col("segment_id").alias("parent"), F.explode("child_ids").alias("child")).distinct())
    parents = edges.groupBy(F.col("child").alias("segment_id")).agg(F.sort_array(F.collect_set("parent")).alias("parent_ids"))
    rows = tree.join(parents, "segment_id", "left").withColumn("parent_ids", F.coalesce("parent_ids", F.array().cast("array<string>")))
    wave = cut(rows.where(F.size("parent_ids") == 0).select("segment_id", F.lit(0).alias("depth_from_root")))
    depth = wave
    while True:
        wave = wave.join(edges, F.col("segment_id") == F.col("parent")).select(F.col("child").alias("segment_id"), (F.col("depth_from_root") + 1).alias("depth_from_root")).distinct().join(depth.select("segment_id"), "segment_id", "left_anti")
        wave = cut(wave)
        if wave.isEmpty():
            break
        depth = cut(depth.unionByName(wave))
    return rows.join(depth, "segment_id", "left").withColumn("parent_id", F.when(F.size("parent_ids") == 1, F.get("parent_ids", F.lit(0))))
