"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, the least
and the greatest image; both agree between two sets with probability J, so half
the hash evaluations make a signature, and because the two are (slightly)
negatively correlated the estimate has less variance than that of as many
minima. Bands of ``rows`` values propose candidates; full shingle sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import batch_of, discard, in_arrow, made_since, materialize, release, slices, text_column
from folioforge.llm.components import components
from folioforge.llm.wordscan import mix, scan, shingles


@dataclass(frozen=True)
class MinMaxParams:
    """``k`` words a shingle; documents link when 100 * |A & B| >= ``percent`` * |A | B|.
    A pair at the threshold itself escapes all bands with probability ``miss`` at most."""

    k: int = 5
    percent: int = 80
    rows: int = 6
    miss: float = 1e-6
    seed: int = 7

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def permutations(self) -> int:
        return math.ceil(self.bands * self.rows / 2)

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.permutations
        return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def sets_of(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and where each row's begin."""
    h, first = shingles(scan(col), k)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    for r in np.flatnonzero(n > 1):
        h[first[r] : first[r + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    size = np.bincount(row[new], minlength=len(n))
    return h[new], np.concatenate([[0], np.cumsum(size)])


def signature(h: np.ndarray, first: np.ndarray, params: MinMaxParams) -> np.ndarray:
    """Rows with a shingle x 2 * permutations: minimum and maximum under each one."""
    at = first[:-1][np.diff(first) > 0]
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at), 2 * params.permutations), np.uint32)
    for i, (a, b) in enumerate(zip(*params.multipliers(), strict=True)):
        y = x * a
        y += b
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, 2 * i] = np.minimum.reduceat(y, at)
        out[:, 2 * i + 1] = np.maximum.reduceat(y, at)
    return out


def band_keys(sig: np.ndarray, params: MinMaxParams) -> np.ndarray:
    """A 64-bit key for each row and band."""
    keys = np.empty((len(sig), params.bands), np.uint64)
    for b in range(params.bands):
        acc = np.full(len(sig), b + 1, np.uint64)
        for i in range(b * params.rows, (b + 1) * params.rows):
            acc = mix(acc + sig[:, i].astype(np.uint64))
        keys[:, b] = acc
    return keys


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch], params: MinMaxParams) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in slices(whole, 1):
            h, first = sets_of(part.column(1), params.k)
            n = np.diff(first)
            some = n > 0
            a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(h):
                a[some] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first[:-1][some])
                b[some] = np.add.reduceat(mix(h + np.uint64(0x14057B7EF767814F)), first[:-1][some])
            keys = band_keys(signature(h, first, params), params) if len(h) else np.zeros((0, params.bands), np.uint64)
            ends = np.concatenate([[0], np.cumsum(some * params.bands)]).astype(np.int32)
            yield batch_of(_SIGNED, doc_id=part.column(0), text_key=part.column(2), n_shingles=n, set_a=a.view(np.int64), set_b=b.view(np.int64), bands=pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64))))


def text_key() -> Column:
    """Tells different texts of one doc_id apart."""
    return F.xxhash64("text")


def sign(docs: DataFrame, params: MinMaxParams) -> DataFrame:
    """``(doc_id, text)`` -> ``text_key``, set size, a 128-bit fingerprint of the set, band keys."""
    return in_arrow(docs.select("doc_id", "text", text_key().alias("text_key")), lambda it: _sign(it, params), "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>")


def _confirm(batches: Iterator[pa.RecordBatch], params: MinMaxParams) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts, in runs of one hub: the hub's set is kept for its run."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])
    hub, mine = None, None
    for whole in batches:
        for part in slices(whole, 3):
            ids = part.column(0).to_pylist()
            h, first = sets_of(part.column(3), params.k)
            linked = []
            for r, a in enumerate(ids):
                if a != hub:
                    hub, mine = a, sets_of(part.column(2).slice(r, 1), params.k)[0]
                own = h[first[r] : first[r + 1]]
                small, large = (own, mine) if len(own) < len(mine) else (mine, own)
                both = 0
                if len(small):
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int((large[at] == small).sum())
                linked.append(both > 0 and 100 * both >= params.percent * (len(own) + len(mine) - both))
            yield batch_of(out, a=part.column(0), b=part.column(1), linked=linked)


def near_duplicates(docs: DataFrame, params: MinMaxParams = MinMaxParams()) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, text_key, n_shingles, component_id, kept`` for every row.

    1. One pass over the texts signs them. Rows of equal shingle sets collapse to
       their smallest doc_id (an aggregation that is pre-aggregated in each task, so
       a third of all rows being one text costs nothing further).
    2. Band keys with two or more sets are buckets. Rather than all pairs of a
       bucket, each member is held against the bucket's hub (its smallest id);
       linked members then share a component. Only buckets that still hold several
       components go on, with more hubs each round (1, 8, 64, ...), until every pair
       of a bucket is linked through its component or has been tested: no link is lost.
    3. A pair is confirmed on full shingle sets computed again from both texts,
       never on signatures. Sets whose sizes alone exclude the threshold are skipped.

    Rows with a null or empty text or one without words have n_shingles 0 and are
    their own component. Rows keep their multiplicity: those that share a doc_id are
    judged by their own text each (different texts whose smallest doc_id is the same
    one share its component), and a row that repeats another is kept like it. A null
    doc_id is returned with a null component and kept. ``docs`` may be empty and may
    have any further columns; they are not read. Tables of single steps are deleted before
    it returns, so that only the result stays in the shared folder.
    """
    spark, before = docs.sparkSession, made_since()
    release()  # what earlier stages left in the driver
    signed, _ = materialize(sign(docs, params), "signed")
    classes, _ = materialize(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "sets"
    )
    members = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    members, _ = materialize(members.join(shared, "bucket"), "buckets")
    texts, _ = materialize(
        text_column(docs, "doc_id", "text").where("text is not null").join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"),
        "texts",
    )
    links = None
    tested = None
    hubs = 1
    left = members.select("bucket", "rep", "n", F.col("rep").alias("comp"))
    while True:
        pick = F.pmod(F.xxhash64("rep"), F.lit(hubs))
        heads = left.groupBy("bucket", pick.alias("slot")).agg(F.min(F.struct("rep", "n", "comp")).alias("hub")).select("bucket", "hub")
        pairs = (
            left.join(heads, "bucket")
            .where("comp <> hub.comp and 100 * least(n, hub.n) >= {0} * greatest(n, hub.n)".format(params.percent))
            .select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        new = _test(pairs, texts, params)
        new, _ = materialize(new, "tested")
        tested = new.select("a", "b") if tested is None else tested.unionByName(new.select("a", "b"))
        found = new.where("linked").select("a", "b")
        links = found if links is None else links.unionByName(found)
        comp, _ = materialize(components(links), "components")
        # on to the members that were no hub, in buckets of several components
        rest = left.join(heads.select("bucket", F.col("hub.rep").alias("rep")), ["bucket", "rep"], "left_anti").drop("comp")
        rest = rest.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("comp"))
        mixed = rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        left, _ = materialize(rest.join(mixed, "bucket", "left_semi"), "rest")
        if left.isEmpty():
            break
        hubs = hubs * 8
    same = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "text_key", "set_a", "set_b", "n_shingles")
    owner = same.join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"])
    whole = owner.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    none = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    result, result_path = materialize(whole.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates")
    discard(spark, *[p for p in made_since(before) if p != result_path])
    return result


def keep_one(docs: DataFrame, params: MinMaxParams = MinMaxParams()) -> DataFrame:
    """The rows of ``docs``, with all their columns, but for those that ``near_duplicates`` doesn't
    keep: of each group the row of the smallest doc_id stays. A row goes for its own text:
    another text with the same doc_id stays if it is kept, and so do rows with a null id."""
    copies = near_duplicates(docs, params).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(copies, (docs["doc_id"] == copies["_id"]) & (F.xxhash64(docs["text"]) == copies["_key"]), "left_anti")


def _test(pairs: DataFrame, texts: DataFrame, params: MinMaxParams) -> DataFrame:
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return in_arrow(both, lambda it: _confirm(it, params), "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))
