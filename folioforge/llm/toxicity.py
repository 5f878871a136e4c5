"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over all words of the labelled examples, and over the beginnings
of words that tell the classes apart, so that inflected forms share some. A
feature's weight is its inverse document frequency times its correlation with the label
(supervised term weighting), both from the examples. Examples stand in an inverted
index whose postings are cut into blocks; each block keeps the greatest weight of every
feature in it. A query takes blocks in order of their upper bound and stops once
no other block can hold a nearer example: the cosines are exact. Neighbours vote with a
weight that falls with distance, and the vote is calibrated by what examples
get from the others.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import Memo, batch_of, discard, in_arrow, materialize, release, share, slices

_LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes of words that a worker remembers with their features, about.
CACHE_BYTES = 24 << 20
#: Blocks that a query looks at first, for a bound on the others.
FIRST = 8


@dataclass(frozen=True)
class ToxicityParams:
    """``docs``: labelled documents of either class that are learned from at most (those
    of least hash); ``calibrate``: how many of either class the vote is calibrated with. Every
    word that ``least`` examples have is a feature; a beginning of words is one if the chi-square of its
    correlation with the label is ``chi2`` or more, too. ``k`` neighbours vote; ``prior`` is the weight
    of the base rate among the votes; ``block`` is how many examples share a block."""

    docs: int = 1500
    calibrate: int = 300
    least: int = 2
    chi2: float = 30.0
    k: int = 15
    prior: float = 0.25
    block: int = 64


def stems_of(word: str) -> list[str]:
    """The beginnings of 4 to 10 characters that go on."""
    return [word[:k] for k in range(4, min(len(word), 11))]


def word_counts(text: str) -> Counter:
    return Counter(_LETTERS.findall(text.lower()))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)


@dataclass
class Relevance:
    """How the label's share differs with a feature: ``a`` and ``b`` of the ``n1`` toxic and ``n0`` clean
    examples have it; ``pi`` is the share of toxic documents among all labelled ones."""

    a: np.ndarray
    b: np.ndarray
    n1: float
    n0: float
    pi: float

    def chi2(self) -> np.ndarray:
        a, b, n1, n0 = self.a, self.b, self.n1, self.n0
        return (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / (n1 * n0 * (a + b) * (n1 - a + n0 - b) + 1e-9)

    def weights(self) -> np.ndarray:
        """Inverse document frequency times correlation, at the classes' true sizes."""
        p1, p0 = self.a / max(1, self.n1), self.b / max(1, self.n0)
        p = self.pi * p1 + (1 - self.pi) * p0
        phi = math.sqrt(self.pi * (1 - self.pi)) * np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12))
        return (1 - np.log(np.maximum(p, 1e-12))) * phi


@dataclass
class Index:
    """Examples as postings. Feature f's entries (one a block) are ``first[f]`` to ``first[f + 1]``; entry e
    stands for block ``block_of[e]``, whose greatest weight of f is ``most[e]``, and owns the postings
    ``start[e]`` to ``start[e + 1]``: an example's place and its weight. Features that a twentieth of the
    examples have keep theirs as rows of ``dense`` (``row_of``, else -1), cut into the same blocks. All is bounded by
    the sample. ``share`` is how many of an example's documents are toxic; equal texts are one example."""

    words: dict[str, int]
    stems: dict[str, int]
    weight: np.ndarray
    first: np.ndarray
    block_of: np.ndarray
    most: np.ndarray
    start: np.ndarray
    place: np.ndarray
    value: np.ndarray
    share: np.ndarray
    ids: list[int]
    base: float
    empty: float
    slope: float = 1.0
    shift: float = 0.0
    params: ToxicityParams = field(default_factory=ToxicityParams)
    row_of: np.ndarray | None = None
    dense: np.ndarray | None = None
    _known: Memo = field(default_factory=lambda: Memo(CACHE_BYTES))

    @classmethod
    def build(cls, rows: Iterable[tuple[int, int, dict[str, int]]], sizes: dict[int, int], params: ToxicityParams = ToxicityParams()) -> Index:
        """``rows``: an example's id, label and word counts; ``sizes``: the labelled documents of each class.
        Rows may come in any order, one at a time."""
        total = sum(sizes.values())
        pi = (sizes.get(1, 0) + 0.5) / (total + 1)
        seen: dict[str, int] = {}
        groups: dict[bytes, list] = {}  # distinct texts: words, counts, least id, toxic, clean
        labels = [0, 0]
        for doc_id, toxic, counts in rows:
            own = np.fromiter((seen.setdefault(w, len(seen)) for w in counts), np.int32, len(counts))
            order = np.argsort(own)
            own, n = own[order], np.fromiter(counts.values(), np.int32, len(counts))[order]
            entry = groups.setdefault(own.tobytes() + n.tobytes(), [own, n, doc_id, 0, 0])
            entry[2] = min(entry[2], doc_id)
            entry[4 - toxic] += 1
            labels[toxic] += 1
        bare = groups.pop(b"", [None, None, 0, 0, 0])
        bare = [bare[3] * sizes.get(1, 0) / max(1, labels[1]), bare[4] * sizes.get(0, 0) / max(1, labels[0])]
        empty = (bare[0] + pi) / (sum(bare) + 1)
        examples = sorted(groups.values(), key=lambda e: e[2])
        yes, no = np.array([e[3] for e in examples], float), np.array([e[4] for e in examples], float)
        n1, n0 = yes.sum(), no.sum()
        if not n1 or not n0:
            none, zero = np.zeros(0), np.zeros(0, np.int64)
            return cls({}, {}, none, np.zeros(1, np.int64), zero, none, np.zeros(1, np.int64), zero, none, none, [], pi, pi, params=params, row_of=zero, dense=np.zeros((0, 0, params.block), np.float32))

        words = {w: i for i, w in enumerate(sorted(seen))}  # the same in whatever order the rows came
        moved = np.empty(len(words), np.int32)
        for w, i in seen.items():
            moved[i] = words[w]
        hashes, wide = array("Q"), np.empty(len(words), np.int64)
        for w, i in words.items():
            below = stems_of(w)
            wide[i] = len(below) + 1
            hashes.extend(map(xxhash.xxh64_intdigest, below))
        hashes, stem = np.unique(np.frombuffer(hashes, np.uint64), return_inverse=True)
        # word i's features: itself, and its beginnings behind all words
        first_of = np.concatenate([[0], np.cumsum(wide)])
        flat = np.empty(first_of[-1], np.int32)
        flat[first_of[:-1]] = np.arange(len(words))
        rest = np.ones(len(flat), bool)
        rest[first_of[:-1]] = False
        flat[rest] = stem + len(words)
        n_all = len(words) + len(hashes)

        def triples(low: int, high: int, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Example, feature and count of the examples from ``low`` to ``high``."""
            part = examples[low:high]
            word, n = moved[np.concatenate([e[0] for e in part])], np.concatenate([e[1] for e in part])
            doc = np.repeat(np.arange(low, low + len(part)), [len(e[0]) for e in part])
            feature = flat[_ranges(first_of[word], wide[word])]
            doc, n = np.repeat(doc, wide[word]), np.repeat(n, wide[word])
            if keep is not None:
                ok = keep[feature]
                doc, n, feature = doc[ok], n[ok], feature[ok]
            pair, inverse = np.unique(doc.astype(np.int64) * n_all + feature, return_inverse=True)
            return pair // n_all, pair % n_all, np.bincount(inverse, n, len(pair))

        step = 128  # examples at a time: their beginnings of words are many
        found = Relevance(np.zeros(n_all), np.zeros(n_all), n1, n0, pi)
        for low in range(0, len(examples), step):
            doc, feature, _ = triples(low, low + step, None)
            found.a += np.bincount(feature, yes[doc], n_all)
            found.b += np.bincount(feature, no[doc], n_all)
        keep = np.arange(n_all) < len(words)
        keep |= found.chi2() >= params.chi2
        keep &= found.a + found.b >= params.least
        to = np.cumsum(keep) - 1
        parts = [triples(low, low + step, keep) for low in range(0, len(examples), step)]
        doc, feature, tf = (np.concatenate([x[i] for x in parts]) for i in range(3))
        feature, tf = to[feature], 1 + np.log(tf)
        found = Relevance(found.a[keep], found.b[keep], n1, n0, pi)
        weight = found.weights()
        spelled = list(words)
        kept = dict(zip(hashes[keep[len(words) :]].tolist(), to[len(words) :][keep[len(words) :]].tolist(), strict=True))
        words = {w: int(to[i]) for w, i in words.items() if keep[i]}
        stems = {x: kept[h] for w in spelled for x in stems_of(w) if (h := xxhash.xxh64_intdigest(x)) in kept} if kept else {}

        # like examples share blocks: in order of their strongest features
        x = tf * weight[feature]
        order = np.lexsort((feature, -x, doc))
        lead = order[np.searchsorted(doc[order], np.arange(len(examples)))]
        placed = np.lexsort((np.arange(len(examples)), -x[lead], feature[lead]))
        place_of = np.empty(len(examples), np.int64)
        place_of[placed] = np.arange(len(examples))
        norm = np.sqrt(np.bincount(doc, x * x, len(examples)))
        index = cls._of_postings(words, stems, weight, feature, place_of[doc], x / np.maximum(norm[doc], 1e-12), params)
        index.share, index.ids, index.base, index.empty = (yes / (yes + no))[placed], [examples[i][2] for i in placed], n1 / (n1 + n0), empty
        index._calibrate(found, [(place_of[i], lambda e=e: {spelled[moved[w]]: n for w, n in zip(e[0].tolist(), e[1].tolist(), strict=True)}, e[3], e[4]) for i, e in enumerate(examples)], sizes)
        return index

    @classmethod
    def _of_postings(cls, words: dict, stems: dict, weight: np.ndarray, feature: np.ndarray, place: np.ndarray, value: np.ndarray, params: ToxicityParams) -> Index:
        order = np.lexsort((place, feature))
        feature, place, value = feature[order], place[order].astype(np.int32), value[order].astype(np.float32)
        block = place // params.block
        new = np.ones(len(place), bool)
        new[1:] = (feature[1:] != feature[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        most = np.maximum.reduceat(value, at) if len(at) else value
        first = np.searchsorted(feature[at], np.arange(len(weight) + 1))
        start, count = np.append(at, len(place)), np.bincount(feature, minlength=len(weight))
        size = params.block * (int(block.max()) + 1 if len(block) else 0)
        long = np.flatnonzero(count >= max(params.block, size / 20))
        row_of = np.full(len(weight), -1, np.int32)
        row_of[long] = np.arange(len(long))
        dense = np.zeros((len(long), size), np.float32)
        own = row_of[feature] >= 0
        dense[row_of[feature[own]], place[own]] = value[own]
        return cls(words, stems, weight, first, block[at], most, start, place, value, np.zeros(0), [], 0.5, 0.5, params=params, row_of=row_of, dense=dense.reshape(len(long), size // params.block, params.block))

    def features(self, counts: dict[str, int], weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The text's features and their weights, a vector of length 1 (or no feature)."""
        known = self._known
        known.trim()
        hits = list(map(known.get, counts))
        if None in hits:
            for i, w in enumerate(counts):
                if hits[i] is None:
                    own = tuple(self.stems[s] for s in stems_of(w) if s in self.stems)
                    if w in self.words:
                        own += (self.words[w],)
                    hits[i] = known[w] = own
                    known.charge(len(w) + 120 + 8 * len(own))
        ids = list(chain.from_iterable(hits))
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0)
        tf = np.repeat(np.fromiter(counts.values(), float, len(counts)), list(map(len, hits)))
        feature, inverse = np.unique(np.array(ids), return_inverse=True)
        x = (1 + np.log(np.bincount(inverse, tf))) * (self.weight if weight is None else weight)[feature]
        norm = math.sqrt(x @ x)
        return (feature, x / norm) if norm > 1e-9 else (np.zeros(0, np.int64), np.zeros(0))

    def nearest(self, feature: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k nearest examples, and of all that tie with the last."""
        k, none = self.params.k, (np.zeros(0), np.zeros(0, np.int64))
        n = self.first[feature + 1] - self.first[feature] if len(feature) else np.zeros(0, np.int64)
        entry = _ranges(self.first[feature], n) if n.sum() else np.zeros(0, np.int64)
        if not len(entry):
            return none
        own = np.repeat(weight, n)
        block, row = self.block_of[entry], self.row_of[feature]
        bound = np.bincount(block, own * self.most[entry])
        order = np.argsort(-bound, kind="stable")
        wide = row >= 0
        rows, weights, short = row[wide], weight[wide].astype(np.float32), np.repeat(~wide, n)
        entry, own, block = entry[short], own[short], block[short]
        first, rest = order[:FIRST], order[FIRST:]
        score, place = self._score(first, entry, own, block, rows, weights)
        if len(rest):
            least = np.partition(score, -k)[-k] if len(score) >= k else 0.0
            rest = rest[bound[rest] >= max(least - 1e-5, 1e-9)]  # no other block can hold a nearer one
            if len(rest):
                more, there = self._score(rest, entry, own, block, rows, weights)
                score, place = np.concatenate([score, more]), np.concatenate([place, there])
        if not len(score):
            return none
        least = np.partition(score, -k)[-k] if len(score) >= k else 0.0
        near = score >= least - 1e-6
        score, place = score[near], place[near]
        by = np.lexsort((place, -score))
        return score[by], place[by]

    def _score(self, blocks: np.ndarray, entry: np.ndarray, own: np.ndarray, block: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines above 0 within some blocks, and whose they are: postings of the entries there, and dense rows."""
        size = self.params.block
        chosen = np.zeros(self.dense.shape[1], bool)
        chosen[blocks] = True
        mine = np.flatnonzero(chosen[block])
        e = entry[mine]
        sizes = self.start[e + 1] - self.start[e]
        at = _ranges(self.start[e], sizes)
        found = np.bincount(self.place[at], np.repeat(own[mine], sizes) * self.value[at], len(chosen) * size).astype(float, copy=False)
        blocks = np.flatnonzero(chosen)
        if len(rows):
            part = self.dense[rows] if len(blocks) == len(chosen) else self.dense[rows[:, None], blocks]
            found.reshape(-1, size)[blocks] += np.tensordot(weights, part, 1)
        hit = np.flatnonzero(found > 0)
        return found[hit], hit

    def vote(self, cosine: np.ndarray, place: np.ndarray) -> float:
        """Share of toxic neighbours by a weight that falls with distance."""
        near = np.minimum(cosine, 1) ** 2
        w = near / np.maximum(0.1, 1.1 - near)
        return float((w @ self.share[place] + self.params.prior * self.base) / (w.sum() + self.params.prior))

    def _calibrate(self, found: Relevance, examples: list[tuple], sizes: dict[int, int]) -> None:
        """Fit the logistic map from votes to probabilities on examples that the others judge:
        an example is no neighbour of its own, and its label counts in no weight of its vector."""
        less = {1: Relevance(np.maximum(found.a - 1, 0), found.b, found.n1 - 1, found.n0, found.pi).weights(), 0: Relevance(found.a, np.maximum(found.b - 1, 0), found.n1, found.n0 - 1, found.pi).weights()}
        x, y, w = [], [], []
        for toxic in (1, 0):
            own = [(p, c, e[1 - toxic]) for p, c, *e in examples if e[1 - toxic]][: self.params.calibrate]
            used = sum(n for _, _, n in own)
            for p, counts, n in own:
                q, v = self.features(counts(), less[toxic])
                cosine, place = self.nearest(q, v)
                others = place != p
                s = self.vote(cosine[others], place[others])
                x.append(math.log(s / (1 - s)))
                y.append(toxic)
                w.append(n * sizes.get(toxic, 0) / used)
        x, y, w = np.array(x), np.array(y, float), np.array(w)
        if y.sum() < 20 or len(y) - y.sum() < 20:  # too few: only the classes' sizes are put right
            true = found.pi / (1 - found.pi)
            self.slope, self.shift = 1.0, math.log(true / (self.base / (1 - self.base)))
            return
        w *= len(w) / w.sum()
        soft = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        beta = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(beta[0] * x + beta[1], -30, 30)))
            g = np.array([(w * (p - soft)) @ x, (w * (p - soft)).sum()]) + 0.1 * (beta - [1.0, 0.0])
            h = w * p * (1 - p)
            step = np.linalg.solve(np.array([[h @ (x * x), h @ x], [h @ x, h.sum()]]) + 0.1 * np.eye(2), g)
            beta -= np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = max(0.05, float(beta[0])), float(beta[1])

    def score(self, counts: dict[str, int]) -> tuple[float, list[int]]:
        """Probability of the toxic label, and the documents of the nearest examples."""
        if not len(self.share):
            return self.empty, []
        cosine, place = self.nearest(*self.features(counts))
        if not len(place):
            return self.empty, []
        s = self.vote(cosine, place)
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * math.log(s / (1 - s)) + self.shift)))), [self.ids[i] for i in place[:5]]


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> Index:
    """``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` -> the index.

    The class sizes are counted over all labelled documents; examples are a bounded sample of
    each class. Labels are joined to ids alone, and the ids of the sample are few
    enough to go to every task: no text but the sample's is shuffled. A doc_id that several rows of ``docs`` have is
    one document, with the least text of them; one with labels that contradict each other, a null
    id, text or label teaches nothing. Without documents of both classes every score is the base rate."""
    spark = docs.sparkSession
    there = docs.where("text is not null and doc_id is not null").select("doc_id")
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").cast("long").alias("toxic"), F.max("toxic").cast("long").alias("most")).where("toxic = most").drop("most")
    marked, marked_at = materialize(marks.join(there, "doc_id", "left_semi"), "labelled")
    sizes = {int(t): n for t, n in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        discard(spark, marked_at)
        return Index.build([], sizes, params)
    chosen = None
    for toxic, n in sorted(sizes.items()):
        # a little over the sample's share by hash, of which the least are the sample: little is sorted
        share = min(1.0, (1.2 * params.docs + 100) / n)
        h = F.xxhash64("doc_id")
        part = marked.where((F.col("toxic") == toxic) & (F.pmod(h, F.lit(1 << 30)) <= int(share * (1 << 30)))).orderBy(F.pmod(h, F.lit(1 << 30)), h, "doc_id").limit(params.docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen, chosen_at = materialize(chosen, "examples")
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most 2 * docs ids
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 2):
                found = [word_counts(t) for t in part.column(2).to_pylist()]
                yield batch_of(out, doc_id=part.column(0), toxic=part.column(1), words=[list(c) for c in found], counts=[list(c.values()) for c in found])

    rows = in_arrow(sample.select("doc_id", "toxic", "text"), count, "doc_id long, toxic long, words array<string>, counts array<long>").toLocalIterator()
    index = Index.build(((i, t, dict(zip(w, n, strict=True))) for i, t, w, n in rows), sizes, params)
    release()
    discard(spark, marked_at, chosen_at)
    return index


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.list_(pa.int64()))])


def score(docs: DataFrame, index: Index) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, score, predicted, evidence`` for every row:
    ``evidence`` lists the labelled documents nearest to it. Whole texts are read in one
    narrow pass. Texts without a feature (null and empty ones among them) score as
    such labelled ones do; rows keep their multiplicity, a null doc_id stays null, other columns aren't read."""
    shared = share(docs.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                found = [shared.value.score(word_counts(t or "")) for t in part.column(1).to_pylist()]
                yield batch_of(_SCORED, doc_id=part.column(0), score=[s for s, _ in found], predicted=[int(s >= 0.5) for s, _ in found], evidence=[e for _, e in found])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int, evidence array<long>")


def keep_clean(docs: DataFrame, index: Index) -> DataFrame:
    """The rows of ``docs`` whose text doesn't score as toxic, with all their columns, in
    the one pass that scores them (no join by id, so repeated and null ids stay)."""
    shared = share(docs.sparkSession, index)
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, at):
                clean = [shared.value.score(word_counts(t or ""))[0] < 0.5 for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(clean, pa.bool_()))

    return in_arrow(docs, run, schema)
