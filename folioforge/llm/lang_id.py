"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The
probability of a word under a language is the sum over all its segmentations into
pieces, which a forward algorithm gives; piece probabilities are learned by
expectation maximisation over the same sums. A text's language is the one under
which its words together are likeliest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.llm.common import Memo, batch_of, in_arrow, slices, text_column

VOCABULARY = "piece_bpe_32k.model"
#: Bytes of words that a worker remembers with their scores, about.
CACHE_BYTES = 32 << 20
_LETTERS = re.compile(r"[^\W\d_]+")
#: ``_LETTERS`` takes number signs such as ``½`` or ``②`` as well; this doesn't.
_STRICT = regex.compile(r"\p{L}+")
UNKNOWN = 1e-7
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Places of a word that are looked up at a time, and cells (words by places) of a group.
_BLOCK, _CELLS = 1 << 14, 1 << 19


@dataclass(frozen=True)
class TrainParams:
    """``docs`` training documents a language at most (those of least hash). Of their words
    those of up to ``longest`` code points train; ``rounds`` of expectation maximisation;
    ``smooth`` is added to each piece's expected count."""

    docs: int = 300
    longest: int = 128
    rounds: int = 3
    smooth: float = 0.02


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _LETTERS.findall(text.lower())
    return found if not found or "".join(found).isalpha() else _STRICT.findall(text.lower())


def vocabulary(path: str) -> dict[str, int]:
    """The lower-case word pieces of a public vocabulary file, numbered from 0."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    return {p: i for i, p in enumerate(sorted({p for p in pieces if p == p.lower() and (p == "▁" or p.removeprefix("▁").isalpha())}))}


def codes_of(words: list[str]) -> np.ndarray:
    """Words of one length as words x code points, each behind the vocabulary's sign for a word start."""
    return np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)


class Pieces:
    """Finds the vocabulary's pieces, of whatever length, at all places of many words at
    once: by length, a sorted table of 64-bit hashes."""

    def __init__(self, ids: dict[str, int]) -> None:
        self.size, self.longest = len(ids), max(map(len, ids), default=1)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in sorted({len(p) for p in ids}):
            own = [p for p in ids if len(p) == m]
            h = np.zeros(len(own), np.uint64)
            for column in np.frombuffer("".join(own).encode("utf-32-le"), "<u4").reshape(-1, m).T:
                h = self._next(h, column)
            order = np.argsort(h)
            there = np.zeros(1 << 16, bool)
            there[h >> np.uint64(48)] = True
            self.tables[m] = h[order], np.array([ids[p] for p in own], np.int32)[order], there

    @staticmethod
    def _next(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        h = (h + codes.astype(np.uint64) + np.uint64(1)) * _STEP
        return h ^ (h >> np.uint64(29))

    def lattice(self, codes: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
        """Ids (``size`` where there is no piece) as starts x piece lengths x words, of the
        starts from ``low`` to ``high``."""
        n, size = codes.shape
        high = size if high is None else high
        longest = min(self.longest, size)
        out = np.full((high - low, longest, n), self.size, np.int32)
        h = np.zeros((n, high - low), np.uint64)
        for m in range(1, longest + 1):
            width = min(high, size - m + 1) - low
            if width <= 0:
                break
            h = self._next(h[:, :width], codes[:, low + m - 1 : low + m - 1 + width])
            if m not in self.tables:
                continue
            keys, values, there = self.tables[m]
            w, i = np.nonzero(there[h >> np.uint64(48)])
            at = np.minimum(np.searchsorted(keys, h[w, i]), len(keys) - 1)
            same = keys[at] == h[w, i]
            out[i[same], m - 1, w[same]] = values[at[same]]
        return out


def with_unknown(prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables with a last row for what is no piece: a single character may stand alone
    with ``UNKNOWN``, longer ones can't."""
    row = np.zeros((1, prob.shape[1]), prob.dtype)
    return np.concatenate([prob, row + UNKNOWN]), np.concatenate([prob, row])


def log_forward(pieces: Pieces, codes: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For words of one length: the log of the summed probability of all segmentations,
    words x languages. Only as many places as the longest piece has are held at a time,
    scaled again and again by word and language, so a word may have any length."""
    n, size = codes.shape
    one, more = tables
    ahead = min(pieces.longest, size)
    alpha = np.zeros((ahead + 1, n, one.shape[1]))
    alpha[0] = 1
    total = np.zeros((n, one.shape[1]))
    for low in range(0, size, _BLOCK):
        high = min(size, low + _BLOCK)
        ids = pieces.lattice(codes, low, high)
        for i in range(low, high):
            here = ids[i - low]
            alpha[1] += alpha[0] * one[here[0]]
            if ahead > 1:
                last = min(ahead, size - i)
                alpha[2 : last + 1] += alpha[0] * more[here[1:last]]
            alpha[:-1] = alpha[1:]
            alpha[-1] = 0
            if (i + 1) % 16 == 0 or i + 1 == size:
                total += np.log(alpha[0])
                alpha /= alpha[0].copy()
    return total


def _by_length(words: list[str]) -> Iterator[list[int]]:
    """Places of words of one length, in groups of a bounded number of characters."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for size, at in groups.items():
        step = max(1, _CELLS // (size + 1))
        yield from (at[i : i + step] for i in range(0, len(at), step))


def _expected(ids: np.ndarray, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over words of one length (one language). Extended
    floats hold what a word of ``longest`` unknown characters has."""
    one, more = (t[:, 0].astype(np.longdouble) for t in with_unknown(prob))
    size, longest, n = ids.shape
    alpha, beta = np.zeros((size + 1, n), np.longdouble), np.zeros((size + 1, n), np.longdouble)
    alpha[0] = beta[size] = 1
    for i in range(size):
        for m in range(1, min(size - i, longest) + 1):
            alpha[i + m] += alpha[i] * (one if m == 1 else more)[ids[i, m - 1]]
    for i in range(size - 1, -1, -1):
        for m in range(1, min(size - i, longest) + 1):
            beta[i] += (one if m == 1 else more)[ids[i, m - 1]] * beta[i + m]
    out = np.zeros(len(prob) + 1)
    share = weight / alpha[size]
    for i in range(size):
        for m in range(1, min(size - i, longest) + 1):
            out += np.bincount(ids[i, m - 1], (share * alpha[i] * more[ids[i, m - 1]] * beta[i + m]).astype(float), len(out))
    return out[:-1]


def fit(counts: dict[str, Counter], ids: dict[str, int], params: TrainParams = TrainParams()) -> tuple[list[str], np.ndarray]:
    """Piece probabilities (pieces x languages) from word counts by language."""
    langs, pieces = sorted(counts), Pieces(ids)
    prob = np.full((len(ids), max(1, len(langs))), 1 / len(ids))
    for k, lang in enumerate(langs):
        words = sorted(w for w in counts[lang] if len(w) <= params.longest)
        weight = np.array([counts[lang][w] for w in words], float)
        groups = [(pieces.lattice(codes_of([words[i] for i in at])), weight[at]) for at in _by_length(words)]
        for _ in range(params.rounds):
            use = np.full(len(ids), params.smooth)
            for steps, w in groups:
                use += _expected(steps, prob[:, k : k + 1], w)
            prob[:, k] = use / use.sum()
    return langs, prob


@dataclass
class Model:
    langs: list[str]
    ids: dict[str, int]
    prob: np.ndarray
    _row: Memo = field(default_factory=lambda: Memo(CACHE_BYTES))
    _score: np.ndarray | None = None
    _lookup: tuple | None = None

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "ids": self.ids, "prob": self.prob, "_row": Memo(CACHE_BYTES), "_score": None, "_lookup": None}

    def _learn(self, words: set[str]) -> None:
        """Log-probabilities of words not seen before, kept for later texts."""
        if self._lookup is None:
            self._lookup = Pieces(self.ids), with_unknown(self.prob)
        if self._score is None or self._row.trim():
            self._score = np.zeros((1024, len(self.langs)))
        new = list(words.difference(self._row))
        base = len(self._row)
        if base + len(new) > len(self._score):
            self._score = np.concatenate([self._score, np.zeros((base + 2 * len(new) - len(self._score), len(self.langs)))])
        for at in _by_length(new):
            self._score[base + np.array(at)] = log_forward(self._lookup[0], codes_of([new[j] for j in at]), self._lookup[1])
        for i, w in enumerate(new):
            self._row[w] = base + i
        self._row.charge(sum(map(len, new)) + len(new) * (160 + 8 * len(self.langs)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        words = [words_of(t) if t else [] for t in texts]
        self._learn(set().union(*words))
        langs, scores = [], []
        for w in words:
            if not w:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self._score[np.fromiter(map(self._row.__getitem__, w), np.int64, len(w))].sum(0)
            k = int(np.argmax(total))
            langs.append(self.langs[k])
            scores.append(float(1 / np.exp(np.maximum(total - total[k], -700)).sum()))
        return langs, scores


def train(labelled: DataFrame, params: TrainParams = TrainParams(), path: str | None = None) -> Model:
    """``labelled(doc_id, text, lang)`` -> a model. The texts are a bounded sample: for each
    language the ``params.docs`` documents of least hash (a doc_id that several rows
    have is one document, with the least text of them). Its word counts are made on the
    executors; the driver gets those of the sample, and holds pieces x languages numbers."""
    ids = vocabulary(path or public_tokenizers.path(VOCABULARY))
    labelled = labelled.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "text", "lang")
    ranked = labelled.select("doc_id", "lang", F.dense_rank().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")).alias("rank"))
    chosen = ranked.where(F.col("rank") <= params.docs).select("doc_id", "lang").distinct()  # a bounded number of ids a language, cut in each task already
    sample = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    out = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
            rows = list(found.items())
            yield batch_of(out, lang=[k for (k, _), _ in rows], word=[w for (_, w), _ in rows], n=[n for _, n in rows])

    totals = in_arrow(sample, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {}
    for lang, word, n in totals.collect():  # as many as the bounded sample has
        counts.setdefault(lang, Counter())[word] = n
    found, prob = fit(counts, ids, params)
    return Model(found, ids, prob)


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, lang_pred, score``: the posterior of the
    likeliest language over the whole text, with equal priors. Null texts and those
    without a letter are ``und`` with score 0. One narrow pass; rows keep their
    multiplicity, a null doc_id stays null, other columns aren't read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                langs, scores = shared.value.predict(part.column(1).to_pylist())
                yield batch_of(_PREDICTED, doc_id=part.column(0), lang_pred=langs, score=scores)

    return in_arrow(text_column(docs, "doc_id", "text"), run, "doc_id long, lang_pred string, score double")
