"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Test items are cut into n-grams of words, the seeds, whose document frequency is counted
first. A rare seed joins a training passage to all items that have it. A frequent one (in many
documents or in many items) joins it to those items only of which the document has one of
the rarer words: any passage that can reach the least score has one, so nothing is lost and
boilerplate joins nothing. Joined passages are aligned by Smith-Waterman over
words, which also scores edited or paraphrased copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import batch_of, in_arrow, discard, materialize, slices, text_column
from folioforge.llm.wordscan import Words, scan, shingles


@dataclass(frozen=True)
class SeedParams:
    """``n`` words a seed (all words of a shorter item). A pair whose alignment has
    ``least`` of the item's best score is contaminated. ``mismatch`` and ``gap`` are
    0 at most."""

    n: int = 4
    least: float = 0.5
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    #: A seed is rare in up to ``few`` documents or this ``rare`` share of them, and ``few`` items.
    few: int = 10
    rare: float = 1e-4
    #: Items up to so many words go to every task (about 60 bytes each); more are handled in
    #: groups of that size, each by passes of its own.
    shared_seeds: int = 1_000_000


def seeds_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed hash, row and word position of every window."""
    h, first = shingles(words, n)
    size = np.diff(first)
    return h, np.repeat(np.arange(len(size)), size), np.arange(len(h)) - np.repeat(first[:-1], size)


def smith_waterman(a: np.ndarray, b: np.ndarray, p: SeedParams) -> tuple[int, int, int]:
    """Best local alignment of b with a, by rows of b: its score, and the half-open range
    of a that it covers."""
    if not len(a) or not len(b):
        return 0, 0, 0
    width = len(a) + 1
    ramp = -p.gap * np.arange(width)
    score = np.zeros(width, np.int64)
    start = np.arange(width)
    best = (0, 0, 0)
    for w in b:
        move = np.where(a == w, p.match, p.mismatch)
        diagonal = score[:-1] + move
        above = score + p.gap
        new = above.copy()
        origin = start.copy()
        better = diagonal >= new[1:]
        new[1:][better] = diagonal[better]
        origin[1:][better] = start[:-1][better]
        fresh = new <= 0
        new[fresh] = 0
        origin[fresh] = np.arange(width)[fresh]
        # gaps along a: the running maximum of score + |gap| * position
        lifted = new + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(width), 0))
        new = top - ramp
        origin = np.where(new > 0, origin[source], np.arange(width))
        new = np.maximum(new, 0)
        score, start = new, origin
        j = int(np.argmax(score))
        if score[j] > best[0]:
            best = (int(score[j]), int(start[j]), j)
    return best


_SCORED = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])
_SCORED_DDL = "doc_id long, item_id long, score double, start_word long, end_word long"
#: Alignments that a task keeps, so that equal passages cost one.
KEPT = 20_000


class Items:
    """Test items by seed hash: for each seed length the sorted seeds, and of seed s the
    items and places ``first[s]`` to ``first[s + 1]``, sorted by item."""

    def __init__(self, rows: list[tuple[int, list[int]]], p: SeedParams) -> None:
        self.few, rows = p.few, [r for r in rows if r[1]]
        self.ids = [i for i, _ in rows]
        self.words = [np.array(w, np.int64) for _, w in rows]
        self.values = [np.unique(w, return_counts=True) for w in self.words]
        size = np.array([len(w) for w in self.words], np.int64)
        flat = np.concatenate([*self.words, np.zeros(0, np.int64)]).view(np.uint64)
        bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        words = Words(np.zeros(0, np.uint8), bounds, bounds, bounds, bounds, flat)
        self.lengths = sorted(set(np.minimum(p.n, size).tolist()))
        self.seeds, self.first, self.item, self.place, self.wide, self.bits = {}, {}, {}, {}, {}, {}
        for k in self.lengths:
            h, row, at = seeds_of(words, k)
            own = np.minimum(p.n, size[row]) == k
            h, row, at = h[own], row[own], at[own]
            order = np.lexsort((at, row, h))
            h, self.item[k], self.place[k] = h[order], row[order].astype(np.int32), at[order].astype(np.int32)
            self.seeds[k], start = np.unique(h, return_index=True)
            self.first[k] = np.append(start, len(h))
            self.wide[k] = np.diff(self.first[k]) > p.few
            self.bits[k] = np.zeros(1 << 22, bool)
            self.bits[k][self.seeds[k] >> np.uint64(42)] = True
        # of each item its rarer words: without any of them too few are left for the least score
        value, inverse, spread = np.unique(flat, return_inverse=True, return_counts=True)
        rare_word, rare_item = [], []
        for i in range(len(rows)):
            w = inverse[bounds[i] : bounds[i + 1]]
            need = max(1, int(np.ceil(p.least * len(w) - 1e-9)))
            rarest = np.unique(w[np.lexsort((w, spread[w]))[: len(w) - need + 1]])
            rare_word.append(rarest)
            rare_item.append(np.full(len(rarest), i, np.int32))
        rare_word, rare_item = np.concatenate([*rare_word, np.zeros(0, np.int64)]), np.concatenate([*rare_item, np.zeros(0, np.int32)])
        order = np.lexsort((rare_item, rare_word))
        self.rare_item = rare_item[order]
        own, start = np.unique(rare_word[order], return_index=True)
        self.rare_word, self.rare_first = value[own.astype(np.int64)], np.append(start, len(order))

    def _find(self, words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, word position and number of all seeds of length k that some item has."""
        h, row, at = seeds_of(words, k)
        found = np.flatnonzero(self.bits[k][h >> np.uint64(42)])
        seed = np.minimum(np.searchsorted(self.seeds[k], h[found]), len(self.seeds[k]) - 1)
        ok = (self.seeds[k][seed] == h[found]) & (words.counts[row[found]] >= k)
        return row[found[ok]], at[found[ok]], seed[ok]

    def frequencies(self, words: Words) -> dict[int, np.ndarray]:
        """For each seed length, the documents that have each seed."""
        out = {}
        for k in self.lengths:
            row, _, seed = self._find(words, k)
            pair = np.unique(row * np.int64(len(self.seeds[k])) + seed)
            out[k] = np.bincount(pair % max(1, len(self.seeds[k])), minlength=len(self.seeds[k]))
        return out

    def mark_frequent(self, k: int, seeds: list[int]) -> None:
        self.wide[k][seeds] = True

    def _likely(self, words: Words, row: int) -> np.ndarray:
        """Items of which the document has a rarer word, sorted."""
        own = np.unique(words.hash[words.first[row] : words.first[row + 1]])
        at = np.minimum(np.searchsorted(self.rare_word, own), len(self.rare_word) - 1)
        at = at[self.rare_word[at] == own]
        return np.unique(np.concatenate([*(self.rare_item[self.rare_first[i] : self.rare_first[i + 1]] for i in at.tolist()), np.zeros(0, np.int32)]))

    def hits(self, words: Words, ids: list[int]) -> Iterator[tuple]:
        """For each row and item: the runs of seeds along a diagonal, as the place and the words around."""
        likely: dict[int, np.ndarray] = {}
        for k in self.lengths:
            groups: dict[tuple[int, int], list[int]] = {}
            for r, at, s in zip(*(x.tolist() for x in self._find(words, k)), strict=True):
                low, high = self.first[k][s], self.first[k][s + 1]
                items, places = self.item[k][low:high], self.place[k][low:high]
                if self.wide[k][s]:
                    if r not in likely:
                        likely[r] = self._likely(words, r)
                    ok = np.isin(items, likely[r])
                    items, places = items[ok], places[ok]
                for item, q in zip(items.tolist(), places.tolist(), strict=True):
                    groups.setdefault((r, item), []).append(at - q)
            for (r, item), seen in groups.items():
                size = len(self.words[item])
                slack = 8 + size // 3
                seen.sort()
                run: list[int] = []
                for x in [*seen, 1 << 60]:
                    if run and x > run[0] + slack:
                        low, high = max(0, run[0] - slack), min(int(words.counts[r]), run[-1] + size + slack)
                        s = words.first[r]
                        yield ids[r], item, low, words.hash[s + low : s + high].view(np.int64)
                        run = []
                    run.append(x)

    def in_reach(self, item: int, window: np.ndarray, least: float) -> bool:
        """Whether the window has so many of the item's words (each as often as the item
        at most) that its alignment can score ``least``: every match uses up one."""
        values, counts = self.values[item]
        at = np.minimum(np.searchsorted(values, window), len(values) - 1)
        common = np.minimum(np.bincount(at[values[at] == window], minlength=len(values)), counts).sum()
        return common / counts.sum() >= least

    def scored(self, words: Words, ids: list[int], p: SeedParams, kept: dict[tuple[int, bytes], tuple[int, int, int]]) -> Iterator[tuple]:
        """The contaminated pairs among ``hits``: score and range of words. ``kept`` has
        the alignments of earlier passages."""
        for doc, item, at, window in self.hits(words, ids):
            if not self.in_reach(item, window, p.least):
                continue
            key = (item, window.tobytes())
            if key not in kept:
                if len(kept) >= KEPT:
                    kept.clear()
                kept[key] = smith_waterman(window, self.words[item], p)
            s, low, high = kept[key]
            score = s / (p.match * len(self.words[item]))
            if score >= p.least:
                yield doc, self.ids[item], score, at + low, at + high


def item_words(items: DataFrame) -> DataFrame:
    """``(item_id, text)`` -> word hashes of each item; items without words go."""
    out = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                w = scan(part.column(1), alnum=True)
                yield batch_of(out, item_id=part.column(0), words=[w.hash[a:b].view(np.int64) for a, b in zip(w.first[:-1], w.first[1:], strict=True)])

    items = text_column(items, "item_id", "text").where("item_id is not null and text is not null")
    return in_arrow(items, run, "item_id long, words array<long>").where("size(words) > 0").groupBy("item_id").agg(F.min("words").alias("words"))


def contamination(docs: DataFrame, items: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """``docs(doc_id, text, ...)`` and ``items(item_id, text, ...)`` -> one row for each
    contaminated pair: ``doc_id, item_id, score`` (share of the item's best alignment
    score) and ``start_word, end_word`` of the passage.

    One pass over whole texts counts the documents of each seed, a second one finds windows that
    share a seed with an item and aligns each of them there; equal windows of a task are
    aligned once. Nothing but seed counts and contaminated pairs is shuffled. Items go to
    the tasks while they have ``shared_seeds`` words at most (counted first); larger benchmarks are handled in
    groups of that size. Words are runs of letters and digits,
    case folded. Null texts and those without words are clean; a null doc_id is dropped.
    Equal doc_ids are one document, of repeated item_ids the one with the least words stands. Other columns
    aren't read, and either table may be empty.
    """
    spark = docs.sparkSession
    known, known_path = materialize(item_words(items), "items")
    total = known.agg(F.sum(F.size("words"))).head()[0] or 0
    groups = max(1, -(-total // params.shared_seeds))
    texts = text_column(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    found = None
    for g in range(groups if total else 0):
        part = known if groups == 1 else known.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        one = _of_group(texts, Items([(r[0], list(r[1])) for r in part.orderBy("item_id").toLocalIterator()], params), params)
        found = one if found is None else found.unionByName(one)
    if found is None:
        discard(spark, known_path)
        return spark.createDataFrame([], _SCORED_DDL)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", -F.col("start_word"), -F.col("end_word"))).alias("m"))
    result, _ = materialize(best.select("doc_id", "item_id", F.col("m.score").alias("score"), (-F.col("m.col2")).alias("start_word"), (-F.col("m.col3")).alias("end_word")), "contaminated")
    discard(spark, known_path)
    return result


_COUNTED = pa.schema([("k", pa.int64()), ("seed", pa.int64()), ("n", pa.int64())])


def _of_group(texts: DataFrame, items: Items, params: SeedParams) -> DataFrame:
    """The contaminated pairs with some items. No more rows than they have seeds reach the driver."""
    sc = texts.sparkSession.sparkContext
    plain = sc.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, rows = {k: np.zeros(len(s), np.int64) for k, s in plain.value.seeds.items()}, 0
        for whole in batches:
            for chunk in slices(whole, 1):
                rows += len(chunk)
                for k, n in plain.value.frequencies(scan(chunk.column(1), alnum=True)).items():
                    mine[k] += n
        yield batch_of(_COUNTED, k=[0], seed=[0], n=[rows])
        for k, n in mine.items():
            some = np.flatnonzero(n)
            yield batch_of(_COUNTED, k=np.full(len(some), k), seed=some, n=n[some])

    counted, path = materialize(in_arrow(texts, count, "k long, seed long, n long").groupBy("k", "seed").agg(F.sum("n").alias("n")), "seeds")
    rows = sum(r[0] for r in counted.where("k = 0").select("n").collect())
    often: dict[int, list[int]] = {}
    for k, seed in counted.where((F.col("k") > 0) & (F.col("n") > max(params.few, params.rare * rows))).select("k", "seed").toLocalIterator():
        often.setdefault(k, []).append(seed)
    for k, seeds in often.items():
        items.mark_frequent(k, seeds)
    discard(texts.sparkSession, path)
    index = sc.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for whole in batches:
            for chunk in slices(whole, 1):
                pairs = list(index.value.scored(scan(chunk.column(1), alnum=True), chunk.column(0).to_pylist(), params, kept))
                yield batch_of(_SCORED, **{f.name: [r[i] for r in pairs] for i, f in enumerate(_SCORED)})

    return in_arrow(texts, run, _SCORED_DDL)
