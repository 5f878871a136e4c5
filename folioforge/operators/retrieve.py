"""Atomic retrievers: a table of queries against a corpus, ranked rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.session import cut

#: Queries that one pass over the corpus answers; more are answered in blocks of so many.
QUERY_BLOCK = 1024
#: Rows whose scores for a block of queries a task holds at a time.
ROW_BLOCK = 1024
#: Queries whose candidates of a block of rows are scored exactly at a time: all rows may be, where scores tie.
QUERY_PART = 64


def top_k(scored: DataFrame, k: int, *order: str | Column, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The k first rows of each query in a total order (the plan keeps k a task before it shuffles)."""
    return scored.withColumn(rank, F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def in_blocks(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a scan for a stated set of queries: at most about ``QUERY_BLOCK`` (counted first)
    are broadcast to a pass over the corpus; a larger set is several passes."""
    groups = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for g in range(groups):
        part = queries if groups == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        out = search(F.broadcast(part))
        found = out if found is None else found.unionByName(out)
    return found


def vector_search(queries: DataFrame, corpus: DataFrame, k: int = 4, *, where: Column | None = None, least: float | None = None, key: str = "vec_id") -> DataFrame:
    """Exact top k by cosine: ``queries(query_id, embedding)`` against
    ``corpus(<key>, embedding)``. ``where`` filters the corpus before the search (and is
    pushed to its scan), ``least`` is a threshold on the cosine. Each task multiplies ``ROW_BLOCK`` of its
    rows at a time with a block of queries in single precision, scores exactly what may be among the k first
    and keeps k a query, so it holds a block of scores and the shuffle is k rows a query and task.
    Empty, mismatched and zero vectors have cosine 0. Ties by key."""
    spark = corpus.sparkSession
    if where is not None:
        corpus = corpus.where(where)
    rows = corpus.select(key, "embedding")
    kind = dict(corpus.dtypes)[key]
    found = None
    wanted = queries.select("query_id", "embedding").toLocalIterator(prefetchPartitions=True)
    while (part := [(q[0], None if q[1] is None else np.array(q[1], np.float64)) for q in islice(wanted, QUERY_BLOCK)]) or found is None:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids = [q for q, _ in shared.value]
            by_size: dict[int, list[int]] = {}
            for i, (_, v) in enumerate(shared.value):
                by_size.setdefault(len(v) if v is not None else 0, []).append(i)
            sides = [(size, np.array(at), *_sides([shared.value[i][1] for i in at])) for size, at in by_size.items() if size]
            best = (np.zeros(0, np.int64), np.zeros(0), None)  # query, score and key of the k first so far
            floor = np.full(len(ids), -np.inf)  # what a row must score to be among them
            for batch in batches:
                for low in range(0, len(batch), ROW_BLOCK):
                    vectors, keys = batch["embedding"].to_numpy()[low : low + ROW_BLOCK], batch[key].to_numpy()[low : low + ROW_BLOCK]
                    sizes = np.array([0 if v is None else len(v) for v in vectors])
                    rough, slack, pairs = np.zeros((len(ids), len(keys)), np.float32), 0.0, []
                    for size, at, y, ys, unit in sides:
                        mine = np.flatnonzero(sizes == size)
                        if len(mine):
                            x, xs, units = _sides(vectors[mine])
                            if len(at) == len(ids) and len(mine) == len(keys):
                                rough = unit.T @ units
                            else:
                                rough[np.ix_(at, mine)] = unit.T @ units
                            slack = max(slack, (size + 8) * 2.0**-22)
                            pairs.append((at, mine, y, ys, x, xs))
                    for q, r in _candidates(rough, floor, slack, k):
                        scores = np.zeros(len(q))
                        for at, mine, y, ys, x, xs in pairs:
                            i, j = _places(at, q, len(ids)), _places(mine, r, len(keys))
                            both = np.flatnonzero((i >= 0) & (j >= 0))
                            scores[both] = _cosines(y, ys, i[both], x, xs, j[both])
                        some = np.flatnonzero(~(scores < floor[q]))
                        if len(some):
                            q, r, scores = q[some], r[some], scores[some]
                            met = np.zeros(len(ids), bool)
                            met[q] = True
                            again = met[best[0]]  # the others stay as they are
                            new = _first_k(np.concatenate([best[0][again], q]), np.concatenate([best[1][again], scores]), keys[r] if best[2] is None else np.concatenate([best[2][again], keys[r]]), k)
                            best = new if best[2] is None else tuple(np.concatenate([a[~again], b]) for a, b in zip(best, new, strict=True))
                            last = np.full(len(ids), -np.inf)
                            last[new[0]] = new[1]  # the worst comes last
                            floor = np.fmax(floor, np.where(np.bincount(new[0], minlength=len(ids)) >= k, last, -np.inf))
            if len(best[0]):
                names = np.empty(len(ids), object)
                names[:] = ids
                yield pd.DataFrame({"query_id": list(names[best[0]]), key: best[2], "score": best[1]})

        out = rows.mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, {key} {kind}, score double")
        found = out if found is None else found.unionByName(out)
    if least is not None:
        found = found.where(F.col("score") >= least)
    return top_k(found, k, F.desc("score"), key)


def _sides(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of one length as columns, their squared norms and, in single precision, their directions: 0 for a
    zero vector, NaN where a norm is too large or too small to divide by."""
    x = np.ascontiguousarray(np.stack(vectors).astype(np.float64).T)
    square = np.zeros(x.shape[1])
    with np.errstate(all="ignore"):
        for row in x:
            square += row * row
        unit = x / np.where(square > 0, np.sqrt(square), 1)
    unit[:, (x != 0).any(0) & ~((square > 1e-100) & (square < 1e100))] = np.nan
    return x, square, unit.astype(np.float32)


def _cosines(y: np.ndarray, ys: np.ndarray, i: np.ndarray, x: np.ndarray, xs: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the columns ``i`` of one side and ``j`` of the other, summed in order: a pair's score depends on its
    two vectors only, so equal rows tie wherever they are (a matrix product rounds by position)."""
    with np.errstate(all="ignore"):
        dot = np.zeros(len(i))
        for a, b in zip(y, x, strict=True):
            dot += a[i] * b[j]
        ys, xs = ys[i], xs[j]
        square = ys * xs
        norm = np.where((square > 1e-290) & (square < 1e290), np.sqrt(square), np.sqrt(ys) * np.sqrt(xs))
        return np.clip(np.divide(dot, norm, out=np.zeros(len(dot)), where=norm > 0), -1, 1)


def _candidates(rough: np.ndarray, floor: np.ndarray, slack: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of queries and rows that may be among the k first, some at a time: those whose rough score is not
    ``slack`` or more below the floor or, if these are many, below the k-th of the block."""
    least = (floor - slack).astype(np.float32)
    if rough.shape[1] > k > 0 and np.count_nonzero(rough >= least[:, None]) > 4 * k * len(rough):
        for low in range(0, len(rough), QUERY_PART):
            part = -rough[low : low + QUERY_PART]
            part.partition(k - 1, axis=1)
            least[low : low + QUERY_PART] = np.fmax(least[low : low + QUERY_PART], -part[:, k - 1] - np.float32(2 * slack))
    near = ~(rough < least[:, None])
    step = len(near) if np.count_nonzero(near) <= QUERY_PART * near.shape[1] else QUERY_PART
    for low in range(0, len(near), step):
        at = np.flatnonzero(near[low : low + step])
        if len(at):
            q, r = np.divmod(at, near.shape[1])
            yield q + low, r


def _places(at: np.ndarray, wanted: np.ndarray, n: int) -> np.ndarray:
    """Where ``wanted`` numbers, of 0 to n - 1, are in ``at``; -1 if they aren't."""
    place = np.full(n, -1)
    place[at] = np.arange(len(at))
    return place[wanted]


def _first_k(query: np.ndarray, score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, best first, ties by key; in order of the queries."""
    order = np.lexsort((np.unique(keys, return_inverse=True)[1], -np.where(np.isnan(score), np.inf, score), query))  # NaN first, as in Spark's order
    query = query[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    order = order[rank < k]
    return query[rank < k], score[order], keys[order]


def mmr(queries: DataFrame, corpus: DataFrame, k: int = 4, fetch: int = 20, weight: float = 0.5, key: str = "vec_id") -> DataFrame:
    """Maximal marginal relevance among the ``fetch`` nearest: each step takes the candidate
    of the greatest weight * sim(query) - (1 - weight) * max sim(chosen)."""
    near = vector_search(queries, corpus, fetch, key=key)
    vectors = near.join(corpus.select(key, "embedding"), key)
    kind, qkind = dict(corpus.dtypes)[key], dict(queries.dtypes)["query_id"]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        x = np.stack(pdf["embedding"]).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        sim = pdf["score"].to_numpy()
        taken: list[int] = []
        worst = np.full(len(pdf), -np.inf)
        gains = []
        while len(taken) < min(k, len(pdf)):
            gain = weight * sim - (1 - weight) * (np.where(np.isinf(worst), 0, worst))
            gain[taken] = -np.inf
            i = int(np.argmax(np.round(gain, 9)))  # of equal gains the nearer one
            gains.append(gain[i])
            taken.append(i)
            worst = np.maximum(worst, x @ x[i])
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "rank": range(1, len(taken) + 1), key: pdf[key].to_numpy()[taken], "score": sim[taken], "mmr_score": gains})

    return vectors.groupBy("query_id").applyInPandas(pick, f"query_id {qkind}, rank int, {key} {kind}, score double, mmr_score double")


def literal_scan(queries: DataFrame, corpus: DataFrame, *, text: str = "content", meta: str | None = None) -> DataFrame:
    """Rows whose text (or metadata rendered as a string) contains a query, ignoring case,
    taken literally. ``queries(query_id, query)`` is a stated set: it's broadcast."""
    hit = F.contains(F.lower(F.col(text)), F.lower("query"))
    if meta:
        hit = hit | F.contains(F.lower(F.col(meta)), F.lower("query"))
    return in_blocks(queries, lambda q: corpus.join(q, hit))


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - indel distance / total length); 100 for two empty strings."""
    if not a and not b:
        return 100.0
    return 200.0 * lcs(a, b) / (len(a) + len(b))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window (of its length, or cut by an end) of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    best, n = 0.0, len(a)
    for i in range(-n + 1, len(b)):
        best = max(best, indel_ratio(a, b[max(0, i) : i + n]))
        if best == 100.0:
            break
    return best


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, p, q = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not p or not q):
        return 100.0
    left, right = (common + " " + p).strip(), (common + " " + q).strip()
    scores = [indel_ratio(left, right)]
    if common:
        scores += [indel_ratio(common, left), indel_ratio(common, right)]
    return max(scores)


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def w_ratio(a: str, b: str) -> float:
    """A weighted best of the others: partial scores count where the lengths differ much."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = indel_ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    scale = 0.9 if longer < 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * token_set_ratio(a, b))


SCORERS = {"ratio": indel_ratio, "partial_ratio": partial_ratio, "token_set_ratio": token_set_ratio, "wratio": w_ratio}


def fuzzy_scan(queries: DataFrame, corpus: DataFrame, *, text: str = "content", threshold: float = 80.0, mode: str = "partial_ratio") -> DataFrame:
    """All rows that a scorer gives ``threshold`` or more, with ``fuzzy_score``. An unknown
    mode is ``partial_ratio``. The stated queries are broadcast; rows are scored in batches."""
    score = SCORERS.get(mode, partial_ratio)

    @F.pandas_udf("double")
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([score(a, b or "") for a, b in zip(q, t, strict=True)])

    pairs = in_blocks(queries, lambda q: corpus.join(q, F.lit(True)))
    return pairs.withColumn("fuzzy_score", scored("query", text)).where(F.col("fuzzy_score") >= threshold)


#: Characters of a query that fit the bits of a word.
WORD = 64


def _near_texts(texts: pa.Array, asked: list[str], most: int) -> pa.Array:
    """For each text the codes ``i * (most + 1) + distance`` of the queries ``asked[i]`` (of up to ``WORD``
    characters) within ``most`` edits. Columns of the edit table are bit vectors (Myers) and
    equal beginnings of texts share theirs: a text costs about one step a query, not one a character."""
    longest = max(map(len, asked), default=0)
    given = texts.to_pylist()
    distinct = sorted({t for t in given if t is not None and len(t) <= longest + most})
    size = np.array([len(t) for t in distinct], np.int64)
    chars = np.zeros((len(distinct), int(size.max(initial=0))), np.uint32)
    for i, t in enumerate(distinct):
        chars[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = np.cumprod(chars[1:] == chars[:-1], 1, dtype=np.int8).sum(1, dtype=np.int64)
    shared = np.concatenate([np.zeros(min(1, len(distinct)), np.int64), np.minimum(same, np.minimum(size[1:], size[:-1]))])
    letters, codes = np.unique(chars, return_inverse=True)
    row = {int(c): i for i, c in enumerate(letters)}
    codes = codes.reshape(chars.shape)
    # depth by depth: which texts end, at which row of the table; from which rows the next ones come, by which letter
    plan, node = [], np.zeros(len(distinct), np.int64)
    for depth in range(chars.shape[1] + 1):
        ended, live = np.flatnonzero(size == depth), np.flatnonzero(size > depth)
        at = node[ended]
        if not len(live):
            plan.append((ended, at, None, None))
            break
        # a text goes on with the row of the one before if all between begin with the same characters
        heads = np.minimum.reduceat(shared, np.concatenate([[0], live[:-1] + 1])) <= depth
        heads[0] = True
        plan.append((ended, at, node[live[heads]], codes[live[heads], depth]))
        node[live] = np.cumsum(heads) - 1
    rows, found, one = [], [], np.uint64(1)
    step = max(1, (1 << 18) // max(1, len(distinct)))
    for low in range(0, len(asked), step):
        part = asked[low : low + step]
        masks = np.zeros((len(letters), len(part)), np.uint64)
        for j, q in enumerate(part):
            for k, c in enumerate(q):
                if (at := row.get(ord(c))) is not None:
                    masks[at, j] |= np.uint64(1 << k)
        length = np.array([len(q) for q in part], np.int64)
        last = np.array([max(0, len(q) - 1) for q in part], np.uint64)
        up, down = np.full((1, len(part)), ~np.uint64(0)), np.zeros((1, len(part)), np.uint64)
        score = length[None].astype(np.int16)
        for depth, (ended, at, before, letter) in enumerate(plan):
            if len(ended):
                d = score[at]
                r, q = np.nonzero(d <= most)
                rows.append(ended[r])
                found.append((low + q) * (most + 1) + d[r, q])
            if before is None:
                break
            up, down, score = up[before], down[before], score[before]
            eq = masks[letter]
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | ~(xh | up), up & xh
            score = score + ((ph >> last) & one).astype(np.int16) - ((mh >> last) & one).astype(np.int16)
            score[:, length == 0] = depth + 1
            ph, mh, xv = (ph << one) | one, mh << one, eq | down
            up, down = mh | ~(xv | ph), ph & xv
    text = np.concatenate([*rows, np.zeros(0, np.int64)])
    order = np.argsort(text, kind="stable")
    code = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int32)[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(distinct)))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(code))
    place = {t: i for i, t in enumerate(distinct)}
    return lists.take(pa.array([place.get(t) for t in given], pa.int64()))


def levenshtein_scan(queries: DataFrame, corpus: DataFrame, most: int, *, text: str = "content") -> DataFrame:
    """The built-in edit distance, with its cut-off: another metric than the fuzzy scan's. Distinct queries
    of up to ``WORD`` characters are compared with a batch of texts at once, longer ones pair by pair. A row
    meets all queries, so even a small corpus is spread over all cores first."""
    spark = corpus.sparkSession
    corpus = corpus.repartition(4 * spark.sparkContext.defaultParallelism)
    low = F.lower(F.col("query"))

    def one_by_one(q: DataFrame) -> DataFrame:
        d = F.levenshtein(F.lower(F.col(text)), low, most)
        return corpus.join(q, d >= 0).withColumn("distance", d)

    def together(q: DataFrame) -> DataFrame:
        asked = sorted(r[0] for r in q.select(low).distinct().collect())  # those of a block of queries

        @F.arrow_udf("array<int>")
        def near(texts: pa.Array) -> pa.Array:
            return _near_texts(texts, asked, most)

        numbered = q.join(F.broadcast(spark.createDataFrame(list(enumerate(asked)), "_q int, _asked string")), low == F.col("_asked")).drop("_asked")
        hits = corpus.withColumn("_hit", F.explode(near(F.lower(F.col(text)))))
        hits = hits.withColumn("_q", F.floor(F.col("_hit") / (most + 1)).cast("int")).withColumn("distance", F.col("_hit") % (most + 1))
        found = hits.join(F.broadcast(numbered), "_q")
        return found.select(*corpus.columns, *q.columns, "distance")

    long = queries.where(F.length(low) > WORD)
    found = in_blocks(queries.where(F.length(low) <= WORD), together)
    return found if long.isEmpty() else found.unionByName(in_blocks(long, one_by_one))


def bm25(queries: DataFrame, corpus: DataFrame, k: int = 4, *, key: str = "doc_id", text: str = "content", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi BM25 over tokens split at white space. A term's negative idf is replaced by
    ``epsilon`` times the mean idf. Each query has k rows, score 0 among them.

    Document frequencies are counted over distinct terms of each row, combined in each task.
    A block of queries goes to every task with its terms, so only their postings are
    aggregated by row; nothing else of a text is shuffled.
    """
    words = corpus.select(F.col(key), F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+"), lambda x: x != "").alias("w"))
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w").cast("double")).alias("avgdl"))
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = cut(df.crossJoin(F.broadcast(stats.select("n"))).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw")))
    facts = cut(idf.agg(F.avg("raw").alias("mean")).crossJoin(F.broadcast(stats.select("avgdl"))))  # one row

    def search(block: DataFrame) -> DataFrame:
        terms = block.select("query_id", F.explode(F.filter(F.split("query", r"(?U)\s+"), lambda x: x != "")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        weights = idf.join(F.broadcast(terms), "term").crossJoin(F.broadcast(facts)).select("query_id", "term", "qtf", "avgdl", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
        wanted = [r[0] for r in terms.select("term").distinct().collect()]  # those of a block of queries
        posted = words.select(key, F.size("w").alias("dl"), F.explode(F.filter("w", lambda x: x.isin(wanted))).alias("term"))
        tf = posted.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        length = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
        scored = tf.join(F.broadcast(weights), "term").groupBy("query_id", key).agg(F.sum(F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + length)).alias("score"))
        best = cut(top_k(scored, k, F.desc(F.round("score", 9)), key).drop("rank"))
        # a query with fewer than k matches is filled from the 2 k least keys, of which fewer than k match
        full = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        pool = corpus.select(key).orderBy(key).limit(2 * k)
        short = block.select("query_id").join(full, "query_id", "left_anti")
        fill = short.crossJoin(F.broadcast(pool)).join(best.select("query_id", key), ["query_id", key], "left_anti").withColumn("score", F.lit(0.0))
        low = best.where(F.col("score") <= 0)
        if low.isEmpty():
            return best.unionByName(fill)
        # scores of 0 and less compete with rows that match nothing
        some = low.select("query_id").distinct().crossJoin(F.broadcast(pool)).join(scored.select("query_id", key), ["query_id", key], "left_anti").withColumn("score", F.lit(0.0))
        return best.unionByName(fill).unionByName(some).distinct()

    return top_k(in_blocks(queries, search), k, F.desc(F.round("score", 9)), key)
