"""Token counts behind a digest cache.

A count depends on the content and the tokenizer only, so it is stored under a
digest of each. A task that reads texts encodes only distinct ones, and none whose digest a
filter of the stored digests says may be there; those join the stored counts by
digest. Texts that the filter was wrong about are encoded by a pass of their own. The new
counts are appended. Digests are shuffled, texts are not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import Memo, batch_of, discard, in_arrow, materialize, scratch, slices

VOCABULARY = "piece_bpe_32k.model"
#: Bytes of units that a worker remembers with their counts, about.
CACHE_BYTES = 24 << 20
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"

_UNIT = re.compile(" *[^ ]+| +")


class Counter:
    """Counts the tokens that the sentencepiece library gives for whole texts.

    Where no piece has a space after another character (checked on loading), no merge
    crosses from a word to the spaces after it. A text is then the concatenation
    of units, each some spaces and a word, that are merged independently, and
    the library has to see each distinct unit only once.
    """

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("a", out_type=str)[0].startswith("▁") and len(self.model.encode(" ")) == len(self.model.encode("  a")) - 1
        self._known = Memo(CACHE_BYTES)

    def _learn(self, units: set[str]) -> None:
        """A unit is kept without its first space, which the library puts before a text."""
        self._known.trim()
        new = list(units.difference(self._known))
        if new:
            self._known.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
            self._known.charge(sum(map(len, new)) + 150 * len(new))

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        units = [[] if "▁" in t else self._units(t) for t in texts]
        self._learn(set(chain.from_iterable(units)))
        # a text with the library's own sign for a space goes to it whole
        return [
            len(self.model.encode(t)) if "▁" in t else sum(map(self._known.__getitem__, u)) + (t[-1:] == " " and t[-2:] != "  " and t != " ")
            for u, t in zip(units, texts, strict=True)
        ]

    @staticmethod
    def _units(text: str) -> list[str]:
        """``" " + text`` cut before each run of spaces; a single space at the end is left to ``count``."""
        if not text:
            return []
        if "  " in text or text[0] == " ":
            units = [u[1:] for u in _UNIT.findall(" " + text)]
            if text[-1] == " " and text[-2:] != "  " and text != " ":
                units.pop()
            return units
        return text.rstrip(" ").split(" ")


@lru_cache(2)
def counter(path: str) -> Counter:
    """One counter a worker."""
    return Counter(path)


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: its library's and the digest of its file."""
    with open(path, "rb") as f:
        return f"sentencepiece-{sentencepiece.__version__}-{hashlib.sha256(f.read()).hexdigest()}"


def read_cache(spark: SparkSession, path: str | None) -> DataFrame:
    """Stored counts; none where nothing is stored yet."""
    if path:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


_COUNTED = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_COUNTED_DDL = "doc_id long, digest binary, n_bytes long, n_tokens long"
#: The filter of stored digests has 16 bits a digest, but this many (8 MB) at most; with more
#: digests it is wrong more often, which costs time but changes no count.
FILTER_BITS = 1 << 26


def stored_filter(stored: DataFrame) -> np.ndarray | None:
    """A bit for each slot that a stored digest has; none where nothing is stored."""
    n = stored.count()
    if not n:
        return None
    size = min(FILTER_BITS, 1 << (16 * n - 1).bit_length())
    slot = F.expr(f"cast(conv(substring(hex(digest), 1, 15), 16, 10) as bigint) & {size - 1}")
    words = stored.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    out = np.zeros(max(1, size >> 6), np.int64)
    for word, bits in words.toLocalIterator():  # FILTER_BITS / 64 rows at most
        out[word] = bits
    return out.view(np.uint64)


def _may_be(bits: np.ndarray, digest: bytes) -> bool:
    slot = (int.from_bytes(digest[:8], "big") >> 4) & ((len(bits) << 6) - 1)
    return bool(int(bits[slot >> 6]) >> (slot & 63) & 1)


def _encode(texts: DataFrame, path: str, bits: np.ndarray | None) -> DataFrame:
    """``(doc_id, text)`` -> digest, bytes and, if the digest isn't in the filter, the count of each row."""
    shared = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = counter(path), Memo(CACHE_BYTES)
        for whole in batches:
            for part in slices(whole, 1):
                known.trim()
                data = [(t or "").encode() for t in part.column(1).to_pylist()]
                digests = [hashlib.sha256(x).digest() for x in data]
                new = {d: x for d, x in zip(digests, data, strict=True) if d not in known and not (shared is not None and _may_be(shared.value, d))}
                known.update(zip(new, counts.count([x.decode() for x in new.values()]), strict=True))
                known.charge(200 * len(new))
                yield batch_of(_COUNTED, doc_id=part.column(0), digest=digests, n_bytes=list(map(len, data)), n_tokens=list(map(known.get, digests)))

    return in_arrow(texts.select("doc_id", "text"), run, _COUNTED_DDL)


def count_tokens(docs: DataFrame, *, path: str | None = None, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_bytes, n_tokens, over_limit, from_cache`` for every row.

    ``cache`` is the folder of stored counts, appended to; by default one of this
    run's own. The digest is SHA-256 over the UTF-8 content, a null being empty:
    the normalisation must not change the count, so it changes nothing else. A task encodes
    equal texts once; two tasks may both encode a text, which is dearer for few
    copies than moving all texts would be, and is stored once. A write that a lost executor
    interrupts leaves no partial counts, and a digest stored twice counts once.
    Null and repeated doc_ids keep their rows; other columns aren't read; no row gives none.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path(VOCABULARY)
    version = tokenizer_digest(path)
    own = cache is None
    cache = cache or scratch(spark, "token-counts")
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    bits = None if own else stored_filter(stored)
    rows, _ = materialize(_encode(docs, path, bits), "token-rows")

    def append(counted: DataFrame) -> None:
        new = counted.where("n_tokens is not null").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache)

    out = lambda df, n, hit: df.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), hit.alias("from_cache"))
    if bits is None:
        append(rows)
        return out(rows, F.col("n_tokens"), F.lit(False))
    known, known_path = materialize(stored, "token-known")  # as stored before anything is appended
    append(rows)
    pending = rows.where("n_tokens is null").select("doc_id", "digest", "n_bytes").join(known, "digest", "left")
    wrong, wrong_path = materialize(pending.where("n_tokens is null").select("digest").distinct(), "token-wrong")
    late = spark.createDataFrame([], _COUNTED_DDL)
    if not wrong.isEmpty():
        text = F.coalesce(docs["text"], F.lit(""))
        late, _ = materialize(_encode(docs.join(wrong, F.unhex(F.sha2(text, 256)) == wrong["digest"], "left_semi"), path, None), "token-rows")
        append(late)
    discard(spark, wrong_path)
    hits = pending.where("n_tokens is not null")
    return out(rows.where("n_tokens is not null"), F.col("n_tokens"), F.lit(False)).unionByName(out(late, F.col("n_tokens"), F.lit(False))).unionByName(out(hits, F.col("n_tokens"), F.lit(True)))
