"""Byte-level BPE, to ids with offsets and back to bytes.

The vocabulary is a file of byte tokens by rank. Bytes are written as printable
characters (the usual byte table), the tokenizers library merges them, and ids
are kept per pre-token: a text is the concatenation of its pre-tokens' ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from folioforge.llm.common import Memo, batch_of, in_arrow, slices, text_column

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of pre-tokens that a worker remembers with their ids, about.
CACHE_BYTES = 80 << 20
#: Pre-tokens that the library encodes at a time: what it returns of each is over a kilobyte.
BATCH = 8192


def byte_table() -> list[str]:
    """A printable character for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b], extra = chr(256 + extra), extra + 1
    return table


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        table = byte_table()
        self._as_chars = str.maketrans({chr(b): c for b, c in enumerate(table)})
        name = {t: "".join(table[b] for b in t) for t in ranks}
        merges = []
        for t in sorted(ranks, key=ranks.__getitem__):
            # every split into known tokens may merge, as the ranks alone decide
            merges += [(name[t[:i]], name[t[i:]]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._bpe = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self._pattern = regex.compile(public_tokenizers.PATTERN)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self._ids = Memo(CACHE_BYTES)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        pieces = [self._pattern.findall(t) for t in texts]
        known = self._ids
        known.trim()
        new = list(set().union(*pieces).difference(known))
        for low in range(0, len(new), BATCH):
            part = new[low : low + BATCH]
            found = self._bpe.encode_batch([p.encode().decode("latin-1").translate(self._as_chars) for p in part], add_special_tokens=False)
            known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(part, found, strict=True))
        known.charge(sum(5 * len(p) for p in new) + 240 * len(new))
        return [b"".join(map(known.__getitem__, p)) for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> list[tuple[int, int]]:
        """Code points [start, end) that each id covers; a character whose bytes are
        split between ids belongs to all of them."""
        spans, at, inside = [], 0, 0
        for i in np.frombuffer(ids, "<u4").tolist():
            start = at if not inside else at - 1
            for b in self.bytes_of[i]:
                if inside:
                    inside -= 1
                else:
                    at += 1
                    inside = 0 if b < 0x80 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            spans.append((start, at))
        return spans


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec a worker."""
    return Codec(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def _texts(col: pa.Array) -> list[str]:
    return [t or "" for t in col.to_pylist()]


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())])


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode each text, decode the ids: counts, digests of both, and whether the
    bytes came back. One narrow pass. A null text counts as empty: no ids, the
    digests of nothing. Rows keep their multiplicity, other columns aren't read."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for whole in batches:
            for part in slices(whole, 1):
                texts = _texts(part.column(1))
                ids = coder.encode(texts)
                back = [coder.decode(x) for x in ids]
                yield batch_of(
                    _DIGEST, doc_id=part.column(0), n_tokens=[len(x) // 4 for x in ids], ids_sha256=[hashlib.sha256(x).hexdigest() for x in ids],
                    decoded_sha256=[hashlib.sha256(x).hexdigest() for x in back], exact=[x == t.encode() for x, t in zip(back, texts, strict=True)],
                )

    return in_arrow(text_column(docs, "doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids of each text with the code points that they cover."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for whole in batches:
            for part in slices(whole, 1, 1 << 19):
                ids = coder.encode(_texts(part.column(1)))
                spans = [coder.offsets(x) for x in ids]
                yield batch_of(_IDS, doc_id=part.column(0), ids=[np.frombuffer(x, "<u4").astype(np.int32) for x in ids], starts=[[s for s, _ in x] for x in spans], ends=[[e for _, e in x] for x in spans])

    return in_arrow(text_column(docs, "doc_id", "text"), run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(rows: DataFrame, path: str | None = None, errors: str = "replace") -> DataFrame:
    """``(doc_id, ids)`` -> ``text``. A character split at either end of a list of ids is
    replaced (or ignored, as ``errors`` says); a null list gives a null text."""
    path = path or vocabulary_path()
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = [None if x is None else b"".join(coder.bytes_of[i] for i in x).decode("utf-8", errors) for x in batch.column(1).to_pylist()]
            yield batch_of(out, doc_id=batch.column(0), text=texts)

    return in_arrow(rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, text string")
