"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for a document. The ledger stores what was measured
and one bit a failed rule; a policy is a version and a mask over those bits, so a
changed policy, or the question what a single rule costs, needs no second pass
over the texts: it is bit arithmetic over the ledger's distinct bit patterns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import batch_of, in_arrow, slices, text_column
from folioforge.llm.wordscan import IS_SPACE, scan, window_counts

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_MEASURED = pa.schema([(c.split()[0], pa.int64()) for c in MEASURES.split(", ")])

#: Rules by bit: a name, and the condition of failure in whole numbers. Rules 0 and 1 are the base.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
)
BASE_MASK = 0b11


@dataclass(frozen=True)
class Policy:
    """A version and the rules that it enforces."""

    version: str
    mask: int


#: The first enforces the base rules only, the second all.
POLICIES = {p.version: p for p in (Policy("base-1", BASE_MASK), Policy("full-1", (1 << len(RULES)) - 1))}
CURRENT = POLICIES["full-1"]

_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True
_letter = ~IS_SPACE & ((np.arange(256) & 0xC0) != 0x80)


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    if not text:
        return 0, 0
    lines = [x for x in text.split("\n") if x and x.strip(" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in slices(whole, 1):
            col = part.column(1)
            words = scan(col, fold=False)
            repeated = np.zeros(len(words.hash) + 1, np.int64)
            np.cumsum(window_counts(words, 3), out=repeated[1:])
            lines = np.array([_lines(t) for t in col.to_pylist()], np.int64).reshape(-1, 2)
            yield batch_of(
                _MEASURED, doc_id=part.column(0), n_words=words.counts, word_chars=_per_row(_letter[words.data], words.offsets), n_symbols=_per_row(_symbol[words.data], words.offsets),
                n_lines=lines[:, 0], n_dup_lines=lines[:, 1], n_repeat_words=repeated[words.first[1:]] - repeated[words.first[:-1]],
            )


def ledger(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> the measurements and ``fail_bits`` of each row, in
    one narrow pass without a shuffle.

    Null, empty and blank texts measure 0 everywhere (and fail ``few_words``). Rows
    keep their multiplicity; a null doc_id stays null. Other columns aren't read.
    """
    measured = in_arrow(text_column(docs, "doc_id", "text"), _measure, MEASURES)
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def verdict(policy: Policy, bits: str = "fail_bits") -> Column:
    """Whether a row of the ledger is kept under a policy."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def only_rule(policy: Policy = CURRENT) -> Column:
    """The name of the only rule of the policy that a row fails, else null."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    out = F.lit(None).cast("string")
    for i, (name, _) in enumerate(RULES):
        out = F.when(bits == (1 << i), F.lit(name)).otherwise(out)
    return out


def apply_policy(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    return rows.withColumn("kept", verdict(policy)).withColumn("policy", F.lit(policy.version))


def ablation(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail nothing else (which
    the policy without it would keep), and rows kept now. At most 2**rules patterns
    are left after the first aggregation, whatever the number of documents."""
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [(name, i) for i, (name, _) in enumerate(RULES) if policy.mask >> i & 1]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for name, i in rules])).alias("r")
    return (
        patterns.select("bits", "n", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_failure"),
            F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("kept_now"),
        )
    )
