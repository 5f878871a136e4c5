"""Pluggable models: embedders, language models, rerankers, as batch functions, with
deterministic stand-ins that say that they are ones."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from string import Formatter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Complete = Callable[[str], str]


#: Words whose slot an embedder remembers; it forgets all when there are more.
SLOTS = 1 << 16


class _Slots(dict):
    """A word's slot, and ``size`` more where it counts against it."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, w: str) -> int:
        if len(self) >= SLOTS:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        self[w] = slot = h % self.size + (0 if h >> 63 else self.size)
        return slot


def hashed_embedder(size: int = 64) -> Embedder:
    """A bag of hashed words of length 1: the same in every process. A word is hashed once a batch, not once an occurrence."""

    def run(texts: list[str]) -> list[list[float]]:
        out, slot = [], _Slots(size).__getitem__
        for t in texts:
            seats = np.bincount(np.array([*map(slot, re.findall(r"\w+", t.lower()))], np.int64), minlength=2 * size)
            v = (seats[:size] - seats[size:]).astype(float)
            n = math.sqrt(float(v @ v))
            out.append((v / n if n else v).tolist())
        return out

    return run


def embed(c: Column, model: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model([x or "" for x in s]))

    return run(c)


def complete(c: Column, model: Complete) -> Column:
    """A model's answers with their errors: a row that fails doesn't fail the job."""

    @F.pandas_udf("struct<value:string,error:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                rows.append((model(x or ""), None))
            except Exception as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["value", "error"])

    return run(c)


def table_summary(c: Column) -> Column:
    """The stand-in summary of a table: its first line."""
    return F.concat(F.lit("Table with headers: "), F.substring_index(F.trim(c), "\n", 1), F.lit(". Contains data rows."))


def extractive_summary(text: str, budget: int) -> str:
    """Leading sentences that fit ``budget`` characters; the cut first one if none does."""
    out = ""
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        if len(out) + len(s) + bool(out) > budget:
            break
        out = f"{out} {s}" if out else s
    return out or text.strip()[:budget]


#: What a prompt for the summary of a cluster has to have.
PLACEHOLDERS = frozenset(("context", "target_language", "max_chars", "target_ratio"))
CLUSTER_PROMPT = "Summarise the texts below in {target_language}, in at most {max_chars} characters and about {target_ratio} of their length.\n\n{context}"


@dataclass(frozen=True)
class ClusterSummarizer:
    """A model's summary of a cluster's joined texts, for ``tree.build``: it is asked for the texts' own language
    (by their script) and the budget. A template without one of the placeholders is refused."""

    model: Complete
    template: str = CLUSTER_PROMPT
    ratio: float = 0.3

    def __post_init__(self) -> None:
        try:
            named = {re.split(r"[.\[]", name)[0] for _, name, _, _ in Formatter().parse(self.template) if name}
        except ValueError as e:
            raise ValueError(f"no template: {e}") from e
        if missing := PLACEHOLDERS - named:
            raise ValueError(f"the template lacks {', '.join(sorted(missing))}")

    def __call__(self, text: str, budget: int) -> str:
        answer = self.model(self.template.format(context=text, target_language=script(text), max_chars=budget, target_ratio=self.ratio))
        if not isinstance(answer, str):
            raise TypeError("a summary must be a string")
        return answer.strip()


def script(text: str) -> str:
    """The language that the script of a plain string tells, as ``functions.text.script_of``; English by default."""
    total = len(re.sub(r"\s", "", text))
    latin, cyrillic = len(re.findall("[A-Za-z]", text)), len(re.findall("[\u0400-\u04ff]", text))
    return "russian" if total and cyrillic > latin and cyrillic >= 0.3 * total else "english"


def table_summarizer(model: Complete, language: str = "English", chars: int = 400) -> Callable[[str], str]:
    """A model's summary of a table given as text, in a language and of about a length."""
    return lambda table: model(f"Summarise this table in {language}, in about {chars} characters at most.\n\n{table}").strip()


@dataclass(frozen=True)
class Registry:
    """provider -> size -> model name."""

    names: dict[str, dict[str, str]]

    def name(self, provider: str, size: str = "base") -> str:
        try:
            return self.names[provider][size]
        except KeyError as e:
            raise ValueError(f"no model for {provider!r} in size {size!r}") from e


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashed": hashed_embedder}


def create_embedder(provider: str = "hashed", **options) -> Embedder:
    """A registered embedder; other providers are registered by whoever has their client."""
    if provider not in EMBEDDERS:
        raise ValueError(f"no embedder {provider!r}: register it in EMBEDDERS")
    return EMBEDDERS[provider](**options)
