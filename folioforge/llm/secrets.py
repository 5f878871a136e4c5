"""Secret scans: fixed patterns, and inferred grammars of credential formats.

From labelled credentials of a format a prefix tree is grown, and states whose
continuations are statistically compatible (the Hoeffding bound of ALERGIA) are
merged into a probabilistic automaton. A candidate string is a secret when some
format's automaton gives it a far higher likelihood than anything ordinary does: a
model of character pairs in long words and names made of words (paths, hosts,
identifiers), and automata of labelled ordinary formats (UUIDs, times, numbers).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import batch_of, discard, in_arrow, materialize, slices, text_bytes, text_column

#: Kinds in their order; the last one is the automata's.
KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Strings that the automata judge.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Examples of up to so many characters are learned from, and parts of a candidate that span cuts have it at most.
LONGEST = 128
_HINT = "(?i)passw|secret|token|api"
_inside = np.zeros(256, bool)
_inside[list((string.ascii_letters + string.digits + "+/_.=-").encode())] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # runs are maximal, so those of 24 or more may be sought as such
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


# --- grammar inference -------------------------------------------------------------


def _symbol(c: str) -> str:
    """Characters as the automata see them: classes, so that few examples tell a format."""
    if c in "0123456789":
        return "9"
    if c in "abcdef":
        return "f"
    if c in string.ascii_lowercase:
        return "z"
    if c in "ABCDEF":
        return "F"
    if c in string.ascii_uppercase:
        return "Z"
    return c


_CLASS_SIZE = {"9": 10, "f": 6, "z": 20, "F": 6, "Z": 20}


@dataclass
class Automaton:
    """A deterministic probabilistic automaton: counts of each state's moves and ends."""

    moves: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])  # symbol -> [target, count]
    ends: list[int] = field(default_factory=lambda: [0])
    #: The shortest and the longest string that can have the format.
    lengths: tuple[int, int] = (0, 1 << 31)

    @classmethod
    def infer(cls, words: Iterable[str], alpha: float = 0.05) -> Automaton:
        """Prefix tree of ``words`` (those over ``LONGEST`` are left out), its compatible states
        merged (red-blue order). If all have one length, so have all strings of the format;
        else these are between the shortest and twice the longest."""
        words = [w for w in words if len(w) <= LONGEST]
        lengths = {len(w) for w in words} or {0}
        a = cls(lengths=(min(lengths), max(lengths) * (1 if len(lengths) == 1 else 2)))
        for w in words:
            s = 0
            for c in map(_symbol, w):
                if c not in a.moves[s]:
                    a.moves[s][c] = [len(a.moves), 0]
                    a.moves.append({})
                    a.ends.append(0)
                a.moves[s][c][1] += 1
                s = a.moves[s][c][0]
            a.ends[s] += 1
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        while True:
            # the frontier in order of its weight: what is seen most is decided first
            blue = [(-n, t, s, c) for s in red for c, (t, n) in a.moves[s].items() if t not in red]
            if not blue:
                return a._trim()
            _, t, s, c = min(blue)
            for r in red:
                if a._compatible(r, t, bound):
                    a.moves[s][c][0] = r
                    a._fold(r, t)
                    break
            else:
                red.append(t)

    def _total(self, s: int) -> int:
        return self.ends[s] + sum(n for _, n in self.moves[s].values())

    def _compatible(self, r: int, b: int, bound: float) -> bool:
        """No continuation of the (tree-shaped) state b is as rare or frequent in r as
        chance would not make it."""
        stack = [(r, b)]
        while stack:
            r, b = stack.pop()
            n, m = self._total(r), self._total(b)
            if not n or not m:
                continue
            limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[r] / n - self.ends[b] / m) > limit:
                return False
            for c in self.moves[r].keys() | self.moves[b].keys():
                x, y = self.moves[r].get(c), self.moves[b].get(c)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) > limit:
                    return False
                if x and y:
                    stack.append((x[0], y[0]))
        return True

    def _fold(self, r: int, b: int) -> None:
        """Add the tree below b to r."""
        stack = [(r, b)]
        while stack:
            r, b = stack.pop()
            self.ends[r] += self.ends[b]
            for c, (t, n) in self.moves[b].items():
                if c in self.moves[r]:
                    self.moves[r][c][1] += n
                    stack.append((self.moves[r][c][0], t))
                else:
                    self.moves[r][c] = [t, n]

    def _trim(self) -> Automaton:
        """Only the states that can be reached, renumbered."""
        order, place = [0], {0: 0}
        for s in order:
            for t, _ in self.moves[s].values():
                if t not in place:
                    place[t] = len(order)
                    order.append(t)
        return Automaton([{c: [place[t], n] for c, (t, n) in self.moves[s].items()} for s in order], [self.ends[s] for s in order], self.lengths)

    def log_likelihood(self, word: str, unseen: float = 1e-4) -> float:
        """Of the whole word and its end. A move that no example made costs log ``unseen``."""
        if not self.lengths[0] <= len(word) <= self.lengths[1]:
            return -math.inf
        s, total = 0, 0.0
        for c in word:
            k = _symbol(c)
            step = self.moves[s].get(k)
            if step is None:
                total += math.log(unseen)
            else:
                total += math.log(step[1] / self._total(s) / _CLASS_SIZE.get(k, 1))
                s = step[0]
        return total + math.log(max(self.ends[s], 0.01) / max(1, self._total(s)))


class Background:
    """Character pairs of ordinary words; what stays likely under it is no secret."""

    def __init__(self, words: Iterable[str]) -> None:
        self.pairs: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for w in words:
            for a, b in zip("^" + w, w + "$", strict=True):
                self.pairs[a][b] += 1
        self.pairs = {a: dict(b) for a, b in self.pairs.items()}
        self.sums = {a: sum(b.values()) for a, b in self.pairs.items()}

    def log_likelihood(self, word: str) -> float:
        return sum(math.log((self.pairs.get(a, {}).get(b, 0) + 0.05) / (self.sums.get(a, 0) + 0.05 * 70)) for a, b in zip("^" + word, word + "$", strict=True))


#: Labelled examples of public credential formats: prefix, alphabet and length of the rest.
_LOWER_HEX, _BASE62 = "0123456789abcdef", string.digits + string.ascii_letters
FORMATS: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "access_id": ("AKIA", string.ascii_uppercase + "234567", (16,)),
    "session_id": ("ASIA", string.ascii_uppercase + "234567", (16,)),
    "forge_token": ("ghp_", _BASE62, (36,)),
    "chat_token": ("xoxb-", string.digits, (24,)),
    "pay_key": ("sk_live_", _BASE62, (24, 32)),
    "map_key": ("AIza", _BASE62 + "-_", (35,)),
    "hex_key": ("", _LOWER_HEX, (18, 20, 32, 40, 64)),
    "base64_key": ("", _BASE62 + "+/", (40, 44, 64)),
}


#: Where a part of a candidate may begin or end: at these, and where a format with a head begins.
_CUT = re.compile("[/.=]+")
_HEADS = [(head, sizes) for head, _, sizes in FORMATS.values() if head]


def parts(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """Ranges of the candidate text[s:e] that may be a secret by themselves: those between
    two cuts next to each other, and between any two at most ``LONGEST`` apart."""
    starts, ends = {s}, {e}
    for m in _CUT.finditer(text, s, e):
        ends.add(m.start())
        starts.add(m.end())
    for head, sizes in _HEADS:
        at = text.find(head, s, e)
        while at >= 0:
            starts.add(at)
            ends |= {at} | {x for n in sizes if (x := at + len(head) + n) <= e}
            at = text.find(head, at + 1, e)
    order = sorted(ends)
    out = []
    for a in sorted(starts):
        i = bisect_right(order, a)
        for b in order[i:]:
            if b - a > LONGEST and b != order[i]:
                break
            if b - a >= 16:
                out.append((a, b))
    return out


def labelled_examples(each: int = 120, seed: int = 11) -> dict[str, list[str]]:
    """Credentials of known formats, drawn anew from a fixed seed: no real ones."""
    rng = random.Random(seed)
    return {name: [head + "".join(rng.choices(letters, k=rng.choice(sizes))) for _ in range(each)] for name, (head, letters, sizes) in FORMATS.items()}


def ordinary_examples(each: int = 120, seed: int = 13) -> dict[str, list[str]]:
    """Strings of formats that are no secrets."""
    rng = random.Random(seed)
    hexa = lambda n: "".join(rng.choices(_LOWER_HEX, k=n))
    when = lambda: f"{rng.randint(1990, 2035)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    return {
        "uuid": ["-".join(map(hexa, (8, 4, 4, 4, 12))) for _ in range(each)],
        "time": [f"{when()}T{rng.randint(0, 23):02}{rng.randint(0, 59):02}{rng.randint(0, 59):02}" for _ in range(each)],
        "dates": [f"{when()}{rng.choice('/_.')}{when()}" for _ in range(each)],
        "number": ["".join(rng.choices(string.digits, k=rng.randint(16, 24))) for _ in range(each)],
    }


def names_of(words: list[str], seed: int = 17) -> list[str]:
    """Names made of ordinary words: paths, hosts, and identifiers of several styles."""
    rng = random.Random(seed)
    out = []
    for i in range(0, len(words) - 2, 3):
        some = [w.lower() for w in words[i : i + 3]]
        out += ["/" + "/".join(some), f"www.{some[0]}.org/{some[1]}.html", f"{some[0]}{rng.randint(0, 99)}.{some[1]}.com", "_".join(some), "-".join(some), "".join(w.title() for w in some), some[0] + some[1].title() + some[2].title(), f"{some[0]}/{rng.randint(1990, 2035)}/{rng.randint(1, 12):02}/{some[1]}-{rng.randint(1, 999)}", "_".join(some).upper()]
    return out


@dataclass
class Scanner:
    """Automata by format, the background, automata of ordinary formats, and the least
    log-likelihood ratio of a secret."""

    formats: dict[str, Automaton]
    background: Background
    ordinary: dict[str, Automaton] = field(default_factory=dict)
    least: float = 14.0

    def score(self, word: str) -> tuple[float, str]:
        base = max([self.background.log_likelihood(word), *(a.log_likelihood(word) for a in self.ordinary.values())])
        return max((a.log_likelihood(word) - base, name) for name, a in self.formats.items())

    def _passes(self, word: str) -> float:
        """The score of a word that can be a secret, else 0."""
        if len(word) < 16:
            return 0.0
        score = self.score(word)[0]
        return score if score >= self.least else 0.0

    def _within(self, text: str, s: int, e: int) -> Iterator[tuple[int, int]]:
        """The secrets in text[s:e], which no base span touches: the whole if it is one, else
        its best parts that don't overlap."""
        word = text[s:e].strip(".=-")
        if len(word) < 16:
            return
        at = text.index(word, s)
        if self._passes(word):
            yield at, at + len(word)
            return
        taken: list[tuple[int, int]] = []
        scored = [(-score / (b - a), a, b) for a, b in parts(text, at, at + len(word)) if (score := self._passes(text[a:b]))]  # by character: a path beside a key only thins it
        for _, a, b in sorted(scored):
            i = bisect_left(taken, (a, b))
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                taken.insert(i, (a, b))
        yield from taken

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """The base spans and what scores as a secret beside them: candidates, or parts of
        them (behind a path or a name, beside a base span)."""
        found = base_spans(text)
        starts = [s for s, _, _ in found]
        reach = list(accumulate((e for _, _, e in found), max))  # the furthest end so far
        more: list[tuple[int, int, int]] = []
        for m in CANDIDATE.finditer(text):
            at, e = m.span()
            # base spans that end behind the candidate's start, in order
            for i in range(bisect_right(reach, at), bisect_left(starts, e)):
                more += [(a, 3, b) for a, b in self._within(text, at, starts[i])]
                at = max(at, found[i][2])
            more += [(a, 3, b) for a, b in self._within(text, at, e)]
        return sorted(found + more)


def train(docs: DataFrame, *, sample: int = 20_000, words: int = 4_000, per_format: int = 300) -> Scanner:
    """Infer the automata from labelled credentials: the fixed examples, and what the
    base patterns find in ``sample`` documents (those of least hash, a bounded sample,
    as are ``words`` ordinary long words for the background and ``per_format`` found
    credentials). Nothing that grows with the corpus reaches the driver. The documents
    are read once, for what is found in them."""
    ids = docs.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample).select("doc_id")
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    out = pa.schema([("kind", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column(1).to_pylist():
                spans = base_spans(text)
                for s, k, e in spans:
                    value = _ASSIGN.match(text, s)[1] if k == 0 else text[s:e]
                    found.add((KINDS[k], value))
                if not spans:
                    found.update(("word", w) for w in re.findall("[A-Za-z]{12,}", text))
            found = {(k, v) for k, v in found if len(v) <= LONGEST}
            rows = sorted(found)
            yield batch_of(out, kind=[k for k, _ in rows], value=[v for _, v in rows])

    bound = {k: per_format for k in KINDS[:3]} | {"word": words}
    rows, path = materialize(in_arrow(chosen, run, "kind string, value string").distinct(), "found")
    pick = None
    for kind, n in bound.items():
        part = rows.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(n)
        pick = part if pick is None else pick.unionByName(part)
    found = defaultdict(list)
    for kind, value in sorted(map(tuple, pick.collect())):
        found[kind].append(value)
    discard(docs.sparkSession, path)
    examples = labelled_examples()
    for kind in KINDS[:3]:
        if len(found[kind]) >= 20:
            examples[f"found_{kind}"] = found[kind]
    plain = found["word"] or ["information", "international", "documentation"]
    return fit(examples, plain)


def fit(examples: dict[str, list[str]], plain: list[str]) -> Scanner:
    """A scanner from labelled credentials by format and ordinary long words."""
    infer = lambda by: {name: Automaton.infer(w) for name, w in by.items()}
    return Scanner(infer(examples), Background([*plain, *names_of(plain)]), infer(ordinary_examples()))


# --- the scan ------------------------------------------------------------------------


def _long_runs(col: pa.Array) -> np.ndarray:
    """Rows with a run of 16 or more candidate characters."""
    data, offsets = text_bytes(col)
    hit = np.zeros(len(col), bool)
    if len(data):
        ok = np.concatenate([[False], _inside[data], [False]]).view(np.int8)
        edge = np.diff(ok)
        start = np.flatnonzero(edge == 1)
        length = np.flatnonzero(edge == -1) - start
        row = np.searchsorted(offsets, start[length >= 16], side="right") - 1
        hit[row] = True
        # a run may go over the border of rows: then both are looked at
        ends = np.searchsorted(offsets, (start + length - 1)[length >= 16], side="right") - 1
        for a, b in zip(row[row != ends], ends[row != ends], strict=True):
            hit[a : b + 1] = True
    return hit


def find(scanner: Scanner, col: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Spans of each text; texts that can't have any are told by their bytes alone."""
    hint = pc.match_substring_regex(col, _HINT).fill_null(False).to_numpy(zero_copy_only=False)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(col))]
    for r in np.flatnonzero(hint | _long_runs(col)):
        text = col[int(r)].as_py()
        if text:
            out[r] = scanner.spans(text)
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_format", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan_secrets(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> counts by kind, a digest of the base spans, all spans.

    One narrow pass over whole texts; the scanner (a few hundred states) travels
    with the task. Positions are code points, ends exclusive. Null and empty texts
    have no spans. Rows keep their multiplicity; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                rows = find(scanner, part.column(1))
                n = [[sum(k == i for _, k, _ in r) for r in rows] for i in range(4)]
                base = [listed([x for x in r if x[1] < 3]) for r in rows]
                yield batch_of(
                    _FOUND, doc_id=part.column(0), n_assign=n[0], n_access=n[1], n_hex=n[2], n_format=n[3],
                    base_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in base], spans=[listed(r) for r in rows],
                )

    return in_arrow(text_column(docs, "doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, k, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """The same rows and columns with the secrets of ``text`` replaced, ``n_chars`` (if
    there) counted again. Columns of other names pass through untouched."""
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, at):
                col = part.column(at)
                rows = find(scanner, col)
                if any(rows):
                    texts = [redact_text(t, r) if r else t for t, r in zip(col.to_pylist(), rows, strict=True)]
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, col.type))
                yield part

    changed = in_arrow(docs, run, schema)
    return changed.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else changed
