"""Secrets: base patterns, and probabilistic automata inferred from labelled credentials.

Labelled credentials form a prefix tree whose states carry counts; states whose outgoing and ending frequencies differ
by no more than a Hoeffding bound, and whose successors agree likewise, are merged into a probabilistic automaton
(state merging in red-blue order). A second automaton comes from labelled harmless strings. Symbols are a string's
first LITERAL characters themselves and character classes after them. Every candidate, a run of MINIMUM or more
credential characters or the value of a base span, is scored by the difference of the two log-likelihoods per symbol.
Base spans stay whatever their score, which comes with them; a run above THRESHOLD is added as kind "format" where no
base span overlaps it.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; repeated rows repeat;
columns other than id and text are dropped (join back on the id).
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .op8_pii import Taken, coded

KINDS = ("assign", "access", "hex", "format")
MINIMUM, LITERAL, ALPHA, THRESHOLD, VARIANTS, FLOOR = 12, 4, 0.05, 0.25, 30, 1e-4

#: Labelled formats: U upper case, l lower case, d digit, x hex digit, b upper case or digit, m any letter or digit,
#: s those and - or _; {n} repeats; other characters stand for themselves.
CREDENTIALS = (
    "AKIAb{16}",
    "ASIAb{16}",
    "gh\\p_m{36}",
    "gh\\o_m{36}",
    "\\s\\k_\\liv\\e_m{24}",
    "\\s\\k-m{40}",
    "\\xo\\x\\b-d{12}-m{24}",
    "AIzas{35}",
    "ey\\Js{20}.ey\\Js{30}.s{30}",
    "g\\lpat-s{20}",
    "npm_m{36}",
    "m{40}",
    "s{43}=",
    "m{32}",
)
HARMLESS = (
    "l{12}",
    "Ul{13}",
    "l{6}.l{5}.co\\m",
    "l{5}.d{2}@",
    "d{4}-d{2}-d{2}.d{2}",
    "d{16}",
    "d{3}.d{3}.d{3}.d{3}",
    "d{2}.d{2}.d{2}.d{2}",
    "d{2}.d{3}.d{2}.d{3}",
    "d{2}.d{2}.d{3}.d{2}",
    "d{2}.d{3}.d{3}.d{3}",
    "d{3}.d{2}.d{3}.d{2}",
    "d{3}.d{3}.d{2}.d{2}",
    "d{1}.d{3}.d{3}.d{3}",
    "d{12}",
    "l{7}_l{6}_d{2}",
    "l{5}-l{6}-l{4}-d{4}",
    "/l{4}/l{6}/l{8}.l{3}",
    "l{8}.l{2}.d{2}.l{3}",
    "Ul{5}Ul{6}Ul{4}d{1}",
    "l{6}/v{1}d{1}.d{1}.d{2}",
    "d{1}.d{1}.d{1}-l{4}.d{2}",
    "l{4}=l{5}d{4}",
    "U{4}-d{4}-d{6}",
    "l{14}d{1}",
    "=l{12}d{3}",
    "l{18}",
    "Ul{18}",
    "l{28}",
    *(f"U{{{n}}}" for n in range(16, 48, 4)),
    "U{8}_U{8}",
    "U{6}-U{10}",
    "U{7}_U{6}_U{7}",
    "l{8}-l{10}",
    "l{5}-l{2}-l{5}-l{6}",
    "Ul{8}-Ul{9}",
    "l{6}_l{5}_l{7}",
    "l{8}/l{9}",
    "/l{5}/l{6}/l{7}",
    "l{7}.l{6}.l{7}",
    "l{7}=l{9}",
    "l{6}Ul{6}Ul{6}",
    "-{24}",
    "={24}",
    "_{24}",
    ".{24}",
)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MINIMUM)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    return [(a, b, kind) for a, b, kind, _ in valued(text)]


def valued(text: str) -> list[tuple[int, int, str, str]]:
    """The base spans with their values: what an assignment assigns, else the whole span."""
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]
    return out


def spell(pattern: str, rng: random.Random) -> str:
    """A string of a labelled format."""
    kinds = {"U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "l": "abcdefghijklmnopqrstuvwxyz", "d": "0123456789", "x": "0123456789abcdef"}
    kinds["b"] = kinds["U"] + kinds["d"]
    kinds["m"] = kinds["U"] + kinds["l"] + kinds["d"]
    kinds["s"] = kinds["m"] + "-_"
    out = []
    for escaped, c, n in re.findall(r"(\\?)(.)(?:\{(\d+)\})?", pattern):
        count = int(n) if n else 1
        varied = n and count > 4
        count = max(4, count + rng.randint(-2, 2)) if varied and pattern in HARMLESS else count
        for _ in range(count):
            out.append(rng.choice(kinds[c]) if n and not escaped and c in kinds else c)
    return "".join(out)


def symbols(text: str) -> list[str]:
    """The first characters, then classes of characters."""
    return [*text[:LITERAL], *("U" if c.isupper() else "D" if c.isdigit() else "H" if c in "abcdef" else "L" if c.islower() else c for c in text[LITERAL:])]


class Automaton:
    """A probabilistic automaton: for each state the symbols' targets and counts, and how many strings end there."""

    def __init__(self, strings: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        for s in strings:
            at = 0
            for c in s:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                self.count[at][c] = self.count[at].get(c, 0) + 1
                at = self.next[at][c]
            self.ends[at] += 1

    def total(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def alike(self, a: int, b: int) -> bool:
        """Whether two states are statistically compatible, successors included."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > bound:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, target in self.next[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + self.count[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], target))
                else:
                    self.next[a][c] = target

    def merge(self) -> Automaton:
        """State merging: blue states (successors of red ones) join the first compatible red state or turn red."""
        red = [0]
        known = {0}
        while True:
            blue = next(((q, c, t) for q in red for c, t in self.next[q].items() if t not in known), None)
            if blue is None:
                self.red = red
                return self
            q, c, t = blue
            home = next((r for r in red if self.alike(r, t)), None)
            if home is None:
                red.append(t)
                known.add(t)
            else:
                self.next[q][c] = home
                self.fold(home, t)

    def matrix(self, alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Targets, log-probabilities of symbols and of ending, by state; symbols never seen lead to the start."""
        place = {q: i for i, q in enumerate(self.red)}
        target = np.zeros((len(self.red), len(alphabet) + 1), np.int64)
        cost = np.full(target.shape, math.log(FLOOR))
        end = np.full(len(self.red), math.log(FLOOR))
        for q, i in place.items():
            n = self.total(q)
            end[i] = math.log(max(self.ends[q] / n, FLOOR))
            for c, t in self.next[q].items():
                target[i, alphabet[c]], cost[i, alphabet[c]] = place[t], math.log(max(self.count[q][c] / n, FLOOR))
        return target, cost, end


class Formats:
    """The two automata as tables; scores strings in batches."""

    def __init__(self, credentials: list[str], harmless: list[str]):
        both = [[symbols(s) for s in x] for x in (credentials, harmless)]
        self.alphabet = {c: i for i, c in enumerate(sorted({c for x in both for s in x for c in s}))}
        self.tables = [Automaton(x).merge().matrix(self.alphabet) for x in both]

    def score(self, strings: list[str]) -> np.ndarray:
        """Log-likelihood ratio per symbol, credential against harmless."""
        if not strings:
            return np.zeros(0)
        other = len(self.alphabet)
        order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))
        size = np.array([len(strings[i]) for i in order])
        flat = np.array([self.alphabet.get(c, other) for i in order for c in symbols(strings[i])])
        start = np.cumsum(size) - size
        total = []
        for target, cost, end in self.tables:
            state, like = np.zeros(len(order), np.int64), np.zeros(len(order))
            for t in range(int(size[0])):
                n = int(np.searchsorted(-size, -t, side="left"))  # those longer than t
                c = flat[start[:n] + t]
                like[:n] += cost[state[:n], c]
                state[:n] = target[state[:n], c]
            total.append(like + end[state])
        out = np.empty(len(order))
        out[order] = (total[0] - total[1]) / (size + 1)
        return out


@lru_cache(maxsize=1)
def train(seed: int = 11) -> Formats:
    rng = random.Random(seed)
    return Formats(*[[spell(p, rng) for p in table for _ in range(VARIANTS)] for table in (CREDENTIALS, HARMLESS)])


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs of credential characters outside base spans; full stops after a run are not its own."""
    taken, out = Taken(base), []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        b = a + len(m[0].rstrip("."))
        if b - a >= MINIMUM and not taken.overlaps(a, b):
            out.append((a, b))
    return out


def added_spans(texts: list[str], base: list[list[tuple[int, int, str]]], formats: Formats) -> list[list[tuple[int, int, str]]]:
    """Candidates whose format is a credential's, outside base spans."""
    return [[(a, b, kind) for a, b, kind, _ in own] for own in scored_runs(texts, base, formats)]


def scored_runs(texts: list[str], base: list[list[tuple[int, int, str]]], formats: Formats) -> list[list[tuple[int, int, str, float]]]:
    places = [(i, a, b) for i, text in enumerate(texts) for a, b in candidates(text, base[i])]
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for (i, a, b), s in zip(places, formats.score([texts[i][a:b] for i, a, b in places]).tolist()):
        if s > THRESHOLD:
            out[i].append((a, b, "format", s))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base string, spans string, found): the base spans and all spans of each whole text, found with scores."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    form = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        own = [valued(t) for t in texts]
        score = iter(shared.value.score([v for x in own for _, _, _, v in x]).tolist())
        base = [[(a, b, kind, next(score)) for a, b, kind, _ in x] for x in own]
        plain = [[x[:3] for x in b] for b in base]
        more = scored_runs(texts, plain, shared.value)
        spans = [p + [x[:3] for x in m] for p, m in zip(plain, more)]
        found = [[dict(zip(("start", "end", "kind", "score"), x)) for x in sorted(b + m)] for b, m in zip(base, more)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([coded(b, KINDS) for b in plain], pa.string()), pa.array([coded(x, KINDS) for x in spans], pa.string()), pa.array(found, form)], names=["id", "base", "spans", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return common.map_arrow(own, one, f"id {kind}, base string, spans string, found array<struct<start: long, end: long, kind: string, score: double>>", text=1).withColumnRenamed("id", id_col)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))
    count = [F.regexp_count("base", F.lit(rf"\b{k}:")).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *count, F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op10_secrets": op10_secrets}
