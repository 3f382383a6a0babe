"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

Base spans of four kinds follow fixed patterns; they are found from digit runs, '@' and '+', in time linear in the
text. A conditional random field adds spans that the patterns do not cover (an address written "name at host dot
com", a telephone number without '+', a card number in parts). Its tokens are words, digit runs and single marks; its
features are shapes of a token and its neighbours and trigger words just before it. It is trained here by adaptive
gradient steps on the forward-backward likelihood of LABELLED, whose digits and names are varied by a seeded
generator. Tasks decode, by Viterbi over batches in numpy, the stretches of REACH tokens around each token with a
digit, '@' or a spelled-out address sign; other tokens have no label that could begin. Stretches of like length are
decoded together, at most GRID tokens at once; a longer stretch is decoded in parts that hand on the scores of the
tags, which gives the same tags as the whole. A decoded span counts if it fulfils its kind's check (see valid) and
overlaps no base span.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; repeated rows repeat;
columns other than id and text are dropped (join back on the id).
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
REACH, EPOCHS, VARIANTS = 6, 8, 6
#: Tokens decoded at once, characters of a stretch that is decoded in parts, tokens of a part, and its context.
GRID, LONG, PART, MARGIN = 1 << 15, 1 << 14, 4096, 16

#: Labelled lines, a span as [kind:text]; 9 stands for any digit, Xx for any name.
LABELLED = (
    "please write to [email:Xx.Xx@Xx.com] before noon",
    "mail [email:Xx at Xx dot com] about the invoice",
    "contact: [email:Xx (at) Xx (dot) org] , thanks",
    "reach me under [email:Xx [at] Xx [dot] net] or later",
    "email [email:Xx99 at Xx dot co dot uk] for access",
    "write to [email:Xx dot Xx at Xx dot com] please",
    "mail: [email:Xx dot Xx at Xx dot org]",
    "e-mail [email:Xx_Xx@Xx.co.uk] today",
    "send it to [email:Xx+Xx@mail9.Xx.org] please",
    "call [phone:(999) 999-9999] after six",
    "phone [phone:999-999-9999] for details",
    "tel. [phone:999.999.9999] or come by",
    "my number is [phone:999 999 9999] , call any time",
    "telephone: [phone:0999 999999] in the morning",
    "fax [phone:00 99 999 999 9999] is still in use",
    "ring [phone:+99 999 999 9999] tonight",
    "call [phone:+9 (999) 999-9999] now",
    "mobile [phone:(999)999-9999] works too",
    "card [card:9999 9999 9999 9999] expires soon",
    "visa [card:9999-9999-9999-9999] was charged",
    "pay with card number [card:9999999999999999] online",
    "amex [card:9999 999999 99999] was refused",
    "credit card: [card:9999.9999.9999.9999] on file",
    "from ip [ip:999.99.99.9] at night",
    "host [ip:99.999.9.99] is down",
    "address [ip:9.9.9.9] answered",
    "server at [ip:99 . 9 . 9 . 99] restarted",
    "ping [ip:99[.]99[.]99[.]9] failed",
    "the year 9999 had 999 days of rain",
    "version 9.9.9 came out on 99.99.9999",
    "order 99999999 ships in 9 days",
    "about 99 of 999 people came at noon",
    "it cost 9,999.99 in total",
    "chapter 9 on page 999 to 999",
    "serial 9999999999999999 of the device",
    "the code 999999 and the build 9.99.9999 match",
    "between 9999 and 9999 the town grew",
    "meet at the station at 99:99 on 9999-99-99",
    "look at the dot on the map at once",
    "room 999 - floor 9 - wing 99",
    "score 9 - 9 after 99 minutes",
    "isbn 999-9-99-999999-9 of the book",
    "hash 9x99xx9x99x9xx99 of the file",
    "password=9xx99x9x9xx99x is not a card",
    "table 9 lists 99.9 and 99.99 and 9.999",
    "a day in 9999 , 99 or 99 more",
)

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
#: What a decoded span must fulfil: digits (least, most).
VALID = {"email": (0, 10_000), "ip": (4, 12), "card": (14, 19), "phone": (9, 15)}
TRIGGERS = frozenset("call phone tel telephone fax ring mobile number card visa amex credit mail email e contact write ip host server address ping".split())
SIGNS = re.compile(r"[0-9@]|\b(?:at|dot)\b")
DIGITS = re.compile(r"[0-9]+")
#: Runs of digits from their start, without backtracking: what could begin inside a run could begin with it.
FOUR = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+")
APART = str.maketrans("", "", " -")
#: A spelled-out address, put together.
AT = re.compile(r"\s*[\[({]\s*(?:at|@)\s*[\])}]\s*|\s+at\s+|\s*@\s*", re.IGNORECASE)
DOT = re.compile(r"\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\s+dot\s+", re.IGNORECASE)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := HOST.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in FOUR.finditer(text):
        if all(len(x := part.lstrip("0")) < 4 and int(x or "0") <= 255 for part in m.groups()):
            out.append((m.start(), m.end(), "ip"))
    for m in CHAIN.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and 18 separators
            digits = m[0].translate(APART)
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


@lru_cache(maxsize=50_000)
def shape(token: str) -> str:
    if token[0].isdigit():
        return f"d{min(len(token), 8)}"
    if token[0].isalpha():
        low = token.lower()
        return f"w={low}" if low in ("at", "dot") else "W" if token[0].isupper() else "w"
    return token


def features(tokens: list[str], gaps: list[bool]) -> list[list[str]]:
    """Names of the features of each token; gaps: whether white space stands before it."""
    s = ["^^", "^", *map(shape, tokens), "$", "$$"]
    n = len(tokens)
    total = [0]
    for t in tokens:
        total.append(total[-1] + (len(t) if t[0].isdigit() else 0))
    out = []
    for i in range(n):
        k = i + 2
        near = [t.lower() for t in tokens[max(0, i - 5) : i] if t.lower() in TRIGGERS]
        # digits that the run of numbers and marks around this token holds
        a, b = i, i
        if shape(tokens[i])[0] not in "wW":
            while a > 0 and shape(tokens[a - 1])[0] not in "wW" and i - a < 8:
                a -= 1
            while b + 1 < n and shape(tokens[b + 1])[0] not in "wW" and b - i < 8:
                b += 1
        digits = total[b + 1] - total[a]
        out.append([f"0{s[k]}", f"-{s[k - 1]}", f"+{s[k + 1]}", f"-0{s[k - 1]}{s[k]}", f"0+{s[k]}{s[k + 1]}", f"-+{s[k - 1]}{s[k + 1]}", f"2-{s[k - 2]}{s[k - 1]}{s[k]}", f"2+{s[k]}{s[k + 1]}{s[k + 2]}", f"g{gaps[i]}{s[k]}", f"n{min(digits, 20)}", f"t{near[-1] if near else ''}", f"t{near[-1] if near else ''}{s[k]}"])
    return out


class Field:
    """Weights of the conditional random field: one row for each feature, and transitions."""

    def __init__(self, index: dict[str, int], unary: np.ndarray, pair: np.ndarray):
        self.index, self.unary, self.pair = index, unary, pair

    def potentials(self, rows: list[list[str]]) -> np.ndarray:
        get = self.index.get
        ids = [[j for f in row if (j := get(f)) is not None] for row in rows]
        return np.stack([self.unary[i].sum(0) if i else np.zeros(len(TAGS)) for i in ids]) if ids else np.zeros((0, len(TAGS)))

    def viterbi(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each chain of potentials; chains advance together, in grids of at most about GRID tokens."""
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
        at = 0
        while at < len(order):
            most, tags = len(chains[order[at]]), len(TAGS)
            if not most:
                break
            own = order[at : at + max(1, GRID // most)]
            at += len(own)
            size = np.array([len(chains[i]) for i in own])
            grid = np.zeros((most, len(own), tags))
            for b, i in enumerate(own):
                grid[: size[b], b] = chains[i]
            score = grid[0] + START
            back = np.zeros((most, len(own), tags), np.int8)
            for t in range(1, most):
                n = int((size > t).sum())
                step = score[:n, :, None] + (self.pair + LEGAL)[None]
                back[t, :n] = step.argmax(1)
                score[:n] = step.max(1) + grid[t, :n]
            tag = score.argmax(1)
            best = np.zeros((most, len(own)), np.int64)
            for t in range(most - 1, -1, -1):
                live = size > t
                best[t, live] = tag[live]
                if t:
                    tag = np.where(live, back[t][np.arange(len(own)), tag], tag)
            for b, i in enumerate(own):
                out[i] = best[: size[b], b]
        return out

    def long_viterbi(self, text: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tags, starts and ends of the tokens of one long stretch, part by part.

        Features look at most MARGIN tokens to either side; a part's last scores begin the next part, and a byte a tag
        and token is kept to walk back.
        """
        find = TOKEN.finditer(text, a, b)
        held = list(islice(find, PART + MARGIN))
        before: list[re.Match] = []
        score, backs, starts, ends = None, [], [], []
        move = self.pair + LEGAL
        while held:
            own, after = held[:PART], held[PART:]
            around = [*before, *held]
            gaps = [m.start() == a or text[m.start() - 1].isspace() for m in around]
            rows = features([m[0] for m in around], gaps)[len(before) : len(before) + len(own)]
            grid = self.potentials(rows)
            back = np.zeros((len(own), len(TAGS)), np.int8)
            for t in range(len(own)):
                if score is None:
                    score = grid[t] + START
                else:
                    step = score[:, None] + move
                    back[t] = step.argmax(0)
                    score = step.max(0) + grid[t]
            score = score - score.max()
            backs.append(back)
            starts.append(np.fromiter((m.start() for m in own), np.int64, len(own)))
            ends.append(np.fromiter((m.end() for m in own), np.int64, len(own)))
            before = own[-MARGIN:]
            held = [*after, *islice(find, PART)]
        if score is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        back = np.concatenate(backs)
        tags, tag = np.zeros(len(back), np.int8), int(score.argmax())
        for t in range(len(back) - 1, -1, -1):
            tags[t] = tag
            tag = back[t, tag]
        return tags, np.concatenate(starts), np.concatenate(ends)


#: An inside tag follows a tag of its kind only.
LEGAL = np.array([[-1e4 if b[0] == "I" and a[1:] != b[1:] else 0.0 for b in TAGS] for a in TAGS])
START = np.array([-1e4 if t[0] == "I" else 0.0 for t in TAGS])


def tokens_of(text: str, first: int = 0) -> tuple[list[str], list[int], list[bool]]:
    found = list(TOKEN.finditer(text))
    starts = [m.start() for m in found]
    return [m[0] for m in found], [first + a for a in starts], [a == 0 or text[a - 1].isspace() for a in starts]


def examples(seed: int = 3) -> list[tuple[list[str], list[bool], list[int]]]:
    """The labelled lines with digits and names varied: tokens, gaps and tags."""
    rng, out = random.Random(seed), []
    for line in LABELLED:
        for _ in range(VARIANTS):
            text, spans, i = "", [], 0
            for part in re.split(r"(\[(?:email|ip|card|phone):(?:[^\[\]]|\[[^\[\]]*\])*\])", line):
                if m := re.fullmatch(r"\[(email|ip|card|phone):(.*)\]", part):
                    part = m[2]
                    kind = m[1]
                else:
                    kind = ""
                made = re.sub("Xx", lambda _: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))), part)
                made = re.sub("9", lambda _: rng.choice("0123456789"), made).replace("x", rng.choice("abcdef"))
                if kind:
                    spans.append((len(text), len(text) + len(made), kind))
                text += made
            toks, starts, gaps = tokens_of(text)
            tags = []
            for a in starts:
                hit = next((s for s in spans if s[0] <= a < s[1]), None)
                tags.append(0 if hit is None else TAGS.index(("B-" if a == hit[0] else "I-") + hit[2]))
            out.append((toks, gaps, tags))
    return out


@lru_cache(maxsize=1)
def train(seed: int = 3) -> Field:
    """Maximises the likelihood of the labelled lines by adaptive gradient steps."""
    data = [(features(t, g), np.array(y)) for t, g, y in examples(seed)]
    index = {f: i for i, f in enumerate(dict.fromkeys(f for rows, _ in data for row in rows for f in row))}
    k = len(TAGS)
    unary, pair = np.zeros((len(index), k)), np.zeros((k, k))
    g_unary, g_pair = np.full_like(unary, 1e-3), np.full_like(pair, 1e-3)
    coded = [(np.array([[index[f] for f in row] for row in rows]), y) for rows, y in data]
    rng = np.random.default_rng(seed)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    for _ in range(EPOCHS):
        for e in rng.permutation(len(coded)):
            ids, y = coded[e]
            n = len(y)
            pot, move = unary[ids].sum(1), pair + LEGAL
            fwd, bwd = np.zeros((n, k)), np.zeros((n, k))
            fwd[0] = pot[0] + START
            for t in range(1, n):
                fwd[t] = lse(fwd[t - 1][:, None] + move, 0) + pot[t]
            for t in range(n - 2, -1, -1):
                bwd[t] = lse(move + (pot[t + 1] + bwd[t + 1])[None], 1)
            z = lse(fwd[-1], 0)
            grad = np.exp(fwd + bwd - z)
            grad[np.arange(n), y] -= 1
            by = np.zeros((k, k))
            for t in range(1, n):
                by += np.exp(fwd[t - 1][:, None] + move + (pot[t] + bwd[t])[None] - z)
                by[y[t - 1], y[t]] -= 1
            touched, inverse = np.unique(ids, return_inverse=True)
            step = np.zeros((len(touched), k))
            np.add.at(step, inverse.reshape(ids.shape), grad[:, None, :])
            step += 1e-3 * unary[touched]
            g_unary[touched] += step * step
            unary[touched] -= 0.3 * step / np.sqrt(g_unary[touched])
            by += 1e-3 * pair
            g_pair += by * by
            pair -= 0.3 * by / np.sqrt(g_pair)
    return Field(index, unary, pair)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around its signs, REACH tokens to either side, joined where they meet."""
    out: list[list[int]] = []
    for m in SIGNS.finditer(text):
        a, b = m.span()
        if out and b <= out[-1][1]:
            continue
        low = out[-1][1] if out else 0
        for _ in range(REACH):
            while a > low and not text[a - 1].isspace():
                a -= 1
            while a > low and text[a - 1].isspace():
                a -= 1
        while a > low and not text[a - 1].isspace():
            a -= 1
        n = len(text)
        for _ in range(REACH):
            while b < n and not text[b].isspace():
                b += 1
            while b < n and text[b].isspace():
                b += 1
        while b < n and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def valid(kind: str, text: str) -> bool:
    digits = "".join(DIGITS.findall(text))
    low, high = VALID[kind]
    if not low <= len(digits) <= high or "\n" in text:
        return False
    if kind == "email":
        return ADDRESS.fullmatch(DOT.sub(".", AT.sub("@", text))) is not None
    if kind == "ip":
        parts = DIGITS.findall(text)
        return len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts)
    if kind == "phone":
        return len(DIGITS.findall(text)) > 1 or len(digits) <= 11
    return luhn(digits)


class Taken:
    """Whether a place of a text overlaps one of its spans."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts = sorted(a for a, _, _ in spans)
        self.ends = list(accumulate((b for _, b, _ in sorted(spans)), max))

    def overlaps(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a


def runs_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(first token, token after the last, kind) of each tagged span."""
    out = []
    for t in np.flatnonzero(tags).tolist():
        if TAGS[tags[t]][0] == "B":
            kind, u = TAGS[tags[t]][2:], t + 1
            while u < len(tags) and TAGS[tags[u]] == f"I-{kind}":
                u += 1
            out.append((t, u, kind))
    return out


def added_spans(texts: list[str], base: list[list[tuple[int, int, str]]], field: Field) -> list[list[tuple[int, int, str]]]:
    """Spans that the field adds to each text."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    taken = [Taken(spans) for spans in base]

    def add(i: int, a: int, b: int, kind: str) -> None:
        if b - a <= 200 and valid(kind, texts[i][a:b]) and not taken[i].overlaps(a, b):
            out[i].append((a, b, kind))

    def decode(some: list[tuple[int, int, int]]) -> None:
        places, chains = [], []
        for i, a, b in some:
            toks, starts, gaps = tokens_of(texts[i][a:b], a)
            if any(t[0].isdigit() or t == "@" for t in toks) or ("at" in toks and "dot" in toks):
                chains.append(field.potentials(features(toks, gaps)))
                places.append((i, toks, starts))
        for (i, toks, starts), tags in zip(places, field.viterbi(chains)):
            for t, u, kind in runs_of(tags):
                add(i, starts[t], starts[u - 1] + len(toks[u - 1]), kind)

    some, held = [], 0
    for i, text in enumerate(texts):
        for a, b in stretches(text) if text else []:
            if b - a > LONG:
                tags, starts, ends = field.long_viterbi(text, a, b)
                for t, u, kind in runs_of(tags):
                    add(i, int(starts[t]), int(ends[u - 1]), kind)
                continue
            some.append((i, a, b))
            held += b - a
            if held > 4 * LONG:
                decode(some)
                some, held = [], 0
    decode(some)
    for spans in out:
        spans.sort()
    return out


def coded(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base string, spans string): the base spans and all spans of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        base = [base_spans(t) for t in texts]
        more = added_spans(texts, base, shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([coded(b, KINDS) for b in base], pa.string()), pa.array([coded(b + m, KINDS) for b, m in zip(base, more)], pa.string())], names=["id", "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return common.map_arrow(own, one, f"id {kind}, base string, spans string", text=1).withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span (overlaps joined, named by the first) replaced by its kind in angle brackets."""
    out, at, end, name = [], 0, -1, ""
    for a, b, kind in sorted(spans):
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out.append(f"<{name}>")
            at = end
        out.append(text[at:a])
        end, name = b, kind.upper()
    return "".join([*out, f"<{name}>", text[end:]]) if end >= 0 else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with all spans of the text replaced; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    place = docs.columns.index(text_col)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(place).to_pylist()
        plain = [t or "" for t in texts]
        base = [base_spans(t) for t in plain]
        more = added_spans(plain, base, shared.value)
        new = pa.array([None if t is None else masked(t, b + m) for t, b, m in zip(texts, base, more)], pa.string())
        return batch.set_column(place, batch.schema.field(place), new)

    return common.map_arrow(docs, one, docs.schema, text=place)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))
    count = [F.regexp_count("base", F.lit(rf"\b{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op8_pii": op8_pii}
