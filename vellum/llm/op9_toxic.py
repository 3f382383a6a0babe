"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks at its ends), so misspelt and unseen words share vectors with
known ones. A window of about WINDOW words averages the vectors of its distinct words; a linear softmax over the
average tells toxic from clean windows, and the logit of a window of few words is shrunk (SHRINK). Embeddings and softmax are trained together on the windows of a bounded sample of labelled
documents (SAMPLE and SAMPLE_BYTES of each label, the smallest by a hash of the id). A document's score comes from its most toxic
window and its number of windows, by a logistic curve fitted to the sample at the labels' own rate. Since the softmax
is linear, tasks need one number for each n-gram bucket: the model that travels has 2^BITS of them.

Defined results: null and empty texts are scored as a text without evidence; unlabelled rows, labels that are null and
rows without an id are never learned from; of a document's labels the largest counts, of its
texts the smallest; with labels of one kind only, every score is that kind's rate; held_out is
null without an id; repeated rows repeat; columns other than id and text are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WINDOW, BITS, DIMS, SHORTEST, LONGEST = 50, 18, 8, 3, 6
SAMPLE, EPOCHS, STEPS, BATCH, THRESHOLD, REMEMBER = 1500, 6, 250, 512, 0.7, 250_000
#: Bytes of the sample's texts for each label: whole documents in the order of their hash until there are so many.
SAMPLE_BYTES = 16 << 20
#: A window of so many distinct words counts half.
SHRINK = 50


def buckets(words: list[str], step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of each word's n-grams and of the word itself, flat, and how many each word has."""
    parts = [some_buckets(words[i : i + step]) for i in range(0, len(words), step)]
    return np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])


def some_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    char = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    stop = np.repeat(end, size)
    at = np.arange(len(char))
    hashed = np.zeros(len(char), np.uint64)
    found, owners = [], []
    padded = np.concatenate([char, np.zeros(LONGEST, np.uint64)])
    for n in range(1, LONGEST + 1):
        hashed = hashed * np.uint64(0x100000001B3) + padded[n - 1 : n - 1 + len(char)] + np.uint64(1)
        if n >= SHORTEST:
            whole = at + n <= stop
            found.append(hashed[whole] ^ np.uint64(n))
            owners.append(owner[whole])
    full = np.add.reduceat(char * (np.uint64(0x9E3779B97F4A7C15) * (at - np.repeat(end - size, size)).astype(np.uint64) | np.uint64(1)), end - size)
    found.append(full)
    owners.append(np.arange(len(words)))
    key, owner = np.concatenate(found), np.concatenate(owners)
    key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    order = np.argsort(owner, kind="stable")
    return key[order].astype(np.int32), np.bincount(owner, minlength=len(words))


def windows(text: str | None) -> list[list[str]]:
    """The distinct words of windows of equal length, near WINDOW words; a text without words has one empty window."""
    words = text.lower().split() if text else []
    n = max(1, round(len(words) / WINDOW))
    cuts = [len(words) * i // n for i in range(n + 1)]
    return [list(dict.fromkeys(words[a:b])) for a, b in zip(cuts, cuts[1:])]


class Model:
    """value: the difference of the softmax's logits that a bucket adds; curve: of (most toxic window, log windows)."""

    def __init__(self, value: np.ndarray, bias: float, curve: tuple[float, float, float]):
        self.value, self.bias, self.curve = value, bias, curve
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {"value": self.value, "bias": self.bias, "curve": self.curve, "known": {}}

    def remember(self, parts: list[list[str]]) -> None:
        new = list({w for words in parts for w in words if w not in self.known})
        if len(self.known) + len(new) > REMEMBER:
            self.known.clear()
            new = list({w for words in parts for w in words})
        if new:
            for i in range(0, len(new), 8192):
                key, size = buckets(new[i : i + 8192])
                mean = np.add.reduceat(self.value[key].astype(np.float64), np.cumsum(size) - size) / size
                self.known.update(zip(new[i : i + 8192], mean.tolist()))

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The most toxic window's logit and the number of windows of each text."""
        split = [windows(t) for t in texts]
        count = np.array([len(x) for x in split])
        parts = [words for x in split for words in x]
        self.remember(parts)
        value = np.array([x for words in parts for x in map(self.known.__getitem__, words)], np.float64)
        size = np.array([len(words) for words in parts])
        owner = np.repeat(np.arange(len(parts)), size)
        logit = np.bincount(owner, value, len(parts)) / np.maximum(size, 1) + self.bias
        logit *= size / (size + SHRINK)  # few words are little evidence
        return np.maximum.reduceat(logit, np.cumsum(count) - count), count

    def score(self, texts: list[str | None]) -> np.ndarray:
        best, count = self.evidence(texts)
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a * best + b * np.log(count) + c, -40, 40)))


def fit(texts: list[str | None], toxic: np.ndarray, rate: float, seed: int = 5) -> Model:
    """Trains on whole texts; rate: the share of toxic documents to which scores are calibrated."""
    if not len(toxic) or toxic.min() == toxic.max():
        level = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
        return Model(np.zeros(1 << BITS, np.float32), 0.0, (0.0, 0.0, level))
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    parts = [(np.array([index.setdefault(w, len(index)) for w in words], np.int32), y) for t, y in zip(texts, toxic.tolist()) for words in windows(t) if words]
    key, size = buckets(list(index))
    start = np.cumsum(size) - size
    labels = np.array([y for _, y in parts])
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    table = (rng.normal(size=(1 << BITS, DIMS)) * 0.02).astype(np.float32)
    soft = (rng.normal(size=(DIMS, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    grown = np.full(1 << BITS, 1e-6, np.float32)
    grown_soft = np.full_like(soft, 1e-6)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(parts)))):
        order = rng.permutation(len(parts))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            flat = np.concatenate([parts[i][0] for i in own])
            count = np.array([len(parts[i][0]) for i in own])
            used, place = np.unique(flat, return_inverse=True)
            n = size[used]
            rows = key[np.repeat(start[used] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            vec = np.add.reduceat(table[rows], np.cumsum(n) - n) / n[:, None]
            mean = np.add.reduceat(vec[place], np.cumsum(count) - count) / count[:, None]
            z = mean @ soft + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            p *= weight[own, None]
            back = p @ soft.T / count[:, None]
            by_word = np.zeros((len(used), DIMS), np.float32)
            repeated = np.repeat(back, count, axis=0)
            for d in range(DIMS):
                by_word[:, d] = np.bincount(place, repeated[:, d], len(used))
            by_row = np.repeat(by_word / n[:, None], n, axis=0)
            touched, inverse = np.unique(rows, return_inverse=True)
            grad = np.stack([np.bincount(inverse, by_row[:, d], len(touched)) for d in range(DIMS)], 1).astype(np.float32)
            grown[touched] += (grad * grad).mean(1)
            table[touched] -= 0.1 * grad / np.sqrt(grown[touched])[:, None]
            grad = mean.T @ p
            grown_soft += grad * grad
            soft -= 0.1 * grad / np.sqrt(grown_soft)
            bias -= 0.02 * p.mean(0)
    value = table @ (soft[:, 1] - soft[:, 0])
    model = Model(value.astype(np.float32), float(bias[1] - bias[0]), (1.0, 0.0, 0.0))
    best, count = model.evidence(texts)
    scale = max(float(np.std(best)), 1e-9)
    x = np.stack([best / scale, np.log(count), np.ones(len(best))], 1)
    w = np.where(toxic == 1, rate / toxic.mean(), (1 - rate) / (1 - toxic.mean()))
    theta = np.zeros(3)
    for _ in range(60):  # Newton steps of a ridged logistic fit
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        ridge = np.diag([1e-3, 1e-3, 1e-6]) * len(x) * 0.05
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (w * (p - toxic)) + ridge @ theta)
        theta -= np.clip(step, -2, 2)
    return Model(model.value, model.bias, (float(theta[0] / scale), float(theta[1]), float(theta[2])))


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> tuple[list[str | None], np.ndarray, float]:
    """Texts and labels of documents that may be learned from, and the share of label 1.

    At most limit documents of each label and SAMPLE_BYTES of their text, so the driver's share is bounded.
    """
    own = labels.where(f"doc_id is not null and {label} in (0, 1) and crc32(cast(doc_id as string)) % 3 <> 1").groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = dict(own.groupBy("y").count().collect())
    if not counts:
        return [], np.zeros(0, np.int64), 0.0
    order = F.xxhash64("doc_id")
    chosen = own.where("y = 1").orderBy(order, "doc_id").limit(limit).unionAll(own.where("y = 0").orderBy(order, "doc_id").limit(limit))
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).join(F.broadcast(chosen), "doc_id")  # at most 2 * limit ids
    upto = F.sum("size").over(W.partitionBy("y").orderBy(order, "doc_id"))
    fits = sizes.groupBy("doc_id", "y").agg(F.max("size").alias("size")).withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id", "y")
    found = docs.select("doc_id", "text").join(F.broadcast(fits), "doc_id")
    rows = found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64), counts.get(1, 0) / sum(counts.values())


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return common.map_arrow(own, one, f"id {kind}, score double", text=1).withColumnRenamed("id", id_col)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE) -> Model:
    return fit(*sample(docs, labels, label, limit))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, common.table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
