"""Packing along a space-filling curve: similar documents share training sequences.

A document's token ids are counted in BUCKETS hashed places; the logarithms of the counts, as a unit vector, are projected
to DIMS fixed random directions. The means and deviations of all documents' projections make a grid of 2^BITS cells a
side, and each cell's place on the Hilbert curve is the document's key. Documents are range-sorted by key (and by row, so
a third of all rows with one text still spreads), and each range is cut along the curve into sequences of a fixed length.
What a range leaves over is cut into sequences of falling powers of two, which need no padding, so none is padded at all.

Defined results: null and empty texts hold the end id alone; rows without an id, repeated rows and rows of one id are
documents of their own; ties on the curve keep the order in which rows were read; an empty table gives no rows; other
columns are ignored. Texts of over LONG characters are encoded in stretches that end at a space, and documents of more
than PART tokens travel in parts, so rows stay small; a text with the tokenizer's special marks is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, op6_wavelet, shingles

BUCKETS, DIMS, BITS = 256, 4, 15
LENGTH, LONG, PART, SLICE = 4096, 1 << 20, 1 << 18, 4 << 20
#: Rows handed back at once.
ROWS = 128
_odd = re.compile(op6_wavelet.ODD)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (a row each, coordinates under 2^bits; at most 63 bits in all)."""
    x = cells.astype(np.int64).T.copy()
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the turns of each level of the curve, the largest first
        low = bit - 1
        for i in range(len(x)):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis >> b & 1)
    return key


@lru_cache(maxsize=1)
def buckets(n: int) -> np.ndarray:
    """The hashed place of each token id under n."""
    return (shingles.mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(56)).astype(np.int64)


def directions(dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(12).standard_normal((BUCKETS, dims))


def vectors(ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A projected vector for each document."""
    bucket = buckets(1 << int(ids.max(initial=1)).bit_length())[ids]
    hashed = np.bincount(np.repeat(np.arange(len(count)), count) * BUCKETS + bucket, minlength=len(count) * BUCKETS)
    v = np.log1p(hashed.reshape(len(count), BUCKETS))
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) @ directions()


#: A worker's compressor and decompressor; a new one for each document costs more than its ids.
_press, _unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def press(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([width]) + _press.compress(ids.astype(f"<u{width}").tobytes())


def unpress(data: bytes) -> np.ndarray:
    return np.frombuffer(_unpress.decompress(data[1:]), f"<u{data[0]}").astype(np.uint32)


def stretches(text: str, size: int = LONG) -> Iterator[str]:
    """The text in parts of at least size characters that end before a space; whole if special marks may be in it."""
    start = 0
    while len(text) - start > size and not _odd.search(text) and (at := text.find(" ", start + size)) >= 0:
        yield text[start:at]
        start = at + 1
    yield text[start:]


def encoded(texts: pa.Array, encode: op6_wavelet.Encoder) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, an end id after each, and how many each has."""
    if len(texts) > 1 or len(texts[0].as_py() or "") <= LONG:
        return encode(texts)
    parts = [encode(pa.array([part]))[0][:-1] for part in stretches(texts[0].as_py())]
    ids = np.concatenate([*parts, encode.end])
    return ids, np.array([len(ids)])


def write_tokens(docs: DataFrame, path: str | None = None, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table (row, doc_id, part, start, doc_tokens, y0, y1, ..., ids): pressed ids and projected vectors."""
    path = path or op6_wavelet.default_tokenizer()
    places = [f"y{i}" for i in range(DIMS)]

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        ids, count = encoded(batch.column(1), op6_wavelet.encoder(path, end))
        y, ends, names = vectors(ids, count), np.cumsum(count), batch.column(0).to_pylist()
        out = []
        for i, (b, n) in enumerate(zip(ends.tolist(), count.tolist())):
            for start in range(0, n, PART):
                out.append((names[i], start // PART, start, n, i, press(ids[b - n + start : min(b, b - n + start + PART)])))
        own, parts, starts, totals, of, data = zip(*out)
        numbers = [pa.array(own, pa.int64()), pa.array(parts, pa.int32()), pa.array(starts, pa.int64()), pa.array(totals, pa.int64())]
        columns = [*numbers, *(pa.array(c) for c in y[list(of)].T), pa.array(data, pa.binary())]
        return [pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start", "doc_tokens", *places, "ids"])]

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sliced = F.monotonically_increasing_id().alias("row")
    found = own.mapInArrow(lambda batches: (x for b in batches for part in common.slices(b, 1, SLICE) if part.num_rows for x in run(part)), f"doc_id long, part int, start long, doc_tokens long, {', '.join(f'{y} double' for y in places)}, ids binary")
    with common.small_batches(docs.sparkSession):
        return common.materialize(found.select(sliced, "*"), "tokens")


def curve_keys(tokens: DataFrame, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """tokens with key, their place on the curve; the grid spans all documents' means and deviations."""
    each = [F.col(f"y{i}") for i in range(dims)]
    stats = tokens.where("part = 0").agg(*[F.avg(y).alias(f"m{i}") for i, y in enumerate(each)], *[F.stddev_pop(y).alias(f"s{i}") for i, y in enumerate(each)]).first()
    mean, deviation = (np.array([stats[f"{k}{i}"] or 0.0 for i in range(dims)]) for k in "ms")

    @F.pandas_udf("long")
    def key(*y: pd.Series) -> pd.Series:
        z = (np.column_stack(y) - mean) / np.maximum(deviation, 1e-12)
        share = 0.5 + 0.5 * np.tanh(0.8 * z)  # close to the normal distribution, so cells fill evenly
        return pd.Series(hilbert(np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits))

    return tokens.withColumn("key", key(*each))


PIECE = ("doc_id", "start", "length", "doc_tokens", "offset")


class Packer:
    """Fills sequences of a fixed length with what comes; the rest is cut into falling powers of two."""

    def __init__(self, length: int):
        self.length = length
        self.parts: list[tuple[tuple, np.ndarray]] = []  # (doc_id, start, doc_tokens) and ids, not yet in a sequence
        self.held = 0

    def _take(self, size: int) -> tuple[np.ndarray, list[tuple]]:
        """A sequence of the first size ids held, and its pieces, as PIECE tells them."""
        ids, pieces, offset = [], [], 0
        while offset < size:
            (doc, start, total), own = self.parts.pop(0)
            n = min(len(own), size - offset)
            if n < len(own):
                self.parts.insert(0, ((doc, start + n, total), own[n:]))
            pieces.append((doc, start, n, total, offset))
            ids.append(own[:n])
            offset += n
        self.held -= size
        return np.concatenate(ids), pieces

    def add(self, doc: tuple, ids: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple]]]:
        self.parts.append((doc, ids))
        self.held += len(ids)
        while self.held >= self.length:
            yield self._take(self.length)

    def rest(self) -> Iterator[tuple[np.ndarray, list[tuple]]]:
        while self.held:
            yield self._take(1 << (self.held.bit_length() - 1))


def pack(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces): sequences along the curve; ids are little-endian 32-bit numbers.

    pieces tell what a sequence holds: (doc_id, start, length, doc_tokens, offset). The result reads the table of tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, pid, seq = Packer(length), TaskContext.get().partitionId(), 0
        out: list[tuple[int, np.ndarray, list[tuple]]] = []

        def handed() -> pa.RecordBatch:
            numbers, ids, pieces = zip(*out)
            each = [pa.array(c, pa.int64()) for c in zip(*(p for own in pieces for p in own))]
            ends = pa.array(np.cumsum([0, *map(len, pieces)]), pa.int32())
            columns = [pa.array(numbers, pa.int64()), pa.array(list(map(len, ids)), pa.int32()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(each, list(PIECE)))]
            return pa.RecordBatch.from_arrays(columns, names=["sequence_id", "n_tokens", "ids", "pieces"])

        def made(sequences: Iterator[tuple[np.ndarray, list[tuple]]]) -> Iterator[pa.RecordBatch]:
            nonlocal seq, out
            for ids, pieces in sequences:
                out.append((pid << 33 | seq, ids, pieces))
                seq += 1
                if len(out) == ROWS:
                    yield handed()
                    out = []

        for batch in batches:
            for doc, start, total, data in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                yield from made(packer.add((doc, start, total), unpress(data.as_py())))
        yield from made(packer.rest())
        if out:
            yield handed()

    ordered = curve_keys(write_tokens(docs, **options)).repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    piece = f"struct<{','.join(f'{name}:long' for name in PIECE)}>"
    return ordered.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, f"sequence_id long, n_tokens int, ids binary, pieces array<{piece}>")


def pieces_of(sequences: DataFrame) -> DataFrame:
    """One row for each piece, with the checksum of its ids."""
    crc = F.expr("transform(pieces, p -> struct(p.doc_id, p.start, p.length, crc32(substring(ids, cast(4 * p.offset + 1 as int), cast(4 * p.length as int))) as ids_crc32, p.doc_tokens, p.offset))")
    one = sequences.select("sequence_id", F.explode(crc).alias("p"))
    return one.select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")


def op12_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_of(pack(common.table(spark, sf_dir, "documents")))


QUERIES = {"op12_curve": op12_curve}
