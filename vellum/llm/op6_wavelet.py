"""Token ids in wavelet matrices, one compressed file row for each shard.

Texts are encoded by the tokenizers library, an end id follows each, and documents in ascending id order fill shards of
about SHARD tokens. A shard's wavelet matrix keeps one bit-plane for each bit of the ids, the highest first, each plane
in the order left by stably parting the tokens by the planes before; ranks for every block of bits are rebuilt on load.
One file answers token access, counting of an id in a range, and lookup of its k-th occurrence, without decoding.

White space ends words before the tokenizer's merges, so each distinct word that a task meets is encoded once (see
Encoder).

Defined results: null and empty texts hold the end id alone; rows without an id come first; repeated rows stand next
to each other, in the order of their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHARD, REMEMBER, BLOCK, SLICE = 1 << 19, 600_000, 512, 4 << 20
MAGIC = b"VWM1"


class WaveletMatrix:
    """Bit-planes of a sequence of unsigned integers."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.planes, self.n = planes, n  # each plane: packed bits
        self.width = len(planes)
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        width = max(1, int(values.max()).bit_length()) if len(values) else 1
        a = values.astype(np.uint16 if width <= 16 else np.uint32)
        planes = []
        for b in range(width - 1, -1, -1):
            bit = (a & a.dtype.type(1 << b)) != 0
            planes.append(np.packbits(bit))
            a = np.concatenate([a[~bit], a[bit]])
        return cls(planes, len(values))

    def decode(self) -> np.ndarray:
        """The whole sequence, parted planes put back from the lowest to the highest."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for b, plane in enumerate(reversed(self.planes)):
            bit = np.unpackbits(plane, count=self.n).view(bool)
            zeros = self.n - int(np.count_nonzero(bit))
            back = np.empty(self.n, kind)
            back[~bit] = a[:zeros]
            back[bit] = a[zeros:] | kind(1 << b)
            a = back
        return a

    @property
    def ranks(self) -> list[np.ndarray]:
        """Ones before each block of a plane."""
        if self._ranks is None:
            self._ranks = []
            for plane in self.planes:
                ones = np.unpackbits(np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)])).reshape(-1, BLOCK).sum(1)
                self._ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        return self._ranks

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits."""
        block = i // BLOCK
        raw = int.from_bytes(self.planes[level][block * BLOCK // 8 : (i + 7) // 8].tobytes(), "big")
        return int(self.ranks[level][block]) + (raw >> (-i % 8)).bit_count()

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that kind."""
        low, high = 0, self.n
        while high - low > 1:
            mid = (low + high) // 2
            ones = self.rank1(level, mid)
            if (ones if bit else mid - ones) <= k:
                low = mid
            else:
                high = mid
        return low

    def zeros(self, level: int) -> int:
        return self.n - self.rank1(level, self.n)

    def access(self, i: int) -> int:
        out = 0
        for level in range(self.width):
            b, ones = self.bit(level, i), self.rank1(level, i)
            out = out << 1 | b
            i = self.zeros(level) + ones if b else i - ones
        return out

    def _descend(self, value: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.width):
            x, y = self.rank1(level, a), self.rank1(level, b)
            a, b = (self.zeros(level) + x, self.zeros(level) + y) if value >> (self.width - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def count(self, value: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of value in places a to b."""
        if value >> self.width:
            return 0
        x, y = self._descend(value, a, self.n if b is None else b)
        return y - x

    def occurrence(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of value; -1 if there are fewer."""
        if k < 0 or k >= self.count(value):
            return -1
        i = self._descend(value, 0, self.n)[0] + k
        for level in range(self.width - 1, -1, -1):
            if value >> (self.width - 1 - level) & 1:
                i = self.select(level, 1, i - self.zeros(level))
            else:
                i = self.select(level, 0, i)
        return i


def pack(tokens: np.ndarray, ids: list[int | None], sizes: np.ndarray) -> bytes:
    """A shard file: head, document ids and sizes, then the compressed planes."""
    m, press = WaveletMatrix.build(tokens), zstandard.ZstdCompressor(level=1)
    docs = press.compress(np.array([-(2**63) if i is None else i for i in ids], "<i8").tobytes() + sizes.astype("<i8").tobytes())
    planes = [press.compress(p.tobytes()) for p in m.planes]
    return b"".join([MAGIC, struct.pack("<QQII", m.n, len(ids), m.width, len(docs)), struct.pack(f"<{m.width}I", *map(len, planes)), docs, *planes])


def unpack(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """The matrix, document ids and sizes of a shard file."""
    if data[:4] != MAGIC:
        raise ValueError("no shard file")
    n, docs, width, size = struct.unpack_from("<QQII", data, 4)
    sizes = struct.unpack_from(f"<{width}I", data, 28)
    at, press = 28 + 4 * width, zstandard.ZstdDecompressor()
    head = np.frombuffer(press.decompress(data[at : at + size]), "<i8")
    at += size
    planes = []
    for s in sizes:
        planes.append(np.frombuffer(press.decompress(data[at : at + s]), np.uint8))
        at += s
    return WaveletMatrix(planes, n), head[:docs], head[docs:]


@lru_cache(maxsize=1)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Marks at the end of a word, after a letter or digit that lower-casing leaves as it is: a token run of their own.
TAIL = r"([a-z0-9ß-öø-ÿ])([!-/:-@\[-`{-~]+)([ \n]|$)"
#: Words of these letters alone are one token run that the library's normalizers leave as it is.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
PLAIN = f"^[{LETTERS}]+$"
#: Where lower-casing letters before the library does would not be the same: special tokens, and I under a dot.
ODD = "<[|]|\u0307"


class Encoder:
    """Encodes texts by their distinct words, each of which a task's worker hands to the library once.

    White space ends token runs; ASCII letters are lower-cased by the tokenizer, and marks after a plain letter form a
    run of their own, so both are taken apart before words are told apart. Texts that match ODD go to the library
    whole. A plain word is given to the library's model itself, spelled in its byte letters, which takes half the time of
    a text of words; where that is not the same for a tokenizer (tried on construction) words go as texts. Words are remembered in two generations: a full one grows old, and what is used
    again returns from it.
    """

    def __init__(self, path: str, end: int):
        self.path, self.end = path, np.array([end], np.uint32)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.model = tokenizer(path).model
        self.spelled = self._spelling()

    def _spelling(self) -> dict[int, str] | None:
        """The byte letters of each letter of plain words; None if the model alone does not give the library's ids."""
        library = tokenizer(self.path)
        runs = [library.pre_tokenizer.pre_tokenize_str(c) for c in LETTERS] if library.pre_tokenizer else []
        if not runs or any(len(run) != 1 for run in runs):
            return None
        spelled = {ord(c): run[0][0] for c, run in zip(LETTERS, runs)}
        probes = [w for c in LETTERS for w in (c, c + c, f"the{c}", f"{c}tion", f"a{c}en{c}er")]
        same = all([t.id for t in self.model.tokenize(w.translate(spelled))] == library.encode(w, add_special_tokens=False).ids for w in probes)
        return spelled if same else None

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of each word, from memory or the library."""
        if len(self.young) > REMEMBER:
            self.young, self.old = {}, self.young
        young, old = self.young.get, self.old.get
        found = list(map(young, words))
        missing = [w for w, x in zip(words, found) if x is None]
        if missing:
            again = {w: x for w in missing if (x := old(w)) is not None}
            self.young.update(again)
            self.encode([w for w in missing if w not in again])
            found = list(map(young, words))
        return found

    def encode(self, words: list[str]) -> None:
        """Remembers the ids of new words."""
        other, library = words, tokenizer(self.path)
        if self.spelled:
            plain = pc.match_substring_regex(pa.array(words, pa.string()), PLAIN).to_pylist()
            other = [w for w, p in zip(words, plain) if not p]
            tokenize, spelled = self.model.tokenize, self.spelled
            for w in compress(words, plain):
                self.young[w] = array("I", [t.id for t in tokenize(w if w.isascii() else w.translate(spelled))]).tobytes()
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            for w, e in zip(part, library.encode_batch_fast(part, add_special_tokens=False)):
                self.young[w] = array("I", e.ids).tobytes()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, an end id after each, and how many each has."""
        texts = texts.fill_null("")
        special = pc.match_substring_regex(texts, ODD)
        plain = pc.if_else(special, "", texts) if pc.any(special).as_py() else texts
        apart = pc.replace_substring_regex(pc.ascii_lower(plain), TAIL, r"\1 \2\3")
        lists = pc.split_pattern(pc.replace_substring(apart, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        known = [*self.learn(words.dictionary.to_numpy(zero_copy_only=False).tolist()), self.end.tobytes()]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(known), np.uint32)
        at = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
        index = np.insert(words.indices.to_numpy(zero_copy_only=False), at, len(known) - 1)
        n = size[index]
        upto = np.cumsum(n)
        ids = flat[np.repeat(start[index] - upto + n, n) + np.arange(int(n.sum()))]
        count = np.diff(upto[at + np.arange(len(at))], prepend=0)
        if len(texts) and pc.any(special).as_py():
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
                whole = tokenizer(self.path).encode(texts[i].as_py(), add_special_tokens=False)
                parts[i] = np.concatenate([np.array(whole.ids, np.uint32), self.end])
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, count


@lru_cache(maxsize=1)
def encoder(path: str, end: int) -> Encoder:
    """One for each Python worker, which runs many tasks."""
    return Encoder(path, end)


def write_shards(docs: DataFrame, path: str | None = None, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table (pid, seq, n_tokens, data): shard files in document order, by partition and place in it."""
    path = path or default_tokenizer()

    def run(batches):
        encode, pid, seq = encoder(path, end), TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        total = 0

        def shard() -> pa.RecordBatch:
            data = pack(np.concatenate(parts), ids, np.concatenate(sizes))
            return pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_tokens": pa.array([total], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for part in common.slices(batch, 1, SLICE):
                tokens, count = encode(part.column(1))
                ids += part.column(0).to_pylist()
                sizes.append(count)
                parts.append(tokens)
                total += len(tokens)
                if total >= SHARD:
                    yield shard()
                    ids, sizes, parts, total, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard()

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = own.repartitionByRange("id").sortWithinPartitions("id", "text")
    return common.materialize(ordered.mapInArrow(run, "pid int, seq int, n_tokens long, data binary"), "shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, decoded from the shard files."""

    def run(batches):
        for batch in batches:
            for pid, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                matrix, ids, sizes = unpack(data)
                raw = memoryview(matrix.decode().astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                k = len(ids)
                none = ids == -(2**63)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, pid, np.int32)), pa.array(np.full(k, seq, np.int32)), pa.array(ids, pa.int64(), mask=none), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["pid", "seq", "id", "inner", "n_tokens", "ids_crc32"])

    docs = shards.select("pid", "seq", "data").mapInArrow(run, "pid int, seq int, id long, inner long, n_tokens long, ids_crc32 long")
    # tokens before each partition (as many rows as partitions), then before each shard in it
    totals = shards.groupBy("pid").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("pid", (F.sum("n").over(W.orderBy("pid")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(W.partitionBy("pid").orderBy("seq")) - F.col("n_tokens")
    starts = shards.select("pid", "seq", inside.alias("inside")).join(before, "pid").select("pid", "seq", (F.col("before") + F.col("inside")).alias("base"))
    return docs.join(starts, ["pid", "seq"]).select("id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(common.table(spark, sf_dir, "documents"))
    return read_documents(shards).withColumnRenamed("id", "doc_id")


QUERIES = {"op6_wavelet": op6_wavelet}
