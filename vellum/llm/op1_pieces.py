"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps, for a run of symbols, an agenda of adjacent pairs ordered by the score of the piece they would
form, the leftmost first among equals, and merges the best until no pair forms a piece. Symbols outside the
vocabulary fall back to their UTF-8 bytes. If no piece holds a space mark after another symbol, merges cannot
cross from one word into the next, so the agenda runs once for each distinct word that a task meets: all new words
of an Arrow batch advance together, one merge a round, in numpy; long words use a heap. Every new word is also
encoded by the sentencepiece library, and a difference raises.

Defined results: null or empty text has no ids and decodes to ''; a null id stays null; repeated rows repeat;
columns other than the id and the text are dropped (join back on the id), so extra names cannot clash.
"""

from __future__ import annotations

import codecs
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Words of more symbols than this go to the heap instead of the numpy rounds.
LONG = 48
#: Distinct words that a task remembers; the memory is emptied when it is full.
REMEMBER = 300_000
#: A rank after all others: the pair forms no piece.
NONE = np.int32(2**31 - 1)
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5

codecs.register_error("vellum-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Vocabulary:
    """The pieces of a model file and its pair table."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or any(p.type in (USER, UNUSED) for p in proto.pieces):
            raise ValueError("a merge-type vocabulary with identity normalisation and a dummy prefix is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.kind = np.array([p.type for p in proto.pieces])
        self.unknown = int(np.flatnonzero(self.kind == UNKNOWN)[0])
        pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        score = [p.score for p in proto.pieces]
        self.by_byte = [-1] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.by_byte[int(p.piece[3:5], 16)] = i
        # symbols: pieces, then single characters that only longer pieces hold
        self.symbols = dict(pieces)
        for p in pieces:
            for c in p:
                self.symbols.setdefault(c, len(proto.pieces) + len(self.symbols) - len(pieces))
        self.outside = max(self.symbols.values()) + 1  # plus its code point: a character that no piece holds
        self.width = self.outside + 0x110000
        pairs = {}
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                a, b = self.symbols.get(p[:cut]), self.symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = i
        self.pairs = pairs
        self.rank = np.unique(-np.array(score), return_inverse=True)[1].astype(np.int32)  # equal scores share a rank
        self.of_char = np.arange(self.outside, self.outside + 0x110000, dtype=np.int32)
        for p, i in self.symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        # a hash table of the pairs with linear probing: keys, the piece that each forms and its rank
        self.bits = max(4, int(len(pairs) * 2.5).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_made = np.full((1 << self.bits) + 1, -1, np.int32)  # the last: no such pair
        left = np.fromiter(pairs, np.int64, len(pairs))
        made = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self.slot(left)
        while len(left):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = left[free]  # of several, the last stays
            put = self.slot_key[at] == left
            self.slot_made[at[put]] = made[put]
            left, made, at = left[~put], made[~put], (at[~put] + 1) & ((1 << self.bits) - 1)
        self.slot_rank = np.append(self.rank, NONE)[self.slot_made]
        self.splits = all(MARK not in p.lstrip(MARK) for p in pieces)
        # decoding: the bytes of each piece, the mark as a space
        raw = [b"" if k in (CONTROL,) else b" \xe2\x81\x87 " if k == UNKNOWN else bytes([int(p.piece[3:5], 16)]) if k == BYTE else p.piece.replace(MARK, " ").encode() for p, k in zip(proto.pieces, self.kind)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len

    def to_ids(self, symbol: int, text: str) -> list[int]:
        """Ids of a final symbol: itself, or the bytes of a character that is no piece."""
        if symbol < len(self.kind):
            return [symbol]
        found = [self.by_byte[b] for b in text.encode()]
        return found if min(found) >= 0 else [self.unknown]

    def heap(self, word: str) -> list[int]:
        """The agenda as a heap of (rank, position); a word of any length."""
        text = list(word)
        symbol = self.of_char[[ord(c) for c in text]].tolist()
        n = len(text)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, int]] = []

        def add(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                made = self.pairs.get(symbol[i] * self.width + symbol[j])
                if made is not None:
                    heapq.heappush(agenda, (int(self.rank[made]), i, j, len(text[i]) + len(text[j])))

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not text[i] or not text[j] or right[i] != j or len(text[i]) + len(text[j]) != size:
                continue
            symbol[i] = self.pairs[symbol[i] * self.width + symbol[j]]
            text[i] += text[j]
            text[j] = ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            add(left[i], i)
            add(i, right[i])
        return [k for s, t in zip(symbol, text) if t for k in self.to_ids(s, t)]

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair of symbols; the last slot, without a piece and ranked NONE, for pairs that form none."""
        key = left.astype(np.int64) * self.width + right
        at = self.slot(key)
        found = self.slot_key[at]
        out = np.where(found == key, at, 1 << self.bits)
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[rest]]
            hit = found == key[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[~hit & (found >= 0)]
        return out

    def rounds(self, grid: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The agenda of many words of symbols, one row of grid each, one merge a round in each; ids as int32 bytes."""
        n, width = grid.shape
        grid = grid.ravel()
        order = np.full(n * width, NONE, np.int32)
        form = np.full(n * width, -1, np.int32)

        def pairs(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            slot = self.pair_slot(left, right)
            order[at], form[at] = self.slot_rank[slot], self.slot_made[slot]

        inner = np.flatnonzero((np.arange(width) < size[:, None] - 1).ravel())
        pairs(inner, grid[inner], grid[inner + 1])
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), n)
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), n)
        alive = (np.arange(width) < size[:, None]).ravel()
        live = np.arange(n)
        while len(live):
            at = order.reshape(n, width)[live].argmin(1) if len(live) < n else order.reshape(n, width).argmin(1)
            base = live * width
            i = base + at
            best = order[i]
            if (best == NONE).any():
                go = best < NONE
                live, base, i = live[go], base[go], i[go]
                if not len(live):
                    break
            ends = base + size[live]
            j = base + after[i]
            k = base + after[j]
            h = base + before[i]
            made = form[i]
            grid[i] = made
            after[i] = after[j]
            alive[j] = False
            order[j] = NONE
            more = k < ends
            before[k[more]] = (i - base)[more]
            order[i] = NONE
            pairs(i[more], made[more], grid[k[more]])
            more = h >= base
            pairs(h[more], grid[h[more]], made[more])
        ids = grid[alive].astype(np.int32).tobytes()
        ends = (np.cumsum(alive.reshape(n, width).sum(1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def words(self, text: str) -> list[str]:
        """Runs that merges cannot leave, each without the space mark that it begins with."""
        if self.splits and MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        text = MARK + text.replace(" ", MARK)
        return [w[1:] for w in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)] if self.splits else [text[1:]]

    def agenda(self, words: list[str], check: bool) -> list[bytes]:
        """The ids of each word (a space mark goes before it), as int32 bytes."""
        words = [MARK + w for w in words]
        out = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        start = np.cumsum(size) - size
        strange = np.maximum.reduceat(symbols, start) >= len(self.kind) if len(words) else np.zeros(0, bool)
        quick = size <= LONG
        for low, high in ((0, 5), (5, 8), (8, 11), (11, 16), (16, 26), (26, LONG)):
            own = np.flatnonzero(quick & (size > low) & (size <= high))
            if len(own):
                width = int(size[own].max())
                grid = symbols[np.minimum(start[own, None] + np.arange(width), len(symbols) - 1)]
                for i, ids in zip(own.tolist(), self.rounds(grid, size[own])):
                    out[i] = ids
        for i in np.flatnonzero(quick & strange).tolist():
            outer = {s: c for c, s in zip(words[i], self.of_char[[ord(c) for c in words[i]]].tolist())}
            ids = [k for s in np.frombuffer(out[i], np.int32).tolist() for k in self.to_ids(s, outer.get(s, ""))]
            out[i] = np.array(ids, np.int32).tobytes()
        for i in np.flatnonzero(~quick).tolist():
            out[i] = np.array(self.heap(words[i]), np.int32).tobytes()
        if check:
            # the library adds the mark of the dummy prefix itself
            own = [i for i, w in enumerate(words) if len(w) > 1]
            for i, ids in zip(own, self.library.encode([words[i][1:] for i in own], num_threads=1)):
                if np.array(ids, np.int32).tobytes() != out[i]:
                    raise ValueError(f"the agenda and the library differ on {words[i]!r}: {np.frombuffer(out[i], np.int32).tolist()} {ids}")
        return out

    def decode_bytes(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the documents whose ids end at ends."""
        size = self.raw_len[ids]
        stop = np.cumsum(size)
        flat = self.raw[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.raw_at[ids] - (stop - size), size)].tobytes()
        first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        out = []
        at = np.concatenate([[0], stop])
        for a, b in zip(first.tolist(), ends.tolist()):
            text = flat[at[a] : at[b]]
            if a < b:
                k = a  # control pieces leave nothing, the mark of the first other piece goes
                while k < b and self.kind[ids[k]] == CONTROL:
                    k += 1
                if k < b and self.kind[ids[k]] == NORMAL and text[:1] == b" ":
                    text = text[1:]
            out.append(text.decode("utf-8", "vellum-each-byte"))
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def list_of_ids(vocab: Vocabulary, known: dict[str, bytes], texts: list[str | None], check: bool) -> pa.ListArray:
    """The ids of each text; known remembers words."""
    split = [vocab.words(t) if t else [] for t in texts]
    new = list({w for words in split for w in words if w not in known})
    if len(known) + len(new) > REMEMBER:
        known.clear()
        new = list({w for words in split for w in words})
    known.update(zip(new, vocab.agenda(new, check)))
    parts = [b"".join(map(known.__getitem__, words)) for words in split]
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))]))


def list_of_texts(vocab: Vocabulary, ids: pa.ListArray) -> pa.Array:
    """The text that each list of ids stands for."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
    return pa.array(vocab.decode_bytes(flat, ends), pa.string())


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", check: bool = True, read_back: bool = False) -> DataFrame:
    """(id, ids array<int>): the pieces of each whole text; with read_back also decoded, what the ids decode to.

    check: compare every distinct word with the library. Both directions then run in one Python worker a task.
    """
    model = model or default_model()
    known: dict[str, bytes] = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(model)
        ids = list_of_ids(vocab, known, batch.column(1).to_pylist(), check)
        decoded = [list_of_texts(vocab, ids)] if read_back else []
        return pa.RecordBatch.from_arrays([batch.column(0), ids, *decoded], names=["id", "ids", "decoded"][: 2 + read_back])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids array<int>" + ", decoded string" * read_back
    out = common.map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), one, schema, text=1)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Adds decoded string to (id, ids): the text that the ids stand for."""
    model = model or default_model()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, list_of_texts(vocabulary(model), part.column(1))], names=["id", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    """The digest columns of encode and decode for a table with doc_id and text."""
    both = encode(docs, read_back=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
