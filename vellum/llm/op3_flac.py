"""Media columns: texts (or any bytes) as FLAC streams and back to PCM blocks.

A payload is stored as 8-bit mono samples (byte - 128) in frames of BLOCK samples. Each frame takes the cheapest of a
constant, raw samples, a fixed linear predictor or a quantised linear predictor, with Rice-coded residuals. A seek
table holds every frame's first sample and offset, so decoding starts anywhere, and many frames decode together: all
frames of a batch that share a shape advance one residual at a time as numpy lanes. Frame headers carry CRC-8, frames
CRC-16, the stream an MD5; the decoder verifies all three and raises on a difference. Predictors, Rice partitions and
escapes are decoded in general; more than one channel is refused.

Defined results: a null payload is empty; a payload is padded with zero bytes to a positive multiple of 64, so an
empty one is 64 zeros; equal payloads give equal streams; repeated rows repeat; columns other than id and payload are
dropped (join back on the id).
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK, UNIT, ORDER, PRECISION, RATE = 1024, 64, 8, 10, 8000
#: Samples in a PCM block of the decoder's output.
PCM_BLOCK = 65536
SLICE = 3 << 20
HALF, ONE = np.uint64(32), np.uint64(1)
#: Fixed predictors as linear predictors: coefficients of the samples before.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = crc_table(0x07, 8).tolist(), crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    out = 0
    for b in data:
        out = CRC8[out ^ b]
    return out


def crc16(frames: list[bytes]) -> np.ndarray:
    """CRC-16 of each frame; zeros before a frame leave it as it is, so all end together."""
    width = max(map(len, frames))
    rows = np.zeros((len(frames), width), np.uint8)
    for row, x in zip(rows, frames):
        row[width - len(x) :] = np.frombuffer(x, np.uint8)
    out = np.zeros(len(frames), np.int64)
    for column in np.ascontiguousarray(rows.T):
        out = (out << 8 & 0xFFFF) ^ CRC16[out >> 8 ^ column]
    return out


def coded_number(n: int) -> bytes:
    """A frame number as in UTF-8, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
        if n < limit:
            return bytes([(0xFF ^ (2 * limit - 1)) & 0xFF | n, *reversed(tail)])


def bit_matrix(values: np.ndarray, width: int) -> np.ndarray:
    """The low bits of each value, the highest first."""
    return (values[..., None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8).reshape(len(values), -1)


def predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of the rows of x by Levinson-Durbin: coefficients and shifts."""
    f = x.astype(np.float32)
    n = f.shape[1]
    r = np.stack([np.einsum("ij,ij->i", f[:, lag:], f[:, : n - lag]) for lag in range(ORDER + 1)], 1).astype(np.float64)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-3
    a = np.zeros((len(x), ORDER))
    err = r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    a = np.nan_to_num(np.clip(a, -15, 15))
    top = np.abs(a).max(1)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(top, 1e-6)) + 1e-9), 0, 15).astype(np.int64)
    c = np.round(a * (1 << shift)[:, None])
    return np.clip(c, -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int32), shift


def rice(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter of each row and its bits."""
    mean = z.mean(1)
    low = np.clip(np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64) - 1, 0, 11)
    cost = np.stack([(z >> (low + d)[:, None]).sum(1) + (low + d + 1) * z.shape[1] for d in range(3)], 1)
    best = cost.argmin(1)
    return low + best, cost[np.arange(len(z)), best]


def subframes(x: np.ndarray) -> list[bytes]:
    """A mono 8-bit subframe for each row of samples, padded to whole bytes."""
    n = x.shape[1]
    out: list[bytes] = [b""] * len(x)
    constant = (x == x[:, :1]).all(1)
    for i in np.flatnonzero(constant):
        out[i] = bytes([0, int(x[i, 0]) & 0xFF])
    rest = np.flatnonzero(~constant)
    if not len(rest):
        return out
    x = x[rest].astype(np.int32)
    coef, shift = predictors(x)
    pred = np.zeros((len(x), n - ORDER), np.int32)
    for j in range(ORDER):
        pred += coef[:, j : j + 1] * x[:, ORDER - 1 - j : n - 1 - j]
    residuals = {"lpc": x[:, ORDER:] - (pred >> shift[:, None].astype(np.int32)), 0: x, 1: np.diff(x), 2: np.diff(x, n=2)}
    head = {"lpc": 8 * ORDER + 9 + PRECISION * ORDER, 0: 0, 1: 8, 2: 16}
    choice = {}
    for kind, res in residuals.items():
        z = res << 1 ^ res >> 31
        choice[kind] = (z, *rice(z))
    cost = np.stack([choice[k][2] + head[k] + 10 for k in residuals], 1)
    kinds = list(residuals)
    best, raw = cost.argmin(1), cost.min(1) >= 8 * n
    for i in np.flatnonzero(raw):
        out[rest[i]] = bytes([2]) + (x[i] & 0xFF).astype(np.uint8).tobytes()
    for k, kind in enumerate(kinds):
        own = np.flatnonzero((best == k) & ~raw)
        if not len(own):
            continue
        z, par = choice[kind][0][own], choice[kind][1][own]
        order = ORDER if kind == "lpc" else kind
        code = 0x40 | (ORDER - 1) << 1 if kind == "lpc" else 0x10 | kind << 1
        fixed = [bit_matrix(np.full((len(own), 1), code), 8), bit_matrix(x[own, :order] & 0xFF, 8)]
        if kind == "lpc":
            fixed += [bit_matrix(np.full((len(own), 1), PRECISION - 1), 4), bit_matrix(shift[own, None], 5), bit_matrix(coef[own] & (1 << PRECISION) - 1, PRECISION)]
        fixed += [np.zeros((len(own), 6), np.uint8), bit_matrix(par[:, None], 4)]  # 4-bit parameters, one partition
        fixed = np.concatenate(fixed, 1)
        quotient = z >> par[:, None].astype(np.int32)
        size = quotient + (par + 1)[:, None]
        total = (fixed.shape[1] + size.sum(1) + 7) // 8 * 8
        start = np.cumsum(total) - total
        bits = np.zeros(int(total.sum()), np.uint8)
        bits[start[:, None] + np.arange(fixed.shape[1])] = fixed
        stop = (start + fixed.shape[1])[:, None] + np.cumsum(size, 1) - size + quotient
        bits[stop] = 1
        for j in range(int(par.max())):
            has = np.flatnonzero(par > j)
            bits[stop[has] + 1 + j] = z[has] >> (par[has] - 1 - j)[:, None].astype(np.int32) & 1
        packed = np.packbits(bits).tobytes()
        for i, a, b in zip(own.tolist(), (start // 8).tolist(), ((start + total) // 8).tolist()):
            out[rest[i]] = packed[a:b]
    return out


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of UNIT."""
    where: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for at in range(0, len(p), BLOCK):
            where.setdefault(min(BLOCK, len(p) - at), []).append((i, at))
    frames: list[dict[int, bytes]] = [{} for _ in payloads]
    for n, places in where.items():
        x = np.frombuffer(b"".join(payloads[i][a : a + n] for i, a in places), np.uint8).reshape(-1, n).astype(np.int16) - 128
        made = []
        for (i, a), body in zip(places, subframes(x)):
            head = b"\xff\xf8" + bytes([0xA4 if n == 1024 else 0x74, 0x02]) + coded_number(a // BLOCK) + (b"" if n == 1024 else struct.pack(">H", n - 1))
            made.append(head + bytes([crc8(head)]) + body)
        for (i, a), frame, crc in zip(places, made, crc16(made).tolist()):
            frames[i][a] = frame + struct.pack(">H", crc)
    out = []
    for p, own in zip(payloads, frames):
        seek, at = [], 0
        for a in sorted(own):
            seek.append(struct.pack(">QQH", a, at, min(BLOCK, len(p) - a)))
            at += len(own[a])
        sizes = [len(f) for f in own.values()]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(bytes(b ^ 0x80 for b in p) if len(p) < 256 else (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        table = b"".join(seek)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own[a] for a in sorted(own)))
    return out


class Bits:
    """Reads bits of one buffer at many places at once."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data + bytes(16), np.uint8)
        n = len(raw) - 8
        self.word = np.zeros(n, np.uint64)
        for k in range(8):
            self.word |= raw[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)

    def window(self, at: np.ndarray) -> np.ndarray:
        return self.word[at >> 3] << (at & 7).view(np.uint64)

    def take(self, at: np.ndarray, width: int) -> np.ndarray:
        """Unsigned values of width bits (at most 32)."""
        return (self.window(at) >> np.uint64(64 - width)).view(np.int64) if width else np.zeros(len(at), np.int64)

    def signed(self, at: np.ndarray, width: int) -> np.ndarray:
        x = self.take(at, width)
        return x - ((x >> (width - 1) & 1) << width) if width else x

    def residual(self, at: np.ndarray, k: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rice codes with parameters k (rest: 63 - k, unsigned): values and where they end."""
        win = self.window(at)
        # leading zeros by the exponent of the upper half as a double; none set gives more than 31
        zeros = 1054 - ((win >> HALF).astype(np.float64).view(np.int64) >> 52)
        if zeros.max() < 32:
            quotient, end = zeros, at + zeros
        else:
            long = np.flatnonzero(zeros > 31)
            base, more = at.copy(), np.zeros(len(at), np.int64)
            while len(long):
                base[long] += 32
                more[long] += 32
                zeros[long] = 1054 - ((self.window(base[long]) >> HALF).astype(np.float64).view(np.int64) >> 52)
                long = long[zeros[long] > 31]
            win = self.window(base)
            quotient, end = zeros + more, base + zeros
        low = win << zeros.view(np.uint64) << ONE >> ONE >> rest
        value = quotient << k | low.view(np.int64)
        return value >> 1 ^ -(value & 1), end + k + 1


def residuals(bits: Bits, at: np.ndarray, count: np.ndarray, order: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reads the Rice-coded residuals of lanes sorted by falling count: a row for each residual, and where lanes end."""
    head = bits.take(at, 6)
    at = at + 6
    width = 4 + (head >> 4 & 1)
    part = size >> (head & 15)
    end = at.copy()
    out = np.zeros((int(count[0]), len(at)), np.int64)
    turn = np.zeros(len(at), np.int64)  # the step at which a lane's next partition begins
    k, plain, raw = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    rest = np.full(len(at), 63, np.uint64)
    active, next_turn, some_raw = len(at), 0, False
    for i in range(len(out)):
        while active and count[active - 1] <= i:
            active -= 1
            end[active] = at[active]
        at = at[:active]
        if i == next_turn:
            own = np.flatnonzero(turn[:active] == i)
            wide = width[own]
            k[own] = np.where(wide == 4, bits.take(at[own], 4), bits.take(at[own], 5))
            at[own] += wide
            raw[own] = k[own] == (1 << wide) - 1
            esc = own[raw[own]]
            plain[esc] = bits.take(at[esc], 5)
            at[esc] += 5
            k[esc] = 0
            rest[own] = (63 - k[own]).view(np.uint64)
            turn[own] = np.where(i == 0, part[own] - order[own], i + part[own])
            while (empty := own[turn[own] == i]).size:  # a first partition of warm-up samples only
                raise ValueError(f"{empty.size} empty partitions")
            next_turn, some_raw = int(turn[:active].min()), bool(raw[:active].any())
        value, after = bits.residual(at, k[:active], rest[:active])
        if some_raw:
            for w in np.unique(plain[:active][raw[:active]]).tolist():
                own = np.flatnonzero(raw[:active] & (plain[:active] == w))
                value[own] = bits.signed(at[own], w)
                after[own] = at[own] + w
        out[i, :active] = value
        at = after
    end[:active] = at
    return out, end


def decode_frames(data: bytes, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[str]]:
    """Samples of the mono frames that begin at starts (bytes), where they end, and their predictors; verifies CRCs."""
    bits = Bits(data)
    size = np.empty(len(starts), np.int64)
    depth = np.empty(len(starts), np.int64)
    body = np.empty(len(starts), np.int64)
    for i, s in enumerate(starts.tolist()):
        if data[s] != 0xFF or data[s + 1] & 0xFE != 0xF8:
            raise ValueError("no frame here")
        code, at = data[s + 2] >> 4, s + 4
        if data[s + 3] >> 4:
            raise ValueError("only one channel is decoded")
        depth[i] = (0, 8, 12, 0, 16, 20, 24, 32)[data[s + 3] >> 1 & 7]
        first = data[at]
        at += 1
        while first & 0x80 and first & 0x40:
            first = first << 1 & 0xFF
            at += 1
        if code == 6:
            size[i], at = data[at] + 1, at + 1
        elif code == 7:
            size[i], at = (data[at] << 8 | data[at + 1]) + 1, at + 2
        else:
            size[i] = 192 if code == 1 else 144 << code if code < 6 else 1 << code
        at += (0, 1, 2, 2)[max(0, (data[s + 2] & 15) - 11)] if data[s + 2] & 15 < 15 else 0
        if crc8(data[s:at]) != data[at]:
            raise ValueError("a frame header's CRC-8 differs")
        body[i] = at + 1
    kind = np.array([data[b] for b in body.tolist()], np.int64)
    if (kind & 1).any() or (depth == 0).any():
        raise ValueError("wasted bits and unknown sample sizes are not decoded")
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(starts)
    names = [""] * len(starts)
    ends = np.empty(len(starts), np.int64)
    at = body * 8 + 8
    kind >>= 1
    for n, code, wide in np.unique(np.stack([size, kind, depth], 1)[kind < 2], axis=0).tolist():
        for i in np.flatnonzero((size == n) & (kind == code) & (depth == wide)).tolist():
            places = at[i : i + 1] if code == 0 else at[i] + wide * np.arange(n)
            x = bits.signed(places, wide)
            out[i], names[i] = np.repeat(x, n) if code == 0 else x, ("constant", "verbatim")[code]
            ends[i] = (int(places[-1]) + wide + 7) // 8 + 2
    own = np.flatnonzero(kind >= 8)
    if len(own):
        order = np.where(kind & 32, kind - 31, kind & 7)
        own = own[np.argsort(order[own] - size[own], kind="stable")]
        order, n, wide, pos, lpc = order[own], size[own], depth[own], at[own], kind[own] >= 32
        most = int(order.max())
        coef = np.zeros((max(most, 1), len(own)), np.int64)
        warm = np.zeros((most, len(own)), np.int64)  # the last warm-up samples end together
        for w in np.unique(wide).tolist():
            for i in range(most):
                lanes = np.flatnonzero((wide == w) & (order > i))
                warm[most - order[lanes] + i, lanes] = bits.signed(pos[lanes] + w * i, w)
        pos = pos + wide * order
        shift = np.zeros(len(own), np.int64)
        lanes = np.flatnonzero(lpc)
        precision = bits.take(pos[lanes], 4) + 1
        shift[lanes] = bits.signed(pos[lanes] + 4, 5)
        pos[lanes] += 9
        for p in np.unique(precision).tolist():
            for j in range(most):
                some = lanes[(precision == p) & (order[lanes] > j)]
                coef[j, some] = bits.signed(pos[some] + p * j, p)
        pos[lanes] += precision * order[lanes]
        for o in range(1, min(4, most) + 1):
            coef[:o, ~lpc & (order == o)] = np.array(FIXED[o], np.int64)[:, None]
        res, stop = residuals(bits, pos, n - order, order, n)
        x = np.concatenate([warm, res])
        back = np.ascontiguousarray(coef[:most][::-1])
        counts = n - order
        active = len(own)
        for i in range(len(res) if most else 0):
            while active and counts[active - 1] <= i:
                active -= 1
            x[most + i, :active] += np.einsum("ij,ij->j", back[:, :active], x[i : i + most, :active]) >> shift[:active]
        x = np.ascontiguousarray(x.T)
        for j, i in enumerate(own.tolist()):
            out[i], names[i] = x[j, most - order[j] : most + counts[j]], "lpc" if lpc[j] else "fixed"
        ends[own] = (stop + 7) // 8 + 2
    bodies = [data[a : b - 2] for a, b in zip(starts.tolist(), ends.tolist())]
    for b, crc in zip(ends.tolist(), crc16(bodies).tolist()):
        if data[b - 2 : b] != struct.pack(">H", crc):
            raise ValueError("a frame's CRC-16 differs")
    return out, ends, names


def parse(stream: bytes) -> tuple[int, bytes, int, list[tuple[int, int, int]]]:
    """Samples, MD5, offset of the first frame, and seek points (sample, offset, samples) of a stream."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, points, total, md5 = 4, [], 0, b""
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            total, md5 = int.from_bytes(block[10:18], "big") & (1 << 36) - 1, block[18:34]
        elif kind & 127 == 3:
            points = [struct.unpack_from(">QQH", block, i) for i in range(0, size - 17, 18)]
        at += 4 + size
        if kind & 128:
            return total, md5, at, [p for p in points if p[0] != 2**64 - 1]


def decode_streams(streams: list[bytes]) -> list[tuple[np.ndarray, list[str]]]:
    """Samples and the frames' predictors of each stream; the frames of all decode together where seek points give them."""
    heads = [parse(s) for s in streams]
    data, base = b"".join(streams), np.cumsum([0, *map(len, streams)])[:-1].tolist()
    full = [sum(p[2] for p in h[3]) == h[0] for h in heads]
    starts = [b + h[2] + p[1] for b, h, ok in zip(base, heads, full) if ok for p in h[3]]
    got, _, names = decode_frames(data, np.array(starts, np.int64)) if starts else ([], None, [])
    out, at = [], 0
    for b, s, h, ok in zip(base, streams, heads, full):
        if ok:
            own, kinds = got[at : at + len(h[3])], names[at : at + len(h[3])]
            at += len(h[3])
        else:  # frame by frame
            own, kinds, place = [], [], h[2]
            while place < len(s):
                x, end, kind = decode_frames(s, np.array([place]))
                own, kinds, place = own + x, kinds + kind, int(end[0])
        x = np.concatenate(own) if own else np.zeros(0, np.int64)
        if any(h[1]) and hashlib.md5(x.astype(np.int8).tobytes()).digest() != h[1]:
            raise ValueError("a stream's MD5 differs")
        out.append((x, kinds))
    return out


def seek(stream: bytes, first: int, count: int) -> np.ndarray:
    """Samples first to first + count of a stream with a seek table; only their frames are decoded."""
    total, _, start, points = parse(stream)
    own = [p for p in points if p[0] < first + count and p[0] + p[2] > first]
    if not own:
        return np.zeros(0, np.int64)
    got, _, _ = decode_frames(stream, np.array([start + p[1] for p in own]))
    skip = first - own[0][0]
    return np.concatenate(got)[skip : skip + count]


def encode(docs: DataFrame, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the payload (text as UTF-8, or binary) as a FLAC stream."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x or b"" for x in batch.column(1).to_pylist()]
        media = encode_streams([x + bytes(-len(x) % UNIT if x else UNIT) for x in raw])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(payload_col).cast("binary").alias("payload"))

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 1, SLICE):
                yield one(part)

    return own.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def decode(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds pcm (blocks of unsigned 8-bit samples with their first sample's offset) and feature to (id, n_bytes, media)."""
    blocks = pa.list_(pa.struct([("offset", pa.int64()), ("data", pa.binary())]))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        pcm, feature = [], []
        for x, kinds in decode_streams(batch.column(2).to_pylist()):
            raw = (x + 128).astype(np.uint8).tobytes()
            pcm.append([{"offset": a, "data": raw[a : a + PCM_BLOCK]} for a in range(0, len(raw), PCM_BLOCK)])
            counts = ",".join(f"{k}={kinds.count(k)}" for k in ("constant", "verbatim", "fixed", "lpc"))
            feature.append(f"frames={len(kinds)},{counts},sum={int(x.sum())},energy={int((x * x).sum())},turns={int((np.diff(np.signbit(x + 64)) != 0).sum())}")
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pcm, blocks), pa.array(feature, pa.string())], names=["id", "n_bytes", "media", "pcm", "feature"])

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 2, SLICE):
                yield one(part)

    kind = media.schema[id_col].dataType.simpleString()
    out = media.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, media binary, pcm array<struct<offset: long, data: binary>>, feature string")
    return out.withColumnRenamed("id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    # the blocks put together at once: hexadecimal strings can be joined, binaries only in pairs
    whole = F.unhex(F.array_join(F.transform("pcm", lambda x: F.hex(x["data"])), ""))
    read = decode(encode(docs)).withColumn("payload", whole)
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_flac": op3_flac}
