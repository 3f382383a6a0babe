"""Word shingles of whole texts as 64-bit hashes, and fast similarity sketches of them."""

from __future__ import annotations

import numpy as np

#: Words are runs of other bytes than these.
SPACES = b" \t\n\v\f\r"
WORDS = 5
COORDINATES = 256

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_byte = stream(11, 256)
_byte[_space] = 0
_place = stream(22, WORDS) | np.uint64(1)


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin (one more at the end).

    A-Z become lower case; a text of fewer than five words is one shingle, one without words none.
    """
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    space = _space[data]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    bounds = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    at = np.searchsorted(first, bounds)  # the words of each text
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = np.cumsum(np.bincount(first, minlength=len(data))[: len(data)]) - 1
    place = np.arange(len(data)) - first[np.maximum(word, 0)]
    place[: first[0]] = 0
    weight = stream(33, int(place.max()) + 1) | np.uint64(1)
    hashed = mix(np.add.reduceat(_byte[_lower[data]] * weight[place], first))
    count = np.diff(at)
    made = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(made)])
    padded = np.concatenate([hashed, np.zeros(WORDS, np.uint64)])
    base = np.arange(out_at[-1]) - np.repeat(out_at[:-1], made) + np.repeat(at[:-1], made)
    size = np.repeat(np.minimum(count, WORDS), made)
    total = size.astype(np.uint64)
    for j in range(WORDS):
        total += np.where(size > j, padded[base + j] * _place[j], np.uint64(0))
    flat = mix(total)
    for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist()):
        flat[a:b].sort()
    owner = np.repeat(np.arange(len(texts)), made)
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))])


def sketches(flat: np.ndarray, starts: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches: a row of coordinates (a power of two) for each non-empty set, zeros for an empty one.

    In round i < t every element of a set falls into one hashed bin, in round t + b all fall into bin b; a bin keeps
    the smallest (round, hash). Sets whose bins are all filled leave, so big sets take about one round, and after 2t
    rounds every bin is filled. Two sets agree in a coordinate with the probability of their similarity.
    """
    n, t = len(starts) - 1, coordinates
    out = np.full(n * t, np.uint64(2**64 - 1))
    owner = np.repeat(np.arange(n), np.diff(starts))
    seeds = stream(44, 2 * t)
    x = flat
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x ^ seeds[i])
        at = owner * t + ((h & np.uint64(t - 1)).astype(np.int64) if i < t else i - t)
        np.minimum.at(out, at, (h >> np.uint64(10)) | np.uint64(i) << np.uint64(54))
        if i < 4 or i % 4 == 0 or i >= t:
            own = np.unique(owner)
            open_ = np.zeros(n, bool)
            open_[own] = (out.reshape(n, t)[own] == np.uint64(2**64 - 1)).any(1)
            left = open_[owner]
            x, owner = x[left], owner[left]
    out = out.reshape(n, t)
    out[np.diff(starts) == 0] = 0
    return out


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each full band of rows coordinates."""
    n = sketch.shape[1] // rows
    key = np.tile(stream(55, n), (len(sketch), 1))
    for j in range(rows):
        key = mix(key ^ sketch[:, j : n * rows : rows])
    return key


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
