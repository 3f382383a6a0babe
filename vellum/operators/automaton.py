"""Many words looked up in a text in one pass: an Aho-Corasick automaton over Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

HIT = StructType([StructField("list", StringType()), StructField("word", StringType()), StructField("n", IntegerType()), StructField("whole", IntegerType()), StructField("first", IntegerType())])
Lists = tuple[tuple[str, tuple[str, ...]], ...]


@lru_cache(maxsize=16)
def machine(lists: Lists) -> tuple:
    """The automaton of all words, and for each (list, word) the number of its word; one for each Python worker."""
    words = list(dict.fromkeys(w for _, own in lists for w in own))
    number = {w: i for i, w in enumerate(words)}
    automaton = ahocorasick.Automaton()
    for w, i in number.items():
        automaton.add_word(w, (i, len(w)))
    automaton.make_automaton()
    return automaton, [(name, w, number[w]) for name, own in lists for w in dict.fromkeys(own)]


def _inner(c: str) -> bool:
    return c.isalnum() or c == "_"


def hits(text: str, lists: Lists) -> list[tuple[str, str, int, int, int]]:
    """(list, word, n, whole, first) for each word that occurs, in the order of lists.

    n counts occurrences that do not overlap, whole those with no letter, digit or _ on either side; first is a place.
    """
    automaton, owners = machine(lists)
    found: dict[int, list[int]] = {}
    for end, (i, size) in automaton.iter(text):
        start = end + 1 - size
        own = found.setdefault(i, [0, 0, start, 0])  # n, whole, first, end of the last one counted
        if start >= own[3]:
            own[0] += 1
            own[3] = end + 1
        own[1] += not (start and _inner(text[start - 1])) and not (end + 1 < len(text) and _inner(text[end + 1]))
    return [(name, w, *found[i][:3]) for name, w, i in owners if i in found] if found else []


def scan(text: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    """Which words of which lists occur in a text: array of (list, word, n, whole, first). A null text holds none.

    One pass over a text finds all words of all lists, whatever their number. Case counts: lower both where it should not.
    """
    fixed: Lists = tuple((name, tuple(w for w in own if w)) for name, own in lists.items())

    @F.arrow_udf(ArrayType(HIT))
    def run(texts: pa.Array) -> pa.Array:
        rows = [hits(t, fixed) if t else [] for t in texts.to_pylist()] if any(own for _, own in fixed) else [[] for _ in texts]
        offsets = np.cumsum([0, *map(len, rows)])
        columns = list(zip(*(r for row in rows for r in row))) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], fields=[pa.field(f.name, k) for f, k in zip(HIT, kinds)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return run(text)


def of(found: Column, name: str, within: int | None = None) -> Column:
    """The hits of one list, those that end within so many characters of the beginning."""
    end = lambda h: h["first"] + F.length(h["word"])
    return F.filter(found, lambda h: (h["list"] == name) & ((end(h) <= within) if within is not None else F.lit(True)))


def any_of(found: Column, name: str, within: int | None = None) -> Column:
    return F.size(of(found, name, within)) > 0
