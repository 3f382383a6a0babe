"""Chunking of texts."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where an oversize piece may be cut, the best first.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")


def cut(piece: str, size: int, overlap: int) -> list[str]:
    """An oversize piece cut at the best separator beyond a third of the size, neighbours overlapping."""
    out = []
    while len(piece) > size:
        at = next((i + len(s) for s in SEPARATORS if (i := piece.rfind(s, size // 3, size)) >= 0), size)
        out.append(piece[:at])
        piece = piece[max(at - overlap, 1) :]
    return [*out, piece] if piece.strip() else out


def chunk(text: str | None, size: int = 2000, overlap: int = 100) -> list[str]:
    """Paragraphs packed up to size; longer ones cut. Every character that is no blank stands in some chunk."""
    if not text or not text.strip():
        return []
    out, now = [], ""
    for part in text.split("\n\n"):
        if len(now) + len(part) + 2 <= size:
            now = f"{now}\n\n{part}" if now else part
            continue
        if now:
            out.append(now)
        now = ""
        if len(part) > size:
            *done, now = cut(part, size, overlap) or [""]
            out += done
        else:
            now = part
    return [c for c in [*out, now] if c.strip()]


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 2000, overlap: int = 100) -> DataFrame:
    """(id, seq, chunk) of each text."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk(t, size, overlap))

    return docs.select(F.col(id_col), F.posexplode(split(F.col(text_col))).alias("seq", "chunk"))


# Where a section beyond the size may end, the best first.
ENDS = (". ", ".\n", "? ", "! ", ";\n", "\n\n", "\n", " ")
_heading = re.compile(r"^#{1,6}\s+.*", re.M)
_gap = re.compile(r"\n{2,}")


def marks(text: str) -> list[tuple[int, int]]:
    """Where a text's parts begin, and where the part before ends: at Markdown headings if there are any, else at blank lines."""
    found = [(m.start(), m.start()) for m in _heading.finditer(text)]
    return found or [(m.end(), m.start()) for m in _gap.finditer(text)]


def spans(text: str, size: int = 8000, overlap: int = 800) -> list[tuple[int, int]]:
    """(begin, end) of each chunk: whole parts together up to size; what is longer is cut, with an overlap.

    Places, not copies: each chunk is a piece of the text. Parts are sections under headings, or paragraphs of a text
    without headings, whose blank lines at a chunk's ends belong to none.
    """
    starts, stops = zip(*marks(text)) if marks(text) else ((), ())
    sections, begin, overlap = [], 0, max(0, min(overlap, size - 1))
    if starts and not stops[0]:  # the text begins with a mark
        begin, starts, stops = starts[0], starts[1:], stops[1:]
    starts, stops = [*starts, len(text)], [*stops, len(text)]
    while begin < len(text):
        fits = bisect_left(stops, begin + size + 1) - 1  # the last part that still ends within size
        at = max(fits, bisect_right(starts, begin))  # one part at least
        sections.append((begin, stops[at]))
        begin = starts[at]
    out = []
    for a, b in sections:
        while b - a > size:
            ends = (text.rfind(s, a, a + size) + len(s) - a for s in ENDS if text.rfind(s, a, a + size) - a > size // 3)
            cut_at = next(ends, size)
            out.append((a, a + cut_at))
            a = max(a + 1, a + cut_at - overlap)
        if b > a:
            out.append((a, b))
    return out


def placed_spans(texts: pa.Array, size: int, overlap: int) -> pa.Array:
    """The spans of each text as a list of (begin, end). One text at a time is a string; what is found stays in flat arrays."""
    offsets, begins, ends = array("i", [0]), array("i"), array("i")
    for t in texts:
        for a, b in spans(t.as_py() or "", size, overlap):
            begins.append(a)
            ends.append(b)
        offsets.append(len(begins))
    of = lambda x: pa.array(np.frombuffer(x, np.int32) if x else [], pa.int32())
    return pa.ListArray.from_arrays(of(offsets), pa.StructArray.from_arrays([of(begins), of(ends)], ["begin", "end"]))


def spread(docs: DataFrame, id_col: str, text_col: str, size: int = 8000, overlap: int = 800) -> DataFrame:
    """(id, seq, begin, chunk) of each text's spans; a null or empty text has none.

    Runs of blank lines count as one, in texts without headings.
    """

    @F.arrow_udf("array<struct<begin:int,end:int>>")
    def places(texts: pa.Array) -> pa.Array:
        return placed_spans(texts, size, overlap)

    own = F.col(text_col)
    even = F.when(own.rlike(r"(?m)^#{1,6}\s+"), own).otherwise(F.regexp_replace(own, r"\n{2,}", "\n\n"))
    placed = docs.select(F.col(id_col), even.alias("even_")).withColumn("places_", places("even_"))
    return placed.select(id_col, "even_", F.posexplode("places_").alias("seq", "p")).select(id_col, "seq", F.col("p.begin").alias("begin"), F.substring("even_", F.col("p.begin") + 1, F.col("p.end") - F.col("p.begin")).alias("chunk"))
