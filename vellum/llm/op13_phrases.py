"""Collocations: phrases whose words meet more often than their frequencies alone would have them meet.

Each word occurrence stands with the words that follow it in its piece, as lead columns w1 to wN, padded with nulls at
the piece's end. Only these longest windows are counted. ROLLUP over (lang, w1, ..., wN) then sums them to the counts
of every shorter prefix, so single words, pairs and the words of a language come out of one table of windows: no
separate explosion for each length.

Windows are made from word codes in Arrow batches and counted there first, in the order of their words, so that
neighbours are alike where Spark shuffles them and its sorts meet sorted runs. They meet by their leading words, all but the last, as one column (head), so
the sums of whole heads need no further shuffle, and rare ones join their shorter prefix before ROLLUP. The last words of
a head that very many windows have (at most HOT, found in a sample; which ones they are changes no result) are dealt to
several tasks. A phrase's parts occur at least as often as the phrase, so counts under the least one are dropped and what
remains is looked up by joins; parts that very many phrases share stay in place (common.spread_join). Products of counts
are decimals of 38 digits, exact up to counts of 10^16.

Defined results: null texts are empty; empty texts, and texts without words, count nothing; a null language is "und", and
rows of the language "und" are counted with it; repeated rows count again; ties are ordered by the phrase's bytes; an
empty table gives no rows; other columns are ignored. Texts longer than BUFFER bytes are taken in stretches that end at
a mark, so memory grows with the longest stretch without one, not with the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Characters whose windows are counted together, and rows in a batch handed back. What a buffer takes counts for each
#: core of an executor, beside the JVM: codes of about 100 bytes a word, and strings of ROWS windows.
BUFFER, ROWS = 3 << 20, 1 << 16
#: Heads with more than a HOT-th of the windows of about SAMPLE documents have their last words dealt to DEALT tasks.
HOT, SAMPLE, DEALT = 512, 1_000, 64
#: Pieces end at these; one of them stands for all, since no word holds it.
MARKS, MARK = r"[.,;:!?\x0A-\x0D]", "."
_end = re.compile(MARKS)


def stretches(text: str, size: int = BUFFER) -> Iterator[str]:
    """The text in parts of at least size characters (but for the last), each ending before a mark."""
    start = 0
    while len(text) - start > size and (found := _end.search(text, start + size)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def window_batches(langs: pa.Array, texts: pa.Array, longest: int, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """(window, n): the distinct windows of texts, in order, and how often each occurs, so many rows at a time.

    A window is its head, a tab and its last word. The head holds the other words and the language, joined by spaces;
    pads are empty words. Windows are numbers until their batch is handed back.
    """
    marked = pc.replace_substring_regex(pc.ascii_lower(texts), MARKS, f" {MARK} ")
    ended = pc.binary_join_element_wise(pc.replace_substring(marked, "\t", " "), MARK, " ")
    lists = pc.split_pattern(ended, " ")
    sizes = np.diff(np.asarray(lists.offsets))
    tokens = lists.flatten().dictionary_encode()
    del marked, ended, lists
    by_bytes = pc.sort_indices(tokens.dictionary)
    words = tokens.dictionary.take(by_bytes)
    place = np.empty(len(words), np.int32)
    place[by_bytes.to_numpy()] = np.arange(len(words), dtype=np.int32)
    code = place[tokens.indices.to_numpy(zero_copy_only=False)]
    lang = langs.dictionary_encode()
    lang_code = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int32), sizes)
    del tokens
    kept = code != pc.index(words, "").as_py()
    code, lang_code = code[kept], lang_code[kept]
    pad = pc.index(words, MARK).as_py()
    starts = np.flatnonzero(code != pad)
    padded = np.concatenate([code, np.full(longest, pad, np.int32)])
    columns, lang_code = [code[starts]], lang_code[starts]
    for j in range(1, longest):
        columns.append(np.where(columns[-1] == pad, np.int32(pad), padded[starts + j]))  # nothing follows a piece's end
    del code, kept, padded
    key, size = np.zeros(len(starts), np.int64), 1
    for column, wide in [*((c, len(words)) for c in columns[:-1]), (lang_code, len(lang.dictionary)), (columns[-1], len(words))]:
        if size * wide >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            size = len(distinct)
        key, size = key * wide + column, size * wide
    order = np.argsort(key)
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    at, n = order[first], np.diff(first, append=len(order))
    del key, order, first, starts
    empty = pc.if_else(pc.equal(words, MARK), "", words)
    for i in range(0, len(at), rows):
        own = at[i : i + rows]
        lead = [empty.take(pa.array(c[own])) for c in columns]
        head = pc.binary_join_element_wise(*lead[:-1], lang.dictionary.take(pa.array(lang_code[own])), " ")
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(head, lead[-1], "\t"), pa.array(n[i : i + rows])], names=["window", "n"])


def lead_windows(langs: pa.Array, texts: pa.Array, longest: int) -> pa.RecordBatch:
    """All of window_batches in one."""
    columns = list(zip(*(b.columns for b in window_batches(langs, texts, longest))))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns] or [pa.array([], pa.string()), pa.array([], pa.int64())], names=["window", "n"])


def windows(docs: DataFrame, longest: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(window, n): padded longest windows, counted by buffers of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: list[str] = []
        texts: list[str] = []
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            yield from window_batches(pa.array(langs, pa.string()), pa.array(texts, pa.string()), longest, ROWS)
            pa.default_memory_pool().release_unused()  # else the worker keeps its largest buffer while the JVM sorts

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                for part in stretches(text.as_py()):
                    langs.append(lang.as_py())
                    texts.append(part)
                    held += len(part)
                    if held >= BUFFER:
                        yield from counted()
                        langs, texts, held = [], [], 0
        if texts:
            yield from counted()

    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    return own.mapInArrow(run, "window string, n long")


def _head() -> F.Column:
    return F.substring_index("window", "\t", 1)


def hot_heads(docs: DataFrame, longest: int, **columns: str) -> list[str]:
    """At most HOT heads: those with more than a HOT-th of a sample's windows."""
    part = docs.sample(min(1.0, SAMPLE / max(docs.count(), 1)), seed=13)
    sums = windows(part, longest, **columns).rollup(_head().alias("head")).agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(HOT + 1)
    most = sums.collect()
    return [r["head"] for r in most if r["head"] is not None and r["n"] * HOT > most[0]["n"]]


def _changes(column: pa.Array) -> np.ndarray:
    """Where a column without nulls differs from the row before; true in the first row."""
    return np.concatenate([[True], pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)])


class Prefixes:
    """One pass over windows in order: what each adds to its prefixes.

    A window that occurs least times keeps all its words. The others of a head add up without their last word; where all
    windows of a head are too few, and none is dealt elsewhere, without the head's last word too. Between batches only
    the open window and two sums of the open head are kept.
    """

    def __init__(self, longest: int, least: int, hot: list[str]):
        self.longest, self.least, self.hot = longest, least, pa.array(hot, pa.string())
        self.open: pa.RecordBatch | None = None
        self.total = self.rest = 0

    def __call__(self, batch: pa.RecordBatch | None) -> pa.RecordBatch:
        """The rows closed by a batch, or by the end (None)."""
        final, n_lead = batch is None, self.longest - 1
        parts = [b for b in (self.open, batch) if b is not None]
        window, n = (pa.concat_arrays([p.column(i) for p in parts]) for i in range(2))
        at = np.flatnonzero(_changes(window))
        window, n = window.take(pa.array(at)), np.add.reduceat(n.to_numpy(), at)
        apart = pc.split_pattern(window, "\t", max_splits=1)
        head, last = pc.list_element(apart, 0), pc.list_element(apart, 1)
        new_head = _changes(head)
        of, heads = np.cumsum(new_head) - 1, np.flatnonzero(new_head)
        closed = len(n) if final else len(n) - 1
        often = (n >= self.least) & pc.not_equal(last, "").to_numpy(zero_copy_only=False)
        total, rest = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        np.add.at(total, of[:closed], n[:closed])
        np.add.at(rest, of[:closed], np.where(often, 0, n)[:closed])
        total[0] += self.total
        rest[0] += self.rest
        if not final:
            self.open = pa.RecordBatch.from_arrays([window[-1:], pa.array(n[-1:])], names=["window", "n"])
            self.total, self.rest = int(total[-1]), int(rest[-1])
        whole = np.flatnonzero(often[:closed])
        ended = np.flatnonzero(rest[: len(heads) if final else -1])
        rows = head.take(pa.array(np.concatenate([whole, heads[ended]])))
        few = np.concatenate([np.zeros(len(whole), bool), total[ended] < self.least]) & ~pc.is_in(rows, self.hot).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(rows, " ", max_splits=n_lead)
        lead = [pc.list_element(split, j) for j in range(self.longest)]
        lead[n_lead - 1] = pc.if_else(pa.array(few), "", lead[n_lead - 1])
        after = pa.concat_arrays([last.take(pa.array(whole)), pa.nulls(len(ended), pa.string())])
        columns = [lead[n_lead], *lead[:n_lead], after, pa.array(np.concatenate([n[whole], rest[ended]]))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", *(f"w{j + 1}" for j in range(self.longest)), "n"])


def prefix_counts(docs: DataFrame, longest: int, least: int, **columns: str) -> DataFrame:
    """(lang, words, f): every phrase of 1 to longest words with f >= least, and each language's total with no words."""
    names = [f"w{j + 1}" for j in range(longest)]
    hot = hot_heads(docs, longest, **columns)
    dealt = F.when(_head().isin(hot), F.pmod(F.hash("window"), F.lit(DEALT))) if hot else F.lit(None)
    met = windows(docs, longest, **columns).repartition(_head(), dealt).sortWithinPartitions("window")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = Prefixes(longest, least, hot)
        for batch in batches:
            if batch.num_rows:
                yield prefixes(batch)
        if prefixes.open is not None:
            yield prefixes(None)

    top = met.mapInArrow(summed, f"lang string, {', '.join(f'{name} string' for name in names)}, n long")
    sums = top.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("level")).where(f"level < {2**longest}")
    sums = sums.where(f"level > 0 or {names[-1]} is not null").where(f"f >= {least} or level = {2**longest - 1}")
    for j, name in enumerate(reversed(names[:-1])):
        sums = sums.where(f"level <> {2 ** (j + 1) - 1} or {name} <> ''")  # pads, and words of rare heads
    return sums.where("lang is not null").select("lang", F.array_compact(F.array(*names)).alias("words"), "f")


def _joined(words) -> F.Column:
    return F.array_join(words, " ")


def _look_up(rows: DataFrame, counts: DataFrame, part: str, name: str, total: int) -> DataFrame:
    """rows with the count, as name, of the phrase in their column part; parts of very many rows stay in place."""
    met = rows.groupBy("lang", part).agg(F.count("*").alias("n"))
    lookup = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).join(met, ["lang", part])
    return common.spread_join(rows, lookup, ["lang", part], total)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to longest words.

    least: occurrences that a candidate needs; share: a candidate goes if a longer candidate around it has so many per
    cent of its occurrences; top: rows for each language. The result reads the table of counts, which stays.
    """
    counts = prefix_counts(docs, longest, least, lang_col=lang_col, text_col=text_col)
    with common.small_batches(docs.sparkSession):
        counts = common.materialize(counts.withColumn("phrase", _joined("words")), "phrases")
    phrases = counts.where("size(words) > 1")
    cut = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _joined(F.slice("words", 1, F.col("k"))).alias("left"), _joined(F.slice("words", F.col("k") + 1, F.size("words"))).alias("right"))
    singles = counts.where("size(words) > 0")
    total = (longest - 1) * counts.count()
    cut = _look_up(_look_up(cut, singles, "left", "l", total), singles, "right", "r", total)
    exact = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cut.withColumn("score", exact).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))

    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _joined(F.slice("words", i, m)))))
    around = phrases.where("size(words) > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share} * a")
    ranked = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(DEALT))  # a language's best are among the best of its parts
    near = ranked.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(f"rank <= {top}")
    first = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {top}")
    words_of = counts.where("size(words) = 0").select("lang", F.col("f").alias("n"))
    return first.join(words_of, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


QUERIES = {"op13_phrases": op13_phrases}

ORACLE_SQL = {
    "op13_phrases": r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents WHERE text IS NOT NULL),
    lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
    spots AS (
      SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS words
      FROM lists, (VALUES (1), (2), (3)) AS sizes(m)),
    counted AS MATERIALIZED (SELECT lang, m, words, array_to_string(words, ' ') AS phrase, count(*) AS f FROM spots GROUP BY 1, 2, 3),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY 1),
    candidates AS (SELECT * FROM counted WHERE m > 1 AND f >= 10),
    parts AS MATERIALIZED (
      SELECT lang, phrase, f AS a, k, array_to_string(words[1:k], ' ') AS lhs, array_to_string(words[k + 1:m], ' ') AS rhs
      FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
    cuts AS (
      SELECT p.lang, p.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM parts p JOIN counted x ON x.lang = p.lang AND x.phrase = lhs JOIN counted y ON y.lang = p.lang AND y.phrase = rhs),
    best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut_rank FROM cuts),
    around AS (
      SELECT lang, phrase, max(f) AS longer FROM (
        SELECT lang, array_to_string(words[1:2], ' ') AS phrase, f FROM candidates WHERE m = 3
        UNION ALL SELECT lang, array_to_string(words[2:3], ' '), f FROM candidates WHERE m = 3) GROUP BY 1, 2),
    ranked AS (
      SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
      FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
      WHERE cut_rank = 1 AND (longer IS NULL OR 100 * longer < 50 * a))
    SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
    """
}
