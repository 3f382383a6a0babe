"""Where quotes stand in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators import automaton

#: Quotes of so many characters together, 16 more for each, are found by one automaton in each task.
FIT = 1 << 20
#: Words of a key.
KEY = 4


#: As many keys of quotes are looked up in place; more meet the texts' keys in a join.
MOST_KEYS = 4096
#: Characters of a key of a short quote, at most.
GRAM = 8


def runs(units: Column, n: int) -> Column:
    """Hashes of all runs of n units.

    Shifted copies of the units are zipped, so each row splits its text a few times and not once a unit.
    """
    shifted = [F.slice(units, i + 1, F.size(units)).alias(f"w{i}") for i in range(n)]
    found = F.transform(F.arrays_zip(*shifted), lambda x: F.xxhash64(*[x[f"w{i}"] for i in range(n)]))
    return F.array_distinct(F.slice(found, F.lit(1), F.greatest(F.size(units) - (n - 1), F.lit(0))))


def keys(text: Column) -> Column:
    """Hashes of all runs of KEY words between single spaces."""
    return runs(F.split(text, " "), KEY)


def short_pairs(docs: DataFrame, short: DataFrame, out: DataFrame) -> DataFrame:
    """out and (doc_id, item_id, quote) where a text holds the first GRAM characters of a quote, or all of a shorter one."""
    size = F.least(F.length("quote"), F.lit(GRAM))
    for (n,) in sorted(short.select(size).distinct().collect()):  # at most GRAM + 1 rows
        key = F.xxhash64(*[F.substring("quote", i + 1, 1) for i in range(n)]) if n else F.length("quote").cast("long")
        grams = runs(F.split("text", ""), n) if n else F.array(F.lit(0).cast("long"))
        found = docs.where("text is not null").select("doc_id", F.explode(grams).alias("key"))
        out = out.unionAll(found.join(short.where(size == n).select("item_id", "quote", key.alias("key")), "key").select("doc_id", "item_id", "quote"))
    return out


def in_place(docs: DataFrame, quotes: DataFrame) -> DataFrame | None:
    """contained() by one pass of an automaton over each text, where quotes fit: only hits leave a text. Else null."""
    rows = quotes.where("quote is not null").select("quote").distinct()
    size = rows.agg(F.sum(F.length("quote") + 16)).first()[0] or 0
    if size > FIT:
        return None
    words = tuple(sorted(r["quote"] for r in rows.collect()))  # at most FIT characters
    found = docs.where("text is not null").select("doc_id", F.explode(automaton.scan(F.col("text"), {"": words})).alias("h"))
    found = found.select("doc_id", F.col("h.word").alias("quote"), F.col("h.first").alias("at"))
    if "" in words:  # stands at the beginning of every text
        found = found.unionAll(docs.where("text is not null").select("doc_id", F.lit("").alias("quote"), F.lit(0).alias("at")))
    asked = quotes.select("item_id", "quote")
    return found.join(asked, "quote").select("doc_id", "item_id", F.col("at").cast("long").alias("start_char"), (F.col("at") + F.length("quote")).cast("long").alias("end_char"))


def contained(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_char, end_char) of docs (doc_id, text) and quotes (item_id, quote): first verbatim places.

    Quotes that fit an automaton are found by it (in_place); the same rows come of any number of quotes as follows.
    A quote's second to fifth words are whole words of any text that holds it, so an equi-join on runs of words finds
    the candidates, and the whole quote is compared in those texts only. Quotes of fewer than six words have no such
    run; where there are any, runs of characters find theirs.
    """
    if (found := in_place(docs, quotes)) is not None:
        return found
    words = F.split("quote", " ")
    keyed = quotes.where(F.size(words) >= KEY + 2).select("item_id", "quote", F.xxhash64(*[F.get(words, F.lit(i + 1)) for i in range(KEY)]).alias("key"))
    few = [r["key"] for r in keyed.select("key").distinct().limit(MOST_KEYS + 1).collect()]
    own = keys(F.col("text"))
    if len(few) <= MOST_KEYS:  # only runs that some quote has leave the text
        own = F.array_intersect(own, F.lit(few) if few else F.array().cast("array<bigint>"))
    pairs = docs.select("doc_id", F.explode(own).alias("key")).join(keyed, "key").select("doc_id", "item_id", "quote")
    pairs = short_pairs(docs, quotes.where(F.size(words) < KEY + 2).where("quote is not null"), pairs)
    at = docs.select("doc_id", "text").join(pairs, "doc_id").withColumn("at", F.expr("instr(text, quote)")).where("at > 0")
    return at.select("doc_id", "item_id", (F.col("at") - 1).cast("long").alias("start_char"), (F.col("at") - 1 + F.length("quote")).cast("long").alias("end_char"))


def flexible(quote: Column) -> Column:
    """A pattern of a quote that lets white space, quotation marks and dashes differ."""
    escaped = F.regexp_replace(F.trim(quote), r"([\\.+*?()\[\]{}|^$])", r"\\$1")
    marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped, "['‘’`]", "['‘’`]"), "[\"“”]", "[\"“”]"), "[-–—]", "[-–—]")
    return F.regexp_replace(marks, r"\s+", r"\\s+")


def offsets(text: Column, quote: Column) -> Column:
    """(start, end, verified) of a quote in a text: verbatim, else tolerant, else nulls and not verified."""
    at = F.call_function("instr", text, quote)
    found = F.call_function("regexp_substr", text, flexible(quote))
    tolerant = F.call_function("instr", text, found)
    start = F.when(at > 0, at - 1).when(tolerant > 0, tolerant - 1)
    size = F.when(at > 0, F.length(quote)).when(tolerant > 0, F.length(found))
    return F.struct(start.cast("long").alias("start"), (start + size).cast("long").alias("end"), start.isNotNull().alias("verified"))
