"""Queries of keys, quote locations, logs, dashboards and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import url
from vellum.operators import keys, logs, quotes
from vellum.sources.bindings import JOBS, jobs
from vellum.sources.tables import read

from .registry import Registry
from .storage import CANON, HOST, PATH

register = Registry()
QUERIES, ORACLE_SQL = register.queries, register.oracles

NAMES = ("E-Mail", " GPS  location", "credit card", "telephone numbers", "hobby", "Clickstream", "user names", "shoe size")


@register("SELECT l_orderkey, l_linenumber, l_partkey, ['email', 'location', 'payment data', 'phone number', 'hobby', 'usage data', 'username', 'shoe size'][CAST(l_partkey % 8 AS INTEGER) + 1] AS key FROM lineitem")
def cls13_filed_names(spark, sf_dir):
    """Names filed exactly, under a close spelling, or as they are."""
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("l_partkey") % 8).cast("int"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", name.alias("name"))
    return keys.with_keys(rows, "name").select("l_orderkey", "l_linenumber", "l_partkey", "key")


WORDS = "array_to_string(string_split(text, ' ')[4:9], ' ')"


#: A quote of double spaces, and the pattern in which its white space, quotation marks and dashes may differ.
SPACED = f"CASE WHEN regexp_matches({WORDS}, '\\S') THEN regexp_replace({WORDS}, '\\s+', '  ', 'g') END"
MARKS = ("['‘’`]", "[\"“”]", "[-–—]")
LOOSE = r"regexp_replace(trim(q), '([\\.+*?()\[\]{}|^$])', '\\\1', 'g')"
for m in MARKS:
    LOOSE = "regexp_replace({}, '{}', '{}', 'g')".format(LOOSE, *[m.replace("'", "''")] * 2)
LOOSE = rf"regexp_replace({LOOSE}, '\s+', '\\s+', 'g')"


@register(f"""SELECT doc_id, pos - 1 AS start, pos - 1 + length(f) AS "end", pos IS NOT NULL AS verified FROM (SELECT doc_id, f, CASE WHEN f <> '' THEN instr(text, f) END AS pos FROM (SELECT doc_id, text, CASE WHEN contains(text, q) THEN q ELSE regexp_extract(text, {LOOSE}) END AS f FROM (SELECT doc_id, text, {SPACED} AS q FROM documents)))""")
def txt7_tolerant_quotes(spark, sf_dir):
    """The fourth to ninth words of every document, quoted with other white space and found again; nulls where it has none."""
    return txt7_tolerant_quotes_all(spark, sf_dir)


@register()
def txt7_tolerant_quotes_all(spark, sf_dir):
    """The fourth to ninth words of every document, whatever white space is between them; nulls where it has none."""
    quote = F.array_join(F.slice(F.split("text", " "), 4, 6), " ")
    spaced = F.when(quote.rlike(r"\S"), F.regexp_replace(quote, r"\s+", "  "))
    at = quotes.offsets(F.col("text"), spaced)
    return read(spark, sf_dir, "documents").select("doc_id", at.alias("at")).select("doc_id", "at.start", "at.end", "at.verified")


@register("SELECT user_id, count(v) AS samples, max(v) AS most, arg_max(v, event_id) FILTER (v IS NOT NULL) AS latest, bool_or(oom) AS oom FROM (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN round(value, 1) END AS v, event_type = 'error' AS oom FROM events) GROUP BY user_id")
def top12_log_signals(spark, sf_dir):
    line = F.when(F.col("event_type") == "error", F.lit("worker killed")).otherwise(F.concat(F.lit("memory: process "), F.round("value", 1).cast("string"), F.lit("MB")))
    lines = read(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line"))
    return logs.memory_signals(lines, "user_id", "event_id", "line", r"process ([0-9.]+)MB")


@register("SELECT source, count(*) AS documents, count(DISTINCT lang) AS langs, min(doc_id) AS first FROM documents GROUP BY source ORDER BY lower(source) LIMIT 15")
def top13_dashboard_list(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("langs"), F.min("doc_id").alias("first"))
    return d.orderBy(F.lower("source")).limit(15)


@register(f"SELECT page_id, {CANON} AS canonical, len(list_filter(string_split({PATH}, '/'), lambda s: lower(s) IN ('en', 'de', 'fr', 'es'))) > 0 AS had_signal FROM pages")
def url3_locale_key(spark, sf_dir):
    key = url.locale_key(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", key.canonical.alias("canonical"), key.had_signal.alias("had_signal"))


@register(f"SELECT page_id, string_split(lower({HOST}), '.')[-2] AS slug FROM pages WHERE length({PATH}) > 1")
def url8_domain_slugs(spark, sf_dir):
    return read(spark, sf_dir, "pages").where(F.length(url.path(F.col("url"))) > 1).select("page_id", url.domain_slug(F.col("url")).alias("slug"))


@register("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def dat4_month_keys(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@register("SELECT o_orderkey, c_name AS product, o_orderdate AS changed_at FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def jon14_change_log(spark, sf_dir):
    """JON-14 and SRT-3: the latest changes with their product's name."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("changed_at"))
    last = o.orderBy(F.desc("changed_at"), F.desc("o_orderkey")).limit(50)
    return last.join(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "left").select("o_orderkey", F.col("c_name").alias("product"), "changed_at")


@register(
    f"""WITH {JOBS}, f AS (SELECT product_slug, max_by(struct_pack(id := id, error := error), updated_at * 1) AS j FROM (SELECT product_slug, id, error, epoch_us(updated_at) * 1000 + id % 1000 AS updated_at FROM jobs WHERE status = 'failed') GROUP BY product_slug)
    SELECT product_slug, j.id AS id, j.error AS error FROM f"""
)
def top5_last_failures(spark, sf_dir):
    """The most recent failed job of each product, with its error."""
    order = F.unix_micros(F.col("updated_at").cast("timestamp")) * 1000 + F.col("id") % 1000
    last = jobs(spark, sf_dir).where("status = 'failed'").groupBy("product_slug").agg(F.max_by(F.struct("id", "error"), order).alias("j"))
    return last.select("product_slug", "j.id", "j.error")


@register("SELECT l_orderkey, l_partkey, CAST(place AS INTEGER) AS place FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) WHERE place <= 3")
def jon18_fallback_citations(spark, sf_dir):
    """Up to three citations from the fields of topics that have none of their own."""
    from pyspark.sql import Window as W

    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    bare = li.join(li.where("l_returnflag = 'R'").select("l_orderkey"), "l_orderkey", "left_anti")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return bare.withColumn("place", F.row_number().over(order)).where("place <= 3").select("l_orderkey", "l_partkey", "place")
