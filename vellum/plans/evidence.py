"""Queries over extractions, evidence, classification and providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import coerce, text
from vellum.operators import chunks, classify, evidence, findings, providers, rollup
from vellum.sources.bindings import FINDINGS
from vellum.sources.bindings import findings as finding_rows
from vellum.sources.tables import read

from .registry import Registry

register = Registry()
QUERIES, ORACLE_SQL = register.queries, register.oracles


def extractions(spark, sf_dir):
    """An order's line items as one document's extraction: odd lines name data, even ones recipients, and so on."""
    li = read(spark, sf_dir, "lineitem").withColumn("d", F.col("l_linenumber"))
    line = lambda cond, x: F.array_sort(F.collect_list(F.when(cond, x)))
    n = F.col("l_linenumber")
    data = F.struct(n, F.concat(F.lit("Data "), (F.col("l_partkey") % 9).cast("string")).alias("data_type"))
    party = F.struct(n, F.concat(F.lit("Party "), (F.col("l_suppkey") % 7).cast("string")).alias("recipient"))
    keep = F.struct(n, F.concat(F.lit("scope "), (F.col("l_partkey") % 3).cast("string")).alias("data_scope"), F.concat((F.col("l_quantity").cast("int")).cast("string"), F.lit(" days")).alias("duration"))
    risk = F.struct(n, F.when(F.col("l_returnflag") == "A", "").otherwise(F.concat(F.lit("Risk "), F.col("l_returnflag"))).alias("value"), F.when(F.col("l_linestatus") == "F", "standard").otherwise("material").alias("materiality"))
    rights = F.struct(F.when(F.max("l_quantity") > 45, "yes").when(F.max("l_quantity") > 30, "no").otherwise("unclear").alias("data_sale"), F.lit("unclear").alias("cookies"), F.lit(None).cast("string").alias("ai_training_on_user_data"), F.lit("unclear").alias("breach_notification"), F.lit("unclear").alias("children_data_collection"))
    return li.groupBy(F.col("l_orderkey").alias("document_id")).agg(
        (F.min("l_suppkey") % 10).alias("product_id"), line(n % 4 == 1, data).alias("data_collected"), line(n % 4 == 2, party).alias("third_party_details"), line(n % 4 == 3, keep).alias("retention_policies"), line(n % 4 == 0, risk).alias("dangers"), rights.alias("privacy_signals"))


EXTRACTED = """
own AS (SELECT l_orderkey AS document_id, min(l_suppkey) % 10 AS product_id, CASE WHEN max(l_quantity) > 45 THEN 'yes' WHEN max(l_quantity) > 30 THEN 'no' END AS sale FROM lineitem GROUP BY l_orderkey),
found AS (
  SELECT l_orderkey AS document_id, 'data_collection' AS category, 'Data ' || CAST(l_partkey % 9 AS VARCHAR) AS value, lower('Data ' || CAST(l_partkey % 9 AS VARCHAR)) AS normalized_value FROM lineitem WHERE l_linenumber % 4 = 1
  UNION ALL SELECT l_orderkey, 'data_sharing', 'Party ' || CAST(l_suppkey % 7 AS VARCHAR), lower('Party ' || CAST(l_suppkey % 7 AS VARCHAR)) FROM lineitem WHERE l_linenumber % 4 = 2
  UNION ALL SELECT l_orderkey, 'retention', 'scope ' || CAST(l_partkey % 3 AS VARCHAR) || ': ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' days', 'scope ' || CAST(l_partkey % 3 AS VARCHAR) FROM lineitem WHERE l_linenumber % 4 = 3
  UNION ALL SELECT l_orderkey, 'dangers', 'Risk ' || l_returnflag, lower('Risk ' || l_returnflag) FROM lineitem WHERE l_linenumber % 4 = 0 AND l_returnflag <> 'A' AND l_linestatus <> 'F'
  UNION ALL SELECT document_id, 'data_sale', 'data_sale: ' || sale, 'data_sale:' || sale FROM own WHERE sale IS NOT NULL
)"""


@register(f"WITH {EXTRACTED} SELECT product_id, f.document_id, category, value, normalized_value FROM found f JOIN own USING (document_id)")
def fnd_all_findings(spark, sf_dir):
    """FND-1, 2, 4, 12, 15 and SET-4: findings of nested extractions."""
    return findings.of_extractions(extractions(spark, sf_dir)).select("product_id", "document_id", "category", "value", "normalized_value")


@register(f"WITH {EXTRACTED} SELECT product_id, category, count(DISTINCT normalized_value) AS n_values, count(DISTINCT document_id) AS n_documents FROM found JOIN own USING (document_id) GROUP BY ALL")
def fnd_rollup_of_extractions(spark, sf_dir):
    """The flagship path: extractions to findings to rollup."""
    f = findings.of_extractions(extractions(spark, sf_dir))
    per = f.select("product_id", "category", "normalized_value", "document_id").distinct()
    return per.groupBy("product_id", "category").agg(F.countDistinct("normalized_value").alias("n_values"), F.countDistinct("document_id").alias("n_documents"))


QUOTE = "'The  Licence \"' || l_returnflag || '\" ends' || ['.', '!', ' ', ''][CAST(l_partkey % 4 AS INTEGER) + 1]"
KEY = f"regexp_replace(trim(regexp_replace(replace(replace(lower({QUOTE}), '\"', ''), 'licence', 'license'), '\\s+', ' ', 'g')), '[\\s.,;:!?]+$', '')"


def citations(spark, sf_dir):
    marks = F.get(F.array(*map(F.lit, (".", "!", " ", ""))), (F.col("l_partkey") % 4).cast("int"))
    quote = F.concat(F.lit('The  Licence "'), F.col("l_returnflag"), F.lit('" ends'), marks)
    return read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("product_id"), F.col("l_orderkey").alias("document_id"), quote.alias("quote"), (F.col("l_linenumber") % 2 == 0).alias("verified"), F.col("l_linestatus").alias("section"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("seq"))


@register(f"SELECT product_id, document_id, quote FROM (SELECT l_suppkey % 10 AS product_id, l_orderkey AS document_id, arg_min({QUOTE}, (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) AS quote FROM lineitem GROUP BY l_suppkey % 10, l_orderkey, {KEY})")
def ded6_citations(spark, sf_dir):
    """DED-6, DED-7 and EVD-1: one citation for each document and quote."""
    return evidence.distinct_citations(citations(spark, sf_dir), ["product_id"]).select("product_id", "document_id", "quote")


@register(
    f"""WITH c AS (SELECT l_suppkey % 10 AS product_id, l_orderkey AS document_id, {KEY} AS k, arg_min({{'q': {QUOTE}, 'v': l_linenumber % 2 = 0, 's': l_linestatus, 'n': (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey}}, (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) AS c FROM lineitem GROUP BY ALL),
    r AS (SELECT product_id, document_id, c.q AS quote, row_number() OVER (PARTITION BY product_id ORDER BY c.v DESC, document_id, c.s, c.q, c.n) AS place FROM c)
    SELECT product_id, document_id, quote, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5"""
)
def srt6_best_citations(spark, sf_dir):
    return evidence.best(evidence.distinct_citations(citations(spark, sf_dir), ["product_id"]), ["product_id"]).select("product_id", "document_id", "quote", "place")


@register(f"WITH {FINDINGS} SELECT product_id, category, value, CAST(sum(n) AS BIGINT) AS n_evidence FROM (SELECT product_id, category, normalized_value, arg_min(value, seq) AS value, sum(evidence) AS n FROM findings GROUP BY ALL) GROUP BY product_id, category, value")
def jon3_hydrated_rollup(spark, sf_dir):
    """JON-3: stored items meet their findings again."""
    f = finding_rows(spark, sf_dir)
    own = rollup.item_documents(f)
    stored = own.drop("value").join(rollup.item_totals(own).select(*rollup.KEY, "value"), rollup.KEY)
    return evidence.hydrate_documents(stored, f)


@register("SELECT DISTINCT d.l_orderkey AS document_id, d.quote, contains(a.quote, d.quote) AS ok FROM (SELECT l_orderkey, 'flag ' || l_returnflag AS quote FROM lineitem) d JOIN (SELECT l_orderkey, 'seen flag ' || min(l_returnflag) || ' here' AS quote FROM lineitem GROUP BY l_orderkey) a USING (l_orderkey)")
def evd2_verbatim_quotes(spark, sf_dir):
    """Quotes that an allowed quote of their document contains."""
    li = read(spark, sf_dir, "lineitem")
    quotes = li.select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("flag "), "l_returnflag").alias("quote")).distinct()
    allowed = li.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.concat(F.lit("seen flag "), F.min("l_returnflag"), F.lit(" here")).alias("quote"))
    return evidence.contained_quotes(quotes, allowed, "document_id").select("document_id", "quote", "ok")


TYPES = {"english": ("the", "and", "ing", "tion"), "german": ("der", "und", "ung", "schaft"), "french": ("les", "eau", "tion"), "spanish": ("los", "ción", "ado")}


def type_sql(types, head=2000, least=2) -> str:
    low = f"lower(substr(coalesce(text, ''), 1, {head}))"
    hits = ["(" + " + ".join(f"CASE WHEN contains({low}, '{w}') THEN 1 ELSE 0 END" for w in words) + ")" for words in types.values()]
    best = f"greatest({', '.join(hits)})"
    return f"CASE WHEN {best} < {least} THEN 'other' " + " ".join(f"WHEN {n} = {best} THEN '{name}'" for name, n in zip(types, hits)) + " ELSE 'other' END"


@register(f"SELECT doc_id, {type_sql(TYPES)} AS type FROM documents")
def cls1_type_by_words(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", classify.by_words(F.col("text"), TYPES, least=2).alias("type"))


STOP = {"en": ("the", "and", "of", "to", "that"), "de": ("der", "die", "und", "von", "mit"), "fr": ("le", "la", "de", "et", "que"), "es": ("el", "los", "de", "y", "que")}


def language_sql() -> str:
    tokens = "regexp_split_to_array(lower(substr(coalesce(text, ''), 1, 1000)), '[^\\p{L}]+')"
    hits = [f"len(list_filter({tokens}, lambda t: t IN ({', '.join(repr(w) for w in words)})))" for words in STOP.values()]
    best = f"greatest({', '.join(hits)})"
    return f"CASE WHEN {best} < 3 THEN 'en' " + " ".join(f"WHEN {h} = {best} THEN '{name}'" for name, h in zip(STOP, hits)) + " END"


@register(f"SELECT doc_id, lang, {language_sql()} AS guess FROM documents")
def cls4_language(spark, sf_dir):
    """The language by common words, beside the one recorded."""
    guess = F.coalesce(classify.language(F.col("text"), STOP), F.lit("en"))
    return read(spark, sf_dir, "documents").select("doc_id", "lang", guess.alias("guess"))


@register("SELECT doc_id, CASE WHEN r = '' THEN 'global' ELSE r END AS regions FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(substr(text, 1, 3000)), 'version|license') THEN 'US' END, CASE WHEN regexp_matches(lower(substr(text, 1, 3000)), 'schaft|keit') THEN 'EU' END], lambda x: x IS NOT NULL), ',') AS r FROM documents)")
def cls5_regions(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(classify.regions(F.col("text"), {"US": "version|license", "EU": "schaft|keit"}), ",").alias("regions"))


@register("SELECT doc_id FROM documents WHERE NOT (doc_id % 2 = 0) OR lang IN ('en', 'de')")
def prd19_visible(spark, sf_dir):
    """Free readers see core kinds only; here two languages are core."""
    core = F.col("lang").isin("en", "de")
    return read(spark, sf_dir, "documents").where((F.col("doc_id") % 2 != 0) | core).select("doc_id")


@register("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE year(o_orderdate) BETWEEN 1990 AND 2030")
def dat1_parsed_dates(spark, sf_dir):
    """Dates written out in two formats and read back."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("t"))
    return o.select("o_orderkey", coerce.parse_date(F.col("t"), 1990, 2030).alias("day")).where("day is not null")


@register()
def txt5_chunks(spark, sf_dir):
    c = chunks.chunks(read(spark, sf_dir, "documents"), "doc_id", "text")
    return c.select("doc_id", "seq", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@register(
    """WITH k AS (SELECT doc_id, text, CASE WHEN length(text) > 800 THEN 'long' WHEN regexp_matches(text, '(?i)\\blicense\\b') THEN 'license' END AS known FROM documents),
    w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) AS word FROM k WHERE known IS NULL) GROUP BY ALL),
    b AS (SELECT doc_id, word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(word) DESC, word) AS place FROM w) WHERE place = 1)
    SELECT doc_id, coalesce(known, word) AS label FROM k LEFT JOIN b USING (doc_id)"""
)
def udf2_filled_labels(spark, sf_dir):
    """Rules label most documents, the offline provider the rest; only those rows reach it."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text")
    known = F.when(F.length("text") > 800, F.lit("long")).when(text.contains_word(F.col("text"), "license"), F.lit("license"))
    return providers.fill(rows, "doc_id", known, F.col("text"), providers.offline).select("doc_id", "label")


@register("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR lang <> 'en'")
def prd16_to_analyze(spark, sf_dir):
    """Rows without an up-to-date stored result: every third document has one, made with the language en."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    stored = docs.where("doc_id % 3 = 0").select("doc_id", text.document_hash(F.col("text"), F.lit("en")).alias("source_hash"))
    return providers.up_to_date(docs, stored, "doc_id", text.document_hash(F.col("text"), F.col("lang"))).select("doc_id")
