"""Queries over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import policies as p
from vellum.functions import text
from vellum.functions import vocabulary as v
from vellum.operators import classify, ingest, quotes
from vellum.sources.bindings import POLICIES, policy_documents
from vellum.sources.tables import read

from .registry import Registry

register = Registry()
QUERIES, ORACLE_SQL = register.queries, register.oracles


@register(
    """
    WITH f AS (SELECT doc_id, source, lang, md5(substr(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 1, 5000)) AS fp FROM documents)
    SELECT source, lang, count(*) AS n_docs
    FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, fp ORDER BY doc_id) AS rn FROM f)
    WHERE rn = 1 GROUP BY source, lang
    """
)
def m0_distinct_by_source_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each content fingerprint within its source, counted by language."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", text.fingerprint(F.col("text")).alias("fp"))
    first = docs.groupBy("source", "fp").agg(F.min_by("lang", "doc_id").alias("lang"))
    return first.groupBy("source", "lang").agg(F.count("*").alias("n_docs"))


FP = "md5(substr(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 1, 5000))"
INDICATORS, PHRASES, QUICK = v.LEGAL_INDICATORS, v.LEGAL_PHRASES, v.QUICK_CHECK


def sql_list(values) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


def sql_hits(low: str, words, head: int | None = None) -> str:
    """How many words of a list a lowered text holds, or its beginning."""
    return f"len(list_filter({sql_list(words)}, lambda w: contains({f'substr({low}, 1, {head})' if head else low}, w)))"


def type_of(what: str) -> str:
    """The cascade of document types over columns low, url, title, text and score: the type, or the stage that decides."""
    about = "lower(title) || ' '"
    by_url = "CASE " + " ".join(f"WHEN {sql_hits('lower(url)', w)} > 0 THEN '{t}'" for t, w in p.URL_HEADS.items()) + " END"
    by_about = "CASE " + " ".join(f"WHEN len(list_filter({sql_list(w)}, lambda k: regexp_matches({about}, '\\b' || k || '\\b'))) > 0 THEN '{t}'" for t, w in p.TITLE_WORDS.items()) + " END"
    counts = [sql_hits("low", w, 2000) for w in classify.TYPE_WORDS.values()]
    best = f"greatest({', '.join(counts)})"
    by_words = "CASE " + " ".join(f"WHEN {c} = {best} THEN '{t}'" for t, c in zip(classify.TYPE_WORDS, counts)) + " END"
    way = "regexp_extract(lower(url), '^[^?#]*')"
    stages = [
        (f"({sql_hits('low', p.LEGAL_MARKS)} > 0 OR length(text) > 500) AND ({by_url}) IS NOT NULL", by_url, "url"),
        (f"length(text) > 300 AND (regexp_matches({way}, '{p.POLICY_PATH}') OR length(text) > 2000 AND score > 0.4) AND ({by_about}) IS NOT NULL", by_about, "about"),
        (f"{best} >= 3 AND length(text) > 500 AND {sql_hits('low', p.STRUCTURE, 2000)} > 0", by_words, "words"),
        ("length(text) < 200", "'other'", "short"),
        (f"{sql_hits('low', p.NAVIGATION, 500)} > 0 AND length(text) < 1000", "'other'", "menu"),
    ]
    return "CASE " + " ".join(f"WHEN {cond} THEN " + (t if what == "type" else f"'{stage}'") for cond, t, stage in stages) + (" END" if what == "type" else " ELSE 'undecided' END")


def regions_of(i: int) -> str:
    """Regions, or their confidence, over columns low, url and title."""

    def codes(text: str, table: dict) -> str:
        rows = "[" + ", ".join("{'w': '" + w.replace("'", "''") + "', 'c': " + sql_list(c) + "::VARCHAR[]}" for w, c in table.items()) + "]"
        return f"flatten(list_transform(list_filter({rows}, lambda x: contains({text}, x.w)), lambda x: x.c))"

    def ordered(values: str) -> str:
        return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"

    start = "substr(low, 1, 3000)"
    ruled = "flatten([" + ", ".join(f"CASE WHEN regexp_matches({start}, '{r}') THEN {sql_list(c)} ELSE []::VARCHAR[] END" for r, c in p.JURISDICTIONS.items()) + "])"
    by_url, by_text = codes("lower(url)", p.REGION_PATHS), f"list_concat({codes(start, p.region_words())}, {ruled})"
    steps = [(f"len({by_url}) > 0", ordered(by_url), "0.80"), (f"{sql_hits('lower(title)', p.REGION_META)} > 0", "['EU']", "0.75"), (f"len({by_text}) > 0", ordered(by_text), "0.85")]
    return "CASE " + " ".join(f"WHEN {x[0]} THEN {x[1 + i]}" for x in steps) + f" ELSE {("['global']", '0.70')[i]} END"


def locale_of(i: int) -> str:
    """The locale, or its confidence, over columns doc_id, low, url and lang."""
    steps = [("doc_id % 9 = 0", "'pt-BR'", "0.95"), ("doc_id % 11 = 0 AND lang <> ''", "lang", "0.85"), ("doc_id % 13 = 0", "'nl-NL'", "0.75")]
    steps += [(f"regexp_matches(lower(url), '{r}')", f"'{x}'", "0.80") for r, x in p.LOCALE_PATHS.items()]
    steps += [(f"{sql_hits('low', p.ENGLISH_SIGNS, 1000)} >= 3", "'en-US'", "0.70")] + [(f"{sql_hits('low', w, 1000)} >= 2", f"'{x}'", "0.70") for x, w in p.FOREIGN_SIGNS.items()]
    return "CASE " + " ".join(f"WHEN {x[0]} THEN {x[1 + i]}" for x in steps) + f" ELSE {("'en-US'", '0.5')[i]} END"



def esc(s: str) -> str:
    return s.replace("'", "''")


def score_sql(indicators, phrases, quick: str) -> str:
    times = {w: f"(length(low) - length(replace(low, '{esc(w)}', ''))) // {len(w)}" for w in indicators}
    found = " + ".join([*(f"least({n}, 1)" for n in times.values()), *(f"2.0 * len(regexp_extract_all(low, '{esc(p)}'))" for p in phrases)])
    chars = " + ".join([*(f"({n}) * {len(w)}" for w, n in times.items()), *(f"length(array_to_string(regexp_extract_all(low, '{esc(p)}'), ''))" for p in phrases)])
    return f"CASE WHEN len(regexp_split_to_array(trim(text), '\\s+')) >= 50 AND length(text) >= 300 AND regexp_matches(low, '{esc(quick)}') THEN least(10.0, ({found}) * ({chars}) / length(text) * 100) ELSE 0.0 END"


def documents(spark, sf_dir, *columns):
    return read(spark, sf_dir, "documents").select(*columns) if columns else read(spark, sf_dir, "documents")


def simple(name: str, column, sql: str):
    """Registers a scalar query (doc_id, value)."""

    def run(spark, sf_dir):
        return documents(spark, sf_dir).select("doc_id", column().alias("value"))

    run.__name__ = name
    run.__doc__ = f"The expression {name} of every document."
    register(f"SELECT doc_id, {sql} AS value FROM documents")(run)


T = lambda: F.col("text")
simple("txt1_fingerprint", lambda: text.fingerprint(T()), FP)
simple("txt2_normalize_value", lambda: F.md5(text.normalize_value(T())), "md5(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))))")
simple("txt3_document_hash", lambda: text.document_hash(T(), F.col("lang")), "sha256(coalesce(text, '') || coalesce(lang, ''))")
simple("txt6_token_estimate", lambda: text.token_estimate(T()), "greatest(1, length(text) // 4)")
simple("txt8_garbled", lambda: text.garbled(T()), "coalesce(length(text) >= 100 AND (len(regexp_extract_all(substr(text, 1, 1024), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')) / length(substr(text, 1, 1024)) > 0.08 OR len(regexp_extract_all(substr(text, 1, 1024), '[^\\x00-\\x7F]')) / length(substr(text, 1, 1024)) > 0.25), false)")
simple("txt10_word_count", lambda: text.word_count(T()), "CAST(len(regexp_extract_all(coalesce(text, ''), '\\w+')) AS BIGINT)")
simple("txt10_long_sentences", lambda: text.long_sentences(T()), "CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: len(regexp_extract_all(s, '\\w+')) > 35)) AS BIGINT)")
simple("txt11_truncate", lambda: text.truncate(T()), "CASE WHEN length(text) > 220 THEN rtrim(substr(text, 1, 217)) || '...' ELSE text END")
simple("txt12_cap", lambda: F.md5(text.cap(T())), "md5(CASE WHEN length(text) > 150000 THEN substr(text, 1, 150000 - 13) || chr(10) || chr(10) || '[truncated]' ELSE text END)")
simple("cls2_whole_word", lambda: text.contains_word(T(), "License"), "regexp_matches(text, '(?i)\\bLicense\\b')")


@register(f"WITH f AS (SELECT doc_id, source, {FP} AS fp FROM documents) SELECT source, fp, min(doc_id) AS doc_id, count(*) AS n FROM f GROUP BY source, fp")
def ded2_first_by_fingerprint(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "source", text.fingerprint(F.col("text")).alias("fp"))
    return docs.groupBy("source", "fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@register(f"WITH f AS (SELECT doc_id, source, lang, {FP} AS fp FROM documents), k AS (SELECT min(doc_id) AS owner, fp FROM f GROUP BY fp) SELECT f.doc_id, k.owner, CASE WHEN f.doc_id = k.owner THEN 'insert' ELSE 'link' END AS action FROM f JOIN k USING (fp)")
def ded3_link_or_insert(spark, sf_dir):
    """A content seen before is linked to its first document instead of inserted."""
    docs = documents(spark, sf_dir, "doc_id", text.fingerprint(F.col("text")).alias("fp"))
    first = docs.groupBy("fp").agg(F.min("doc_id").alias("owner"))
    action = F.when(F.col("doc_id") == F.col("owner"), "insert").otherwise("link")
    return docs.join(first, "fp").select("doc_id", "owner", action.alias("action"))


@register("SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS analyzed, greatest(0, count(*) - count(*) FILTER (quality = 1)) AS pending FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def agg2_pending_documents(spark, sf_dir):
    joined = documents(spark, sf_dir, "doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    done = F.count_if(F.col("quality") == 1)
    return joined.groupBy("source").agg(F.count("*").alias("n"), done.alias("analyzed"), F.greatest(F.lit(0), F.count("*") - done).alias("pending"))


@register("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def agg1_count_by_type(spark, sf_dir):
    return documents(spark, sf_dir, "source", "lang").groupBy("source", "lang").agg(F.count("*").alias("n"))


@register("SELECT p AS product, count(*) AS n FROM (SELECT unnest(list_distinct([source, 'src' || CAST(doc_id % 20 AS VARCHAR)])) AS p FROM documents) GROUP BY p")
def agg3_documents_per_product(spark, sf_dir):
    """PRD-1 and AGG-3: membership by owner or list, exploded to an equi-key."""
    product = F.explode(text.ordered_union(F.array("source"), F.array(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")))))
    return documents(spark, sf_dir, "doc_id", "source").select(product.alias("product")).groupBy("product").agg(F.count("*").alias("n"))


@register("WITH h AS (SELECT source, sha256(coalesce(text, '') || coalesce(lang, '')) AS h FROM documents), b AS (SELECT source, substr(h, 1, 4) AS bucket, sha256(string_agg(h, '|' ORDER BY h)) AS d FROM h GROUP BY ALL) SELECT source, sha256(string_agg(bucket || ':' || d, '|' ORDER BY bucket)) AS signature FROM b GROUP BY source")
def agg24_signature(spark, sf_dir):
    """A signature of all hashes of a source in two levels: a digest for each of 65,536 ranges, then one of those, so a source of any size is no single value."""
    h = documents(spark, sf_dir, "source", text.document_hash(F.col("text"), F.col("lang")).alias("h"))
    digest = lambda x: F.sha2(F.array_join(F.array_sort(F.collect_list(x)), "|"), 256)
    ranges = h.groupBy("source", F.substring("h", 1, 4).alias("bucket")).agg(digest("h").alias("d"))
    return ranges.groupBy("source").agg(digest(F.concat_ws(":", "bucket", "d")).alias("signature"))


@register("WITH c AS (SELECT source, count(DISTINCT lang) AS types, count(*) FILTER (lang <> 'es') AS core FROM documents GROUP BY source) SELECT source, types < 2 OR core < 3 AS thin FROM c")
def agg23_thin_evidence(spark, sf_dir):
    c = documents(spark, sf_dir, "source", "lang").groupBy("source").agg(F.countDistinct("lang").alias("types"), F.count_if(F.col("lang") != "es").alias("core"))
    return c.select("source", ((F.col("types") < 2) | (F.col("core") < 3)).alias("thin"))


@register(f"WITH {POLICIES} SELECT doc_id, round({score_sql(INDICATORS, PHRASES, QUICK)}, 6) AS score FROM (SELECT doc_id, text, lower(text) AS low FROM policies)")
def txt9_content_score(spark, sf_dir):
    return policy_documents(spark, sf_dir).select("doc_id", F.round(ingest.content_score(F.col("text"), F.lit(""), title_words=()), 6).alias("score"))


GARBLED = "coalesce(length(text) >= 100 AND (len(regexp_extract_all(substr(text, 1, 1024), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')) / length(substr(text, 1, 1024)) > 0.08 OR len(regexp_extract_all(substr(text, 1, 1024), '[^\\x00-\\x7F]')) / length(substr(text, 1, 1024)) > 0.25), false)"


@register(f"WITH {POLICIES} SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 300 THEN 'too_short' WHEN {GARBLED} THEN 'garbled' WHEN {score_sql(INDICATORS, PHRASES, QUICK)} / 10 < 0.2 AND NOT doc_id % 3 = 0 THEN 'low_legal_score' WHEN NOT starts_with(lang, 'en') THEN 'locale' WHEN ({type_of('stage')}) IN ('short', 'menu') THEN 'not_policy' END AS reason FROM (SELECT *, lower(text) AS low, {score_sql(INDICATORS, PHRASES, QUICK)} / 10 AS score FROM (SELECT *, lower(text) AS low FROM policies))")
def prd10_admission_reason(spark, sf_dir):
    """Length, garbled text, policy score, locale, then whether it is a policy at all."""
    scored = classify.with_signs(policy_documents(spark, sf_dir).withColumn("description", F.lit(""))).withColumn("score", ingest.content_score(F.col("text"), F.lit(""), title_words=()))
    kind = classify.document_type(F.col("signs"), F.col("text"), F.col("url"), F.col("score") / 10)
    return scored.select("doc_id", ingest.skip_reason(F.col("text"), F.col("score"), F.col("doc_id") % 3 == 0, F.col("lang"), policy=kind["is_policy"]).alias("reason"))


@register(f"WITH {POLICIES} SELECT doc_id, {type_of('type')} AS type, {type_of('stage')} AS stage FROM (SELECT *, lower(text) AS low, {score_sql(INDICATORS, PHRASES, QUICK)} / 10 AS score FROM (SELECT *, lower(text) AS low FROM policies))")
def cls1_document_type(spark, sf_dir):
    """The whole cascade: address, title, words of the beginning, length, menus."""
    scored = classify.with_signs(policy_documents(spark, sf_dir).withColumn("description", F.lit(""))).withColumn("score", ingest.content_score(F.col("text"), F.lit(""), title_words=()))
    return scored.select("doc_id", classify.document_type(F.col("signs"), F.col("text"), F.col("url"), F.col("score") / 10).alias("t")).select("doc_id", "t.type", "t.stage")


@register(f"WITH {POLICIES} SELECT doc_id, array_to_string(r, ',') AS regions, c AS confidence FROM (SELECT doc_id, {regions_of(0)} AS r, CAST({regions_of(1)} AS DOUBLE) AS c FROM (SELECT *, lower(text) AS low FROM policies))")
def cls5_document_regions(spark, sf_dir):
    """Regions by address, metadata, then frameworks, phrases and jurisdictions."""
    docs = classify.with_signs(policy_documents(spark, sf_dir).withColumn("description", F.lit("")))
    r = classify.document_regions(F.col("signs"), F.col("text"))
    return docs.select("doc_id", r.alias("r")).select("doc_id", F.array_join("r.regions", ",").alias("regions"), F.col("r.confidence").alias("confidence"))


@register(f"WITH {POLICIES} SELECT doc_id, {locale_of(0)} AS locale, CAST({locale_of(1)} AS DOUBLE) AS confidence FROM (SELECT *, lower(text) AS low FROM policies)")
def cls4_document_locale(spark, sf_dir):
    """Locale by metadata (here every ninth page's Open Graph and every eleventh's language), address, then signs; else the fallback."""
    docs = classify.with_signs(policy_documents(spark, sf_dir).withColumn("description", F.lit("")))
    og, own = F.when(F.col("doc_id") % 9 == 0, F.lit("pt-BR")), F.when(F.col("doc_id") % 11 == 0, F.col("lang"))
    found = classify.document_locale(F.col("signs"), F.col("url"), og, own, F.when(F.col("doc_id") % 13 == 0, F.array(F.lit("nl-NL"))))
    fallback = F.struct(F.lit("en-US").alias("locale"), F.lit(0.5).alias("confidence"))
    return docs.select("doc_id", F.coalesce(found, fallback).alias("l")).select("doc_id", "l.locale", "l.confidence")


@register("SELECT doc_id FROM documents WHERE length(coalesce(text, '')) < 500")
def prd23_short_texts(spark, sf_dir):
    return documents(spark, sf_dir).where(F.length(F.coalesce("text", F.lit(""))) < 500).select("doc_id")


@register("SELECT doc_id, array_to_string(list_filter([CASE WHEN coalesce(text, '') = '' THEN 'text' END, CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def prd24_missing_fields(spark, sf_dir):
    joined = documents(spark, sf_dir, "doc_id", "text").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    gone = F.array_compact(F.array(F.when(F.coalesce("text", F.lit("")) == "", "text"), F.when(F.col("quality").isNull(), "quality"), F.when(F.col("toxic").isNull(), "toxic")))
    return joined.select("doc_id", F.array_join(gone, ",").alias("missing"))


@register("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jon12_label_map(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@register("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def prd22_sources_without_hits(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "source")
    hit = docs.join(read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("source").distinct()
    return docs.select("source").distinct().join(hit, "source", "left_anti")


@register("SELECT d.doc_id, b.item_id, instr(d.text, b.text) - 1 AS start_char, instr(d.text, b.text) - 1 + length(b.text) AS end_char FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def jon8_quote_containment(spark, sf_dir):
    """JON-8 and TXT-7: documents that hold a quote verbatim, and where.

    Quotes meet texts by a run of their inner words.
    """
    return quotes.contained(documents(spark, sf_dir, "doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote")))


@register("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, CAST(max(length(text)) AS BIGINT) AS longest FROM conversations GROUP BY conv_id")
def mrg_turn_order(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.max(F.length("text")).cast("long").alias("n"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"), F.max("n").alias("longest"))


@register()
def txt9_content_score_all(spark, sf_dir):
    """The content score by every policy word."""
    return documents(spark, sf_dir, "doc_id", F.round(ingest.content_score(F.col("text"), F.lit(""), INDICATORS, PHRASES, QUICK), 6).alias("score"))


@register()
def prd10_admission_reason_all(spark, sf_dir):
    """Why a document is not admitted, its score by every policy word."""
    score = ingest.content_score(F.col("text"), F.lit(""), INDICATORS, PHRASES, QUICK)
    return documents(spark, sf_dir, "doc_id", ingest.skip_reason(F.col("text"), score, F.col("doc_id") % 3 == 0, F.col("lang")).alias("reason"))


@register()
def txt12_cap_all(spark, sf_dir):
    """Texts cut at the default size only."""
    return documents(spark, sf_dir, "doc_id", F.md5(text.cap(T())).alias("value"))
