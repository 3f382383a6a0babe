"""Queries of writes, joins and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import grades, policies, url
from vellum.functions import vocabulary as v
from vellum.functions.coerce import SENSITIVITY
from vellum.operators import ingest, merge, store, topics
from vellum.sources.bindings import LINKS, links
from vellum.sources.tables import read

from .registry import Registry

register = Registry()
QUERIES, ORACLE_SQL = register.queries, register.oracles

PARTS = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', {})"
SCHEME, HOST, PATH, QUERY = (PARTS.format(i) for i in (1, 2, 3, 4))
LANGS = "('ar', 'cs', 'da', 'de', 'en', 'es', 'fi', 'fr', 'hu', 'id', 'it', 'ja', 'ko', 'ms', 'nl', 'no', 'pl', 'ro', 'ru', 'sv', 'th', 'tr', 'vi')"
TRACK = "(" + ", ".join(f"'{x}'" for x in url.TRACKING_PARAMETERS) + ")"
NAME = "lower(regexp_extract(p, '^([^=]*)', 1))"
KEPT = f"array_to_string(list_filter(string_split({QUERY}, '&'), lambda p: p <> '' AND NOT ({{}})), '&')"
NORMAL_QUERY = KEPT.format(f"starts_with({NAME}, 'utm_') OR {NAME} IN {TRACK}")
CANON_QUERY = KEPT.format(f"{NAME} IN ('lang', 'language', 'hl')")
CANON_PATH = f"'/' || array_to_string(list_filter(string_split({PATH}, '/'), lambda s: s <> '' AND lower(s) NOT IN {LANGS}), '/')"
CANON = f"{SCHEME} || '://' || {HOST} || {CANON_PATH} || CASE WHEN {CANON_QUERY} <> '' THEN '?' || {CANON_QUERY} ELSE '' END"
NORMAL = f"{SCHEME} || '://' || {HOST} || {PATH} || CASE WHEN {NORMAL_QUERY} <> '' THEN '?' || {NORMAL_QUERY} ELSE '' END"
WAY = f"CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END"
LOCALE = f"(regexp_matches({WAY}, '(?i)^/[a-z]{{2}}([-_][a-z]{{2}})?(/|$)') OR (regexp_matches(lower({HOST}), '^[a-z]{{2}}([-_][a-z]{{2}})?\\.') AND NOT starts_with(lower({HOST}), 'www.')))"


def pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", "url")


@register(f"SELECT page_id, CASE WHEN ends_with({NORMAL}, '/') AND length({PATH}) > 1 THEN substr({NORMAL}, 1, length({NORMAL}) - 1) ELSE {NORMAL} END AS normalized FROM pages")
def url1_normalize(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", url.normalize(F.col("url")).alias("normalized"))


@register(f"SELECT page_id, {CANON} AS canonical FROM pages")
def url2_canonicalize(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", url.canonicalize(F.col("url")).alias("canonical"))


@register(f"SELECT page_id, CAST({LOCALE} AS INTEGER) AS looks_locale, CAST(length({WAY}) AS INTEGER) AS path_length FROM pages")
def url4_canonical_rank(spark, sf_dir):
    rank = url.canonical_rank(F.col("url"))
    return pages(spark, sf_dir).select("page_id", rank.looks_locale.alias("looks_locale"), rank.path_length.alias("path_length"))


DOMAIN = f"regexp_replace(regexp_replace(lower({HOST}), '[/:].*$', ''), '^www\\.', '')"


@register(f"SELECT page_id, d AS domain, array_to_string(string_split(d, '.')[-2:], '.') AS base, string_split(d, '.')[-2] AS slug FROM (SELECT page_id, {DOMAIN} AS d FROM pages)")
def url7_domains(spark, sf_dir):
    p = pages(spark, sf_dir)
    return p.select("page_id", url.normalize_domain(F.col("url")).alias("domain"), url.base_domain(F.col("url")).alias("base"), url.domain_slug(F.col("url")).alias("slug"))


@register(f"SELECT base, count(*) AS n FROM (SELECT array_to_string(string_split({DOMAIN}, '.')[-2:], '.') AS base FROM pages) GROUP BY base")
def ded8_seeds_by_domain(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(url.base_domain(F.col("url")).alias("base")).agg(F.count("*").alias("n"))


@register(f"SELECT page_id, host || path AS candidate FROM (SELECT page_id, {SCHEME} || '://' || {HOST} AS host FROM pages), (SELECT unnest(['/privacy', '/terms', '/legal']) AS path)")
def url9_candidates(spark, sf_dir):
    base = F.concat(url.scheme(F.col("url")), F.lit("://"), url.part(F.col("url"), 2))
    return pages(spark, sf_dir).select("page_id", F.explode(url.candidates(base, ("/privacy", "/terms", "/legal"))).alias("candidate"))


@register(f"SELECT page_id FROM pages WHERE lower({HOST}) LIKE '%.example.com' OR lower({HOST}) = 'example.com'")
def prd12_domain_filter(spark, sf_dir):
    return pages(spark, sf_dir).where(url.under_domain(url.host(F.col("url")), F.array(F.lit("example.com")))).select("page_id")


@register(f"SELECT canonical, count(*) AS n_variants, min(page_id) AS first FROM (SELECT page_id, {CANON} AS canonical FROM pages) GROUP BY canonical")
def ded5_locale_keys(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(url.locale_key(F.col("url")).canonical.alias("canonical")).agg(F.count("*").alias("n_variants"), F.min("page_id").alias("first"))


@register(f"SELECT page_id, variant FROM (SELECT page_id, CAST(row_number() OVER (PARTITION BY canonical ORDER BY is_english DESC, page_id) AS INTEGER) AS variant FROM (SELECT page_id, {CANON} AS canonical, list_contains(list_transform(string_split({PATH}, '/'), lambda s: lower(s)), 'en') AS is_english FROM pages)) WHERE variant <= 2")
def win9_variant_cap(spark, sf_dir):
    return ingest.variants(pages(spark, sf_dir), "url", "page_id").select("page_id", "variant")


URL_WORDS, URL_PHRASES = v.URL_KEYWORDS, v.URL_PHRASES


def url_score_sql() -> str:
    kept = f"list_filter(string_split(lower({QUERY}), '&'), lambda x: NOT list_contains({policies_list(policies.REDIRECT_PARAMETERS)}, string_split(x, '=')[1]))"
    query = f"array_to_string(list_transform({kept}, lambda x: replace(url_decode(replace(x, '+', ' ')), '=', ' ')), ' ')"
    tokens = lambda c: f"list_filter(string_split(regexp_replace({c}, '[^\\w]+|_', ' ', 'g'), ' '), lambda x: x <> '')"
    said = lambda c, k: " + ".join(f"CASE WHEN regexp_matches({c}, '{p}') THEN {k * x} ELSE 0.0 END" for p, x in URL_PHRASES.items())
    words = lambda c, k: " + ".join(f"len(list_filter({c}, lambda z: z = '{w}')) * ({k * x})" for w, x in URL_WORDS.items())
    inner = " + ".join(f"CASE WHEN NOT list_contains(t, '{w}') AND contains(p || ' ' || array_to_string(t, ' '), '{w}') THEN {0.8 * x} ELSE 0.0 END" for w, x in URL_WORDS.items() if x > 0)
    paths = " + ".join(f"CASE WHEN contains(p, '{w}') THEN {x} ELSE 0.0 END" for w, x in policies.PATH_WEIGHTS.items())
    other = f"CASE WHEN regexp_matches(p, '{policies.HEX_PATH}') THEN 2.0 ELSE 0.0 END - CASE WHEN regexp_matches(p, '/[^/]+/terms/[^/]+') AND NOT regexp_matches(p, '/terms/(service|use|conditions|sale|payment|payments|business|general|user|website|privacy|cookie|cookies|policy|of-|and-)') THEN 8.5 ELSE 0.0 END"
    out = f"CASE WHEN regexp_matches(p, '{v.AUTH_PATH}') OR regexp_matches(p, '{v.GALLERY_PATH}') THEN 0.0 ELSE greatest(0.0, {said('w', 1)} + {paths} + {words('t', 1)} + {inner} + {other} + {said('a', 2.5)} + {words('s', 2)}) END"
    base = f"SELECT page_id, lower({PATH}) AS p, trim(lower({PATH}) || ' ' || {query}) AS w, lower(regexp_extract(url, '#(.*)$', 1)) AS f, lower(anchor) AS a FROM links"
    return f"WITH {LINKS} SELECT page_id, CAST(round({out}, 6) AS DOUBLE) AS score FROM (SELECT *, {tokens("w || ' ' || f")} AS t, list_filter(regexp_split_to_array(a, '\\W+'), lambda x: x <> '') AS s FROM ({base}))"


def policies_list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


@register(url_score_sql())
def url5_url_scores(spark, sf_dir):
    """Scores of links by their address and text."""
    return links(spark, sf_dir).select("page_id", F.round(ingest.url_score(F.col("url"), anchor=F.col("anchor")), 6).alias("score"))


@register()
def url5_url_scores_all(spark, sf_dir):
    """The score of addresses by every keyword and phrase."""
    return pages(spark, sf_dir).select("page_id", F.round(ingest.url_score(F.col("url"), {**v.URL_PHRASES, **URL_PHRASES}, {**v.URL_KEYWORDS, **URL_WORDS}), 6).alias("score"))


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def jon1_semi(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@register("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 1000)")
def jon7_orphans(spark, sf_dir):
    return store.orphans(read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").where("c_acctbal >= 1000").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@register("SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 1000)")
def agg39_orphan_count(spark, sf_dir):
    known = read(spark, sf_dir, "customer").where("c_acctbal >= 1000").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(known, "o_custkey", "left_anti").agg(F.count("*").alias("n"))


@register("SELECT r_name, n_name, count(c_custkey) AS n FROM region CROSS JOIN (SELECT DISTINCT n_name, n_nationkey, n_regionkey FROM nation) LEFT JOIN customer ON c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY r_name, n_name")
def jon6_coverage_grid(spark, sf_dir):
    """Every region with every nation, and the customers that fit both: two fixed dimensions make the grid."""
    keys = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r_regionkey")  # the five regions
    grid = read(spark, sf_dir, "nation").select("n_name", "n_nationkey", "n_regionkey", keys).join(read(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey")
    per = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    n = F.when(F.col("n_regionkey") == F.col("r_regionkey"), F.coalesce("c", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return grid.join(per, "n_nationkey", "left").select("r_name", "n_name", n.alias("n"))


@register("SELECT o_orderkey, coalesce(c_name, 'unknown') AS title FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 4 <> 0")
def jon5_titles(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return read(spark, sf_dir, "orders").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("title"))


@register("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'part') OR contains(lower(p_type), 'part') ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50")
def prd5_search_page(spark, sf_dir):
    term = "part"
    hit = F.lower("p_name").contains(term) | F.lower("p_type").contains(term)
    return read(spark, sf_dir, "part").where(hit).orderBy("p_name", "p_partkey").offset(50).limit(25).select("p_partkey", "p_name")


@register("SELECT CAST(greatest(1, ceil(count(*) / 24.0)) AS BIGINT) AS pages FROM part")
def srt13_page_count(spark, sf_dir):
    return read(spark, sf_dir, "part").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 24)).cast("long").alias("pages"))


@register("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set2_difference(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").subtract(read(spark, sf_dir, "orders").select("o_custkey"))


@register("SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey FROM supplier")
def set5_union(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).union(read(spark, sf_dir, "supplier").select("s_suppkey")).distinct()


@register("SELECT o_custkey, string_agg(p, ',' ORDER BY s, p) AS priorities FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS s FROM orders GROUP BY ALL) GROUP BY o_custkey")
def set1_ordered_union(spark, sf_dir):
    seen = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("seq"))
    return seen.groupBy("o_custkey").agg(F.array_join(merge.union("o_orderpriority", "seq"), ",").alias("priorities"))


@register("SELECT c_custkey, CASE WHEN n.name <> '' THEN n.name ELSE o.name END AS name FROM (SELECT c_custkey, c_name AS name FROM customer) o LEFT JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE upper(c_name) END AS name FROM customer WHERE c_acctbal < 5000) n ON n.k = c_custkey")
def snk2_guarded_update(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    old = c.select("c_custkey", F.col("c_name").alias("name"))
    new = c.where("c_acctbal < 5000").withColumnRenamed("c_name", "name").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.upper("name")).alias("name"))
    return store.guarded_update(old, new, "c_custkey", ["name"])


@register("SELECT coalesce(n.k, o.k) AS k, coalesce(n.status, o.status) AS status, CASE WHEN o.k IS NULL THEN 'new' ELSE o.origin END AS origin FROM (SELECT o_orderkey AS k, o_orderstatus AS status, 'old' AS origin FROM orders WHERE o_orderpriority <> '1-URGENT') o FULL JOIN (SELECT o_orderkey AS k, 'X' AS status FROM orders WHERE o_orderstatus <> 'P') n ON o.k = n.k")
def snk4_upsert(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    old = o.where("o_orderpriority <> '1-URGENT'").select("k", "status", F.lit("old").alias("origin"))
    return store.upsert(old, o.where("status <> 'P'").select("k", F.lit("X").alias("status")), "k", {"origin": F.lit("new")})


@register("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'F' THEN 'status' END, CASE WHEN o_orderkey % 5 = 0 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS changed FROM orders WHERE (o_orderkey % 2 = 0 AND o_orderstatus <> 'F') OR o_orderkey % 5 = 0")
def jon19_changed_fields(spark, sf_dir):
    """JON-19, SNK-7 and STR-8: what an update changes, as the change log records it."""
    old = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = old.withColumn("status", F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise(F.col("status"))).withColumn("price", F.when(F.col("o_orderkey") % 5 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return store.changed_fields(old, new, "o_orderkey", ["status", "price"]).withColumn("changed", F.array_join("changed", ","))


@register("SELECT doc_id, array_to_string(list_filter(list_distinct([source, 'src' || CAST(doc_id % 20 AS VARCHAR)]), lambda x: x <> 'src3'), ',') AS owners FROM documents WHERE len(list_filter(list_distinct([source, 'src' || CAST(doc_id % 20 AS VARCHAR)]), lambda x: x <> 'src3')) = 1")
def snk6_cascade_delete(spark, sf_dir):
    """What a deleted product leaves: documents of other owners stay; here those left with a single owner."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.array("source", F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")))).alias("owners"))
    left, _ = store.cascade_delete("src3", docs, "doc_id", "owners")
    return left.where(F.size("owners") == 1).select("doc_id", F.array_join("owners", ",").alias("owners"))


@register("SELECT l_orderkey, count(*) FILTER (l_linenumber % 2 = 1 AND l_suppkey % 10 <> 3) AS shown, count(*) FILTER (l_suppkey % 10 = 3) AS stale FROM lineitem GROUP BY l_orderkey")
def snk12_stale_citations(spark, sf_dir):
    """SNK-12 and PRD-18: citations of one document become stale; verified fresh ones are shown."""
    cite = F.struct((F.col("l_suppkey") % 10).alias("document_id"), (F.col("l_linenumber") % 2 == 1).alias("verified"), F.lit(False).alias("stale"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(cite).alias("citations"))
    marked = store.mark_stale(rows, "citations", F.lit(3))
    return marked.select("l_orderkey", F.size(store.displayable(F.col("citations"))).cast("long").alias("shown"), F.size(F.filter("citations", lambda c: c["stale"])).cast("long").alias("stale"))


@register(
    """WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus AS state, ['A', 'B', 'C', 'D', 'E'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS grade FROM orders),
    l AS (SELECT *, lag(state) OVER w AS p, lag(grade) OVER w AS g FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    r AS (SELECT o_custkey, o_orderkey, instr('ABCDE', grade) - instr('ABCDE', g) AS delta, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM l WHERE p IS NULL OR p <> state)
    SELECT o_custkey, o_orderkey, CAST(delta AS INTEGER) AS delta, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20"""
)
def win1_history(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("state"), F.get(F.array(*map(F.lit, "ABCDE")), (F.col("o_orderkey") % 5).cast("int")).alias("grade"))
    return store.history(o, "o_custkey", "o_orderkey", "state", "grade").select("o_custkey", "o_orderkey", "delta", "place")


@register(
    f"""WITH p AS (SELECT page_id AS id, url, {CANON} AS canonical, lower({HOST}) AS host, page_id % 7 AS content FROM pages), k AS (SELECT * FROM p WHERE starts_with(url, 'https://')), n AS (SELECT * FROM p)
    SELECT n.id, coalesce(a.m, b.m, c.m) AS match, CASE WHEN a.m IS NOT NULL THEN 'url' WHEN b.m IS NOT NULL THEN 'canonical' WHEN c.m IS NOT NULL THEN 'content' END AS tier
    FROM n LEFT JOIN (SELECT url, min(id) AS m FROM k GROUP BY url) a ON a.url = n.url LEFT JOIN (SELECT canonical, min(id) AS m FROM k GROUP BY canonical) b ON b.canonical = n.canonical
    LEFT JOIN (SELECT host, content, min(id) AS m FROM k GROUP BY host, content) c ON c.host = n.host AND c.content = n.content"""
)
def jon10_three_tiers(spark, sf_dir):
    p = pages(spark, sf_dir).select(F.col("page_id").alias("id"), "url", url.canonicalize(F.col("url")).alias("canonical"), url.host(F.col("url")).alias("host"), (F.col("page_id") % 7).alias("content"))
    return store.three_tiers(p, p.where("url like 'https://%'"), "url", "canonical", ["host", "content"])


@register("SELECT conv_id, role, arg_max(text, length(text) * 100000 - turn) AS longest FROM conversations GROUP BY conv_id, role")
def mrg4_longest(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(merge.longest("text", "turn").alias("longest"))


LEVEL = "['low', 'medium', 'high', 'sensitive', 'odd'][CAST((turn * 7 + length(text)) % 5 AS INTEGER) + 1]"


def levels(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.withColumn("level", F.get(F.array(*map(F.lit, ("low", "medium", "high", "sensitive", "odd"))), ((F.col("turn") * 7 + F.length("text")) % 5).cast("int")))


@register(f"SELECT conv_id, arg_max(level, r * 100000 - turn) AS level FROM (SELECT conv_id, turn, {LEVEL} AS level, CASE {LEVEL} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'sensitive' THEN 4 ELSE 0 END AS r FROM conversations) GROUP BY conv_id")
def mrg2_max_rank(spark, sf_dir):
    return levels(spark, sf_dir).groupBy("conv_id").agg(merge.strongest("level", SENSITIVITY, "turn").alias("level"))


@register(f"SELECT conv_id, arg_max(level, turn) FILTER (level IN ('low', 'medium', 'high')) AS level FROM (SELECT conv_id, turn, {LEVEL} AS level FROM conversations) GROUP BY conv_id")
def mrg6_last_valid(spark, sf_dir):
    return levels(spark, sf_dir).groupBy("conv_id").agg(merge.last_valid("level", "turn", ("low", "medium", "high")).alias("level"))


@register(f"SELECT conv_id, bool_or(level = 'high') AS high, CASE WHEN bool_or(level = 'sensitive') THEN 'yes' WHEN bool_or(level = 'low') THEN 'no' ELSE 'unclear' END AS signal FROM (SELECT conv_id, {LEVEL} AS level FROM conversations) GROUP BY conv_id")
def mrg17_signal_merge(spark, sf_dir):
    answer = F.when(F.col("level") == "sensitive", "yes").when(F.col("level") == "low", "no").otherwise("unclear")
    return levels(spark, sf_dir).groupBy("conv_id").agg(merge.sticky(F.col("level") == "high").alias("high"), merge.signal(answer).alias("signal"))


@register(f"SELECT conv_id, string_agg(level, ',' ORDER BY s) AS levels FROM (SELECT conv_id, level, min(turn) AS s FROM (SELECT conv_id, turn, {LEVEL} AS level FROM conversations) GROUP BY ALL) GROUP BY conv_id")
def mrg3_ordered_union(spark, sf_dir):
    seen = levels(spark, sf_dir).groupBy("conv_id", "level").agg(F.min("turn").alias("turn"))
    return seen.groupBy("conv_id").agg(F.array_join(merge.union("level", "turn"), ",").alias("levels"))


@register("SELECT conv_id, arg_min(text, turn) FILTER (role = 'assistant') AS first FROM conversations GROUP BY conv_id")
def mrg8_first(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("answer", F.when(F.col("role") == "assistant", F.col("text")))
    return c.groupBy("conv_id").agg(merge.first("answer", "turn").alias("first"))


@register("SELECT o_custkey, CAST(round_even(sum(s * w) / sum(w), 0) AS INTEGER) AS risk FROM (SELECT o_custkey, o_orderkey % 11 AS s, CASE o_orderpriority WHEN '1-URGENT' THEN 300 WHEN '2-HIGH' THEN 150 ELSE 100 END AS w FROM orders WHERE o_orderstatus <> 'P') GROUP BY o_custkey")
def agg19_doc_weighted_risk(spark, sf_dir):
    weight = F.when(F.col("o_orderpriority") == "1-URGENT", 3.0).when(F.col("o_orderpriority") == "2-HIGH", 1.5).otherwise(1.0)
    o = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_custkey", (F.col("o_orderkey") % 11).alias("s"), weight.alias("w"))
    return o.groupBy("o_custkey").agg(topics.weighted(F.col("s"), F.col("w")).alias("risk"))


DIMENSION = "['transparency', 'data_collection_scope', 'user_control', 'third_party_sharing', 'data_retention_score', 'security_score', 'other'][CAST(l_linenumber % 7 AS INTEGER) + 1]"


@register(
    f"""WITH d AS (SELECT l_orderkey, {DIMENSION} AS dim, ['A', 'B', 'C', 'D', 'E'][CAST(l_partkey % 5 AS INTEGER) + 1] AS grade FROM lineitem),
    w AS (SELECT l_orderkey, CASE grade WHEN 'A' THEN 9 WHEN 'B' THEN 7 WHEN 'C' THEN 5 WHEN 'D' THEN 3 ELSE 1 END AS s, CASE dim WHEN 'transparency' THEN 14 WHEN 'data_collection_scope' THEN 26 WHEN 'user_control' THEN 18 WHEN 'third_party_sharing' THEN 24 WHEN 'data_retention_score' THEN 10 WHEN 'security_score' THEN 8 END AS w FROM d WHERE dim <> 'other'),
    m AS (SELECT l_orderkey, round_even(sum(s * w) / sum(w), 0) AS m FROM w GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN m >= 8 THEN 'A' WHEN m >= 6 THEN 'B' WHEN m >= 4 THEN 'C' WHEN m >= 2 THEN 'D' ELSE 'E' END AS grade FROM m"""
)
def agg20_dimension_grade(spark, sf_dir):
    names = F.array(*map(F.lit, [*grades.DIMENSION_WEIGHTS, "other"]))
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", F.get(names, (F.col("l_linenumber") % 7).cast("int")).alias("dim"), F.get(F.array(*map(F.lit, "ABCDE")), (F.col("l_partkey") % 5).cast("int")).alias("grade")).where("dim <> 'other'")
    mean = topics.weighted(grades.user_score(F.col("grade")), grades.lookup(F.col("dim"), grades.DIMENSION_WEIGHTS))
    return d.groupBy("l_orderkey").agg(mean.alias("m")).select("l_orderkey", grades.of_user_score(F.col("m")).alias("grade"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN p NOT BETWEEN 1 AND 5 THEN d ELSE substr('ABCDE', CAST(least(greatest(p, instr('ABCDE', d) - 1), instr('ABCDE', d) + 1) AS INTEGER), 1) END AS grade FROM (SELECT l_orderkey, l_linenumber, l_partkey % 6 + 1 AS p, ['A', 'B', 'C', 'D', 'E'][CAST(l_suppkey % 5 AS INTEGER) + 1] AS d FROM lineitem)")
def cls9_clamp_grade(spark, sf_dir):
    letters = F.array(*map(F.lit, "ABCDE?"))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.get(letters, (F.col("l_partkey") % 6).cast("int")).alias("p"), F.get(letters, (F.col("l_suppkey") % 5).cast("int")).alias("d"))
    return li.select("l_orderkey", "l_linenumber", grades.clamp(F.col("p"), F.col("d")).alias("grade"))


@register("SELECT o_custkey, k AS regulation, CAST(round_even(avg(v), 0) AS INTEGER) AS mean FROM (SELECT o_custkey, unnest(['gdpr', 'ccpa']) AS k, unnest([o_orderkey % 11, o_orderkey % 7]) AS v FROM orders) GROUP BY ALL")
def agg21_compliance_mean(spark, sf_dir):
    scores = F.create_map(F.lit("gdpr"), F.col("o_orderkey") % 11, F.lit("ccpa"), F.col("o_orderkey") % 7)
    o = read(spark, sf_dir, "orders").select("o_custkey", F.explode(scores).alias("regulation", "v"))
    return o.groupBy("o_custkey", "regulation").agg(F.bround(F.avg("v")).cast("int").alias("mean"))


ITEM = """item AS (SELECT l_orderkey AS document_id, 'k' || CAST(l_partkey % 3 AS VARCHAR) AS key, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS seq, 'Party ' || CAST(l_suppkey % 5 AS VARCHAR) AS recipient, [l_returnflag, l_linestatus] AS data_shared,
  repeat('p', CAST(l_quantity AS INTEGER) % 6 + 1) AS purpose, ['low', 'medium', 'high', 'odd'][CAST(l_partkey % 4 AS INTEGER) + 1] AS risk_level, l_returnflag = 'R' AS third_party, CAST(l_quantity AS INTEGER) AS minimum_age, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE 'unclear' END AS opt_out_available FROM lineitem)"""


def items(spark, sf_dir):
    n = F.col("l_quantity").cast("int")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.concat(F.lit("k"), (F.col("l_partkey") % 3).cast("string")).alias("key"), (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("seq"), F.concat(F.lit("Party "), (F.col("l_suppkey") % 5).cast("string")).alias("recipient"),
        F.array("l_returnflag", "l_linestatus").alias("data_shared"), F.repeat(F.lit("p"), n % 6 + 1).alias("purpose"), F.get(F.array(*map(F.lit, ("low", "medium", "high", "odd"))), (F.col("l_partkey") % 4).cast("int")).alias("risk_level"), (F.col("l_returnflag") == "R").alias("third_party"), n.alias("minimum_age"),
        F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "R", "no").otherwise("unclear").alias("opt_out_available"))


@register(
    f"""WITH {ITEM}, u AS (SELECT document_id, key, string_agg(DISTINCT v, ',' ORDER BY v) AS data_shared FROM (SELECT document_id, key, unnest(data_shared) AS v FROM item) GROUP BY document_id, key)
    SELECT i.document_id, i.key, arg_min(recipient, seq) AS recipient, any_value(u.data_shared) AS data_shared, max(purpose) AS purpose, arg_max(risk_level, seq) FILTER (risk_level <> 'odd') AS risk_level FROM item i JOIN u ON u.document_id = i.document_id AND u.key = i.key GROUP BY i.document_id, i.key"""
)
def mrg6_third_parties(spark, sf_dir):
    merged = merge.merge_field(items(spark, sf_dir), "third_party_details")
    return merged.withColumn("data_shared", F.array_join(F.array_sort("data_shared"), ","))  # line items repeat a place in their order


@register(f"WITH {ITEM} SELECT document_id, key, bool_or(third_party) AS third_party FROM item GROUP BY ALL")
def mrg5_cookies(spark, sf_dir):
    return merge.merge_field(items(spark, sf_dir), "cookies_and_trackers")


@register(f"WITH {ITEM} SELECT document_id, max(minimum_age) AS minimum_age FROM item GROUP BY ALL")
def mrg12_children(spark, sf_dir):
    return merge.merge_field(items(spark, sf_dir), "children_policy", ("document_id",))


@register(f"WITH {ITEM} SELECT document_id, key, CASE WHEN bool_or(opt_out_available = 'yes') THEN 'yes' WHEN bool_or(opt_out_available = 'no') THEN 'no' ELSE 'unclear' END AS opt_out_available FROM item GROUP BY ALL")
def mrg11_ai_usage(spark, sf_dir):
    return merge.merge_field(items(spark, sf_dir), "ai_usage")
