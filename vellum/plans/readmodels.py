"""Queries over stored entities: lookups, projections, decisions and read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import grades, names, text, url
from vellum.functions import vocabulary as v
from vellum.operators import classify, merge, rollup, store, topics
from vellum.operators import readmodels as op
from vellum.sources.bindings import CATEGORIES, FINDINGS, JOBS, findings, jobs
from vellum.sources.tables import read

from .extracted import DUCK, ITEM, NORM, SEQ, items
from .registry import Registry
from .rollups import STANCES, products
from .storage import CANON, HOST, NORMAL, PATH, SCHEME

register = Registry()
QUERIES, ORACLE_SQL = register.queries, register.oracles

OTHERS = "'src' || CAST(doc_id % 20 AS VARCHAR)"


def members(spark, sf_dir, *columns):
    """Documents by product: the owner, and a product that the id names."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", *columns)
    return op.membership(docs, "source", F.array(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"))))


@register("SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents")
def src1_full_scan(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


@register(f"SELECT doc_id, source, product FROM (SELECT doc_id, source, unnest(list_distinct([source, {OTHERS}])) AS product FROM documents) WHERE product = 'src7' AND doc_id = 7")
def src3_lookup_in_product(spark, sf_dir):
    """One document within one product, by membership."""
    return members(spark, sf_dir).where("product = 'src7' and doc_id = 7")


@register("SELECT d.doc_id, d.lang, d.source, md5(d.text) AS digest FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def src5_scan_with_analysis(spark, sf_dir):
    """Whole documents that have an analysis."""
    done = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return read(spark, sf_dir, "documents").join(done, "doc_id", "left_semi").select("doc_id", "lang", "source", F.md5("text").alias("digest"))


@register("SELECT o_orderkey, o_orderkey % 11 AS gdpr, o_orderkey % 7 AS ccpa FROM orders")
def src7_compliance_scan(spark, sf_dir):
    """One nested field of the analyses, and no other."""
    status = F.struct((F.col("o_orderkey") % 11).alias("gdpr"), (F.col("o_orderkey") % 7).alias("ccpa"))
    stored = read(spark, sf_dir, "orders").select("o_orderkey", F.struct(status.alias("compliance_status"), F.col("o_orderpriority").alias("summary")).alias("analysis"))
    return stored.select("o_orderkey", "analysis.compliance_status.gdpr", "analysis.compliance_status.ccpa")


@register(f"SELECT product, n_domains FROM (SELECT array_to_string(string_split(lower({HOST}), '.')[-2:], '.') AS product, count(DISTINCT lower({HOST})) AS n_domains, list_distinct(list(lower({HOST}))) AS domains FROM pages GROUP BY 1) WHERE list_contains(domains, product) OR len(list_filter(domains, lambda d: starts_with(d, 'blog.'))) > 0")
def src8_products_by_domain(spark, sf_dir):
    """Products whose list of domains holds a blog or their own registered domain."""
    hosts = read(spark, sf_dir, "pages").select(url.host(F.col("url")).alias("domain")).distinct()
    p = hosts.groupBy(url.base_domain(F.col("domain")).alias("product")).agg(F.collect_set("domain").alias("domains"))
    held = F.array_contains("domains", F.col("product")) | F.exists("domains", lambda d: d.startswith("blog."))
    return p.where(held).select("product", F.size("domains").cast("long").alias("n_domains"))


@register("SELECT source AS slug, count(DISTINCT lang) < 2 OR count(*) < 3 AS thin, max(n_chars) AS longest FROM documents GROUP BY source")
def src9_thin_flags(spark, sf_dir):
    """Nested reads of the stored intelligence: its flag and one number of its overview."""
    d = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("slug")).agg(F.countDistinct("lang").alias("langs"), F.count("*").alias("n"), F.max("n_chars").alias("longest"))
    stored = d.select("slug", F.struct(((F.col("langs") < 2) | (F.col("n") < 3)).alias("thin"), F.struct("longest", "n").alias("overview")).alias("intelligence"))
    return stored.select("slug", "intelligence.thin", "intelligence.overview.longest")


@register("SELECT doc_id, coalesce(toxic, -1) AS analysis FROM documents LEFT JOIN labels USING (doc_id)")
def snk3_field_set(spark, sf_dir):
    """One field of every document set from its analysis, the others as they were."""
    new = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("analysis"))
    return store.set_field(read(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("analysis")), new, "doc_id", "analysis")


@register("SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'R' THEN 'harmful' ELSE lower(l_returnflag) END, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS stances FROM lineitem GROUP BY l_orderkey")
def snk11_bulk_update(spark, sf_dir):
    """All stances of all products rewritten in one pass."""
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("stance"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("s"))
    new = F.transform("s", lambda x: F.when(x["stance"] == "R", "harmful").otherwise(F.lower(x["stance"])))
    return rows.select("l_orderkey", F.array_join(new, ",").alias("stances"))


@register("SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS left_documents, count(*) FILTER (o_orderstatus = 'P') AS stale, bool_or(o_orderstatus = 'P') AS overview_dropped FROM orders GROUP BY o_custkey")
def snk13_deleted_documents(spark, sf_dir):
    """Deleting the pending documents of every product: citations of them turn stale, the documents go, overviews built on them are dropped."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    gone = F.col("o_orderstatus") == "P"
    return o.groupBy("o_custkey").agg(F.count_if(~gone).alias("left_documents"), F.count_if(gone).alias("stale"), F.bool_or(gone).alias("overview_dropped"))


@register(f"SELECT doc_id, source || CASE WHEN {OTHERS} <> source THEN ',' || {OTHERS} ELSE '' END || ',' || lang AS members FROM documents")
def prd2_member_names(spark, sf_dir):
    """The products of a document, the owner first, trimmed and each once."""
    other = F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"))
    names = F.array_distinct(F.filter(F.transform(F.array("source", other, "lang"), lambda x: F.trim(x)), lambda x: x != ""))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(names, ",").alias("members"))


@register(f"SELECT product, doc_id, lang FROM (SELECT doc_id, lang, unnest(list_distinct([source, {OTHERS}])) AS product FROM documents)")
def prd3_contextualised(spark, sf_dir):
    """Every document as each of its products sees it."""
    return members(spark, sf_dir, "lang").select("product", "doc_id", "lang")


STATUS = "CASE page_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 200 END"
KIND = "CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' ELSE 'text/html; charset=utf-8' END"
BODY = "CASE WHEN page_id % 3 = 0 THEN substr(html, 1, 400) ELSE html END"
PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"


@register(f"SELECT page_id, CASE WHEN s = 429 THEN false WHEN s >= 400 AND s < 500 THEN true WHEN k = 'application/pdf' THEN true WHEN s = 200 AND strlen(b) < 512 THEN true WHEN k = 'text/plain' THEN length(trim(b, ' ')) < 500 ELSE length({PLAIN}) < 500 END AS browser FROM (SELECT page_id, {STATUS} AS s, {KIND} AS k, {BODY} AS b FROM pages)")
def prd15_browser_fallback(spark, sf_dir):
    p = read(spark, sf_dir, "pages").selectExpr("page_id", f"{STATUS} AS s", f"{KIND} AS k", f"{BODY} AS b")
    return p.select("page_id", op.needs_browser(F.col("s"), F.col("k"), F.col("b")).alias("browser"))


OTHER = f"CASE page_id % 4 WHEN 0 THEN {SCHEME} || '://www.' || lower({HOST}) || '/c' || CAST(page_id AS VARCHAR) || '?utm_source=x' WHEN 1 THEN 'https://elsewhere.info/' || CAST(page_id AS VARCHAR) WHEN 2 THEN url || '#part' END"


@register(f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN {SCHEME} || '://www.' || lower({HOST}) || '/c' || CAST(page_id AS VARCHAR) ELSE own END AS url FROM (SELECT page_id, url, rtrim_one AS own FROM (SELECT page_id, url, CASE WHEN length({PATH}) > 1 AND ends_with({NORMAL}, '/') THEN substr({NORMAL}, 1, length({NORMAL}) - 1) ELSE {NORMAL} END AS rtrim_one FROM pages))")
def url10_effective_urls(spark, sf_dir):
    """The declared address where it is of the page's own registered domain."""
    u, n = F.col("url"), F.col("page_id")
    www = F.concat(url.scheme(u), F.lit("://www."), url.host(u), F.lit("/c"), n.cast("string"), F.lit("?utm_source=x"))
    candidate = F.when(n % 4 == 0, www).when(n % 4 == 1, F.concat(F.lit("https://elsewhere.info/"), n.cast("string"))).when(n % 4 == 2, F.concat(u, F.lit("#part")))
    return read(spark, sf_dir, "pages").select("page_id", op.effective_url(u, candidate).alias("url"))


@register(f"SELECT url, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, CASE WHEN length({PATH}) > 1 AND ends_with({NORMAL}, '/') THEN substr({NORMAL}, 1, length({NORMAL}) - 1) ELSE {NORMAL} END AS url FROM pages) GROUP BY url")
def ded1_first_urls(spark, sf_dir):
    """The first page of each normalised address."""
    return read(spark, sf_dir, "pages").groupBy(url.normalize(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@register("SELECT doc_id, CASE WHEN coalesce(new, '') = '' THEN 'skip' WHEN sha256(new || lang) = sha256(text || lang) THEN 'skip' ELSE 'update' END AS action FROM (SELECT doc_id, text, lang, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '' ELSE text || '!' END AS new FROM documents)")
def ded4_upsert_decision(spark, sf_dir):
    """Incoming texts: the same content is skipped, an empty one never overwrites, another updates."""
    new = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, "").otherwise(F.concat("text", F.lit("!")))
    return read(spark, sf_dir, "documents").select("doc_id", store.upsert_action(F.col("text"), new, F.col("lang")).alias("action"))


@register("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5000")
def srt5_recent_urls(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1995-01-01'").select("o_orderkey", "o_orderdate")
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5000)


@register(f"WITH {FINDINGS} SELECT product_id, category, string_agg(DISTINCT normalized_value, '|' ORDER BY normalized_value) AS stated FROM findings GROUP BY ALL")
def srt7_report_order(spark, sf_dir):
    """The findings of a topic by their value."""
    f = findings(spark, sf_dir).select("product_id", "category", "normalized_value").distinct()
    return f.groupBy("product_id", "category").agg(F.array_join(F.array_sort(F.collect_list("normalized_value")), "|").alias("stated"))


STRONG = f"regexp_matches(lower({PATH}), '{v.STRONG_PATH}')"


@register(f"SELECT page_id, strong, CAST(place AS INTEGER) AS place FROM (SELECT page_id, strong, row_number() OVER (PARTITION BY host, strong ORDER BY length(path), page_id) AS place FROM (SELECT page_id, lower({HOST}) AS host, {PATH} AS path, {STRONG} AS strong FROM pages)) WHERE place <= CASE WHEN strong THEN 200 ELSE 8 END")
def srt8_sitemap_children(spark, sf_dir):
    """Children of each site's sitemap, policy ones up to 200, others up to 8, the shortest paths first."""
    p = read(spark, sf_dir, "pages").select("page_id", url.host(F.col("url")).alias("host"), url.path(F.col("url")).alias("path"))
    p = p.withColumn("strong", F.lower("path").rlike(v.STRONG_PATH)).withColumn("group", F.concat("host", F.lit(" "), F.col("strong").cast("string")))
    kept = op.capped(p, "group", [F.length("path"), F.col("page_id")], F.when(F.col("strong"), 200).otherwise(8))
    return kept.select("page_id", "strong", "place")


@register(f"SELECT page_id, {STRONG} AS strong FROM pages")
def url6_strong_paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.lower(url.path(F.col("url"))).rlike(v.STRONG_PATH).alias("strong"))


@register(f"WITH {JOBS} SELECT * FROM (SELECT 'running' AS list, id FROM jobs WHERE status IN ('crawling', 'analyzing') ORDER BY updated_at DESC, id DESC LIMIT 8) UNION ALL SELECT * FROM (SELECT 'failed', id FROM jobs WHERE status = 'failed' ORDER BY updated_at DESC, id DESC LIMIT 20)")
def srt11_snapshot_lists(spark, sf_dir):
    """The latest running and failed jobs of a snapshot."""
    j = jobs(spark, sf_dir).select("id", "status", "updated_at")
    latest = lambda name, cond, n: j.where(cond).orderBy(F.desc("updated_at"), F.desc("id")).limit(n).select(F.lit(name).alias("list"), "id")
    return latest("running", "status in ('crawling', 'analyzing')", 8).unionAll(latest("failed", "status = 'failed'", 20))


@register("SELECT c_custkey AS id, coalesce(m, TIMESTAMP '1970-01-01') AS changed FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def srt12_sitemap_entries(spark, sf_dir):
    """Every product with the time of its overview, else that of the product."""
    m = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("m"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(m, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.coalesce("m", F.expr("timestamp_ntz '1970-01-01'")).alias("changed"))


MD = "CASE doc_id % 3 WHEN 0 THEN 'x' || chr(10) || '# Head  ' || lang || chr(10) ELSE 'no heading # here' END"
SAID = "CASE WHEN doc_id % 4 = 0 THEN '  Title ' || source || '  ' END"
ADDRESS = "'https://www.site' || CAST(doc_id % 9 AS VARCHAR) || '.org/' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'privacy-policy_page' END"


@register(f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Title ' || source WHEN doc_id % 3 = 0 THEN 'Head ' || lang WHEN doc_id % 5 = 0 THEN 'Site' || CAST(doc_id % 9 AS VARCHAR) || ' — Terms Of Use' ELSE 'Privacy Policy Page — Terms Of Use' END AS title, CASE WHEN doc_id % 4 = 0 THEN 'metadata' WHEN doc_id % 3 = 0 THEN 'markdown_header' ELSE 'url_fallback' END AS origin FROM documents")
def txt13_titles(spark, sf_dir):
    n = F.col("doc_id")
    md = F.when(n % 3 == 0, F.concat(F.lit("x\n# Head  "), "lang", F.lit("\n"))).otherwise("no heading # here")
    said = F.when(n % 4 == 0, F.concat(F.lit("  Title "), "source", F.lit("  ")))
    address = F.concat(F.lit("https://www.site"), (n % 9).cast("string"), F.lit(".org/"), F.when(n % 5 == 0, "").otherwise("privacy-policy_page"))
    t = op.title(said, md, address, F.lit("terms_of_use"))
    return read(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", "t.title", F.col("t.source").alias("origin"))


@register(f"WITH {STANCES} SELECT f.product_id, f.category, arg_min(f.value, CAST(CASE WHEN s.stance = 'fair' AND (f.category IN ('benefits', 'security', 'user_rights', 'breach_notification')) THEN 0 ELSE 1 END AS HUGEINT) * 1000000000000000000 + f.seq) AS headline FROM findings f JOIN stances s USING (product_id, category) GROUP BY ALL")
def txt15_headlines(spark, sf_dir):
    """The finding that stands for each topic."""
    from .rollups import top1_topic_stances

    return op.headlines(findings(spark, sf_dir), top1_topic_stances(spark, sf_dir))


WORDS = ("license", "version", "ering", "tion", "und", "les", "ado", "ción")


@register("SELECT doc_id, length(coalesce(text, '')) >= 300 AND (" + " + ".join(f"CASE WHEN contains(lower(substr(text, 1, 2000)), '{w}') THEN 1 ELSE 0 END" for w in WORDS) + ") >= 3 AS supported FROM documents")
def cls3_policy_guard(spark, sf_dir):
    """Whether a text has the body and vocabulary that a broad class needs."""
    return read(spark, sf_dir, "documents").select("doc_id", classify.substantive(F.col("text"), WORDS).alias("supported"))


@register(f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('# T ' || coalesce(text, ''), '(?s)```.*?```', ' ', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^#{{1,6}}\\s+', '', 'g'), '[*_`~]+', '', 'g'), '(?m)^\\s*[-+>]\\s+', '', 'g'), '\\S+'), lambda x: true)[1:3], ' ') AS head FROM documents")
def txt4_markdown_text(spark, sf_dir):
    """The first words of each text as Markdown without its marks."""
    plain = text.markdown_to_text(F.concat(F.lit("# T "), F.coalesce("text", F.lit(""))))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.regexp_extract_all(plain, F.lit(r"(\S+)"), F.lit(1)), 1, 3), " ").alias("head"))


@register(
    """WITH d AS (SELECT l_orderkey, ['transparency', 'data_collection_scope', 'user_control', 'third_party_sharing', 'data_retention_score', 'security_score', 'other'][CAST(l_linenumber % 7 AS INTEGER) + 1] AS dim, ['A', 'B', 'C', 'D', 'E'][CAST(l_partkey % 5 AS INTEGER) + 1] AS grade FROM lineitem WHERE l_suppkey % 4 > 0),
    w AS (SELECT l_orderkey, CASE grade WHEN 'A' THEN 9 WHEN 'B' THEN 7 WHEN 'C' THEN 5 WHEN 'D' THEN 3 ELSE 1 END AS s, CASE dim WHEN 'transparency' THEN 14 WHEN 'data_collection_scope' THEN 26 WHEN 'user_control' THEN 18 WHEN 'third_party_sharing' THEN 24 WHEN 'data_retention_score' THEN 10 WHEN 'security_score' THEN 8 END AS w FROM d WHERE dim <> 'other'),
    m AS (SELECT l_orderkey, round_even(sum(s * w) / sum(w), 0) AS m FROM w GROUP BY l_orderkey),
    g AS (SELECT o_orderkey, CASE WHEN o_custkey % 6 < 5 THEN o_custkey % 6 + 1 END AS p, CASE WHEN m >= 8 THEN 1 WHEN m >= 6 THEN 2 WHEN m >= 4 THEN 3 WHEN m >= 2 THEN 4 WHEN m IS NOT NULL THEN 5 END AS d FROM orders LEFT JOIN m ON l_orderkey = o_orderkey),
    f AS (SELECT o_orderkey, CASE WHEN p IS NULL OR d IS NULL THEN coalesce(p, d) ELSE least(greatest(p, d - 1), d + 1) END AS g FROM g)
    SELECT o_orderkey, substr('ABCDE', CAST(g AS INTEGER), 1) AS grade, ['very_user_friendly', 'user_friendly', 'moderate', 'pervasive', 'very_pervasive'][CAST(g AS INTEGER)] AS verdict, CAST(g * 2 - 1 AS INTEGER) AS risk FROM f"""
)
def cls11_document_grades(spark, sf_dir):
    """Grade, verdict and risk of each document from its justified dimensions and the proposed grade."""
    letters = F.array(*map(F.lit, "ABCDE"))
    names = F.array(*map(F.lit, [*grades.DIMENSION_WEIGHTS, "other"]))
    d = read(spark, sf_dir, "lineitem").where("l_suppkey % 4 > 0").select(F.col("l_orderkey").alias("o_orderkey"), F.get(names, (F.col("l_linenumber") % 7).cast("int")).alias("dim"), F.get(letters, (F.col("l_partkey") % 5).cast("int")).alias("g")).where("dim <> 'other'")
    mean = topics.weighted(grades.user_score(F.col("g")), grades.lookup(F.col("dim"), grades.DIMENSION_WEIGHTS))
    derived = d.groupBy("o_orderkey").agg(mean.alias("m")).select("o_orderkey", grades.of_user_score(F.col("m")).alias("derived"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.get(letters, (F.col("o_custkey") % 6).cast("int")).alias("proposed")).join(derived, "o_orderkey", "left")
    return op.document_grades(o).select("o_orderkey", "grade", "verdict", "risk")


@register(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, event_type IN ('error', 'view') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, n, true AS allowed, 'closed' AS state, CASE WHEN bad THEN 1 ELSE 0 END AS fails, CASE WHEN bad THEN t ELSE 0.0 END AS last, false AS opened FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.event_id, e.n, NOT opened OR e.t - last >= 36000, CASE WHEN NOT opened THEN 'closed' WHEN e.t - last >= 36000 THEN 'half_open' ELSE 'open' END,
        CASE WHEN opened AND e.t - last < 36000 THEN fails WHEN bad THEN fails + 1 ELSE 0 END, CASE WHEN (NOT opened OR e.t - last >= 36000) AND bad THEN e.t ELSE last END, CASE WHEN opened AND e.t - last < 36000 THEN true WHEN bad THEN fails + 1 >= 3 ELSE false END
      FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT event_id, allowed, state FROM r"""
)
def str5_breaker_states(spark, sf_dir):
    """Each user's requests through a breaker of three failures and ten hours."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_type").isin("error", "view").alias("failed"))
    return op.breaker(e, "user_id", "at", "failed", "event_id", threshold=3, reset=36000.0).select("event_id", "allowed", "state")


@register("SELECT event_id, json_valid(props) AND json_type(props) = 'OBJECT' AS valid FROM events")
def udf4_valid_answers(spark, sf_dir):
    """Whether stored answers are objects, as a predicate."""
    return read(spark, sf_dir, "events").select("event_id", F.expr("coalesce(schema_of_variant(try_parse_json(props)) like 'OBJECT%', false)").alias("valid"))


@register(f"WITH {STANCES}, c AS (SELECT product_id, category, count(DISTINCT document_id) FILTER (evidence > 0) AS cited FROM findings GROUP BY ALL) SELECT s.product_id, s.category, s.stance, coalesce(c.cited, 0) AS cited_documents, s.evidence_count FROM stances s LEFT JOIN c USING (product_id, category)")
def top3_topic_breakdown(spark, sf_dir):
    """Topics of overviews with the documents they cite."""
    from .rollups import top1_topic_stances

    cited = findings(spark, sf_dir).where("evidence > 0").groupBy("product_id", "category").agg(F.countDistinct("document_id").alias("cited"))
    return top1_topic_stances(spark, sf_dir).join(cited, ["product_id", "category"], "left").select("product_id", "category", "stance", F.coalesce("cited", F.lit(0)).alias("cited_documents"), "evidence_count")


@register("SELECT source AS slug, count(*) AS total, count(*) FILTER (quality = 1) AS analyzed, string_agg(DISTINCT lang, ',' ORDER BY lang) AS types, CAST(round_even(avg(doc_id % 11), 0) AS INTEGER) AS gdpr FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def top4_overview_read(spark, sf_dir):
    """What an overview shows beside the stored text: counts, types and mean compliance."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy(F.col("source").alias("slug")).agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("analyzed"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("types"), F.bround(F.avg(F.col("doc_id") % 11)).cast("int").alias("gdpr"))


@register("SELECT doc_id, lang AS doc_type, CASE WHEN length(text) > 220 THEN rtrim(substr(text, 1, 217)) || '...' ELSE text END AS summary, quality IS NOT NULL AS analyzed FROM documents LEFT JOIN labels USING (doc_id)")
def top7_document_summaries(spark, sf_dir):
    """Summary rows of documents."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.col("lang").alias("doc_type"), text.truncate(F.col("text")).alias("summary"), F.col("quality").isNotNull().alias("analyzed"))


@register(f"WITH {ITEM}, v AS (SELECT document_id, value, min(seq) AS s FROM item GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY s) AS n FROM v), d AS (SELECT document_id, data_type, min(seq) AS s FROM item WHERE trim(data_type) <> '' GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY s) AS n FROM d) SELECT o.document_id, coalesce(a, '') AS points, coalesce(b, '') AS collected FROM own o LEFT JOIN (SELECT document_id, string_agg(value, '|' ORDER BY n) AS a FROM r WHERE n <= 3 GROUP BY 1) USING (document_id) LEFT JOIN (SELECT document_id, string_agg(data_type, '|' ORDER BY n) AS b FROM e WHERE n <= 2 GROUP BY 1) USING (document_id)")
def top8_packed_inputs(spark, sf_dir):
    """What a model is given of each document: the first few values of each field."""
    i = items(spark, sf_dir, "value", "data_type")
    once = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]))
    rows = i.groupBy("document_id").agg(once("value").alias("v"), F.filter(once("data_type"), lambda x: F.trim(x) != "").alias("d"))
    return rows.select("document_id", F.array_join(F.slice("v", 1, 3), "|").alias("points"), F.array_join(F.slice("d", 1, 2), "|").alias("collected"))


@register(f"WITH {STANCES}, r AS (SELECT product_id, count(*) FILTER (stance = 'harmful') AS harmful, count(*) FILTER (status = 'found') AS found FROM stances GROUP BY product_id), d AS (SELECT product_id, count(DISTINCT document_id) AS documents FROM findings GROUP BY product_id) SELECT r.product_id, harmful, found, coalesce(documents, 0) AS documents FROM r LEFT JOIN d USING (product_id)")
def top9_level_two(spark, sf_dir):
    """The second level of a product: its stances and its documents."""
    from .rollups import top1_topic_stances

    r = top1_topic_stances(spark, sf_dir).groupBy("product_id").agg(F.count_if(F.col("stance") == "harmful").alias("harmful"), F.count_if(F.col("status") == "found").alias("found"))
    d = findings(spark, sf_dir).groupBy("product_id").agg(F.countDistinct("document_id").alias("documents"))
    return r.join(d, "product_id", "left").select("product_id", "harmful", "found", F.coalesce("documents", F.lit(0)).alias("documents"))


@register(f"WITH {STANCES} SELECT product_id, count(*) FILTER (status = 'missing' AND stance <> 'not_disclosed') AS silent_but_judged, count(*) FILTER (status = 'found' AND evidence_count = 0) AS uncited FROM stances GROUP BY product_id")
def top10_rollout_checks(spark, sf_dir):
    """What a rollout must not show: judged silence, and findings without a citation."""
    from .rollups import top1_topic_stances

    s = top1_topic_stances(spark, sf_dir)
    return s.groupBy("product_id").agg(F.count_if((F.col("status") == "missing") & (F.col("stance") != "not_disclosed")).alias("silent_but_judged"), F.count_if((F.col("status") == "found") & (F.col("evidence_count") == 0)).alias("uncited"))


FIELDS = {"text_items": "value", "international_transfers": "destination", "user_rights": "right_type"}


@register(f"WITH {ITEM}" + ", ".join([""] + [f"{f}_k AS (SELECT DISTINCT document_id, {NORM.format(c)} AS key FROM item WHERE trim({c}) <> '')" for f, c in FIELDS.items()]) + " SELECT document_id, field, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT document_id, '{f}' AS field FROM {f}_k" for f in FIELDS) + ") GROUP BY ALL")
def agg35_merged_extractions(spark, sf_dir):
    """All fields of an extraction merged by their own policies, and how many items each document keeps."""
    i = items(spark, sf_dir, "value", "materiality", "destination", "mechanism", "data_types", "right_type", "description")
    i = merge.dealt(i, "document_id")
    parts = [merge.merge_field(merge.keyed(i, f), f).groupBy("document_id").agg(F.count("*").alias("n")).select("document_id", F.lit(f).alias("field"), "n") for f in FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Site names as pages give them: the host's own name with what sites add to it.
TAILS = (" Blog", " Legal Group", " — Privacy Policy", "®", ", Inc.", " Transparency Center", " Cloud View", "", " | Help Center")
LABEL = f"string_split(lower({HOST}), '.')[-2]"
RAW = f"CASE WHEN page_id % 11 = 0 THEN 'Privacy Policy' WHEN page_id % 11 = 1 THEN 'Aug 2022' ELSE upper(substr({LABEL}, 1, 1)) || substr({LABEL}, 2) || {[*TAILS]}[CAST(page_id % {len(TAILS)} AS INTEGER) + 1] END"
IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
EDGE = f"regexp_replace({{}}, '{names.EDGES}', '', 'g')"


def brand_sql(name: str) -> str:
    """The cleaned name, by the same patterns."""
    out = EDGE.format(f"trim(regexp_replace({name}, '\\s+', ' ', 'g'), ' ')")
    for marks in ("[,.]+$", "[®™©℠]+$", "[,.]+$"):
        out = EDGE.format(f"regexp_replace({out}, '{marks}', '')")
    return out


BRANDS = f"""
raw AS (SELECT page_id, lower({HOST}) AS host, {LABEL} AS slug, {RAW} AS name FROM pages),
cut AS (SELECT *, {brand_sql('name')} AS w FROM raw),
parts AS (SELECT *, regexp_split_to_array(w, '{names.BREAKS}') AS p FROM cut),
kept AS (SELECT *, list_filter(p, lambda x: x <> '' AND lower(x) NOT IN {IN(names.SECTIONS)}) AS k FROM parts),
own AS (SELECT *, CASE WHEN len(k) > 0 AND len(k) < len(p) THEN {EDGE.format("array_to_string(k, ' - ')")} ELSE w END AS o FROM kept),
cleaned AS (SELECT *, regexp_replace({EDGE.format(f"CASE WHEN regexp_matches(o, '{names.ONLY_ENDINGS}') THEN '' ELSE regexp_replace(o, '{names.ENDINGS}', '') END")}, '[,.]+$', '') AS brand FROM own),
tokens AS (SELECT *, regexp_replace(lower(brand), '[^a-z0-9]', '', 'g') AS token, regexp_replace(lower(slug), '[^a-z0-9]', '', 'g') AS key, regexp_split_to_array(lower(brand), '\\s+') AS words FROM cleaned),
brands AS (SELECT page_id, host, name, brand, length(brand) BETWEEN 2 AND 60 AND lower(brand) NOT IN {IN(names.PLACEHOLDERS)} AND NOT contains(brand, '://') AND NOT starts_with(brand, 'www.') AND NOT regexp_matches(brand, '^[0-9.]*[0-9][0-9.]*$') AND NOT regexp_matches(brand, '{names.DATE}') AND NOT regexp_matches(brand, '^[A-Z]{{2}}$')
  AND len(words) <= 2 AND NOT (len(words) > 1 AND len(list_filter(words, lambda x: x IN {IN(names.DESCRIPTIVE)})) > 0)
  AND token <> '' AND key <> '' AND (contains(token, key) OR contains(key, token) OR (length(key) >= 4 AND regexp_matches(token, array_to_string(string_split(key, ''), '.*')))) AS ok FROM tokens)"""


def brands(spark, sf_dir):
    host = url.host(F.col("url"))
    label = F.element_at(F.split(host, r"\."), -2)
    tail = F.get(F.array(*map(F.lit, TAILS)), (F.col("page_id") % len(TAILS)).cast("int"))
    name = F.when(F.col("page_id") % 11 == 0, "Privacy Policy").when(F.col("page_id") % 11 == 1, "Aug 2022").otherwise(F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 100), tail))
    p = read(spark, sf_dir, "pages").select("page_id", host.alias("host"), label.alias("slug"), name.alias("name"))
    p = p.withColumn("brand", names.clean(F.col("name")))
    return p.withColumn("ok", names.acceptable(F.col("brand"), F.col("slug")))


@register(f"WITH {BRANDS} SELECT page_id, brand, ok FROM brands")
def txt14_brand_names(spark, sf_dir):
    """The cleaned site name of every page, and whether it may be the product's name."""
    return brands(spark, sf_dir).select("page_id", "brand", "ok")


@register(f"WITH {BRANDS}, votes AS (SELECT host, brand, count(*) AS n, min(page_id) AS s FROM brands WHERE ok GROUP BY ALL), best AS (SELECT host, brand FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, s) AS place FROM votes) WHERE place = 1), now AS (SELECT host, arg_min(brand, page_id) AS name, arg_min(ok, page_id) AS ok FROM brands GROUP BY host) SELECT host, name, CASE WHEN NOT ok THEN b.brand END AS corrected FROM now LEFT JOIN best b USING (host)")
def prd26_corrected_names(spark, sf_dir):
    """Products whose name is bad, and what their documents' names say instead."""
    b = brands(spark, sf_dir)
    votes = b.where("ok").groupBy("host", "brand").agg(F.count("*").alias("n"), F.min("page_id").alias("s"))
    best = votes.groupBy("host").agg(F.max_by("brand", F.struct("n", -F.col("s"))).alias("best"))
    now = b.groupBy("host").agg(F.min_by(F.struct("brand", "ok"), "page_id").alias("x"))
    return now.join(best, "host", "left").select("host", F.col("x.brand").alias("name"), F.when(~F.col("x.ok"), F.col("best")).alias("corrected"))
