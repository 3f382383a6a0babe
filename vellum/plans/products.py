"""Queries over products, links and read models."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import coerce, grades, url
from vellum.operators import products as op
from vellum.operators import rollup
from vellum.sources.bindings import CATEGORIES, FINDINGS, JOBS, findings, jobs
from vellum.sources.tables import read

from .registry import Registry
from .rollups import COVERAGE
from .rollups import products as product_rows
from .storage import HOST, LOCALE, PATH, SCHEME, WAY

register = Registry()
QUERIES, ORACLE_SQL = register.queries, register.oracles


@register("SELECT count(*) FILTER (length(coalesce(text, '')) >= 200) AS accepted, count(*) FILTER (length(coalesce(text, '')) < 200) AS rejected FROM documents")
def snk1_validated_append(spark, sf_dir):
    """What a validated append takes and refuses, counted in one pass."""
    marked = op.marked(read(spark, sf_dir, "documents").select(F.length("text").alias("n")), F.col("n") >= 200)
    return marked.agg(F.count_if("_ok").alias("accepted"), F.count_if(~F.col("_ok")).alias("rejected"))


@register("SELECT product, string_agg(seed, ',' ORDER BY seed) AS seeds FROM (SELECT DISTINCT source AS product, 'https://' || source || '.org/' || lang AS seed FROM documents) GROUP BY product")
def snk5_added_seeds(spark, sf_dir):
    """SNK-5 and SNK-14: array-set appends."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("product"), F.concat(F.lit("https://"), "source", F.lit(".org/"), "lang").alias("seed"))
    return d.groupBy("product").agg(F.array_join(F.array_sort(F.collect_set("seed")), ",").alias("seeds"))


@register("SELECT count(*) FILTER (t IS NULL) AS added, count(*) FILTER (s IS NOT NULL AND t IS NOT NULL) AS replaced, count(*) FILTER (s IS NULL) AS removed FROM (SELECT o_orderkey AS s FROM orders WHERE o_orderstatus <> 'P') FULL JOIN (SELECT o_orderkey AS t FROM orders WHERE o_orderpriority <> '1-URGENT') ON s = t")
def snk8_promotion_counts(spark, sf_dir):
    """What replacing the published orders (all but urgent ones) by the settled ones would change."""
    o = read(spark, sf_dir, "orders")
    return op.promotion(o.where("o_orderstatus <> 'P'").select("o_orderkey"), o.where("o_orderpriority <> '1-URGENT'").select("o_orderkey"), "o_orderkey")


@register("SELECT user_id AS job, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS fetched, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM events GROUP BY user_id")
def snk15_counters(spark, sf_dir):
    """Counters as sums of appended deltas."""
    one = lambda t: F.sum(F.when(F.col("event_type") == t, 1).otherwise(0)).cast("long")
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(one("click").alias("fetched"), one("error").alias("failed"))


@register("SELECT c_custkey AS id, lower(replace(c_name, '#', '-')) AS slug, c_mktsegment AS category FROM customer")
def snk16_renamed_columns(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.withColumnsRenamed({"c_custkey": "id", "c_mktsegment": "category"}).select("id", F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("slug"), "category")


@register("SELECT p_partkey, p_name FROM part WHERE p_partkey = 7")
def src2_point_lookup(spark, sf_dir):
    return read(spark, sf_dir, "part").where("p_partkey = 7").select("p_partkey", "p_name").limit(1)


@register("SELECT doc_id, lang, source, n_chars FROM documents WHERE source = 'src3'")
def src4_light_scan(spark, sf_dir):
    """All columns but the heavy one of one product's documents."""
    return read(spark, sf_dir, "documents").where("source = 'src3'").drop("text")


@register("SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def src6_by_type(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id", "lang")


ADMIT = f"""CASE WHEN page_id % 8 > 5 THEN 'too_deep' WHEN {SCHEME} <> 'https' THEN 'scheme' WHEN regexp_matches(lower({HOST}), '(^|[.-])(internal|staging|preview)($|\\.)') THEN 'mirror'
  WHEN lower({HOST}) = 'example.net' OR ends_with(lower({HOST}), '.example.net') THEN 'denied_domain' WHEN NOT (lower({HOST}) = 'example.com' OR ends_with(lower({HOST}), '.example.com')) THEN 'other_domain' END"""


@register(f"SELECT page_id, {ADMIT} AS reason FROM pages")
def prd11_url_admission(spark, sf_dir):
    reason = op.admit_url(F.col("url"), F.col("page_id") % 8, F.array(F.lit("example.com")), F.array(F.lit("example.net")))
    return read(spark, sf_dir, "pages").select("page_id", reason.alias("reason"))


@register(f"SELECT page_id, turn FROM (SELECT page_id, CAST(row_number() OVER (PARTITION BY lower({HOST}) ORDER BY CASE WHEN regexp_matches({PATH}, '(?i)(privacy|terms|legal|policy)') THEN 0 ELSE 1 END, length(url) DESC, url, page_id) AS INTEGER) AS turn FROM pages) WHERE turn <= 5")
def srt9_frontier(spark, sf_dir):
    links = read(spark, sf_dir, "pages").select("page_id", "url", url.host(F.col("url")).alias("site"), F.length("url").alias("score"))
    order = W.partitionBy("site").orderBy(F.when(url.path(F.col("url")).rlike("(?i)(privacy|terms|legal|policy)"), 0).otherwise(1), F.desc("score"), "url", "page_id")
    return links.withColumn("turn", F.row_number().over(order)).where("turn <= 5").select("page_id", "turn")


@register(f"SELECT host, arg_min(page_id, CAST({LOCALE} AS INTEGER) * 100000000 + length({WAY}) * 1000 + page_id / 100000.0) AS page_id FROM (SELECT *, lower({HOST}) AS host FROM pages) GROUP BY host")
def win3_most_canonical_page(spark, sf_dir):
    """WIN-2, WIN-3 and SRT-10: the page of each site with the most canonical URL."""
    rank = url.canonical_rank(F.col("url"))
    return read(spark, sf_dir, "pages").groupBy(url.host(F.col("url")).alias("host")).agg(F.min_by("page_id", F.struct(rank.alias("r"), F.col("page_id").alias("p"))).alias("page_id"))


@register(
    """WITH n AS (SELECT o_custkey, o_orderkey AS seq, CAST(o_orderkey % 3 AS INTEGER) AS priority, 'Name ' || CAST(o_orderkey % 4 AS VARCHAR) AS name FROM orders),
    c AS (SELECT o_custkey, priority, name, count(*) AS n, min(seq) AS seq FROM n GROUP BY ALL)
    SELECT o_custkey, name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY priority, n DESC, seq) AS rn FROM c) WHERE rn = 1"""
)
def agg33_name_vote(spark, sf_dir):
    n = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3).cast("int").alias("priority"), F.concat(F.lit("Name "), (F.col("o_orderkey") % 4).cast("string")).alias("name"))
    return op.vote(n, "o_custkey")


@register(
    """WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS critical, count(*) FILTER (l_returnflag = 'A') AS good, ['A', 'B', 'C', 'D', 'E'][CAST(l_orderkey % 5 AS INTEGER) + 1] AS g FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, substr('ABCDE', CAST(CASE WHEN critical >= 2 THEN 5 WHEN critical = 1 THEN greatest(instr('ABCDE', g), 4) WHEN good >= 2 THEN greatest(instr('ABCDE', g) - 1, 1) ELSE instr('ABCDE', g) END AS INTEGER), 1) AS grade FROM l"""
)
def agg34_finding_floor(spark, sf_dir):
    letter = F.get(F.array(*map(F.lit, "ABCDE")), (F.col("l_orderkey") % 5).cast("int"))
    c = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("critical"), F.count_if(F.col("l_returnflag") == "A").alias("good"))
    return c.select("l_orderkey", op.finding_floor(F.col("critical"), F.col("good"), letter).alias("grade"))


@register("SELECT count(DISTINCT source) AS products, count(*) AS documents, count(quality) AS analyzed, count(*) FILTER (toxic = 1) AS flagged FROM documents LEFT JOIN labels USING (doc_id)")
def agg36_totals(spark, sf_dir):
    j = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return j.agg(F.countDistinct("source").alias("products"), F.count("*").alias("documents"), F.count("quality").alias("analyzed"), F.count_if(F.col("toxic") == 1).alias("flagged"))


@register("SELECT user_id, CAST(least(100, floor((least(n, 3) + 0.5) * 100 / 3)) AS INTEGER) AS percent FROM (SELECT user_id, count(*) FILTER (event_type = 'signup') AS n FROM events GROUP BY user_id)")
def agg40_progress(spark, sf_dir):
    steps = F.slice(F.array_compact(F.collect_list(F.when(F.col("event_type") == "signup", "completed"))), 1, 3)
    return read(spark, sf_dir, "events").groupBy("user_id").agg(op.progress(steps, F.lit(0.5)).alias("percent"))


@register("SELECT doc_id, CAST(round_even((n_chars % 11 + doc_id % 7) / 2.0, 0) AS INTEGER) AS risk FROM documents")
def agg22_mean_of_map(spark, sf_dir):
    by = F.create_map(F.lit("a"), F.col("n_chars") % 11, F.lit("b"), F.col("doc_id") % 7)
    mean = F.aggregate(F.map_values(by), F.lit(0).cast("long"), lambda a, x: a + x) / F.size(by)
    return read(spark, sf_dir, "documents").select("doc_id", F.bround(mean).cast("int").alias("risk"))


@register("SELECT source, doc_id, md5(min(lang)) AS hash FROM documents GROUP BY source, doc_id")
def agg25_source_hashes(spark, sf_dir):
    """The map of document hashes of each product, a row an entry: a source may hold any number of documents."""
    return read(spark, sf_dir, "documents").groupBy("source", "doc_id").agg(F.md5(F.min("lang")).alias("hash"))


@register(
    """SELECT o_orderkey, greatest(0, least(10, greatest(greatest(d, CASE g WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 7 ELSE 9 END, t) - least(a, 2), f))) AS risk
    FROM (SELECT o_orderkey, d, t, a, f, least(greatest(p, e - 1), e + 1) AS g FROM (SELECT o_orderkey, o_orderkey % 11 AS d, o_orderkey % 5 + 1 AS p, o_custkey % 11 AS t, o_custkey % 4 AS a, CASE WHEN o_orderkey % 9 = 0 THEN 7 ELSE 0 END AS f,
      CASE WHEN o_orderkey % 11 <= 2 THEN 1 WHEN o_orderkey % 11 <= 4 THEN 2 WHEN o_orderkey % 11 <= 6 THEN 3 WHEN o_orderkey % 11 <= 8 THEN 4 ELSE 5 END AS e FROM orders))"""
)
def cls10_reconciled_risk(spark, sf_dir):
    proposed = F.get(F.array(*map(F.lit, "ABCDE")), (F.col("o_orderkey") % 5).cast("int"))
    risk = op.reconciled(F.col("o_orderkey") % 11, proposed, F.col("o_custkey") % 11, F.col("o_custkey") % 4, F.when(F.col("o_orderkey") % 9 == 0, 7).otherwise(0))
    return read(spark, sf_dir, "orders").select("o_orderkey", risk.alias("risk"))


@register("SELECT l_orderkey, l_linenumber, l_partkey, CASE lower(trim(v)) WHEN 'yes' THEN 'yes' WHEN 'true' THEN 'yes' WHEN '1' THEN 'yes' WHEN 'no' THEN 'no' WHEN '0' THEN 'no' WHEN 'unknown' THEN 'unclear' WHEN '' THEN 'unclear' END AS answer FROM (SELECT *, ['Yes', ' TRUE', '1', 'no ', '0', 'unknown', '', 'maybe'][CAST(l_partkey % 8 AS INTEGER) + 1] AS v FROM lineitem)")
def cls8_yes_no_unclear(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, ("Yes", " TRUE", "1", "no ", "0", "unknown", "", "maybe"))), (F.col("l_partkey") % 8).cast("int"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", coerce.yes_no_unclear(raw).alias("answer"))


@register(f"SELECT page_id AS id, product_id, CASE WHEN p1 IS NOT NULL THEN 'exact' WHEN p2 IS NOT NULL THEN 'base' END AS tier FROM (SELECT p.page_id, coalesce(a.m, b.m) AS product_id, a.m AS p1, b.m AS p2 FROM (SELECT page_id, regexp_replace(lower({HOST}), '^www\\.', '') AS d FROM pages) p LEFT JOIN (SELECT regexp_replace(lower({HOST}), '^www\\.', '') AS d, min(page_id) AS m FROM pages WHERE {SCHEME} = 'https' GROUP BY 1) a ON a.d = p.d LEFT JOIN (SELECT array_to_string(string_split(lower({HOST}), '.')[-2:], '.') AS b, min(page_id) AS m FROM pages WHERE {SCHEME} = 'https' GROUP BY 1) b ON b.b = array_to_string(string_split(p.d, '.')[-2:], '.'))")
def jon11_domain_match(spark, sf_dir):
    """The product of every page, the first secure page of a domain standing for its product."""
    p = read(spark, sf_dir, "pages").select("page_id", F.col("url"), url.host(F.col("url")).alias("domain"))
    return op.domain_match(p.select(F.col("page_id").alias("id"), "domain"), p.where("url like 'https://%'").select(F.col("page_id").alias("product_id"), "domain"))


@register(f"WITH {JOBS} SELECT j.id, coalesce('https://' || c_name, 'none') AS url FROM jobs j LEFT JOIN customer ON 'p' || c_custkey = j.product_slug WHERE j.status = 'completed'")
def jon13_recrawl_urls(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("product_slug"), F.concat(F.lit("https://"), "c_name").alias("base"))
    return jobs(spark, sf_dir).where("status = 'completed'").join(c, "product_slug", "left").select("id", F.coalesce("base", F.lit("none")).alias("url"))


@register(f"WITH {JOBS} SELECT j.id, e.user_id AS subscriber FROM (SELECT product_slug, max(id) AS id FROM jobs WHERE status = 'completed' GROUP BY product_slug) j JOIN (SELECT DISTINCT user_id, 'p' || user_id AS product_slug FROM events WHERE event_type = 'view') e USING (product_slug) ORDER BY e.user_id, j.id LIMIT 500")
def jon15_notifications(spark, sf_dir):
    done = jobs(spark, sf_dir).where("status = 'completed'").groupBy("product_slug").agg(F.max("id").alias("id"))
    subs = read(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("subscriber"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("product_slug")).distinct()
    return done.join(subs, "product_slug").select("id", "subscriber").orderBy("subscriber", "id").limit(500)


@register(f"WITH {JOBS} SELECT t.event_id AS id FROM events t LEFT JOIN (SELECT * FROM jobs WHERE value >= 20) j ON j.id = t.event_id WHERE j.status IS NOT NULL AND j.status NOT IN ('crawling', 'analyzing', 'generating')")
def jon16_tasks_to_stop(spark, sf_dir):
    """Tasks whose job has ended, a task an event; those whose job is unknown (of small value) go on."""
    known = jobs(spark, sf_dir).where("value >= 20").select("id", "status")
    return op.ended(read(spark, sf_dir, "events").select(F.col("event_id").alias("id")), known).select("id")


@register("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def jon17_hydrated_ids(spark, sf_dir):
    ids = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return read(spark, sf_dir, "supplier").join(ids, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@register(f"WITH {FINDINGS}, {COVERAGE}, s AS (SELECT product_id, category, count(*) AS n, count(DISTINCT document_id) AS d FROM findings WHERE evidence > 1 GROUP BY ALL) SELECT c.product_id, c.category, CASE WHEN c.status = 'found' AND s.n IS NULL THEN 'not_disclosed' ELSE c.status END AS status, coalesce(s.n, 0) AS n_citations, coalesce(s.d, 0) AS n_documents FROM coverage c LEFT JOIN s USING (product_id, category)")
def top2_topic_report(spark, sf_dir):
    f = findings(spark, sf_dir)
    spans = f.withColumn("quote", F.when(F.col("evidence") > 1, F.col("value")).otherwise(""))
    return op.report(spans, rollup.coverage(f, product_rows(spark, sf_dir), CATEGORIES))


@register("SELECT o_orderkey FROM orders WHERE list_sort(list_distinct([o_custkey % 3, o_orderkey % 3])) = list_sort(list_distinct([o_orderkey % 3, o_custkey % 5]))")
def set3_equal_sets(spark, sf_dir):
    same = lambda *c: F.array_sort(F.array_distinct(F.array(*c)))
    a, b, c = F.col("o_custkey") % 3, F.col("o_orderkey") % 3, F.col("o_custkey") % 5
    return read(spark, sf_dir, "orders").where(same(a, b) == same(b, c)).select("o_orderkey")


@register("SELECT source, string_agg(lang, ',' ORDER BY lang) AS langs FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source")
def set6_language_union(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@register("SELECT doc_id, array_to_string(CASE WHEN len(d) > 0 THEN d[1:3] WHEN len(r) > 0 THEN r[1:3] ELSE k[1:3] END, '|') AS concerns FROM (SELECT doc_id, k, list_filter(k, lambda x: contains(lower(x), 'share')) AS r, CASE WHEN doc_id % 4 = 0 THEN ['danger ' || lang] ELSE [] END AS d FROM (SELECT doc_id, lang, [lang || ' point', 'they share ' || source, 'length ' || CAST(n_chars % 9 AS VARCHAR)] AS k FROM documents))")
def prd21_concerns(spark, sf_dir):
    points = F.array(F.concat("lang", F.lit(" point")), F.concat(F.lit("they share "), "source"), F.concat(F.lit("length "), (F.col("n_chars") % 9).cast("string")))
    dangers = F.when(F.col("doc_id") % 4 == 0, F.array(F.concat(F.lit("danger "), "lang"))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(op.concerns(dangers, points), "|").alias("concerns"))


@register("SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name ORDER BY lower(n_name) LIMIT 10 OFFSET 5")
def srt1_paged_list(spark, sf_dir):
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "nation").join(c, "n_nationkey").select("n_name", "n").orderBy(F.lower("n_name")).offset(5).limit(10)


@register("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'A' WHEN c_acctbal >= 8000 THEN 'A' WHEN c_acctbal >= 5000 THEN 'B' WHEN c_acctbal >= 2000 THEN 'C' WHEN c_acctbal >= 0 THEN 'D' ELSE 'E' END AS grade FROM customer")
def top6_reconciled_grade(spark, sf_dir):
    """An explainer's grade gives way to the overview's where there is one."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    overview = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("a").alias("overview"))
    own = F.when(F.col("c_acctbal") >= 8000, "A").when(F.col("c_acctbal") >= 5000, "B").when(F.col("c_acctbal") >= 2000, "C").when(F.col("c_acctbal") >= 0, "D").otherwise("E")
    return c.join(overview, "c_custkey", "left").select("c_custkey", grades.coerce(F.coalesce("overview", own)).alias("grade"))
