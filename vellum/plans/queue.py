"""Queries over the job queue."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators import jobs as op
from vellum.operators import scans
from vellum.sources.bindings import JOBS, jobs
from vellum.sources.tables import read

from .registry import Registry

register = Registry()
QUERIES, ORACLE_SQL = register.queries, register.oracles

ERROR_CLASS = "CASE WHEN lower(coalesce(error, '')) LIKE '%robots%' THEN 'robots' WHEN regexp_matches(lower(coalesce(error, '')), 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(lower(coalesce(error, '')), 'connection|dns|network|ssl') THEN 'network' WHEN status_code >= 400 THEN 'http_error' ELSE 'unknown' END"
HARD = "(coalesce(status_code IN (401, 403, 407, 451), false) OR regexp_matches(lower(coalesce(error, '')), 'forbidden|unauthorized|access denied|captcha|bot wall|legal reasons'))"
NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")


@register("SELECT event_id, ts FROM (SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 5000)")
def prd4_recent_topk(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "ts").where("ts >= timestamp_ntz'2024-01-10 00:00:00'")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(5000)


@register(f"WITH {JOBS} SELECT id, product_slug FROM jobs WHERE status IN ('crawling', 'analyzing', 'generating') AND coalesce(last_heartbeat, updated_at) < {NOW} - INTERVAL 30 MINUTE")
def prd6_stale_jobs(spark, sf_dir):
    return jobs(spark, sf_dir).where(op.stale(F.col("last_heartbeat"), F.col("updated_at"), F.col("status"), now())).select("id", "product_slug")


@register(f"WITH {JOBS} SELECT id, attempts < 12 AND NOT {HARD} AND ({ERROR_CLASS} IN ('timeout', 'network', 'http_error', 'unknown') OR error IS NULL) AS retry FROM jobs")
def prd7_retry_eligible(spark, sf_dir):
    return jobs(spark, sf_dir).select("id", op.retryable(F.col("attempts"), F.col("error"), F.col("status_code")).alias("retry"))


@register(f"WITH {JOBS} SELECT id, error FROM jobs WHERE {HARD}")
def prd8_hard_errors(spark, sf_dir):
    return jobs(spark, sf_dir).where(op.hard(F.col("error"), F.col("status_code"))).select("id", "error")


@register(f"WITH {JOBS} SELECT {ERROR_CLASS} AS kind, count(*) AS n FROM jobs WHERE error IS NOT NULL GROUP BY 1")
def prd9_error_classes(spark, sf_dir):
    return jobs(spark, sf_dir).where("error is not null").groupBy(op.error_class(F.col("error"), F.col("status_code")).alias("kind")).agg(F.count("*").alias("n"))


@register(f"WITH {JOBS} SELECT status, count(*) AS n FROM jobs GROUP BY status")
def agg4_jobs_by_status(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@register(f"WITH {JOBS} SELECT product_slug, count(*) AS n FROM jobs WHERE active GROUP BY product_slug HAVING count(*) > 1")
def agg5_duplicate_active_jobs(spark, sf_dir):
    return jobs(spark, sf_dir).where("active").groupBy("product_slug").agg(F.count("*").alias("n")).where("n > 1")


@register(f"WITH {JOBS} SELECT count(*) FILTER (status = 'pending' AND NOT skip_crawl) AS pending_crawl, count(*) FILTER (status = 'pending' AND skip_crawl) AS pending_regen, count(*) FILTER (status IN ('crawling', 'analyzing') AND NOT skip_crawl) AS running_crawl, count(*) FILTER (status IN ('crawling', 'analyzing') AND skip_crawl) AS running_regen, count(*) FILTER (active) AS active FROM jobs")
def agg6_queue_counts(spark, sf_dir):
    return op.queue_counts(jobs(spark, sf_dir))


@register(f"WITH {JOBS} SELECT coalesce(substr(error, 1, 120), 'unknown') AS reason, count(*) AS n FROM jobs WHERE status = 'failed' GROUP BY 1 ORDER BY n DESC, reason LIMIT 10")
def agg7_top_failures(spark, sf_dir):
    reason = F.coalesce(F.substring("error", 1, 120), F.lit("unknown")).alias("reason")
    return jobs(spark, sf_dir).where("status = 'failed'").groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10)


@register(f"WITH {JOBS} SELECT count(*) AS total, count(*) FILTER (status = 'failed' AND created_at >= {NOW} - INTERVAL 7 DAY) AS failed_7d, count(*) FILTER (created_at >= {NOW} - INTERVAL 7 DAY) AS jobs_7d, coalesce(count(*) FILTER (status = 'failed' AND created_at >= {NOW} - INTERVAL 7 DAY) * 10 < count(*) FILTER (created_at >= {NOW} - INTERVAL 7 DAY), true) AS all_green FROM jobs")
def agg8_ship_gates(spark, sf_dir):
    """Totals, and whether fewer than a tenth of the last week's jobs failed."""
    recent = F.col("created_at") >= now() - F.expr("INTERVAL 7 DAYS")
    failed, total = F.count_if(recent & (F.col("status") == "failed")), F.count_if(recent)
    return jobs(spark, sf_dir).agg(F.count("*").alias("total"), failed.alias("failed_7d"), total.alias("jobs_7d"), F.coalesce(failed * 10 < total, F.lit(True)).alias("all_green"))


@register(f"WITH {JOBS} SELECT product_slug, string_agg(kind || ':' || n, ',' ORDER BY n DESC, kind) AS breakdown FROM (SELECT product_slug, {ERROR_CLASS} AS kind, count(*) AS n FROM jobs WHERE error IS NOT NULL GROUP BY ALL) GROUP BY product_slug")
def agg30_skip_breakdown(spark, sf_dir):
    per = jobs(spark, sf_dir).where("error is not null").groupBy("product_slug", op.error_class(F.col("error"), F.col("status_code")).alias("kind")).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), "kind", "n")))
    return per.groupBy("product_slug").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["kind"], F.lit(":"), x["n"].cast("string"))), ",").alias("breakdown"))


@register(
    f"""WITH {JOBS}, c AS (SELECT product_slug, count(*) AS n, count(*) FILTER ({ERROR_CLASS} = 'robots') AS robots, count(*) FILTER ({ERROR_CLASS} IN ('timeout', 'network')) AS connection, count(*) FILTER ({HARD}) AS hard FROM jobs WHERE error IS NOT NULL GROUP BY product_slug)
    SELECT product_slug, n, CASE WHEN robots = n THEN 'all_robots' WHEN connection = n THEN 'all_connection' WHEN hard = n THEN 'all_hard' WHEN robots > 0 THEN 'partial_robots' ELSE 'crawl_failed' END AS reason FROM c"""
)
def agg31_crawl_outcome(spark, sf_dir):
    return op.outcome(jobs(spark, sf_dir))


@register(f"WITH {JOBS} SELECT id, product_slug, CAST(sum(CASE WHEN {HARD} THEN 1 ELSE 0 END) OVER (PARTITION BY product_slug ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hard_failures, sum(CASE WHEN {HARD} THEN 1 ELSE 0 END) OVER (PARTITION BY product_slug ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) >= 5 AS broken FROM jobs")
def agg32_hard_failures(spark, sf_dir):
    """AGG-32 and STR-4: hard failures add up and open a domain's breaker."""
    w = W.partitionBy("product_slug").orderBy("created_at", "id").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(op.hard(F.col("error"), F.col("status_code")).cast("long")).over(w)
    return jobs(spark, sf_dir).select("id", "product_slug", total.alias("hard_failures"), (total >= op.BREAKER).alias("broken"))


@register(f"WITH {JOBS} SELECT product_slug, count(*) AS n FROM jobs WHERE skip_crawl AND hour(created_at) >= 8 GROUP BY product_slug ORDER BY n DESC, product_slug LIMIT 500")
def agg37_regen_batch(spark, sf_dir):
    return jobs(spark, sf_dir).where("skip_crawl and hour(created_at) >= 8").groupBy("product_slug").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "product_slug").limit(500)


@register(f"WITH {JOBS} SELECT product_slug, coalesce(round(100.0 * count(*) FILTER (status = 'completed') / nullif(count(*) FILTER (status IN ('completed', 'failed')), 0), 6), 0) AS success_rate FROM jobs GROUP BY product_slug")
def agg38_success_rate(spark, sf_dir):
    done = F.count_if(F.col("status") == "completed")
    ended = F.count_if(F.col("status").isin("completed", "failed"))
    return jobs(spark, sf_dir).groupBy("product_slug").agg(F.coalesce(F.round(F.try_divide(done * 100.0, ended), 6).cast("double"), F.lit(0.0)).alias("success_rate"))


@register("SELECT event_type AS model, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, string_agg(DISTINCT 'u' || user_id % 3, ',' ORDER BY 'u' || user_id % 3) AS providers FROM events GROUP BY event_type")
def agg28_usage_by_model(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    provider = F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))
    return e.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.array_join(F.array_sort(F.collect_set(provider)), ",").alias("providers"))


@register(
    """WITH m AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
    SELECT user_id, CAST(max(streak) AS BIGINT) AS longest FROM (SELECT user_id, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM m) GROUP BY user_id"""
)
def win4_failure_streaks(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return scans.streaks(e, "user_id", F.col("event_type") != "error", ["ts", "event_id"]).groupBy("user_id").agg(F.max("streak").alias("longest"))


@register(
    """WITH m AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS hit, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
    s AS (SELECT user_id, event_id, island, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM m)
    SELECT user_id, count(*) AS n FROM s WHERE island >= 1 AND since >= 10 GROUP BY user_id"""
)
def win5_converged(spark, sf_dir):
    """Rows at least ten after the last hit, once there was one."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    rows = scans.streaks(e, "user_id", F.col("event_type") == "purchase", ["ts", "event_id"], "since", "seen")
    return rows.where("seen and since >= 10").groupBy("user_id").agg(F.count("*").alias("n"))


@register("SELECT user_id, CAST(min(gap) AS BIGINT) AS least_gap FROM (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) GROUP BY user_id")
def win6_request_gaps(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = scans.previous(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", at.alias("at")), "user_id", "at", ["ts", "event_id"], "before")
    return rows.select("user_id", (F.col("at") - F.col("before")).alias("gap")).groupBy("user_id").agg(F.min("gap").alias("least_gap"))


@register("SELECT event_id, round(least(100, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), 2) AS progress FROM events")
def win7_high_water(spark, sf_dir):
    rows = scans.running_max(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", "value", ["ts", "event_id"], "top")
    return rows.select("event_id", F.round(F.least(F.lit(100.0), "top"), 2).alias("progress"))


@register("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def win8_rolling_quota(spark, sf_dir):
    return op.rolling(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 24).select("event_id", "n")


@register(f"WITH {JOBS} SELECT product_slug, id FROM (SELECT product_slug, id, row_number() OVER (PARTITION BY product_slug ORDER BY skip_crawl DESC, created_at, id) AS rn FROM jobs WHERE status = 'pending') WHERE rn = 1")
def win10_claim_next(spark, sf_dir):
    return op.claim_next(jobs(spark, sf_dir), "product_slug")


@register(f"WITH {JOBS} SELECT product_slug, id, updated_at FROM (SELECT product_slug, id, updated_at, row_number() OVER (PARTITION BY product_slug ORDER BY updated_at, id) AS rn FROM jobs WHERE status = 'failed' AND product_slug NOT IN (SELECT product_slug FROM jobs WHERE active)) WHERE rn = 1 ORDER BY updated_at, id LIMIT 200")
def win11_revive(spark, sf_dir):
    return op.revive(jobs(spark, sf_dir))


@register(f"WITH {JOBS} SELECT id, CAST(floor((epoch_us({NOW}) - epoch_us(coalesce(last_heartbeat, updated_at))) / 60000000) AS BIGINT) AS age FROM jobs WHERE status IN ('crawling', 'analyzing', 'generating') AND epoch_us({NOW}) - epoch_us(coalesce(last_heartbeat, updated_at)) >= 1800000000")
def win12_heartbeat_age(spark, sf_dir):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    age = us(now()) - us(F.coalesce("last_heartbeat", "updated_at"))
    return jobs(spark, sf_dir).where(F.col("status").isin(*op.RUNNING) & (age >= 1_800_000_000)).select("id", F.floor(age / 60_000_000).alias("age"))


@register("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 20 AS BIGINT) AS day FROM orders")
def win13_stagger(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return op.stagger(o, 8, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "day")


@register("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def srt2_latest(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@register(f"WITH {JOBS} SELECT id, updated_at + INTERVAL 7 DAY AS next_due FROM jobs WHERE status = 'completed' AND updated_at + INTERVAL 7 DAY <= {NOW} ORDER BY next_due, id LIMIT 50")
def srt4_due_schedules(spark, sf_dir):
    due = F.col("updated_at") + F.expr("INTERVAL 7 DAYS")
    return jobs(spark, sf_dir).where("status = 'completed'").select("id", due.alias("next_due")).where(F.col("next_due") <= now()).orderBy("next_due", "id").limit(50)


@register("SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS used, least(count(*), 15) AS counted, count(*) >= 15 AS exhausted FROM events GROUP BY 1, 2")
def str6_month_quota(spark, sf_dir):
    return op.quota(read(spark, sf_dir, "events"), "user_id", "ts", 15)


@register(f"WITH {JOBS}, r AS (SELECT id, product_slug, updated_at, row_number() OVER (ORDER BY updated_at, id) AS rn FROM jobs WHERE status = 'failed' AND attempts < 12) SELECT id, product_slug, 'pending' AS status FROM r WHERE rn <= 200")
def str10_requeue(spark, sf_dir):
    failed = jobs(spark, sf_dir).where("status = 'failed' and attempts < 12").orderBy("updated_at", "id").limit(200)
    return failed.select("id", "product_slug", F.lit("pending").alias("status"))


@register(f"WITH {JOBS} SELECT id FROM jobs WHERE NOT (status IN ('completed', 'failed') AND updated_at < {NOW} - INTERVAL 10 DAY)")
def str11_ttl(spark, sf_dir):
    """Rows left when terminal jobs expire after ten days."""
    gone = F.col("status").isin("completed", "failed") & (F.col("updated_at") < now() - F.expr("INTERVAL 10 DAYS"))
    return jobs(spark, sf_dir).where(~gone).select("id")


@register(f"WITH {JOBS}, d AS (SELECT product_slug, count(*) FILTER (active) AS active, count(*) FILTER (status = 'failed') AS failed, max(updated_at) AS last_seen FROM jobs GROUP BY product_slug) SELECT product_slug, CASE WHEN active > 1 THEN 'duplicate_active' WHEN failed >= 5 THEN 'many_failures' WHEN last_seen < {NOW} THEN 'quiet' ELSE 'ok' END AS alert FROM d")
def top11_fleet_alerts(spark, sf_dir):
    d = jobs(spark, sf_dir).groupBy("product_slug").agg(F.count_if("active").alias("active"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("updated_at").alias("last_seen"))
    alert = F.when(F.col("active") > 1, "duplicate_active").when(F.col("failed") >= 5, "many_failures").when(F.col("last_seen") < now(), "quiet").otherwise("ok")
    return d.select("product_slug", alert.alias("alert"))
