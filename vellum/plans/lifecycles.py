"""Queries of job lifecycles, schedules and crawl progress."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vellum.functions import text
from vellum.operators import lifecycle as op
from vellum.sources.bindings import JOBS, jobs
from vellum.sources.sinks import workspace
from vellum.sources.tables import read

from vellum.streaming import lifecycle as life
from vellum.streaming import store as streams

from .documents import FP, GARBLED
from .queue import NOW, now
from .registry import Registry

register = Registry()
QUERIES, ORACLE_SQL = register.queries, register.oracles


@register(f"WITH {JOBS}, k AS (SELECT *, epoch_us(created_at) * 1000 + id % 1000 AS o FROM jobs) SELECT product_slug, coalesce(arg_min(status, o) FILTER (status IN ('completed', 'failed')), arg_max(status, o)) AS status, count(*) AS n FROM k GROUP BY product_slug")
def str2_final_states(spark, sf_dir):
    order = F.unix_micros(F.col("created_at").cast("timestamp")) * 1000 + F.col("id") % 1000
    return op.final_state(jobs(spark, sf_dir), "product_slug", "status", order)


@register("SELECT user_id, count(*) FILTER (gap > 3600) AS stalls, CAST(floor(max(gap)) AS BIGINT) AS longest FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000 AS gap FROM events) GROUP BY user_id")
def str3_stalls(spark, sf_dir):
    return op.stalls(read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id")


@register(f"WITH {JOBS}, s AS (SELECT product_slug, max(updated_at) AS last FROM jobs WHERE status = 'completed' GROUP BY product_slug) SELECT product_slug, last, last + INTERVAL 1 DAY AS due FROM s WHERE last + INTERVAL 1 DAY <= {NOW} ORDER BY due, product_slug LIMIT 20")
def str7_due_schedules(spark, sf_dir):
    s = jobs(spark, sf_dir).where("status = 'completed'").groupBy("product_slug").agg(F.max("updated_at").alias("last"))
    return op.due(s, "last", now(), 1, 20, ["product_slug"])


@register(f"SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE ts >= {NOW} - INTERVAL 24 HOUR)")
def str9_resume_window(spark, sf_dir):
    pages = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return op.fresh(pages, read(spark, sf_dir, "events"), "user_id", "ts", now())


@register("SELECT user_id, coalesce(min(back) FILTER (hit), max(back) + 1) > 10 AS exhausted FROM (SELECT user_id, event_type = 'purchase' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) GROUP BY user_id")
def win14_exhausted(spark, sf_dir):
    return op.exhausted(read(spark, sf_dir, "events"), "user_id", F.col("event_type") == "purchase", ["ts", "event_id"])


@register(f"SELECT doc_id, NOT {GARBLED} AND NOT contains(lower(coalesce(text, '')), 'enable javascript') AND length(coalesce(text, '')) >= CASE WHEN doc_id % 10 >= 5 THEN 1000 ELSE 500 END AS enough FROM documents")
def prd14_sufficient(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", op.sufficient(F.col("text"), text.garbled(F.col("text")), F.col("doc_id") % 10).alias("enough"))


@register(f"WITH {JOBS} SELECT id, CASE WHEN coalesce(contains(error, 'robots'), false) THEN 'blocked_by_robots' WHEN status_code = 404 THEN 'not_found' WHEN status_code >= 400 THEN 'http_error' WHEN value > 50 THEN 'static' WHEN skip_crawl THEN 'rendered' ELSE 'deferred' END AS outcome FROM jobs")
def src19_fetch_outcomes(spark, sf_dir):
    robots = F.coalesce(F.contains("error", F.lit("robots")), F.lit(False))
    return jobs(spark, sf_dir).select("id", op.fetch_outcome(F.col("status_code"), robots, F.col("value") > 50, F.col("skip_crawl")).alias("outcome"))


@register("SELECT DISTINCT source || '.org' AS domain FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def prd20_extension_domains(spark, sf_dir):
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".org")).alias("domain")).join(good, "doc_id", "left_semi").select("domain").distinct()


@register(f"WITH {JOBS} SELECT status, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(c) AS BIGINT) AS cents FROM (SELECT status, product_slug, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS c FROM jobs GROUP BY ALL) GROUP BY status")
def agg29_merged_usage(spark, sf_dir):
    """Usage summaries of products merged again."""
    per = jobs(spark, sf_dir).groupBy("status", "product_slug").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("c"))
    return per.groupBy("status").agg(F.sum("n").alias("calls"), F.sum("c").alias("cents"))


#: An event's job is its user's day, its status follows from its kind; errors end jobs in ten ways.
STALL, FRESH = 6 * 3600, 24 * 3600
#: Bytes of files that a batch of the stream takes: a batch has a fixed cost in each partition of the state, a file has none.
BATCH_BYTES = 256 << 20
ENDED = "[" + ", ".join(f"'{x}'" for x in life.ENDS) + "]"
EVENTS = f"""
e AS (
  SELECT user_id * 31 + day(ts) AS key, epoch_us(ts) AS "at", event_id AS tie,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'crawling' WHEN 'signup' THEN 'synthesising' WHEN 'purchase' THEN 'generating_overview' ELSE {ENDED}[event_id % 10 + 1] END AS value
  FROM events)"""


def job_events(events):
    """key, ts, tie, value of a table or a stream of events."""
    ends = F.element_at(F.array(*map(F.lit, life.ENDS)), (F.col("event_id") % 10 + 1).cast("int"))
    value = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "crawling").when(F.col("event_type") == "signup", "synthesising").when(F.col("event_type") == "purchase", "generating_overview").otherwise(ends)
    return events.select((F.col("user_id") * 31 + F.dayofmonth("ts")).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), value.alias("value"))


def folded_events(spark, sf_dir, fold, select=job_events, late="40 days"):
    """The fold of the events table as a stream, some files at a time, then of the time after it. Files come in any order, so lateness spans them."""
    out = streams.FoldedEvents(spark, workspace(spark, "fold"), fold, late)
    rows = select(streams.table_stream(spark, sf_dir, "events", bytes_per_trigger=BATCH_BYTES))
    out.run(rows, settle=False)
    out.advance(datetime(2100, 1, 1))
    out.run(rows)
    return out.result()


LEGAL = " ".join(f"WHEN s = '{a}' THEN v IN ({', '.join(repr(x) for x in (a, *b))})" for a, b in life.NEXT.items())
LIFE = f"""
WITH RECURSIVE {EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at", tie, value) AS i FROM e),
steps AS (
  SELECT key, 0::BIGINT AS i, NULL::VARCHAR AS s, NULL::BIGINT AS due, NULL::VARCHAR AS kind, NULL::VARCHAR AS was, NULL::VARCHAR AS now, NULL::BIGINT AS "at", NULL::BIGINT AS alarm, NULL::VARCHAR AS alarmed FROM o WHERE i = 1
  UNION ALL
  SELECT key, i, CASE WHEN ok THEN v ELSE s END, CASE WHEN NOT ok THEN due WHEN v IN {tuple(life.ENDS)} THEN NULL ELSE "at" + {STALL * 1_000_000} END,
    CASE WHEN NOT ok THEN 'illegal' WHEN v IS NOT DISTINCT FROM s THEN NULL ELSE 'moved' END, s, v, "at", alarm, alarmed
  FROM (
    SELECT *, coalesce(CASE WHEN s IS NULL THEN v = 'pending' {LEGAL} ELSE false END, false) AS ok
    FROM (
      SELECT p.key, o.i, o.value AS v, o."at", CASE WHEN p.due < o."at" THEN 'failed' ELSE p.s END AS s, CASE WHEN p.due < o."at" THEN NULL ELSE p.due END AS due,
        CASE WHEN p.due < o."at" THEN p.due END AS alarm, CASE WHEN p.due < o."at" THEN p.s END AS alarmed
      FROM steps p JOIN o ON o.key = p.key AND o.i = p.i + 1))),
ended AS (SELECT key, s, due FROM steps QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1),
life AS (
  SELECT key, kind, was, now, "at" FROM steps WHERE kind IS NOT NULL
  UNION ALL SELECT key, 'stalled', alarmed, 'failed', alarm FROM steps WHERE alarm IS NOT NULL
  UNION ALL SELECT key, 'stalled', s, 'failed', due FROM ended WHERE due IS NOT NULL)"""


@register(f'{LIFE} SELECT key, kind, was, now, "at" FROM life WHERE kind <> \'stalled\'')
def str2_lifecycle(spark, sf_dir):
    """Every move of every job, and every status that may not follow, folded from a stream."""
    return folded_events(spark, sf_dir, life.Lifecycle(STALL)).where("kind <> 'stalled'")


@register(f"{LIFE} SELECT key, was, \"at\" FROM life WHERE kind = 'stalled'")
def str3_stall_alarms(spark, sf_dir):
    """Alarms of jobs without a sign of life, at the time they fall due, raised by timers."""
    return folded_events(spark, sf_dir, life.Lifecycle(STALL)).where("kind = 'stalled'").select("key", "was", "at")


def user_events(events):
    return events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), F.lit("seen").alias("value"))


@register(
    f"""WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) AS "at" FROM events),
    seen AS (
      SELECT key, min("at") AS "at" FROM e GROUP BY key
      UNION ALL SELECT s.key, (SELECT min(e."at") FROM e WHERE e.key = s.key AND e."at" > s."at" + {FRESH * 1_000_000}) FROM seen s WHERE s."at" IS NOT NULL)
    SELECT key, 'seen' AS kind, "at" FROM seen WHERE "at" IS NOT NULL UNION ALL SELECT key, 'expired', "at" + {FRESH * 1_000_000} FROM seen WHERE "at" IS NOT NULL"""
)
def str11_expiring_sightings(spark, sf_dir):
    """Sightings that count, and when each expires, so that the next one counts again."""
    return folded_events(spark, sf_dir, life.Sightings(FRESH), user_events).select("key", "kind", "at")


@register(f"SELECT md5(coalesce(source, '') || chr(10) || {FP}) AS key, coalesce(source, '') AS owner, min(doc_id) AS doc_id, count(*) AS n_docs FROM documents WHERE length(coalesce(text, '')) >= 300 AND NOT {GARBLED} GROUP BY 1, 2")
def str1_streamed_store(spark, sf_dir):
    """Documents admitted and stored as a stream brings them, file by file; the same as at once."""
    pages = streams.page_store(spark)
    pages.run(streams.table_stream(spark, sf_dir, "documents"))
    return pages.table.read()
