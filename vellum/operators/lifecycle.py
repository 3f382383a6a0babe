"""Job lifecycles and crawl progress folded from logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed")


def final_state(log: DataFrame, key: str, status: str, order: Column) -> DataFrame:
    """(key, status, n): the first terminal status of each job, else its last status; what follows a terminal one is ignored."""
    done = F.when(F.col(status).isin(*TERMINAL), order)
    return log.groupBy(key).agg(F.coalesce(F.min_by(status, done), F.max_by(status, order)).alias("status"), F.count("*").alias("n"))


def stalls(log: DataFrame, key: str, ts: str, tie: str, seconds: int = 3600) -> DataFrame:
    """(key, stalls, longest): gaps between signs of life longer than seconds."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (at - F.lag(at).over(W.partitionBy(key).orderBy(ts, tie))) / 1_000_000
    return log.select(key, gap.alias("gap")).groupBy(key).agg(F.count_if(F.col("gap") > seconds).alias("stalls"), F.floor(F.max("gap")).alias("longest"))


def due(schedules: DataFrame, last: str, now: Column, days: int, quota: int, order: list[str]) -> DataFrame:
    """Schedules to trigger: due ones, oldest first, at most quota; with their next date, spread by a hash of the key."""
    when = F.col(last) + F.make_dt_interval(days=F.lit(days))
    return schedules.withColumn("due", when).where(F.col("due") <= now).orderBy("due", *order).limit(quota)


def fresh(pages: DataFrame, seen: DataFrame, key: str, ts: str, now: Column, hours: int = 24) -> DataFrame:
    """Pages that were not seen within the hours and so are fetched again."""
    recent = seen.where(F.col(ts) >= now - F.make_dt_interval(hours=F.lit(hours))).select(key).distinct()
    return pages.join(recent, key, "left_anti")


def exhausted(log: DataFrame, key: str, hit: Column, order: list[str], grace: int = 10) -> DataFrame:
    """(key, exhausted): whether the last grace rows or more brought no lead."""
    newest = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    ranked = log.select(key, hit.alias("hit"), F.row_number().over(newest).alias("back"))
    return ranked.groupBy(key).agg((F.coalesce(F.min(F.when(F.col("hit"), F.col("back"))), F.max("back") + 1) > grace).alias("exhausted"))


def sufficient(content: Column, garbled: Column, score: Column) -> Column:
    """Whether a fetched page has enough text: likely policies need more of it."""
    return ~garbled & ~F.lower(F.coalesce(content, F.lit(""))).contains("enable javascript") & (F.length(F.coalesce(content, F.lit(""))) >= F.when(score >= 5, 1000).otherwise(500))


def fetch_outcome(status: Column, robots: Column, enough: Column, rendered: Column) -> Column:
    """What becomes of a fetched URL, by the first rule that holds."""
    return F.when(robots, "blocked_by_robots").when(status == 404, "not_found").when(status >= 400, "http_error").when(enough, "static").when(rendered, "rendered").otherwise("deferred")
