"""A job queue as a table: predicates, error classes, counters, claims and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.sources.sinks import settled

RUNNING = ("crawling", "analyzing", "generating")
MOST_ATTEMPTS, STALE_MINUTES, BREAKER = 12, 30, 5
HARD_CODES = (401, 403, 407, 451)
HARD_WORDS = ("forbidden", "unauthorized", "access denied", "captcha", "bot wall", "legal reasons")
RETRYABLE = ("timeout", "network", "http_error")


def stale(heartbeat: Column, updated: Column, status: Column, now: Column, minutes: int = STALE_MINUTES) -> Column:
    """A running job whose last sign of life is older than so many minutes."""
    return status.isin(*RUNNING) & (F.coalesce(heartbeat, updated) < now - F.make_dt_interval(mins=F.lit(minutes)))


def error_class(message: Column, code: Column) -> Column:
    """The first class that fits: robots, timeout, network, http_error, unknown."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.contains("robots"), "robots").when(m.rlike("timeout|timed out"), "timeout").when(m.rlike("connection|dns|network|ssl"), "network").when(code >= 400, "http_error").otherwise("unknown")


def hard(message: Column, code: Column) -> Column:
    """Errors that a retry will not mend."""
    m = F.lower(F.coalesce(message, F.lit("")))
    by_word = F.lit(False)
    for w in HARD_WORDS:
        by_word = by_word | m.contains(w)
    return F.coalesce(code.isin(*HARD_CODES), F.lit(False)) | by_word


def retryable(attempts: Column, message: Column, code: Column) -> Column:
    kind = error_class(message, code)
    return (attempts < MOST_ATTEMPTS) & ~hard(message, code) & (kind.isin(*RETRYABLE) | message.isNull() | (kind == "unknown"))


def queue_counts(jobs: DataFrame) -> DataFrame:
    """Pending and running jobs, with and without a crawl, in one pass."""
    pending, running = F.col("status") == "pending", F.col("status").isin(*RUNNING)
    return jobs.agg(
        F.count_if(pending & ~F.col("skip_crawl")).alias("pending_crawl"),
        F.count_if(pending & F.col("skip_crawl")).alias("pending_regen"),
        F.count_if(running & ~F.col("skip_crawl")).alias("running_crawl"),
        F.count_if(running & F.col("skip_crawl")).alias("running_regen"),
        F.count_if("active").alias("active"),
    )


def outcome(jobs: DataFrame) -> DataFrame:
    """Why a product's crawl gave nothing, by the first rule that holds."""
    kind = error_class(F.col("error"), F.col("status_code"))
    counted = jobs.where("error is not null").groupBy("product_slug").agg(
        F.count("*").alias("n"), F.count_if(kind == "robots").alias("robots"), F.count_if(kind.isin("timeout", "network")).alias("connection"), F.count_if(hard(F.col("error"), F.col("status_code"))).alias("hard"))
    c = F.col
    reason = F.when(c("robots") == c("n"), "all_robots").when(c("connection") == c("n"), "all_connection").when(c("hard") == c("n"), "all_hard").when(c("robots") > 0, "partial_robots").otherwise("crawl_failed")
    return counted.select("product_slug", "n", reason.alias("reason"))


def crawl_outcome(errors: DataFrame, skips: DataFrame, key: str = "product_slug") -> DataFrame:
    """(key, n_errors, n_skips, outcome, skipped_for): why a crawl stored nothing, by the first rule that holds.

    errors: (key, error, status_code), skips: (key, reason), pages that were fetched and left out. Robots alone, then
    connections or refusals among what robots let through, then skips with their most frequent reason, robots in part,
    and other errors; a key without either does not appear.
    """
    kind = error_class(F.col("error"), F.col("status_code"))
    failed = errors.where("error is not null").groupBy(key).agg(
        F.count("*").alias("n_errors"), F.count_if(kind == "robots").alias("robots"), F.count_if(kind.isin("timeout", "network")).alias("connection"), F.count_if(hard(F.col("error"), F.col("status_code")) & (kind != "robots")).alias("hard"))
    by_reason = skips.groupBy(key, "reason").agg(F.count("*").alias("k"))
    most = by_reason.groupBy(key).agg(F.sum("k").alias("n_skips"), F.min_by("reason", F.struct(-F.col("k"), F.col("reason"))).alias("reason"))
    both = failed.join(most, key, "full_outer").fillna(0, ["n_errors", "robots", "connection", "hard", "n_skips"])
    rest = F.col("n_errors") - F.col("robots")
    outcome = F.when((F.col("robots") > 0) & (rest == 0), "all_robots").when((rest > 0) & (F.col("connection") == rest), "all_connection").when((rest > 0) & (F.col("hard") == rest), "all_hard")
    outcome = outcome.when(F.col("n_skips") > 0, "skipped").when(F.col("robots") > 0, "partial_robots").otherwise("crawl_failed")
    return both.select(key, "n_errors", "n_skips", outcome.alias("outcome"), F.col("reason").alias("skipped_for"))


def claim_next(jobs: DataFrame, key: str) -> DataFrame:
    """The pending job of each key to run next: those without a crawl first, then the oldest."""
    order = F.struct((~F.col("skip_crawl")).alias("a"), F.col("created_at").alias("b"), F.col("id").alias("c"))
    return jobs.where("status = 'pending'").groupBy(key).agg(F.min_by("id", order).alias("id"))


def revive(jobs: DataFrame, batch: int = 200) -> DataFrame:
    """One failed job, the oldest, of each product without an active one."""
    failed = jobs.where("status = 'failed'")
    idle = failed.join(jobs.where("active").select("product_slug").distinct(), "product_slug", "left_anti")
    first = idle.groupBy("product_slug").agg(F.min_by(F.struct("id", "updated_at"), F.struct("updated_at", "id")).alias("j"))
    return first.select("product_slug", "j.id", "j.updated_at").orderBy("updated_at", "id").limit(batch)


def rolling(rows: DataFrame, key: str, ts: str, hours: int, alias: str = "n") -> DataFrame:
    """Rows of a key within the hours up to each one."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return rows.withColumn(alias, F.count("*").over(W.partitionBy(key).orderBy(at).rangeBetween(-hours * 3_600_000_000, 0)))


def quota(rows: DataFrame, key: str, ts: str, limit: int) -> DataFrame:
    """Use of each key and month against a limit."""
    month = F.date_format(ts, "yyyy-MM").alias("month")
    return rows.groupBy(key, month).agg(F.count("*").alias("used")).select(key, "month", "used", F.least("used", F.lit(limit)).alias("counted"), (F.col("used") >= limit).alias("exhausted"))


def stagger(rows: DataFrame, buckets: int, order: list[str], per_day: int = 20) -> DataFrame:
    """The day of each row when per_day run a day, in order.

    Row numbers over the whole table come from counts of ranges of the order, so no task sorts everything. The ranges
    are checkpointed, for their bounds are sampled anew each time they are computed.
    """
    ranged = settled(rows.repartitionByRange(buckets, *order).withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(W.partitionBy("part").orderBy(*order))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("day", F.floor((F.col("before") + F.col("inside") - 1) / per_day)).drop("part", "inside", "before")
