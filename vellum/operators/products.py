"""Products and their read models: admission of links, names, gates, grades, schedules and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import grades, text, url

RISK_WORDS = ("sell", "share", "track", "third part", "retain", "arbitration", "waive")


def validated(rows: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows to append and those refused."""
    both = marked(rows, ok)
    return both.where("_ok").drop("_ok"), both.where("not _ok").drop("_ok")


def marked(rows: DataFrame, ok: Column) -> DataFrame:
    """The rows with _ok, whether they may be appended."""
    return rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))


def ended(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Tasks (id) whose job (id, status) is known and runs no more."""
    return tasks.join(jobs, "id", "left").where("status is not null and status not in ('crawling', 'analyzing', 'generating')")


def admit_url(address: Column, depth: Column, allowed: Column, denied: Column, deepest: int = 5) -> Column:
    """Why a link is not followed, by the first rule that holds; null for those that are."""
    site = url.host(address)
    return (
        F.when(depth > deepest, "too_deep")
        .when(url.scheme(address) != "https", "scheme")
        .when(site.rlike(r"(^|[.-])(internal|staging|preview)($|\.)"), "mirror")
        .when(url.under_domain(site, denied), "denied_domain")
        .when(~url.under_domain(site, allowed), "other_domain")
        .when(address.rlike(r"(?i)\.(png|jpe?g|gif|webp|svg|ico|woff2?|mp4|mp3|pdf)([?#]|$)"), "asset")
    )


def frontier(links: DataFrame, site: str, score: str, budget: int) -> DataFrame:
    """The links of each site to follow next: strong policy paths first, then by falling score and URL."""
    order = W.partitionBy(site).orderBy(F.when(url.path(F.col("url")).rlike("(?i)(privacy|terms|legal|policy)"), 0).otherwise(1), F.desc(score), "url")
    return links.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= budget)


def crawl(links: DataFrame, seeds: DataFrame, rounds: int, save) -> DataFrame:
    """(url, depth) reached from seeds within rounds steps over links (src, dst); save writes and rereads a round's table."""
    seen = save(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, rounds + 1):
        edge = seen.where(F.col("depth") == depth - 1).select(F.col("url").alias("src"))
        new = links.join(edge, "src", "left_semi").select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        new = new.withColumn("depth", F.lit(depth))
        grown = save(seen.unionByName(new))
        if grown.where(F.col("depth") == depth).isEmpty():
            return grown
        seen = grown
    return seen


def vote(names: DataFrame, owner: str) -> DataFrame:
    """The name of each owner: of the best source (smallest priority) the most frequent, the first among equals."""
    counted = names.groupBy(owner, "priority", "name").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    return counted.groupBy(owner).agg(F.min_by("name", F.struct("priority", -F.col("n"), "seq")).alias("name"))


def concerns(dangers: Column, keypoints: Column, most: int = 3) -> Column:
    """The first dangers, else key points with a risk word, else the first key points."""
    risky = F.filter(keypoints, lambda k: F.lower(k).rlike("|".join(RISK_WORDS)))
    return F.slice(F.when(F.size(dangers) > 0, dangers).when(F.size(risky) > 0, risky).otherwise(keypoints), 1, most)


def progress(steps: Column, running: Column, total: int = 3) -> Column:
    """Percent of a job: completed steps and the running one's part."""
    done = F.size(F.filter(steps, lambda s: s == "completed"))
    return F.least(F.lit(100), F.floor((done + F.coalesce(running, F.lit(0.0))) * 100 / total)).cast("int")


def reconciled(dimension: Column, proposed: Column, topic: Column, adjustment: Column, floor: Column) -> Column:
    """The final risk of a product: the worst of three, less a small positive adjustment, not below its floor."""
    clamped = grades.risk_score(grades.clamp(proposed, grades.of_risk_score(dimension)))
    worst = F.greatest(dimension, clamped, topic) - F.least(adjustment, F.lit(2))
    return F.greatest(F.lit(0), F.least(F.lit(10), F.greatest(worst, floor)))


def finding_floor(critical: Column, good: Column, grade: Column) -> Column:
    """Critical findings floor a grade at D or E; none, and two good ones, lift it by a letter."""
    place = F.instr(F.lit("ABCDE"), grade)
    moved = F.when(critical >= 2, 5).when(critical == 1, F.greatest(place, F.lit(4))).when(good >= 2, F.greatest(place - 1, F.lit(1))).otherwise(place)
    return F.substring(F.lit("ABCDE"), moved, F.lit(1))


def domain_match(incoming: DataFrame, products: DataFrame) -> DataFrame:
    """(id, product_id, tier): by the exact domain, else by the base domain."""
    by = lambda c, name: products.groupBy(c.alias("k")).agg(F.min("product_id").alias(name))
    exact, base = by(url.normalize_domain(F.col("domain")), "p1"), by(url.base_domain(F.col("domain")), "p2")
    out = incoming.withColumn("k1", url.normalize_domain(F.col("domain"))).withColumn("k2", url.base_domain(F.col("domain")))
    out = out.join(exact.withColumnRenamed("k", "k1"), "k1", "left").join(base.withColumnRenamed("k", "k2"), "k2", "left")
    return out.select("id", F.coalesce("p1", "p2").alias("product_id"), F.when(F.col("p1").isNotNull(), "exact").when(F.col("p2").isNotNull(), "base").alias("tier"))


def member_names(owner: Column, others: Column) -> Column:
    return text.ordered_union(F.array(owner), others)


def report(spans: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics of products with their cited findings; a found topic whose findings lack citations is not disclosed."""
    cited = spans.where("quote <> ''").groupBy("product_id", "category").agg(F.count("*").alias("n_citations"), F.countDistinct("document_id").alias("n_documents"))
    out = topics.join(cited, ["product_id", "category"], "left")
    status = F.when((F.col("status") == "found") & F.col("n_citations").isNull(), "not_disclosed").otherwise(F.col("status"))
    return out.select("product_id", "category", status.alias("status"), F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def promotion(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """What replacing a table would do, as counts: rows added, replaced and removed."""
    s, t = source.select(key, F.lit(1).alias("s")), target.select(key, F.lit(1).alias("t"))
    both = s.join(t, key, "full_outer")
    return both.agg(F.count_if(F.col("t").isNull()).alias("added"), F.count_if(F.col("s").isNotNull() & F.col("t").isNotNull()).alias("replaced"), F.count_if(F.col("s").isNull()).alias("removed"))
