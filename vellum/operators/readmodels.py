"""Read models: projections, decisions and short lists over stored products, documents and jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import grades, text, url

# Fixed values of the browser fallback: bytes of an empty shell, characters of a page, kinds that can be read as they are.
SHELL_BYTES, PAGE_CHARS, READABLE = 512, 500, ("text/html", "text/plain", "text/markdown", "application/xhtml")
PROTECTIVE_TOPICS = ("benefits", "security", "user_rights", "breach_notification")
PROTECTIVE_MARKERS = ("sells_data: no", "does not sell", "do not sell", "not sell", "encrypt", "no ai training", "not used for training", "does not use", "opt out", "delete your", "data deletion")


def membership(docs: DataFrame, owner: str, others: Column) -> DataFrame:
    """Each document once for every product it belongs to, product being that product."""
    return docs.withColumn("product", F.explode(text.ordered_union(F.array(owner), others)))


def plain_text(html: Column) -> Column:
    """The visible text of a page, roughly: scripts, styles and tags go."""
    out = html
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))


def needs_browser(status: Column, kind: Column, body: Column) -> Column:
    """Whether a plain response is a shell that only a browser can fill; a rate limit is none."""
    mime = F.trim(F.lower(F.substring_index(F.coalesce(kind, F.lit("")), ";", 1)))
    readable = F.lit(False)
    for known in READABLE:
        readable = readable | mime.startswith(known)
    whole = F.coalesce(body, F.lit(""))
    few = F.when(mime.startswith("text/html"), F.length(plain_text(whole)) < PAGE_CHARS).otherwise(F.length(F.trim(whole)) < PAGE_CHARS)
    return F.when(status == 429, False).when((status >= 400) & (status < 500), True).when(~readable, True).when((status == 200) & (F.octet_length(whole) < SHELL_BYTES), True).otherwise(few)


def effective_url(address: Column, candidate: Column) -> Column:
    """A page's declared address where it is of the same registered domain, else its own, both normalised."""
    own, other = url.normalize(address), url.normalize(F.trim(candidate))
    same = url.base_domain(url.host(address)) == url.base_domain(url.host(candidate))
    return F.when(F.coalesce(same, F.lit(False)), other).otherwise(own)


def title(declared: Column, markdown: Column, address: Column, doc_type: Column) -> Column:
    """(title, source): the declared title, else the first heading, else one made of the address and the type."""
    said = F.trim(F.regexp_replace(F.coalesce(declared, F.lit("")), r"\s+", " "))
    heading = F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(markdown, F.lit("")), r"(?m)^#[ \t]+(.+)$", 1), r"\s+", " "))
    parts = F.filter(F.split(url.path(address), "/"), lambda p: p != "")
    site = F.split(F.regexp_replace(url.host(address), r"www\.", ""), r"\.")[0]
    name = F.initcap(F.when(F.size(parts) > 0, F.translate(F.element_at(parts, -1), "-_", "  ")).otherwise(site))
    made = F.concat(name, F.lit(" — "), F.initcap(F.translate(doc_type, "_", " ")))
    found = F.when(said != "", said).when(heading != "", heading).otherwise(made)
    return F.struct(found.alias("title"), F.when(said != "", "metadata").when(heading != "", "markdown_header").otherwise("url_fallback").alias("source"))


def protective(topic: Column, value: Column) -> Column:
    """Whether a finding speaks for the users."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    any_ = F.lit(False)
    for m in PROTECTIVE_MARKERS:
        any_ = any_ | low.contains(m)
    no = low.rlike(r"\bno\b")
    by_topic = topic.isin(*PROTECTIVE_TOPICS) | ((topic == "data_sale") & no) | ((topic == "ai_training") & (no | low.contains("not train")))
    return (low != "") & (by_topic | any_)


def headlines(findings: DataFrame, stances: DataFrame) -> DataFrame:
    """(product_id, category, headline): the first protective finding of a fair topic, else its first."""
    rows = findings.join(stances.select("product_id", "category", "stance"), ["product_id", "category"])
    late = ~((F.col("stance") == "fair") & protective(F.col("category"), F.col("value")))
    return rows.groupBy("product_id", "category").agg(F.min_by("value", F.struct(late.alias("late"), F.col("seq"))).alias("headline"))


def document_grades(rows: DataFrame) -> DataFrame:
    """Grade, verdict and risk of documents (proposed, derived): the proposed grade within a letter of the derived one."""
    grade = F.when(F.col("proposed").isNotNull() & F.col("derived").isNotNull(), grades.clamp(F.col("proposed"), F.col("derived"))).otherwise(F.coalesce("proposed", "derived"))
    out = rows.withColumn("grade", grade)
    known = F.col("grade").isNotNull()
    return out.withColumns({"verdict": F.when(known, grades.verdict(F.col("grade"))), "risk": F.when(known, grades.risk_score(F.col("grade")))})


def capped(rows: DataFrame, key: str, order: list[Column], most: Column | int) -> DataFrame:
    """At most so many rows of each key, in order, with their place."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)


def breaker(events: DataFrame, key: str, at: str, failed: str, order: str, threshold: int = 15, reset: float = 60.0) -> DataFrame:
    """Adds allowed and state to requests (key, at in seconds, failed): closed, open or half-open after so many failures.

    After threshold failures in a row, requests of a key are refused until reset seconds have passed; then one probe is
    let through, whose success closes the breaker and whose failure opens it again. Requests of a key stream in order
    through one task, which holds the state of a single key at a time.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, count, last, opened = None, 0, 0.0, False
        for pdf in parts:
            allowed, states = [], []
            for k, t, bad in zip(pdf[key], pdf[at], pdf[failed]):
                if k != now:
                    now, count, last, opened = k, 0, 0.0, False
                go = not opened or t - last >= reset
                states.append("closed" if not opened else "half_open" if go else "open")
                allowed.append(go)
                if go and bad:
                    count, last = count + 1, t
                    opened = count >= threshold
                elif go:
                    count, opened = 0, False
            yield pdf.assign(allowed=allowed, state=states)

    ordered = events.repartition(key).sortWithinPartitions(key, at, order)
    return ordered.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema) + ", allowed boolean, state string")
