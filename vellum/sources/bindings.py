"""The engine's entities on the data folder's tables, and the same as SQL for the oracles.

A source is a product; an event is a job; a line item is a finding; an order is a document of findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text

from .tables import read

# The categories that a product's findings should cover.
CATEGORIES = ("data_collection", "data_purposes", "data_sharing", "user_rights", "retention", "security", "cookies_tracking", "data_sale", "international_transfers", "government_access", "corporate_family_sharing", "ai_training", "automated_decisions", "content_ownership", "scope_expansion", "liability", "dispute_resolution", "indemnification", "termination_consequences", "children", "breach_notification", "consent_mechanisms", "account_lifecycle")
STATUSES = {"view": "pending", "click": "crawling", "signup": "completed", "purchase": "analyzing", "error": "failed"}

CATEGORY_LIST = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"

JOBS = """
jobs AS (
  SELECT event_id AS id, 'p' || user_id AS product_slug,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'crawling' WHEN 'signup' THEN 'completed' WHEN 'purchase' THEN 'analyzing' WHEN 'error' THEN 'failed' END AS status,
    event_type <> 'signup' AND event_type <> 'error' AS active, event_id % 3 = 0 AS skip_crawl, CAST(event_id % 14 AS INTEGER) AS attempts,
    ts AS created_at, ts + INTERVAL 5 MINUTE AS updated_at, CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 4 MINUTE END AS last_heartbeat,
    CASE event_id % 6 WHEN 0 THEN 'HTTP 403 forbidden by host' WHEN 1 THEN 'request timeout after 30s' WHEN 2 THEN 'blocked by robots.txt' WHEN 3 THEN 'connection reset by peer' WHEN 4 THEN 'HTTP 503 unavailable' END AS error,
    CASE event_id % 6 WHEN 0 THEN 403 WHEN 4 THEN 503 END AS status_code, value
  FROM events
)"""

FINDINGS = f"""
findings AS (
  SELECT l_suppkey AS product_id, l_orderkey AS document_id, {CATEGORY_LIST}[CAST(l_partkey % 23 AS INTEGER) + 1] AS category,
    'Level  ' || CAST(CAST(l_quantity AS INTEGER) % 4 AS VARCHAR) || ' ' || l_returnflag AS value,
    lower(trim(regexp_replace('Level  ' || CAST(CAST(l_quantity AS INTEGER) % 4 AS VARCHAR) || ' ' || l_returnflag, '\\s+', ' ', 'g'))) AS normalized_value,
    ['material', 'notable', 'standard', NULL][l_linenumber % 4 + 1] AS materiality, CAST(l_linenumber % 3 AS INTEGER) AS evidence,
    CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS seq
  FROM lineitem
)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])[F.col("event_type")]
    kind = F.col("event_id") % 6
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("product_slug"),
        status.alias("status"),
        (~F.col("event_type").isin("signup", "error")).alias("active"),
        (F.col("event_id") % 3 == 0).alias("skip_crawl"),
        (F.col("event_id") % 14).cast("int").alias("attempts"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("updated_at"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("INTERVAL 4 MINUTES")).alias("last_heartbeat"),
        F.when(kind == 0, "HTTP 403 forbidden by host").when(kind == 1, "request timeout after 30s").when(kind == 2, "blocked by robots.txt").when(kind == 3, "connection reset by peer").when(kind == 4, "HTTP 503 unavailable").alias("error"),
        F.when(kind == 0, 403).when(kind == 4, 503).alias("status_code"),
        "value",
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    value = F.concat(F.lit("Level  "), (F.col("l_quantity").cast("int") % 4).cast("string"), F.lit(" "), F.col("l_returnflag"))
    names = F.array(*map(F.lit, CATEGORIES))
    levels = F.array(F.lit("material"), F.lit("notable"), F.lit("standard"), F.lit(None).cast("string"))
    return li.select(
        F.col("l_suppkey").alias("product_id"),
        F.col("l_orderkey").alias("document_id"),
        F.get(names, (F.col("l_partkey") % 23).cast("int")).alias("category"),
        value.alias("value"),
        text.normalize_value(value).alias("normalized_value"),
        F.get(levels, (F.col("l_linenumber") % 4).cast("int")).alias("materiality"),
        (F.col("l_linenumber") % 3).cast("int").alias("evidence"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("seq"),
    )


#: What the documents table's texts are headed by, addressed and titled with, so that they read as a site's pages.
OPENINGS = (
    "Privacy Policy. Last updated May 2024. We collect personal information and personal data; your rights, data retention and data sharing are described here.",
    "Terms of Service. Effective date: 1 June. By using our service you accept these; governing law, dispute resolution, arbitration and limitation of liability follow.",
    "Cookie policy: cookies we use, web beacons and analytics cookies. Last revised in March. Manage cookies in your cookie settings.",
    "Home. About. Contact. Search the menu.",
    "For users in Germany and for EU residents: GDPR applies, with a data protection officer.",
    "For California residents: CCPA and HIPAA notices. This agreement is governed by the laws of the State of New York.",
    "Copyright infringement and DMCA: send a takedown notice. Published: 2023. Fair use and intellectual property stay untouched.",
    "Data processing agreement between data controller and data processor; sub-processor list, effective at once.",
    "Politique de confidentialité et conditions d'utilisation: données personnelles.",
    "Datenschutzerklärung und Nutzungsbedingungen, personenbezogene Daten.",
    "Términos de servicio y política de privacidad.",
    "We are committed to protecting your privacy. Effective date and jurisdiction: courts of England.",
    "Our recipes of the week, with news of the kitchen.",
    "Users in Japan and Singapore: PDPA and APPI; SOC 2 and ISO 27001 reports.",
    "Security practices and data breach notification; vendors and subprocessors are audited for compliance.",
    "",
)
ADDRESSES = ("/legal/privacy", "/terms-of-service", "/en/blog/post", "/de-de/datenschutz", "/help/terms/?next=/privacy", "/company/legal/cookies", "/eu/notice", "/uk/terms/glossary-word", "/login", "/gallery/terms", "/policy/data?topic=privacy%20policy", "/about#privacy-policy", "/a0b1c2d3e4f5a6b7c8d9e0f1a2b3c4d5e6f7/x", "/trust/sub-processors", "/datahub/privacyportal", "/br/aviso", "/")
TITLES = ("Privacy Policy", "Photos of the day", "Terms of Use", "Cookie Notice", "", "EU privacy and GDPR", "Grandpa's page", "Trust center: information security", "News", "Children's privacy", "Acceptable use")
ANCHORS = ("Privacy Policy", "read more", "terms of service", "", "Legal notice", "contact", "GDPR and cookies")


def _pick(values: tuple[str, ...], key: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, url, title, text, lang: the documents as pages of sites; every seventh is its opening alone."""
    body = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.coalesce("text", F.lit(""))))
    own = read(spark, sf_dir, "documents").where("doc_id is not null")
    address = F.concat(F.lit("https://site"), (F.col("doc_id") % 50).cast("string"), F.lit(".example"), _pick(ADDRESSES, "doc_id"))
    return own.select("doc_id", address.alias("url"), _pick(TITLES, "doc_id").alias("title"), F.concat(_pick(OPENINGS, "doc_id"), body).alias("text"), "lang")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, anchor: each page's address followed by a policy's path, and the text of a link to it."""
    host = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    return read(spark, sf_dir, "pages").select("page_id", F.concat(host, _pick(ADDRESSES, "page_id")).alias("url"), _pick(ANCHORS, "page_id").alias("anchor"))


def _list(values) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


POLICIES = f"""
policies AS (
  SELECT doc_id, 'https://site' || (doc_id % 50) || '.example' || {_list(ADDRESSES)}[doc_id % {len(ADDRESSES)} + 1] AS url, {_list(TITLES)}[doc_id % {len(TITLES)} + 1] AS title,
    {_list(OPENINGS)}[doc_id % {len(OPENINGS)} + 1] || CASE WHEN doc_id % 7 = 0 THEN '' ELSE ' ' || coalesce(text, '') END AS text, lang
  FROM documents WHERE doc_id IS NOT NULL)"""
LINKS = f"""
links AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || {_list(ADDRESSES)}[page_id % {len(ADDRESSES)} + 1] AS url, {_list(ANCHORS)}[page_id % {len(ANCHORS)} + 1] AS anchor FROM pages)"""
