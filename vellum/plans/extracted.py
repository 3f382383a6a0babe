"""Queries over the fields of extractions: findings of each field, merged items, materiality and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text
from vellum.operators import findings as fnd
from vellum.operators import materiality, merge, rollup
from vellum.sources.bindings import FINDINGS, findings
from vellum.sources.tables import read

from .registry import Registry

register = Registry()
QUERIES, ORACLE_SQL = register.queries, register.oracles

#: Attributes of extracted items, each as SQL that Spark and DuckDB share, over one line item.
Q = "CAST(l_quantity AS INTEGER)"
ATTRIBUTES = {
    "value": "concat('Term  ', CAST(l_partkey % 4 AS STRING))",
    "materiality": f"CASE (l_partkey + {Q}) % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'notable' WHEN 2 THEN 'material' END",
    "data_type": "CASE WHEN l_partkey % 7 = 0 THEN ' ' ELSE concat('Data ', CAST(l_partkey % 9 AS STRING)) END",
    "destination": "CASE WHEN l_suppkey % 6 = 5 THEN '' ELSE concat('Land  ', CAST(l_suppkey % 6 AS STRING)) END",
    "authority_type": "CASE WHEN l_partkey % 5 = 4 THEN '' ELSE concat('Agency ', CAST(l_partkey % 5 AS STRING)) END",
    "conditions": "CASE WHEN l_suppkey % 3 > 0 THEN concat('By  order ', CAST(l_suppkey % 3 AS STRING)) END",
    "right_type": "CASE WHEN l_partkey % 6 = 5 THEN '' ELSE concat('Right ', CAST(l_partkey % 6 AS STRING)) END",
    "description": f"CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE concat('Text ', repeat('d', {Q} % 5 + 1)) END",
    "usage_type": "CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'training_on_user_data' WHEN 2 THEN 'profiling' ELSE 'ranking' END",
    "mechanism": f"CASE {Q} % 4 WHEN 0 THEN 'arbitration' WHEN 1 THEN 'Mediation' WHEN 2 THEN 'odd' ELSE '' END",
    "limitation_type": f"CASE {Q} % 4 WHEN 0 THEN 'cap' WHEN 1 THEN ' Exclusion ' WHEN 2 THEN 'odd' END",
    "scope": "concat('Scope ', CAST(l_partkey % 3 AS STRING))",
    "venue": "concat('City ', CAST(l_suppkey % 2 AS STRING))",
    "governing_law": "concat('Law ', CAST(l_partkey % 2 AS STRING))",
    "ownership_type": f"CASE {Q} % 3 WHEN 0 THEN 'user_retains' WHEN 1 THEN 'Company_Owns' ELSE 'odd' END",
    "scope_type": f"CASE {Q} % 3 WHEN 0 THEN 'cross_entity' WHEN 1 THEN 'survival_clause' ELSE 'odd' END",
    "purpose": f"concat('use ', CAST({Q} % 3 AS STRING))",
    "extends_beyond_product": "l_returnflag = 'R'",
    "class_action_waiver": "l_returnflag = 'A'",
    "jury_trial_waiver": "l_linestatus = 'F'",
}
#: Arrays, for which the two dialects differ: (first, second element).
ARRAYS = {
    "data_types": ("l_returnflag", "l_linestatus"),
    "data_shared": ("l_linestatus", "l_returnflag"),
    "purposes": ("l_returnflag", "l_linestatus"),
    "entities": ("concat('U', CAST(l_partkey % 3 AS STRING))", "concat('V', CAST(l_suppkey % 2 AS STRING))"),
    "entities_affected": ("concat('V', CAST(l_suppkey % 2 AS STRING))", "concat('U', CAST(l_partkey % 2 AS STRING))"),
}
SEQ = "((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"
DUCK = ", ".join([*(f"{e} AS {c}" for c, e in ATTRIBUTES.items()), *(f"[{a}, {b}] AS {c}" for c, (a, b) in ARRAYS.items())])
ITEM = f"item AS (SELECT l_orderkey AS document_id, {SEQ} AS seq, {DUCK} FROM lineitem), own AS (SELECT l_orderkey AS document_id, min(l_suppkey) % 10 AS product_id FROM lineitem GROUP BY l_orderkey)"


def items(spark, sf_dir, *columns):
    """One extracted item for each line item of an order, its document."""
    made = [*(f"{e} AS {c}" for c, e in ATTRIBUTES.items() if c in columns), *(f"array({a}, {b}) AS {c}" for c, (a, b) in ARRAYS.items() if c in columns)]
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS document_id", "l_suppkey", f"{SEQ} AS seq", *made)


def extraction(spark, sf_dir, field, *columns):
    """Documents with the items of one field in order."""
    own = F.array_sort(F.collect_list(F.struct("seq", *columns)))
    rows = items(spark, sf_dir, *columns).groupBy("document_id").agg((F.min("l_suppkey") % 10).alias("product_id"), own.alias(field))
    return rows


NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"


def finding(name, field, columns, category, value, key, keep):
    """Registers the findings of one field: what a document of a product states."""

    def run(spark, sf_dir):
        rows = extraction(spark, sf_dir, field, *columns)
        made = fnd.of_ai_usage(rows) if field == "ai_usage" else fnd.of_field(rows, field)
        return made.select("product_id", "document_id", "category", "value", "normalized_value")

    run.__name__, run.__doc__ = name, f"Findings of {field}."
    register(f"WITH {ITEM} SELECT product_id, document_id, {category} AS category, {value} AS value, {NORM.format(key)} AS normalized_value FROM item JOIN own USING (document_id) WHERE {keep}")(run)


finding("fnd3_data_purposes", "data_purposes", ("data_type", "purposes"), "'data_purposes'", "data_type", "data_type", "trim(data_type) <> ''")
finding("fnd5_transfers", "international_transfers", ("destination",), "'international_transfers'", "destination", "destination", "destination <> ''")
finding("fnd6_government_access", "government_access", ("authority_type", "conditions"), "'government_access'", "authority_type || ': ' || coalesce(conditions, '')", "authority_type || ':' || coalesce(conditions, '')", "authority_type <> ''")
finding("fnd7_corporate_family", "corporate_family_sharing", ("entities",), "'corporate_family_sharing'", "array_to_string(entities, ', ')", "array_to_string(entities, ',')", "true")
finding("fnd8_user_rights", "user_rights", ("right_type",), "'user_rights'", "right_type", "right_type", "right_type <> ''")
finding("fnd9_ai_usage", "ai_usage", ("usage_type", "description"), "CASE WHEN usage_type = 'training_on_user_data' THEN 'ai_training' ELSE 'automated_decisions' END", "CASE WHEN description <> '' THEN description ELSE usage_type END", "usage_type || ':' || description", "usage_type <> ''")
finding("fnd10_liability", "liability", ("description",), "'liability'", "description", "description", "description <> ''")
finding("fnd10_content_ownership", "content_ownership", ("description",), "'content_ownership'", "description", "description", "description <> ''")
finding("fnd10_scope_expansion", "scope_expansion", ("description",), "'scope_expansion'", "description", "description", "description <> ''")
finding("fnd11_dispute_resolution", "dispute_resolution", ("mechanism", "description"), "'dispute_resolution'", "CASE WHEN description <> '' THEN description ELSE mechanism END", "mechanism", "mechanism <> ''")

CHILD = f"SELECT l_orderkey AS document_id, min(l_suppkey) % 10 AS product_id, max(CASE WHEN l_returnflag = 'R' THEN {Q} END) AS age, count(*) FILTER (l_linestatus = 'O') > 5 AS consent, CASE WHEN min(l_partkey) % 2 = 0 THEN 'No adverts' END AS care FROM lineitem GROUP BY l_orderkey"


@register(f"SELECT * FROM (SELECT product_id, document_id, 'children' AS category, concat_ws('; ', 'Minimum age: ' || age, CASE WHEN consent THEN 'Parental consent required' END, care) AS value, lower(concat_ws('; ', 'Minimum age: ' || age, CASE WHEN consent THEN 'Parental consent required' END, care)) AS normalized_value FROM ({CHILD})) WHERE value <> ''")
def fnd14_children(spark, sf_dir):
    """What each document says of children."""
    li = read(spark, sf_dir, "lineitem")
    policy = F.struct(
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("int"))).alias("minimum_age"),
        (F.count_if(F.col("l_linestatus") == "O") > 5).alias("parental_consent_required"),
        F.when(F.min("l_partkey") % 2 == 0, "No adverts").alias("special_protections"),
    )
    rows = li.groupBy(F.col("l_orderkey").alias("document_id")).agg((F.min("l_suppkey") % 10).alias("product_id"), policy.alias("children_policy"))
    return fnd.of_children(rows).select("product_id", "document_id", "category", "value", "normalized_value")


SIGNAL = "CASE (l_orderkey + {0}) % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unclear' END"


@register(f"SELECT product_id, document_id, category, s || ': ' || v AS value, s || ':' || v AS normalized_value FROM (SELECT l_orderkey AS document_id, min(l_suppkey) % 10 AS product_id, unnest({[*fnd.SIGNALS]}) AS s, unnest({[*fnd.SIGNALS.values()]}) AS category, unnest([{', '.join(SIGNAL.format(i) for i in range(len(fnd.SIGNALS)))}]) AS v FROM lineitem GROUP BY l_orderkey) WHERE v IN ('yes', 'no')")
def fnd15_signals(spark, sf_dir):
    signals = F.struct(*[F.expr(SIGNAL.format(i)).alias(s) for i, s in enumerate(fnd.SIGNALS)])
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.min("l_suppkey") % 10).alias("product_id"))
    return fnd.of_signals(rows.select("product_id", F.col("l_orderkey").alias("document_id"), signals.alias("privacy_signals"))).select("product_id", "document_id", "category", "value", "normalized_value")


def merged(name, field, columns, key, out, where="true", kind=None):
    """Registers a field's merged items: out maps an attribute to its SQL."""
    used = (*columns, *([kind[0]] if kind else []))

    def run(spark, sf_dir):
        rows = merge.merge_field(merge.keyed(items(spark, sf_dir, *used), field), field)
        return rows.select("document_id", "key", *[F.array_join(F.array_sort(c), ",").alias(c) if c in ARRAYS and c != "entities" else F.array_join(c, ",").alias(c) if c == "entities" else c for c in out])

    run.__name__, run.__doc__ = name, f"Items of {field} merged by document and key."
    known = "" if kind is None else f", CASE WHEN lower(trim({kind[0]})) IN ({', '.join(repr(k) for k in merge.KINDS[field][1])}) THEN lower(trim({kind[0]})) ELSE '{merge.KINDS[field][2]}' END AS kind"
    unions = [c for c in out if c in ARRAYS and c != "entities"]
    sets = "".join(f", {c}_of AS (SELECT document_id, key, string_agg(DISTINCT v, ',' ORDER BY v) AS {c} FROM (SELECT document_id, key, unnest({c}) AS v FROM k) GROUP BY ALL)" for c in unions)
    joins = "".join(f" LEFT JOIN {c}_of USING (document_id, key)" for c in unions)
    plain = ", ".join(f"{e} AS {c}" for c, e in out.items() if c not in unions)
    register(f"WITH {ITEM}, i AS (SELECT *{known} FROM item), k AS (SELECT *, {NORM.format(key)} AS key FROM i WHERE {where}){sets}, m AS (SELECT document_id, key{', ' + plain if plain else ''} FROM k GROUP BY document_id, key) SELECT * FROM m{joins}")(run)


FIRST = "arg_min({0}, seq)"
RANK = "arg_max(materiality, CAST(CASE materiality WHEN 'standard' THEN 1 WHEN 'notable' THEN 2 WHEN 'material' THEN 3 ELSE 0 END AS HUGEINT) * 1000000000000000000000 - seq)"
merged("mrg1_text_items", "text_items", ("value", "materiality"), "value", {"value": FIRST.format("value"), "materiality": RANK})
merged("mrg7_transfers", "international_transfers", ("destination", "mechanism", "data_types"), "destination", {"destination": FIRST.format("destination"), "mechanism": "arg_min(mechanism, seq)", "data_types": ""}, "destination <> ''")
merged("mrg8_government_access", "government_access", ("authority_type", "conditions"), "authority_type || ':' || coalesce(conditions, '')", {"authority_type": FIRST.format("authority_type")})
merged("mrg9_corporate_family", "corporate_family_sharing", ("entities", "purpose", "data_shared"), "array_to_string(list_sort(entities), ',')", {"entities": "array_to_string(arg_min(entities, seq), ',')", "purpose": FIRST.format("purpose"), "data_shared": ""})
merged("mrg10_user_rights", "user_rights", ("right_type", "mechanism", "description"), "right_type", {"right_type": FIRST.format("right_type"), "mechanism": FIRST.format("mechanism"), "description": "arg_max(description, CAST(length(description) AS HUGEINT) * 1000000000000000000000 - seq)"}, "right_type <> ''")
merged("mrg13_liability", "liability", ("scope", "description", "extends_beyond_product"), "kind || ':' || scope", {"scope": FIRST.format("scope"), "limitation_type": "min(kind)", "description": FIRST.format("description"), "extends_beyond_product": "bool_or(extends_beyond_product)"}, kind=("limitation_type",))
merged("mrg14_dispute", "dispute_resolution", ("venue", "governing_law", "class_action_waiver", "jury_trial_waiver"), "kind || ':' || venue || ':' || governing_law", {"mechanism": "min(kind)", "venue": FIRST.format("venue"), "governing_law": FIRST.format("governing_law"), "class_action_waiver": "bool_or(class_action_waiver)", "jury_trial_waiver": "bool_or(jury_trial_waiver)"}, kind=("mechanism",))
merged("mrg15_content_ownership", "content_ownership", ("scope", "description"), "kind || ':' || scope", {"ownership_type": "min(kind)", "scope": FIRST.format("scope"), "description": FIRST.format("description")}, kind=("ownership_type",))
merged("mrg16_scope_expansion", "scope_expansion", ("description", "entities_affected"), "kind || ':' || description", {"scope_type": "min(kind)", "description": FIRST.format("description"), "entities_affected": ""}, kind=("scope_type",))


#: Terms with labels as stored or as a model gave them.
TERM = "CASE l_partkey % 5 WHEN 0 THEN '  ' ELSE concat('term ', CAST(l_partkey % 5 AS STRING)) END"
LABEL = f"CASE {Q} % 5 WHEN 0 THEN 'standard_industry' WHEN 1 THEN ' Notable' WHEN 2 THEN 'MATERIAL_RISK' WHEN 3 THEN 'odd' END"
TIER = f"CASE WHEN lower(trim({LABEL})) IN ('standard_industry', 'notable', 'material_risk') THEN lower(trim({LABEL})) WHEN trim({TERM}) = '' THEN 'standard_industry' ELSE 'material_risk' END"
GIVEN = "CASE l_linenumber % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'low' WHEN 3 THEN 'odd' END"
SAID = "CASE l_suppkey % 4 WHEN 0 THEN 'Blocker' WHEN 1 THEN 'critical' WHEN 2 THEN 'nuance' ELSE '' END"
LINE = "l_orderkey, l_linenumber, l_partkey"


def terms(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{TERM} AS text", f"{LABEL} AS label", f"{GIVEN} AS severity", f"{SAID} AS classification")


@register(f"SELECT {LINE}, t AS tier, t <> 'material_risk' AS excluded FROM (SELECT *, {TIER} AS t FROM lineitem)")
def cls6_materiality_tiers(spark, sf_dir):
    """The tier of every term, and whether it is left out of the dangers."""
    t, label = F.col("text"), F.col("label")
    return terms(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", materiality.tier(t, label).alias("tier"), materiality.excluded(t, label).alias("excluded"))


@register(f"SELECT {LINE}, CASE WHEN t = 'standard_industry' THEN 'low' WHEN t = 'notable' AND s IN ('critical', 'high') THEN 'medium' WHEN s IN ('critical', 'high', 'medium', 'low') THEN s ELSE 'medium' END AS severity FROM (SELECT *, {TIER} AS t, lower({GIVEN}) AS s FROM lineitem)")
def cls7_calibrated_severity(spark, sf_dir):
    return terms(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", materiality.severity(F.col("severity"), F.col("text"), F.col("label")).alias("severity"))


@register(f"SELECT {LINE}, CASE WHEN t = 'notable' THEN CASE WHEN lower(s) IN ('critical', 'high') THEN 'medium' WHEN lower(s) = 'low' THEN 'low' ELSE 'medium' END ELSE s END AS severity, CASE WHEN t = 'notable' AND c <> 'nuance' THEN 'informational' ELSE c END AS classification FROM (SELECT *, {TIER} AS t, {GIVEN} AS s, {SAID} AS c FROM lineitem) WHERE t <> 'standard_industry'")
def cls7_watch_out_cases(spark, sf_dir):
    """Cases to watch out for, calibrated by their tier."""
    return materiality.watch_out(terms(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_partkey", "severity", "classification")


@register(f"SELECT label, count(*) AS n, count(*) FILTER (t = 'material_risk') AS material FROM (SELECT coalesce(lower(trim({LABEL})), 'none') AS label, {TIER} AS t FROM lineitem) GROUP BY label")
def udf5_labelled_terms(spark, sf_dir):
    """Each different term is labelled once, by a provider's batch labels joined to it; here the stored labels are the batch."""
    own = terms(spark, sf_dir).select("text", "label").groupBy("text", "label").agg(F.count("*").alias("n"))
    marked = own.withColumn("tier", materiality.tier(F.col("text"), F.col("label")))
    material = F.sum(F.when(F.col("tier") == materiality.MATERIAL, F.col("n")).otherwise(0))
    return marked.groupBy(F.coalesce(F.lower(F.trim("label")), F.lit("none")).alias("label")).agg(F.sum("n").alias("n"), material.alias("material"))


RISK = "['low', 'medium', 'high', 'odd'][CAST(s % 4 AS INTEGER) + 1]"
SIGNALS = f"""
{FINDINGS.strip()},
one AS (SELECT product_id, category, normalized_value, arg_min(value, seq) AS value, count(DISTINCT document_id) AS d, min(seq) AS s, CASE max(CASE materiality WHEN 'material' THEN 3 WHEN 'notable' THEN 2 WHEN 'standard' THEN 1 END) WHEN 3 THEN 'material_risk' WHEN 2 THEN 'notable' WHEN 1 THEN 'standard_industry' END AS label FROM findings GROUP BY ALL),
tiers AS (SELECT *, coalesce(label, 'material_risk') AS t, s % 3 > 0 AS has FROM one),
signals AS (SELECT product_id, category, CASE category
  WHEN 'data_sale' THEN 6 WHEN 'ai_training' THEN 6 WHEN 'breach_notification' THEN 5 WHEN 'children' THEN 6
  WHEN 'data_collection' THEN CASE WHEN has THEN least(10, CASE s % 4 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 7 ELSE 5 END + CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END) ELSE 5 END
  WHEN 'data_sharing' THEN CASE WHEN has THEN CASE s % 4 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 8 ELSE 6 END ELSE 6 END
  WHEN 'cookies_tracking' THEN CASE WHEN has THEN greatest(CASE WHEN s % 2 = 0 THEN 7 ELSE 5 END, CASE WHEN s % 5 = 0 THEN 8 ELSE 0 END) ELSE 6 END
  WHEN 'security' THEN CASE WHEN d >= 2 THEN 3 ELSE 4 END WHEN 'user_rights' THEN CASE WHEN d >= 2 THEN 3 ELSE 4 END
  WHEN 'government_access' THEN 7 WHEN 'liability' THEN 7 WHEN 'scope_expansion' THEN 7
  WHEN 'indemnification' THEN CASE t WHEN 'standard_industry' THEN 3 WHEN 'notable' THEN 5 ELSE 7 END WHEN 'international_transfers' THEN CASE t WHEN 'standard_industry' THEN 3 WHEN 'notable' THEN 5 ELSE 7 END
  WHEN 'dispute_resolution' THEN CASE t WHEN 'material_risk' THEN 6 ELSE 4 END
  WHEN 'termination_consequences' THEN CASE t WHEN 'standard_industry' THEN 3 ELSE 5 END
  WHEN 'content_ownership' THEN CASE t WHEN 'standard_industry' THEN 3 WHEN 'notable' THEN 5 ELSE 7 END
  ELSE 5 END AS signal FROM tiers)"""


@register(f"WITH {SIGNALS} SELECT product_id, category, m AS signal, CASE WHEN m <= 3 THEN 'fair' WHEN m <= 6 THEN 'concerning' ELSE 'harmful' END AS stance FROM (SELECT product_id, category, CAST(round_even(avg(signal), 0) AS INTEGER) AS m FROM signals GROUP BY ALL)")
def agg15_topic_signals(spark, sf_dir):
    """The mean signal of each topic, and the stance it stands for."""
    rank = F.max(F.when(F.col("materiality") == "material", 3).when(F.col("materiality") == "notable", 2).when(F.col("materiality") == "standard", 1))
    one = findings(spark, sf_dir).groupBy("product_id", "category", "normalized_value").agg(F.min_by("value", "seq").alias("value"), F.countDistinct("document_id").alias("d"), F.min("seq").alias("s"), rank.alias("rank"))
    label = F.when(F.col("rank") == 3, materiality.MATERIAL).when(F.col("rank") == 2, materiality.NOTABLE).when(F.col("rank") == 1, materiality.STANDARD)
    level = F.get(F.array(*map(F.lit, ("low", "medium", "high", "odd"))), (F.col("s") % 4).cast("int"))
    signal = materiality.topic_signal(F.col("category"), F.col("value"), label, F.col("d"), level, F.when(F.col("s") % 2 == 0, "required").otherwise("optional"), level, F.col("s") % 2 == 0, F.when(F.col("s") % 5 == 0, "Advertising").otherwise("other"), F.col("s") % 3 > 0)
    return materiality.topic_stances(one.select("product_id", "category", signal.alias("signal")))


GUARDED = f"""SELECT l_orderkey AS id, min(l_partkey) % 3 = 0 AS adequate, CASE WHEN min(l_suppkey) % 3 = 0 THEN ' ' ELSE repeat('word ', CAST(min({Q}) AS INTEGER)) END AS headline, repeat('sum ', CAST(max({Q}) AS INTEGER)) AS summary, repeat('why ', CAST(max({Q}) AS INTEGER)) AS justification,
  CASE WHEN max(l_partkey) % 2 = 0 THEN 'e' ELSE 'B' END AS grade, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS silent, sum(CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_linenumber % 2 END) AS evidence,
  count(*) FILTER (l_linestatus = 'F') AS dangers, count(*) FILTER (l_linestatus = 'O') AS benefits, count(*) FILTER (l_partkey % 3 = 0) AS paths, count(*) FILTER (l_partkey % 3 = 1) AS contacts, count(*) FILTER (l_suppkey % 3 > 0) AS acts FROM lineitem GROUP BY l_orderkey"""


@register(f"SELECT id, NOT adequate OR trim(headline) <> '' AS headline_not_empty, NOT (grade = 'e' AND silent / n > 0.7 AND evidence = 0) AS no_e_grade_on_silence, len(regexp_extract_all(summary, '\\w+')) <= 20 AS summary_length, len(regexp_extract_all(headline, '\\w+')) <= 25 AS headline_length, len(regexp_extract_all(justification, '\\w+')) <= 35 AS no_long_sentences, dangers < 5 OR benefits >= 2 AS dangers_benefits_balance, paths / n >= 0.7 OR paths + contacts = n AS rights_have_paths, acts / n >= 0.7 AS actions_actionable, NOT ((NOT adequate OR trim(headline) <> '') AND NOT (grade = 'e' AND silent / n > 0.7 AND evidence = 0)) AS re_roll FROM ({GUARDED})")
def cls12_overview_guards(spark, sf_dir):
    """Checks of overviews, an order each: its lines are rights, actions, dangers, benefits and stances."""
    line = lambda cond, x: F.array_compact(F.collect_list(F.when(cond, x)))
    right = F.when(F.col("l_partkey") % 3 == 0, "See Settings to opt").when(F.col("l_partkey") % 3 == 1, "Contact them").otherwise("You may ask")
    act = F.when(F.col("l_suppkey") % 3 == 1, "Opt-out now").when(F.col("l_suppkey") % 3 == 2, "mail to a@b.c").otherwise("Think about it")
    stance = F.struct(F.when(F.col("l_returnflag") == "A", "missing").otherwise("found").alias("status"), F.when(F.col("l_returnflag") == "A", 0).otherwise(F.col("l_linenumber") % 2).cast("int").alias("evidence_count"))
    n = F.col("l_quantity").cast("int")
    o = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        (F.min("l_partkey") % 3 == 0).alias("adequate"), F.when(F.min("l_suppkey") % 3 == 0, " ").otherwise(F.repeat(F.lit("word "), F.min(n))).alias("headline"), F.repeat(F.lit("sum "), F.max(n)).alias("summary"), F.repeat(F.lit("why "), F.max(n)).alias("justification"),
        F.when(F.max("l_partkey") % 2 == 0, "e").otherwise("B").alias("grade"), F.collect_list(stance).alias("stances"), line(F.col("l_linestatus") == "F", F.lit("risk.")).alias("dangers"), line(F.col("l_linestatus") == "O", F.lit("good.")).alias("benefits"), F.collect_list(right).alias("rights"), F.collect_list(act).alias("actions"))
    checked = materiality.overview_guards(o, text.word_count, text.long_sentences)
    return checked.select("id", "headline_not_empty", "no_e_grade_on_silence", "summary_length", "headline_length", "no_long_sentences", "dangers_benefits_balance", "rights_have_paths", "actions_actionable", "re_roll")


@register("SELECT d.doc_id, p.source AS product, d.source = p.source AS owner FROM (SELECT doc_id, source, unnest(list_distinct([source, 'src' || CAST(doc_id % 20 AS VARCHAR)])) AS member FROM documents) d JOIN (SELECT DISTINCT source FROM documents) p ON p.source = d.member")
def jon2_membership(spark, sf_dir):
    """Documents with all products they belong to, by an equi-join after the membership list is exploded."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    member = F.explode(text.ordered_union(F.array("source"), F.array(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")))))
    return docs.select("doc_id", F.col("source").alias("own"), member.alias("product")).join(docs.select(F.col("source").alias("product")).distinct(), "product").select("doc_id", "product", (F.col("own") == F.col("product")).alias("owner"))


@register(f"WITH {FINDINGS}, c AS (SELECT product_id, category FROM findings WHERE category IN ('data_sale', 'retention', 'ai_training', 'breach_notification', 'children') GROUP BY ALL HAVING count(DISTINCT normalized_value) > 1) SELECT product_id, category, count(DISTINCT document_id) AS n_documents, CAST(sum(evidence) AS BIGINT) AS n_evidence FROM findings JOIN c USING (product_id, category) GROUP BY ALL")
def jon4_hydrated_conflicts(spark, sf_dir):
    """Conflicts with the evidence of the documents that they name."""
    f = findings(spark, sf_dir)
    few = rollup.conflicts(f).select("product_id", "category")
    return f.join(few, ["product_id", "category"]).groupBy("product_id", "category").agg(F.countDistinct("document_id").alias("n_documents"), F.sum("evidence").alias("n_evidence"))


@register(f"WITH i AS (SELECT l_orderkey AS d, {SEQ} AS seq, 'part ' || (l_partkey % 5) AS v FROM lineitem), k AS (SELECT d, 'they need ' || string_agg(DISTINCT v, ' and ' ORDER BY v) AS kp FROM i WHERE seq % 2 = 0 GROUP BY d), m AS (SELECT i.d, i.seq, row_number() OVER (PARTITION BY i.d ORDER BY i.seq) AS place FROM i JOIN k ON k.d = i.d AND contains(k.kp, i.v)) SELECT d AS document_id, seq, CAST(place AS INTEGER) AS place FROM m WHERE place <= 3")
def jon9_keypoint_evidence(spark, sf_dir):
    """At most three spans of evidence for each key point that names their value, within a document."""
    i = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS document_id", f"{SEQ} AS seq", "concat('Part ', CAST(l_partkey % 5 AS STRING)) AS value")
    points = i.where("seq % 2 = 0").groupBy("document_id").agg(F.concat(F.lit("They need "), F.array_join(F.array_sort(F.collect_set("value")), " and ")).alias("keypoint"))
    return rollup.keypoint_evidence(points, i).select("document_id", "seq", "place")
