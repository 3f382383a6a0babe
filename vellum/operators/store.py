"""Writes on plain tables: guarded updates, upserts, deletes, change logs and histories, all as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRADES = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5}


def guarded_update(old: DataFrame, new: DataFrame, key: str, heavy: list[str]) -> DataFrame:
    """Rows of both; a new value wins, but an empty one never overwrites a heavy column."""
    o, n = old.alias("o"), new.alias("n")
    fresh = lambda c: F.when(F.col(f"n.{c}") == "", None).otherwise(F.col(f"n.{c}")) if c in heavy else F.col(f"n.{c}")
    picked = [F.coalesce(fresh(c), F.col(f"o.{c}")).alias(c) for c in old.columns if c != key]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *picked)


def upsert(old: DataFrame, new: DataFrame, key: str, on_insert: dict[str, Column]) -> DataFrame:
    """New values by key; columns in on_insert are set only where the row did not exist."""
    o, n = old.alias("o"), new.alias("n")
    inserted = F.col(f"o.{key}").isNull()
    columns = []
    for c in old.columns:
        if c == key:
            columns.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c in on_insert:
            columns.append(F.when(inserted, on_insert[c]).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            columns.append((F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")).alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str], sets: list[str] = ()) -> DataFrame:
    """(key, changed): which fields differ, sets compared without order; unchanged rows are left out."""
    o, n = old.alias("o"), new.alias("n")

    def differ(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        return ~F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b))) if c in sets else ~a.eqNullSafe(b)

    changed = F.array_compact(F.array(*[F.when(differ(c), F.lit(c)) for c in [*fields, *sets]]))
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}")).select(F.col(f"o.{key}").alias(key), changed.alias("changed"))
    return both.where(F.size("changed") > 0)


def cascade_delete(owner: str, members: DataFrame, key: str, owners: str) -> tuple[DataFrame, DataFrame]:
    """(left, deleted): rows lose the owner; those with no other owner go."""
    rest = members.withColumn(owners, F.array_remove(owners, owner))
    touched = F.array_contains(members[owners], owner)
    return rest.where(~(touched & (F.size(owners) == 0))), members.where(touched).withColumn(owners, F.array_remove(owners, owner)).where(F.size(owners) == 0).select(key)


def mark_stale(rows: DataFrame, nested: str, document: Column) -> DataFrame:
    """Citations of a document become stale inside an array of structs (document_id, verified, stale)."""
    return rows.withColumn(nested, F.transform(nested, lambda c: c.withField("stale", F.when(c["document_id"] == document, F.lit(True)).otherwise(c["stale"]))))


def displayable(citations: Column) -> Column:
    return F.filter(citations, lambda c: c["verified"] & ~c["stale"])


def history(snapshots: DataFrame, key: str, ts: str, state: str, grade: str, keep: int = 20) -> DataFrame:
    """Snapshots whose state differs from the one before, with the grade's change, newest first, at most keep."""
    w = W.partitionBy(key).orderBy(ts)
    value = F.create_map(*[F.lit(x) for p in GRADES.items() for x in p])
    before = F.lag(state).over(w)
    new = snapshots.withColumn("delta", value[F.col(grade)] - value[F.lag(grade).over(w)]).withColumn("same", F.coalesce(before == F.col(state), F.lit(False))).where("not same")
    return new.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc(ts)))).where(F.col("place") <= keep).drop("same")


def orphans(citations: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Cited documents that do not exist."""
    return citations.select(key).distinct().join(documents.select(key), key, "left_anti")


def three_tiers(incoming: DataFrame, known: DataFrame, exact: str, canonical: str, content: list[str]) -> DataFrame:
    """(id, match, tier): an existing row by exact URL, else by canonical URL, else by owner and content."""
    first = lambda keys, name: known.groupBy(*keys).agg(F.min("id").alias(name))
    out = incoming.join(first([exact], "m1"), [exact], "left").join(first([canonical], "m2"), [canonical], "left").join(first(content, "m3"), content, "left")
    tier = F.when(F.col("m1").isNotNull(), "url").when(F.col("m2").isNotNull(), "canonical").when(F.col("m3").isNotNull(), "content")
    return out.select("id", F.coalesce("m1", "m2", "m3").alias("match"), tier.alias("tier"))


def set_field(rows: DataFrame, values: DataFrame, key: str, name: str) -> DataFrame:
    """One field of the rows set from (key, name) where there is a value; all other fields and rows stay."""
    new = values.select(key, F.col(name).alias("_new"))
    return rows.join(new, key, "left").withColumn(name, F.coalesce("_new", name)).drop("_new")


def upsert_action(old: Column, new: Column, metadata: Column) -> Column:
    """update where an incoming text and its metadata hash to something else; an empty text never overwrites."""
    digest = lambda x: F.sha2(F.concat(F.coalesce(x, F.lit("")), F.coalesce(metadata, F.lit(""))), 256)
    return F.when(F.coalesce(new, F.lit("")) == "", "skip").when(digest(new) == digest(old), "skip").otherwise("update")
