"""Mixing sources to target weights by min-cost flow.

A text may stand in several sources. Texts are aggregated by membership pattern, the set of sources that hold them, and
a flow network routes their words: the origin feeds each pattern, first once for every distinct text, then a second
time, then what its rows still allow, each pass dearer than the one before (convex costs of repetition, whichever
source takes them); a pattern feeds its sources, each up to PASSES times the words of its rows there; a source ends in
its quota. The cheapest largest flow says how many words of a pattern each source takes; whole passes go to all its
rows, and the rest to rows in the order of a seeded hash, whose cut is found by histograms of the hash, finer and
finer, so no source is sorted in one task. What rounding to rows leaves of a source's target is then settled likewise
over the whole source.

Only patterns by source and sources reach the driver (patterns as arrays, some 200 bytes for each one by source),
whatever their number: the flow is the same at any size. Above MOST of them, tables of them meet rows by shuffles and
not by broadcasts, which changes no result.

Defined results: a null text has size 0; sizes of 0 are never taken; a null source is a source of its own, last in
order; null texts share nothing; repeated rows share a hash and stand next to each other in the order; no documents
give no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, PASSES, MOST, SEED = (5, 2, 1), 1.5, 2, 200_000, 17


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0))


def targets(sizes: list[tuple[str | None, int]], total: float, weights: tuple[int, ...] = WEIGHTS, most: float = PASSES) -> dict[str | None, float]:
    """Shares of total by weight, none above most times its source's size; the excess goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    open_, out, left = dict(order), {}, total
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s, n in open_.items() if share * weight[s] > most * n]
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = float(most * open_.pop(s))
            left -= out[s]
    return out


class Network:
    """A flow network with integer capacities; flows only grow."""

    def __init__(self) -> None:
        # origin, end; a node's edges are a chain from its first to its last, in the order in which they came
        self.first, self.last = array("q", [-1, -1]), array("q", [-1, -1])
        self.next, self.to, self.room = array("q"), array("q"), array("q")

    def node(self) -> int:
        self.first.append(-1)
        self.last.append(-1)
        return len(self.first) - 1

    def edge(self, a: int, b: int, most: int) -> int:
        for x, y, r in ((a, b, most), (b, a, 0)):
            e = len(self.to)
            if self.first[x] < 0:
                self.first[x] = e
            else:
                self.next[self.last[x]] = e
            self.last[x] = e
            self.next.append(-1)
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def fill(self) -> None:
        """Augments to a largest flow along shortest paths, level by level."""
        to, room, following = self.to, self.room, self.next
        while True:
            level = array("q", [-1]) * len(self.first)
            level[0] = 0
            todo = deque([0])
            while todo:
                x = todo.popleft()
                e = self.first[x]
                while e >= 0:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = level[x] + 1
                        todo.append(to[e])
                    e = following[e]
            if level[1] < 0:
                return
            at = self.first[:]
            path: list[int] = []
            x = 0
            while True:
                if x == 1:
                    put = min(room[e] for e in path)
                    for e in path:
                        room[e] -= put
                        room[e ^ 1] += put
                    back = next(i for i, e in enumerate(path) if not room[e])
                    x = to[path[back] ^ 1]
                    del path[back:]
                    continue
                while (e := at[x]) >= 0 and not (room[e] and level[to[e]] == level[x] + 1):
                    at[x] = following[e]
                if e >= 0:
                    path.append(e)
                    x = to[e]
                elif path:
                    x = to[path.pop() ^ 1]
                    at[x] = following[at[x]]
                else:
                    break


def flow(unique: dict, room: Mapping[tuple, int] | Iterable[tuple[tuple, int]], quota: dict) -> dict[tuple, int]:
    """Words that each source takes of each pattern, by (pattern, source): the largest flow of least cost."""
    room = dict(room)
    taken = flows(unique.items(), ((p, s, n) for (p, s), n in room.items()), quota)
    return dict(zip(room, taken))


def flows(unique: Iterable[tuple], room: Iterable[tuple], quota: dict) -> array:
    """Words that each source takes of each pattern, in the order of room: the largest flow of least cost.

    unique: (pattern, words of its distinct texts); room: (pattern, source, the most words). The first and second pass
    over a pattern's distinct texts and all further ones cost more and more a word. Costs lie on the origin's edges
    alone, so a largest flow over the cheaper edges is part of a cheapest largest flow: edges are opened in the order
    of their cost and what flows is never taken back.
    """
    net = Network()
    of_source = {s: net.node() for s in quota}
    for s, n in quota.items():
        net.edge(of_source[s], 1, n)
    of_pattern, words_ = {}, array("q")
    for p, n in unique:
        of_pattern[p] = net.node()
        words_.append(n)
    cells = array("q", [net.edge(of_pattern[p], of_source[s], n) for p, s, n in room])
    for most in (1, 1, None):
        for node, n in zip(of_pattern.values(), words_):
            net.edge(0, node, n if most else 1 << 62)
        net.fill()
    return array("q", (net.room[e ^ 1] for e in cells))


def cut(rows: DataFrame, level: Column, left: str) -> DataFrame:
    """(key, at, left): of each key the level in which the words left run out, and how many are left there."""
    sums = rows.groupBy("key", left, level.alias("at")).agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(W.partitionBy("key").orderBy("at"))
    return sums.withColumn("upto", upto).where((F.col("upto") > F.col(left)) & (F.col("upto") - F.col("size") <= F.col(left))).select("key", "at", (F.col(left) - F.col("upto") + F.col("size")).alias("left"))


def small(df: DataFrame, n: int) -> DataFrame:
    """df of n rows, broadcast if they are at most MOST."""
    return F.broadcast(df) if n <= MOST else df


def meet(rows: DataFrame, table: DataFrame, on: list[str], n: int, total: int) -> DataFrame:
    """Left join of rows, total of them, to a table of n rows that is unique by on and has n, its number of rows of that key (dropped)."""
    return rows.join(F.broadcast(table.drop("n")), on, "left") if n <= MOST else common.spread_join(rows, table, on, total)


def chosen(rows: DataFrame, quotas: DataFrame, n: int) -> DataFrame:
    """(key, edge): rows (key, u, size) with u up to edge make about the rest words of the n quotas (key, rest)."""
    some = rows.where("size > 0").join(small(quotas.where("rest > 0"), n), "key")
    first = cut(some, F.shiftright("u", 51), "rest")
    inner = some.withColumn("at", F.shiftright("u", 51)).join(small(first, n), ["key", "at"])
    second = cut(inner, F.shiftright("u", 39), "left").withColumnRenamed("left", "last")
    last = inner.withColumn("at", F.shiftright("u", 39)).join(small(second, n), ["key", "at"])
    upto = F.sum("size").over(W.partitionBy("key").orderBy("u", "id").rowsBetween(W.unboundedPreceding, 0))
    ends = last.withColumn("upto", upto).groupBy("key", "at").agg(F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("last"), F.col("u"))).alias("u"))
    edges = ends.select("key", F.coalesce("u", F.shiftleft("at", 39) - 1).alias("edge"))
    # words that run out in no level (fewer than the rest): all rows
    return quotas.where("rest > 0").join(small(edges, n), "key", "left").select("key", F.coalesce("edge", F.lit(2**63 - 1)).alias("edge"))


def mix(docs: DataFrame, id_col: str, size: Column, source: Column, same: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED, order: tuple[str, ...] | None = None) -> tuple[DataFrame, dict, dict]:
    """((id, source, size, taken), {source: size}, {source: target}) for documents of a source each.

    same: what copies in several sources have in common (a text), nothing if None; order: the columns that the seeded
    hash is of, the id if None.
    """
    spark = docs.sparkSession
    own = F.xxhash64(source.isNull(), source)  # sources and patterns by hash: they are broadcast
    both = [F.xxhash64(F.lit(i), same) if same is not None else F.lit(None).cast("long") for i in range(2)]
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(order or (id_col,))), 1)
    with common.Scratch(spark) as tables:
        sized = docs.select(F.col(id_col).alias("id"), source.alias("source"), own.alias("own"), size.alias("size"), hashed.alias("u"), *[F.when(same.isNotNull() if same is not None else F.lit(False), c).alias(f"t{i}") for i, c in enumerate(both)])
        sized = tables.write(sized, "sized")
        found = sized.groupBy("source", "own").agg(F.sum("size").alias("size")).collect()
        sizes = {r["source"]: r["size"] for r in found}
        target = targets(list(sizes.items()), share * sum(sizes.values()), weights)
        quota = {s: round(t) for s, t in target.items()}
        owns = sorted(((r["own"], r["source"]) for r in found), key=lambda x: x[0])
        total = sized.count()
        # the sources of each text; those of one source need no lookup
        texts = sized.where("t0 is not null").groupBy("t0", "t1").agg(F.array_sort(F.collect_set("own")).alias("sources"), F.max("size").alias("size"), F.count("*").alias("n"))
        texts = tables.write(texts.select("t0", "t1", F.when(F.size("sources") > 1, F.xxhash64("sources")).otherwise(F.col("sources")[0]).alias("pattern"), (F.size("sources") > 1).alias("several"), "size", "n"), "texts")
        shared = texts.where("several").select("t0", "t1", "pattern", "n")
        rows = common.spread_join(sized, shared, ["t0", "t1"], total).withColumn("pattern", F.coalesce("pattern", "own"))
        rows = tables.write(rows.select("id", "source", "own", "size", "u", "pattern"), "rows")
        cells = rows.groupBy("pattern", "own").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("pattern", "own").toArrow()
        alone = sized.where("t0 is null").groupBy(F.col("own").alias("pattern")).agg(F.sum("size").alias("size"))
        held = texts.groupBy("pattern").agg(F.sum("size").alias("size")).unionAll(alone).groupBy("pattern").agg(F.sum("size").alias("size"))
        unique = held.orderBy("pattern").toArrow()  # no more than cells
        p, o, z, many = (cells[c].to_numpy() for c in ("pattern", "own", "size", "n"))
        amount = np.array(flows(zip(unique["pattern"].to_numpy().tolist(), unique["size"].to_numpy().tolist()), zip(p.tolist(), o.tolist(), (PASSES * z).tolist()), {own: quota[s] for own, s in owns}), dtype=np.int64)
        with_words = z > 0
        p, o, z, many, amount = (x[with_words] for x in (p, o, z, many, amount))
        n = len(p)
        plan = spark.createDataFrame(pa.table({"pattern": p, "own": o, "passes": amount // z, "rest": amount % z, "n": many}), "pattern long, own long, passes long, rest long, n long").withColumn("key", F.xxhash64("own", "pattern"))
        some = meet(rows, plan, ["pattern", "own"], n, total)
        edges = chosen(some.where("rest > 0").select("key", "id", "u", "size"), plan.select("key", "rest"), n)
        some = some.join(small(edges, n), "key", "left").withColumn("passes", F.coalesce(F.col("passes") + F.when(F.col("u") <= F.col("edge"), 1).otherwise(0), F.lit(0)))
        some = some.select("id", "source", "own", "size", "passes", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "u"), 1).alias("u"))
        some = tables.write(some, "first")
        # what rounding to rows left of each source's quota
        taken = some.groupBy("source", "own").agg(F.sum(F.col("size") * F.col("passes")).alias("taken"), F.count("*").alias("n")).collect()
        gaps = [(r["own"], abs(quota[r["source"]] - r["taken"]), 1 if quota[r["source"]] > r["taken"] else -1, r["n"]) for r in taken]
        gaps = spark.createDataFrame(gaps, "key long, rest long, sign int, n long")
        open_ = meet(some.withColumnRenamed("own", "key"), gaps, ["key"], len(taken), total).where((F.col("sign") > 0) & (F.col("passes") < PASSES) | (F.col("sign") < 0) & (F.col("passes") > 0))
        edges = chosen(open_.select("key", "id", "u", "size"), gaps.select("key", "rest"), len(taken))
        ends = gaps.join(small(edges, len(taken)), "key").select(F.col("key").alias("own"), "sign", "edge", "n")
        moved = F.col("passes") + F.when(F.col("u") <= F.col("edge"), F.col("sign")).otherwise(0)
        out = meet(some, ends, ["own"], len(taken), total).select("id", "source", "size", (F.col("size") * F.greatest(F.lit(0), F.least(F.lit(PASSES), moved))).cast("long").alias("taken"))
        tables.keep("first")
        # the small tables that the result still reads
        tables.keep("rows")
    return out.withColumnRenamed("id", id_col), sizes, target


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out, sizes, target = mix(docs, "doc_id", words(F.col("text")), F.col("source"), same=F.col("text"))
    known = spark.createDataFrame([(s, sizes[s], target[s]) for s in sizes], "source string, source_size long, target double")
    known = small(known.withColumnRenamed("source", "own"), len(sizes))
    return out.join(known, out.source.eqNullSafe(known.own)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_mix": op5_mix}
