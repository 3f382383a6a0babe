"""Exact top-k search by inner product over KD-trees, one tree for each shard of the vectors.

Components become integers, floor(scale * x). Vectors are dealt to shards by a hash of their id; each shard's tree
splits at the median of its widest dimension, down to leaves that one matrix product scores, and keeps the tight
bounding box of every node. For a query, the score of any vector in a box is at most sum(max(q * low, q * high)). A
query first searches one shard, then WIDEN times as many in each round; the kth best score so far goes with it, so
boxes below it are cut at once, and the remaining leaves are visited in order of falling bound until the bound is below
the kth best score. Queries meet shards in blocks: one task holds one tree and at most some thousand queries.

Defined results: vectors that are null, or hold null or non-finite components, and rows without an id take no part;
vectors of different lengths never meet; rows with the query's id are no candidates for it; repeated candidate rows
count as often as they occur, identical repeated query rows are answered once; ties go to the smaller id; fewer than
k candidates give fewer rows; an empty table gives none. Other columns are ignored. Components or scores
beyond 64 bits raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS, WIDEN = 16_384, 4096, 1024, 8


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * component) as long; null where the vector takes no part."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fit, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def grow(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, ...]:
    """A KD-tree: order of the rows, and for each node its box, its rows and its children (-1: a leaf)."""
    order = np.arange(len(vectors))
    low, high, first, last, left, right = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        own = vectors[order[a:b]]
        low.append(own.min(0))
        high.append(own.max(0))
        first.append(a)
        last.append(b)
        left.append(-1)
        right.append(-1)
        return len(first) - 1

    todo = [node(0, len(vectors))]
    while todo:
        k = todo.pop()
        a, b = first[k], last[k]
        extent = high[k] - low[k]
        if b - a <= leaf_rows or not extent.size or not extent.any():
            continue  # small, or copies of one vector
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(vectors[order[a:b], int(extent.argmax())], half)]
        left[k], right[k] = node(a, a + half), node(a + half, b)
        todo += [left[k], right[k]]
    return order, np.array(low), np.array(high), np.array(first), np.array(last), np.array(left), np.array(right)


def search(tree: dict, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of at most k best vectors for each query; none below its floor.

    The frontier of a query starts at the root; nodes whose bound is below the kth score known so far go, the others
    give way to their children. Leaves are then visited in order of falling bound, each raising the kth score.
    """
    n, big = len(ids), np.int64(-(2**63 - 1))
    largest = int(np.abs(vectors).max(initial=0)) * max(1, int(np.abs(tree["vectors"]).max(initial=0))) * max(1, vectors.shape[1])
    if largest >= 2**63:
        raise OverflowError("a score may not fit 64 bits")
    kind = np.float64 if largest < 2**52 else object  # products within 2**52 are exact in BLAS
    q, v = vectors.astype(kind), tree["vectors"].astype(kind)
    bound = np.maximum(q, 0) @ tree["high"].astype(kind).T + np.minimum(q, 0) @ tree["low"].astype(kind).T
    kth = floor.copy()
    best_score = np.full((n, k), big)
    best_id = np.full((n, k), np.int64(2**63 - 1))
    # down from the root: which leaves remain for which query
    alive = np.zeros(bound.shape, bool)
    alive[:, 0] = True
    for node in range(len(tree["first"])):
        rows = alive[:, node] & (bound[:, node] >= kth)
        alive[:, node] = rows
        if tree["left"][node] >= 0:
            alive[:, tree["left"][node]] = alive[:, tree["right"][node]] = rows
    leaves = np.flatnonzero(tree["left"] < 0)
    own = np.where(alive[:, leaves], bound[:, leaves], -np.inf)
    rank = np.argsort(-own, axis=1, kind="stable")
    active = np.arange(n)
    for step in range(len(leaves)):
        leaf = rank[active, step]
        go = own[active, leaf] >= kth[active]
        go &= own[active, leaf] > -np.inf
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        by = np.argsort(leaf, kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            node = leaves[leaf[rows[0]]]
            a, b = tree["first"][node], tree["last"][node]
            who = active[rows]
            score = (q[who] @ v[a:b].T).astype(np.int64)
            cand = tree["ids"][a:b]
            # own rows are few: those queries whose id is in the leaf
            order = np.argsort(cand, kind="stable")
            low, high = np.searchsorted(cand[order], ids[who]), np.searchsorted(cand[order], ids[who], side="right")
            for i in np.flatnonzero(high > low).tolist():
                score[i, order[low[i] : high[i]]] = big
            least = kth[who]
            if b - a > k:
                least = np.maximum(least, np.partition(score, b - a - k, axis=1)[:, b - a - k])
            i, j = np.nonzero((score >= least[:, None]) & (score > big))
            # the survivors with what each query had, best first
            i = np.concatenate([i, np.repeat(np.arange(len(who)), k)])
            found = np.concatenate([score[i[: len(j)], j], best_score[who].ravel()])
            named = np.concatenate([cand[j], best_id[who].ravel()])
            order = np.lexsort((named, -found, i))
            place = np.arange(len(order)) - np.searchsorted(i[order], i[order])
            order = order[place < k]
            best_score[who] = found[order].reshape(-1, k)
            best_id[who] = named[order].reshape(-1, k)
            kth[who] = np.maximum(kth[who], best_score[who, k - 1])
    found = (best_score > big) & (best_score >= floor[:, None])
    row = np.broadcast_to(np.arange(n)[:, None], found.shape)[found]
    return row, best_id[found], best_score[found]


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def build_trees(vectors: DataFrame) -> DataFrame:
    """One row for each (dim, shard) of (dim, shard, id, v): the tree as packed arrays."""
    names = ("low", "high", "first", "last", "left", "right")

    def one(key: tuple, part: pa.Table) -> pa.Table:
        v = matrix(part["v"], part.num_rows)
        order, *nodes = grow(v)
        ids = part["id"].to_numpy()[order]
        packed = {"ids": ids, "vectors": v[order], **dict(zip(names, nodes))}
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), **{c: pa.array([x.astype(np.int64).tobytes()], pa.binary()) for c, x in packed.items()}})

    schema = "dim int, shard int, ids binary, vectors binary, " + ", ".join(f"{c} binary" for c in names)
    return vectors.groupBy("dim", "shard").applyInArrow(one, schema)


def visit(trees: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, q, vec_id, score) for queries (dim, shard, block, id, v, floor) and trees (dim, shard, block, ...)."""

    def one(tree_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not tree_rows.num_rows or not query_rows.num_rows:
            return schema.empty_table()
        dim = query_rows["dim"][0].as_py()
        raw = {c: np.frombuffer(tree_rows[c][0].as_py(), np.int64) for c in ("ids", "vectors", "low", "high", "first", "last", "left", "right")}
        for c in ("vectors", "low", "high"):
            raw[c] = raw[c].reshape(len(raw["ids"]) if c == "vectors" else len(raw["first"]), dim)
        ids = query_rows["id"].to_numpy()
        row, vec, score = search(raw, ids, matrix(query_rows["v"], len(ids)), query_rows["floor"].to_numpy(), k)
        return pa.table([pa.array(ids[row]), pa.array(query_rows["q"].to_numpy()[row]), pa.array(vec), pa.array(score)], schema=schema)

    keys = ["dim", "shard", "block"]
    return trees.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(one, "query_id long, q long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products for the rows that is_query marks."""
    spark = vectors.sparkSession
    fit = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"), is_query.alias("asks")).where("id is not null and v is not null")
    fit = fit.withColumn("dim", F.size("v"))
    n, asked = fit.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // BLOCK_QUERIES))
    dealt = fit.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    trees = common.materialize(build_trees(dealt.select("dim", "shard", "id", "v")), "trees")
    trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = fit.where("asks").withColumn("q", F.xxhash64("id", "v")).dropDuplicates(["id", "q"]).withColumn("block", F.pmod(F.col("q"), F.lit(blocks)).cast("int"))
    queries = common.materialize(queries, "queries")
    least = F.lit(-(2**63)).cast("long")
    home = F.pmod(F.xxhash64("q"), F.lit(shards)).cast("int")
    shape = ["dim", "shard", "block", "id", "q", "v", "floor"]
    order = W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    found, done, size = None, 0, 1
    while done < shards:
        # the next shards after home, one in the first round, then more and more
        asks = queries.withColumn("shard", F.explode(F.transform(F.sequence(F.lit(done), F.lit(min(done + size, shards) - 1)), lambda i: F.pmod(home + i, F.lit(shards)))))
        if found is None:
            asks = asks.withColumn("floor", least)
        else:
            known = found.groupBy("query_id", "q").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
            asks = asks.join(known.select(F.col("query_id").alias("id"), "q", "kth"), ["id", "q"], "left").withColumn("floor", F.coalesce("kth", least))
        more = visit(trees, asks.select(shape), k)
        every = more if found is None else found.drop("rank").unionByName(more)
        found = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        done, size = done + size, size * WIDEN
        if done < shards:
            found = common.materialize(found, "found")
    return found.select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH e AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""

QUERIES = {"op2_topk": op2_topk}
ORACLE_SQL = {"op2_topk": SQL}
