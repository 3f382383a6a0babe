"""Near-duplicate documents: fast similarity sketches, banding and exact verification.

Texts become sets of five-word shingles. Equal sets form a class, whose smallest id stands for it; only these go on.
Their sketches (see shingles.sketches) are cut into bands; classes that agree in a band share a bucket. Whole sets
decide what links, in two steps, so that a group of near copies never turns into all its pairs (different documents that
merely share a long passage still meet in blocks, see 2: their number counts squared there):

1. Every member of a bucket is compared with the bucket's smallest one. What links is one group (components), however
   many members it has.
2. A bucket whose other members are still of more than one group is open. In open buckets, the outsiders, those not in
   the bucket's largest group, are compared with all its members. Open buckets that overlap are handled together
   (families); outsiders and members are dealt to blocks, and every two blocks meet in one task, which returns a
   spanning forest of the links it confirms, not the links.

Both give the components of all links between members of a bucket, since members of one group need no comparison. A
link at the threshold is missed only if its sketches agree in no band: (1 - s^rows)^bands, 4e-5 at s = 0.85 (32 bands
of 8), 3e-6 at s = 0.8 (42 of 6) and less above; the rows of a band follow from the threshold (see band_rows).

Defined results: A-Z become lower case, words are runs of other characters than white space; a text of fewer than
five words is one shingle, one without words (or null) none, and links with nothing; rows without an id come back with
a null component, kept false, and link nothing; repeated rows link with one another; rows that share an id count as
one document, which links with whatever one of its texts links with; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graphs
from .shingles import COORDINATES, bands, shingle_sets, sketches

#: The most that a link at the threshold may escape all bands.
MISS = 5e-5
#: A block holds about so many members, and texts of about so many bytes.
BLOCK_ROWS, BLOCK_BYTES = 256, 8 << 20


def band_rows(percent: int) -> int:
    """The most rows a band can have so that a link at the threshold is missed with at most MISS."""
    return max([r for r in range(1, 33) if (1 - (percent / 100) ** r) ** (COORDINATES // r) <= MISS], default=1)


def features(docs: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(id, n_shingles, n_bytes, d1, d2, keys): the set's size and digest, and its band keys."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        flat, starts = shingle_sets(texts)
        n = np.diff(starts)
        total = np.concatenate([[np.uint64(0)], np.cumsum(flat)])
        squares = np.concatenate([[np.uint64(0)], np.cumsum((flat ^ (flat >> np.uint64(29))) * (flat | np.uint64(1)))])
        keys = bands(sketches(flat, starts), rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel().view(np.int64)))
        digest = [pa.array((x[starts[1:]] - x[starts[:-1]]).view(np.int64)) for x in (total, squares)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array([len(t or b"") for t in texts], pa.int64()), *digest, lists], names=["id", "n_shingles", "n_bytes", "d1", "d2", "keys"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return common.map_arrow(own, one, "id long, n_shingles long, n_bytes long, d1 long, d2 long, keys array<long>", text=1)


def forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those links that join what earlier ones have not joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            out.append((a, b))
    return out


def linked(texts: list[bytes], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts, one of side 0 and one of side 1, whose sets link, by exact intersection sizes."""
    flat, starts = shingle_sets(texts)
    n, size = len(texts), np.diff(starts)
    owner = np.repeat(np.arange(n), size)
    values, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count > 1)
    column = np.full(len(values), -1)
    column[often] = np.arange(len(often))
    place = column[place]
    owner, place = owner[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    both = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    for a in range(0, len(often), step):
        i, j = np.searchsorted(place, [a, a + step])
        grid = np.zeros((n, step), np.float32)
        grid[owner[i:j], place[i:j] - a] = 1
        both += grid[left] @ grid[right].T
    both = np.rint(both).astype(np.int64)
    hit = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
    hit &= (size[left] > 0)[:, None]
    a, b = np.nonzero(hit)
    return left[a], right[b]


def confirm(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) between sides 0 and 1 of members (keys, side, id, text): a spanning forest for each group of keys."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def one(part: pa.Table) -> pa.Table:
        ids = part["id"].to_pylist()
        a, b = linked(part["text"].cast(pa.binary()).to_pylist(), part["side"].to_numpy(), percent)
        rows = forest([(ids[i], ids[j]) for i, j in zip(a.tolist(), b.tolist()) if ids[i] != ids[j]])
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], schema=schema)

    return members.groupBy(*keys).applyInArrow(one, "a long, b long")


def blocks(key: str) -> Column:
    """How many blocks the rows (n_bytes) of a key make."""
    return F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int").alias(key)


def dealt(blocks: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")


def star_links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (a, b, n_bytes of a): the members a of each b meet it in blocks, each with its own copy of b."""
    some = pairs.groupBy("b").agg(blocks("parts"), F.count("*").alias("n"))
    members = common.spread_join(pairs.withColumnRenamed("a", "id"), some, ["b"], pairs.count()).select("b", dealt("parts").alias("part"), "id", F.lit(1).alias("side"))
    heads = members.select("b", "part").distinct().select("b", "part", F.col("b").alias("id"), F.lit(0).alias("side"))
    return confirm(members.unionByName(heads).join(texts.hint("merge"), "id"), ["b", "part"], percent)


def open_links(keys: DataFrame, labels: DataFrame, texts: DataFrame, sizes: DataFrame, tables: common.Scratch, percent: int) -> DataFrame:
    """Links between members (key, id) of a bucket that are of different groups by labels (id, label)."""
    own = tables.write(keys.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")), "labelled")
    total = own.count()
    groups = own.groupBy("key", "label").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    state = groups.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("groups"), F.min("first").alias("head"), F.sum("n").alias("n"))
    state = tables.write(state.where("groups > 1").select("key", F.col("most.label").alias("main"), "head", "n"), "open")
    inside = common.spread_join(own, state, ["key"], total).where("main is not null").select("id", (F.col("label") != F.col("main")).alias("outside"), "head")
    inside = tables.write(inside.groupBy("id", "head").agg(F.max("outside").alias("outside")), "inside")
    families = graphs.components(inside.select(F.col("id").alias("a"), F.col("head").alias("b")), tables, "families")
    members = inside.groupBy("id").agg(F.max("outside").alias("outside")).join(families, inside.id == families.node).join(sizes, "id")
    members = tables.write(members.select("id", F.col("component").alias("family"), "outside", "n_bytes"), "members")
    of_all = members.groupBy("family").agg(blocks("ys"), F.count("*").alias("n"))
    of_out = members.where("outside").groupBy("family").agg(blocks("xs"))
    placed = common.spread_join(members, of_all.join(of_out, "family"), ["family"], total)
    right = placed.select("family", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), dealt("ys").alias("y"), "id", F.lit(1).alias("side"))
    left = placed.where("outside").select("family", dealt("xs").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"), "id", F.lit(0).alias("side"))
    return confirm(left.unionByName(right).join(texts.hint("merge"), "id"), ["family", "x", "y"], percent)


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: its group of near copies, and whether it is the group's smallest id."""
    with common.Scratch(docs.sparkSession) as tables:
        feats = tables.write(features(docs, id_col, text_col, band_rows(percent)), "features")
        digest = ["n_shingles", "d1", "d2"]
        full = feats.where("id is not null and n_shingles > 0")
        classes = tables.write(full.groupBy(*digest).agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
        # band keys of the representatives, in buckets of more than one
        reps = full.join(classes.select(F.col("rep").alias("id"), *digest), ["id", *digest]).dropDuplicates(["id", *digest])
        reps = tables.write(reps.select("id", "n_bytes", "keys"), "reps")
        keys = reps.select("id", F.explode("keys").alias("key"))
        heads = keys.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.count("*").alias("n")).where("head < last")
        heads = tables.write(heads.select("key", "head", "n"), "heads")
        shared = tables.write(common.spread_join(keys, heads, ["key"], reps.count() * (COORDINATES // band_rows(percent))).where("id <> head"), "shared")
        sizes = reps.groupBy("id").agg(F.sum("n_bytes").alias("n_bytes"))
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
        pairs = shared.select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
        pairs = tables.write(pairs.join(sizes, pairs.a == sizes.id).select("a", "b", "n_bytes"), "pairs")
        # the texts of all candidates, gathered once
        ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
        texts = tables.write(texts.join(ids.hint("merge"), "id", "left_semi"), "texts")
        # rows that share an id are one document, whatever their texts
        several = full.groupBy("id").agg(F.min(F.struct(*digest)).alias("x"), F.max(F.struct(*digest)).alias("y")).where("x <> y").select("id")
        several = full.join(several, "id", "left_semi").join(classes, digest).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
        links = tables.write(star_links(pairs, texts, percent).unionAll(several), "star")
        groups = graphs.components(links, tables, "star-groups")
        more = open_links(shared.select("key", "id"), groups.select(F.col("node").alias("id"), F.col("component").alias("label")), texts, sizes, tables, percent)
        more = tables.write(more, "more")
        if not more.isEmpty():  # groups that they join
            joined = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)
            groups = graphs.components(joined, tables, "groups")
        labels = classes.join(groups, classes.rep == groups.node, "left").select(*digest, F.coalesce("component", "rep").alias("component_id"), "n")
        labels = tables.write(labels, "labels")
        out = feats.select("id", "n_shingles", *[F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col(c)).alias(c) for c in digest[1:]])
        out = common.spread_join(out, labels, digest, feats.count())
        tables.keep("features", "labels")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_minhash_dedup": op4_minhash_dedup}
