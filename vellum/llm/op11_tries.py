"""Prefix tries of conversations: adaptive radix trees over fixed-width turn ids, one for each range of keys.

A turn's id is the first WIDTH bytes of a SHA-256 digest of its role and text, a big-endian number; a conversation's key is
the ids of its turns, so keys that share d turns share WIDTH * d bytes. Keys are range-sorted with their conversation
ids, so even a third of all rows with one key spreads over tasks, and each stretch of about SHARD key bytes becomes one
adaptive radix tree: nodes of 4, 16, 48 and 256 children that grow as they fill, with compressed paths. Only byte depths
at a turn's end are nodes of the trie; a compressed path holds one for each turn on it.

A tree knows the last key before its range and the first one after. A node of the trie is shared with a neighbour only if
it lies on such a common prefix; of those, at most two paths a tree, each tree gives its share (members, first members of
children, leaves that end there, savings), and the shares simply add up. All other nodes are final where they are made.

Defined results: rows without a conversation id take no part; null turns come first, equal ones in the order of their
ids; a null role or text is empty; repeated rows are turns of their own; an empty table gives no rows; other columns are
ignored. A conversation is one record: its key and ids take about 100 bytes a turn in one task.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Bytes of a turn's id; key bytes (and 16 a key) of a tree; characters in a piece of a list of ids.
WIDTH, SHARD, PIECE = 16, 2 << 20, 1 << 16


class Node:
    """A node of a radix tree: a compressed path, then children by their next byte in one of four layouts.

    Up to 4 and up to 16 children: bytes in order beside their nodes. Up to 48: an index of 256 places into the nodes.
    Up to 256: one place for each byte. The layout follows from the number of children and is replaced as it grows.
    """

    __slots__ = ("path", "ends", "kind", "bytes", "nodes")

    def __init__(self, path: bytes):
        self.path, self.ends = path, None
        self.kind, self.bytes, self.nodes = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.kind <= 16:
            at = self.bytes.find(byte)
            return self.nodes[at] if at >= 0 else None
        if self.kind == 48:
            at = self.bytes[byte]
            return self.nodes[at - 1] if at else None
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> None:
        """Adds a child, or replaces the one of that byte."""
        if self.kind <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.nodes[at] = node
                return
            if len(self.bytes) == self.kind:
                self._grow()
                return self.put(byte, node)
            at = next((i for i, b in enumerate(self.bytes) if b > byte), len(self.bytes))
            self.bytes.insert(at, byte)
            self.nodes.insert(at, node)
        elif self.kind == 48:
            if self.bytes[byte]:
                self.nodes[self.bytes[byte] - 1] = node
                return
            if len(self.nodes) == 48:
                self._grow()
                return self.put(byte, node)
            self.nodes.append(node)
            self.bytes[byte] = len(self.nodes)
        else:
            self.nodes[byte] = node

    def _grow(self) -> None:
        if self.kind == 4:
            self.kind = 16
        elif self.kind == 16:
            index = bytearray(256)
            for i, b in enumerate(self.bytes):
                index[b] = i + 1
            self.kind, self.bytes = 48, index
        else:
            whole: list = [None] * 256
            for b, at in enumerate(self.bytes):
                if at:
                    whole[b] = self.nodes[at - 1]
            self.kind, self.bytes, self.nodes = 256, bytearray(), whole

    def children(self) -> list[Node]:
        """In the order of their bytes."""
        if self.kind <= 16:
            return self.nodes
        if self.kind == 48:
            return [self.nodes[at - 1] for at in self.bytes if at]
        return [n for n in self.nodes if n is not None]


class RadixTree:
    """Byte strings, each with the numbers added for it; a string may be a prefix of others."""

    def __init__(self):
        self.root = Node(b"")

    def add(self, key: bytes, number: int) -> None:
        parent, byte, node, at = None, 0, self.root, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                same = len(os.path.commonprefix([path, key[at : at + len(path)]]))
                upper = Node(path[:same])
                node.path = path[same:]
                upper.put(path[same], node)
                parent.put(byte, upper)
                node, path = upper, upper.path
            at += len(path)
            if at == len(key):
                if node.ends is None:
                    node.ends = []
                node.ends.append(number)
                return
            below = node.child(key[at])
            if below is None:
                leaf = Node(key[at:])
                leaf.ends = [number]
                node.put(key[at], leaf)
                return
            parent, byte, node = node, key[at], below

    def get(self, key: bytes) -> list[int]:
        """The numbers added for a key."""
        node, at = self.root, 0
        while True:
            if not key.startswith(node.path, at):
                return []
            at += len(node.path)
            if at == len(key):
                return node.ends or []
            node = node.child(key[at])
            if node is None:
                return []


def common_turns(a: bytes | None, b: bytes | None) -> int:
    """Whole turns that two keys begin with alike; -1 if there is no such key."""
    if a is None or b is None:
        return -1
    return len(os.path.commonprefix([a, b])) // WIDTH


class Walk:
    """The trie nodes of one tree, children before parents.

    first and last are the tree's outer keys, before and after the turns they share with the neighbours' (-1: none).
    """

    def __init__(self, tree: RadixTree, sizes: dict[bytes, int], first: bytes, last: bytes, before: int, after: int):
        self.tree, self.sizes, self.first, self.last, self.before, self.after = tree, sizes, first, last, before, after
        self.rows: list[tuple] = []
        self.pieces: list[tuple[bytes, int, str]] = []

    def name(self, key: bytes) -> bytes:
        return hashlib.sha256(key).digest()[:WIDTH]

    def run(self) -> None:
        """Fills rows (path, parent_path, parent_conv_id, conv_id, depth, n_convs, n_children, n_leaves, saved, sha).

        path and parent_path are set for nodes that neighbours share. Each frame of the stack is a tree node with the key
        down to its end; what a trie node needs from below is summed in sums, one list for each open tree node.
        """
        stack: list[tuple[Node, bytes, bool]] = [(self.tree.root, b"", False)]
        sums: list[list] = [[0, None, 0, 0, 0, []]]  # members, smallest, children that begin here, leaves, saved, rows waiting for their parent
        while stack:
            node, above, done = stack.pop()
            key = above + node.path
            if not done:
                stack.append((node, above, True))
                sums.append([0, None, 0, 0, 0, []])
                stack.extend((child, key, False) for child in node.children())
                continue
            own = sums.pop()
            if node.ends:
                own[0] += len(node.ends)
                low = min(node.ends)
                own[1] = low if own[1] is None else min(own[1], low)
            # trie nodes on this path, the deepest first: depths whose end lies after above, and at most at key's end
            for depth in range(len(key) // WIDTH, len(above) // WIDTH if above or node is not self.tree.root else -1, -1):
                own = self.emit(key[: depth * WIDTH], depth, node.ends if depth * WIDTH == len(key) else None, own)
            up = sums[-1]
            up[0] += own[0]
            up[1] = own[1] if up[1] is None else min(up[1], own[1]) if own[1] is not None else up[1]
            for i in (2, 3, 4):
                up[i] += own[i]
            up[5] += own[5]

    def emit(self, key: bytes, depth: int, ends: list[int] | None, own: list) -> list:
        """The row of a trie node; returns what it adds to the node above."""
        members, low, children, leaves, saved, waiting = own
        starts_before = depth <= self.before and self.first.startswith(key)
        goes_on = depth <= self.after and self.last.startswith(key)
        size = self.sizes[key[-WIDTH:]] if depth else 0
        saved += members * size - (0 if starts_before else size)
        # a node's own members sort before longer ones, so only its last tree can tell that it has no children
        leaves += 0 if waiting or goes_on else 1
        path = self.name(key) if starts_before or goes_on else None
        for row in waiting:  # the children, whose parent is now known
            self.rows.append((row[0], path, None if path else low, *row[1:]))
        sha = None
        if path is None:
            sha = hashlib.sha256(",".join(map(str, ends or [])).encode()).hexdigest()
        elif ends:
            text = ",".join(map(str, ends))
            self.pieces += [(path, i, text[a : a + PIECE]) for i, a in enumerate(range(0, len(text), PIECE))]
        row = (path, low, depth, members, children, leaves, saved, sha)
        if depth == 0:
            self.rows.append((row[0], None, None, *row[1:]))
        return [members, low, 0 if starts_before else 1, leaves, saved, [row]]


def turns(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of id (hexadecimal) and size in UTF-8 bytes."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what), 256), 1, 2 * WIDTH)
    own = table.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).cast("long").alias("turn"), digest.alias("id"), F.octet_length(what).alias("size")).alias("t"))
    listed = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))  # nulls first
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def shared_starts(own: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c begins with the first h = crc32(c) % most turns of c - c % every, then goes on after its own first h."""
    base = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    met = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(base, "base", "left")
    none = F.expr("cast(array() as array<struct<id:string,size:int>>)")
    begin = F.when(F.col("h") > 0, F.slice(F.coalesce("first", none), 1, F.greatest("h", F.lit(1)))).otherwise(none)
    return met.select("conv_id", F.concat(begin, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def write_trees(convs: DataFrame) -> DataFrame:
    """The written table (pid, seq, first, last, keys, ids, turns, sizes): sorted ranges of keys, about SHARD bytes each."""
    keyed = convs.select(F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), "conv_id", F.transform("turns", lambda t: t["size"]).alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, held = TaskContext.get().partitionId(), 0, 0
        keys: list[bytes] = []
        ids: list[int] = []
        sizes: dict[bytes, int] = {}

        def shard() -> pa.RecordBatch:
            row = {"pid": pid, "seq": seq, "first": keys[0], "last": keys[-1], "keys": keys, "ids": ids, "turns": list(sizes), "sizes": list(sizes.values())}
            return pa.RecordBatch.from_pylist([row], schema=SHARDS)

        for batch in batches:
            for key, number, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys.append(key)
                ids.append(number)
                sizes.update((key[WIDTH * i : WIDTH * (i + 1)], n) for i, n in enumerate(own))
                held += len(key) + 16
                if held >= SHARD:
                    yield shard()
                    keys, ids, sizes, held, seq = [], [], {}, 0, seq + 1
        if keys:
            yield shard()

    ordered = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return common.materialize(ordered.mapInArrow(run, "pid int, seq int, first binary, last binary, keys array<binary>, ids array<long>, turns array<binary>, sizes array<int>"), "trees")


SHARDS = pa.schema([("pid", pa.int32()), ("seq", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("keys", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64())), ("turns", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32()))])
ROWS = "path binary, parent_path binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, pid int, seq int, k int, piece string"
NODE = [("path", pa.binary()), ("parent_path", pa.binary()), *((n, pa.int64()) for n in ("parent_conv_id", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())]
TAIL = [("pid", pa.int32()), ("seq", pa.int32()), ("k", pa.int32()), ("piece", pa.string())]


def neighbours(shards: DataFrame) -> DataFrame:
    """(pid, seq, before, after): the key before each range and the one after; one row a partition is in one window."""
    outer = shards.groupBy("pid").agg(F.min_by("first", "seq").alias("first"), F.max_by("last", "seq").alias("last"))
    order = W.orderBy("pid")  # as many rows as partitions
    outer = outer.select("pid", F.lag("last").over(order).alias("left"), F.lead("first").over(order).alias("right"))
    own = W.partitionBy("pid").orderBy("seq")
    near = shards.select("pid", "seq", F.lag("last").over(own).alias("before"), F.lead("first").over(own).alias("after"))
    return near.join(outer, "pid").select("pid", "seq", F.coalesce("before", "left").alias("before"), F.coalesce("after", "right").alias("after"))


def tree_nodes(shards: DataFrame) -> DataFrame:
    """Final nodes, shares of nodes (path is set) and pieces of the lists of their ends (piece is set) of every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                tree, sizes = RadixTree(), dict(zip(row["turns"], row["sizes"]))
                for key, number in zip(row["keys"], row["ids"]):
                    tree.add(key, number)
                walk = Walk(tree, sizes, row["first"], row["last"], common_turns(row["before"], row["first"]), common_turns(row["last"], row["after"]))
                walk.run()
                n, m = len(walk.rows), len(walk.pieces)
                for a in range(0, n, 20_000):
                    part = list(zip(*walk.rows[a : a + 20_000]))
                    k = len(part[0])
                    arrays = [pa.array(c, t) for c, (_, t) in zip(part, NODE)] + [pa.nulls(k, t) for _, t in TAIL]
                    yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(NODE + TAIL))
                for a in range(0, m, 100):
                    paths, ks, pieces = zip(*walk.pieces[a : a + 100])
                    k = len(paths)
                    tail = [pa.array(np.full(k, row["pid"], np.int32)), pa.array(np.full(k, row["seq"], np.int32)), pa.array(ks, pa.int32()), pa.array(pieces, pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), *(pa.nulls(k, t) for _, t in NODE[1:]), *tail], schema=pa.schema(NODE + TAIL))

    near = shards.join(neighbours(shards), ["pid", "seq"])
    return near.mapInArrow(run, ROWS)


def chained_hashes(pieces: DataFrame) -> DataFrame:
    """(path, ends_sha256): the hash of each path's pieces, comma-joined over trees, read in order and never gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state, done = None, None, []
        for batch in batches:
            for name, k, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if name != path:
                    if path is not None:
                        done.append((path, state.hexdigest()))
                    path, state = name, hashlib.sha256()
                elif k == 0:
                    state.update(b",")
                state.update(piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["path", "ends_sha256"])
                done = []
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([state.hexdigest()])], names=["path", "ends_sha256"])

    ordered = pieces.repartition("path").sortWithinPartitions("path", "pid", "seq", "k").select("path", "k", "piece")
    return ordered.mapInArrow(run, "path binary, ends_sha256 string")


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns): COLUMNS. The result reads the table of nodes, which stays."""
    nodes = common.materialize(tree_nodes(write_trees(convs)), "nodes")
    rows = nodes.where("piece is null")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = rows.where("path is not null").groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_path").alias("parent_path"), *sums)
    shared = shared.join(chained_hashes(nodes.where("piece is not null").select("path", "pid", "seq", "k", "piece")), "path", "left")
    shared = shared.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    shared = common.materialize(shared, "shared")
    single = rows.where("path is null")
    known = single.where("parent_path is null").select(*COLUMNS)
    child = single.where("parent_path is not null").drop("path", "parent_conv_id").unionByName(shared.drop("path"), allowMissingColumns=True)
    parents = shared.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    found = common.spread_join(child.select("parent_path", *(c for c in COLUMNS if c != "parent_conv_id")), parents, ["parent_path"], nodes.count())
    return known.unionByName(found.select(*COLUMNS))


def op11_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(shared_starts(turns(common.table(spark, sf_dir, "conversations"))))


QUERIES = {"op11_tries": op11_tries}

ORACLE_SQL = {
    "op11_tries": r"""
    WITH crc_table AS (
      SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], list_transform(range(8), lambda i: 0::BIGINT)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    own AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
             sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id
      FROM conversations WHERE conv_id IS NOT NULL),
    placed AS (SELECT conv_id, id, strlen(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS i FROM own),
    hashed AS (
      SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM own), crc_table),
    rebuilt AS (
      SELECT a.conv_id, id, size, i FROM hashed a JOIN placed p ON p.conv_id = a.conv_id - a.conv_id % 5 AND i <= h
      UNION ALL SELECT a.conv_id, id, size, i FROM hashed a JOIN placed p ON p.conv_id = a.conv_id AND i > h),
    ordered AS (SELECT conv_id, id, size, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d FROM rebuilt),
    paths AS (
      SELECT conv_id, d AS depth, size, sha256(string_agg(id, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS path FROM ordered
      UNION ALL SELECT conv_id, 0, 0, 'root' FROM hashed),
    lengths AS (SELECT conv_id, max(depth) AS turns FROM paths GROUP BY 1),
    nodes AS (
      SELECT path, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
             sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (turns = depth), '')) AS ends_sha256
      FROM paths p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY 1, 2),
    above AS (SELECT DISTINCT c.path, p.path AS parent FROM paths c JOIN paths p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1),
    under AS (SELECT DISTINCT p.path, c.path AS below FROM paths c JOIN paths p ON p.conv_id = c.conv_id AND p.depth <= c.depth),
    children AS (SELECT parent AS path, count(*) AS n_children FROM above GROUP BY 1),
    summed AS (
      SELECT u.path, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
      FROM under u JOIN nodes n ON n.path = u.below LEFT JOIN children k ON k.path = u.below GROUP BY 1)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN summed s ON s.path = n.path LEFT JOIN children k ON k.path = n.path
    LEFT JOIN above a ON a.path = n.path LEFT JOIN nodes p ON p.path = a.parent
    """
}
