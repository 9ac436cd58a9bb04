"""Merkle manifest of a dataset, with hash states kept for folding changes.

Every row is a leaf; leaves are numbered within their partition and form one tree per partition, and
the partitions' roots form one more tree. A tree is built in blocks of ``FAN ** LEVELS`` neighbouring
nodes, a round of blocks per ``LEVELS`` levels, so that no task holds more than a block however large a
partition is. Inside a block each parent keeps a copy of its hash state before every child slot. A
changed leaf is folded upwards by resuming, at each parent, the state before its own slot with the
replacement and the right siblings only: what lies to the left is in the state already. Hash states
cannot leave a process, so what passes between rounds is each block's path: the siblings left and right
of it. The states before a block's slots are made once from the left ones, for all leaves of the block.

Rows with the same doc_id are ordered by their leaf. Null fields have a mark of their own, a null
partition comes first, and an empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.llm.text import table, written

#: Children of a node, and levels that one round builds: blocks of 1,024 nodes.
FAN = 2
LEVELS = 10
SIDES = "array<struct<left: array<string>, right: array<string>>>"
SIDES_TYPE = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))


def height(n: int, fan: int) -> int:
    """Levels above ``n`` leaves."""
    levels, most = 0, 1
    while most < n:
        levels, most = levels + 1, most * fan
    return levels


class Block:
    """The lowest ``levels`` levels over some neighbouring nodes."""

    def __init__(self, nodes: list[bytes], levels: int, fan: int) -> None:
        self.fan = fan
        self.levels = [nodes]
        #: By level and node: the parent's state before the node's slot.
        self.before: list[list] = []
        for _ in range(levels):
            below, above, states = self.levels[-1], [], []
            for first in range(0, len(below), fan):
                state = hashlib.sha256()
                for child in below[first : first + fan]:
                    states.append(state.copy())
                    state.update(child)
                above.append(state.hexdigest().encode())
            self.levels.append(above)
            self.before.append(states)

    def root(self) -> bytes:
        return self.levels[-1][0]

    def right(self, level: int, i: int) -> list[bytes]:
        return self.levels[level][i + 1 : (i // self.fan + 1) * self.fan]

    def left(self, level: int, i: int) -> list[bytes]:
        return self.levels[level][i // self.fan * self.fan : i]

    def fold(self, i: int, node: bytes) -> bytes:
        """The block's root with ``node`` in place ``i``."""
        for level, states in enumerate(self.before):
            state = states[i].copy()
            state.update(node)
            for sibling in self.right(level, i):
                state.update(sibling)
            node, i = state.hexdigest().encode(), i // self.fan
        return node

    def sides(self, i: int) -> list[tuple[list[bytes], list[bytes]]]:
        """The siblings of node ``i`` and of its ancestors, left and right, level by level."""
        out = []
        for level in range(len(self.before)):
            out.append((self.left(level, i), self.right(level, i)))
            i //= self.fan
        return out


class Path:
    """What lies above a block: the states before its slots, and the siblings to the right."""

    def __init__(self, sides: list[dict]) -> None:
        self.steps = []
        self.siblings = b"".join(x.encode() for s in sides for x in (*s["left"], *s["right"]))
        for s in sides:
            state = hashlib.sha256("".join(s["left"]).encode())
            self.steps.append((state, "".join(s["right"]).encode()))

    def fold(self, node: bytes) -> bytes:
        for before, right in self.steps:
            state = before.copy()
            state.update(node)
            state.update(right)
            node = state.hexdigest().encode()
        return node


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tree_key(partition: Column) -> Column:
    """A key that is never null and sorts like ``partition`` in bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), partition.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, a table read from files, with ``pos`` (from 0) and ``n`` (rows) within ``key``.

    Sorted by ranges and written; a row's place is its place in its file, less where its key begins there,
    plus what earlier files hold of the key. The window sees one row per key and file.
    """
    place = [F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")]  # parts equal rows
    by = ["key", *[F.col(c).asc_nulls_first() for c in order]]
    placed = rows.select("*", place[0].alias("_file"), place[1].alias("_index"))
    ordered = placed.repartitionByRange(*by, "_file", "_index").sortWithinPartitions(*by, "_file", "_index")
    ordered = written(ordered.select(*rows.columns, F.spark_partition_id().alias("part")), "merkle-order")
    at = ordered.select("*", F.col("_metadata.row_index").alias("_index"))
    parts = at.groupBy("key", "part").agg(F.min("_index").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("key")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "key", "part", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(whole).alias("n"),
    )
    return at.join(parts, ["key", "part"]).select(*rows.columns, (F.col("_index") + F.col("shift")).alias("pos"), "n")


@dataclass(frozen=True)
class Shape:
    """Children of a node and levels of a block; what tasks need to know of a forest."""

    fan: int
    levels: int

    def width(self) -> int:
        return self.fan**self.levels

    def part(self, n: int, r: int) -> int:
        """Levels that round ``r`` builds over a key of ``n`` leaves."""
        return min(self.levels, max(0, height(n, self.fan) - r * self.levels))

    def block(self, group: pa.Table, r: int) -> Block:
        """The tree over a block's nodes, which come in order."""
        return Block(nodes_of(group), self.part(group["n"][0].as_py(), r), self.fan)


@dataclass
class Forest:
    """``rounds[r]``: nodes (key, n, pos, digest) after r rounds; in the last one, the keys' roots."""

    rounds: list[DataFrame]
    shape: Shape

    def roots(self) -> DataFrame:
        return self.rounds[-1]

    def blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.call_function("div", F.col("pos"), F.lit(self.shape.width())))


def nodes_of(group: pa.Table, column: str = "digest") -> list[bytes]:
    return [x.encode() for x in group.column(column).to_pylist()]


def grown(nodes: DataFrame, fan: int = FAN, levels: int = LEVELS) -> Forest:
    """Trees over ``nodes`` (key, n, pos, digest), one per key, round by round."""
    shape = Shape(fan, levels)
    forest = Forest([nodes], shape)
    most = nodes.agg(F.max("n")).first()[0] or 0

    def climb(r: int) -> Callable[[pa.Table], pa.Table]:
        def up(group: pa.Table) -> pa.Table:
            group = group.sort_by("pos")
            at = {"key": group["key"][:1], "n": group["n"][:1], "pos": group["block"][:1]}
            return pa.table(at | {"digest": [shape.block(group, r).root().decode()]})

        return up

    for r in range(-(-height(most, fan) // levels)):
        above = forest.blocks(forest.rounds[-1]).groupBy("key", "block").applyInArrow(climb(r), "key string, n long, pos long, digest string")
        forest.rounds.append(written(above, "merkle-nodes"))
    return forest


def sides_of(block: Block, above: list[dict]) -> pa.Array:
    """Each node's path: its siblings inside the block, then ``above``."""
    own = (block.sides(i) for i in range(len(block.levels[0])))
    named = ([{"left": [x.decode() for x in a], "right": [x.decode() for x in b]} for a, b in sides] for sides in own)
    return pa.array([x + above for x in named], SIDES_TYPE)


def paths(forest: Forest, above: DataFrame) -> DataFrame:
    """For each block of the forest's first nodes: (key, block, sides, subroot, root).

    ``above`` has the path of each key's root: key, sides, subroot, root.
    """
    out = above.select("key", F.lit(0).cast("long").alias("block"), "sides", "subroot", "root")
    shape = forest.shape

    def descend(r: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def down(group: pa.Table, path: pa.Table) -> pa.Table:
            group, up = group.sort_by("pos"), path.to_pylist()[0]
            sides = sides_of(shape.block(group, r), up["sides"])
            same = {c: pa.array([up[c]] * len(group), pa.string()) for c in ("subroot", "root")}
            return pa.table({"key": group["key"], "block": group["pos"], "sides": sides} | same)

        return down

    for r in range(len(forest.rounds) - 2, 0, -1):
        below = forest.blocks(forest.rounds[r]).groupBy("key", "block")
        schema = f"key string, block long, sides {SIDES}, subroot string, root string"
        out = written(below.cogroup(out.groupBy("key", "block")).applyInArrow(descend(r), schema), "merkle-paths")
    return out


def proofs(forest: Forest, leaves: DataFrame, above: DataFrame) -> DataFrame:
    """Per leaf: subroot, root, the hash of its siblings, and the root folded from ``replaced``.

    ``leaves`` has the columns of the forest's first nodes, ``id`` and ``replaced`` (a digest, the same
    or another). What is under each leaf is read once; its block's path comes as one row.
    """
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    shape = forest.shape

    def prove(group: pa.Table, path: pa.Table) -> pa.Table:
        group, up = group.sort_by("pos"), path.to_pylist()[0]
        block, over = shape.block(group, 0), Path(up["sides"])
        proof, folded = [], []
        for i, new in enumerate(nodes_of(group, "replaced")):
            own = b"".join(x for sides in block.sides(i) for side in sides for x in side)
            proof.append(hashlib.sha256(own + over.siblings).hexdigest())
            folded.append(over.fold(block.fold(i, new)).decode())
        return pa.table(
            {
                "id": group["id"], "leaf": group["digest"], "subroot": [up["subroot"]] * len(group),
                "root": [up["root"]] * len(group), "proof_sha256": proof, "folded_root": folded,
            }
        )

    below = forest.blocks(leaves).groupBy("key", "block")
    return below.cogroup(paths(forest, above).groupBy("key", "block")).applyInArrow(prove, schema)


@dataclass
class Manifest:
    """The trees of the partitions, and the tree over their roots."""

    leaves: DataFrame
    trees: Forest
    top: Forest

    def above(self) -> DataFrame:
        """Each partition's path to the root."""
        root = self.top.roots().select(F.col("digest").alias("root"))
        at = F.struct(F.array().cast(SIDES).alias("sides"), F.lit(None).cast("string").alias("subroot"), "root")
        start = root.select(F.lit("").alias("key"), at.alias("at")).select("key", "at.*")

        shape = self.top.shape

        def own(group: pa.Table, path: pa.Table) -> pa.Table:
            group, up = group.sort_by("pos"), path.to_pylist()[0]
            sides = sides_of(shape.block(group, 0), up["sides"])
            root = pa.array([up["root"]] * len(group))
            return pa.table({"key": group["tree"], "sides": sides, "subroot": group["digest"], "root": root})

        below = self.top.blocks(self.top.rounds[0]).groupBy("key", "block")
        higher = paths(self.top, start).groupBy("key", "block")
        found = below.cogroup(higher).applyInArrow(own, f"key string, sides {SIDES}, subroot string, root string")
        return written(found, "merkle-partitions")

    def fold(self) -> DataFrame:
        """``proofs`` of all leaves."""
        return proofs(self.trees, self.leaves, self.above())


def manifest(rows: DataFrame, fan: int = FAN, levels: int = LEVELS) -> Manifest:
    """The manifest of ``rows``: key (``tree_key``), id (the order within it), digest, replaced."""
    leaves = written(numbered(written(rows, "merkle-leaves"), "id", "digest"), "merkle-numbered")
    trees = grown(leaves, fan, levels)
    roots = trees.roots().select(F.lit("").alias("key"), F.col("key").alias("tree"), "digest")
    top = written(numbered(written(roots, "merkle-roots"), "tree"), "merkle-roots")
    return Manifest(leaves, trees, grown(top, fan, levels))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, one tree per lang, and each row's proof and folded root.

    Null fields are ``-``, a null lang is a partition of its own and comes first, rows without doc_id come
    first in theirs; of rows with one doc_id the smaller leaf comes first. Repeated rows are leaves each. Empty and
    very long texts are hashed whole. No rows: no rows. A row with a null doc_id or n_chars is never tampered with.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")

    def digest(n_chars: Column) -> Column:
        return leaf(docs["doc_id"], docs["source"], docs["lang"], n_chars, docs["text"])

    own = digest(docs["n_chars"])
    tampered = docs["n_chars"].isNotNull() & (F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0)
    rows = docs.select(
        tree_key(docs["lang"]).alias("key"), docs["doc_id"].alias("id"), own.alias("digest"),
        F.when(tampered, digest(docs["n_chars"] + 1)).otherwise(own).alias("replaced"),
    )
    found = manifest(rows).fold()
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


#: Trees and paths by recursion, a level at a time; crc32 bit by bit.
OP12_SQL = """
WITH RECURSIVE
fields AS (
    SELECT doc_id, lang, n_chars,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS size,
        coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more,
        coalesce(strlen(text) || ':' || text, '-') AS tail,
        4294967295 - list_reduce(
            list_prepend(4294967295::BIGINT, flatten(list_transform(
                string_split(coalesce(doc_id::VARCHAR, ''), ''),
                lambda c: [CASE WHEN c = '' THEN 0 ELSE ascii(c) END::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
            lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))) AS crc
    FROM documents
),
digests AS (
    SELECT doc_id, lang, sha256(head || size || tail) AS leaf,
        CASE WHEN doc_id IS NOT NULL AND crc % 7 = 0 THEN sha256(head || more || tail) ELSE sha256(head || size || tail) END AS changed
    FROM fields
),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        coalesce('=' || lang, '-') AS key
    FROM digests
),
nodes AS (
    SELECT key, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY key) AS width FROM leaves
    UNION ALL
    SELECT key, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(width) + 1) // 2
    FROM nodes WHERE width > 1 GROUP BY key, level, pos // 2
),
subroots AS (
    SELECT key, digest AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos FROM nodes WHERE width = 1
),
tops AS (
    SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS width FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(width) + 1) // 2
    FROM tops WHERE width > 1 GROUP BY level, pos // 2
),
every AS (
    SELECT key, level, pos, digest, width FROM nodes
    UNION ALL SELECT '', level, pos, digest, width FROM tops
),
climb AS (
    SELECT l.key AS tree, l.pos AS leaf_pos, l.key, 0 AS level, l.pos, '' AS proof, l.changed AS folded
    FROM leaves l
    UNION ALL
    SELECT c.tree, c.leaf_pos, CASE WHEN n.width > 1 THEN c.key ELSE '' END,
        CASE WHEN n.width > 1 THEN c.level + 1 ELSE 0 END,
        CASE WHEN n.width > 1 THEN c.pos // 2 ELSE t.pos END,
        c.proof || CASE WHEN n.width > 1 THEN coalesce(s.digest, '') ELSE '' END,
        CASE WHEN n.width > 1 THEN sha256(CASE WHEN c.pos % 2 = 0 THEN c.folded || coalesce(s.digest, '') ELSE s.digest || c.folded END)
            ELSE c.folded END
    FROM climb c
    JOIN every n ON n.key = c.key AND n.level = c.level AND n.pos = c.pos
    LEFT JOIN every s ON s.key = c.key AND s.level = c.level AND s.pos = xor(c.pos, 1)
    LEFT JOIN subroots t ON t.key = c.key
    WHERE n.width > 1 OR c.key <> ''
),
ended AS (
    SELECT c.* FROM climb c JOIN every n ON n.key = c.key AND n.level = c.level AND n.pos = c.pos
    WHERE c.key = '' AND n.width = 1
)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
    e.folded = t.digest AS verified
FROM leaves l
JOIN ended e ON e.tree = l.key AND e.leaf_pos = l.pos
JOIN subroots s ON s.key = l.key
JOIN tops t ON t.width = 1
"""
