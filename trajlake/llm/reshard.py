"""Resharding by minimum-cost flow.

A sharded folder holds ``shard=K/`` folders of Parquet files. From the shards' sizes in bytes and the
capacities of the new shards a minimum-cost flow says how many bytes go from where to where. Staying
costs nothing, so no other plan moves fewer bytes. The flow is laid over the files (the blocks): what
stays is not touched, files that leave go whole, and only files on a border are split row by row.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.llm.text import table, text_bytes
from trajlake.session import new_folder

SHARDS = 8
#: The layout that the query starts from: so many shards, filled by source.
OLD_SHARDS = 6


def min_cost_flow(
    supply: Sequence[int], capacity: Sequence[int], cost: Callable[[int, int], int]
) -> dict[tuple[int, int], int]:
    """Units from each supplier to each receiver at least cost, by successive shortest paths.

    Runs on one number per shard, never on rows. Ties go to lower numbers.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are less than the data")
    n, m = len(supply), len(capacity)
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(capacity)
    potential = [0] * (n + m)
    while any(left):
        # Reduced costs are never negative, so Dijkstra's search holds on the residual network.
        far: list[float] = [float("inf")] * (n + m)
        back: list[int] = [-1] * (n + m)
        heap: list[tuple[float, int]] = []
        for i in range(n):
            if left[i]:
                far[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            if u < n:
                edges: Iterable[tuple[int, int]] = ((n + j, cost(u, j)) for j in range(m))
            else:
                edges = ((i, -cost(i, u - n)) for i in range(n) if flow.get((i, u - n)))
            for v, c in edges:
                step = d + c + potential[u] - potential[v]
                if step < far[v]:
                    far[v], back[v] = step, u
                    heapq.heappush(heap, (step, v))
        ends = [j for j in range(m) if room[j] and far[n + j] < float("inf")]
        end = min(ends, key=lambda j: (far[n + j] + potential[n + j], j))
        reach = far[n + end]
        for v in range(n + m):
            potential[v] += int(min(far[v], reach))
        path = [n + end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end])
        for u, v in zip(path, path[1:], strict=False):
            if u >= n:
                amount = min(amount, flow[(v, u - n)])
        for u, v in zip(path, path[1:], strict=False):
            key, sign = ((u, v - n), 1) if u < n else ((v, u - n), -1)
            flow[key] = flow.get(key, 0) + sign * amount
        left[path[0]] -= amount
        room[end] -= amount
    return {k: v for k, v in sorted(flow.items()) if v}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


@dataclass
class Layout:
    """A sharded table: files that stayed in the first folder, and the folder of rewritten ones."""

    spark: SparkSession
    schema: T.StructType
    folder: str
    kept: list[str]
    moved: str | None

    def rows(self) -> DataFrame:
        """``row`` (the input's columns), ``shard``, and the file's name."""
        parts = []
        if self.kept:
            parts.append(self.spark.read.schema(self.schema).option("basePath", self.folder).parquet(*self.kept))
        if self.moved:
            parts.append(self.spark.read.schema(self.schema).parquet(self.moved))
        if not parts:
            parts.append(self.spark.createDataFrame([], self.schema).withColumn("_metadata", F.struct(F.lit("").alias("file_name"))))
        found = [p.select("row", "shard", F.col("_metadata.file_name").alias("file")) for p in parts]
        return found[0] if len(found) == 1 else found[0].unionAll(found[1])


def lay_out(df: DataFrame, folder: str, shard: Column) -> T.StructType:
    """Write ``df`` as a sharded folder. Rows are kept in a struct, so column names cannot clash."""
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), shard.cast("int").alias("shard"))
    rows.write.partitionBy("shard").parquet(folder)
    return T.StructType([rows.schema["row"], T.StructField("shard", T.IntegerType())])


def reshard(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    size: Column,
    shards: int,
    cost: Callable[[int, int], int] = lambda old, new: int(old != new),
    capacities: Sequence[int] | None = None,
) -> tuple[Layout, dict[tuple[int, int], int]]:
    """Deal a sharded folder out to ``shards`` shards; returns the layout and the flow in bytes.

    ``size`` is an expression over ``row``. The driver sees one row per file, as any listing does.
    Without ``capacities`` the shards get equal sizes. On a border file a row goes to the side that
    holds the middle of it, so a cut is off by half a row at most. Files that stay are not rewritten.
    An empty folder gives an empty layout.
    """
    source = spark.read.schema(schema).parquet(folder)
    files = (
        source.select("shard", F.col("_metadata.file_path").alias("file"), size.alias("size"))
        .groupBy("shard", "file")
        .agg(F.sum("size").alias("bytes"))
        .collect()
    )
    old = sorted({f["shard"] for f in files})
    supply = [sum(f["bytes"] for f in files if f["shard"] == k) for k in old]
    room = list(capacities) if capacities is not None else even_capacities(sum(supply), shards)
    flow = {(old[i], j): v for (i, j), v in min_cost_flow(supply, room, lambda i, j: cost(old[i], j)).items()}
    kept: list[str] = []
    whole: list[tuple[str, int]] = []
    split: list[tuple[str, list[float], list[int]]] = []
    for k in old:
        # The shard's files end to end; what stays comes first.
        targets = sorted((j for i, j in flow if i == k), key=lambda j: (j != k, j))
        ends, at = [], 0
        for j in targets:
            at += flow[(k, j)]
            ends.append(at)
        at = 0
        for f in sorted((f for f in files if f["shard"] == k), key=lambda f: f["file"]):
            low, high = at, at + f["bytes"]
            at = high
            mine = [(float(e - low), j) for e, s, j in zip(ends, [0, *ends], targets, strict=False) if s < high and e > low]
            if len(mine) > 1:
                split.append((f["file"], [e for e, _ in mine], [j for _, j in mine]))
            elif mine[0][1] == k:
                kept.append(f["file"])
            else:
                whole.append((f["file"], mine[0][1]))
    parts = []
    if whole:
        go = spark.createDataFrame(whole, "file string, target int")
        rows = _some(spark, schema, folder, [f for f, _ in whole])
        parts.append(rows.join(go, "file").select("row", F.col("target").alias("shard")))
    if split:
        go = spark.createDataFrame(split, "file string, ends array<double>, targets array<int>")
        rows = _some(spark, schema, folder, [f for f, _, _ in split])
        order = Window.partitionBy("file").orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, 0)
        middle = F.sum("size").over(order) - F.col("size") / 2
        rows = rows.withColumn("size", size).withColumn("middle", middle).join(go, "file")
        passed = F.size(F.filter("ends", lambda e: e <= F.col("middle")))
        place = F.least(passed, F.size("ends") - 1)
        parts.append(rows.select("row", F.get("targets", place).alias("shard")))
    moved = None
    if parts:
        moved = new_folder(spark, "moved")
        (parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])).write.partitionBy("shard").parquet(moved)
    return Layout(spark, schema, folder, kept, moved), flow


def _some(spark: SparkSession, schema: T.StructType, folder: str, paths: list[str]) -> DataFrame:
    rows = spark.read.schema(schema).option("basePath", folder).parquet(*paths)
    return rows.select("row", F.col("_metadata.file_path").alias("file"))


def with_slots(layout: Layout, order: Sequence[Column], *extra: Column) -> DataFrame:
    """``shard``, ``slot`` (gapless from 0 in each shard) and ``extra`` columns over ``row``.

    Rows are counted inside files; only the files' counts are summed along a shard.
    """
    rows = layout.rows()
    counts = rows.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # Bound expressions first, so that the texts are gone before rows are dealt out.
    named = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    slim = rows.select("shard", "file", *named, *extra)
    inside = Window.partitionBy("shard", "file").orderBy(*[f"_o{i}" for i in range(len(order))])
    numbered = slim.withColumn("_n", F.row_number().over(inside) - 1)
    found = numbered.join(starts, ["shard", "file"]).withColumn("slot", (F.col("start") + F.col("_n")).cast("long"))
    return found.drop("_n", "start", "file", *[f"_o{i}" for i in range(len(order))])


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> Layout:
    """The documents, lying in ``OLD_SHARDS`` shards by source, dealt anew to ``shards`` equal ones.

    Needs ``text`` and ``source``; a row's size is its text's bytes plus one, one for a null text.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "shards")
    old = F.pmod(F.crc32(F.coalesce(docs["source"], F.lit(""))), F.lit(OLD_SHARDS))
    schema = lay_out(docs, folder, old)
    layout, _ = reshard(spark, folder, schema, text_bytes(F.col("row.text")) + 1, shards)
    return layout


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard``, which replaces a column of that name."""
    rows = shard_documents(docs, shards).rows()
    kept = [c for c in docs.columns if c.lower() != "shard"]
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "shard")


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 8 under the law ``bytes``, after resharding from the old layout.

    Returns doc_id, size, text_crc32 (null for a null text), law, shard, slot, grown_shard (null).
    Repeated rows each get a slot; an empty table gives no rows.
    """
    layout = shard_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    text = F.col("row.text")
    found = with_slots(
        layout,
        [F.col("row.doc_id"), F.crc32(text)],
        F.col("row.doc_id").alias("doc_id"),
        (text_bytes(text) + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
