"""Near-duplicate documents: bottom-k sketches, inverted lists, exact Jaccard.

One hash function orders a document's word shingles. Its sketch is the first k of them, with k large
enough for the threshold: documents that are similar enough share a retained value, whatever the order
is, as long as it is the same for all. So values known to be frequent come last in the order, and lists
of passages that many documents share are short. An inverted list leads its members to its leader, the
member with the fewest rarer values; links verified so far join components, and only pairs of
different components are looked at further. Pairs whose union sketch shows too little overlap are
dropped; the others are verified on the full shingle sets. Documents with equal sets, as told by their
size and 128 bits of hash, are one node, and only one of them has a sketch in the lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.text import byte_words, kth_largest, lean, table, texts_of, unpacked, with_id, with_row, written

#: Words per shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 85
#: Values of the sketch that estimates a pair's similarity, and how many of the union's must be common.
#: A pair at the threshold falls below with a probability of less than 1e-9.
ESTIMATE, COMMON = 64, 32
#: Frequent values that come last in the order: so many at most, seen this often at least, and counted
#: where a chunk of ``CHUNK`` shingles has them ``IN_CHUNK`` times. Which they are is a matter of speed only.
FREQUENT, SEEN, IN_CHUNK, CHUNK = 1 << 20, 16, 3, 4_000_000
REMEMBERED = 300_000

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Factors of the two halves of a set's mark.
_R, _T = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _Q
    return h ^ (h >> np.uint64(29))


def all_shingles(data: bytes | None, known: WordHash) -> np.ndarray:
    """The hashes of a text's shingles, repeated ones too; fewer words than a shingle are one.

    Only A-Z has another case for ``bytes.lower``.
    """
    words = byte_words(data.lower()) if data else []
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out *= _P
        out += each[k : k + len(out)]
    return _mixed(out)


def shingles(data: bytes | None, known: WordHash) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    return np.unique(all_shingles(data, known))


def half_mark(values: np.ndarray, factor: np.uint64) -> int | None:
    """64 bits that depend on which values a set has, not on their order; None for the empty set."""
    return int(_mixed(values * factor).sum(dtype=np.uint64).view(np.int64)) if len(values) else None


def retained(n: int) -> int:
    """Of n values in any common order, how many hold one of each set that is similar enough."""
    return n - (PERCENT * n + 99) // 100 + 1


@lean
def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, waiting, size = WordHash(), [], 0

    def out() -> pa.RecordBatch:
        values = np.concatenate(waiting)
        waiting.clear()
        values.sort()
        # No copy of all values: those that one ``IN_CHUNK - 1`` places before equals, at the end of their run.
        run = values[IN_CHUNK - 1 :] == values[: max(0, len(values) - IN_CHUNK + 1)]
        often = values[IN_CHUNK - 1 :][run]
        last = np.flatnonzero(np.append(often[1:] != often[:-1], True)[: len(often)])
        n = np.diff(last, prepend=-1) + IN_CHUNK - 1
        return pa.RecordBatch.from_arrays([pa.array(often[last].view(np.int64)), pa.array(n)], ["value", "n"])

    for batch in batches:
        for text in texts_of(batch.column(0)):
            waiting.append(all_shingles(text, known))
            size += len(waiting[-1])
            if size > CHUNK:
                yield out()
                size = 0
    if waiting:
        yield out()


def frequent_values(texts: DataFrame) -> np.ndarray:
    """Frequent shingles and their counts, in order of the shingles; ``FREQUENT`` at most."""
    counts = texts.mapInArrow(_frequent, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    counts = written(counts, "frequent")
    limit = kth_largest(counts, "n", FREQUENT + 1)
    top = (counts if limit is None else counts.where(F.col("n") > limit)).toPandas()
    values = top["value"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return np.stack([values[order], top["n"].to_numpy(np.int64)[order].view(np.uint64)])


def sketch(values: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first values of a set in the common order: by hash, frequent ones last and by their counts."""
    k = retained(len(values))
    if not often.shape[1]:
        return values[:k]
    place = np.minimum(np.searchsorted(often[0], values), often.shape[1] - 1)
    common = often[0][place] == values
    rare = values[~common][:k]
    if len(rare) == k:
        return rare
    rest = values[common]
    order = np.lexsort((rest, often[1][place[common]]))
    return np.concatenate([rare, rest[order][: k - len(rare)]])


def _nodes(often) -> callable:
    @lean
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frequent = WordHash(), often.value
        for batch in batches:
            sizes, marks, twins, firsts, least = [], [], [], [], []
            for text in texts_of(batch.column(2)):
                values = shingles(text, known)
                sizes.append(len(values))
                marks.append(half_mark(values, _R))
                twins.append(half_mark(values, _T))
                firsts.append(sketch(values, frequent).view(np.int64))
                # The upper bits in the same order, for estimates.
                least.append((values[:ESTIMATE] >> np.uint64(33)).astype(np.int32))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            made = [pa.array(c, t) for c, t in zip((sizes, marks, twins, firsts, least), types, strict=True)]
            names = ["row", "doc_id", "n", "mark", "twin", "sketch", "least"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names)

    return each


@lean
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [squeeze.compress(x or b"") for x in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["node", "packed"])


def could_link(n: Column, m: Column, i: Column, j: Column) -> Column:
    """Whether sets of n and m values can be similar enough if i and j come before their first common one."""
    common = F.least(n - i, m - j)
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * common >= PERCENT * (n + m))


@lean
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b, left, right) whose texts are similar enough; rows of one ``a`` come together."""
    open_, known = zstandard.ZstdDecompressor(), WordHash()
    last, mine = None, np.zeros(0, np.uint64)
    for batch in batches:
        hits = []
        for i, (a, left, right) in enumerate(zip(batch.column(0).to_numpy(), batch.column(2), batch.column(3), strict=True)):
            if a != last:
                last, mine = a, shingles(open_.decompress(left.as_py()), known)
            other = shingles(open_.decompress(right.as_py()), known)
            common = len(np.intersect1d(mine, other, assume_unique=True))
            if 100 * common >= PERCENT * (len(mine) + len(other) - common):
                hits.append(i)
        yield batch.select(["a", "b"]).take(pa.array(hits, pa.int64()))


def links(pairs: DataFrame, marks: DataFrame, packed: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough. Pairs are many more than the planner sees."""
    one = pairs.hint("merge").join(marks.select(F.col("node").alias("a"), F.col("least").alias("la")), "a")
    two = one.hint("merge").join(marks.select(F.col("node").alias("b"), F.col("least").alias("lb")), "b")
    union = F.slice(F.array_sort(F.array_union("la", "lb")), 1, ESTIMATE)
    common = F.size(F.array_intersect(F.array_intersect("la", "lb"), union))
    near = two.where(common * ESTIMATE >= COMMON * F.size(union)).select("a", "b")
    right = near.hint("merge").join(packed.select(F.col("node").alias("b"), F.col("packed").alias("right")), "b")
    both = right.hint("merge").join(packed.select(F.col("node").alias("a"), F.col("packed").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(_verified, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest node reachable, for all nodes of ``edges`` (a, b).

    Every round links a node's neighbours to the smallest one, first the larger neighbours, then the
    smaller ones, until all edges lead to the components' smallest nodes.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = written(large.where("a <> b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = small.unionAll(low.select("a", F.col("least").alias("b"))).where("a <> b").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (row, doc_id, text) with groups: row, doc_id, n_shingles, component_id, kept, first.

    ``row`` is a long that is a row's own. component_id is the group's smallest doc_id (null if none
    has one), ``kept`` whether it is the row's, ``first`` is true for one row of each group.
    Texts without words are groups of their own.
    """
    spark = docs.sparkSession
    rows = docs.select("row", "doc_id", "text")
    often = spark.sparkContext.broadcast(frequent_values(rows.select("text")))
    schema = "row long, doc_id long, n long, mark long, twin long, sketch array<long>, least array<int>"
    each = written(rows.mapInArrow(_nodes(often), schema), "sketches")
    # Tables, here and below, so that joins deal out both sides and can split a large group of copies.
    groups = written(each.where("n > 0").groupBy("mark", "twin", "n").agg(F.min("row").alias("node")), "groups")
    # One sketch of each group: ``node`` is a row's own number, so the join has no hot key.
    chosen = written(each.select(F.col("row").alias("node"), "n", "sketch").join(groups.select("node"), "node"), "chosen")
    posts = chosen.select("node", "n", F.posexplode("sketch").alias("i", "value"))
    lists = posts.groupBy("value").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    # As a table, so that the join deals out both sides and can split a long list.
    shared = written(lists.where("low <> high").select("value"), "shared")
    named = written(posts.hint("merge").join(shared.hint("merge"), "value").select("value", "node", "n", "i"), "lists")
    wanted = named.select("node").distinct()
    packed = rows.select(F.col("row").alias("node"), "text").mapInArrow(_packed, "node long, packed binary")
    packed = written(packed.join(wanted, "node"), "texts")
    marks = each.select(F.col("row").alias("node"), "least")
    # First every member with its list's leader.
    leaders = named.groupBy("value").agg(F.min(F.struct("i", "node", "n")).alias("l"))
    led = named.join(leaders, "value").where((F.col("node") != F.col("l.node")) & could_link(F.col("n"), F.col("l.n"), F.col("i"), F.col("l.i")))
    first = written(links(led.select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct(), marks, packed), "links")
    known = written(components(first), "components")
    # Then the members that are still in different components.
    placed = named.join(known, "node", "left").select("value", "node", "n", "i", F.coalesce("component", "node").alias("c"))
    placed = written(placed, "placed")
    open_ = placed.groupBy("value").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("value")
    rest = placed.join(open_, "value")
    other = rest.select("value", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "i", "c")])
    pairs = rest.hint("merge").join(other, "value").where((F.col("node") < F.col("node2")) & (F.col("c") != F.col("c2")))
    pairs = pairs.where(could_link(F.col("n"), F.col("n2"), F.col("i"), F.col("i2")))
    second = links(pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct(), marks, packed)
    found = written(components(first.unionAll(second)), "components")
    nodes = groups.join(found, "node", "left").select("mark", "twin", "n", F.coalesce("component", "node").alias("component"))
    nodes = written(nodes, "nodes")
    grouped = each.select("row", "doc_id", "n", "mark", "twin").join(nodes, ["mark", "twin", "n"], "left")
    grouped = written(grouped.withColumn("component", F.coalesce("component", "row")), "grouped")
    facts = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("f"))
    facts = written(facts, "facts")
    return grouped.join(facts, "component").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("row") == F.col("f.row")).alias("first"),
    )


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group: doc_id, n_shingles, component_id, kept.

    A null or empty text has no shingles and is a group of its own; very long texts count whole. Rows
    without doc_id are kept only in groups where none has one; rows that repeat the group's smallest
    doc_id are all kept. An empty table gives no rows.
    """
    docs = with_row(table(spark, sf_dir, "documents", "doc_id", "text"))
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs``, a table read from files, with one row of each group: the one with the smallest doc_id."""
    rows = with_id(docs)
    groups = near_duplicates(rows.select(F.col("id").alias("row"), F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")))
    return unpacked(rows.join(groups.where("not first").select(F.col("row").alias("id")), "id", "left_anti"), docs.columns)
