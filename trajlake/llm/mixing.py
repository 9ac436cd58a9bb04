"""Mixing sources to target weights, with DataFrame operations only.

Each source's documents are packed end to end into blocks of ``BLOCK`` words; a source too small for
``BLOCKS`` of these has blocks of a ``BLOCKS``-th of its size, so that it can meet its target too. A target, in
words, gives its quota of blocks. The output consists of shards of ``SLOTS`` blocks; how many each
shard gets of each source is a multinomial draw conditioned on the quotas (slots are dealt to shards
by a pseudorandom permutation), so the totals meet the targets. A source's slots, counted on from
shard to shard, run through pseudorandom permutations of its block numbers, one for each pass, so no
block is taken a second time before every block has been taken once. Blocks are joined by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.llm.text import WORD, n_words, table, with_id, written

BLOCK = 256
#: Blocks that a source is cut into at least, if it has as many words.
BLOCKS = 256
SLOTS = 1024
SEED = 20_250
WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size.
MOST = 3
#: Documents per bucket when a source's word positions are summed up.
BUCKET_ROWS = 1024
#: Slots that one task makes from one row.
CHUNK = 8192
ROUNDS = 24


def permuted(index: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1: rounds that swap ``x`` with ``k - x`` or leave both.

    Works for any ``n`` without tables or sorting: a round maps the pair {x, k - x} onto itself.
    """

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *seed), n) - x, n)
        swap = F.xxhash64(F.greatest(x, other), r, *seed).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index, step)


def targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """``sources`` (source, size) with number, weight and target; one row per source.

    Weights repeat by the sources' code points, null last. The target is the lesser of ``most`` times
    the size and the weight's share of what the capped sources leave. In order of size by weight the
    capped sources come first, so one pass finds the level at which no further source is capped.
    """
    byname = Window.orderBy(F.col("source").asc_nulls_last())
    out = sources.withColumn("sid", F.row_number().over(byname))
    choice = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    out = out.withColumn("weight", F.get(choice, (F.col("sid") - 1) % len(WEIGHTS)))
    out = out.withColumn("most", F.lit(float(most)) * F.col("size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    out = out.withColumn("level", level)
    holds = F.col("level") * F.col("weight") <= F.col("most")
    lowest = F.struct((F.col("most") / F.col("weight")).alias("at"), "sid", "level")
    out = out.withColumn("first", F.min(F.when(holds, lowest)).over(whole))
    share = F.least(F.col("most"), F.coalesce(F.col("first.level") * F.col("weight"), F.col("most")))
    return out.select("source", "sid", "size", "weight", share.alias("target"))


def quotas(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The length and number of each source's blocks, how many to take (``quota``), and where its slots begin."""
    length = F.least(F.lit(block), F.greatest(F.lit(1), F.expr(f"size div {BLOCKS}"))).cast("long")
    sources = sources.withColumn("length", length)
    n = F.ceil(F.col("size") / F.col("length"))
    quota = F.least(n * MOST, F.round(F.col("target") * n / F.greatest(F.col("size"), F.lit(1))).cast("long"))
    out = sources.withColumn("blocks", n).withColumn("quota", quota)
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return (
        out.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)))
        .withColumn("slots", F.sum("quota").over(Window.partitionBy()))
    )


def packed(docs: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """``docs`` (source, size, order columns) with the source's number, its blocks' ``length``, and the word position ``start``.

    Positions are summed inside buckets; a source has one row per bucket to sum along.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    keys = [c for c in docs.columns if c != "source"]
    s = sources.select(F.col("source").alias("_source"), "sid", "length")
    out = docs.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    out = out.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sums = out.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return out.join(starts, ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner", "bucket")


def shard_counts(quota: DataFrame, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """How many blocks of each source each output shard gets, and where these begin among the source's."""
    chunks = quota.where("quota > 0").select(
        "sid", "blocks", "quota", "first", "slots",
        F.explode(F.sequence(F.lit(0), F.expr(f"(quota - 1) div {CHUNK}"))).alias("chunk"),
    )
    low = F.col("chunk") * CHUNK
    each = chunks.repartition("sid", "chunk").select(
        "sid", "blocks", "first", "slots",
        F.explode(F.sequence(low, F.least(low + CHUNK, F.col("quota")) - 1)).alias("j"),
    )
    place = permuted(F.col("first") + F.col("j"), F.col("slots"), F.lit(seed))
    drawn = each.withColumn("shard", F.floor(place / slots)).groupBy("sid", "blocks", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))


def draws(counts: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per block of the mix: ``shard``, source, the pass over the source, and the block's number."""
    each = counts.select("sid", "blocks", "shard", F.explode(F.sequence("begin", F.col("begin") + F.col("n") - 1)).alias("j"))
    turn = F.expr("j div blocks")
    index = permuted(F.pmod(F.col("j"), F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("sid"), turn)
    return each.select("sid", "shard", turn.alias("turn"), index.alias("block"))


def pieces(packs: DataFrame) -> DataFrame:
    """A row for each block that a document's words lie in: the document's words ``skip`` .. ``skip + words - 1``."""
    end = F.col("start") + F.col("size")
    spread = F.sequence(F.expr("start div length"), F.expr("(start + size - 1) div length"))
    out = packs.where("size > 0").withColumn("block", F.explode(spread))
    low = F.greatest(F.col("start"), F.col("block") * F.col("length"))
    high = F.least(end, (F.col("block") + 1) * F.col("length"))
    return out.withColumn("skip", low - F.col("start")).withColumn("words", high - low)


def _prepared(slim: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources with quotas, documents at their word positions, and the blocks taken."""
    sums = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    sums = written(sums, "sources")
    rows = sums.agg(F.sum("rows")).first()[0] or 0
    quota = written(quotas(targets(sums.select("source", "size"))), "quotas")
    return quota, packed(slim, quota, rows), draws(shard_counts(quota))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document.

    Returns doc_id, size, source_size, target (both of the source), taken. A null text has size 0 and
    is taken 0 times; documents without source are one source; repeated rows are packed one by one.
    An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    slim = written(docs.select("doc_id", "source", n_words(docs["text"]).alias("size")), "sizes")
    quota, packs, drawn = _prepared(slim)
    takes = drawn.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    # Blocks grow with the data, which the planner cannot see behind the explode: no broadcast.
    found = pieces(packs).join(takes.hint("merge"), ["sid", "block"], "left")
    taken = F.sum(F.col("words") * F.coalesce(F.col("times"), F.lit(0))).alias("taken")
    found = found.groupBy("sid", "start", "doc_id", "size").agg(taken).select("sid", "doc_id", "size", "taken")
    s = quota.select("sid", "source", F.col("size").alias("source_size"), "target")
    none = slim.where("size = 0").join(s, slim["source"].eqNullSafe(s["source"]))
    none = none.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return found.join(s, "sid").select("doc_id", "size", "source_size", "target", "taken").unionAll(none)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass over a source, the words taken of each document.

    A document whose blocks were all taken in a pass keeps its text as it is; of others the words
    taken remain, joined by one blank. ``n_chars`` follows the text. Columns are those of ``docs``, a
    table read from files; a document without words is not in the mix.
    """
    rows = with_id(docs)
    slim = rows.select("id", F.col("row.source").alias("source"), n_words(F.col("row.text")).alias("size"))
    slim = written(slim, "sizes")
    _, packs, drawn = _prepared(slim)
    parts = pieces(packs).join(drawn.select("sid", "block", "turn").hint("merge"), ["sid", "block"])
    cuts = parts.groupBy("id", "size", "turn").agg(
        F.sort_array(F.collect_list(F.struct("skip", "words"))).alias("cuts"), F.sum("words").alias("taken")
    )
    found = rows.join(cuts.hint("merge"), "id")
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    some = F.flatten(F.transform("cuts", lambda c: F.slice(words, (c["skip"] + 1).cast("int"), c["words"].cast("int"))))
    text = F.when(F.col("taken") == F.col("size"), F.col("row.text")).otherwise(F.array_join(some, " "))
    out = found.withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
