"""I-Match fingerprints over randomised lexicon subsets, with DataFrame operations only.

The lexicon holds the terms whose share of documents lies in a band. A fingerprint has one hash per
lexicon subset: that of the sorted distinct terms that the subset keeps: the whole lexicon, and from an
eighth to a 1024th of it, so that documents of any length have subsets that a change misses.

Terms are numbered by hash into ``SLOTS`` slots. The band is one of shares, so a slot that many rare
terms fall into stays below it at any size, and the lexicon is a bit set of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.llm.text import GAP, table, written

SLOTS = 1 << 20
#: Terms in at least the first and at most the second share of all documents are kept.
BAND = (0.0005, 0.25)
#: Besides the whole lexicon: ``SEEDS`` subsets each of 1/8, 1/16, .. 1/1024 of it.
DENSEST, LEVELS, SEEDS = 3, 8, 4
#: Documents per bucket, on average, when each meets its successor.
BUCKET_ROWS = 512
#: Percentiles of doc_id, and of doc_id between two of them, by which buckets are cut: bounded whatever the data.
KNOTS = 256
#: Buckets whose order is worked out together.
GROUP = 4096


def terms(text: Column) -> Column:
    """A text's distinct words in lower case; none for null."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP)), "")


def lexicon(docs: DataFrame, text: str, rows: int, band: tuple[float, float] = BAND) -> Column:
    """The band's terms as a bit set: an array of ``SLOTS / 64`` numbers, whatever the data."""
    found = docs.select(F.explode(terms(F.col(text))).alias("term"))
    share = F.col("n") / F.lit(max(1, rows))
    slot = F.xxhash64("term").bitwiseAND(F.lit(SLOTS - 1))
    inside = found.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where(share.between(*band))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = inside.groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    bits = [0] * (SLOTS // 64)
    for w in words:
        bits[w["word"]] = w["bits"]
    # Split and cast of a constant are folded, so the array is made once for all rows.
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")


def fingerprint(text: Column, bits: Column) -> Column:
    """One number per subset, the whole lexicon first; null where the subset keeps none of the terms.

    A term's mark is its 64-bit hash: the low bits are its slot, others decide for the subsets. The
    subsets of one seed lie in each other, so each is filtered from the one before.
    """
    marks = F.transform(terms(text), lambda w: F.xxhash64(w))
    known = F.filter(
        marks,
        lambda m: F.getbit(
            F.get(bits, F.shiftright(m.bitwiseAND(F.lit(SLOTS - 1)), 6).cast("int")), m.bitwiseAND(F.lit(63)).cast("int")
        ) == 1,
    )

    def chain(kept: Column, seed: int) -> Column:
        masks = F.array(*[F.lit(((1 << level) - 1) << (20 + 11 * seed)) for level in range(DENSEST, DENSEST + LEVELS)])
        first = F.array(kept)
        lists = F.aggregate(
            masks, first, lambda acc, mask: F.concat(acc, F.array(F.filter(F.element_at(acc, -1), lambda m: m.bitwiseAND(mask) == 0)))
        )
        return lists if seed == 0 else F.slice(lists, 2, LEVELS)

    def hashes(kept: Column) -> Column:
        lists = F.concat(*[chain(kept, seed) for seed in range(SEEDS)])
        return F.transform(lists, lambda x: F.when(F.size(x) > 0, F.xxhash64(x)))

    # The sorted terms are bound once, as the only element of an array.
    return F.get(F.transform(F.array(F.array_sort(known)), hashes), F.lit(0))


def as_text(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda h: F.lower(F.hex(h))), "-", ".")


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes by subsets that keep terms of either text; 1 for texts without terms."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(both, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = F.size(F.filter(both, lambda p: p["a"] == p["b"]))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half replaced by as much of the beginning of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), (F.length(text) - half).cast("int")), F.substr(other, F.lit(1), half))


def _knots(key: Column) -> Column:
    return F.percentile_approx(key, F.array(*[F.lit(i / KNOTS) for i in range(KNOTS + 1)]), 10 * KNOTS)


def _below(knots: Column, key: Column) -> tuple[Column, Column]:
    """How many knots are smaller than ``key``, and how many are no larger."""
    return F.size(F.filter(knots, lambda k: k < key)), F.size(F.filter(knots, lambda k: k <= key))


def bucketed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``bucket``, which counts up in descending doc_id, rows without one last.

    Buckets follow the counts, not the range of doc_id: percentiles cut the rows into bands, and
    percentiles of each band cut it again; between two of these buckets are equal ranges. A doc_id, or none, that
    very many rows have lies on several percentiles and is spread over its buckets in order of its texts' hashes.
    """
    # Turned over, so that it ascends in descending doc_id, with nothing beyond what stands for null.
    turned = docs.withColumn("turned", F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)))
    first = turned.agg(_knots(F.col("turned")).alias("knots")).first()["knots"] or []
    band = _below(F.array(*[F.lit(k).cast("long") for k in first]), F.col("turned"))[1].alias("band")
    bands = turned.select("turned", band).groupBy("band").agg(F.count(F.lit(1)).alias("n"), _knots(F.col("turned")).alias("knots"))
    wide = bands.withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS))
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    # KNOTS + 1 rows of KNOTS + 1 numbers.
    wide = wide.withColumn("base", F.coalesce(F.sum(F.col("buckets") + 1).over(before), F.lit(0)))
    found = turned.withColumn("band", band).join(F.broadcast(wide), "band")
    smaller, reached = _below(F.col("knots"), F.col("turned"))
    found = found.withColumn("_smaller", smaller).withColumn("_reached", reached)
    low, high = F.get("knots", F.col("_smaller") - 1).cast("double"), F.get("knots", F.col("_smaller")).cast("double")
    between = F.col("_smaller") - 1 + F.coalesce((F.col("turned").cast("double") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    part = F.xxhash64("text").cast("double") / float(1 << 64) + 0.5
    on_one = F.col("_smaller") + part * (F.col("_reached") - F.col("_smaller") - 1)
    place = F.when(F.col("_reached") > F.col("_smaller"), on_one).otherwise(F.greatest(between, F.lit(0.0)))
    bucket = F.col("base") + F.floor(F.least(place / KNOTS, F.lit(1.0)) * F.col("buckets"))
    return found.select(*docs.columns, bucket.cast("long").alias("bucket"))


def followed(buckets: DataFrame) -> DataFrame:
    """Each ``bucket`` with the next larger one (``head``); the first follows the last."""
    grouped = buckets.select("bucket", F.expr(f"bucket div {GROUP}").alias("group"))
    groups = grouped.groupBy("group").agg(F.min("bucket").alias("least"))
    next_group = F.coalesce(F.lead("least").over(Window.orderBy("group")), F.min("least").over(Window.partitionBy()))
    after = groups.select("group", next_group.alias("after"))
    inside = grouped.withColumn("head", F.lead("bucket").over(Window.partitionBy("group").orderBy("bucket")))
    return inside.join(after, "group").select("bucket", F.coalesce("head", "after").alias("head"))


def _compared(rows: DataFrame, bits: Column) -> DataFrame:
    """Adds what depends on the successor (``next_text``, ``next_print``); null where it is not known yet."""
    out = rows.withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    out = out.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    out = out.withColumn("edited_print", F.when(F.col("_edited").isNotNull(), fingerprint(F.col("_edited"), bits)))
    return out.drop("_edited")


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text is empty. The successor is the row next in descending doc_id, rows without doc_id
    last, rows of one doc_id in order of their texts' hashes; the last row's is the first, so a single
    row is its own. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bits = lexicon(docs, "text", docs.count())
    rows = bucketed(docs).select("doc_id", "text", fingerprint(F.col("text"), bits).alias("print"), "bucket")
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    rows = (
        rows.withColumn("next_text", F.lead("text").over(inside))
        .withColumn("next_print", F.lead("print").over(inside))
        .withColumn("place", F.row_number().over(inside))
    )
    border = F.col("next_text").isNull() | (F.col("place") == 1)
    # Written once; a bucket's first and last rows keep their texts, to meet across buckets.
    found = written(
        _compared(rows, bits).select(
            "doc_id", F.length("text").cast("long").alias("n_chars"), "edited_sha256", "print", "edited_print", "next_print",
            "bucket", "place", F.when(border, F.col("text")).alias("text"), F.col("next_text").isNull().alias("last"),
        ),
        "prints",
    )
    heads = found.where("place = 1").select(F.col("bucket").alias("head"), F.col("text").alias("next_text"), F.col("print").alias("next_print"))
    follow = followed(heads.select(F.col("head").alias("bucket")))
    lasts = found.where("last").drop("next_print", "edited_sha256", "edited_print").join(follow, "bucket").join(heads, "head")
    columns = ["doc_id", "n_chars", "edited_sha256", "print", "edited_print", "next_print"]
    out = found.where("not last").select(columns).unionAll(_compared(lasts, bits).select(columns))
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
