"""Ordered scans that never hold one key in one task.

A plain ``Window.partitionBy(key).orderBy(time)`` puts all rows of a key into one task, which fails
when one object holds a third of a large table. Here every scan works inside ``(key, bucket)``,
where a bucket is a fixed stretch of the order column, and takes what it needs from earlier
buckets out of a summary with one row per ``(key, bucket)``. A bucket holds at most as many rows
as it has distinct order values, and a key at most span / width summary rows, whatever the number
of rows. The order column is a BIGINT or a timestamp. Keys must not be null; readers leave such
rows out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.clock import MICROS, floor_div, micros

BUCKET = "_bucket"
DEFAULT_SECONDS = 600
# Buckets that make up one group when there is no key to spread a summary by.
GROUP = 4096


def with_time_bucket(df: DataFrame, time: str, seconds: int = DEFAULT_SECONDS) -> DataFrame:
    return df.withColumn(BUCKET, floor_div(micros(time), seconds * MICROS))


def with_bucket(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(BUCKET, floor_div(F.col(order).cast("bigint"), width))


def _placed(bucketed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with keys and bucket. Said once and up front, the same condition reaches every use of
    the rows, so that their shuffle is recognised as one."""
    cond = F.col(BUCKET).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return bucketed.where(cond)


def _attach(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join of the per-bucket summary, which has a row for every bucket. Being an inner join it
    asks the same of both inputs, so a shuffle they share is written once."""
    return rows.join(carry, [*keys, BUCKET])


def next_bucket(edges: DataFrame, keys: Sequence[str], *, forward: bool, name: str) -> DataFrame:
    """Add ``name``: the following bucket of the key (the preceding one with ``forward`` off).

    Without keys the buckets are taken group by group, and only groups are put in one order.
    """
    step, nearest = (F.lead, F.min) if forward else (F.lag, F.max)
    if keys:
        return edges.withColumn(name, step(BUCKET).over(Window.partitionBy(*keys).orderBy(BUCKET)))
    grouped = edges.withColumn("_group", floor_div(BUCKET, GROUP))
    groups = grouped.groupBy("_group").agg(nearest(BUCKET).alias("_edge"))
    all_groups = Window.partitionBy(F.lit(0)).orderBy("_group")
    beyond = groups.select("_group", step("_edge").over(all_groups).alias("_beyond"))
    inside = step(BUCKET).over(Window.partitionBy("_group").orderBy(BUCKET))
    return (
        grouped.withColumn("_inside", inside)
        .join(beyond, "_group")
        .withColumn(name, F.coalesce("_inside", "_beyond"))
        .drop("_group", "_inside", "_beyond")
    )


def latest_before(buckets: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the latest non-null ``value`` among earlier buckets of the key.

    Without keys the buckets are taken group by group, and only groups are put in one order.
    """
    if keys:
        before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        return buckets.withColumn(name, F.last(value, ignorenulls=True).over(before))
    grouped = buckets.withColumn("_group", floor_div(BUCKET, GROUP))
    newest = F.max(F.when(F.col(value).isNotNull(), F.struct(BUCKET, F.col(value).alias("_v"))))
    groups = grouped.groupBy("_group").agg(newest["_v"].alias("_newest"))
    earlier = (Window.unboundedPreceding, -1)
    all_groups = Window.partitionBy(F.lit(0)).orderBy("_group").rowsBetween(*earlier)
    beyond = groups.select("_group", F.last("_newest", ignorenulls=True).over(all_groups).alias("_beyond"))
    own_group = Window.partitionBy("_group").orderBy(BUCKET).rowsBetween(*earlier)
    return (
        grouped.withColumn("_inside", F.last(value, ignorenulls=True).over(own_group))
        .join(beyond, "_group")
        .withColumn(name, F.coalesce("_inside", "_beyond"))
        .drop("_group", "_inside", "_beyond")
    )


def neighbour_row(
    bucketed: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    name: str,
    *,
    forward: bool = False,
) -> DataFrame:
    """Add struct ``name``: ``columns`` of the previous (or next) row of the same key.

    The last (first) row of each bucket is repeated in the following (preceding) bucket of its key
    as a guest, so one window finds all neighbours; guests leave afterwards. The result stays
    partitioned and sorted for a further scan over the same buckets.
    """
    bucketed = _placed(bucketed, keys)
    fields = [order, *[c for c in columns if c != order]]
    # Field by field: flat buffers merge in a hash aggregate on the map side, whereas a struct
    # would have to be sorted.
    outer, pick = (F.min, F.min_by) if forward else (F.max, F.max_by)
    edges = bucketed.groupBy(*keys, BUCKET).agg(
        outer(order).alias(order), *[pick(c, order).alias(c) for c in fields[1:]]
    )
    guests = (
        next_bucket(edges, keys, forward=not forward, name="_to")
        .withColumn(BUCKET, F.col("_to"))
        .drop("_to")
        .where(F.col(BUCKET).isNotNull())
        .withColumn("_guest", F.lit(True))
    )
    together = bucketed.withColumn("_guest", F.lit(False)).unionByName(guests, allowMissingColumns=True)
    part = Window.partitionBy(*keys, BUCKET).orderBy(order)
    step = F.lead if forward else F.lag
    return (
        together.withColumn(name, step(F.struct(*fields)).over(part))
        .where(~F.col("_guest"))
        .drop("_guest")
    )


def streak_lengths(
    bucketed: DataFrame, keys: Sequence[str], order: str, flags: Mapping[str, str]
) -> DataFrame:
    """Add for each flag column, under the name it maps to, how many rows in a row, up to and
    with this one, have it set. All flags share one window pass."""
    part = Window.partitionBy(*keys, BUCKET).orderBy(order)
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    before = (
        Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = _placed(bucketed, keys).withColumn("_rn", F.row_number().over(part)).withColumns(
        {f"_break_{f}": F.max(F.when(~F.col(f), F.col("_rn"))).over(upto) for f in flags}
    )
    # Per bucket: its rows and the place of each flag's last break, hence the streak it hands on.
    per_bucket = ranked.groupBy(*keys, BUCKET).agg(
        F.count("*").alias("_n"), *[F.max(f"_break_{f}").alias(f"_last_{f}") for f in flags]
    )
    counted = per_bucket.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carry = counted.select(
        *keys,
        BUCKET,
        *[
            (
                F.col("_before")
                - F.coalesce(F.max(F.col("_before") + F.col(f"_last_{f}")).over(before), F.lit(0))
            ).alias(f"_carry_{f}")
            for f in flags
        ],
    )
    lengths = {
        name: F.when(F.col(f"_break_{f}").isNotNull(), F.col("_rn") - F.col(f"_break_{f}")).otherwise(
            F.col("_rn") + F.coalesce(f"_carry_{f}", F.lit(0))
        )
        for f, name in flags.items()
    }
    spare = [f"_{kind}_{f}" for kind in ("break", "carry") for f in flags]
    return _attach(ranked, carry, keys).withColumns(lengths).drop("_rn", *spare)


def last_known(
    bucketed: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add ``name``: the latest non-null ``value`` of the key at or before this row.

    ``order`` lists the order column and any tie-breaking columns.
    """
    part = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    bucketed = _placed(bucketed, keys)
    latest = F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v"))))
    buckets = bucketed.groupBy(*keys, BUCKET).agg(latest["_v"].alias("_last"))
    carry = latest_before(buckets, keys, "_last", "_carry").drop("_last")
    own = bucketed.withColumn("_own", F.last(value, ignorenulls=True).over(part))
    return (
        _attach(own, carry, keys)
        .withColumn(name, F.coalesce("_own", "_carry"))
        .drop("_own", "_carry")
    )


def ordinal(
    df: DataFrame, keys: Sequence[str], order: str, width: int, tie: Sequence[str], name: str
) -> DataFrame:
    """Add ``name``: 0-based place of the row within its key, counted by ``order`` then ``tie``.

    Rows are gathered per ``(keys, bucket)``. Sizes and rows come from the same shuffle, so the
    input is computed once.
    """
    rest = [c for c in df.columns if c not in {*keys, order, *tie}]
    gathered = (
        with_bucket(df, order, width)
        .groupBy(*keys, BUCKET)
        .agg(F.array_sort(F.collect_list(F.struct(order, *tie, *rest))).alias("_rows"))
    )
    before = (
        Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = gathered.select(*keys, BUCKET, F.size("_rows").alias("_n")).select(
        *keys, BUCKET, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    placed = gathered.join(offsets, [*keys, BUCKET]).select(
        *keys, "_before", F.posexplode("_rows").alias("_at", "_row")
    )
    return placed.select(
        *keys,
        *[F.col(f"_row.`{c}`").alias(c) for c in (order, *tie, *rest)],
        (F.col("_before") + F.col("_at")).cast("bigint").alias(name),
    )


def expand_steps(df: DataFrame, count: str, name: str, block: int = 4096) -> DataFrame:
    """One row per step 0 .. ``count`` - 1 of each input row, in blocks spread over the cluster.

    Steps come in blocks and blocks in groups of as many, so even a series of a trillion steps
    never makes a long list in one row; the shuffle of the blocks hands it to many tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last_step = F.col(count).cast("bigint") - 1
    zero = F.lit(0).cast("bigint")

    def within(group: str, last: Column) -> Column:
        first = F.col(group) * F.lit(block)
        return F.explode_outer(F.sequence(first, F.least(first + F.lit(block - 1), last)))

    groups = df.where(F.col(count) > 0).withColumn(
        "_blocks", F.explode_outer(F.sequence(zero, floor_div(last_step, block * block)))
    )
    blocks = groups.withColumn("_block", within("_blocks", floor_div(last_step, block))).drop("_blocks")
    spread = blocks.repartition(parts, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], "_block"))
    return spread.withColumn(name, within("_block", last_step)).drop("_block")
