"""What was where at an instant: floor lookup of whole frames, for any number of probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.clock import MICROS, floor_div, micros, trunc_ms
from trajlake.operators.scans import BUCKET, last_known, latest_before, with_bucket
from trajlake.session import written

DEFAULT_BUCKET_SECONDS = 60


def last_wins(rows: DataFrame, seq: str) -> DataFrame:
    """One position per instant and object: the one that came last by ``seq``.

    ``max_by`` merges on the map side, so repeated rows of a hot key shrink before the shuffle.
    One call per axis keeps flat buffers and with them the hash aggregate; ``seq`` is unique
    within a key, so all three take the same row.
    """
    return rows.groupBy("timestamp", "objid").agg(*[F.max_by(a, seq).alias(a) for a in ("x", "y", "z")])


def frame_times(traj: DataFrame, time: str = "timestamp") -> DataFrame:
    return traj.select(F.col(time).alias("frame_ts")).distinct()


def floor_times(
    times: DataFrame, probes: DataFrame, *, bucket_seconds: int = DEFAULT_BUCKET_SECONDS
) -> DataFrame:
    """For each distinct ``probe_ts`` the greatest ``frame_ts`` not after it, else the first one.

    Both sides shrink to distinct instants first, so a bucket holds at most as many rows as it
    has instants; these are written once, as they are read several times. Inside a bucket a window carries the last
    frame forward; a probe with no earlier frame in its bucket takes the carry-in, the latest frame of any earlier
    bucket, from a table with one row per bucket.
    """
    width = bucket_seconds * MICROS
    marks = (
        times.select(F.col("frame_ts").alias("_t"), F.col("frame_ts").alias("_frame"), F.lit(0).alias("_kind"))
        .unionByName(
            probes.select(F.col("probe_ts").alias("_t"))
            .distinct()
            .select("_t", F.lit(None).cast("timestamp_ntz").alias("_frame"), F.lit(1).alias("_kind"))
        )
        .withColumn(BUCKET, floor_div(micros("_t"), width))
    )
    marks = written(marks, "instants")
    per_bucket = marks.groupBy(BUCKET).agg(
        F.max("_frame").alias("_max"), F.min("_frame").alias("_min")
    )
    carry = latest_before(per_bucket, [], "_max", "_carry").select(BUCKET, "_carry")
    first = per_bucket.agg(F.min("_min")).scalar()
    inside = (
        Window.partitionBy(BUCKET)
        .orderBy("_t", "_kind")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        marks.withColumn("_seen", F.last("_frame", ignorenulls=True).over(inside))
        .where(F.col("_kind") == 1)
        .join(carry, BUCKET)
        .select(
            F.col("_t").alias("probe_ts"), F.coalesce("_seen", "_carry", first).alias("frame_ts")
        )
    )


def with_frame(
    traj_times: DataFrame, probes: DataFrame, time: str, *, bucket_seconds: int = DEFAULT_BUCKET_SECONDS
) -> DataFrame:
    """Add ``frame_ts`` to every probe row; the probe instant is cut to milliseconds first."""
    cut = probes.withColumn("probe_ts", trunc_ms(time))
    found = floor_times(traj_times, cut.select("probe_ts"), bucket_seconds=bucket_seconds)
    return cut.join(found, "probe_ts").drop("probe_ts")


def asof_frame(
    traj: DataFrame,
    probes: DataFrame,
    time: str = "probe",
    *,
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Every probe with all rows of its frame. Objects absent from that frame stay absent."""
    found = with_frame(frame_times(traj), probes, time, bucket_seconds=bucket_seconds)
    return found.join(traj.withColumnRenamed("timestamp", "frame_ts"), "frame_ts")


def asof_position(
    traj: DataFrame,
    probes: DataFrame,
    time: str = "probe",
    objid: str = "objid",
    *,
    how: str = "inner",
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Every probe with the position its own object has in its frame."""
    found = with_frame(frame_times(traj), probes, time, bucket_seconds=bucket_seconds)
    side = traj.withColumnRenamed("timestamp", "frame_ts").withColumnRenamed("objid", objid)
    return found.join(side, ["frame_ts", objid], how)


def last_exact_hit(
    traj_times: DataFrame, probes: DataFrame, ordinal: str, time: str, *, width: int = 65536
) -> DataFrame:
    """Add ``hit_ts``: the latest probe, in probe order, that lay exactly on a frame; else null."""
    cut = probes.withColumn("_probe", trunc_ms(time))
    hits = traj_times.select(F.col("frame_ts").alias("_probe"), F.col("frame_ts").alias("_hit"))
    marked = with_bucket(cut.join(hits, "_probe", "left"), ordinal, width)
    return last_known(marked, [], [ordinal], "_hit", "hit_ts").drop("_hit", "_probe", BUCKET)


def agreement_rate(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Share of keys for which two answer tables agree, nulls counting as equal to each other."""
    pairs = left.select(key, F.col(value).alias("_a")).join(
        right.select(key, F.col(value).alias("_b")), key
    )
    same = F.col("_a").eqNullSafe(F.col("_b")).cast("double")
    return pairs.agg(F.count("*").alias("n_queries"), F.avg(same).alias("correctness_rate"))
