"""Replay: ticks, resampling, the next event, clips around events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions.clock import (
    MICROS,
    MIN_TICK_SECONDS,
    floor_div,
    from_micros,
    micros,
    playback_speed,
    seek_clamp,
)
from trajlake.operators.asof import asof_frame, frame_times
from trajlake.operators.scans import BUCKET, expand_steps, neighbour_row, with_bucket

EVENT_SECONDS = 1.0


def playback_ticks(ranges: DataFrame, *, update_seconds: float, speed: str = "speed") -> DataFrame:
    """Instants a replay shows for each row with ``start_ts``, ``end_ts`` and a speed.

    Updates add up until they amount to 0.1 s of data, then one tick is shown. Forward replay
    starts at the beginning, backward replay at the end; the last tick is the edge itself.
    """
    s = playback_speed(speed)
    update = F.lit(float(update_seconds)) * F.abs(s) * F.lit(float(MICROS))
    updates = F.ceil(F.lit(MIN_TICK_SECONDS * MICROS) / update)
    span = micros("end_ts") - micros("start_ts")
    sized = (
        ranges.withColumn("_step", F.rint(updates * update).cast("bigint"))
        .withColumn("_forward", s > 0)
        .withColumn("_count", F.greatest(F.lit(1), F.ceil(span / F.col("_step"))).cast("bigint"))
    )
    moved = (F.col("tick") + 1) * F.col("_step")
    forward = F.least(micros("start_ts") + moved, micros("end_ts"))
    backward = F.greatest(micros("end_ts") - moved, micros("start_ts"))
    return (
        expand_steps(sized, "_count", "tick")
        .withColumn("tick_ts", from_micros(F.when(F.col("_forward"), forward).otherwise(backward)))
        .drop("_step", "_forward", "_count")
    )


def resample(traj: DataFrame, ranges: DataFrame, *, update_seconds: float, speed: str = "speed") -> DataFrame:
    """The frame shown at every tick of a replay."""
    ticks = playback_ticks(ranges, update_seconds=update_seconds, speed=speed)
    return asof_frame(traj, ticks, "tick_ts")


def next_event(events: DataFrame, ordinal: str = "ordinal", time: str = "timestamp", *, width: int = 65536) -> DataFrame:
    """Add ``next_ts``: the time of the following list entry; after the last one, of the first."""
    first = events.agg(F.min_by(time, ordinal)).scalar()
    with_next = neighbour_row(with_bucket(events, ordinal, width), [], ordinal, [time], "_next", forward=True)
    return with_next.withColumn("next_ts", F.coalesce(F.col(f"_next.{time}"), first)).drop("_next", BUCKET)


def event_clips(
    traj: DataFrame,
    events: DataFrame,
    *,
    time: str = "event_ts",
    ordinal: str = "ordinal",
    seconds: float = EVENT_SECONDS,
    stop_at_end: bool = False,
) -> DataFrame:
    """Rows of ``[event, event + seconds)`` for every event, clamped to the range of the data.

    Events meet distinct frame instants first, over time buckets, and only the matching instants
    then meet the rows, on the instant itself. With ``stop_at_end`` the replay is over once a
    clip runs into the end of the data: events listed after it are dropped.
    """
    length = round(seconds * MICROS)
    width = max(MICROS, length)
    times = frame_times(traj)
    start, end = times.agg(F.min("frame_ts")).scalar(), times.agg(F.max("frame_ts")).scalar()
    clips = events.withColumn("clip_start", seek_clamp(time, start, end)).withColumn(
        "_from", micros("clip_start")
    )
    if stop_at_end:
        over = clips.where(F.col("_from") + F.lit(length) >= micros(end)).agg(F.min(ordinal)).scalar()
        clips = clips.where(over.isNull() | (F.col(ordinal) <= over))
    spans = F.sequence(
        floor_div("_from", width), floor_div(F.col("_from") + F.lit(length - 1), width)
    )
    by_bucket = clips.withColumn(BUCKET, F.explode(spans))
    instants = times.withColumn("_t", micros("frame_ts")).withColumn(BUCKET, floor_div("_t", width))
    shown = (
        by_bucket.join(instants, BUCKET)
        .where((F.col("_t") >= F.col("_from")) & (F.col("_t") < F.col("_from") + F.lit(length)))
        .drop(BUCKET, "_t", "_from")
    )
    rows = traj.select(F.col("timestamp").alias("frame_ts"), "objid", "x", "y", "z")
    return shown.join(rows.withColumnRenamed("objid", "shown_objid"), "frame_ts")
