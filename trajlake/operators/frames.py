"""Frames over time: thinning, gap filling, overlapping windows, projection to pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions.clock import MICROS, floor_div, from_micros, micros
from trajlake.functions.geometry import pixel, view_point
from trajlake.operators.refractory import spaced_instants
from trajlake.operators.scans import expand_steps, last_known, with_bucket

DEFAULT_FPS = 30.0
CHUNK_SECONDS = 2.0


def thin_grid(traj: DataFrame, fps: float = DEFAULT_FPS) -> DataFrame:
    """The first frame of every 1/fps slot, with all its rows."""
    if float(fps).is_integer():
        slot = floor_div(micros("timestamp") * F.lit(int(fps)), MICROS)
    else:
        slot = floor_div(micros("timestamp"), round(MICROS / fps))
    kept = traj.groupBy(slot.alias("_slot")).agg(F.min("timestamp").alias("timestamp"))
    return traj.join(kept.select("timestamp"), "timestamp", "left_semi")


def thin_greedy(traj: DataFrame, fps: float = DEFAULT_FPS) -> DataFrame:
    """Frames at least 1/fps after the last frame that was kept, with all their rows."""
    kept = spaced_instants(traj, [], "timestamp", 1.0 / fps)
    return traj.join(kept, "timestamp", "left_semi")


def gap_fill(
    rows: DataFrame,
    key: str,
    seq: str,
    columns: list[str],
    targets: DataFrame | None = None,
    *,
    width: int = 4096,
) -> DataFrame:
    """Every number from the first good one to the target, gaps filled by the one before.

    ``targets`` gives ``key`` and ``target`` (numbers 0 .. target - 1); without it the last
    number of each key is the end. Adds ``is_duplicate``.
    """
    ends = rows.groupBy(key).agg(F.min(seq).alias("_first"), (F.max(seq) + 1).alias("_end"))
    if targets is not None:
        ends = ends.join(targets, key).withColumn("_end", F.col("target")).drop("target")
    numbers = expand_steps(
        ends.withColumn("_count", (F.col("_end") - F.col("_first")).cast("bigint")), "_count", "_i", width
    ).select(key, (F.col("_first") + F.col("_i")).alias(seq))
    good = rows.select(key, seq, F.struct(*columns).alias("_row"))
    joined = with_bucket(numbers.join(good, [key, seq], "left"), seq, width)
    filled = last_known(joined, [key], [seq], "_row", "_filled")
    return filled.select(
        key, seq, *[F.col(f"_filled.{c}").alias(c) for c in columns], F.col("_row").isNull().alias("is_duplicate")
    )


def overlap_windows(
    rows: DataFrame, video: str, time: str, *, chunk: float = CHUNK_SECONDS, overlap: float = 0.0
) -> DataFrame:
    """Rows with every chunk of their video they fall in: chunk length, overlap to the next one."""
    if not 0 <= overlap < chunk:
        raise ValueError("the overlap must be shorter than the chunk")
    length, stride = round(chunk * MICROS), round((chunk - overlap) * MICROS)
    starts = rows.groupBy(video).agg(F.min(time).alias("_start"))
    offset = micros(time) - micros("_start")
    last = floor_div(offset, stride)
    first = F.greatest(F.lit(0).cast("bigint"), floor_div(offset - F.lit(length), stride) + 1)
    return (
        rows.join(starts, video)
        .withColumn("chunk_no", F.explode(F.sequence(first, last)))
        .withColumn("chunk_start", from_micros(micros("_start") + F.col("chunk_no") * stride))
        .drop("_start")
    )


def project_pixels(
    traj: DataFrame, view, projection, *, width: int = 720, height: int = 480, scale: float = 1.0
) -> DataFrame:
    """Add ``px`` and ``py``; rows behind the camera are dropped."""
    vx, vy, vz = view_point(view)
    seen = traj.withColumn("_vx", vx).withColumn("_vy", vy).withColumn("_vz", vz).where(F.col("_vz") < 0)
    px, py = pixel([F.col("_vx"), F.col("_vy"), F.col("_vz")], projection, width, height, scale)
    return seen.withColumn("px", px).withColumn("py", py).drop("_vx", "_vy", "_vz")


def duplicates_per_key(filled: DataFrame, key: str) -> DataFrame:
    return filled.groupBy(key).agg(
        F.count("*").alias("frames"), F.count_if(F.col("is_duplicate")).alias("duplicates")
    )


