"""Speed, stalls, wall proximity, bearings and collision labels per object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions.clock import MICROS, micros
from trajlake.functions.geometry import heading
from trajlake.operators.labelling import collision_rows
from trajlake.operators.scans import BUCKET, neighbour_row, streak_lengths, with_time_bucket
from trajlake.session import written

# The share of the expected progress below which an object is stuck, how many
# rows in a row it takes, the limits of a time step in seconds, and the label cooldown.
STUCK_RATIO = 0.3
STUCK_ROWS = 5
STEP_MIN = 1.0 / 240.0
STEP_MAX = 0.1
WALL_ROWS = 5
LABEL_COOLDOWN = 0.5
DEFAULT_SPEED = 120.0
BUCKET_SECONDS = 3600


def object_speed(traj: DataFrame, *, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Add ``dt``, ``displacement`` and ``speed`` since the previous row of the object."""
    steps = neighbour_row(
        with_time_bucket(traj, "timestamp", bucket_seconds), ["objid"], "timestamp", ["x", "y", "z"], "_prev"
    )
    dx, dy, dz = (F.col(a) - F.col(f"_prev.{a}") for a in ("x", "y", "z"))
    dt = (micros("timestamp") - micros("_prev.timestamp")) / F.lit(float(MICROS))
    moved = F.sqrt(dx * dx + dy * dy + dz * dz)
    return (
        steps.withColumn("dt", dt)
        .withColumn("displacement", moved)
        .withColumn("speed", F.when(F.col("dt") > 0, F.col("displacement") / F.col("dt")))
        .drop("_prev", BUCKET)
    )


def stuck_flags(
    traj: DataFrame,
    *,
    speed: float = DEFAULT_SPEED,
    ratio: float = STUCK_RATIO,
    step_max: float = STEP_MAX,
    headings: tuple[str, str, str] | None = None,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Add ``stuck``: progress since the previous row fell short of the expected share.

    Progress is the way along the heading columns where they are given, else the way moved. The
    first row of an object is not judged and counts as not stuck.
    """
    steps = neighbour_row(
        with_time_bucket(traj, "timestamp", bucket_seconds), ["objid"], "timestamp", ["x", "y", "z"], "_prev"
    )
    delta = [F.col(a) - F.col(f"_prev.{a}") for a in ("x", "y", "z")]
    if headings:
        way = sum((d * F.col(h) for d, h in zip(delta, headings, strict=True)), F.lit(0.0))
    else:
        way = F.sqrt(delta[0] * delta[0] + delta[1] * delta[1] + delta[2] * delta[2])
    dt = (micros("timestamp") - micros("_prev.timestamp")) / F.lit(float(MICROS))
    dt = F.greatest(F.lit(STEP_MIN), F.least(F.lit(float(step_max)), dt))
    short = way < F.lit(float(speed)) * dt * F.lit(float(ratio))
    return steps.withColumn("stuck", F.coalesce(short, F.lit(False))).drop("_prev")


def stall_runs(traj: DataFrame, *, bucket_seconds: int = BUCKET_SECONDS, **rule) -> DataFrame:
    """Add ``run``: how many rows in a row the object has been stuck."""
    flagged = stuck_flags(traj, bucket_seconds=bucket_seconds, **rule)
    return streak_lengths(flagged, ["objid"], "timestamp", {"stuck": "run"})


def stalls(traj: DataFrame, *, rows: int = STUCK_ROWS, **rule) -> DataFrame:
    """The row at which each stall reaches ``rows`` stuck rows in a row."""
    return stall_runs(traj, **rule).where(F.col("run") == rows).drop("run", "stuck", BUCKET)


def _facts(box: DataFrame):
    """The one row of a box as a struct-valued scalar subquery, computed once."""
    return box.select(F.struct("*")).scalar()


def near_flags(rows: DataFrame, box: DataFrame, *, margin: float | None = None, y_up: bool = True) -> DataFrame:
    """Add ``wall_distance`` and ``near``: it is below the margin."""
    facts = _facts(box)

    def gap(axis: str):
        return facts[f"half_{axis}"] - F.abs(F.col(axis) - facts[f"center_{axis}"])

    limit = F.lit(float(margin)) if margin is not None else facts["wall_margin"]
    nearest = F.least(gap("x"), gap("z" if y_up else "y"))
    close = (limit > 0) & F.coalesce(F.col("wall_distance") < limit, F.lit(False))
    return rows.withColumn("wall_distance", nearest).withColumn("near", close)


def wall_runs(
    traj: DataFrame, box: DataFrame, *, bucket_seconds: int = BUCKET_SECONDS, **rule
) -> DataFrame:
    """Add ``wall_distance`` and ``run``: how many rows in a row it stayed below the margin."""
    flagged = near_flags(with_time_bucket(traj, "timestamp", bucket_seconds), box, **rule)
    return streak_lengths(flagged, ["objid"], "timestamp", {"near": "run"})


def wall_hugs(traj: DataFrame, box: DataFrame, *, rows: int = WALL_ROWS, **rule) -> DataFrame:
    """The row at which an object has been close to a wall for ``rows`` rows in a row."""
    return wall_runs(traj, box, **rule).where(F.col("run") == rows).drop("run", "near", BUCKET)


def headings_to_center(traj: DataFrame, box: DataFrame, *, y_up: bool = True) -> DataFrame:
    """Bearing of every row toward the box centre in the horizontal plane."""
    a, b = ("x", "z") if y_up else ("x", "y")
    facts = _facts(box)
    first, second = heading(facts[f"center_{a}"] - F.col(a), facts[f"center_{b}"] - F.col(b))
    return traj.withColumn("heading_a", first).withColumn("heading_b", second)


def headings_away(pairs: DataFrame, traj: DataFrame, *, horizontal=("x", "z")) -> DataFrame:
    """For each contact the bearing of ``a`` away from ``b``; ``b`` leaves the opposite way."""
    u, v = horizontal
    side = traj.select("timestamp", "objid", F.col(u).alias("_u"), F.col(v).alias("_v"))

    def of(name: str) -> DataFrame:
        return side.select(
            "timestamp",
            F.col("objid").alias(name),
            F.col("_u").alias(f"_u_{name}"),
            F.col("_v").alias(f"_v_{name}"),
        )

    joined = pairs.join(of("a"), ["timestamp", "a"]).join(of("b"), ["timestamp", "b"])
    first, second = heading(F.col("_u_a") - F.col("_u_b"), F.col("_v_a") - F.col("_v_b"))
    return joined.select(
        *pairs.columns, first.alias("heading_a"), second.alias("heading_b")
    )


def collision_labels(
    traj: DataFrame,
    box: DataFrame,
    *,
    stuck_rows: int = STUCK_ROWS,
    wall_rows: int = WALL_ROWS,
    cooldown: float = LABEL_COOLDOWN,
    stall_rule: dict | None = None,
    wall_rule: dict | None = None,
) -> DataFrame:
    """Label rows ``stuck`` and ``wall``: counters begin anew after each label, see ``labelling``.

    A row that is both counts as stuck, because that is looked at first.
    """
    flagged = near_flags(stuck_flags(traj, **(stall_rule or {})), box, **(wall_rule or {}))
    flagged = written(flagged.select("timestamp", "objid", "x", "y", "z", "stuck", "near"), "flagged")
    labels = collision_rows(flagged, stuck_rows=stuck_rows, wall_rows=wall_rows, cooldown=cooldown)
    return flagged.drop("stuck", "near").join(labels, ["objid", "timestamp"]).select("timestamp", "objid", "x", "y", "z", "kind")
