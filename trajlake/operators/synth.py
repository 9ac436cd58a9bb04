"""Load-test data: synthetic trajectories, object grids, time grids and probe sets.

Every generator takes a table of specifications, one row per object or series, and expands it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.clock import MICROS, cut_ms, from_micros, micros
from trajlake.functions.ids import objid_from_number
from trajlake.operators.scans import expand_steps, ordinal

# Instants are numbered in buckets of so many seconds.
NUMBERING_SECONDS = 3600

# Fixed values of the number mixer: multipliers and modulus.
_MIX = (1103515245, 12345, 104729, 2147483647)


def _uniform(number: Column, salt: int, seed: int) -> Column:
    """A repeatable number from 0 up to 1, made from a whole number."""
    by, axis_by, seed_by, mod = _MIX
    mixed = F.pmod(F.pmod(number, F.lit(1_000_000_000)) * F.lit(by) + F.lit(salt * axis_by + seed * seed_by), F.lit(mod))
    again = F.pmod(mixed * F.lit(48271), F.lit(mod))
    return again.cast("double") / F.lit(float(mod))


def synth_trajectory(
    specs: DataFrame,
    *,
    seed: int = 42,
    bounds: tuple[float, float] = (0.0, 1000.0),
    step_units: float = 12.0,
) -> DataFrame:
    """Objects moving steadily inside a box and reflected at its sides.

    ``specs`` has ``number``, ``start_ts``, ``duration_s`` and ``hz``. Positions are closed
    formulas of the step, so any step is made without the ones before it.
    """
    lo, hi = bounds
    side = hi - lo
    steps = specs.withColumn("_count", F.rint(F.col("duration_s") * F.col("hz")).cast("bigint"))
    rows = expand_steps(steps, "_count", "_i")
    at = micros("start_ts") + F.rint(F.col("_i") * F.lit(float(MICROS)) / F.col("hz")).cast("bigint")

    def axis(k: int) -> Column:
        begin = _uniform(F.col("number"), 2 * k + 1, seed) * F.lit(side)
        move = (_uniform(F.col("number"), 2 * k + 2, seed) * F.lit(2.0) - F.lit(1.0)) * F.lit(step_units)
        way = begin + move * F.col("_i").cast("double")
        lap = way - F.floor(way / F.lit(2.0 * side)).cast("double") * F.lit(2.0 * side)
        return F.lit(lo) + F.when(lap <= side, lap).otherwise(F.lit(2.0 * side) - lap)

    return rows.select(
        from_micros(at).alias("timestamp"),
        objid_from_number("number").alias("objid"),
        *[axis(k).alias(name) for k, name in enumerate(("x", "y", "z"))],
    )


def calibration_grid(
    objects: DataFrame,
    *,
    duration_s: float = 10.0,
    interval_s: float = 0.2,
    y: float = 0.0,
    x_range: tuple[float, float] = (0.0, 1000.0),
    z_range: tuple[float, float] = (0.0, 1000.0),
) -> DataFrame:
    """Static objects on a square grid, row by row, at regular instants.

    ``objects`` has ``number`` from 1 up, ``grid_size`` and ``start_ts``.
    """
    steps = int(round(duration_s / interval_s)) + 1
    place = F.col("number") - 1
    size = F.col("grid_size")

    def line(index: Column, lo: float, hi: float) -> Column:
        spread = F.lit(lo) + F.try_divide(F.lit(hi - lo), (size - 1).cast("double")) * index.cast("double")
        return F.when(size > 1, spread).otherwise(F.lit((lo + hi) * 0.5))

    column = F.pmod(place, size)
    row = F.call_function("div", place - column, size)
    rows = expand_steps(objects.withColumn("_count", F.lit(steps).cast("bigint")), "_count", "_i")
    at = micros("start_ts") + F.rint(F.col("_i") * F.lit(interval_s * MICROS)).cast("bigint")
    return rows.select(
        from_micros(at).alias("timestamp"),
        objid_from_number("number").alias("objid"),
        F.round(line(column, *x_range), 1).alias("x"),
        F.lit(round(float(y), 1)).alias("y"),
        F.round(line(row, *z_range), 1).alias("z"),
    )


def time_grid(specs: DataFrame, *, interval_s: float = 0.2) -> DataFrame:
    """``steps`` regular instants from ``start_ts`` for every row of ``specs``."""
    rows = expand_steps(specs, "steps", "step")
    at = micros("start_ts") + F.rint(F.col("step") * F.lit(interval_s * MICROS)).cast("bigint")
    return rows.withColumn("timestamp", from_micros(at))


def probe_sets(
    ranges: DataFrame, *, queries: str = "n_queries", fps: float = 60.0, slider_s: float = 0.1
) -> DataFrame:
    """Forward and backward play and slider probes over each row's range, cut to milliseconds."""
    patterns = (
        ("play_forward", 1.0 / fps, 1),
        ("play_backward", 1.0 / fps, -1),
        ("slider_forward", slider_s, 1),
        ("slider_backward", slider_s, -1),
    )
    rows = expand_steps(ranges, queries, "query_id")
    probes = F.array(
        *[
            F.struct(
                F.lit(name).alias("pattern"),
                cut_ms(
                    (micros("start_ts") if sign > 0 else micros("end_ts"))
                    + F.lit(sign) * F.col("query_id") * F.lit(round(step * MICROS))
                ).alias("probe"),
            )
            for name, step, sign in patterns
        ]
    )
    return rows.withColumn("_p", F.explode(probes)).select("*", "_p.pattern", "_p.probe").drop("_p")


def random_probes(instants: DataFrame, queries: DataFrame, *, time: str = "timestamp", offset_s: float = 0.5, seed: int = 42) -> DataFrame:
    """For each ``query_id`` a recorded instant, moved by up to ``offset_s`` either way and cut to milliseconds.

    Instants are numbered, so a query finds its own by an equality join. Repeatable for a seed.
    """
    recorded = instants.select(F.col(time).alias("_t")).where("_t is not null").distinct().withColumn("_m", micros("_t"))
    placed = ordinal(recorded, [], "_m", NUMBERING_SECONDS * MICROS, [], "_place").select("_m", "_place")
    share = _uniform(F.col("query_id"), 1, seed)
    asked = queries.withColumn("_place", F.floor(share * recorded.agg(F.count("*")).scalar()))
    offset = F.rint((_uniform(F.col("query_id"), 2, seed) * 2.0 - 1.0) * F.lit(offset_s * MICROS)).cast("bigint")
    found = asked.join(placed, "_place").withColumn("pattern", F.lit("random_jump")).withColumn("probe", cut_ms(F.col("_m") + offset))
    return found.drop("_m", "_place")
