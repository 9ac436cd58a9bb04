"""Facts about a trajectory table: ranges, frames, objects, chunks, bounding box and walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.clock import chunk_index, chunk_key, format_ts, instant

AXES = ("x", "y", "z")

# Smallest room height, the box used without data, the share of the smaller
# horizontal side that counts as close to a wall, and contact distance per object radius.
MIN_HEIGHT = 3.0
DEFAULT_BOX = {"across": 5.0, "height": 3.0}
WALL_SHARE = 0.05
CONTACT_PER_RADIUS = 2.2
WALLS = ("Floor", "North", "South", "East", "West")


def coord_range(traj: DataFrame) -> DataFrame:
    return traj.agg(
        *[F.min(a).alias(f"min_{a}") for a in AXES], *[F.max(a).alias(f"max_{a}") for a in AXES]
    )


def time_bounds(traj: DataFrame) -> DataFrame:
    return traj.agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"))


def object_ids(traj: DataFrame) -> DataFrame:
    return traj.where(F.col("objid") != "").select("objid").distinct().orderBy("objid")


def frame_list(traj: DataFrame) -> DataFrame:
    return traj.select("timestamp").distinct().orderBy("timestamp")


def first_frame(traj: DataFrame) -> DataFrame:
    """Rows of the earliest frame; the bound is a scalar subquery the scan can filter by."""
    return traj.where(F.col("timestamp") == traj.agg(F.min("timestamp")).scalar())


def object_counts(traj: DataFrame) -> DataFrame:
    """Rows, distinct objects and the objects of the first frame."""
    per_object = traj.groupBy("objid").agg(F.count("*").alias("_n"))
    return per_object.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.count("*").alias("objects")
    ).withColumn("first_frame_objects", first_frame(traj).agg(F.count("*")).scalar())


def points_per_object(traj: DataFrame) -> DataFrame:
    return traj.groupBy("objid").agg(F.count("*").alias("points"))


def with_chunk(traj: DataFrame, chunk_seconds: int, time: str = "timestamp") -> DataFrame:
    """Add ``chunk``, counted from the first instant of the data (a scalar subquery)."""
    base = traj.agg(F.min(time)).scalar()
    return traj.withColumn("chunk", chunk_index(time, base, chunk_seconds))


def chunk_parts(chunked: DataFrame) -> DataFrame:
    """One row per chunk and object: what all manifest tables are made of.

    Merged on the map side, so counting distinct chunks and objects never spreads the rows themselves.
    """
    return chunked.groupBy("chunk", "objid").agg(
        F.count("*").alias("rows"),
        F.min("timestamp").alias("start_ts"),
        F.max("timestamp").alias("end_ts"),
        *[F.min(a).alias(f"min_{a}") for a in AXES],
        *[F.max(a).alias(f"max_{a}") for a in AXES],
    )


def stats_of_parts(parts: DataFrame, fmt: str = "parquet") -> DataFrame:
    return (
        parts.groupBy("chunk")
        .agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("rows").alias("rows"))
        .withColumn("key", chunk_key("start_ts", fmt))
    )


def chunk_stats(chunked: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Start, end, rows and object key of every chunk."""
    return (
        chunked.groupBy("chunk")
        .agg(
            F.min("timestamp").alias("start_ts"),
            F.max("timestamp").alias("end_ts"),
            F.count("*").alias("rows"),
        )
        .withColumn("key", chunk_key("start_ts", fmt))
    )


def head_of_parts(
    parts: DataFrame, *, chunk_seconds: int, fmt: str = "parquet", hz: float | None = None, dataset: str = ""
) -> DataFrame:
    """The one-row head of a manifest. Chunks and object ids are tables of their own, because
    they grow with the data: ``chunk_stats`` and ``object_ids``."""
    return parts.agg(
        F.lit(1).alias("version"),
        F.lit(dataset).alias("dataset"),
        F.lit(hz).cast("double").alias("hz"),
        F.lit(chunk_seconds).cast("bigint").alias("chunk_seconds"),
        F.lit(fmt).alias("format"),
        format_ts(F.min("start_ts")).alias("start"),
        format_ts(F.max("end_ts")).alias("end"),
        F.sum("rows").alias("rows"),
        F.count_distinct("objid").alias("objects"),
        F.count_distinct("chunk").alias("chunks"),
        *[F.min(f"min_{a}").alias(f"min_{a}") for a in AXES],
        *[F.max(f"max_{a}").alias(f"max_{a}") for a in AXES],
    )


def manifest(chunked: DataFrame, **facts) -> DataFrame:
    """The head of a manifest of rows that have their ``chunk``."""
    return head_of_parts(chunk_parts(chunked), **facts)


def bounding_box(ranges: DataFrame, *, y_up: bool = True, min_height: float = MIN_HEIGHT) -> DataFrame:
    """Centre, size, half extents and wall margin of the box around a coordinate range."""
    up, depth_axis = ("y", "z") if y_up else ("z", "y")

    def extent(axis: str) -> Column:
        return F.col(f"max_{axis}") - F.col(f"min_{axis}")

    def middle(axis: str) -> Column:
        return (F.col(f"min_{axis}") + F.col(f"max_{axis}")) / 2.0

    has = F.col("min_x").isNotNull()
    sizes = {
        "x": F.when(has, extent("x")).otherwise(DEFAULT_BOX["across"]),
        depth_axis: F.when(has, extent(depth_axis)).otherwise(DEFAULT_BOX["across"]),
        up: F.when(has, F.greatest(extent(up), F.lit(min_height))).otherwise(DEFAULT_BOX["height"]),
    }
    sized = ranges.select("*", *[sizes[a].alias(f"size_{a}") for a in AXES])
    half_up = F.col(f"size_{up}") / 2.0
    centre = {
        "x": F.when(has, middle("x")).otherwise(0.0),
        depth_axis: F.when(has, middle(depth_axis)).otherwise(0.0),
        up: F.when(has, F.col(f"min_{up}") + half_up).otherwise(half_up),
    }
    return sized.select(
        *[centre[a].alias(f"center_{a}") for a in AXES],
        *[F.col(f"size_{a}") for a in AXES],
        *[(F.col(f"size_{a}") / 2.0).alias(f"half_{a}") for a in AXES],
        (F.lit(WALL_SHARE) * F.least("size_x", f"size_{depth_axis}")).alias("wall_margin"),
    )


def wall_slabs(box: DataFrame, *, thickness: float = 1.0, y_up: bool = True) -> DataFrame:
    """Centre and size of the floor and of the four walls around a bounding box."""
    up, depth_axis = ("y", "z") if y_up else ("z", "y")
    normal = {
        "Floor": (up, -1.0),
        "North": (depth_axis, 1.0),
        "South": (depth_axis, -1.0),
        "East": ("x", 1.0),
        "West": ("x", -1.0),
    }

    def slab(wall: str) -> Column:
        axis, sign = normal[wall]
        fields = [F.lit(wall).alias("wall")]
        for a in AXES:
            shift = (F.col(f"half_{a}") + F.lit(thickness / 2.0)) * F.lit(sign if a == axis else 0.0)
            fields.append((F.col(f"center_{a}") + shift).alias(f"center_{a}"))
        for a in AXES:
            size = F.lit(float(thickness)) if a == axis else F.col(f"size_{a}")
            fields.append(size.alias(f"size_{a}"))
        return F.struct(*fields)

    return box.select(F.explode(F.array(*[slab(w) for w in WALLS])).alias("s")).select("s.*")


def contact_distance(radii: DataFrame, radius: str = "radius") -> DataFrame:
    return radii.agg((F.lit(CONTACT_PER_RADIUS) * F.max(radius)).alias("contact_distance"))


def range_scan(traj: DataFrame, start, end) -> DataFrame:
    """Rows between two instants, bounds included; refused unless the end lies after the start.

    Plain comparisons with literals, so they prune partitions and row groups. Bounds beyond the
    data need no intersecting: there is nothing to read there.
    """
    if end <= start:
        raise ValueError("the end must lie after the start")
    return traj.where(F.col("timestamp").between(instant(start), instant(end)))


def objects_in_frame(frame: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of mapped objects with their mapped name; other objects are left out."""
    return frame.join(mapping, "objid")


def mapped_or_self(rows: DataFrame, mapping: DataFrame, key: str = "objid", value: str = "mapped") -> DataFrame:
    """Replace a key by its mapped name, or keep it where the mapping lacks it."""
    return (
        rows.join(mapping.select(key, F.col(value).alias("_m")), key, "left")
        .withColumn(key, F.coalesce("_m", F.col(key)))
        .drop("_m")
    )

