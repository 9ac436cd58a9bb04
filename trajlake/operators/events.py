"""From model answers to an event table joined to positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions.answers import last_entries, object_set, with_items, with_strict_items
from trajlake.functions.clock import clock_to_timestamp_text, parse_ts
from trajlake.functions.ids import objid_from_number
from trajlake.operators.asof import asof_position
from trajlake.operators.scans import ordinal
from trajlake.session import written


def parsed(responses: DataFrame, content: str = "content") -> DataFrame:
    return with_items(responses, content)


def quarantine(responses: DataFrame, content: str = "content") -> DataFrame:
    """Answers that the lenient reading cannot make sense of.

    The one-element explode keeps the condition from being moved below the parsing steps, where
    each of them would run several times.
    """
    read = parsed(responses, content).withColumn("_r", F.explode_outer(F.array(F.struct("items"))))
    return read.where(F.col("_r.items").isNull()).drop("items", "_r")


def mentions(
    responses: DataFrame,
    order: str,
    content: str = "content",
    *,
    base_date="2025-01-01",
    keep: tuple[str, ...] = (),
    outer: bool = False,
) -> DataFrame:
    """One row per reported group: ``timestamp`` text, sorted place, ``grp`` of object ids.

    ``order`` is the BIGINT place of the answer; ``item_pos`` the place inside it. Empty groups
    are dropped. ``base_date`` is a date text or a column. With ``outer`` an answer or entry without
    any group leaves a row whose ``timestamp`` is null.
    """
    date = F.lit(base_date) if isinstance(base_date, str) else base_date
    read = with_items(
        responses.select(*keep, F.col(order).alias("chunk_pos"), date.alias("_date"), content), content, "_items"
    )
    # The outer forms keep the optimizer from testing, and so parsing, the list below the explode.
    items = read.select(*keep, "chunk_pos", "_date", F.posexplode_outer("_items").alias("item_pos", "_item"))
    entries = items.withColumn("_e", F.explode_outer(last_entries("_item")))
    reported = F.coalesce(F.size("_e.value") > 0, F.lit(False))
    entries = entries if outer else entries.where(reported)
    at = clock_to_timestamp_text(F.col("_e.key"), F.col("_date"))
    return entries.select(
        *keep,
        (F.when(reported, at) if outer else at).alias("timestamp"),
        "chunk_pos",
        "item_pos",
        F.transform("_e.value", objid_from_number).alias("grp"),
    )


def numbered(found: DataFrame, *, width: int = 4096) -> DataFrame:
    """Add ``group_no``: the place of each group among all groups of its timestamp."""
    return ordinal(found, ["timestamp"], "chunk_pos", width, ["item_pos"], "group_no")


def consolidated(found: DataFrame) -> DataFrame:
    """All groups of every timestamp, each a row with its place ``group_no``. Duplicates are kept.

    One row per group at every size: however many answers name the same second, no list grows.
    """
    return numbered(found).select("timestamp", "group_no", "grp")


def event_stats(found: DataFrame) -> DataFrame:
    """Distinct timestamps, groups, first and last event, distinct objects.

    One pass: rows shrink to one per timestamp and object, merged on the map side, before
    anything distinct is counted.
    """
    pairs = (
        found.select("timestamp", F.posexplode("grp").alias("_i", "objid"))
        .groupBy("timestamp", "objid")
        .agg(F.count_if(F.col("_i") == 0).alias("_n"))
    )
    return pairs.agg(
        F.count_distinct("timestamp").alias("timestamps"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("event_groups"),
        F.min("timestamp").alias("first_event"),
        F.max("timestamp").alias("last_event"),
        F.count_distinct("objid").alias("objects"),
    )


def event_keys(found: DataFrame) -> DataFrame:
    """Per timestamp the first object of its first group."""
    first = F.min(F.struct("chunk_pos", "item_pos", F.col("grp")[0].alias("objid")))
    return (
        found.groupBy("timestamp")
        .agg(first.alias("_first"))
        .select("timestamp", F.col("_first.objid").alias("objid"), parse_ts("timestamp").alias("probe"))
    )


def event_positions(found: DataFrame, traj: DataFrame) -> DataFrame:
    """Events with the position of their object in the frame at that instant; others dropped.

    The lookup reads its probes several times, so the keys are a table: answers are parsed once.
    """
    placed = asof_position(traj, written(event_keys(found), "event-keys"), "probe")
    return placed.select("timestamp", "objid", "x", "y", "z")


def event_unmatched(found: DataFrame, traj: DataFrame) -> DataFrame:
    """Events whose object is not in the frame."""
    marked = traj.select("timestamp", "objid", "x", "y", "z", F.lit(True).alias("_there"))
    placed = asof_position(marked, written(event_keys(found), "event-keys"), "probe", how="left")
    return placed.where(F.col("_there").isNull()).select("timestamp", "objid")


def event_list(lines: DataFrame, line_no: str = "line_no") -> DataFrame:
    """Event rows in list order; rows without time or position dropped, missing axes become 0."""
    axes = [F.coalesce(F.col(f"position.{a}"), F.lit(0.0)).alias(a) for a in ("x", "y", "z")]
    whole = F.col("timestamp").isNotNull() & (F.col("timestamp") != "") & F.col("position").isNotNull()
    return lines.where(whole).select(F.col(line_no).alias("ordinal"), "timestamp", "objid", *axes)


def event_list_positions(events: DataFrame) -> DataFrame:
    """One position per timestamp, the one listed last."""
    last = F.max_by(F.struct("x", "y", "z"), F.col("ordinal"))
    return events.groupBy("timestamp").agg(last.alias("_p")).select("timestamp", "_p.x", "_p.y", "_p.z")


def predictions(responses: DataFrame, source: str, content: str = "content") -> DataFrame:
    """Distinct predicted sets per source and clock, from answers that hold strict JSON."""
    read = with_strict_items(responses.select(F.col(source).alias("source_file"), content), content, "_items")
    items = read.select("source_file", F.explode_outer("_items").alias("_item"))
    sets = items.withColumn("_e", F.explode_outer(last_entries("_item"))).select(
        "source_file", F.col("_e.key").alias("clock"), object_set("_e.value").alias("objects")
    )
    return sets.where(F.col("objects").isNotNull()).dropDuplicates()
