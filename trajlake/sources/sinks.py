"""Writers for events, event lists, summaries, reports, traces, labels and raw answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.clock import format_ts
from trajlake.operators.trajectory import mapped_or_self

DECIMALS = 3


def event_lines(events: DataFrame) -> DataFrame:
    """``{"<timestamp>": [[ids]]}`` for every group; a reader appends the lists of one timestamp."""
    return events.select("timestamp", "group_no", F.to_json(F.create_map("timestamp", F.array("grp"))).alias("value"))


def write_events(events: DataFrame, path: str) -> None:
    """Event lines in order of timestamp and group; a range sort, so no task sees them all."""
    event_lines(events).orderBy("timestamp", "group_no").select("value").write.text(path)


def event_list_rows(placed: DataFrame) -> DataFrame:
    return placed.select("timestamp", "objid", F.struct("x", "y", "z").alias("position"))


def event_list_lines(placed: DataFrame) -> DataFrame:
    return event_list_rows(placed).select("timestamp", F.to_json(F.struct("timestamp", "objid", "position")).alias("value"))


def write_event_list(placed: DataFrame, path: str) -> None:
    """Event list lines; name the folder ``*_eventlist.jsonl`` to have it found again."""
    event_list_rows(placed).orderBy("timestamp").write.json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Summaries, evaluation reports and averages: one document per line."""
    df.write.json(path)


def _fixed(col: str) -> Column:
    return F.format_string(f"%.{DECIMALS}f", F.col(col))


def trace_rows(traj: DataFrame, *extra: str) -> DataFrame:
    """Rows as text: millisecond timestamps and coordinates with three decimals."""
    return traj.select(
        format_ts("timestamp").alias("timestamp"), "objid", *[_fixed(a).alias(a) for a in ("x", "y", "z")], *extra
    )


def write_trace(traj: DataFrame, path: str, *, append: bool = True) -> None:
    trace_rows(traj).write.mode("append" if append else "errorifexists").csv(path, header=True)


def label_rows(labels: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Collision labels as text, objects under their mapped names; missing positions are zero."""
    named = mapped_or_self(labels, mapping) if mapping is not None else labels
    return trace_rows(named.fillna(0.0, ["x", "y", "z"]), "kind")


def write_labels(labels: DataFrame, path: str, mapping: DataFrame | None = None) -> None:
    label_rows(labels, mapping).write.mode("append").csv(path, header=True)


def archive_responses(responses: DataFrame, path: str) -> None:
    """Raw answers, a folder per model; the videos of a model lie together in its files.

    A folder per video as well would make as many tiny files as there are videos. Rebalancing
    joins small models and splits large ones.
    """
    ordered = responses.hint("rebalance", F.col("model")).sortWithinPartitions("model", "video")
    ordered.write.partitionBy("model").mode("append").json(path)
