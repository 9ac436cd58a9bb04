"""Whole flows, each a composition of operators with one lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions.clock import parse_ts
from trajlake.operators.evaluate import macro_average, metrics
from trajlake.operators.events import (
    event_list,
    event_positions,
    mentions,
    predictions,
)
from trajlake.operators.playback import event_clips, next_event
from trajlake.operators.proximity import contacts, scene_episodes, truth_rows
from trajlake.sources.lake import asof_lake, write_lake


def answers_to_event_list(responses: DataFrame, order: str, traj: DataFrame, **reading) -> DataFrame:
    """Model answers to the event list: parse, drop empty groups, first object, position."""
    return event_positions(mentions(responses, order, **reading), traj)


def event_summary(documents: DataFrame, *, base_date="2025-01-01") -> DataFrame:
    """Per response document its counts and its events as JSON text.

    A document is a row, whatever its id: ids may be missing or repeated. Rows are numbered once, and
    documents without any event stay because every explode keeps them.
    """
    numbered = documents.withColumn("_doc", F.monotonically_increasing_id())
    chunks = numbered.select(
        "_doc", "id", "model", "execution_time", F.posexplode_outer("chunk_responses").alias("chunk_pos", "_c")
    ).select(
        "_doc", "id", "model", "execution_time", F.col("chunk_pos").cast("bigint").alias("chunk_pos"), F.col("_c.content").alias("content")
    )
    keep = ("_doc", "id", "model", "execution_time")
    found = mentions(chunks, "chunk_pos", base_date=base_date, keep=keep, outer=True)
    per_time = found.groupBy(*keep, "timestamp").agg(
        F.array_sort(F.collect_list(F.when(F.col("timestamp").isNotNull(), F.struct("chunk_pos", "item_pos", "grp")))).alias("_g")
    )
    entry = F.when(F.col("timestamp").isNotNull(), F.struct("timestamp", F.col("_g.grp").alias("groups")))
    per_document = per_time.groupBy(*keep).agg(F.array_sort(F.collect_list(entry)).alias("_e"), F.sum(F.size("_g")).alias("_groups"))
    return per_document.select(
        F.coalesce("id", F.lit("")).alias("source_id"),
        F.coalesce("model", F.lit("")).alias("model"),
        F.coalesce("execution_time", F.lit(0.0)).alias("execution_time"),
        F.size("_e").cast("bigint").alias("total_timestamps"),
        F.col("_groups").alias("total_groups"),
        F.to_json(F.map_from_entries("_e")).alias("events"),
    )


def summary_replay(traj: DataFrame, lines: DataFrame, *, seconds: float = 1.0, stop_at_end: bool = True) -> DataFrame:
    """Event list to replay: what is shown for each event, and which event comes next."""
    events = event_list(lines).select("ordinal", parse_ts("timestamp").alias("event_ts"))
    following = next_event(events, time="event_ts")
    return event_clips(traj, following, seconds=seconds, stop_at_end=stop_at_end)


def evaluation(responses: DataFrame, truth: DataFrame, files: DataFrame, source: str) -> DataFrame:
    """Answers to scores per file, each file held against its truth set."""
    return metrics(truth, predictions(responses, source), files)


def evaluation_average(responses: DataFrame, truth: DataFrame, files: DataFrame, source: str) -> DataFrame:
    """Answers to the average over files of the scores rounded to two places."""
    scores = evaluation(responses, truth, files, source)
    return macro_average(scores.select(*[F.round(c, 2).alias(c) for c in ("precision", "recall", "f1_score")]))


def truth_from_contacts(traj: DataFrame, distance: float, **guard) -> DataFrame:
    """Truth rows made by computation: contacts that fire, as clock and object numbers.

    A contact fires when both objects are past their guards, whoever caused these.
    """
    return truth_rows(scene_episodes(contacts(traj, distance), **guard))


def ingest_and_look_up(
    traj: DataFrame, uri: str, probes: DataFrame, *, chunk_seconds: int, time: str = "probe"
) -> DataFrame:
    """Write a lake and answer probes from it, reading only the files they need."""
    spark = traj.sparkSession
    root = write_lake(traj, uri, chunk_seconds=chunk_seconds)
    return asof_lake(spark, root, probes, time)

