"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query runs once to warm up and then is timed into a no-op sink. ``rates`` compares with the
published figures: rows ingested and probes answered per second.

    python bench.py [--all] [names...]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

HEADLINE = """asof_frame asof_lake last_wins chunk_stats manifest contacts contact_episodes scene_episodes
object_speed stalls wall_hugs collision_labels parse_content events_consolidated event_positions event_summary
event_clips resample playback_ticks next_event last_hit eval_metrics eval_details gap_fill overlap_windows
thin_fps thin_greedy percentile_index run_stats synth_trajectory sniff_delimiter lake_roundtrip""".split()

# Published figure: rows per second of a 15,000-row ingest.
REFERENCE_INGEST = 136_000


def timed(job) -> float:
    begin = time.perf_counter()
    job()
    return time.perf_counter() - begin


def ingest_rate(spark, sf: str) -> dict[str, float]:
    """Write a lake of five rows per second for objects taken from the events, then probe it."""
    from pyspark.sql import functions as F

    from checks import fixtures as fx
    from trajlake.operators.synth import synth_trajectory
    from trajlake.session import new_folder
    from trajlake.sources.lake import asof_lake, write_lake

    specs = fx.users(spark, sf).select(
        (F.col("user_id") + 1).alias("number"),
        F.lit("2025-01-01 00:00:00").cast("timestamp_ntz").alias("start_ts"),
        F.lit(300.0).alias("duration_s"),
        F.lit(5.0).alias("hz"),
    )
    made = new_folder(spark, "made")
    synth_trajectory(specs).write.parquet(made)
    rows = spark.read.parquet(made)
    count = rows.count()
    root = new_folder(spark, "lake")
    spent = timed(lambda: write_lake(rows, root, chunk_seconds=60, hz=5.0))
    # Twenty probes per event, scattered over the whole range.
    probes = (
        fx.events(spark, sf)
        .select(F.explode(F.sequence(F.col("event_id") * 20, F.col("event_id") * 20 + 19)).alias("query_id"))
        .withColumn("ms", F.pmod(F.col("query_id") * 7919, F.lit(300_000)))
        .select("query_id", F.timestamp_micros(F.lit(1_735_689_600_000_000) + F.col("ms") * 1000).cast("timestamp_ntz").alias("probe"))
    )
    # Whole frames, as a replay of the scene asks.
    placed = asof_lake(spark, root, probes)
    asked = probes.count()
    seek = timed(lambda: placed.write.format("noop").mode("overwrite").save())
    return {
        "ingest_rows": count,
        "ingest_rows_per_s": round(count / spent),
        "ingest_vs_published": round(count / spent / REFERENCE_INGEST, 2),
        "probes": asked,
        "probes_per_s": round(asked / seek),
    }


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--all", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from checks import registry
    from trajlake.session import local_session

    spark = local_session("bench", cpus, "16g")
    names = args.names or (list(registry.TYPED) if args.all else HEADLINE)
    spent: dict[str, float] = {}

    def run(name: str) -> None:
        registry.TYPED[name](spark, sf).write.format("noop").mode("overwrite").save()

    for name in names:
        if not args.all:
            run(name)
        spent[name] = round(timed(lambda n=name: run(n)), 3)
        if args.all:
            print(name, spent[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total time of headline queries",
        "value": round(sum(spent.values()), 3),
        "unit": "sec",
        "queries": spent,
        "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
    }
    if not args.names:
        line["rates"] = ingest_rate(spark, sf)
    print(json.dumps(line))


if __name__ == "__main__":
    main()
