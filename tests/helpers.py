import datetime as dt
import random

START = dt.datetime(2025, 1, 1)


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def positions(spark, rows):
    """Rows of (seconds, objid, x, y, z)."""
    return spark.createDataFrame(
        [(at(t), o, float(x), float(y), float(z)) for t, o, x, y, z in rows],
        "timestamp timestamp_ntz, objid string, x double, y double, z double",
    )


def greedy(times, gap):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] >= gap:
            kept.append(t)
    return kept


def seeded(n=1):
    return random.Random(n)
