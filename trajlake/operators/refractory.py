"""Greedy spacing: keep a row only if a gap has passed since the last row that was kept.

The rule is sequential, yet no key is ever followed in one task, and only instants go to Python.
Instants are gathered per ``(keys, piece)``, where a piece is a stretch of time, cut finer where it
would hold more than ``PIECE_ROWS`` of them. A piece is a function: from the guard it is entered with to
the guard it is left with. An entering guard lies less than a gap after the piece's first instant, so
the function needs a step for each instant of that gap only. Pieces are composed ``FAN`` at a time, level
by level, until a key is one function; from there the guards go back down to the pieces. A table has at
most as many steps as a gap has instants, and a task holds ``FAN`` tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.functions.clock import MICROS, from_micros, micros
from trajlake.session import written

DEFAULT_SECONDS = 600
GAPS_PER_BUCKET = 64
PIECE_ROWS = 50_000
FAN = 64
_NEVER = -(2**62)
_LONGS = T.ArrayType(T.LongType())


def _exits(ms: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps of a piece: for each instant that may be the first one kept, the guard at the end."""
    following = np.searchsorted(ms, ms + gap)
    last = np.where(following < len(ms), following, np.arange(len(ms)))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    starts = min(len(ms), int(np.searchsorted(ms, ms[0] + gap)) + 1)
    return ms[:starts], ms[last[:starts]] + gap


def _through(firsts: np.ndarray, guards: np.ndarray, entering: np.ndarray) -> np.ndarray:
    """The guards with which a piece is left; a guard beyond all its steps passes unchanged."""
    place = np.searchsorted(firsts, entering)
    hit = place < len(firsts)
    out = entering.copy()
    out[hit] = guards[place[hit]]
    return out


def _composed(tables: Sequence[tuple[np.ndarray, np.ndarray]], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps of several pieces in a row."""
    steps = np.unique(np.concatenate([f for f, _ in tables]))
    steps = steps[: int(np.searchsorted(steps, steps[0] + gap)) + 1]
    guards = steps
    for firsts, ends in tables:
        guards = _through(firsts, ends, guards)
    return steps, guards


def _kept(ms: np.ndarray, guard: int, gap: int) -> np.ndarray:
    """The instants that are kept, given the guard the piece starts with."""
    kept = []
    i = int(np.searchsorted(ms, guard))
    while i < len(ms):
        kept.append(ms[i])
        i = int(np.searchsorted(ms, ms[i] + gap))
    return np.array(kept, dtype="int64")


@F.pandas_udf(T.StructType([T.StructField(n, _LONGS) for n in ("firsts", "guards")]))
def _tables(ms: pd.Series, gap: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_exits(m, g) for m, g in zip(ms, gap, strict=True)], columns=["firsts", "guards"], dtype=object)


@F.pandas_udf(_LONGS)
def _keep(ms: pd.Series, guard: pd.Series, gap: pd.Series) -> pd.Series:
    return pd.Series([_kept(m, s, g) for m, s, g in zip(ms, guard, gap, strict=True)], dtype=object)


def cut_into_pieces(instants: DataFrame, keys: Sequence[str], width: int) -> tuple[DataFrame, int]:
    """Add ``_piece``, growing with time, and the number of ``FAN`` levels above the pieces.

    Where a stretch of ``width`` microseconds holds too many instants of a key it is cut into a power
    of two of parts, several times more than even spacing would need.
    """
    placed = instants.withColumn("_bucket", F.floor(F.col("_m") / F.lit(width)))
    sizes = placed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    low, high, most = sizes.agg(F.min("_bucket"), F.max("_bucket"), F.max("_n")).first()
    if low is None:
        return placed.withColumn("_piece", F.lit(0).cast("bigint")), 1
    parts = 1
    if most > PIECE_ROWS:
        parts = 1 << (4 * most // PIECE_ROWS).bit_length()
        dense = sizes.where(F.col("_n") > PIECE_ROWS).select(
            *keys, "_bucket", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_n") * F.lit(4.0 / PIECE_ROWS)))).cast("bigint").alias("_cut")
        )
        placed = placed.join(dense, [*keys, "_bucket"], "left").withColumn("_cut", F.coalesce("_cut", F.lit(1)))
    else:
        placed = placed.withColumn("_cut", F.lit(1))
    inside = F.col("_m") - F.col("_bucket") * F.lit(width)
    part = F.floor(inside * F.col("_cut") / F.lit(float(width))) * F.expr(f"{parts} div _cut")
    placed = placed.withColumn("_piece", (F.col("_bucket") - F.lit(low)) * F.lit(parts) + part).drop("_cut")
    total, levels = (high - low + 1) * parts, 0
    while total > 1:
        total, levels = -(-total // FAN), levels + 1
    return placed, max(1, levels)


def _guards(tables: DataFrame, keys: Sequence[str], levels: int, gap: int) -> DataFrame:
    """``_start`` of every piece: the guard it really begins with."""
    schema = T.StructType([*[tables.schema[k] for k in keys], T.StructField("_piece", T.LongType())])
    whole = T.StructType([*schema.fields, T.StructField("firsts", _LONGS), T.StructField("guards", _LONGS)])
    started = T.StructType([*schema.fields, T.StructField("_start", T.LongType())])

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_piece")
        firsts, guards = _composed(list(zip(group["firsts"], group["guards"], strict=True)), gap)
        head = group.iloc[:1][[*keys, "_up"]].rename(columns={"_up": "_piece"})
        return head.assign(firsts=[firsts], guards=[guards])[[f.name for f in whole]]

    def hand_down(key: tuple, parents: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_piece")
        guard, starts = np.array(parents["_start"].iloc[:1], dtype="int64"), []
        for firsts, ends in zip(group["firsts"], group["guards"], strict=True):
            starts.append(int(guard[0]))
            guard = _through(firsts, ends, guard)
        return group.assign(_start=starts)[[f.name for f in started]]

    up = F.expr(f"_piece div {FAN}").alias("_up")
    stages = [tables.select(*keys, "_piece", "firsts", "guards")]
    for _ in range(levels - 1):
        stages.append(stages[-1].select("*", up).groupBy(*keys, "_up").applyInPandas(compose, whole))
    starts = stages[-1].select(*keys, up.alias("_piece")).distinct().withColumn("_start", F.lit(_NEVER).cast("bigint"))
    for stage in reversed(stages):
        # Other names than below: both sides come from the same rows.
        own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
        parents = starts.select(*own, F.col("_piece").alias("_parent"), "_start")
        starts = parents.groupBy(*[f"_k{i}" for i in range(len(keys))], "_parent").cogroup(stage.select("*", up).groupBy(*keys, "_up")).applyInPandas(hand_down, started)
    return starts


def spaced_instants(
    instants: DataFrame, keys: Sequence[str], time: str, gap_seconds: float, *, bucket_seconds: float | None = None
) -> DataFrame:
    """Rows ``(keys, time)`` of the distinct instants that the greedy rule keeps.

    A bucket is ``bucket_seconds`` long; by default ten minutes or 64 gaps, whichever is longer. Its
    length is a matter of speed only. Keys are not null.
    """
    gap = round(gap_seconds * MICROS)
    width = round(bucket_seconds * MICROS) if bucket_seconds else max(DEFAULT_SECONDS * MICROS, gap * GAPS_PER_BUCKET)
    distinct = instants.select(*keys, micros(time).alias("_m")).where("_m is not null").distinct()
    distinct = written(distinct, "instants")
    placed, levels = cut_into_pieces(distinct, keys, width)
    gathered = placed.groupBy(*keys, "_piece").agg(F.array_sort(F.collect_list("_m")).alias("_ms"))
    tables = gathered.withColumn("_t", _tables("_ms", F.lit(gap))).select(*keys, "_piece", "_t.firsts", "_t.guards")
    # Keys with a single piece begin without a guard; only the others are chained.
    if keys:
        several = tables.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        tables = tables.join(several, list(keys), "left_semi")
    starts = _guards(tables, keys, levels, gap)
    begun = gathered.join(starts, [*keys, "_piece"], "left").withColumn("_start", F.coalesce("_start", F.lit(_NEVER).cast("bigint")))
    kept = begun.select(*keys, F.explode(_keep("_ms", "_start", F.lit(gap))).alias("_m"))
    return kept.select(*keys, from_micros("_m").alias(time))


def spaced_rows(
    rows: DataFrame, keys: Sequence[str], time: str, gap_seconds: float, *, bucket_seconds: float | None = None
) -> DataFrame:
    """The rows that the greedy rule keeps, all rows of a kept instant alike."""
    kept = spaced_instants(rows, keys, time, gap_seconds, bucket_seconds=bucket_seconds)
    return rows.join(kept, [*keys, time]).select(*rows.columns)
