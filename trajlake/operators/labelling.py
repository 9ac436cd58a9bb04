"""Collision labels: counters of stuck and wall rows that begin anew after each label.

An object's state is its two counters, whether its last position is forgotten, and the guard, the instant
from which it may be labelled again. That is sequential, but no object is followed in one task: its rows
are cut into pieces of time, and every state a piece may be entered with is carried through it at once.
Counters are small numbers, and of guards only those within the piece's first rows differ, so a piece
is a small table from entering to leaving states. Tables are composed level by level like those of
greedy spacing; the states come back down, and each piece then finds its own labels. Rows are stepped
through many pieces and states at once, so the steps of a task are the rows of its longest piece.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.functions.clock import MICROS, from_micros, micros
from trajlake.operators.refractory import FAN, cut_into_pieces

_LONGS = T.ArrayType(T.LongType())
_NEVER = -(2**62)
#: In a table: no label in between, so the entering guard still holds.
_KEPT = -(2**61)
#: A state is four numbers: stuck rows, wall rows, whether the last position is forgotten, the guard.
_FRESH = (0, 0, 0, _NEVER)


def _entries(early: np.ndarray, stuck_rows: int, wall_rows: int) -> np.ndarray:
    """All states a piece can be entered with, one in each row.

    ``early`` are the piece's instants up to a cooldown after its first one. A guard counts by how
    many of them lie before it.
    """
    guards = np.concatenate([[_NEVER], early + 1])
    # A label in the piece sets a guard of its first instant and a cooldown at least, which is later.
    grid = np.meshgrid(np.arange(stuck_rows + 1), np.arange(wall_rows + 1), np.arange(2), guards, indexing="ij")
    return np.stack([g.ravel() for g in grid], axis=1).astype(np.int64)


def _lane(state: np.ndarray, early: np.ndarray, stuck_rows: int, wall_rows: int) -> np.ndarray:
    """The rows of ``_entries`` that states stand for."""
    place = np.searchsorted(early, state[:, 3])
    shape = (stuck_rows + 1, wall_rows + 1, 2, len(early) + 1)
    return np.ravel_multi_index((state[:, 0], state[:, 1], state[:, 2], place), shape)


def _step(state: np.ndarray, m: np.ndarray, stuck: np.ndarray, near: np.ndarray, rule: tuple[int, int, int]) -> np.ndarray:
    """All states after a row each; returns which of them labelled it (1 stuck, 2 wall)."""
    stuck_rows, wall_rows, cooldown = rule
    judged = state[:, 2] == 0
    state[:, 0] = np.where(judged, np.where(stuck, np.minimum(state[:, 0] + 1, stuck_rows), 0), state[:, 0])
    blocked = judged & (state[:, 0] >= stuck_rows)
    walls = np.where(near, np.minimum(state[:, 1] + 1, wall_rows), 0)
    state[:, 1] = np.where(blocked, state[:, 1], walls)
    hit = (blocked | (state[:, 1] >= wall_rows)) & (m >= state[:, 3])
    state[:, :2][hit] = 0
    state[:, 2] = hit
    state[:, 3] = np.where(hit, m + cooldown, state[:, 3])
    return np.where(hit, np.where(blocked, 1, 2), 0)


#: States that are stepped through together.
TOGETHER = 200_000


def _march(ms: list, fs: list, states: list[np.ndarray], rule: tuple[int, int, int], *, merge: bool) -> tuple[list[np.ndarray], list[list[dict]]]:
    """The states after each of several pieces, and the labels on the way.

    A step takes the next row of every piece that has one, for all its states. Longest pieces come first,
    so those that go on are a prefix. With ``merge`` states that have become equal go on as one.
    """
    order = sorted(range(len(ms)), key=lambda i: -len(ms[i]))
    lengths = np.array([len(ms[i]) for i in order])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    m_all = np.concatenate([ms[i] for i in order])
    f_all = np.concatenate([fs[i] for i in order])
    owner = np.repeat(np.arange(len(order)), [len(states[i]) for i in order])
    state = np.concatenate([states[i] for i in order])
    lanes = np.arange(len(state))
    found: list[list[dict]] = [[] for _ in ms]
    for t in range(int(lengths[0])):
        active = int(np.searchsorted(-lengths, -t, side="left"))
        k = int(np.searchsorted(owner, active))
        at = begins[owner[:k]] + t
        m, f = m_all[at], f_all[at]
        kinds = _step(state[:k], m, f & 1 > 0, f & 2 > 0, rule)
        if not merge:
            for i in np.flatnonzero(kinds).tolist():
                found[order[owner[i]]].append({"m": int(m[i]), "kind": int(kinds[i])})
        # After 8, 16, 32 .. rows: most states have met by then, and what is left costs little.
        elif t >= 7 and (t + 1) & t == 0 and len(state) > len(order):
            both, place = np.unique(np.column_stack([owner, state]), axis=0, return_inverse=True)
            lanes, owner, state = place.ravel()[lanes], both[:, 0], np.ascontiguousarray(both[:, 1:])
    ends = state[lanes]
    out: list[np.ndarray] = [ends[:0]] * len(ms)
    first = 0
    for i in order:
        out[i] = ends[first : first + len(states[i])]
        first += len(states[i])
    return out, found


def _tables(ms: list, fs: list, rule: tuple[int, int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each piece its early instants and, for each state it may be entered with, the state it leaves behind."""
    early = [m[: int(np.searchsorted(m, m[0] + rule[2]))] for m in ms]
    begun = [_entries(e, *rule[:2]) for e in early]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    first = total = 0
    for i, states in enumerate(begun):
        total += len(states)
        if total >= TOGETHER or i + 1 == len(begun):
            some = slice(first, i + 1)
            leaving, _ = _march(ms[some], fs[some], begun[some], rule, merge=True)
            for e, before, after in zip(early[some], begun[some], leaving, strict=True):
                # Labels set later guards than any that a state may come with.
                after[after[:, 3] == before[:, 3], 3] = _KEPT
                out.append((e, after))
            first, total = i + 1, 0
    return out


def _through(early: np.ndarray, leaving: np.ndarray, state: np.ndarray, rule: tuple[int, int, int]) -> np.ndarray:
    """The states after a piece."""
    after = leaving[_lane(state, early, *rule[:2])]
    after[:, 3] = np.where(after[:, 3] == _KEPT, state[:, 3], after[:, 3])
    return after


def collision_rows(flagged: DataFrame, *, stuck_rows: int, wall_rows: int, cooldown: float, bucket_seconds: float | None = None) -> DataFrame:
    """``objid``, ``timestamp`` and ``kind`` of every label, from rows with the flags ``stuck`` and ``near``.

    A row counts as stuck or not, unless the last position is forgotten. At ``stuck_rows`` in a row the
    object is blocked, and its wall counter stands still; else at ``wall_rows`` in a row it hugs the
    wall. Either is labelled unless the last label is less than ``cooldown`` seconds old; a label sets
    both counters to 0 and forgets the position. Counters that cannot be labelled yet keep standing.
    Pieces are ``bucket_seconds`` long, by default an hour or 64 cooldowns, whichever is longer; the
    length is a matter of speed only.
    """
    bucket_seconds = bucket_seconds or max(3600.0, 64 * cooldown)
    rule = (stuck_rows, wall_rows, round(cooldown * MICROS))
    flag = F.when(F.col("stuck"), 1).otherwise(0) + F.when(F.col("near"), 2).otherwise(0)
    rows = flagged.select("objid", micros("timestamp").alias("_m"), flag.cast("bigint").alias("_f"))
    placed, levels = cut_into_pieces(rows, ["objid"], round(bucket_seconds * MICROS))
    both = F.array_sort(F.collect_list(F.struct("_m", "_f")))
    gathered = placed.groupBy("objid", "_piece").agg(both.alias("_r")).select(
        "objid", "_piece", F.col("_r._m").alias("_ms"), F.col("_r._f").alias("_fs")
    )

    @F.pandas_udf(T.StructType([T.StructField("early", _LONGS), T.StructField("leaving", _LONGS)]))
    def tables(ms: pd.Series, fs: pd.Series) -> pd.DataFrame:
        made = _tables(ms.to_list(), fs.to_list(), rule)
        return pd.DataFrame([(e, s.ravel()) for e, s in made], columns=["early", "leaving"], dtype=object)

    def through(early: np.ndarray, leaving: np.ndarray, state: np.ndarray) -> np.ndarray:
        return _through(np.asarray(early), np.asarray(leaving).reshape(-1, 4), state, rule)

    schema = "objid string, _piece long, early array<long>, leaving array<long>"
    started = "objid string, _piece long, _start array<long>"

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_piece")
        first = np.asarray(group["early"].iloc[0])
        # Later pieces may begin within the cooldown of the first instant.
        early = np.unique(np.concatenate([np.asarray(e) for e in group["early"]]))
        early = early[: int(np.searchsorted(early, first[0] + rule[2]))]
        state = _entries(early, *rule[:2])
        begun = state[:, 3].copy()
        for e, s in zip(group["early"], group["leaving"], strict=True):
            state = through(e, s, state)
        state[state[:, 3] == begun, 3] = _KEPT
        return pd.DataFrame({"objid": [group["objid"].iloc[0]], "_piece": [int(group["_up"].iloc[0])], "early": [early], "leaving": [state.ravel()]})

    def hand_down(key: tuple, parents: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_piece")
        state, starts = np.asarray(parents["_start"].iloc[0], dtype=np.int64).reshape(1, 4), []
        for e, s in zip(group["early"], group["leaving"], strict=True):
            starts.append(state[0])
            state = through(e, s, state)
        return group.assign(_start=starts)[["objid", "_piece", "_start"]]

    up = F.expr(f"_piece div {FAN}").alias("_up")
    # Objects with a single piece begin fresh; only the others are chained.
    several = gathered.groupBy("objid").agg(F.count("*").alias("_n")).where("_n > 1").select("objid")
    chained = gathered.join(several, "objid", "left_semi")
    stages = [chained.withColumn("_t", tables("_ms", "_fs")).select("objid", "_piece", "_t.early", "_t.leaving")]
    for _ in range(levels - 1):
        stages.append(stages[-1].select("*", up).groupBy("objid", "_up").applyInPandas(compose, schema))
    fresh = F.array(*[F.lit(v).cast("bigint") for v in _FRESH])
    starts = stages[-1].select("objid", up.alias("_piece")).distinct().withColumn("_start", fresh)
    for stage in reversed(stages):
        parents = starts.select(F.col("objid").alias("_k"), F.col("_piece").alias("_parent"), "_start")
        starts = parents.groupBy("_k", "_parent").cogroup(stage.select("*", up).groupBy("objid", "_up")).applyInPandas(hand_down, started)

    @F.pandas_udf("array<struct<m:long,kind:int>>")
    def labelled(ms: pd.Series, fs: pd.Series, start: pd.Series) -> pd.Series:
        states = [np.array(s, dtype=np.int64).reshape(1, 4) for s in start]
        return pd.Series(_march(ms.to_list(), fs.to_list(), states, rule, merge=False)[1] if len(ms) else [], dtype=object)

    begun = gathered.join(starts, ["objid", "_piece"], "left").withColumn("_start", F.coalesce("_start", fresh))
    hits = begun.select("objid", F.explode(labelled("_ms", "_fs", "_start")).alias("h"))
    kind = F.when(F.col("h.kind") == 1, "stuck").otherwise("wall").alias("kind")
    return hits.select("objid", from_micros("h.m").alias("timestamp"), kind)
