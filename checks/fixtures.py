"""Views of the given tables in the shapes the operators take, on Spark and as DuckDB CTEs.

Both sides describe the same rows: positions are made from ``events`` (one object per user), model
answers and truth lines from the same events, runs from ``orders``, names from ``nation`` and
``customer``, delimited text from ``documents``. All rows of a table are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions.clock import format_ts, from_micros, trunc_ms
from trajlake.functions.ids import objid_from_number
from trajlake.operators.asof import last_wins
from trajlake.operators.evaluate import ground_truth
from trajlake.operators.events import predictions

# ---- Spark views ---------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark, sf):
    return table(spark, sf, "events")


def as_positions(ev: DataFrame, time) -> DataFrame:
    return ev.select(
        time.alias("timestamp"),
        objid_from_number(F.col("user_id") + 1).alias("objid"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.pmod(F.col("event_id") * 7919, F.lit(500)).cast("double").alias("z"),
        F.col("event_id"),
    )


#: Consecutive events that make up a frame: its crowd is the same at any size, the frames grow in number.
PER_FRAME = 14


def frame_time():
    """The full hour of an event's frame."""
    hours = F.floor(F.col("event_id") / PER_FRAME)
    return from_micros(F.lit(1_704_067_200_000_000) + hours * F.lit(3_600_000_000))


def hourly_rows(spark, sf):
    """Rows by hourly frames; an object can occur several times in one frame."""
    return as_positions(events(spark, sf), frame_time())


def traj(spark, sf):
    return last_wins(hourly_rows(spark, sf), "event_id")


def fine(spark, sf):
    """Rows at millisecond instants."""
    return last_wins(as_positions(events(spark, sf), trunc_ms("ts")), "event_id")


def probes(spark, sf):
    """One probe per event, moved by up to an hour either way, so some lie outside the data."""
    shift = F.pmod(F.col("event_id") * 7919, F.lit(7200)) - 3600
    return events(spark, sf).select(
        F.col("event_id").alias("query_id"),
        trunc_ms(F.col("ts") + F.make_dt_interval(secs=shift)).alias("probe"),
    )


def half_hour_probes(spark, sf):
    """Probes in event order on full and half hours; only the full hours can lie on a frame."""
    half = F.make_dt_interval(mins=F.pmod(F.col("event_id"), F.lit(2)) * 30)
    return events(spark, sf).select(
        F.col("event_id").alias("query_id"),
        (F.date_trunc("HOUR", "ts").cast("timestamp_ntz") + half).alias("probe"),
    )


def users(spark, sf):
    """Per user the range of its events and their number."""
    return events(spark, sf).groupBy("user_id").agg(
        trunc_ms(F.min("ts")).alias("start_ts"), trunc_ms(F.max("ts")).alias("end_ts"), F.count("*").alias("n")
    )


def answer_text(clock, minute, a, b):
    """A list of two items, the second one empty."""
    return F.concat(
        F.lit('[{"'), clock, F.lit('": ['), a.cast("string"), F.lit(", "), b.cast("string"),
        F.lit(']}, {"'), minute, F.lit('": []}]'),
    )


def responses(spark, sf):
    """One answer per event, in seven manners of writing, some of them without any event."""
    e = events(spark, sf)
    a, b = F.col("user_id") % 4 + 1, F.col("user_id") % 3 + 5
    j = answer_text(F.date_format("ts", "HH:mm:ss"), F.date_format("ts", "HH:mm:00"), a, b)
    i = F.col("event_id")
    content = (
        F.when(i % 11 == 0, "no overlap was found")
        .when(i % 7 == 0, "[]")
        .when(i % 5 == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
        .when(i % 5 == 1, F.concat(F.lit("Here are the events: "), j, F.lit(" done.")))
        .when(i % 5 == 2, F.replace(j, F.lit('"'), F.lit("'")))
        .when(i % 5 == 3, F.concat(F.lit('{"events": '), j, F.lit("}")))
        .otherwise(j)
    )
    return e.select(
        "event_id",
        F.col("event_type").alias("model"),
        F.col("value").alias("execution_time"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        content.alias("content"),
    )


def documents(spark, sf):
    """Response documents: one per event, its answer and an empty one."""
    return responses(spark, sf).select(
        F.col("event_id").cast("string").alias("id"),
        "model",
        "execution_time",
        F.array(F.struct("content"), F.struct(F.lit("[]").alias("content"))).alias("chunk_responses"),
    )


def second_clock():
    """A clock text that ten consecutive events share."""
    c = F.floor(F.col("event_id") / 10)
    return F.format_string("%02d:%02d:%02d", F.floor(c / 3600), F.floor(c / 60) % 60, c % 60)


HELD_AGAINST = {"click": "view", "view": "error", "error": "signup", "signup": "purchase"}


def truth_lines(spark, sf):
    """A truth set of every event type."""
    pair = F.concat_ws(",", (F.col("user_id") % 4 + 1).cast("string"), (F.col("user_id") % 3 + 5).cast("string"))
    return (
        events(spark, sf)
        .select(
            F.col("event_type").alias("gt_id"),
            F.col("event_id").alias("line_no"),
            F.concat_ws(" ", second_clock(), pair).alias("value"),
        )
    )


def truth(spark, sf):
    return ground_truth(truth_lines(spark, sf))


def prediction_answers(spark, sf):
    """Answers of every event type as a source: fenced list, bare list or prose; sign-ups only prose."""
    j = F.concat(
        F.lit('[{"'), second_clock(), F.lit('": ['), (F.col("user_id") % 3 + 5).cast("string"), F.lit(", "),
        (F.col("user_id") % 4 + 1).cast("string"), F.lit("]}]"),
    )
    i = F.col("event_id")
    content = (
        F.when((i % 3 == 2) | (F.col("event_type") == "signup"), F.concat(F.lit("I saw "), j))
        .when(i % 3 == 0, F.concat(F.lit("Found:\n```json\n"), j, F.lit("\n```")))
        .otherwise(j)
    )
    return events(spark, sf).select("event_type", content.alias("content"))


def pred(spark, sf):
    return predictions(prediction_answers(spark, sf), "event_type")


def eval_files(spark, sf):
    """Every source with the truth set it is held against, that of another type."""
    of = F.lit("click")
    for source, other in HELD_AGAINST.items():
        of = F.when(F.col("event_type") == source, other).otherwise(of)
    return events(spark, sf).select(F.col("event_type").alias("source_file"), of.alias("gt_id")).distinct()


def runs(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run"),
        F.col("o_orderstatus").alias("label"),
        F.col("o_totalprice").alias("wall_clock_s"),
        (~F.col("o_orderpriority").startswith("5")).alias("success"),
        F.col("o_orderpriority").alias("error"),
    )


def mapping(spark, sf):
    return table(spark, sf, "nation").select(
        objid_from_number(F.col("n_nationkey") + 1).alias("objid"), F.col("n_name").alias("mapped")
    )


def as_text(rows: DataFrame) -> DataFrame:
    """Rows with their timestamps as text, the way the reference of the formats prints them."""
    stamps = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("timestamp_ntz", "timestamp")}
    return rows.select(*[format_ts(c).alias(c) if c in stamps else F.col(c) for c in rows.columns])


# ---- the same views as DuckDB CTEs ---------------------------------------------------------

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%g')"


def ts(expr: str) -> str:
    return TS.format(expr)


_POSITION = """arg_max(value, event_id) AS x,
  arg_max(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), event_id) AS y,
  arg_max(CAST((event_id * 7919) % 500 AS DOUBLE), event_id) AS z"""

_CLOCK = "printf('%02d:%02d:%02d', (event_id // 10) // 3600, ((event_id // 10) // 60) % 60, (event_id // 10) % 60)"

CTES = {
    "hourly_rows": """hourly_rows AS (SELECT TIMESTAMP '2024-01-01' + to_hours(event_id // 14) AS timestamp, printf('obj%03d', user_id + 1) AS objid,
  value AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y,
  CAST((event_id * 7919) % 500 AS DOUBLE) AS z, event_id FROM events)""",
    "traj": f"""traj AS (SELECT TIMESTAMP '2024-01-01' + to_hours(event_id // 14) AS timestamp, printf('obj%03d', user_id + 1) AS objid,
  {_POSITION} FROM events GROUP BY 1, 2)""",
    "fine": f"""fine AS (SELECT date_trunc('millisecond', ts) AS timestamp, printf('obj%03d', user_id + 1) AS objid,
  {_POSITION} FROM events GROUP BY 1, 2)""",
    "frames": "frames AS (SELECT DISTINCT timestamp AS frame_ts FROM traj)",
    "probes": """probes AS (SELECT event_id AS query_id,
  date_trunc('millisecond', ts + to_seconds((event_id * 7919) % 7200 - 3600)) AS probe FROM events)""",
    "half": """half AS (SELECT event_id AS query_id,
  date_trunc('hour', ts) + to_minutes((event_id % 2) * 30) AS probe FROM events)""",
    "located": """located AS (SELECT p.query_id, p.probe,
  coalesce(f.frame_ts, (SELECT min(frame_ts) FROM frames)) AS frame_ts
  FROM probes p ASOF LEFT JOIN frames f ON p.probe >= f.frame_ts)""",
    "users": """users AS (SELECT user_id, date_trunc('millisecond', min(ts)) AS start_ts,
  date_trunc('millisecond', max(ts)) AS end_ts, count(*) AS n FROM events GROUP BY 1)""",
    "mentions": """mentions AS (SELECT event_id, '2025-01-01 ' || strftime(ts, '%H:%M:%S') || '.000' AS timestamp,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000' AS day_timestamp,
  [printf('obj%03d', user_id % 4 + 1), printf('obj%03d', user_id % 3 + 5)] AS grp
  FROM events WHERE event_id % 11 <> 0 AND event_id % 7 <> 0)""",
    "truth": f"""truth AS (SELECT event_type AS gt_id, {_CLOCK} AS clock, arg_max(user_id % 4 + 1, event_id) AS a,
  arg_max(user_id % 3 + 5, event_id) AS b FROM events GROUP BY 1, 2)""",
    "pred": f"""pred AS (SELECT DISTINCT event_type AS source_file, {_CLOCK} AS clock,
  user_id % 4 + 1 AS a, user_id % 3 + 5 AS b FROM events WHERE event_type <> 'signup' AND event_id % 3 <> 2)""",
    "eval_files": """eval_files AS (SELECT DISTINCT event_type AS source_file,
  CASE event_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'error' WHEN 'error' THEN 'signup' WHEN 'signup' THEN 'purchase'
    ELSE 'click' END AS gt_id FROM events)""",
    "verdicts": """verdicts AS (SELECT coalesce(g.source_file, p.source_file) AS source_file,
  coalesce(g.clock, p.clock) AS clock, g.a AS ta, g.b AS tb, p.a AS pa, p.b AS pb,
  CASE WHEN g.clock IS NULL THEN 'extra' WHEN p.clock IS NULL THEN 'missing'
       WHEN g.a = p.a AND g.b = p.b THEN 'correct' ELSE 'incorrect' END AS verdict
  FROM (SELECT f.source_file, t.* FROM eval_files f JOIN truth t USING (gt_id)) g
  FULL OUTER JOIN pred p ON g.source_file = p.source_file AND g.clock = p.clock)""",
    "counts": """counts AS (SELECT source_file,
  CAST(count(*) FILTER (WHERE verdict = 'correct') AS BIGINT) AS tp,
  CAST(count(*) FILTER (WHERE verdict IN ('extra', 'incorrect')) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE verdict = 'missing') AS BIGINT) AS fn FROM verdicts GROUP BY 1)""",
    "scores": """scores AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score FROM (
  SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall FROM counts))""",
    "contacts": """contacts AS (SELECT l.timestamp, l.objid AS a, r.objid AS b,
  sqrt((l.x - r.x) * (l.x - r.x) + (l.z - r.z) * (l.z - r.z)) AS distance
  FROM traj l JOIN traj r ON l.timestamp = r.timestamp AND l.objid < r.objid
  WHERE (l.x - r.x) * (l.x - r.x) + (l.z - r.z) * (l.z - r.z) < 625)""",
    "mapping": "mapping AS (SELECT printf('obj%03d', n_nationkey + 1) AS objid, n_name AS mapped FROM nation)",
    "runs": """runs AS (SELECT o_orderkey AS run, o_orderstatus AS label, o_totalprice AS wall_clock_s,
  NOT starts_with(o_orderpriority, '5') AS success, o_orderpriority AS error FROM orders)""",
    "base": "base AS (SELECT min(timestamp) AS b FROM traj)",
    "chunked": """chunked AS (SELECT traj.*, CAST(date_diff('second', (SELECT min(timestamp) FROM traj), timestamp) // 21600 AS BIGINT) AS chunk
  FROM traj)""",
    "box": """box AS (SELECT (min(x) + max(x)) / 2 AS cx, (min(z) + max(z)) / 2 AS cz, min(y) + greatest(max(y) - min(y), 3) / 2 AS cy,
  max(x) - min(x) AS sx, greatest(max(y) - min(y), 3) AS sy, max(z) - min(z) AS sz,
  0.05 * least(max(x) - min(x), max(z) - min(z)) AS margin FROM fine)""",
    "stall_runs": """flags AS (SELECT *, coalesce(
    sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w))
      < 6000.0 * greatest(1.0 / 240.0, least(0.1, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1000000.0)) * 0.3,
    false) AS stuck FROM fine WINDOW w AS (PARTITION BY objid ORDER BY timestamp)),
  islands AS (SELECT *, sum(CASE WHEN stuck THEN 0 ELSE 1 END) OVER (PARTITION BY objid ORDER BY timestamp) AS island FROM flags),
  stall_runs AS (SELECT *, CASE WHEN stuck THEN sum(CASE WHEN stuck THEN 1 ELSE 0 END)
    OVER (PARTITION BY objid, island ORDER BY timestamp) ELSE 0 END AS run FROM islands)""",
    "wall_runs": """near AS (SELECT fine.*, least(sx / 2 - abs(x - cx), sz / 2 - abs(z - cz)) AS wall_distance,
    least(sx / 2 - abs(x - cx), sz / 2 - abs(z - cz)) < margin AS near FROM fine CROSS JOIN box),
  wall_islands AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY objid ORDER BY timestamp) AS island FROM near),
  wall_runs AS (SELECT *, CASE WHEN near THEN sum(CASE WHEN near THEN 1 ELSE 0 END)
    OVER (PARTITION BY objid, island ORDER BY timestamp) ELSE 0 END AS run FROM wall_islands)""",
}

# What each CTE reads, so that a query lists only the last ones it needs.
_NEEDS = {
    "frames": ["traj"],
    "located": ["frames", "probes"],
    "verdicts": ["truth", "pred", "eval_files"],
    "counts": ["verdicts"],
    "scores": ["counts"],
    "contacts": ["traj"],
    "base": ["traj"],
    "chunked": ["traj"],
    "box": ["fine"],
    "stall_runs": ["fine"],
    "wall_runs": ["box"],
}


def sql(select: str, *names: str, extra: str = "", recursive: bool = False) -> str:
    """A query over the named views."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [CTES[n] for n in order] + ([extra] if extra else [])
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else ""
    return head + select
