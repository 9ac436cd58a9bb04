"""Every registered query with the DuckDB statement it must equal."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import as_text, sql, ts
from trajlake.functions import answers, clock, ids
from trajlake.functions.clock import MICROS, micros
from trajlake.operators import (
    asof,
    evaluate,
    events,
    frames,
    motion,
    playback,
    proximity,
    stats,
    synth,
    trajectory,
)
from trajlake.plans import flows
from trajlake.session import new_folder, written
from trajlake.sources import files, lake, sinks
from trajlake.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TYPED: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def check(name: str, statement: str | None = None):
    """Register a query; timestamps in its result become text. ``TYPED`` keeps it as it is."""

    def register(fn: Query) -> Query:
        TYPED[name] = fn
        QUERIES[name] = lambda spark, sf: as_text(fn(spark, sf))
        if statement is not None:
            ORACLE[name] = statement
        return fn

    return register


def joined(col: str) -> Column:
    return F.concat_ws(",", F.col(col).cast("array<string>"))


XYZ = ["timestamp", "objid", "x", "y", "z"]
XYZ_SQL = f"{ts('timestamp')} AS timestamp, objid, x, y, z"

# ---- lookups ------------------------------------------------------------------------------


@check(
    "asof_frame",
    sql(
        f"SELECT query_id, {ts('frame_ts')} AS frame_ts, objid, x, y, z FROM located JOIN traj ON timestamp = frame_ts",
        "located",
    ),
)
def asof_frame(spark, sf):
    found = asof.asof_frame(fx.traj(spark, sf), fx.probes(spark, sf))
    return found.select("query_id", "frame_ts", "objid", "x", "y", "z")


@check("last_wins", sql(f"SELECT {XYZ_SQL} FROM traj", "traj"))
def last_wins(spark, sf):
    return asof.last_wins(fx.hourly_rows(spark, sf), "event_id")


@check("frame_times", sql(f"SELECT {ts('frame_ts')} AS timestamp FROM frames", "frames"))
def frame_times(spark, sf):
    return trajectory.frame_list(fx.traj(spark, sf))


@check("first_frame", sql(f"SELECT {XYZ_SQL} FROM traj WHERE timestamp = (SELECT min(timestamp) FROM traj)", "traj"))
def first_frame(spark, sf):
    return trajectory.first_frame(fx.traj(spark, sf))


_HITS = """hits AS (SELECT query_id, probe, last_value(f.frame_ts IGNORE NULLS) OVER (ORDER BY query_id) AS hit_ts
  FROM half LEFT JOIN frames f ON probe = f.frame_ts)"""


@check("last_hit", sql(f"SELECT query_id, {ts('probe')} AS probe, {ts('hit_ts')} AS hit_ts FROM hits", "frames", "half", extra=_HITS))
def last_hit(spark, sf):
    times = asof.frame_times(fx.traj(spark, sf))
    return asof.last_exact_hit(times, fx.half_hour_probes(spark, sf), "query_id", "probe")


@check(
    "lookup_agreement",
    sql(
        """SELECT count(*) AS n_queries, avg(CASE WHEN coalesce(hit_ts, (SELECT min(frame_ts) FROM frames)) = f.frame_ts
           THEN 1.0 ELSE 0.0 END) AS correctness_rate
           FROM hits ASOF LEFT JOIN frames f ON probe >= f.frame_ts""",
        "frames",
        "half",
        extra=_HITS,
    ),
)
def lookup_agreement(spark, sf):
    times = asof.frame_times(fx.traj(spark, sf))
    probes = fx.half_hour_probes(spark, sf)
    exact = asof.with_frame(times, probes, "probe")
    lossy = asof.last_exact_hit(times, probes, "query_id", "probe")
    first = times.agg(F.min("frame_ts")).scalar()
    lossy = lossy.select("query_id", F.coalesce("hit_ts", first).alias("frame_ts"))
    return asof.agreement_rate(exact, lossy, "query_id", "frame_ts")


# ---- trajectory facts ---------------------------------------------------------------------


@check("coord_range", sql("SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM traj", "traj"))
def coord_range(spark, sf):
    return trajectory.coord_range(fx.traj(spark, sf))


@check("time_bounds", sql(f"SELECT {ts('min(timestamp)')} AS start_ts, {ts('max(timestamp)')} AS end_ts FROM fine", "fine"))
def time_bounds(spark, sf):
    return trajectory.time_bounds(fx.fine(spark, sf))


@check("object_ids", sql("SELECT DISTINCT objid FROM traj WHERE objid <> ''", "traj"))
def object_ids(spark, sf):
    return trajectory.object_ids(fx.traj(spark, sf))


@check(
    "object_counts",
    sql(
        """SELECT count(*) AS total_rows, count(DISTINCT objid) AS objects,
           (SELECT count(*) FROM traj WHERE timestamp = (SELECT min(timestamp) FROM traj)) AS first_frame_objects FROM traj""",
        "traj",
    ),
)
def object_counts(spark, sf):
    return trajectory.object_counts(fx.traj(spark, sf))


@check("points_per_object", sql("SELECT objid, count(*) AS points FROM traj GROUP BY 1", "traj"))
def points_per_object(spark, sf):
    return trajectory.points_per_object(fx.traj(spark, sf))


@check("chunk_index", sql(f"SELECT {ts('timestamp')} AS timestamp, objid, chunk FROM chunked", "chunked"))
def chunk_index(spark, sf):
    return trajectory.with_chunk(fx.traj(spark, sf), 21600).select("timestamp", "objid", "chunk")


_CHUNKS = f"""SELECT chunk, {ts('min(timestamp)')} AS start_ts, {ts('max(timestamp)')} AS end_ts, count(*) AS rows,
  printf('chunk_%013d.parquet', epoch_ms(min(timestamp))) AS key FROM chunked GROUP BY chunk"""


@check("chunk_stats", sql(_CHUNKS, "chunked"))
def chunk_stats(spark, sf):
    return trajectory.chunk_stats(trajectory.with_chunk(fx.traj(spark, sf), 21600))


@check(
    "manifest",
    sql(
        f"""SELECT 1 AS version, 'events' AS dataset, CAST(5.0 AS DOUBLE) AS hz, CAST(21600 AS BIGINT) AS chunk_seconds, 'parquet' AS format,
        {ts('min(timestamp)')} AS start, {ts('max(timestamp)')} AS "end", count(*) AS rows, count(DISTINCT objid) AS objects,
        count(DISTINCT chunk) AS chunks, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z,
        max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM chunked""",
        "chunked",
    ),
)
def manifest(spark, sf):
    chunked = trajectory.with_chunk(fx.traj(spark, sf), 21600)
    return trajectory.manifest(chunked, chunk_seconds=21600, hz=5.0, dataset="events")


@check(
    "bounding_box",
    sql(
        """SELECT cx AS center_x, cy AS center_y, cz AS center_z, sx AS size_x, sy AS size_y, sz AS size_z,
           sx / 2 AS half_x, sy / 2 AS half_y, sz / 2 AS half_z, margin AS wall_margin FROM box""",
        "box",
    ),
)
def bounding_box(spark, sf):
    return trajectory.bounding_box(trajectory.coord_range(fx.fine(spark, sf)))


@check(
    "wall_slabs",
    sql(
        """SELECT 'Floor' AS wall, cx AS center_x, cy - sy / 2 - 0.5 AS center_y, cz AS center_z, sx AS size_x, 1.0::DOUBLE AS size_y, sz AS size_z FROM box
           UNION ALL SELECT 'North', cx, cy, cz + (sz / 2 + 0.5), sx, sy, 1.0 FROM box
           UNION ALL SELECT 'South', cx, cy, cz - (sz / 2 + 0.5), sx, sy, 1.0 FROM box
           UNION ALL SELECT 'East', cx + (sx / 2 + 0.5), cy, cz, 1.0, sy, sz FROM box
           UNION ALL SELECT 'West', cx - (sx / 2 + 0.5), cy, cz, 1.0, sy, sz FROM box""",
        "box",
    ),
)
def wall_slabs(spark, sf):
    return trajectory.wall_slabs(trajectory.bounding_box(trajectory.coord_range(fx.fine(spark, sf))))


@check("contact_distance", "SELECT 2.2::DOUBLE * max(CAST(p_size AS DOUBLE)) AS contact_distance FROM part")
def contact_distance(spark, sf):
    return trajectory.contact_distance(fx.table(spark, sf, "part").select(F.col("p_size").cast("double").alias("radius")))


@check(
    "range_scan",
    f"""SELECT {ts('ts')} AS timestamp, event_id, value FROM events
        WHERE ts BETWEEN TIMESTAMP '2024-01-08 06:00:00' AND TIMESTAMP '2024-01-19 18:30:00'""",
)
def range_scan(spark, sf):
    rows = fx.events(spark, sf).select(F.col("ts").alias("timestamp"), "event_id", "value")
    return trajectory.range_scan(rows, dt.datetime(2024, 1, 8, 6), dt.datetime(2024, 1, 19, 18, 30))


@check("mapped_objects", sql(f"SELECT {XYZ_SQL}, mapped FROM traj JOIN mapping USING (objid)", "traj", "mapping"))
def mapped_objects(spark, sf):
    return trajectory.objects_in_frame(fx.traj(spark, sf), fx.mapping(spark, sf)).select(*XYZ, "mapped")


# ---- scalars ------------------------------------------------------------------------------


@check(
    "parse_ts",
    f"""SELECT event_id, CASE event_type WHEN 'error' THEN NULL
          WHEN 'view' THEN {ts("date_trunc('second', ts)")}
          ELSE {ts("ts")} END AS timestamp FROM events""",
)
def parse_ts(spark, sf):
    forms = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("at "), F.date_format("ts", "HH:mm")))
        .when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(F.col("event_type") == "signup", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(F.concat(F.lit("  "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" ")))
    )
    return fx.events(spark, sf).select("event_id", clock.parse_ts(forms).alias("timestamp"))


@check("format_ts", f"SELECT event_id, {ts('ts')} AS text FROM events")
def format_ts(spark, sf):
    return fx.events(spark, sf).select("event_id", clock.format_ts("ts").alias("text"))


@check(
    "epoch_ms",
    """SELECT event_id, CAST(CASE WHEN m % 1000 > 500 OR (m % 1000 = 500 AND (m // 1000) % 2 = 1) THEN m // 1000 + 1
         ELSE m // 1000 END AS BIGINT) AS ms FROM (SELECT event_id, epoch_us(ts) AS m FROM events)""",
)
def epoch_ms(spark, sf):
    return fx.events(spark, sf).select("event_id", clock.epoch_ms("ts").alias("ms"))


@check("objid_format", "SELECT event_id, printf('obj%03d', event_id) AS objid FROM events")
def objid_format(spark, sf):
    return fx.events(spark, sf).select("event_id", ids.objid_from_number("event_id").alias("objid"))


@check(
    "objid_number",
    """SELECT c_custkey, CAST(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS VARCHAR) AS number,
       c_mktsegment AS segment FROM customer""",
)
def objid_number(spark, sf):
    return fx.table(spark, sf, "customer").select(
        "c_custkey", ids.objid_number("c_name").alias("number"), ids.objid_number("c_mktsegment").alias("segment")
    )


@check(
    "label_id",
    """SELECT p_partkey, CAST(nullif(regexp_extract(p_brand || '#' || p_partkey, '([0-9]{3})$', 1), '') AS INTEGER) AS label FROM part""",
)
def label_id(spark, sf):
    name = F.concat_ws("#", "p_brand", "p_partkey")
    return fx.table(spark, sf, "part").select("p_partkey", ids.label_id(name).alias("label"))


@check(
    "fence_strip",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(text, E' \\n\\t\\r') ELSE trim(text, E' \\n\\t\\r') END AS body FROM documents""",
)
def fence_strip(spark, sf):
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))
    text = F.when(F.col("doc_id") % 2 == 0, fenced).otherwise(F.col("text"))
    return fx.table(spark, sf, "documents").select("doc_id", answers.strip_fence(text).alias("body"))


@check(
    "list_in_prose",
    f"""SELECT doc_id, coalesce(nullif(regexp_extract(prose, '{answers.LIST_IN_PROSE}', 1), ''), prose) AS found FROM (
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' [{{"a": [' || doc_id || ']}}, {{"b": []}}] ' || text ELSE text END AS prose FROM documents)""",
)
def list_in_prose(spark, sf):
    """Every third document has a list of objects in its middle."""
    held = F.concat("text", F.lit(' [{"a": ['), F.col("doc_id").cast("string"), F.lit(']}, {"b": []}] '), "text")
    prose = F.when(F.col("doc_id") % 3 == 0, held).otherwise(F.col("text"))
    return fx.table(spark, sf, "documents").select("doc_id", answers.list_in_prose(prose).alias("found"))


@check(
    "parse_content",
    """SELECT event_id, CAST(CASE WHEN event_id % 11 = 0 THEN -1 WHEN event_id % 7 = 0 THEN 0 ELSE 2 END AS INTEGER) AS items,
       CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN '' ELSE strftime(ts, '%H:%M:%S') || ' ' || (user_id % 4 + 1) || ',' || (user_id % 3 + 5) END AS first
       FROM events""",
)
def parse_content(spark, sf):
    parsed = events.parsed(fx.responses(spark, sf))
    entry = F.get(F.map_entries(F.get("items", F.lit(0))), F.lit(0))
    first = F.concat_ws(" ", entry["key"], F.concat_ws(",", entry["value"].cast("array<string>")))
    return parsed.select("event_id", F.coalesce(F.size("items"), F.lit(-1)).alias("items"), first.alias("first"))


@check("quarantine", "SELECT event_id, 'no overlap was found' AS content FROM events WHERE event_id % 11 = 0")
def quarantine(spark, sf):
    return events.quarantine(fx.responses(spark, sf)).select("event_id", "content")


_BOUNDS = "(SELECT min(ts) FROM events)", "(SELECT max(ts) FROM events)"


def _bounds(spark, sf):
    ev = fx.events(spark, sf)
    return ev.agg(F.min("ts")).scalar(), ev.agg(F.max("ts")).scalar()


@check(
    "progress",
    f"""SELECT event_id, least(1.0, greatest(0.0, CAST(epoch_us(ts + to_hours(event_id % 97 - 48)) - epoch_us({_BOUNDS[0]}) AS DOUBLE)
        / (epoch_us({_BOUNDS[1]}) - epoch_us({_BOUNDS[0]})))) AS progress FROM events""",
)
def progress(spark, sf):
    start, end = _bounds(spark, sf)
    at = F.col("ts") + F.make_dt_interval(hours=F.col("event_id") % 97 - 48)
    return fx.events(spark, sf).select("event_id", clock.progress(at, start, end).alias("progress"))


@check(
    "seek_progress",
    f"""SELECT event_id, {ts(f'''make_timestamp(CAST(epoch_us({_BOUNDS[0]}) + round_even((epoch_us({_BOUNDS[1]}) - epoch_us({_BOUNDS[0]}))
          * least(1.0, greatest(0.0, ((event_id * 7919) % 1400 - 200) / 1000.0::DOUBLE)), 0) AS BIGINT))''')} AS at FROM events""",
)
def seek_progress(spark, sf):
    start, end = _bounds(spark, sf)
    share = (F.pmod(F.col("event_id") * 7919, F.lit(1400)) - 200) / F.lit(1000.0)
    return fx.events(spark, sf).select("event_id", clock.seek_progress(share, start, end).alias("at"))


@check(
    "seek_clamp",
    f"""SELECT event_id, {ts(f'greatest({_BOUNDS[0]}, least(ts + to_hours(event_id % 97 - 48), {_BOUNDS[1]}))')} AS at FROM events""",
)
def seek_clamp(spark, sf):
    start, end = _bounds(spark, sf)
    at = F.col("ts") + F.make_dt_interval(hours=F.col("event_id") % 97 - 48)
    return fx.events(spark, sf).select("event_id", clock.seek_clamp(at, start, end).alias("at"))


@check(
    "playback_speed",
    """SELECT event_id, greatest(-10.0, least(10.0, CASE WHEN abs(s) < 0.001 THEN 1.0 ELSE s END)) AS speed
       FROM (SELECT event_id, CAST((event_id % 61 - 30) / 2.0 AS DOUBLE) AS s FROM events)""",
)
def playback_speed(spark, sf):
    s = (F.col("event_id") % 61 - 30) / F.lit(2.0)
    return fx.events(spark, sf).select("event_id", clock.playback_speed(s).alias("speed"))


@check(
    "duration_parse",
    """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN value * 1.0 WHEN 'view' THEN value * 60.0
       WHEN 'purchase' THEN value * 3600.0 ELSE value END AS seconds FROM events""",
)
def duration_parse(spark, sf):
    unit = (
        F.when(F.col("event_type") == "error", " days")
        .when(F.col("event_type") == "click", "s")
        .when(F.col("event_type") == "view", "MIN ")
        .when(F.col("event_type") == "purchase", "h")
        .otherwise("")
    )
    text = F.concat(F.col("value").cast("string"), unit)
    return fx.events(spark, sf).select("event_id", clock.duration_seconds(text).alias("seconds"))


@check(
    "video_time",
    sql(
        f"""SELECT {ts('timestamp')} AS timestamp, objid, epoch_us(timestamp) - epoch_us((SELECT min(timestamp) FROM fine)) AS data_us,
            CAST(epoch_us(timestamp) - epoch_us((SELECT min(timestamp) FROM fine)) AS DOUBLE) / 1000000.0 / 3.0 AS video_s FROM fine""",
        "fine",
    ),
)
def video_time(spark, sf):
    rows = fx.fine(spark, sf)
    start = rows.agg(F.min("timestamp")).scalar()
    timed = rows.withColumn("video_s", clock.video_time("timestamp", start, 3.0))
    back = micros(clock.data_time("video_s", start, 3.0)) - micros(start)
    return timed.select("timestamp", "objid", back.alias("data_us"), "video_s")


_VIEW = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [-280.0, -50.0, -250.5, 1.0]]
_PROJ = [[1.5, 0.0, 0.0, 0.0], [0.0, 2.0, 0.0, 0.0], [0.0, 0.0, -1.5, -1.0], [0.0, 0.0, -2.5, 0.0]]


@check(
    "project_pixels",
    sql(
        f"""SELECT {ts('timestamp')} AS timestamp, objid,
          CAST(trunc(360.0 + (((x - 280.0) * 1.5 / (250.5 - z) * 0.5 + 0.5) * 720.0 - 360.0) * 1.1::DOUBLE) AS BIGINT) AS px,
          CAST(trunc(240.0 + ((1.0 - ((y - 50.0) * 2.0 / (250.5 - z) * 0.5 + 0.5)) * 480.0 - 240.0) * 1.1::DOUBLE) AS BIGINT) AS py
          FROM traj WHERE z - 250.5 < 0""",
        "traj",
    ),
)
def project_pixels(spark, sf):
    seen = frames.project_pixels(fx.traj(spark, sf), _VIEW, _PROJ, scale=1.1)
    return seen.select("timestamp", "objid", "px", "py")


@check(
    "headings",
    sql(
        f"""SELECT {ts('timestamp')} AS timestamp, objid,
          CASE WHEN (cx - x) * (cx - x) + (cz - z) * (cz - z) > 1e-12 THEN round(cos(atan2(cz - z, cx - x)), 6) END AS heading_a,
          CASE WHEN (cx - x) * (cx - x) + (cz - z) * (cz - z) > 1e-12 THEN round(sin(atan2(cz - z, cx - x)), 6) END AS heading_b
          FROM fine CROSS JOIN box""",
        "box",
    ),
)
def headings(spark, sf):
    rows = fx.fine(spark, sf)
    box = trajectory.bounding_box(trajectory.coord_range(rows))
    found = motion.headings_to_center(rows, box)
    return found.select(
        "timestamp", "objid", F.round("heading_a", 6).alias("heading_a"), F.round("heading_b", 6).alias("heading_b")
    )


# ---- files and sinks ----------------------------------------------------------------------


@check("scan_csv", sql(f"SELECT {XYZ_SQL} FROM fine", "fine"))
def scan_csv(spark, sf):
    path = new_folder(spark, "scan") + ".csv"
    sink = fx.fine(spark, sf).withColumn("timestamp", clock.format_ts("timestamp"))
    sink.write.csv(path, header=True)
    return files.read_trajectory(spark, path).select(*XYZ)


@check("scan_parquet", sql(f"SELECT {XYZ_SQL} FROM fine", "fine"))
def scan_parquet(spark, sf):
    path = new_folder(spark, "scan") + ".parquet"
    fx.fine(spark, sf).write.parquet(path)
    return files.read_trajectory(spark, path).select(*XYZ)


@check(
    "scan_rejects",
    "SELECT user_id, event_id FROM events WHERE event_type IN ('error', 'view')",
)
def scan_rejects(spark, sf):
    path = new_folder(spark, "rejects") + ".csv"
    e = fx.events(spark, sf)
    bad_time, bad_number = F.col("event_type") == "error", F.col("event_type") == "view"
    e.select(
        F.when(bad_time, "yesterday").otherwise(clock.format_ts("ts")).alias("timestamp"),
        F.col("user_id").cast("string").alias("objid"),
        F.when(bad_number, "n/a").otherwise(F.col("value").cast("string")).alias("x"),
        F.lit("0").alias("y"),
        F.col("event_id").cast("string").alias("z"),
    ).write.csv(path, header=True)
    rejects = files.trajectory_rejects(spark, path)
    return rejects.select(F.col("objid").cast("bigint").alias("user_id"), F.col("z").cast("bigint").alias("event_id"))


_DELIMITED = """counted AS (SELECT doc_id, text,
   [length(text) - length(replace(text, chr(9), '')), length(text) - length(replace(text, ',', '')),
    length(text) - length(replace(text, ';', '')), length(text) - length(replace(text, '|', '')),
    length(text) - length(replace(text, ' ', ''))] AS n FROM documents),
  sniffed AS (SELECT doc_id, text, list_max(n) AS occurrences,
   [chr(9), ',', ';', '|', ' '][list_position(n, list_max(n))] AS delimiter FROM counted)"""


@check("sniff_delimiter", sql("SELECT doc_id, delimiter, CAST(occurrences AS BIGINT) AS occurrences FROM sniffed", extra=_DELIMITED))
def sniff_delimiter(spark, sf):
    return files.sniff_delimiter(fx.table(spark, sf, "documents"), "doc_id", "text")


@check(
    "delimited_cells",
    sql(
        r"""SELECT doc_id, count(DISTINCT line_no) AS lines, count(*) AS cells,
        CAST(sum(length(trim(cell, E' \n\t\r'))) AS BIGINT) AS chars
        FROM (SELECT doc_id, line_no, unnest(CASE WHEN delimiter = ' ' THEN regexp_split_to_array(line, '\s+')
          ELSE string_split(line, delimiter) END) AS cell
          FROM (SELECT doc_id, delimiter, trim(unnest(string_split(text, chr(10))), E' \n\t\r') AS line,
                generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM sniffed) WHERE line <> '') GROUP BY 1""",
        extra=_DELIMITED,
    ),
)
def delimited_cells(spark, sf):
    lines = fx.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    cells = files.delimited_cells(lines, "doc_id")
    chars = F.aggregate("cells", F.lit(0), lambda n, c: n + F.length(c))
    return cells.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.sum(F.size("cells")).alias("cells"), F.sum(chars).alias("chars")
    )


_LIST = """'[{"' || strftime(ts, '%H:%M:%S') || '": [' || (user_id % 4 + 1) || ', ' || (user_id % 3 + 5) || ']}, {"' ||
  strftime(ts, '%H:%M') || ':00": []}]'"""
_ANSWER = f"""CASE WHEN event_id % 11 = 0 THEN 'no overlap was found' WHEN event_id % 7 = 0 THEN '[]'
  WHEN event_id % 5 = 0 THEN '```json' || chr(10) || {_LIST} || chr(10) || '```' WHEN event_id % 5 = 1 THEN 'Here are the events: ' || {_LIST} || ' done.'
  WHEN event_id % 5 = 2 THEN replace({_LIST}, '"', chr(39)) WHEN event_id % 5 = 3 THEN '{{"events": ' || {_LIST} || '}}' ELSE {_LIST} END"""


def _write_responses(spark, sf) -> str:
    path = new_folder(spark, "responses")
    sinks.write_json(fx.documents(spark, sf), path)
    return path


@check(
    "response_chunks",
    f"""SELECT CAST(event_id AS VARCHAR) AS id, event_type AS model, value AS execution_time, CAST(p AS INTEGER) AS chunk_pos,
          CASE p WHEN 1 THEN '[]' ELSE {_ANSWER} END AS content FROM events, (VALUES (0), (1)) v(p)""",
)
def response_chunks(spark, sf):
    documents = files.read_responses(spark, _write_responses(spark, sf), multiline=False)
    return files.response_chunks(documents).select("id", "model", "execution_time", "chunk_pos", "content")


def _list_lines(spark, sf):
    """Event list lines in event order: some lack the position, some an axis."""
    position = F.when(
        F.col("event_type") != "error",
        F.struct(
            F.col("value").alias("x"),
            F.when(F.col("event_type") != "view", F.col("user_id").cast("double")).alias("y"),
            F.col("event_id").cast("double").alias("z"),
        ),
    )
    return fx.events(spark, sf).select(
        "event_id",
        clock.format_ts(F.date_trunc("HOUR", "ts").cast("timestamp_ntz")).alias("timestamp"),
        ids.objid_from_number(F.col("user_id") + 1).alias("objid"),
        position.alias("position"),
    )


def _write_event_list(spark, sf, folder: str) -> str:
    path = f"{folder}/run_eventlist.jsonl"
    _list_lines(spark, sf).orderBy("event_id").drop("event_id").write.json(path)
    return path


@check(
    "event_list_read",
    f"""SELECT {ts("date_trunc('hour', ts)")} AS timestamp, printf('obj%03d', user_id + 1) AS objid, value AS x,
        CASE WHEN event_type = 'view' THEN 0.0 ELSE CAST(user_id AS DOUBLE) END AS y, CAST(event_id AS DOUBLE) AS z
        FROM events WHERE event_type <> 'error'""",
)
def event_list_read(spark, sf):
    path = _write_event_list(spark, sf, new_folder(spark, "lists"))
    return events.event_list(files.read_event_list(spark, path)).drop("ordinal")


@check(
    "event_list_positions",
    f"""SELECT {ts("date_trunc('hour', ts)")} AS timestamp, arg_max(value, event_id) AS x,
        arg_max(CASE WHEN event_type = 'view' THEN 0.0 ELSE CAST(user_id AS DOUBLE) END, event_id) AS y,
        arg_max(CAST(event_id AS DOUBLE), event_id) AS z
        FROM events WHERE event_type <> 'error' GROUP BY 1""",
)
def event_list_positions(spark, sf):
    path = _write_event_list(spark, sf, new_folder(spark, "lists"))
    return events.event_list_positions(events.event_list(files.read_event_list(spark, path)))


@check("latest_file", "SELECT 'later_eventlist.jsonl' AS name")
def latest_file(spark, sf):
    folder = new_folder(spark, "lists")
    _write_event_list(spark, sf, folder)
    newer = f"{folder}/later_eventlist.jsonl"
    sinks.write_event_list(fx.traj(spark, sf), newer)
    return files.latest_file(spark, folder).select(F.regexp_extract("uri", "([^/]+)$", 1).alias("name"))


def _lake(spark, sf, fmt="parquet") -> str:
    return lake.write_lake(
        fx.traj(spark, sf), new_folder(spark, "lake"), chunk_seconds=21600, hz=5.0, dataset="events", fmt=fmt
    )


@check("list_files", sql("SELECT DISTINCT 'chunk=' || chunk AS chunk, true AS filled FROM chunked", "chunked"))
def list_files(spark, sf):
    """The rows of the lake in a folder per chunk, listed."""
    path = new_folder(spark, "parted")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lake.read_lake(spark, _lake(spark, sf)).repartition(parts, "chunk").write.partitionBy("chunk").parquet(path)
    found = files.list_files(spark, path, glob="*.parquet")
    # Rows without an instant have no chunk.
    number = F.regexp_extract("uri", "chunk=([^/]+)", 1).try_cast("bigint")
    return found.select(F.concat(F.lit("chunk="), number).alias("chunk"), (F.col("size") > 0).alias("filled")).distinct()


@check(
    "file_stat",
    """SELECT 'event_type=' || event_type AS name, true AS found, true AS filled, count(*) AS asked FROM events GROUP BY 1
       UNION ALL SELECT 'event_type=none/part', false, false, 1""",
)
def file_stat(spark, sf):
    """A path for every event, that of its type's folder, and one that is missing."""
    path = new_folder(spark, "parted")
    fx.events(spark, sf).write.partitionBy("event_type").parquet(path)
    names = fx.events(spark, sf).select(F.concat(F.lit("event_type="), "event_type").alias("name"))
    names = names.unionAll(spark.range(1).select(F.lit("event_type=none/part")))
    found = files.file_stat(spark, path, names.withColumn("uri", F.concat(F.lit(f"{path}/"), "name")))
    filled = (F.coalesce("size", F.lit(0)) > 0).alias("filled")
    return found.groupBy("name", "found", filled).agg(F.count("*").alias("asked"))


@check("lake_scan", sql(f"SELECT {XYZ_SQL}, chunk FROM chunked", "chunked"))
def lake_scan(spark, sf):
    return lake.read_lake(spark, _lake(spark, sf)).select(*XYZ, "chunk")


@check("lake_roundtrip", sql(_CHUNKS.replace(".parquet'", ".csv'"), "chunked"))
def lake_roundtrip(spark, sf):
    return trajectory.chunk_stats(lake.read_lake(spark, _lake(spark, sf, "csv")), "csv")


@check(
    "lake_export",
    sql(
        f"""SELECT printf('chunk_%013d.csv', epoch_ms(min(timestamp))) AS key, {ts('min(timestamp)')} AS start, {ts('max(timestamp)')} AS last,
            count(*) AS rows, count(*) AS found, max(x) AS x,
            (SELECT string_agg(DISTINCT objid, ',' ORDER BY objid) FROM traj) AS objids
            FROM traj GROUP BY date_diff('second', (SELECT min(timestamp) FROM traj), timestamp) // 86400""",
        "traj",
    ),
)
def lake_export(spark, sf):
    """What others' tools read: the document's chunks, and what each of its files holds."""
    root = lake.write_lake(fx.traj(spark, sf), new_folder(spark, "lake"), chunk_seconds=86400)
    target = new_folder(spark, "single")
    doc = lake.read_manifest_document(spark, lake.export_lake(spark, root, target))
    # The folder is listed as one: a path per file would cost a task each, and so would the columns, were they looked up.
    text = spark.read.schema(", ".join(f"{c} string" for c in XYZ)).option("header", True).option("pathGlobFilter", "chunk_*.csv").csv(target)
    held = text.groupBy(F.col("_metadata.file_name").alias("key")).agg(F.count("*").alias("found"), F.max(F.col("x").cast("double")).alias("x"))
    rows = doc.select(F.inline("chunks")).join(held, "key").select("key", "start", F.col("end").alias("last"), "rows", "found", "x")
    # All ids of the document stand in every row, so they come last: nothing deals out or keeps a copy per chunk.
    return rows.crossJoin(F.broadcast(doc.select(F.array_join("objids", ",").alias("objids"))))


@check(
    "lake_range",
    sql(
        f"""SELECT {XYZ_SQL}, chunk FROM chunked
            WHERE timestamp BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-03 12:00:00'""",
        "chunked",
    ),
)
def lake_range(spark, sf):
    rows = lake.read_lake(spark, _lake(spark, sf), start=dt.datetime(2024, 1, 2), end=dt.datetime(2024, 1, 3, 12))
    return rows.select(*XYZ, "chunk")


def _micro_rows(spark, sf):
    """Rows at microseconds, the first one 600 after a full millisecond."""
    e = fx.events(spark, sf)
    at = F.lit(1_704_067_200_000_600) + F.col("event_id") * F.lit(5_999_990)
    return fx.as_positions(e, clock.from_micros(at))


@check(
    "lake_range_border",
    """SELECT event_id AS n, (event_id * 5999990) // 60000000 AS chunk FROM events
       WHERE event_id * 5999990 BETWEEN 59999500 - 600 AND 600000000 - 600""",
)
def lake_range_border(spark, sf):
    """A range whose ends lie less than a millisecond from chunk borders."""
    root = lake.write_lake(_micro_rows(spark, sf).drop("event_id"), new_folder(spark, "lake"), chunk_seconds=60)
    start = dt.datetime(2024, 1, 1, 0, 0, 59, 999500)
    rows = lake.read_lake(spark, root, start=start, end=dt.datetime(2024, 1, 1, 0, 10))
    n = (micros("timestamp") - F.lit(1_704_067_200_000_600)) / F.lit(5_999_990)
    return rows.select(n.cast("bigint").alias("n"), "chunk")


@check(
    "chunk_for_time",
    sql(
        f"""SELECT query_id, {ts('probe')} AS probe, coalesce(s.chunk, 0) AS chunk FROM probes p
            ASOF LEFT JOIN (SELECT chunk, min(timestamp) AS start FROM chunked GROUP BY 1) s ON p.probe >= s.start""",
        "chunked",
        "probes",
    ),
)
def chunk_for_time(spark, sf):
    return lake.chunk_for_time(lake.read_chunks(spark, _lake(spark, sf)), fx.probes(spark, sf))


_ASOF_LAKE = sql(
    f"SELECT query_id, {ts('frame_ts')} AS frame_ts, objid, x, y, z FROM located JOIN traj ON timestamp = frame_ts", "located"
)


@check("asof_lake", _ASOF_LAKE)
def asof_lake(spark, sf):
    root = _lake(spark, sf)
    found = lake.asof_lake(spark, root, fx.probes(spark, sf))
    return found.select("query_id", "frame_ts", "objid", "x", "y", "z")


@check("lake_replay", _ASOF_LAKE)
def lake_replay(spark, sf):
    found = flows.ingest_and_look_up(
        fx.traj(spark, sf), new_folder(spark, "lake"), fx.probes(spark, sf), chunk_seconds=86400
    )
    return found.select("query_id", "frame_ts", "objid", "x", "y", "z")


_TRACE = "printf('%.3f', x) AS x, printf('%.3f', y) AS y, printf('%.3f', z) AS z"


@check("trace_format", sql(f"SELECT {ts('timestamp')} AS timestamp, objid, {_TRACE} FROM fine", "fine"))
def trace_format(spark, sf):
    path = new_folder(spark, "trace") + ".csv"
    sinks.write_trace(fx.fine(spark, sf), path)
    return spark.read.csv(path, header=True)


@check("response_archive", f"SELECT event_id, event_type AS model, 'user' || user_id AS video, value AS execution_time, {_ANSWER} AS content FROM events")
def response_archive(spark, sf):
    path = new_folder(spark, "archive")
    e = fx.events(spark, sf).select("event_id", F.concat(F.lit("user"), "user_id").alias("video"))
    sinks.archive_responses(fx.responses(spark, sf).join(e, "event_id").drop("day"), path)
    return spark.read.json(path).select("event_id", "model", "video", "execution_time", "content")


# ---- events -------------------------------------------------------------------------------


def _mentions(spark, sf):
    return events.mentions(fx.responses(spark, sf), "event_id")


def _dated_mentions(spark, sf):
    return events.mentions(fx.responses(spark, sf), "event_id", base_date=F.col("day"))


@check("event_mentions", sql("SELECT event_id AS chunk_pos, timestamp, array_to_string(grp, ',') AS grp FROM mentions", "mentions"))
def event_mentions(spark, sf):
    return _mentions(spark, sf).select("chunk_pos", "timestamp", joined("grp").alias("grp"))


_GROUPS = """lists AS (SELECT timestamp, row_number() OVER (PARTITION BY timestamp ORDER BY event_id) - 1 AS group_no,
  array_to_string(grp, ',') AS grp FROM mentions)"""


@check("events_consolidated", sql("SELECT * FROM lists", "mentions", extra=_GROUPS))
def events_consolidated(spark, sf):
    return events.consolidated(_mentions(spark, sf)).select("timestamp", "group_no", joined("grp").alias("grp"))


@check(
    "events_jsonl",
    sql("""SELECT '{"' || timestamp || '":[["' || array_to_string(grp, '","') || '"]]}' AS value FROM mentions""", "mentions"),
)
def events_jsonl(spark, sf):
    path = new_folder(spark, "events") + ".jsonl"
    sinks.write_events(events.consolidated(_mentions(spark, sf)), path)
    return spark.read.text(path)


@check(
    "event_stats",
    sql(
        """SELECT count(DISTINCT timestamp) AS timestamps, count(*) AS event_groups, min(timestamp) AS first_event,
           max(timestamp) AS last_event, (SELECT count(DISTINCT o) FROM (SELECT unnest(grp) AS o FROM mentions)) AS objects FROM mentions""",
        "mentions",
    ),
)
def event_stats(spark, sf):
    return events.event_stats(_mentions(spark, sf))


_KEYS = """keys AS (SELECT day_timestamp AS timestamp, arg_min(grp[1], event_id) AS objid FROM mentions GROUP BY 1),
  placed AS (SELECT k.timestamp, k.objid, f.frame_ts FROM (SELECT *, CAST(timestamp AS TIMESTAMP) AS probe FROM keys) k
    ASOF JOIN frames f ON k.probe >= f.frame_ts)"""

_POSITIONS = "SELECT p.timestamp, p.objid, t.x, t.y, t.z FROM placed p JOIN traj t ON t.timestamp = p.frame_ts AND t.objid = p.objid"


@check("event_positions", sql(_POSITIONS, "frames", "mentions", extra=_KEYS))
def event_positions(spark, sf):
    return events.event_positions(_dated_mentions(spark, sf), fx.traj(spark, sf))


@check("event_flow", sql(_POSITIONS, "frames", "mentions", extra=_KEYS))
def event_flow(spark, sf):
    return flows.answers_to_event_list(fx.responses(spark, sf), "event_id", fx.traj(spark, sf), base_date=F.col("day"))


@check(
    "event_unmatched",
    sql(
        """SELECT p.timestamp, p.objid FROM placed p
           WHERE NOT EXISTS (SELECT 1 FROM traj t WHERE t.timestamp = p.frame_ts AND t.objid = p.objid)""",
        "frames",
        "mentions",
        extra=_KEYS,
    ),
)
def event_unmatched(spark, sf):
    return events.event_unmatched(_dated_mentions(spark, sf), fx.traj(spark, sf))


@check("event_list_jsonl", sql(f"SELECT timestamp, objid, x, y, z FROM ({_POSITIONS})", "frames", "mentions", extra=_KEYS))
def event_list_jsonl(spark, sf):
    path = new_folder(spark, "list") + "_eventlist.jsonl"
    sinks.write_event_list(event_positions(spark, sf), path)
    return events.event_list(files.read_event_list(spark, path)).drop("ordinal")


@check(
    "event_summary",
    sql(
        """SELECT CAST(e.event_id AS VARCHAR) AS source_id, event_type AS model, value AS execution_time,
           CAST(count(m.event_id) AS BIGINT) AS total_timestamps, CAST(count(m.event_id) AS BIGINT) AS total_groups,
           CASE WHEN count(m.event_id) = 0 THEN '{}' ELSE '{"' || any_value(m.timestamp) || '":[["' || array_to_string(any_value(grp), '","') || '"]]}' END AS events
           FROM events e LEFT JOIN mentions m USING (event_id) GROUP BY e.event_id, event_type, value""",
        "mentions",
    ),
)
def event_summary(spark, sf):
    return flows.event_summary(files.read_responses(spark, _write_responses(spark, sf), multiline=False))


# ---- replay -------------------------------------------------------------------------------

_NEXT = """nexts AS (SELECT event_id AS ordinal, ts AS event_ts,
  coalesce(lead(ts) OVER (ORDER BY event_id), (SELECT arg_min(ts, event_id) FROM events)) AS next_ts FROM events)"""


def _event_list(spark, sf):
    return fx.events(spark, sf).select(F.col("event_id").alias("ordinal"), F.col("ts").alias("event_ts"))


@check("next_event", sql(f"SELECT ordinal, {ts('event_ts')} AS event_ts, {ts('next_ts')} AS next_ts FROM nexts", extra=_NEXT))
def next_event(spark, sf):
    return playback.next_event(_event_list(spark, sf), time="event_ts")


_CLIPS = """clips AS (SELECT e.event_id AS ordinal, frame_ts FROM
   (SELECT event_id, greatest((SELECT min(frame_ts) FROM frames), least(ts, (SELECT max(frame_ts) FROM frames))) AS s FROM events) e
   JOIN frames f ON f.frame_ts >= e.s AND f.frame_ts < e.s + INTERVAL 90 MINUTE)"""


@check(
    "event_clips",
    sql(
        f"SELECT ordinal, {ts('frame_ts')} AS frame_ts, objid, x, y, z FROM clips JOIN traj ON timestamp = frame_ts",
        "frames",
        extra=_CLIPS,
    ),
)
def event_clips(spark, sf):
    found = playback.event_clips(fx.traj(spark, sf), _event_list(spark, sf), seconds=5400)
    return found.select("ordinal", "frame_ts", F.col("shown_objid").alias("objid"), "x", "y", "z")


@check(
    "summary_replay",
    sql(
        f"""SELECT n.ordinal, {ts('n.next_ts')} AS next_ts, {ts('frame_ts')} AS frame_ts, count(*) AS objects
            FROM nexts n JOIN
            (SELECT event_id, greatest((SELECT min(frame_ts) FROM frames), least(date_trunc('second', ts), (SELECT max(frame_ts) FROM frames))) AS s FROM events) e
              ON n.ordinal = e.event_id
            JOIN frames f ON f.frame_ts >= e.s AND f.frame_ts < e.s + INTERVAL 1 HOUR JOIN traj ON timestamp = frame_ts
            WHERE n.ordinal <= (SELECT min(event_id) FROM events WHERE date_trunc('second', ts) + INTERVAL 1 HOUR >= (SELECT max(frame_ts) FROM frames))
            GROUP BY ALL""",
        "frames",
        extra=_NEXT.replace("ts AS event_ts", "date_trunc('second', ts) AS event_ts")
        .replace("lead(ts)", "lead(date_trunc('second', ts))")
        .replace("arg_min(ts, event_id)", "arg_min(date_trunc('second', ts), event_id)"),
    ),
)
def summary_replay(spark, sf):
    lines = fx.events(spark, sf).select(
        F.col("event_id").alias("line_no"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        ids.objid_from_number(F.col("user_id") + 1).alias("objid"),
        F.struct(F.col("value").alias("x"), F.col("value").alias("y"), F.col("value").alias("z")).alias("position"),
    )
    shown = flows.summary_replay(fx.traj(spark, sf), lines, seconds=3600)
    return shown.groupBy("ordinal", "next_ts", "frame_ts").agg(F.count("*").alias("objects"))


_SPEED = "greatest(-10.0, least(10.0, CASE WHEN user_id % 21 = 10 THEN 1.0 ELSE CAST(user_id % 21 - 10 AS DOUBLE) END))"


def _ticks_sql(seconds: int) -> str:
    return f"""paced AS (SELECT *, {_SPEED} AS s, epoch_us(start_ts) AS a, epoch_us(end_ts) AS e FROM users),
  stepped AS (SELECT *, CAST({seconds * MICROS} * abs(s) AS BIGINT) AS step FROM paced),
  ticks AS (SELECT user_id, tick, make_timestamp(CASE WHEN s > 0 THEN least(a + (tick + 1) * step, e) ELSE greatest(e - (tick + 1) * step, a) END) AS tick_ts
    FROM (SELECT *, unnest(generate_series(0, greatest(1, CAST(ceil((e - a) / step) AS BIGINT)) - 1)) AS tick FROM stepped))"""


def _ranges(spark, sf):
    return fx.users(spark, sf).withColumn("speed", F.col("user_id") % 21 - 10)


@check("playback_ticks", sql(f"SELECT user_id, tick, {ts('tick_ts')} AS tick_ts FROM ticks", "users", extra=_ticks_sql(3600)))
def playback_ticks(spark, sf):
    ticks = playback.playback_ticks(_ranges(spark, sf), update_seconds=3600)
    return ticks.select("user_id", "tick", "tick_ts")


@check(
    "resample",
    sql(
        f"""SELECT user_id, {ts('tick_ts')} AS tick_ts, {ts('frame_ts')} AS frame_ts, objid, x, z
            FROM (SELECT t.user_id, t.tick_ts, coalesce(f.frame_ts, (SELECT min(frame_ts) FROM frames)) AS frame_ts
                  FROM ticks t ASOF LEFT JOIN frames f ON t.tick_ts >= f.frame_ts)
            JOIN traj ON timestamp = frame_ts""",
        "users",
        "frames",
        extra=_ticks_sql(14400),
    ),
)
def resample(spark, sf):
    shown = playback.resample(fx.traj(spark, sf), _ranges(spark, sf), update_seconds=14400)
    return shown.select("user_id", "tick_ts", "frame_ts", "objid", "x", "z")


# ---- evaluation ---------------------------------------------------------------------------


@check("ground_truth", sql("SELECT gt_id, clock, a || ',' || b AS objects FROM truth", "truth"))
def ground_truth(spark, sf):
    return fx.truth(spark, sf).select("gt_id", "clock", joined("objects").alias("objects"))


@check("predictions_strict", sql("SELECT source_file, clock, a || ',' || b AS objects FROM pred", "pred"))
def predictions_strict(spark, sf):
    return fx.pred(spark, sf).select("source_file", "clock", joined("objects").alias("objects"))


@check(
    "eval_details",
    sql(
        """SELECT source_file, clock, coalesce(ta || ',' || tb, '') AS truth, coalesce(pa || ',' || pb, '') AS predicted, verdict FROM verdicts""",
        "verdicts",
    ),
)
def eval_details(spark, sf):
    rows = evaluate.details(fx.truth(spark, sf), fx.pred(spark, sf), fx.eval_files(spark, sf))
    return rows.select("source_file", "clock", joined("truth").alias("truth"), joined("predicted").alias("predicted"), "verdict")


@check("eval_missing", sql("SELECT source_file, clock, ta || ',' || tb AS truth FROM verdicts WHERE verdict = 'missing'", "verdicts"))
def eval_missing(spark, sf):
    rows = evaluate.missing(fx.truth(spark, sf), fx.pred(spark, sf), fx.eval_files(spark, sf))
    return rows.select("source_file", "clock", joined("truth").alias("truth"))


@check("eval_extra", sql("SELECT DISTINCT source_file, clock FROM verdicts WHERE verdict = 'extra'", "verdicts"))
def eval_extra(spark, sf):
    return evaluate.extra_clocks(fx.truth(spark, sf), fx.pred(spark, sf), fx.eval_files(spark, sf)).select("source_file", "clock")


@check("eval_clocks", sql("SELECT clock FROM truth UNION SELECT clock FROM pred", "truth", "pred"))
def eval_clocks(spark, sf):
    return evaluate.all_clocks(fx.truth(spark, sf), fx.pred(spark, sf))


@check("eval_metrics", sql("SELECT source_file, tp, fp, fn, precision, recall, f1_score FROM scores", "scores"))
def eval_metrics(spark, sf):
    return evaluate.metrics(fx.truth(spark, sf), fx.pred(spark, sf), fx.eval_files(spark, sf))


@check("eval_flow", sql("SELECT source_file, tp, fp, fn, precision, recall, f1_score FROM scores", "scores"))
def eval_flow(spark, sf):
    return flows.evaluation(fx.prediction_answers(spark, sf), fx.truth(spark, sf), fx.eval_files(spark, sf), "event_type")


@check(
    "eval_report",
    sql(
        """SELECT source_file, 'metrics' AS kind, round(precision, 2) AS precision, round(recall, 2) AS recall, round(f1_score, 2) AS f1_score,
             NULL AS clock, '' AS truth, '' AS predicted FROM scores
           UNION ALL SELECT source_file, verdict, NULL, NULL, NULL, clock, coalesce(ta || ',' || tb, ''), coalesce(pa || ',' || pb, '') FROM verdicts""",
        "scores",
    ),
)
def eval_report(spark, sf):
    path = new_folder(spark, "report")
    lines = evaluate.report(fx.truth(spark, sf), fx.pred(spark, sf), fx.eval_files(spark, sf))
    sinks.write_json(lines, path)
    back = spark.read.schema(lines.schema).json(path)
    return back.select(
        "source_file", "kind", "metrics.*", "clock", joined("truth").alias("truth"), joined("predicted").alias("predicted")
    )


@check(
    "average_report",
    sql(
        """SELECT source_file, p AS precision, r AS recall, f AS f1_score, CAST(1 AS BIGINT) AS num_files FROM rounded
           UNION ALL SELECT NULL, round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), count(*) FROM rounded""",
        "scores",
        extra="rounded AS (SELECT source_file, round(precision, 2) AS p, round(recall, 2) AS r, round(f1_score, 2) AS f FROM scores)",
    ),
)
def average_report(spark, sf):
    scores = flows.evaluation(fx.prediction_answers(spark, sf), fx.truth(spark, sf), fx.eval_files(spark, sf), "event_type")
    lines = evaluate.average_report(scores.select("source_file", *[F.round(c, 2).alias(c) for c in evaluate.SCORES]))
    return lines.select("source_file", *[F.round(c, 6).alias(c) for c in evaluate.SCORES], "num_files")


@check(
    "macro_average",
    sql(
        """SELECT round(avg(round(precision, 2)), 6) AS precision, round(avg(round(recall, 2)), 6) AS recall,
           round(avg(round(f1_score, 2)), 6) AS f1_score, count(*) AS num_files FROM scores""",
        "scores",
    ),
)
def macro_average(spark, sf):
    means = flows.evaluation_average(fx.prediction_answers(spark, sf), fx.truth(spark, sf), fx.eval_files(spark, sf), "event_type")
    return means.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")], "num_files")


@check(
    "metrics_read",
    """SELECT CAST(o_orderkey AS VARCHAR) AS source_file, o_totalprice AS precision, CAST(o_custkey AS DOUBLE) AS recall, o_totalprice / 2 AS f1_score
       FROM orders WHERE o_orderstatus = 'O'""",
)
def metrics_read(spark, sf):
    """Metrics documents of which two kinds are unusable: one lacks a figure, one all of them."""
    path = new_folder(spark, "metrics")
    status = F.col("o_orderstatus")
    figures = F.struct(
        F.col("o_totalprice").alias("precision"),
        F.when(status != "P", F.col("o_custkey").cast("double")).alias("recall"),
        (F.col("o_totalprice") / 2).alias("f1_score"),
    )
    fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("source_file"), F.when(status != "F", figures).alias("metrics")
    ).write.json(path)
    return evaluate.usable_metrics(files.read_metrics(spark, path, multiline=False))


# ---- detection ----------------------------------------------------------------------------


@check("contacts", sql(f"SELECT {ts('timestamp')} AS timestamp, a, b, distance FROM contacts", "contacts"))
def contacts(spark, sf):
    return proximity.contacts(fx.traj(spark, sf), 25.0)


@check(
    "headings_away",
    sql(
        f"""SELECT {ts('c.timestamp')} AS timestamp, a, b,
            CASE WHEN distance * distance > 1e-12 THEN round(cos(atan2(l.z - r.z, l.x - r.x)), 6) END AS heading_a,
            CASE WHEN distance * distance > 1e-12 THEN round(sin(atan2(l.z - r.z, l.x - r.x)), 6) END AS heading_b
            FROM contacts c JOIN traj l ON l.timestamp = c.timestamp AND l.objid = a JOIN traj r ON r.timestamp = c.timestamp AND r.objid = b""",
        "contacts",
    ),
)
def headings_away(spark, sf):
    rows = fx.traj(spark, sf)
    found = motion.headings_away(proximity.contacts(rows, 25.0).drop("distance"), rows)
    return found.select(
        "timestamp", "a", "b", F.round("heading_a", 6).alias("heading_a"), F.round("heading_b", 6).alias("heading_b")
    )


def _spaced(source: str, keys: list[str], seconds: int) -> str:
    """The greedy rule as recursion: the first instant of a key, then each first one past the gap."""
    same = " AND ".join(f"c.{k} = f.{k}" for k in keys) or "true"
    cols = "".join(f"{k}, " for k in keys)
    fcols = "".join(f"f.{k}, " for k in keys)
    return f"""fires AS (SELECT {cols}min(timestamp) AS timestamp FROM {source} {'GROUP BY ' + cols.rstrip(', ') if keys else ''}
  UNION ALL SELECT {fcols}min(c.timestamp) FROM fires f JOIN {source} c ON {same} AND c.timestamp >= f.timestamp + INTERVAL {seconds} SECOND
  GROUP BY {fcols}f.timestamp)"""


@check(
    "contact_episodes",
    sql(
        f"SELECT {ts('timestamp')} AS timestamp, a, b, distance FROM fires JOIN contacts USING (timestamp, a, b)",
        "contacts",
        extra=_spaced("contacts", ["a", "b"], 7200),
        recursive=True,
    ),
)
def contact_episodes(spark, sf):
    return proximity.pair_episodes(proximity.contacts(fx.traj(spark, sf), 25.0), guard_seconds=7200)


#: Hours, as frames are an hour apart: a guard reaches over many frames and, at this size of segment, several segments.
_GUARD_HOURS, _SEGMENT = 7, 1000

_SCENE = f"""numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY timestamp, a, b) AS i FROM contacts),
  visited AS (SELECT 0::BIGINT AS i, NULL::TIMESTAMP AS timestamp, ''::VARCHAR AS a, ''::VARCHAR AS b, MAP {{}}::MAP(VARCHAR, TIMESTAMP) AS guards, false AS fired
    UNION ALL SELECT n.i, n.timestamp, n.a, n.b,
      CASE WHEN ok THEN map_concat(v.guards, MAP {{n.a: n.timestamp + INTERVAL {_GUARD_HOURS} HOUR, n.b: n.timestamp + INTERVAL {_GUARD_HOURS} HOUR}}) ELSE v.guards END, ok
    FROM visited v JOIN numbered n ON n.i = v.i + 1,
      LATERAL (SELECT coalesce(n.timestamp >= v.guards[n.a], true) AND coalesce(n.timestamp >= v.guards[n.b], true) AS ok))"""
_SCENE_RULE = {"guard_seconds": _GUARD_HOURS * 3600, "segment_rows": _SEGMENT}


@check(
    "scene_episodes",
    sql(f"SELECT {ts('timestamp')} AS timestamp, a, b FROM visited WHERE fired", "contacts", extra=_SCENE, recursive=True),
)
def scene_episodes(spark, sf):
    return proximity.scene_episodes(proximity.contacts(fx.traj(spark, sf), 25.0), **_SCENE_RULE)


@check(
    "truth_from_contacts",
    sql(
        """SELECT strftime(timestamp, '%H:%M:%S') AS clock, least(CAST(a[4:] AS INTEGER), CAST(b[4:] AS INTEGER)) || ',' ||
           greatest(CAST(a[4:] AS INTEGER), CAST(b[4:] AS INTEGER)) AS objects FROM visited WHERE fired""",
        "contacts",
        extra=_SCENE,
        recursive=True,
    ),
)
def truth_from_contacts(spark, sf):
    rows = flows.truth_from_contacts(fx.traj(spark, sf), 25.0, **_SCENE_RULE)
    return rows.select("clock", joined("objects").alias("objects"))


_MOTION = f"""moved AS (SELECT timestamp, objid,
  (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1000000.0 AS dt,
  sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)) AS displacement
  FROM fine WINDOW w AS (PARTITION BY objid ORDER BY timestamp))"""


@check(
    "object_speed",
    sql(f"SELECT {ts('timestamp')} AS timestamp, objid, dt, round(displacement, 9) AS displacement, round(displacement / dt, 9) AS speed FROM moved", "fine", extra=_MOTION),
)
def object_speed(spark, sf):
    rows = motion.object_speed(fx.fine(spark, sf))
    return rows.select(
        "timestamp", "objid", "dt", F.round("displacement", 9).alias("displacement"), F.round("speed", 9).alias("speed")
    )


_STALL = {"speed": 6000.0}


@check("stalls", sql(f"SELECT {XYZ_SQL} FROM stall_runs WHERE run = 2", "stall_runs"))
def stalls(spark, sf):
    return motion.stalls(fx.fine(spark, sf), rows=2, **_STALL).select(*XYZ)


def _box(spark, sf):
    return trajectory.bounding_box(trajectory.coord_range(fx.fine(spark, sf)))


@check("wall_hugs", sql(f"SELECT {XYZ_SQL}, wall_distance FROM wall_runs WHERE run = 2", "wall_runs"))
def wall_hugs(spark, sf):
    return motion.wall_hugs(fx.fine(spark, sf), _box(spark, sf), rows=2).select(*XYZ, "wall_distance")


# Row by row: n stuck and w wall rows in a row, whether the last position is forgotten, the last label.
_BLOCKED = "(NOT v.forgot AND r.stuck AND v.n + 1 >= 2)"
_HUGS = f"(NOT {_BLOCKED} AND r.near AND v.w + 1 >= 2)"
_FREE = "(v.label IS NULL OR r.timestamp >= v.label + INTERVAL 10 HOUR)"
_HIT = f"(({_BLOCKED} OR {_HUGS}) AND {_FREE})"
_LABELS = f"""rows_in_order AS (SELECT f.timestamp, f.objid, f.x, f.y, f.z, f.stuck, n.near,
    row_number() OVER (PARTITION BY f.objid ORDER BY f.timestamp) AS i FROM flags f JOIN near n USING (timestamp, objid)),
  walk AS (SELECT objid, CAST(0 AS BIGINT) AS i, 0 AS n, 0 AS w, false AS forgot, CAST(NULL AS TIMESTAMP) AS label, '' AS kind
    FROM (SELECT DISTINCT objid FROM rows_in_order)
    UNION ALL SELECT r.objid, r.i,
      CASE WHEN {_HIT} THEN 0 WHEN v.forgot THEN v.n WHEN r.stuck THEN v.n + 1 ELSE 0 END,
      CASE WHEN {_HIT} THEN 0 WHEN {_BLOCKED} THEN v.w WHEN r.near THEN v.w + 1 ELSE 0 END,
      {_HIT}, CASE WHEN {_HIT} THEN r.timestamp ELSE v.label END,
      CASE WHEN NOT {_HIT} THEN '' WHEN {_BLOCKED} THEN 'stuck' ELSE 'wall' END
    FROM walk v JOIN rows_in_order r ON r.objid = v.objid AND r.i = v.i + 1)"""


@check(
    "collision_labels",
    sql(
        f"""SELECT {ts('timestamp')} AS timestamp, coalesce(mapped, objid) AS objid, {_TRACE}, kind
            FROM walk JOIN rows_in_order USING (objid, i) LEFT JOIN mapping USING (objid) WHERE kind <> ''""",
        "stall_runs",
        "wall_runs",
        "mapping",
        extra=_LABELS,
        recursive=True,
    ),
)
def collision_labels(spark, sf):
    labels = motion.collision_labels(
        fx.fine(spark, sf), _box(spark, sf), stuck_rows=2, wall_rows=2, cooldown=36000.0, stall_rule=_STALL
    )
    path = new_folder(spark, "labels") + ".csv"
    sinks.write_labels(labels, path, fx.mapping(spark, sf))
    return spark.read.csv(path, header=True)


@check(
    "object_hits",
    sql(f"SELECT {ts('timestamp')} AS timestamp, unnest([a, b]) AS objid FROM visited WHERE fired", "contacts", extra=_SCENE, recursive=True),
)
def object_hits(spark, sf):
    return proximity.object_hits(proximity.scene_episodes(proximity.contacts(fx.traj(spark, sf), 25.0), **_SCENE_RULE))


# ---- frames -------------------------------------------------------------------------------


@check(
    "thin_fps",
    sql(
        f"""SELECT {XYZ_SQL} FROM fine WHERE timestamp IN
            (SELECT min(timestamp) FROM fine GROUP BY epoch_us(timestamp) // 20000000000)""",
        "fine",
    ),
)
def thin_fps(spark, sf):
    return frames.thin_grid(fx.fine(spark, sf), fps=1 / 20000)


@check(
    "thin_greedy",
    sql(
        f"SELECT {XYZ_SQL} FROM fine WHERE timestamp IN (SELECT timestamp FROM fires)",
        "fine",
        extra=_spaced("fine", [], 20000),
        recursive=True,
    ),
)
def thin_greedy(spark, sf):
    return frames.thin_greedy(fx.fine(spark, sf), fps=1 / 20000)


@check(
    "gap_fill",
    """WITH ends AS (SELECT event_type, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY 1),
       numbers AS (SELECT event_type, unnest(generate_series(a, b)) AS seq FROM ends)
       SELECT n.event_type, n.seq, last_value(e.value IGNORE NULLS) OVER w AS value, last_value(e.user_id IGNORE NULLS) OVER w AS user_id,
         e.event_id IS NULL AS is_duplicate
       FROM numbers n LEFT JOIN events e ON e.event_type = n.event_type AND e.event_id = n.seq
       WINDOW w AS (PARTITION BY n.event_type ORDER BY n.seq)""",
)
def gap_fill(spark, sf):
    rows = fx.events(spark, sf).withColumnRenamed("event_id", "seq")
    return frames.gap_fill(rows, "event_type", "seq", ["value", "user_id"])


@check(
    "gap_fill_counts",
    """SELECT event_type, CAST((SELECT max(event_id) + 1 FROM events) - min(event_id) AS BIGINT) AS frames,
       CAST((SELECT max(event_id) + 1 FROM events) - min(event_id) - count(*) AS BIGINT) AS duplicates FROM events GROUP BY 1""",
)
def gap_fill_counts(spark, sf):
    rows = fx.events(spark, sf).withColumnRenamed("event_id", "seq")
    target = rows.agg(F.max("seq") + 1).scalar()
    targets = rows.select("event_type").distinct().withColumn("target", target)
    return frames.duplicates_per_key(frames.gap_fill(rows, "event_type", "seq", ["value"], targets), "event_type")


@check(
    "overlap_windows",
    sql(
        f"""SELECT event_type AS video, i AS chunk_no, {ts('make_timestamp(a + i * 5400000000)')} AS chunk_start, count(*) AS rows FROM (
            SELECT event_type, a, unnest(generate_series(greatest(0, CAST(floor((o - 7200000000) / 5400000000) AS BIGINT) + 1), CAST(floor(o / 5400000000) AS BIGINT))) AS i
            FROM (SELECT event_type, a, epoch_us(ts) - a AS o FROM events JOIN (SELECT event_type, epoch_us(min(ts)) AS a FROM events GROUP BY 1) USING (event_type)))
            GROUP BY ALL"""
    ),
)
def overlap_windows(spark, sf):
    rows = fx.events(spark, sf).select(F.col("event_type").alias("video"), "ts")
    found = frames.overlap_windows(rows, "video", "ts", chunk=7200, overlap=1800)
    return found.groupBy("video", "chunk_no", "chunk_start").agg(F.count("*").alias("rows"))


# ---- runs ---------------------------------------------------------------------------------


@check(
    "run_stats",
    sql(
        """SELECT label, count(*) AS runs_total, count(*) FILTER (WHERE success) AS runs_success, count(*) FILTER (WHERE NOT success) AS errors,
           round(avg(wall_clock_s) FILTER (WHERE success), 4) AS wall_clock_s_mean,
           round(stddev_pop(wall_clock_s) FILTER (WHERE success), 4) AS wall_clock_s_std FROM runs GROUP BY 1""",
        "runs",
    ),
)
def run_stats(spark, sf):
    found = stats.run_stats(fx.runs(spark, sf))
    rounded = [F.round(c, 4).alias(c) for c in ("wall_clock_s_mean", "wall_clock_s_std")]
    return found.select("label", "runs_total", "runs_success", "errors", *rounded)


@check("run_errors", sql("SELECT label, error FROM runs WHERE NOT success", "runs"))
def run_errors(spark, sf):
    return stats.run_errors(fx.runs(spark, sf))


@check(
    "percentile_index",
    sql(
        """SELECT label, wall_clock_s AS percentile FROM (SELECT label, wall_clock_s,
             row_number() OVER (PARTITION BY label ORDER BY wall_clock_s) AS i, count(*) OVER (PARTITION BY label) AS n FROM runs)
           WHERE i = least(n, CAST(floor(0.95::DOUBLE * n) AS BIGINT) + 1)""",
        "runs",
    ),
)
def percentile_index(spark, sf):
    return stats.percentile_index(fx.runs(spark, sf), "label", "wall_clock_s", 0.95)


@check(
    "speedup",
    sql(
        """SELECT round(avg(wall_clock_s) FILTER (WHERE success AND label = 'F') / avg(wall_clock_s) FILTER (WHERE success AND label = 'O'), 9) AS speedup
           FROM runs""",
        "runs",
    ),
)
def speedup(spark, sf):
    return stats.speedup(fx.runs(spark, sf), "F", "O").select(F.round("speedup", 9).alias("speedup"))


# ---- load-test data made from the tables --------------------------------------------------


def _uniform_sql(number: str, salt: int, seed: int = 42) -> str:
    mixed = f"((({number}) % 1000000000 * 1103515245 + {salt * 12345 + seed * 104729}) % 2147483647)"
    return f"(CAST(({mixed} * 48271) % 2147483647 AS DOUBLE) / 2147483647.0)"


def _axis_sql(k: int) -> str:
    begin = f"({_uniform_sql('number', 2 * k + 1)} * 1000.0::DOUBLE)"
    move = f"(({_uniform_sql('number', 2 * k + 2)} * 2.0::DOUBLE - 1.0) * 12.0)"
    way = f"({begin} + {move} * CAST(i AS DOUBLE))"
    lap = f"({way} - floor({way} / 2000.0::DOUBLE) * 2000.0)"
    return f"round(CASE WHEN {lap} <= 1000.0 THEN {lap} ELSE 2000.0 - {lap} END, 6)"


@check(
    "synth_trajectory",
    sql(
        f"""SELECT {ts('make_timestamp(epoch_us(start_ts) + i * 200000)')} AS timestamp, printf('obj%03d', number) AS objid,
            {_axis_sql(0)} AS x, {_axis_sql(1)} AS y, {_axis_sql(2)} AS z
            FROM (SELECT user_id + 1 AS number, start_ts, unnest(generate_series(0, n * 5 - 1)) AS i FROM users)""",
        "users",
    ),
)
def synth_trajectory(spark, sf):
    specs = fx.users(spark, sf).select(
        (F.col("user_id") + 1).alias("number"), "start_ts", F.col("n").cast("double").alias("duration_s"), F.lit(5.0).alias("hz")
    )
    rows = synth.synth_trajectory(specs)
    return rows.select("timestamp", "objid", *[F.round(a, 6).alias(a) for a in ("x", "y", "z")])


@check(
    "calibration_grid",
    sql(
        f"""SELECT {ts('make_timestamp(epoch_us(start_ts) + i * 200000)')} AS timestamp, printf('obj%03d', p + 1) AS objid,
            round(1000.0 / (g - 1) * (p % g), 1) AS x, 0.0::DOUBLE AS y, round(1000.0 / (g - 1) * (p // g), 1) AS z
            FROM (SELECT user_id AS p, start_ts, unnest(generate_series(0, 50)) AS i,
                  (SELECT CAST(ceil(sqrt(max(user_id) + 1)) AS BIGINT) FROM events) AS g FROM users)""",
        "users",
    ),
)
def calibration_grid(spark, sf):
    size = fx.events(spark, sf).agg(F.ceil(F.sqrt(F.max("user_id") + 1))).scalar()
    objects = fx.users(spark, sf).select((F.col("user_id") + 1).alias("number"), "start_ts", size.alias("grid_size"))
    return synth.calibration_grid(objects)


@check(
    "time_grid",
    sql(
        f"""SELECT user_id, i AS step, {ts('make_timestamp(epoch_us(start_ts) + i * 200000)')} AS timestamp
            FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM users)""",
        "users",
    ),
)
def time_grid(spark, sf):
    specs = fx.users(spark, sf).select("user_id", "start_ts", F.col("n").alias("steps"))
    return synth.time_grid(specs).select("user_id", "step", "timestamp")


@check(
    "probe_sets",
    sql(
        f"""SELECT user_id, i AS query_id, pattern, {ts("make_timestamp(CASE WHEN pattern LIKE '%forward' THEN epoch_us(start_ts) + i * step ELSE epoch_us(end_ts) - i * step END)")} AS probe
            FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM users)
            CROSS JOIN (VALUES ('play_forward', 16667), ('play_backward', 16667), ('slider_forward', 100000), ('slider_backward', 100000)) v(pattern, step)""",
        "users",
    ),
)
def probe_sets(spark, sf):
    found = synth.probe_sets(fx.users(spark, sf), queries="n")
    return found.select("user_id", "query_id", "pattern", "probe")


@check(
    "random_probes",
    sql(
        f"""SELECT event_id AS query_id, 'random_jump' AS pattern,
            {ts(f"make_timestamp(((m + CAST(round_even(({_uniform_sql('event_id', 2)} * 2.0::DOUBLE - 1.0) * 500000.0, 0) AS BIGINT)) // 1000) * 1000)")} AS probe
            FROM (SELECT event_id, CAST(floor({_uniform_sql('event_id', 1)} * (SELECT count(*) FROM placed)) AS BIGINT) AS place FROM events)
            JOIN placed USING (place)""",
        "fine",
        extra="""placed AS (SELECT epoch_us(timestamp) AS m, row_number() OVER (ORDER BY timestamp) - 1 AS place
          FROM (SELECT DISTINCT timestamp FROM fine))""",
    ),
)
def random_probes(spark, sf):
    queries = fx.events(spark, sf).select(F.col("event_id").alias("query_id"))
    return synth.random_probes(fx.fine(spark, sf), queries)


# ---- streams ------------------------------------------------------------------------------


#: Above so many rows for each of four micro-batches there are more of them, with several files each.
BATCH_ROWS, BATCH_FILES = 1_000_000, 4


def _late_stream(rows, time, order, seconds: int):
    """The rows as a stream of four micro-batches, and its folder; a row is up to so many seconds late, the last ones come first.

    Many rows come in more micro-batches, so that the rows of one are bounded: cut by rank of arrival, and of several files.
    """
    spark = rows.sparkSession
    path, parted = new_folder(spark, "late"), new_folder(spark, "pieces")
    rows = rows.withColumn("arrival", micros(time) + F.pmod(order * 7919, F.lit(seconds)) * MICROS)
    first, last, n = rows.agg(F.min(micros(time)), F.max(micros(time)), F.count("*")).first()
    pieces, files = max(4, -(-n // BATCH_ROWS)), 1 if n <= BATCH_ROWS else BATCH_FILES
    if pieces == 4:
        piece = F.least(F.lit(3), F.floor((F.col("arrival") - F.lit(first)) / F.lit(((last or 0) - (first or 0)) // 4 + 1)))
    else:
        ranks = F.percentile_approx("arrival", [k / pieces for k in range(1, pieces)], 100 * pieces)
        cuts = F.array(*[F.lit(c) for c in rows.agg(ranks).first()[0] or []])
        piece = F.when(F.col("arrival").isNull(), pieces - 1).otherwise(F.size(F.filter(cuts, lambda c: c < F.col("arrival"))))
    # Cut once, then written one after the other: a stream takes its files by age.
    rows.withColumn("piece", piece.cast("int")).write.partitionBy("piece").parquet(parted)
    cut = spark.read.schema(rows.schema.add("piece", "integer")).parquet(parted)
    for k in range(pieces):
        late = cut.where(F.col("piece") == k).drop("arrival", "piece")
        late.repartitionByRange(files, order.desc()).sortWithinPartitions(order.desc()).write.mode("append").parquet(path)
    return _stream_of(spark, path, files), path


def _stream_of(spark, path, files: int = 1):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def _copy_of_a_row(spark, path, **changed) -> None:
    """One more file with a row as it comes, but for some columns."""
    rows = spark.read.parquet(path)
    row = rows.limit(1).withColumns(changed).select(rows.columns)
    spark.createDataFrame(row.collect(), rows.schema).coalesce(1).write.mode("append").parquet(path)


#: The event whose frame is the closing instant.
_LAST_EVENT = fx.PER_FRAME * ((jobs.END - dt.datetime(2024, 1, 1)) // dt.timedelta(hours=1))


def _late_events(spark, sf, time, seconds: int):
    """The stream of late events, and what closes it."""
    late, path = _late_stream(fx.events(spark, sf), time, F.col("event_id"), seconds)

    def close() -> None:
        _copy_of_a_row(spark, path, event_id=F.lit(_LAST_EVENT).cast("bigint"), ts=clock.instant(jobs.END))

    return late, close


@check(
    "stream_ingest",
    sql(
        f"SELECT {ts('timestamp')} AS timestamp, objid, x, y, z, epoch_us(timestamp) // 3600000000 AS chunk FROM traj",
        "traj",
    ),
)
def stream_ingest(spark, sf):
    path, marks = new_folder(spark, "live"), new_folder(spark, "marks")
    late, close = _late_events(spark, sf, fx.frame_time(), 36000)
    rows = fx.as_positions(late, fx.frame_time())
    jobs.finished(lambda: jobs.start_ingest(rows, path, marks, order="event_id", chunk_seconds=3600, lateness="12 hours"), close)
    return jobs.read_ingested(spark, path)


@check(
    "stream_chunk_stats",
    sql(
        f"""SELECT {ts("date_trunc('day', timestamp)")} AS window_start, count(*) AS rows, count(DISTINCT objid) AS objects, min(x) AS min_x,
            max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM hourly_rows GROUP BY 1""",
        "hourly_rows",
    ),
)
def stream_chunk_stats(spark, sf):
    late, _ = _late_events(spark, sf, fx.frame_time(), 36000)
    rows = fx.as_positions(late, fx.frame_time())
    found = jobs.chunk_statistics(rows, "1 day", lateness="12 hours")
    return jobs.window_totals(jobs.run_updates(found, new_folder(spark, "live"), new_folder(spark, "marks")))


@check(
    "stream_contacts",
    sql(
        f"""SELECT {ts('l.timestamp')} AS timestamp, l.objid AS a, r.objid AS b FROM hourly_rows l JOIN hourly_rows r
            ON l.timestamp = r.timestamp AND l.objid < r.objid
            WHERE (l.x - r.x) * (l.x - r.x) + (l.z - r.z) * (l.z - r.z) < 625""",
        "hourly_rows",
    ),
)
def stream_contacts(spark, sf):
    """Frames in time order over several micro-batches, so that the state never holds all rows."""
    late, _ = _late_events(spark, sf, fx.frame_time(), 1)
    rows = fx.as_positions(late, fx.frame_time())
    found = jobs.live_contacts(rows, rows, 25.0)
    return jobs.run_to_parquet(found, new_folder(spark, "live"), new_folder(spark, "marks"))


@check(
    "stream_stalls",
    sql(
        f"SELECT {ts('timestamp')} AS timestamp, objid FROM stall_runs WHERE run = 2",
        "stall_runs",
    ),
)
def stream_stalls(spark, sf):
    """Rows out of order over several micro-batches, and objects silent for longer than a day."""
    late, close = _late_events(spark, sf, F.col("ts"), 36000)
    rows = fx.as_positions(late, clock.trunc_ms("ts"))
    found = jobs.live_stalls(rows, stuck_rows=2, lateness="12 hours", **_STALL)
    return jobs.run_to_parquet(found, new_folder(spark, "live"), new_folder(spark, "marks"), close).select("timestamp", "objid")


@check(
    "stream_contact_fires",
    sql(
        f"SELECT {ts('timestamp')} AS timestamp, a, b FROM fires",
        "contacts",
        extra=_spaced("contacts", ["a", "b"], 864000),
        recursive=True,
    ),
)
def stream_contact_fires(spark, sf):
    """Contacts out of order over several micro-batches, to the end of the stream."""
    found = written(proximity.contacts(fx.traj(spark, sf), 25.0).select("timestamp", "a", "b"), "contacts")
    late, path = _late_stream(found, F.col("timestamp"), F.xxhash64("a", "b") % 1000, 36000)

    def close() -> None:
        _copy_of_a_row(spark, path, timestamp=clock.instant(jobs.END))

    fires = jobs.live_fires(late, guard_seconds=864000, lateness="12 hours")
    return jobs.run_to_parquet(fires, new_folder(spark, "live"), new_folder(spark, "marks"), close)


@check(
    "stream_contact_chain",
    sql(
        f"SELECT {ts('timestamp')} AS timestamp, a, b FROM fires",
        "hourly_rows",
        extra="""met AS (SELECT DISTINCT l.timestamp, l.objid AS a, r.objid AS b FROM hourly_rows l JOIN hourly_rows r
          ON l.timestamp = r.timestamp AND l.objid < r.objid
          WHERE (l.x - r.x) * (l.x - r.x) + (l.z - r.z) * (l.z - r.z) < 625), """ + _spaced("met", ["a", "b"], 864000),
        recursive=True,
    ),
)
def stream_contact_chain(spark, sf):
    """From late positions to fires in one query: the join of frames and the refractory, both stateful."""
    late, close = _late_events(spark, sf, fx.frame_time(), 36000)
    rows = fx.as_positions(late, fx.frame_time())
    fires = jobs.live_contact_fires(rows, rows, 25.0, guard_seconds=864000, lateness="12 hours")
    return jobs.run_to_parquet(fires, new_folder(spark, "live"), new_folder(spark, "marks"), close)


@check("stream_events", sql("SELECT * FROM lists", "mentions", extra=_GROUPS))
def stream_events(spark, sf):
    path, marks = new_folder(spark, "live"), new_folder(spark, "marks")
    source = _write_event_answers(spark, sf)
    stream = spark.readStream.schema("event_id bigint, content string").json(source)
    jobs.start_events(stream, path, marks, order="event_id").awaitTermination()
    return events.consolidated(spark.read.parquet(path)).select("timestamp", "group_no", joined("grp").alias("grp"))


def _write_event_answers(spark, sf) -> str:
    path = new_folder(spark, "answers")
    fx.responses(spark, sf).select("event_id", "content").write.json(path)
    return path
