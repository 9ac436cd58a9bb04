"""What lets queries grow: bounded micro-batches, state, files and passes over the input."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import START, at, greedy, positions, seeded
from pyspark.sql import functions as F

from checks import registry
from trajlake.operators import events
from trajlake.session import new_folder
from trajlake.sources import lake
from trajlake.streaming import jobs

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture(scope="module")
def own_events(spark, tmp_path_factory):
    """300 events of 22 frames, six hours and more apart in their own clock."""
    sf = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, START + dt.timedelta(minutes=i), i % 7, "click", float(i * 37 % 90), '{"k": 1}') for i in range(300)]
    spark.createDataFrame(rows, EVENT).write.parquet(f"{sf}/events.parquet")
    return sf


def test_list_files_has_a_folder_per_chunk(spark, own_events):
    """chunks of six hours; frames are an hour each."""
    found = registry.TYPED["list_files"](spark, own_events).collect()
    assert sorted(map(tuple, found)) == sorted((f"chunk={k}", True) for k in range(4))


def test_late_stream_bounds_its_batches(spark, own_events, monkeypatch):
    """F1, F2: no micro-batch holds more than about so many rows, and rows come no later than told."""
    monkeypatch.setattr(registry, "BATCH_ROWS", 30)
    rows = spark.read.parquet(f"{own_events}/events.parquet")
    _, path = registry._late_stream(rows, F.col("ts"), F.col("event_id"), 600)
    held = [(r.time, r.file, r.ts) for r in spark.read.parquet(path).select(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), "ts").collect()]
    assert len(held) == 300
    files = sorted({(time, file) for time, file, _ in held})
    assert len(files) > 20
    seen = START
    for k in range(0, len(files), registry.BATCH_FILES):
        batch = [ts for time, file, ts in held if (time, file) in files[k : k + registry.BATCH_FILES]]
        assert len(batch) <= 40
        assert min(batch) >= seen - dt.timedelta(seconds=600)
        seen = max([seen, *batch])


def run(stream, tmp_path):
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_live_contacts_wait_once_in_the_state(spark, tmp_path):
    """all pairs, also over borders of cells, on both sides of zero and just apart; few rows in the state."""
    rng = seeded(3)
    places = [(rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in range(240)]
    places += [(0.0, 0.0), (24.999999999999996, 0.0), (25.0, 0.0), (50.0, 0.0), (74.99999999999999, 0.0), (0.0, -24.999999999999996)]
    rows = [(k % 5, f"o{k}", x, 0.0, z) for k, (x, z) in enumerate(places)]
    positions(spark, rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(positions(spark, rows[:1]).schema).parquet(str(tmp_path / "in"))
    query = run(jobs.live_contacts(stream, stream, 25.0), tmp_path)
    got = sorted((r.timestamp, r.a, r.b) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(
        (at(s), min(a, b), max(a, b)) for s, a, x, _, z in rows for t, b, u, _, w in rows
        if s == t and a < b and (x - u) * (x - u) + (z - w) * (z - w) < 625
    )
    assert got == want and want
    waiting = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    assert waiting <= 8 * len(rows)


def test_live_contacts_meet_over_batches_in_few_entries(spark, tmp_path):
    """F2: rows of a frame in different micro-batches meet, all pairs of duplicates too; late rows and rows without a place do not. The
    state's entries go with the keys, not with the rows."""
    rng = seeded(5)
    rows = [(k % 40, f"o{k % 90}", rng.uniform(-90, 90), 0, rng.uniform(-90, 90)) for k in range(3600)]
    pieces = [rows[::2], rows[1::2], [(4000, "d", 0, 0, 0)], [(4000, "e", 90, 0, 0)]]
    pieces.append([(1, "a", 0, 0, 0), (1, "b", 0, 0, 0), (4000, "c", 9, 0, 0)])
    gaps = spark.createDataFrame([(at(3), None, 0.0, 0.0, 0.0), (at(3), "n", None, 0.0, 0.0)], positions(spark, rows[:1]).schema)
    path = str(tmp_path / "in")
    for k, piece in enumerate(pieces):
        (positions(spark, piece).unionAll(gaps) if k == 0 else positions(spark, piece)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(gaps.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = run(jobs.live_contacts(stream, stream, 25.0, lateness="1 minute"), tmp_path)
    got = sorted((r.timestamp, r.a, r.b) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # Of the last piece the rows at one second are late: the watermark was past them two micro-batches before.
    judged = [*rows, *pieces[2], *pieces[3], pieces[4][2]]
    want = sorted(
        (at(s), a, b) for s, a, x, _, z in judged for t, b, u, _, w in judged
        if s == t and a < b and (x - u) * (x - u) + (z - w) * (z - w) < 625
    )
    assert got == want and len(want) > 1000
    waiting = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    assert waiting <= 3 * jobs.CELL_KEYS


def test_pairs_are_measured_a_part_at_a_time(monkeypatch):
    """a crowded cell's pairs are never all in memory."""
    rng = seeded(7)
    rows = [(1, 5, k % 2, f"o{k}", rng.uniform(0, 50), rng.uniform(0, 50)) for k in range(120)]
    frame = pd.DataFrame(rows, columns=jobs.MEETING.names)
    whole = [tuple(r) for f in jobs.Meetings(25.0).met(frame, frame) for r in f[["a", "b"]].to_numpy()]
    monkeypatch.setattr(jobs, "PAIRS_AT_ONCE", 500)
    parts = [[tuple(r) for r in f[["a", "b"]].to_numpy()] for f in jobs.Meetings(25.0).met(frame, frame)]
    assert len(parts) > 10 and sorted(sum(parts, [])) == sorted(whole)
    want = [(a[3], b[3]) for a in rows for b in rows if b[2] and a[3] < b[3] and (a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2 < 625]
    assert sorted(whole) == sorted(want)


def stalls_of(rows, limit, stuck_rows):
    """Onsets by object, a row at a time; the last of several rows at one instant counts."""
    found = []
    for o in sorted({r[1] for r in rows}):
        run, last = 0, None
        for t, (x, y, z) in sorted({r[0]: r[2:] for r in rows if r[1] == o}.items()):
            run = run + 1 if last and (x - last[0]) ** 2 + (y - last[1]) ** 2 + (z - last[2]) ** 2 < limit * limit else 0
            last = (x, y, z)
            if run == stuck_rows:
                found.append((o, at(t)))
    return found


def test_live_stalls_of_many_objects_share_state(spark, tmp_path):
    """calls and state go with the keys, not with the objects; runs cross micro-batches, rows come late and twice."""
    rng = seeded(9)
    rows = [(10 * (k // 700), f"o{k % 700}", rng.randrange(3), 0, rng.randrange(2)) for k in range(14000)]
    rows += [(t, o, x + 1, y, z) for t, o, x, y, z in rng.sample(rows, 500)]
    path = str(tmp_path / "in")
    # Up to 30 seconds late, against a lateness of a minute; then a row that moves the watermark past all.
    arrives = sorted(rows, key=lambda r: r[0] + ((int(r[1][1:]) + r[0] // 10) % 2) * 30)
    for part in [arrives[k : k + 3700] for k in range(0, len(arrives), 3700)] + [[(9000, "end", 0, 0, 0)], [(9001, "end", 90, 0, 0)]]:
        positions(spark, part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(positions(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(path)
    # Steps are ten seconds, taken as one: stuck is what moves less than 1.2.
    query = run(jobs.live_stalls(stream, speed=4.0, ratio=0.3, step_max=1.0, stuck_rows=3, lateness="1 minute"), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.objid, r.timestamp) for r in got) == sorted(stalls_of(arrives, 1.2, 3)) and len(got) > 500
    assert {r.run for r in got} == {3}
    waiting = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    assert waiting <= jobs.OBJECT_KEYS


@pytest.mark.parametrize("forget", [None, 60_000])
def test_live_stalls_forget_silent_objects(spark, tmp_path, forget):
    """of the objects of a key only the silent one is forgotten; its run begins anew then."""
    still = [[(t, "on", 0, 0, 0) for t in range(k, k + 100, 10)] for k in range(0, 600, 100)]
    pieces = [still[0] + [(t, "off", 0, 0, 0) for t in (0, 10)], *still[1:], [(600, "on", 50, 0, 0), (600, "off", 0, 0, 0)], [(900, "on", 0, 0, 0)]]
    path = str(tmp_path / "in")
    for part in pieces:
        positions(spark, part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(positions(spark, still[0]).schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.OBJECT_KEYS, keys = 1, jobs.OBJECT_KEYS
    try:
        run(jobs.live_stalls(stream, speed=4.0, stuck_rows=2, lateness="10 seconds", forget_after_ms=forget), tmp_path)
    finally:
        jobs.OBJECT_KEYS = keys
    got = sorted((r.objid, r.timestamp) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ([] if forget else [("off", at(600))]) + [("on", at(20))]


def test_live_lake_files_go_with_rows(spark, tmp_path):
    """200 chunks, and a few files a micro-batch."""
    rows = positions(spark, [(60 * k, f"o{k % 3}", k, 0, 0) for k in range(200)]).withColumn("n", F.monotonically_increasing_id())
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "live")
    jobs.start_ingest(stream, path, str(tmp_path / "marks"), order="n", lateness="1 minute").awaitTermination()
    found = jobs.read_ingested(spark, path)
    first = int(START.replace(tzinfo=dt.UTC).timestamp()) // 60
    # The last rows wait for the watermark.
    assert sorted(r.chunk - first for r in found.collect()) == list(range(199))
    assert len(found.inputFiles()) <= 4


def test_export_of_many_chunks(spark):
    """tasks go with the rows and not with the chunks, and ten thousand chunks are no limit."""
    assert lake.EXPORT_CHUNKS > 150_000
    rows = positions(spark, [(5 * k, f"o{k % 3}", k, 0, 0) for k in range(150)])
    root, target = lake.write_lake(rows, new_folder(spark, "lake"), chunk_seconds=5), new_folder(spark, "single")
    doc = lake.read_manifest_document(spark, lake.export_lake(spark, root, target)).first()
    assert len(doc.chunks) == doc.rows == 150
    assert spark.read.option("header", True).csv(f"{target}/chunk_*.csv").count() == 150


def test_export_check_copies_no_ids_per_chunk(spark, own_events):
    """the ids of the document meet the chunks after the join, so that no exchange or join holds a copy per chunk."""
    found = registry.TYPED["lake_export"](spark, own_events)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline(chunks" in plan
    assert not [line for line in plan.splitlines() if "Generate" in line and "objids" in line]
    # 21 frames of 7 objects and a last one of 6.
    want = ("2024-01-01 00:00:00.000", "2024-01-01 21:00:00.000", 153, 153, ",".join(f"obj{k:03d}" for k in range(1, 8)))
    assert [(r.start, r.last, r.rows, r.found, r.objids) for r in found.collect()] == [want]


@pytest.mark.parametrize("place", [events.event_positions, events.event_unmatched])
def test_answers_are_parsed_once(spark, place):
    """a lookup reads its probes several times, but the answers once."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    answers = [(k, f'[{{"00:{k // 60:02d}:{k % 60:02d}": [{k % 3 + 1}]}}]') for k in range(90)]
    found = spark.createDataFrame(answers, "event_id bigint, content string").withColumn("content", seen("content"))
    traj = positions(spark, [(t, f"obj00{o}", t, o, 0) for t in range(0, 90, 10) for o in (1, 2)])
    placed = place(events.mentions(found, "event_id"), traj).collect()
    assert len(placed) == (60 if place is events.event_positions else 30)
    assert read.value == 90


def test_spaced_fires():
    """many pairs at once, as one by one."""
    rng = seeded(11)
    for gap in (1, 4, 30):
        rows = sorted({(rng.randrange(12), rng.randrange(100)) for _ in range(400)})
        pair, m = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
        last = np.array([rng.choice([jobs._NEVER, rng.randrange(-40, 40)]) for _ in range(12)], dtype=np.int64)
        want = []
        for p in range(12):
            later = [t for q, t in rows if q == p and (last[p] == jobs._NEVER or t >= last[p] + gap)]
            want += [(p, t) for t in greedy(later, gap)]
        fired = jobs.spaced_fires(pair, m, last, gap)
        assert list(zip(pair[fired].tolist(), m[fired].tolist(), strict=True)) == want


def test_live_fires_of_many_pairs_share_state(spark, tmp_path):
    """state and calls go with the keys, not with the pairs."""
    schema = "timestamp timestamp_ntz, a string, b string"
    pairs = [(at(k % 600), f"o{k}", None if k % 2 else "p") for k in range(3000)]
    spark.createDataFrame(pairs, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = run(jobs.live_fires(stream, guard_seconds=17, lateness="1 minute"), tmp_path)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == sum(1 for t, _, _ in pairs if t < at(599 - 60))
    waiting = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    assert waiting <= 6 * jobs.PAIR_KEYS
