"""Reading answers, consolidating events, evaluating predictions."""

import pytest
from helpers import at, positions
from pyspark.sql import functions as F

from trajlake.functions import answers, clock, ids
from trajlake.operators import evaluate, events, playback
from trajlake.plans import flows
from trajlake.sources import files

LENIENT = [
    ("", []),
    ("[]", []),
    ('[{"00:00:03": [1, 3]}]', [{"00:00:03": [1, 3]}]),
    ('```json\n[{"00:00:03": [1, 3]}]\n```', [{"00:00:03": [1, 3]}]),
    ("[{'00:00:03': [1, 3]},]", [{"00:00:03": [1, 3]}]),
    ('Sure: [{"00:00:03": [1]}, {"00:00:04": []}] as asked', [{"00:00:03": [1]}, {"00:00:04": []}]),
    ('{"events": [{"00:00:03": [1]}]}', [{"00:00:03": [1]}]),
    ('{"00:00:03": [1]}', [{"00:00:03": [1]}]),
    ('{"00:00:03": [1], "00:00:05": [2]}', [{"00:00:03": [1], "00:00:05": [2]}]),
    ("nothing to see", None),
    ('[{"00:00:03": ["one"]}]', None),
]


@pytest.mark.parametrize("text,want", LENIENT)
def test_lenient(spark, text, want):
    df = spark.createDataFrame([(text,)], "content string")
    assert events.parsed(df).first()["items"] == want


def test_strict(spark):
    cases = {
        '[{"00:00:03": [1, 3]}]': [{"00:00:03": [1, 3]}],
        'x ```json\n[{"00:00:03": [1]}]\n``` y': [{"00:00:03": [1]}],
        "[{'00:00:03': [1]}]": None,
        'Sure: [{"00:00:03": [1]}]': None,
        '{"events": []}': None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "content string")
    got = {r.content: r.i for r in answers.with_strict_items(df, "content", "i").collect()}
    assert got == cases


def test_consolidation(spark):
    rows = [
        (0, '[{"00:07:11": [3, 6]}, {"00:09:02": [5, 6]}]'),
        (1, '[{"00:07:11": [3, 6]}, {"00:08:00": []}, {"00:07:11": [9]}]'),
        (2, '{"00:09:02": [8], "00:09:02": [2000, 5]}'),
    ]
    found = events.mentions(spark.createDataFrame(rows, "pos bigint, content string"), "pos")
    got = {(r.timestamp, r.group_no): r.grp for r in events.consolidated(found).collect()}
    assert got == {
        ("2025-01-01 00:07:11.000", 0): ["obj003", "obj006"],
        ("2025-01-01 00:07:11.000", 1): ["obj003", "obj006"],
        ("2025-01-01 00:07:11.000", 2): ["obj009"],
        ("2025-01-01 00:09:02.000", 0): ["obj005", "obj006"],
        ("2025-01-01 00:09:02.000", 1): ["obj2000", "obj005"],
    }
    stats = events.event_stats(found).first()
    assert (stats.timestamps, stats.event_groups, stats.objects) == (2, 5, 5)


def test_positions(spark):
    traj = positions(spark, [(0, "obj001", 1, 2, 3), (1, "obj002", 4, 5, 6)])
    rows = [(0, '[{"00:00:00": [1, 2]}, {"00:00:01": [1]}, {"00:00:05": [2]}]')]
    responses = spark.createDataFrame(rows, "pos bigint, content string")
    got = {r.timestamp[-6:]: (r.objid, r.x) for r in flows.answers_to_event_list(responses, "pos", traj).collect()}
    assert got == {"00.000": ("obj001", 1.0), "05.000": ("obj002", 4.0)}
    lost = events.event_unmatched(events.mentions(responses, "pos"), traj).collect()
    assert [(r.timestamp[-6:], r.objid) for r in lost] == [("01.000", "obj001")]


def test_event_list_order(spark, tmp_path):
    path = tmp_path / "a_eventlist.jsonl"
    path.write_text(
        '{"timestamp":"2025-01-01 00:00:03","objid":"1","position":{"x":1,"y":2,"z":3}}\n\n'
        '{"timestamp":"2025-01-01 00:00:01","objid":"1","position":{"x":4}}\n'
        '{"timestamp":"2025-01-01 00:00:02","objid":"1"}\n'
        '{"timestamp":"2025-01-01 00:00:03","objid":"2","position":{"x":9,"y":9,"z":9}}\n'
    )
    rows = events.event_list(files.read_event_list(spark, str(path)))
    assert [(r.timestamp[-2:], r.x, r.z) for r in rows.orderBy("ordinal").collect()] == [("03", 1, 3), ("01", 4, 0), ("03", 9, 9)]
    assert {r.timestamp[-2:]: r.x for r in events.event_list_positions(rows).collect()} == {"03": 9, "01": 4}


def test_summary_documents(spark):
    docs = spark.createDataFrame(
        [("v1", "m", 2.5, [('[{"00:00:02": [1]}]',), ('[{"00:00:01": [2]}, {"00:00:02": [3]}]',)]), ("v2", None, None, [])],
        "id string, model string, execution_time double, chunk_responses array<struct<content:string>>",
    )
    got = {r.source_id: r for r in flows.event_summary(docs).collect()}
    assert got["v1"].total_timestamps == 2 and got["v1"].total_groups == 3
    assert got["v1"].events == '{"2025-01-01 00:00:01.000":[["obj002"]],"2025-01-01 00:00:02.000":[["obj001"],["obj003"]]}'
    twice = docs.unionAll(docs).withColumn("id", F.when(F.col("model").isNotNull(), F.col("id")))
    rows = flows.event_summary(twice).collect()
    assert sorted((r.source_id, r.total_groups) for r in rows) == sorted([("v1", 3), ("v1", 3), ("", 0), ("", 0)])
    assert (got["v2"].model, got["v2"].execution_time, got["v2"].total_groups, got["v2"].events) == ("", 0.0, 0, "{}")


def truth(spark):
    lines = [(i, v) for i, v in enumerate(["00:00:01 1,4", "00:00:02 3,2", "00:00:03", "00:00:02 4,2", "", "00:00:09 5"])]
    return evaluate.ground_truth(spark.createDataFrame(lines, "line_no int, value string").withColumn("gt_id", F.lit("1")))


def held_against_one(spark, *names):
    return spark.createDataFrame([(n, "1") for n in names], "source_file string, gt_id string")


def test_truth(spark):
    assert {r.clock: r.objects for r in truth(spark).collect()} == {"00:00:01": [1, 4], "00:00:02": [2, 4], "00:00:09": [5]}


def test_metrics(spark):
    pred = spark.createDataFrame(
        [
            ("f", "00:00:01", [1, 4]),  # right
            ("f", "00:00:01", [1, 2]),  # wrong set at a known clock
            ("f", "00:00:02", []),  # an empty set counts and is wrong
            ("f", "00:00:05", [1]),  # unknown clock
            ("g", "00:00:09", [5]),
        ],
        "source_file string, clock string, objects array<int>",
    )
    of = held_against_one(spark, "f", "g", "silent")
    got = {r.source_file: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluate.metrics(truth(spark), pred, of).collect()}
    assert got == {"f": (1, 3, 1, 0.25, 0.5), "g": (1, 0, 2, 1.0, 1 / 3), "silent": (0, 0, 3, 0.0, 0.0)}
    of = held_against_one(spark, "f", "g")
    missing = sorted((r.source_file, r.clock) for r in evaluate.missing(truth(spark), pred, of).collect())
    assert missing == [("f", "00:00:09"), ("g", "00:00:01"), ("g", "00:00:02")]
    verdicts = sorted((r.source_file, r.verdict) for r in evaluate.details(truth(spark), pred, of).collect())
    assert verdicts == [("f", "correct"), ("f", "extra"), ("f", "incorrect"), ("f", "incorrect"), ("f", "missing"),
                        ("g", "correct"), ("g", "missing"), ("g", "missing")]
    kinds = sorted((r.source_file, r.kind) for r in evaluate.report(truth(spark), pred, of).collect())
    assert kinds == sorted(verdicts + [("f", "metrics"), ("g", "metrics")])
    averaged = evaluate.average_report(evaluate.metrics(truth(spark), pred, of)).collect()
    assert {(r.source_file, r.num_files) for r in averaged} == {("f", 1), ("g", 1), (None, 2)}


def test_no_truth_match_is_zero(spark):
    pred = spark.createDataFrame([("f", "00:00:05", [1])], "source_file string, clock string, objects array<int>")
    row = evaluate.metrics(truth(spark), pred, held_against_one(spark, "f")).first()
    assert (row.precision, row.recall, row.f1_score) == (0.0, 0.0, 0.0)


def test_metrics_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"source_file": "a",\n"metrics": {"precision": 1.0, "recall": 0.5, "f1_score": 0.67}}')
    (tmp_path / "b.json").write_text('{"source_file": "b", "metrics": {"precision": 1.0}}')
    (tmp_path / "c.json").write_text('{"source_file": "c"}')
    (tmp_path / "d.json").write_text("{broken")
    read = files.read_metrics(spark, f"{tmp_path}/*.json")
    assert [r.source_file for r in evaluate.usable_metrics(read).collect()] == ["a"]
    assert evaluate.unusable_metrics(read).count() == 3
    assert evaluate.macro_average(evaluate.usable_metrics(read)).first().num_files == 1


def test_clips_stop_at_end(spark):
    traj = positions(spark, [(i * 0.5, "a", i, 0, 0) for i in range(9)])  # until 4.0
    listed = spark.createDataFrame([(0, at(1)), (1, at(3.5)), (2, at(0))], "ordinal bigint, event_ts timestamp_ntz")
    all_clips = playback.event_clips(traj, listed)
    assert sorted((r.ordinal, r.x) for r in all_clips.collect()) == [(0, 2), (0, 3), (1, 7), (1, 8), (2, 0), (2, 1)]
    stopped = playback.event_clips(traj, listed, stop_at_end=True)
    assert {r.ordinal for r in stopped.collect()} == {0, 1}


def test_next_event_wraps(spark):
    listed = spark.createDataFrame([(10, at(5)), (20, at(1)), (30, at(9))], "ordinal bigint, timestamp timestamp_ntz")
    got = {r.ordinal: r.next_ts for r in playback.next_event(listed, width=3).collect()}
    assert got == {10: at(1), 20: at(9), 30: at(5)}


def test_ticks(spark):
    df = spark.createDataFrame([(at(0), at(1), 1.0), (at(0), at(1), -2.0), (at(0), at(1), 0.0)], "start_ts timestamp_ntz, end_ts timestamp_ntz, speed double")
    ticks = playback.playback_ticks(df, update_seconds=0.04).collect()
    by_speed = {}
    for r in ticks:
        by_speed.setdefault(r.speed, []).append((r.tick, round((r.tick_ts - at(0)).total_seconds(), 3)))
    assert sorted(by_speed[1.0])[:2] == [(0, 0.12), (1, 0.24)] and max(by_speed[1.0]) == (8, 1.0)
    assert sorted(by_speed[-2.0])[:2] == [(0, 0.84), (1, 0.68)] and max(by_speed[-2.0]) == (6, 0.0)
    assert sorted(by_speed[0.0]) == sorted(by_speed[1.0])


def test_text_rules(spark):
    df = spark.createDataFrame([("60",), ("30s",), ("1min",), ("2h",), ("1.5H",), ("soon",)], "t string")
    assert [r[0] for r in df.select(clock.duration_seconds("t")).collect()] == [60.0, 30.0, 60.0, 7200.0, 5400.0, None]
    names = spark.createDataFrame([("obj042",), ("cam",), ("x1234",), ("obj000",)], "n string")
    got = [tuple(r) for r in names.select(ids.objid_number("n"), ids.label_id("n")).collect()]
    assert got == [("42", 42), ("cam", None), ("1234", 234), ("0", 0)]


def test_separators(spark):
    # By source: the commas of its lines together outnumber the rest, or blanks, or tabs do.
    df = spark.createDataFrame(
        [("a", "x,y;z"), ("a", "p,q,r"), ("b", "1 2  3"), ("b", ""), ("c", "x\ty\tz|w")], "source string, value string"
    )
    got = {(r.source, r.value): r.cells for r in files.delimited_cells(df).collect()}
    assert got == {
        ("a", "x,y;z"): ["x", "y;z"], ("a", "p,q,r"): ["p", "q", "r"], ("b", "1 2  3"): ["1", "2", "3"], ("c", "x\ty\tz|w"): ["x", "y", "z|w"],
    }


def test_newest_list(spark, tmp_path):
    import os

    for name, age in (("old_eventlist.jsonl", 100), ("new_eventlist.jsonl", 10), ("other.jsonl", 1)):
        path = tmp_path / name
        path.write_text("{}\n")
        os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))
    assert files.latest_file(spark, str(tmp_path)).first().uri.endswith("new_eventlist.jsonl")
    assert files.list_files(spark, str(tmp_path)).count() == 3


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError):
        files.read_trajectory(spark, "/data/positions.xlsx")
    assert files.resolve("s3://b/k") == "s3a://b/k" and files.resolve("minio://b/k") == "s3a://b/k"
    assert files.artifact_uri("s3://b/out/", "event_list", "x.jsonl") == "s3a://b/out/event_list/x.jsonl"


def test_strip_fence(spark):
    texts = ["```json\n[1]\n```", "```\n[1]", " plain ", "```a\n b \n c\n```"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(answers.strip_fence(F.col("t"))).collect()] == ["[1]", "```\n[1]", "plain", "b \n c"]
