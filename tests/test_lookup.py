"""Floor lookup of frames, in memory and through the lake."""

import bisect

import pytest
from helpers import at, positions
from pyspark.sql import functions as F

from trajlake.operators import asof
from trajlake.session import new_folder
from trajlake.sources import lake


def grid(spark):
    rows = [(i * 0.2, f"obj{o:03d}", i, o, i * o) for i in range(300) for o in range(1, 5)]
    return positions(spark, rows)


def probe_times():
    on = [i * 0.2 for i in range(0, 300, 7)]
    off = [t + 0.07 for t in on]
    edges = [i * 5.0 for i in range(12)]
    return sorted({round(t, 3) for t in on + off + edges + [-3.0, 59.8 + 3.0]})


def expected():
    frames = [round(i * 0.2, 3) for i in range(300)]
    return {t: frames[max(0, bisect.bisect_right(frames, t + 1e-9) - 1)] for t in probe_times()}


def probes(spark):
    return spark.createDataFrame([(at(t),) for t in probe_times()], "probe timestamp_ntz")


def check(found):
    want = {at(t): at(f) for t, f in expected().items()}
    got = {}
    for r in found.groupBy("probe").agg(F.min("frame_ts").alias("f"), F.max("frame_ts").alias("g"), F.count("*").alias("n")).collect():
        assert r.f == r.g and r.n == 4
        got[r.probe] = r.f
    assert got == want


def test_frames(spark):
    check(asof.asof_frame(grid(spark), probes(spark), bucket_seconds=7))


def test_lake_agrees_with_full_load(spark):
    root = lake.write_lake(grid(spark), new_folder(spark, "lake"), chunk_seconds=5, hz=5.0, dataset="grid")
    assert lake.read_chunks(spark, root).count() == 12
    head = lake.read_manifest(spark, root + "/manifest.json").first()
    assert (head["rows"], head["objects"], head["chunks"]) == (1200, 4, 12)
    check(lake.asof_lake(spark, root, probes(spark)))


def test_lookup_opens_wanted_files_only(spark):
    root = lake.write_lake(grid(spark), new_folder(spark, "lake"), chunk_seconds=5, files=6)
    few = spark.createDataFrame([(at(12.3),), (at(12.5),)], "probe timestamp_ntz")
    found = lake.asof_lake(spark, root, few)
    assert found.count() == 2 * 4
    opened = {f.rsplit("/", 1)[1] for f in found.inputFiles() if "/data/" in f}
    zones = lake.read_files(spark, root).collect()
    assert opened == {z.file for z in zones if z["first"] <= at(12.4) and z["last"] >= at(12.2)}
    assert len(opened) < len(zones)


def test_export(spark, monkeypatch):
    root = lake.write_lake(grid(spark), new_folder(spark, "lake"), chunk_seconds=5, hz=5.0, dataset="grid")
    for fmt in ("csv", "parquet"):
        target = new_folder(spark, "single")
        doc = lake.read_manifest_document(spark, lake.export_lake(spark, root, target, fmt)).first()
        assert (doc.rows, doc.hz, doc.dataset, len(doc.chunks), len(doc.objids)) == (1200, 5.0, "grid", 12, 4)
        back = lake.read_chunk_files(spark, target, fmt).drop("seq")
        assert back.exceptAll(grid(spark).select(back.columns)).isEmpty() and back.count() == 1200
        # Again over what is there: replaced, not doubled.
        lake.export_lake(spark, root, target, fmt)
        assert lake.read_chunk_files(spark, target, fmt).count() == 1200
    monkeypatch.setattr(lake, "EXPORT_CHUNKS", 11)
    with pytest.raises(ValueError, match="too large"):
        lake.export_lake(spark, root, new_folder(spark, "single"))


def test_empty_lake(spark):
    root = lake.write_lake(grid(spark).limit(0), new_folder(spark, "lake"), chunk_seconds=5)
    assert lake.read_lake(spark, root).count() == 0
    assert lake.asof_lake(spark, root, probes(spark)).count() == 0


def test_lake_range_prunes_files(spark):
    root = lake.write_lake(grid(spark), new_folder(spark, "lake"), chunk_seconds=5, files=6)
    some = lake.read_lake(spark, root, start=at(12), end=at(17))
    assert {r.chunk for r in some.select("chunk").distinct().collect()} == {2, 3}
    assert some.count() == 26 * 4
    assert len(some.inputFiles()) < len(lake.read_lake(spark, root).inputFiles())
    assert "GreaterThanOrEqual(timestamp" in some._jdf.queryExecution().toString()


def test_probe_is_cut_to_milliseconds(spark):
    rows = positions(spark, [(0, "a", 0, 0, 0), (1.0005, "a", 1, 0, 0)])
    probe = spark.createDataFrame([(at(1.0005),)], "probe timestamp_ntz")
    assert asof.asof_frame(rows, probe).first().x == 0.0


def test_absent_objects_stay_absent(spark):
    rows = positions(spark, [(0, "a", 0, 0, 0), (0, "b", 0, 0, 0), (1, "a", 1, 0, 0)])
    probe = spark.createDataFrame([(at(1.5),)], "probe timestamp_ntz")
    assert [r.objid for r in asof.asof_frame(rows, probe).collect()] == ["a"]


def test_crowded_frame_and_probe(spark):
    """A third of all rows in one frame and of all probes at one instant."""
    rows = positions(spark, [(5, f"o{i}", i, 0, 0) for i in range(1000)] + [(i, "o0", i, 0, 0) for i in range(2000) if i != 5])
    probe = spark.createDataFrame([(at(5.5),)] * 50 + [(at(i + 0.5),) for i in range(100, 200)], "probe timestamp_ntz")
    assert asof.asof_frame(rows, probe).count() == 50 * 1000 + 100


def test_last_wins(spark):
    rows = positions(spark, [(0, "a", 1, 1, 1), (0, "a", 2, 2, 2), (0, "b", 3, 3, 3)]).withColumn(
        "seq", F.monotonically_increasing_id()
    )
    got = {r.objid: (r.x, r.y, r.z) for r in asof.last_wins(rows, "seq").collect()}
    assert got == {"a": (2.0, 2.0, 2.0), "b": (3.0, 3.0, 3.0)}


def test_single_file_lake(spark, tmp_path):
    """A lake that comes as one manifest document and chunk files."""
    import json

    (tmp_path / "chunk_1735689600000.csv").write_text(
        "timestamp,objid,x,y,z\n2025-01-01 00:00:00.000,obj001,1,2,3\n2025-01-01T00:00:01,obj001,4,5,6\n"
    )
    (tmp_path / "chunk_1735689605000.csv").write_text("timestamp,objid,x,y,z\n2025-01-01 00:00:05.000,obj002,7,8,9\n")
    (tmp_path / "manifest.json").write_text(
        json.dumps(
            {
                "version": 1,
                "dataset": "d",
                "hz": 5.0,
                "chunk_seconds": 5,
                "format": "csv",
                "objids": ["obj001", "obj002"],
                "rows": 3,
                "chunks": [{"key": "chunk_1735689600000.csv", "start": "2025-01-01 00:00:00.000", "end": "", "rows": 2}],
            },
            indent=2,
        )
    )
    doc = lake.read_manifest_document(spark, f"{tmp_path}/manifest.json").first()
    assert doc.objids == ["obj001", "obj002"] and doc.chunks[0].rows == 2
    rows = lake.read_chunk_files(spark, str(tmp_path), "csv")
    assert rows.count() == 3
    assert rows.agg(F.max("timestamp")).first()[0] == at(5)


def test_file_stat(spark, tmp_path):
    from trajlake.sources import files

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "one.txt").write_text("12345")
    (tmp_path / "a" / "two.txt").write_text("123")
    (tmp_path / "a" / "empty.txt").write_text("")
    paths = ["a", "a/", "a/b", "a/b/one.txt", "a/empty.txt", "a/b/none.txt", "a/two.txt"]
    wanted = spark.createDataFrame([(p, f"{'file://' * (i % 2)}{tmp_path}/{p}") for i, p in enumerate(paths)] + [("null", None)], "p string, uri string")
    got = {r.p: (r.found, r.files, r["size"]) for r in files.file_stat(spark, str(tmp_path), wanted).collect()}
    assert got == {
        "a": (True, 2, 8), "a/": (True, 2, 8), "a/b": (True, 1, 5), "a/b/one.txt": (True, 1, 5), "a/empty.txt": (False, 0, None),
        "a/b/none.txt": (False, 0, None), "a/two.txt": (True, 1, 3), "null": (False, 0, None),
    }
