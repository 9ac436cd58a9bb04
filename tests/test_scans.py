"""Bucketed scans against plain loops, with buckets small enough to cut every run."""

from helpers import at, greedy, positions, seeded
from pyspark.sql import functions as F

from trajlake.operators import frames, motion, refractory, scans, stats


def numbers(spark, n=400, keys=3, seed=3):
    rng = seeded(seed)
    rows, used = [], set()
    while len(rows) < n:
        k, o = f"k{min(rng.randrange(keys), rng.randrange(keys))}", rng.randrange(-500, 1000)
        if (k, o) not in used:
            used.add((k, o))
            rows.append((k, o, rng.random() < 0.7, rng.randrange(100) if rng.random() < 0.4 else None))
    return rows, spark.createDataFrame(rows, "k string, o bigint, flag boolean, v int")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_neighbours(spark):
    rows, df = numbers(spark)
    bucketed = scans.with_bucket(df, "o", 10)
    got = scans.neighbour_row(bucketed, ["k"], "o", ["v"], "p")
    got = scans.neighbour_row(got, ["k"], "o", ["v"], "q", forward=True)
    found = {(r.k, r.o): (r.p and r.p.o, r.q and r.q.o) for r in got.collect()}
    for k, series in by_key(rows).items():
        for i, r in enumerate(series):
            before = series[i - 1][1] if i else None
            after = series[i + 1][1] if i + 1 < len(series) else None
            assert found[(k, r[1])] == (before, after)


def test_streaks(spark):
    rows, df = numbers(spark)
    got = scans.streak_lengths(
        scans.with_bucket(df.withColumn("not", ~F.col("flag")), "o", 4), ["k"], "o", {"flag": "run", "not": "off"}
    )
    rows_out = got.collect()
    assert all((r.run == 0) != (r.off == 0) for r in rows_out)
    found = {(r.k, r.o): r.run for r in rows_out}
    for k, series in by_key(rows).items():
        run = 0
        for r in series:
            run = run + 1 if r[2] else 0
            assert found[(k, r[1])] == run


def test_last_known(spark):
    rows, df = numbers(spark)
    got = scans.last_known(scans.with_bucket(df, "o", 4), ["k"], ["o"], "v", "seen")
    found = {(r.k, r.o): r.seen for r in got.collect()}
    for k, series in by_key(rows).items():
        last = None
        for r in series:
            last = r[3] if r[3] is not None else last
            assert found[(k, r[1])] == last


def test_ordinal(spark):
    rows, df = numbers(spark)
    found = {(r.k, r.o): r.n for r in scans.ordinal(df, ["k"], "o", 7, [], "n").collect()}
    for k, series in by_key(rows).items():
        for i, r in enumerate(series):
            assert found[(k, r[1])] == i


def test_expand_steps(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", 1)], "k string, n bigint")
    got = sorted((r.k, r.i) for r in scans.expand_steps(df, "n", "i", 3).collect())
    assert got == [("a", i) for i in range(10)] + [("c", 0)]
    long = spark.createDataFrame([("a", 1000), ("b", 9), ("c", 27)], "k string, n bigint")
    got = [(r.k, r.i) for r in scans.expand_steps(long, "n", "i", 3).collect()]
    assert sorted(got) == [(k, i) for k, n in (("a", 1000), ("b", 9), ("c", 27)) for i in range(n)]


def test_spacing(spark):
    rng = seeded(5)
    times = {"hot": [rng.random() * 3000 for _ in range(3000)], "b": [rng.random() * 5000 for _ in range(60)], "c": [7.0]}
    times["regular"] = [i * 0.2 for i in range(2000)]
    rows = [(k, at(t)) for k, series in times.items() for t in series]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    for gap, bucket in ((1.7, 600), (0.5, 10), (30.0, 60)):
        got = {}
        for r in refractory.spaced_instants(df, ["k"], "t", gap, bucket_seconds=bucket).collect():
            got.setdefault(r.k, []).append(r.t)
        for k, series in times.items():
            want = greedy([round((at(t) - at(0)).total_seconds() * 1e6) for t in series], round(gap * 1e6))
            assert sorted(round((t - at(0)).total_seconds() * 1e6) for t in got[k]) == want


def test_spacing_chain_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(refractory, "FAN", 4)
    monkeypatch.setattr(refractory, "PIECE_ROWS", 20)
    rng = seeded(6)
    series = [i * 0.2 for i in range(1500)] + [100 + rng.random() * 2 for _ in range(500)] + [5000.0]
    df = spark.createDataFrame([(at(t),) for t in series], "t timestamp_ntz")
    for bucket in (0.5, 4, 1000):
        got = sorted(r.t for r in refractory.spaced_instants(df, [], "t", 1.7, bucket_seconds=bucket).collect())
        want = greedy([round((at(t) - at(0)).total_seconds() * 1e6) for t in series], 1_700_000)
        assert [round((t - at(0)).total_seconds() * 1e6) for t in got] == want


def test_stalls(spark):
    rows = [(i * 0.1, "a", 0, 0, 0) for i in range(8)] + [(0.8, "a", 50, 0, 0)] + [(0.9 + i * 0.1, "a", 50, 0, 0) for i in range(7)]
    rows += [(i * 0.1, "b", i * 50, 0, 0) for i in range(16)]
    found = motion.stalls(positions(spark, rows), rows=5, bucket_seconds=1).collect()
    assert sorted((r.objid, r.timestamp) for r in found) == [("a", at(0.5)), ("a", at(1.3))]


def test_walls(spark):
    box = spark.createDataFrame([(0.0, 0.0, 0.0, 10.0, 5.0, 10.0, 1.0)],
        "center_x double, center_y double, center_z double, half_x double, half_y double, half_z double, wall_margin double")
    near = [(i, "a", 9.5, 0, 0) for i in range(6)]
    away = [(i, "b", 9.5 if i != 3 else 0.0, 0, 0) for i in range(6)]
    rows = positions(spark, near + away + [(i, "c", 0, 4.9, 0) for i in range(6)])
    assert [(r.objid, r.timestamp) for r in motion.wall_hugs(rows, box, rows=5, bucket_seconds=2).collect()] == [("a", at(4))]
    assert motion.wall_hugs(rows, box, rows=5, margin=0.0).count() == 0


def test_gap_fill(spark):
    df = spark.createDataFrame([("v", 2, "a"), ("v", 5, "b"), ("w", 0, "c")], "k string, s bigint, p string")
    targets = spark.createDataFrame([("v", 8), ("w", 3)], "k string, target bigint")
    got = sorted((r.k, r.s, r.p, r.is_duplicate) for r in frames.gap_fill(df, "k", "s", ["p"], targets, width=2).collect())
    assert got == [
        ("v", 2, "a", False), ("v", 3, "a", True), ("v", 4, "a", True), ("v", 5, "b", False), ("v", 6, "b", True),
        ("v", 7, "b", True), ("w", 0, "c", False), ("w", 1, "c", True), ("w", 2, "c", True),
    ]


def test_thin_grid_thirty_per_second(spark):
    rows = positions(spark, [(i / 60, o, 0, 0, 0) for i in range(60) for o in ("a", "b")])
    assert frames.thin_grid(rows, 30).count() == 60


def test_percentile(spark):
    rng = seeded(9)
    groups = {"a": [float(i) for i in range(20)], "b": [rng.expovariate(0.001) for _ in range(3001)], "c": [4.0], "d": [2.0] * 50 + [3.0]}
    groups["e"] = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(500)] + [-0.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    last = spark.createDataFrame([("n", v) for v in (float("nan"), 3.0, float("inf"))], "g string, v double")
    assert [stats.percentile_index(last, "g", "v", q).first().percentile for q in (0.0, 0.5)] == [3.0, float("inf")]
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.percentile for r in stats.percentile_index(df, "g", "v", q).collect()}
        assert got == {g: sorted(vs)[min(len(vs) - 1, int(q * len(vs)))] for g, vs in groups.items()}


def test_run_stats(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("b", 5.0, True), ("b", 1.0, False), ("c", 1.0, False)],
        "label string, wall_clock_s double, success boolean")
    got = {r.label: (r.runs_total, r.runs_success, r.wall_clock_s_mean, r.wall_clock_s_std) for r in stats.run_stats(df).collect()}
    assert got == {"a": (2, 2, 2.0, 1.0), "b": (2, 1, 5.0, 0.0), "c": (1, 0, None, None)}
    assert stats.speedup(df, "b", "a").select(F.col("speedup")).first()[0] == 2.5


def test_scans_without_keys(spark, monkeypatch):
    """Buckets in groups: neighbours and last values across empty buckets and groups."""
    monkeypatch.setattr(scans, "GROUP", 3)
    rng = seeded(11)
    orders = sorted(rng.sample(range(-300, 3000), 60))
    rows = [(o, rng.randrange(9) if rng.random() < 0.2 else None) for o in orders]
    df = scans.with_bucket(spark.createDataFrame(rows, "o bigint, v int"), "o", 5)
    both = scans.neighbour_row(scans.neighbour_row(df, [], "o", ["v"], "p"), [], "o", ["v"], "n", forward=True)
    found = {r.o: (r.p and (r.p.o, r.p.v), r.n and (r.n.o, r.n.v)) for r in both.collect()}
    for i, r in enumerate(rows):
        assert found[r[0]] == (rows[i - 1] if i else None, rows[i + 1] if i + 1 < len(rows) else None)
    seen = {r.o: r.s for r in scans.last_known(df, [], ["o"], "v", "s").collect()}
    last = None
    for o, v in rows:
        last = v if v is not None else last
        assert seen[o] == last


def test_labels_begin_anew(spark, monkeypatch):
    """Counters, forgotten positions and the cooldown, against a plain loop, over many small pieces."""
    from trajlake.operators import labelling

    monkeypatch.setattr(labelling, "FAN", 3)
    monkeypatch.setattr(refractory, "FAN", 3)
    rng = seeded(12)
    rows = []
    for k in ("a", "b", "c"):
        t, stuck, near = 0.0, False, False
        for _ in range(400):
            t += rng.choice((0.03, 0.2, 0.2, 0.2, 3.0 if rng.random() < 0.1 else 0.2))
            stuck = stuck if rng.random() < 0.85 else not stuck
            near = near if rng.random() < 0.9 else not near
            rows.append((k, at(round(t, 3)), stuck, near))
    df = spark.createDataFrame(rows, "objid string, timestamp timestamp_ntz, stuck boolean, near boolean")
    for cooldown, bucket in ((0.5, 2.0), (5.0, 2.0), (0.5, 100.0)):
        got = labelling.collision_rows(df, stuck_rows=5, wall_rows=4, cooldown=cooldown, bucket_seconds=bucket).collect()
        want, state = [], {}
        for k, t, stuck, near in rows:
            n, w, forgot, label = state.get(k, (0, 0, False, None))
            if not forgot:
                n = n + 1 if stuck else 0
            blocked = not forgot and n >= 5
            if not blocked:
                w = w + 1 if near else 0
            hit = (blocked or w >= 4) and (label is None or (t - label).total_seconds() >= cooldown)
            if hit:
                want.append((k, t, "stuck" if blocked else "wall"))
                n, w, label = 0, 0, t
            state[k] = (n, w, hit, label)
        assert sorted((r.objid, r.timestamp, r.kind) for r in got) == sorted(want)
        assert len(want) > 20
