"""The operators against brute force, on small tables that hold nulls, empties, ties, copies and long texts."""

import base64
import collections
import gzip
import hashlib
import itertools
import math
import re
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import odd_documents, odd_pages
from llm_helpers import jaccard_groups, removed, waterfill

from checks import compare
from trajlake.llm import (
    class_lm,
    decontaminate,
    imatch,
    importance,
    minhash_dedup,
    mixing,
    registry,
    reshard,
    substring_dedup,
    text,
    url_lists,
    warc,
)

WORD = re.compile(text.WORD)
SMALL = "/root/testdata/sf0.001"


def words(t):
    return WORD.findall(t or "")


def some(x):
    """Sortable even where it holds nulls."""
    return tuple((v is not None, v) for v in x)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, none, name):
    assert registry.QUERIES[name](spark, none).count() == 0


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_sql(spark, name):
    ok, note = compare.compare(spark, compare.connect(SMALL), SMALL, registry.QUERIES[name], registry.ORACLE[name])
    assert ok, note


# ---- 1 ------------------------------------------------------------------------------------


def test_reshard(spark, odd):
    rows = registry.QUERIES["op1_reshard"](spark, odd).collect()
    docs = odd_documents()
    want = sorted(some((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode()))) for i, t, _ in docs)
    assert sorted(some((r.doc_id, r.size, r.text_crc32)) for r in rows) == want
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in rows)
    assert max(sizes.values()) - min(sizes[k] for k in range(8)) <= 2 * largest


def test_flow_moves_least():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, m = rng.integers(1, 7, 2)
        supply = rng.integers(0, 50, n).tolist()
        room = reshard.even_capacities(sum(supply), int(m))
        flow = reshard.min_cost_flow(supply, room, lambda i, j: int(i != j))
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supply
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= room[k] for k in range(m))
        stays = sum(v for (i, j), v in flow.items() if i == j)
        assert stays == sum(min(supply[k], room[k]) for k in range(min(n, m)))


def test_flow_against_all_assignments():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(30):
        cost = rng.integers(0, 9, (3, 3))
        supply, room = [2, 1, 2], [2, 2, 1]
        flow = reshard.min_cost_flow(supply, room, lambda i, j: int(cost[i, j]))
        got = sum(v * cost[i, j] for (i, j), v in flow.items())
        units = [0, 0, 1, 2, 2]
        best = min(sum(cost[i, j] for i, j in zip(units, p, strict=True)) for p in itertools.permutations([0, 0, 1, 1, 2]))
        assert got == best
    with pytest.raises(ValueError):
        reshard.min_cost_flow([5], [4], lambda i, j: 0)


def test_files_that_stay_are_not_rewritten(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "cast(id % 4 AS string) AS source")
    schema = reshard.lay_out(rows.repartition(8), str(tmp_path / "s"), rows["doc_id"] % 4)
    layout, flow = reshard.reshard(spark, str(tmp_path / "s"), schema, text.text_bytes(reshard.F.col("row.text")), 4)
    assert layout.moved is None and len(layout.kept) == 32 and set(flow) == {(k, k) for k in range(4)}
    layout, flow = reshard.reshard(spark, str(tmp_path / "s"), schema, text.text_bytes(reshard.F.col("row.text")), 5)
    assert sum(v for (i, j), v in flow.items() if i != j) == 80_000
    assert len(layout.kept) >= 20 and layout.rows().count() == 4000
    assert {r["shard"]: r["count"] for r in layout.rows().groupBy("shard").count().collect()} == dict.fromkeys(range(5), 800)


# ---- 2 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("many", [2, 500])
def test_substrings(spark, odd, many, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    got = registry.QUERIES["op2_substring_dedup"](spark, odd).collect()
    docs = odd_documents()
    want = removed([words(t) for _, t, _ in docs], substring_dedup.WINDOW)
    expected = []
    for (i, t, _), gone in zip(docs, want, strict=True):
        kept = " ".join(w for w, g in zip(words(t), gone, strict=True) if not g)
        expected.append((i, len(words(t)), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(some, got)) == sorted(map(some, expected))
    assert sum(sum(g) for g in want) > 300


def test_automaton():
    rng = np.random.default_rng(3)
    for _ in range(60):
        texts = ["".join(rng.choice(list("ab"), rng.integers(1, 14))) for _ in range(rng.integers(1, 5))]
        automaton = substring_dedup.Automaton()
        states = [automaton.add(list(t), k << 40) for k, t in enumerate(texts)]
        automaton.close()
        for least in (1, 2, 3, 5):
            seen = collections.Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
            for t, s in zip(texts, states, strict=True):
                want = [i >= least - 1 and seen[t[i - least + 1 : i + 1]] > 1 for i in range(len(t))]
                assert automaton.repeated(s, least) == want


# ---- 3 ------------------------------------------------------------------------------------


def test_mixing(spark, odd):
    rows = registry.QUERIES["op3_mix_sources"](spark, odd).collect()
    docs = odd_documents()
    assert sorted(some((r.doc_id, r["size"])) for r in rows) == sorted(some((i, len(words(t)))) for i, t, _ in docs)
    size = collections.Counter()
    for _, t, s in docs:
        size[s] += len(words(t))
    want = waterfill(size, mixing.WEIGHTS, mixing.MOST)
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[(r.source_size, round(r.target, 6))] += r.taken
    pairs = collections.Counter()
    for s in size:
        pairs[(size[s], round(want[s], 6))] += 1
    assert set(taken) == set(pairs)
    block = {k: max(1, min(mixing.BLOCK, k[0] // mixing.BLOCKS)) for k in pairs}
    assert all(abs(taken[k] - k[1] * n) <= (0.02 * k[1] + 1.5 * block[k]) * n for k, n in pairs.items())
    again = registry.QUERIES["op3_mix_sources"](spark, odd).collect()
    assert sorted(map(some, again)) == sorted(map(some, rows))


def test_small_sources_meet_their_targets(spark, tmp_path):
    """Twelve sources smaller than a block each."""
    docs = [(10 * s + k, f"s{s:02}", " ".join(["w"] * 30)) for s in range(12) for k in range(5)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = mixing.op3_mix_sources(spark, str(tmp_path)).collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.doc_id // 10] += r.taken
        target[r.doc_id // 10] = r.target
    assert target == pytest.approx({s: 1800 * w / 32 for s, w in enumerate([5, 2, 1] * 4)})
    assert all(abs(taken[s] - t) <= 1.5 for s, t in target.items())


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(spark, n):
    F = mixing.F
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    assert n < 100 or sum(r.p == i for i, r in enumerate(got)) < 20


def test_shards_draw_from_all_sources(spark):
    sources = spark.createDataFrame([("a", 300_000), ("b", 300_000), ("c", 300_000)], "source string, size long")
    counts = mixing.shard_counts(mixing.quotas(mixing.targets(sources)), slots=500).collect()
    per = collections.defaultdict(dict)
    for r in counts:
        per[r.shard][r.sid] = r.n
    full = [v for v in per.values() if sum(v.values()) == 500]
    assert len(full) >= 6
    # 5 : 2 : 1 within a few standard deviations, and not the same in all.
    assert all(abs(v[1] / 500 - 5 / 8) < 0.1 and abs(v[3] / 500 - 1 / 8) < 0.08 for v in full)
    assert len({v[1] for v in full}) > 1


# ---- 4 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("often", [False, True])
def test_near_duplicates(spark, odd, often, monkeypatch):
    if often:
        monkeypatch.setattr(minhash_dedup, "SEEN", 2)
        monkeypatch.setattr(minhash_dedup, "IN_CHUNK", 2)
    got = registry.QUERIES["op4_minhash_dedup"](spark, odd).collect()
    docs = odd_documents()
    sizes, least, _ = jaccard_groups([(i, t) for i, t, _ in docs], minhash_dedup.SHINGLE, minhash_dedup.PERCENT)
    want = [(i, n, c, i == c) for (i, _, _), n, c in zip(docs, sizes, least, strict=True)]
    assert sorted(map(some, got)) == sorted(map(some, want))


def test_groups_of_edited_copies(spark, tmp_path):
    """Copies with few to many edits, without their original, and copies of copies."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(150)]
        for i in range(40):
            copy = list(base)
            for p in rng.choice(150, 1 + i % (2 + g), replace=False):
                copy[p] = f"e{g}x{i}p{p}"
            rows.append((len(rows) * 3 % 241 + 1000 * g, " ".join(copy)))
    chain = [f"c{k}" for k in range(100)]
    for i in range(30):
        chain[i * 3] = f"n{i}"
        rows.append((9000 + i, " ".join(chain)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.component_id for r in registry.QUERIES["op4_minhash_dedup"](spark, str(tmp_path)).collect()}
    _, least, _ = jaccard_groups(rows, 5, 85)
    assert got == {i: c for (i, _), c in zip(rows, least, strict=True)}
    assert len(set(least)) < len(rows) - 100


def test_set_marks():
    """Two halves that tell sets apart each on its own, whatever the order."""
    rng = np.random.default_rng(8)
    sets = [rng.integers(0, 1 << 63, 1 + i % 40).astype(np.uint64) for i in range(2000)]
    marks = [(minhash_dedup.half_mark(v, minhash_dedup._R), minhash_dedup.half_mark(v, minhash_dedup._T)) for v in sets]
    assert len({a for a, _ in marks}) == len({b for _, b in marks}) == len(sets) and all(a != b for a, b in marks)
    assert marks == [(minhash_dedup.half_mark(v[::-1], minhash_dedup._R), minhash_dedup.half_mark(v[::-1], minhash_dedup._T)) for v in sets]
    assert minhash_dedup.half_mark(sets[0][:0], minhash_dedup._R) is None


def test_frequent_values_in_little_memory(monkeypatch):
    """Counting sorts a chunk in place, gives memory back at its end, and counts what occurs often enough."""
    calls = []
    monkeypatch.setattr(text, "give_back", lambda: calls.append(1))
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 1000, 2000))) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, *texts[:2], *texts[:1]])], ["text"])
    list(minhash_dedup._frequent(iter([batch])))
    tracemalloc.start()
    rows = [r for b in minhash_dedup._frequent(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    known = minhash_dedup.WordHash()
    values = np.concatenate([minhash_dedup.all_shingles(t.encode(), known) for t in [*texts, *texts[:2], *texts[:1]]])
    found, n = np.unique(values, return_counts=True)
    assert {r["value"]: r["n"] for r in rows} == {int(v): int(k) for v, k in zip(found.view(np.int64), n, strict=True) if k >= minhash_dedup.IN_CHUNK}
    assert len(rows) >= 1996 and len(calls) == 2
    assert peak < 3 * values.nbytes


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 120)] + [(119, 50), (7, 7)]
    found = minhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 1 for i in range(1, 41)} | {i: 50 for i in [50, *range(100, 120)]}
    assert {r.node: r.component for r in found} == want


# ---- 5 ------------------------------------------------------------------------------------


def test_warc_pages(spark, odd):
    got = registry.QUERIES["op5_warc"](spark, odd).collect()
    pages = odd_pages()
    least = {}
    for i, _, h in pages:
        least[h or ""] = min((x for x in (least.get(h or ""), i) if x is not None), default=None)
    want = []
    for i, _, h in pages:
        data, first = (h or "").encode(), least[h or ""]
        revisit = first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(some, got)) == sorted(map(some, want))


def test_warc_round_trip(spark, odd, tmp_path):
    pages = spark.read.parquet(f"{odd}/pages.parquet")
    path = str(tmp_path / "w")
    warc.write_warc(warc.with_revisits(pages, least_bytes=8), path, size=2000, date="2026-01-31T23:59:59Z")
    rows = warc.read_warc(spark, path).collect()
    assert len(rows) == len(odd_pages()) and all(r.fault is None for r in rows)
    payloads = collections.Counter(h or "" for _, _, h in odd_pages())
    for r in rows:
        if r.record_type == "response":
            assert bytes(r.payload).decode() in payloads
        else:
            assert r.payload is None and r.payload_bytes >= 8
    # Every file is a plain sequence of gzip members.
    files = [f.read_bytes() for f in (tmp_path / "w").glob("archive=*/part-*")]
    assert len(files) > 4
    for data in files:
        found = list(warc.Reader(data).records())
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        assert all(head["warc-date"] == "2026-01-31T23:59:59Z" for head, _ in found)
        # Without its last record an archive is within its size.
        sizes = [len(gzip.compress(block, 6)) for _, block in found]
        assert len(data) - sizes[-1] <= 2000 + 1000


def test_warc_large_record(spark, tmp_path):
    """A page of 20 million bytes that do not compress well, and small ones about it."""
    rng = np.random.default_rng(3)
    large = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 7_000_000)))
    rows = [(1, "u", "small", None, False), (2, "u", large, None, False), (3, "u", "small too", None, False)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first long, revisit boolean").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"), size=1 << 20)
    assert len(list((tmp_path / "w").glob("archive=*/part-*"))) == 2
    got = warc.read_warc(spark, str(tmp_path / "w")).select("page_id", "payload_bytes", "fault").collect()
    assert sorted(map(tuple, got)) == [(1, 5, None), (2, len(large.encode()), None), (3, 9, None)]


def test_warc_reader_faults():
    one = warc.record(1, "http://a", b"payload" * 50_000, False, None, "2026-01-31T23:59:59Z")
    two = warc.record(2, "http://a", b"", False, None, "2026-01-31T23:59:59Z")
    data = gzip.compress(one) + b"\0" + gzip.compress(two) + b"\0\0"
    found = [warc._parsed(*r) for r in warc.Reader(data).records()]
    assert [(f[0], f[4], f[6]) for f in found] == [(1, 350_000, None), (2, 0, None)]
    broken = gzip.compress(one.replace(b"payloadpayload", b"payloadPayload", 1))
    assert warc._parsed(*next(warc.Reader(broken).records()))[6] == "block digest"
    with pytest.raises((ValueError, zlib.error)):
        list(warc.Reader(data[: len(data) // 2]).records())
    with pytest.raises(ValueError):
        list(warc.Reader(gzip.compress(b"HTTP/1.1 200\r\n\r\n")).records())
    with pytest.raises(ValueError):
        list(warc.Reader(gzip.compress(one[:-4])).records())


# ---- 6 ------------------------------------------------------------------------------------


def test_importance_on_held_out_labels(spark):
    """Fitted on the labels of even documents; the others are judged."""
    F = importance.F
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = importance.fit(docs, labels.where("doc_id % 2 = 0"))
    kept = importance.drawn(docs, F.col("text"), F.col("doc_id"), model, F.col("doc_id"))
    judged = labels.where("doc_id % 2 = 1").join(kept.withColumn("kept", F.lit(1)), "doc_id", "left")
    rows = judged.groupBy((F.expr("quality = 1 and toxic = 0")).alias("good")).agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()
    share = {r.good: r.share for r in rows}
    assert share[True] > 0.95 and share[False] < 0.1
    # Both directions count, and a text without tokens is worth least.
    assert (model.weights > 0).sum() > 50 and (model.weights < 0).sum() > 50
    texts = docs.sparkSession.createDataFrame([(1, ""), (2, None), (3, " \n"), (4, "a word")], "doc_id long, text string")
    found = {r.doc_id: r.judged.log_weight for r in importance.judged(texts, F.col("text"), F.col("doc_id"), model).collect()}
    assert found[1] == found[2] == found[3] == importance.LOWEST < found[4]


def test_importance_edges(spark, odd):
    rows = registry.QUERIES["op6_importance"](spark, odd).collect()
    ids = [r.doc_id for r in rows]
    docs = odd_documents()
    assert set(ids) <= {i for i, _, _ in docs} and 0 < len(rows) <= len(docs)
    empty = {i for i, t, _ in docs if not (t or "").strip()}
    assert all((r.log_weight == importance.LOWEST) <= (r.doc_id in empty) for r in rows)


def test_gumbel_draws_by_weight(spark):
    F = importance.F
    model = importance.Model(np.zeros(importance.PARTS * importance.BUCKETS, np.float32), None)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    kept = importance.drawn(docs, F.col("text"), F.col("doc_id"), model, F.col("doc_id"), share=0.25).collect()
    assert len(kept) == 1000
    # Equal weights: a draw at random, not a prefix.
    assert 1800 < np.mean([r.doc_id for r in kept]) < 2200


@pytest.mark.parametrize("k", [1, 3, 6, 7])
def test_kth_largest(spark, k):
    values = [5, -(1 << 62), 5, 1 << 61, 0, -1]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert text.kth_largest(df, "x", k) == (sorted(values, reverse=True)[k - 1] if k <= 6 else None)
    order = importance.ordered(np.array([-np.inf, -2.5, -0.0, 0.0, 1e-300, 3.0, np.inf]))
    assert list(order) == sorted(order) and order[2] == order[3]


# ---- 7 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("held", [200_000, 20])
def test_scores(spark, odd, held, monkeypatch):
    monkeypatch.setattr(class_lm, "HELD", held)
    rows = registry.QUERIES["op7_class_lm"](spark, odd).collect()
    docs = odd_documents()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [[*(w.translate(text.TO_LOWER) for w in words(t)), None] for _, t, _ in docs]
    counts = collections.Counter(w for (i, _, _), ws in zip(docs, tokens, strict=True) if not out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, _, _), ws in zip(docs, tokens, strict=True):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        want.append((i, out(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(map(some, got)) == sorted(map(some, want))
    assert all(r.score < 0 for r in rows)


def test_class_model_is_a_distribution(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model, counts = class_lm.train(docs)
    assert np.allclose((10**model.steps).sum(axis=1), 1)
    mass = collections.Counter()
    for w, n in zip(model.held[: class_lm.CLUSTERED], model.counts, strict=False):
        mass[model.classes[1 + model.held.index(w)]] += n / model.mass[model.classes[1 + model.held.index(w)]]
    assert all(abs(x - 1) < 1e-9 for x in mass.values())
    rows = class_lm.score(docs).collect()
    late = [r for r in rows if r.held_out]
    assert sum(r.score for r in late) > sum(r.base_score for r in late)


def test_exchange_gain():
    """The gain of a move is the change of the likelihood."""
    rng = np.random.default_rng(6)
    size = class_lm.ALL
    words_, classes = 12, rng.integers(0, 5, 12)
    pairs = rng.integers(0, 9, (words_, words_)).astype(float)

    def grid(cls):
        g = np.zeros((size, size))
        for a in range(words_):
            for b in range(words_):
                g[cls[a], cls[b]] += pairs[a, b]
        return g

    def likelihood(g):
        x = class_lm._xlogx
        return x(g).sum() - x(g.sum(axis=1)).sum() - x(g.sum(axis=0)).sum()

    g = grid(classes)
    for w in range(words_):
        after, before = np.zeros(size), np.zeros(size)
        np.add.at(after, classes, pairs[w])
        np.add.at(before, classes, pairs[:, w])
        to, gain = class_lm.best_class(int(classes[w]), after, before, pairs[w, w], g)
        moved = classes.copy()
        moved[w] = to
        assert abs(likelihood(grid(moved)) - likelihood(g) - gain) < 1e-6
        best = max(likelihood(grid(np.where(np.arange(words_) == w, c, classes))) for c in range(class_lm.CLASSES))
        assert abs(best - likelihood(grid(moved))) < 1e-6


@pytest.mark.parametrize("together", [7, 1 << 14])
def test_placed_classes(together, monkeypatch):
    """The classes of words left to endings are those that ``best_class`` finds, however many are placed together."""
    monkeypatch.setattr(class_lm, "PLACED_COUNTS", together)
    rng = np.random.default_rng(11)
    size = class_lm.ALL
    for _ in range(20):
        kinds = rng.integers(0, size, 30)
        pairs = rng.integers(0, 5, (30, 30)) * rng.integers(0, 2, (30, 30))
        kinds[:9] = class_lm.CLASSES + 1 + rng.integers(class_lm.ENDINGS, size=9)
        grid, after, before = np.zeros((size, size)), np.zeros((9, size)), np.zeros((9, size))
        np.add.at(grid, (kinds[:, None], kinds[None, :]), pairs)
        for w in range(9):
            np.add.at(after[w], kinds, pairs[w])
            np.add.at(before[w], kinds, pairs[:, w])
        twice = np.diag(pairs)[:9]
        got = class_lm.placed_classes(kinds[:9], after, before, twice, grid)
        assert got.tolist() == [class_lm.best_class(int(kinds[w]), after[w], before[w], twice[w], grid)[0] for w in range(9)]


def test_words_told_apart_together(monkeypatch):
    """Each text's words get the numbers that they have one by one, with 0 around each text."""
    texts = [b"One two\tTWO", None, b"", " \u00c9 \u00e9 \u6f22 \U0001f600\x0b\x1c".encode(), b"y" * 300 + b" " + b"ab " * 50 + b"y" * 299, b" \r\n", b"Zz end"]
    numbers = {}
    for text_ in texts:
        for w in class_lm.words(text_):
            numbers.setdefault(w, len(numbers) + 1)
    for together in (1 << 22, 2):
        monkeypatch.setattr(class_lm, "TOGETHER", together)
        seen = 0
        for at, some in class_lm.grouped(pa.array(texts, pa.binary())):
            assert at == seen and len(set(some.words)) == len(some.words)
            line = some.line(numbers)
            for i, (a, b) in enumerate(zip(some.first, some.first[1:], strict=False)):
                want = class_lm.words(texts[seen])
                assert [some.words[k] for k in some.place[a:b]] == want
                assert line[a + i : b + i + 2].tolist() == [0, *(numbers[w] for w in want), 0]
                seen += 1
        assert seen == len(texts)


def test_rows_of_a_word_are_added_up(spark):
    """A word's counts may come in any number of rows, over several batches."""
    rng = np.random.default_rng(15)
    grid = rng.integers(1, 1000, (class_lm.ALL, class_lm.ALL)).astype(float)
    counts = {f"w{i}": rng.integers(0, 3, class_lm.KINDS) for i in range(40)} | {"once": np.eye(class_lm.KINDS, dtype=int)[0]}
    whole = [(w, np.flatnonzero(n).tolist(), n[n > 0].tolist()) for w, n in counts.items()]
    split = [(w, [k], [1]) for w, kinds, ns in whole for k, n in zip(kinds, ns, strict=True) for _ in range(n)]
    rng.shuffle(split)
    assert len(split) > 2 * class_lm.PLACED
    schema = "word string, kinds array<short>, ns array<long>"
    of = lambda rows: {r.word: r.kind for r in class_lm.placed(spark.createDataFrame(rows, schema).coalesce(1), grid).collect()}
    split = [(str(w), [int(k) for k in ks], [int(n) for n in ns]) for w, ks, ns in split]
    assert of(split) == of(whole) and set(of(whole)) == set(counts) - {"once"}


@pytest.mark.parametrize("held", [200_000, 30])
def test_every_frequent_word_has_a_class(spark, held, monkeypatch):
    """Words past the first ones are clustered too, and scores are those of all words' classes."""
    monkeypatch.setattr(class_lm, "HELD", held)
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"w{min(int(x), 9000)}" for x in rng.zipf(1.3, 400))) for i in range(150)] + [(900, None)]
    rows += [(1000 + i, " ".join(f"k{(i * 300 + k) % 6000}" for k in range(300))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = class_lm.train(docs)
    named = {r.word: (r.n, r.kind) for r in counts.collect()}
    frequent = {w for w, (n, _) in named.items() if n >= 3}
    assert len(frequent) > class_lm.CLUSTERED and all(named[w][1] < class_lm.CLASSES for w in frequent)
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    end = class_lm.END

    def kinds(t):
        ending = lambda w: class_lm.CLASSES + 1 + zlib.crc32(w[-1:].encode()) % class_lm.ENDINGS
        return [end, *(named[w][1] if w in named else ending(w) for w in words(t)), end]

    grid = np.zeros((class_lm.ALL, class_lm.ALL))
    for i, t in rows:
        line = kinds(t)
        if not out(i):
            np.add.at(grid, (line[:-1], line[1:]), 1)
    assert (model.mass[: class_lm.CLASSES] == grid.sum(axis=0)[: class_lm.CLASSES]).all()
    want = {}
    for i, t in rows:
        line = kinds(t)
        score = model.steps[line[:-1], line[1:]].sum()
        for w in words(t):
            n, kind = named.get(w, (0, kinds(w)[1]))
            score += math.log10((n + (kind > end)) / model.mass[kind])
        want[i] = score
    got = {r.doc_id: r.score for r in class_lm.score(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


# ---- 8 ------------------------------------------------------------------------------------


def test_contaminated(spark, odd):
    rows = {(r.doc_id, r.item_id): r.score for r in registry.QUERIES["op8_decontaminate"](spark, odd).collect()}
    assert set(rows) == {(11, 0), (12, 0), (13, 0)}
    assert all(s == 1.0 for s in rows.values())


def test_edited_copies(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"v{i}" for i in range(5000)]
    pick = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    items = [(i, " ".join(pick(40))) for i in range(30)]
    docs, hit = [], set()
    for i, t in items:
        copy = t.split(" ")
        for p in range(3, 40, 6):
            copy[p] = "edited"
        del copy[20]
        copy.insert(10, "inserted")
        docs.append((i, " ".join(pick(100) + [w.upper() + "," for w in copy] + pick(80))))
        hit.add((i, i))
        docs.append((1000 + i, " ".join(pick(200) + copy[:5])))
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r.doc_id, r.item_id) for r in found} == hit


def test_edited_copies_beside_exact_ones(spark):
    """An exact copy of the item elsewhere hides no edited one, whichever words the edits left."""
    rng = np.random.default_rng(9)
    pick = lambda n: [f"v{w}" for w in rng.integers(0, 5000, n)]
    items = [(i, " ".join(pick(40))) for i in range(30)]
    docs, hit = [], set()
    for i, t in items:
        for k, every in enumerate([0, 4, 5, 6]):
            copy = t.split(" ")
            for p in range(3, 40, every) if every else []:
                copy[p] = f"edit{k}"
            docs.append((10 * i + k, " ".join(pick(60) + copy + pick(60))))
            hit.add((10 * i + k, i))
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r.doc_id, r.item_id) for r in found} == hit


def test_frequent_words_make_long_seeds(spark):
    """Texts of a few frequent words share many n-grams with items by chance; hardly any is aligned, all copies are found."""
    rng = np.random.default_rng(12)
    share = 1 / np.arange(1, 5001)
    pick = lambda n: [f"v{w}" for w in rng.choice(5000, n, p=share / share.sum())]
    items = [(i, " ".join(pick(40))) for i in range(200)]
    docs, hit = [], set()
    for i in range(1000):
        words = pick(300)
        if i % 20 == 0:
            copy = items[i // 20][1].split(" ")
            copy[7::8] = pick(len(copy[7::8]))
            words[100:100] = copy
            hit.add((i, i // 20))
        docs.append((i, " ".join(words)))
    docs, items = spark.createDataFrame(docs, "key long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.candidates(docs, items).count() < 500
    found = decontaminate.contaminated(docs, items, "key").collect()
    assert {(r.key, r.item_id) for r in found} == hit


def test_seeds():
    """Seeds are the shortest that are rare enough; each is found in any text that holds it, grown from its beginnings."""
    rng = np.random.default_rng(13)
    known = decontaminate.WordHash()
    words = [f"w{x}" for x in rng.integers(0, 50, 60)]
    each = decontaminate.hashes(words, known)
    bits = rng.uniform(0.5, 6, 60).astype(np.float32)
    places, found, whole = decontaminate.seeds(each, bits, 20.0)
    ends = {}
    for at in range(60):
        end = next((e for e in range(at + decontaminate.GRAM, 61) if bits[at:e].sum() >= 20 - 1e-4), None)
        if end is not None:
            ends[at] = end
    assert {p for p, w in zip(places, whole, strict=True) if w} == set(ends)
    for p, g, w in zip(places, found, whole, strict=True):
        if w:
            assert g == decontaminate.grams(each[p : ends[p]], ends[p] - p).view(np.int64)[0]

    def filled(flag):
        out = np.zeros(decontaminate.FILTER_BITS >> 6, np.uint64)
        for g in (x for x, w in zip(found, whole, strict=True) if w == flag):
            slot = g & (decontaminate.FILTER_BITS - 1)
            out[slot >> 6] |= np.uint64(1 << (slot & 63))
        return out

    where, hits = decontaminate.seed_hits(each, filled(True), filled(False))
    want = {(p, g) for p, g, w in zip(places, found, whole, strict=True) if w}
    assert want <= set(zip(where.tolist(), hits.tolist(), strict=True))
    assert not len(decontaminate.seed_hits(each[:2], filled(True), filled(False))[0])


def test_words_hashed_together(monkeypatch):
    """Words of many texts at a time get the hashes that they have one by one, whatever their letters and lengths."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    some = [every[i : i + 5] for i in range(0, len(every), 997)]
    texts = ["One two,three_4", None, "", "\u0130 \u0391\u03a3 \u03a3\n\u03a3a x\U0001f600y  z", "y" * 300 + " " + "é" * 30, " \t", "ß" * 24 + "s", *some, "end"]
    known = decontaminate.WordHash()
    for together in (1 << 20, 40):
        monkeypatch.setattr(decontaminate, "TOGETHER", together)
        groups = list(decontaminate.hashed(pa.array(texts, pa.string())))
        assert len(groups) == 1 if together > len(every) // 5 else len(groups) > 9
        seen = []
        for at, words in groups:
            assert at == len(seen)
            for low, high in zip(words.first, words.first[1:], strict=False):
                want = decontaminate.normal_words(texts[len(seen)])
                assert words.hashes[low:high].tolist() == decontaminate.hashes(want, known).tolist()
                assert high == low or words.between(low, high) == want
                seen.append(high - low)
        assert len(seen) == len(texts)
    assert (decontaminate._in_words() == [bool(re.match(r"\w", chr(c))) for c in range(0x110000)]).all()


def test_seeds_end_with_their_text():
    each = decontaminate.hashes("a b c d e".split(), decontaminate.WordHash())
    filled = np.full(decontaminate.FILTER_BITS >> 6, ~np.uint64(0))
    empty = np.zeros_like(filled)
    assert decontaminate.seed_hits(each, filled, empty, np.array([0, 2, 2, 5]))[0].tolist() == [2]
    assert decontaminate.seed_hits(each, filled, filled, np.array([0, 0, 4, 5]))[0].tolist() == [0, 0, 1]


def test_texts_of_one_item(spark):
    """Each text of an item is found, however rare the other's words are."""
    rng = np.random.default_rng(10)
    pick = lambda n: " ".join(f"v{w}" for w in rng.integers(0, 5000, n))
    often, rare = pick(40), pick(40)
    docs = [(i, f"{pick(50)} {often} {pick(50)}") for i in range(3)] + [(3, f"{pick(50)} {rare}"), (4, pick(100))]
    items = spark.createDataFrame([(0, often), (0, rare)], "item_id long, text string")
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in found} == {(i, 0, 1.0) for i in range(4)}


def test_alignment():
    rng = np.random.default_rng(8)
    a = [rng.integers(0, 4, rng.integers(1, 12)) for _ in range(40)]
    b = [rng.integers(0, 4, rng.integers(1, 20)) for _ in range(40)]
    got, _ = decontaminate.align(a, b)
    for x, y, s in zip(a, b, got, strict=True):
        h = np.zeros((len(x) + 1, len(y) + 1))
        for i in range(len(x)):
            for j in range(len(y)):
                step = decontaminate.MATCH if x[i] == y[j] else decontaminate.MISMATCH
                h[i + 1, j + 1] = max(0, h[i, j] + step, h[i, j + 1] + decontaminate.GAP, h[i + 1, j] + decontaminate.GAP)
        assert h.max() == s


# ---- 9 ------------------------------------------------------------------------------------


def test_intervals_as_of(spark):
    entries = [
        ("example.com", 10, "block"), ("example.com", 20, "drop"), ("example.com", 100, "block"), ("A.example.com", 12, "allow"),
        ("tie.org", 5, "allow"), ("tie.org", 5, "block"), (None, 1, "block"), ("x.org", None, "block"), ("x.org", 1, "what"),
    ]
    captures = [
        (1, "http://example.com/", 9), (2, "http://example.com/", 10), (3, "http://b.example.com/", 19), (4, "http://example.com/", 20),
        (5, "https://u:p@a.EXAMPLE.com:8080/p", 15), (6, "http://notexample.com", 15), (7, "http://tie.org", 6), (8, None, 6),
        (9, "http://example.com", None), (10, "http://example.com", 5000), (10, "http://example.com", 5000), (11, "http://x.org", 3),
    ]
    spans = url_lists.intervals(spark.createDataFrame(entries, "domain string, day long, action string"))
    rows = spark.createDataFrame(captures, "page_id long, url string, day long").selectExpr("*", "'x' AS verdict", "1 AS bucket", "page_id * 2 AS _id", "'n' AS _note", "0 AS row")
    got = url_lists.as_of(rows, spans, "url", "day").collect()
    want = {1: "none", 2: "block", 3: "block", 4: "none", 5: "allow", 6: "none", 7: "block", 8: "none", 9: "none", 10: "block", 11: "none"}
    assert len(got) == len(captures) and {r.page_id: r.verdict for r in got} == want
    assert all((r._id, r._note, r["row"], r.bucket) == (2 * r.page_id, "n", 0, 1) for r in got)
    assert {(r.entry, r.valid_from, r.valid_to) for r in got if r.page_id == 3} == {("example.com", 10, 20)}


def test_url_verdicts_on_odd_pages(spark, odd):
    ok, note = compare.compare(spark, _views(odd), odd, registry.QUERIES["op9_url_lists"], registry.ORACLE["op9_url_lists"])
    assert ok, note


def _views(folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return con


# ---- 10 -----------------------------------------------------------------------------------


def test_fingerprints(spark, odd):
    rows = registry.QUERIES["op10_imatch"](spark, odd).collect()
    docs = [(i, t or "") for i, t, _ in odd_documents()]
    # Rows without id come last, those of one id in the order of Spark's hash of the text.
    F = imatch.F
    marks = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in docs], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    docs.sort(key=lambda d: (d[0] is None, -(d[0] or 0), marks[d[1]]))
    want, nexts = [], collections.defaultdict(set)
    for k, (i, t) in enumerate(docs):
        other = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest()))
        nexts[want[-1]].add((t, other))
    assert sorted(some(r[:3]) for r in rows) == sorted(map(some, want))
    by_text = collections.defaultdict(set)
    for r in rows:
        for t, _ in nexts[tuple(r[:3])]:
            by_text[t].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1
    assert all(len(p) == 1 for p in by_text.values())


def test_whole_lexicon_print_is_of_the_terms_in_the_band(spark):
    F = imatch.F
    texts = ["a b c d", "d C b a a", "a b c e", "a f", "a g", "a h", "a i", ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    bits = imatch.lexicon(docs, "text", len(texts), (0.2, 0.5))
    # b, c and d are in two or three of eight texts; the others are too rare or too common.
    first = [r.p[0] for r in docs.select(imatch.fingerprint(F.col("text"), bits).alias("p")).collect()]
    assert first[0] == first[1] and first[0] != first[2] is not None
    assert first[3:] == [None] * 5


def plain_prints(texts, every):
    """Fingerprints by plain Python; ``every`` are the texts that decide on the lexicon."""
    mark = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    terms = lambda t: {w for w in re.split(text.GAP, t.lower()) if w}
    share = collections.Counter(mark(w) % imatch.SLOTS for t in every for w in terms(t))
    low, high = imatch.BAND
    lexicon = {s for s, n in share.items() if low <= n / len(every) <= high}
    signed = lambda m: m - (1 << 64) if m >> 63 else m

    def one(kept):
        if not kept:
            return "."
        h = 42
        for m in kept:
            h = xxhash.xxh64_intdigest(struct.pack("<q", m), h)
        return f"{h:x}"

    out = []
    for t in texts:
        marks = [m for m in map(mark, terms(t)) if m % imatch.SLOTS in lexicon]
        lists = [marks]
        for seed in range(imatch.SEEDS):
            for level in range(imatch.DENSEST, imatch.DENSEST + imatch.LEVELS):
                lists.append([m for m in marks if not (m >> (20 + 11 * seed)) & ((1 << level) - 1)])
        out.append("-".join(one(sorted(map(signed, kept))) for kept in lists))
    return out


def plain_likeness(a, b):
    pairs = [(x, y) for x, y in zip(a.split("-"), b.split("-"), strict=True) if (x, y) != (".", ".")]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


def test_fingerprints_by_plain_python(spark, tmp_path):
    rng = np.random.default_rng(14)
    ids = [int(i) for i in rng.permutation(700)] + [10**15, -(10**17)]
    docs = [(i, None if i % 90 == 7 else " ".join(f"T{w}" for w in rng.integers(0, 400, rng.integers(0, 60)))) for i in ids]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in imatch.op10_imatch(spark, str(tmp_path)).collect()}
    docs = sorted(((i, t or "") for i, t in docs), reverse=True)
    texts = [t for _, t in docs]
    following = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
    own, changed = plain_prints(texts, texts), plain_prints(edited, texts)
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        r = got[i]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(t), own[k], changed[k])
        assert r.edited_sha256 == hashlib.sha256(edited[k].encode()).hexdigest()
        assert r.near_edited == pytest.approx(plain_likeness(own[k], changed[k]))
        assert r.near_next == pytest.approx(plain_likeness(own[k], own[(k + 1) % len(docs)]))


def test_buckets_follow_the_counts(spark):
    """Far-off ids, one id on a third of the rows, and rows without id make no large bucket, and none out of order."""
    ids = [*range(5000), 10**15, -(10**18), *[77] * 6000, *[None] * 6000, *(10**12 + 10**9 * k + j for k in range(40) for j in range(100))]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = imatch.bucketed(docs).withColumn("mark", imatch.F.xxhash64("text")).collect()
    assert len(rows) == len(ids)
    size = collections.Counter(r.bucket for r in rows)
    assert max(size.values()) <= 2 * imatch.BUCKET_ROWS
    rows.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.mark))
    assert all(a.bucket <= b.bucket for a, b in itertools.pairwise(rows))
    found = dict(imatch.followed(docs.sparkSession.createDataFrame([(b,) for b in size], "bucket long")).collect())
    order = sorted(size)
    assert found == dict(zip(order, order[1:] + order[:1], strict=True))
