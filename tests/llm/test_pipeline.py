"""Every stage of the pipeline on its own, against plain versions, on tables that hold odd rows."""

import collections
import math
import re
import struct

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from llm_helpers import jaccard_groups, waterfill

from trajlake.llm import decontaminate, importance, minhash_dedup, mixing, text

STAGES = dict(corpus_pipeline.STAGES)
NAMES = ["quality classifier", "near dedup", "decontamination", "mixing", "sharding"]


def key(r):
    return tuple((v is not None, v) for v in r)


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.read.parquet(f"{odd}/documents.parquet")


def run(spark, odd, docs, name):
    return text.written(STAGES[name](spark, docs, odd), "stage")


def test_stages_in_order(spark, odd, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    for name in NAMES:
        out = run(spark, odd, docs, name)
        if name == "sharding":
            assert set(out.columns) == set(docs.columns) and out.schema["shard"].dataType.typeName() == "integer"
        else:
            assert out.schema.simpleString() == docs.schema.simpleString()
        docs = out
    assert docs.count() > 10


def test_quality(spark, odd, docs):
    """The draw again, from counts of plain loops."""
    labels = collections.defaultdict(list)
    for r in spark.read.parquet(f"{odd}/labels.parquet").collect():
        if r.doc_id is not None:
            labels[r.doc_id].append(r.quality == 1 and (r.toxic or 0) == 0)
    good = {d: all(v) for d, v in labels.items()}
    rows = docs.collect()
    marks, heads = importance.Marks(), importance.Heads()
    size = importance.PARTS * importance.BUCKETS
    raw, target = np.zeros(size), np.zeros(size)
    for r in rows:
        found, _ = importance.features(r.text or "", marks, heads)
        np.add.at(raw, found, 1)
        if good.get(r.doc_id):
            np.add.at(target, found, 1)
    weights = np.zeros(size, np.float32)
    for b in np.flatnonzero(raw):
        part = slice(b // importance.BUCKETS * importance.BUCKETS, (b // importance.BUCKETS + 1) * importance.BUCKETS)
        due = raw[b] * target[part].sum() / raw[part].sum()
        ratio = math.log((target[b] + importance.PRIOR) / (due + importance.PRIOR)) if target[part].sum() else 0.0
        weights[b] = math.copysign(max(0.0, abs(ratio) - importance.CHANCE / (due + importance.PRIOR) ** 0.5), ratio)
    assert (weights > 0).any() and (weights < 0).any()
    rank = []
    for r in rows:
        found, n = importance.features(r.text or "", marks, heads)
        weight = weights[found].sum(dtype=float) * importance.TOKENS / n if n else importance.LOWEST
        mark = 42 if r.doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
        mark = xxhash.xxh64_intdigest(struct.pack("<i", importance.SEED), mark) % (1 << 52)
        rank.append((weight - math.log(-math.log((mark + 0.5) / (1 << 52))), weight))
    k = int(len(rows) * sum(good.values()) / len(good) + 0.5)
    last = sorted((x for x, _ in rank), reverse=True)[k - 1]
    want = [(key((r.doc_id, r.text)), w) for r, (x, w) in zip(rows, rank, strict=True) if x >= last]
    assert 0 < len(want) < len(rows)
    got = importance.drawn(
        docs, importance.F.col("text"), importance.F.col("doc_id"),
        importance.fit(docs, spark.read.parquet(f"{odd}/labels.parquet")), importance.F.col("doc_id"), importance.F.col("text"),
    ).collect()
    for (a, w), (b, v) in zip(sorted(want), sorted((key((r.doc_id, r.text)), r.log_weight) for r in got), strict=True):
        assert a == b and abs(w - v) < 1e-3
    kept = run(spark, odd, docs, "quality classifier").collect()
    assert sorted(key((r.doc_id, r.text)) for r in kept) == sorted(key((r.doc_id, r.text)) for r in got)
    assert not collections.Counter(map(str, kept)) - collections.Counter(map(str, rows))


def test_near_dedup(spark, odd, docs):
    rows = docs.collect()
    _, _, group = jaccard_groups([(r.doc_id, r.text) for r in rows], minhash_dedup.SHINGLE, minhash_dedup.PERCENT)
    kept = run(spark, odd, docs, "near dedup").collect()
    assert not collections.Counter(map(str, kept)) - collections.Counter(map(str, rows))
    # One row of each group, that with the smallest number; texts without words are groups of their own.
    groups = collections.defaultdict(list)
    for g, r in zip(group, rows, strict=True):
        groups[g].append(r)
    want = [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)).doc_id for g in groups.values()]
    assert sorted(key((r.doc_id,)) for r in kept) == sorted(key((d,)) for d in want)


def test_decontamination(spark, odd, docs):
    items = [decontaminate.normal_words(r.text) for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect() if r.item_id is not None]
    items = [w for w in items if len(w) >= decontaminate.GRAM]

    def hit(t):
        words = decontaminate.normal_words(t)
        for item in items:
            number = {w: i for i, w in enumerate(item)}
            if words:
                score, _ = decontaminate.align([np.array([number[w] for w in item])], [np.array([number.get(w, -3) for w in words])])
                if score[0] / len(item) >= decontaminate.LEAST_SCORE:
                    return True
        return False

    rows = docs.collect()
    kept = run(spark, odd, docs, "decontamination").collect()
    assert collections.Counter(map(str, kept)) == collections.Counter(str(r) for r in rows if not hit(r.text))
    assert len(kept) < len(rows)


def test_mixing(spark, odd, docs):
    rows, mixed = docs.collect(), run(spark, odd, docs, "mixing").collect()
    size, taken = collections.Counter(), collections.Counter()
    whole = collections.defaultdict(set)
    for r in rows:
        size[r.source] += len(re.findall(text.WORD, r.text or ""))
        whole[(r.doc_id, r.source)].add(r.text)
    passes = collections.Counter()
    for r in mixed:
        words = re.findall(text.WORD, r.text)
        assert r.n_chars == len(r.text) and words
        taken[r.source] += len(words)
        assert any(r.text == t or r.text in " ".join(re.findall(text.WORD, t or "")) for t in whole[(r.doc_id, r.source)]) or r.doc_id == 14
        passes[(r.doc_id, r.source)] += 1
    want = waterfill(size, mixing.WEIGHTS, mixing.MOST)
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 1.5 * max(1, min(mixing.BLOCK, size[s] // mixing.BLOCKS)) for s in size)
    copies = collections.Counter((r.doc_id, r.source) for r in rows)
    assert all(n <= mixing.MOST * copies[k] for k, n in passes.items())


def test_sharding(spark, odd, docs):
    rows, out = docs.drop("shard").collect(), run(spark, odd, docs, "sharding")
    assert collections.Counter(map(str, out.drop("shard").select(docs.drop("shard").columns).collect())) == collections.Counter(map(str, rows))
    sizes = collections.Counter()
    for r in out.collect():
        sizes[r["shard"]] += len((r.text or "").encode()) + 1
    assert set(sizes) <= set(range(8)) and max(sizes.values()) <= sum(sizes.values()) / 8 + 2 * 140_000
