"""Operators 11 to 13 against plain versions and their SQL, on tables with everything that may be odd in them."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from conftest import odd_documents, sentence

from checks import compare
from trajlake.llm import collocations, language, merkle, registry

# Names that the operators use inside.
EXTRA = "key string, pos long, n long, part int, digest string, id long, spans string, w1 string, f long, a long, share double"
VALUES = ("k", 1, 2, 3, "d", 4, "s", "w", 5, 6, 0.5)
WORDS = ["the", "cat", "sat", "New", "new", "york", "city", "é", "漢字", "a-b"]


def documents():
    rng = random.Random(8)
    rows = [(i, t, rng.choice(["en", "de", None, "", "und"]), s) for i, t, s in odd_documents()]
    for i in range(100, 160):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; ", "\r"]) for _ in range(rng.randrange(80)))
        rows.append((i, text, rng.choice(["en", "de", None, "und"]), rng.choice(["a", None])))
    rows += [(200, "x " * 3000, "en", "a"), (201, "New York City. " * 40, "xx", "a"), (201, "New York City. " * 40, "xx", "a")]
    return [(i, t, lang, s, None if i is None or i % 9 == 0 else len(t or ""), *VALUES) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def strange(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("strange"))
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    spark.createDataFrame(documents(), schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["op12_merkle", "op13_collocations"])
def test_strange_documents(spark, strange, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{strange}/documents.parquet/*.parquet'")
    ok, note = compare.compare(spark, con, strange, registry.QUERIES[name], registry.ORACLE[name])
    assert ok, note


# ---- 11 -----------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.QUERIES["op11_language"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_strange_documents(spark, strange):
    rows = registry.QUERIES["op11_language"](spark, strange).collect()
    docs = documents()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == sorted((d[0] is None, d[0]) for d in docs)
    learned = {d[2] for d in docs if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 and d[1] is not None} - {None}
    letters = collections.defaultdict(set)
    for d in docs:
        letters[d[0]].add(any(c.isalpha() for c in d[1] or ""))
    for r in rows:
        assert r.lang_pred in learned | {"und"} and 0 <= r.score <= 1
        if letters[r.doc_id] == {False}:
            assert (r.lang_pred, r.score) == ("und", 0)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_best_paths_are_best():
    rng = np.random.default_rng(3)
    for switch in (0.0, 0.7, 3.0):
        scores = rng.integers(-4, 0, (12, 3)).astype(np.float32)
        texts = [rng.integers(0, 12, n) for n in (1, 5, 6, 3, 6)]
        for ids, path in zip(texts, language.best_paths(scores, texts, switch), strict=True):

            def worth(p, ids=ids, scores=scores, switch=switch):
                return sum(scores[w, x] for w, x in zip(ids, p, strict=True)) - switch * sum(a != b for a, b in itertools.pairwise(p))

            most = max(worth(p) for p in itertools.product(range(3), repeat=len(ids)))
            assert worth(path.tolist()) == pytest.approx(most)


def test_spans_of_mixed_texts(spark):
    rng = random.Random(1)
    a, b, c = [[f"{x}{y}{z}" for x in s for y in s for z in s] for s in ("kotu", "gräl", "дома")]
    train = [(i, sentence(rng, 60, w), x) for i in range(60) for w, x in ((a, "aa"), (b, "bb"), (c, "cc"))]
    model = language.fitted(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "bb", "cc"]
    # Cyrillic letters leave one candidate.
    assert language.Model.scores(model, ["мода"]).argmax() == 2 and (model.scripts[0] & model.scripts[2]) == 0
    mixed = sentence(rng, 30, a) + ". " + sentence(rng, 25, b) + " 12 " + sentence(rng, 20, c)
    texts = [(1, mixed), (2, None), (3, "12 ½ _"), (4, "kotu " * 5 + "gräl " + "kotu " * 5), (5, sentence(rng, 5000, b))]
    found = {r.id: r.spans for r in language.labelled(spark.createDataFrame(texts, "id long, text string"), model).collect()}
    assert [(s.first, s.last, s.lang) for s in found[1]] == [(0, 29, "aa"), (30, 54, "bb"), (55, 74, "cc")]
    assert sum(s.letters for s in found[1]) == sum(c.isalpha() for c in mixed)
    assert found[2] == [] and found[3] == []
    assert [s.lang for s in found[5]] == ["bb"]
    free = {r.id: r.spans for r in language.labelled(spark.createDataFrame(texts, "id long, text string"), model, switch=0.0).collect()}
    assert [s.lang for s in free[4]] == ["aa", "bb", "aa"]


def test_sample_is_bounded_and_the_table_small(spark):
    rng = random.Random(2)
    docs = [(i, sentence(rng, 5, ["ab", "cd"]), f"l{i % 3}") for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    taken = language.sampled(frame, {f"l{i}": 1000 for i in range(3)}, 100).count()
    assert 200 < taken < 400
    many = spark.createDataFrame([(i, "word", f"l{i}") for i in range(2000)], "doc_id long, text string, lang string")
    model = language.fitted(many)
    assert model.counts.nbytes <= language.MODEL_BYTES and len(model.langs) == 2000


# ---- 12 -----------------------------------------------------------------------------------


def plain_root(nodes, fan):
    while len(nodes) > 1:
        nodes = [hashlib.sha256("".join(nodes[i : i + fan]).encode()).hexdigest() for i in range(0, len(nodes), fan)]
    return nodes[0]


@pytest.mark.parametrize(("fan", "levels"), [(2, 2), (3, 1)])
def test_many_rounds_and_other_fans(spark, fan, levels):
    """Blocks far smaller than the trees, so that nodes and paths pass through several rounds."""
    rng = random.Random(fan * 10 + levels)
    sizes = {f"k{i:02}": rng.randrange(1, 40) for i in range(11)} | {"k50": 1}
    rows = [(k, i, hashlib.sha256(f"{k}{i}".encode()).hexdigest()) for k, n in sizes.items() for i in range(n)]
    changed = {(k, i): hashlib.sha256(f"new {k}{i}".encode()).hexdigest() for k, i, _ in rows if rng.random() < 0.3}
    table = spark.createDataFrame([(*r, changed.get(r[:2], r[2])) for r in rows], "key string, id long, digest string, replaced string")
    found = merkle.manifest(table, fan, levels).fold().collect()
    leaves = {k: [d for key, _, d in rows if key == k] for k in sizes}
    subroots = {k: plain_root(v, fan) for k, v in leaves.items()}
    root = plain_root([subroots[k] for k in sorted(subroots)], fan)
    assert len(found) == len(rows)
    place = {d: (k, i) for k, i, d in rows}
    for r in found:
        k, i = place[r.leaf]
        assert (r.subroot, r.root) == (subroots[k], root)
        own = list(leaves[k])
        own[i] = changed.get((k, i), own[i])
        folded = subroots | {k: plain_root(own, fan)}
        assert r.folded_root == plain_root([folded[x] for x in sorted(folded)], fan)
        siblings, nodes, at = [], leaves[k], i
        for start in (None, sorted(subroots).index(k)):
            if start is not None:
                nodes, at = [subroots[x] for x in sorted(subroots)], start
            while len(nodes) > 1:
                first = at // fan * fan
                siblings += [x for j, x in enumerate(nodes[first : first + fan], first) if j != at]
                nodes = [hashlib.sha256("".join(nodes[j : j + fan]).encode()).hexdigest() for j in range(0, len(nodes), fan)]
                at //= fan
        assert r.proof_sha256 == hashlib.sha256("".join(siblings).encode()).hexdigest()


def test_fold_takes_right_siblings_only():
    """What lies to the left is in the kept state: it may be lost, and the root still comes out."""
    nodes = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(7)]
    new = nodes[0]
    block = merkle.Block(list(nodes), 3, 2)
    want = merkle.Block([*nodes[:5], new, nodes[6]], 3, 2).root()
    for level in block.levels:
        for i in range(5 >> block.levels.index(level)):
            level[i] = b"lost"
    assert block.fold(5, new) == want


# ---- 13 -----------------------------------------------------------------------------------


def plain_collocations(docs, longest, least, absorbed):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in docs:
        for piece in (text or "").encode().translate(collocations.FOLD).split(b"."):
            words = piece.decode().split()
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {
            p for q, a in some.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)
            if 100 * a >= absorbed * some[p := q[i : i + k]]
        }
        for p, a in some.items():
            if p not in gone:
                score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                out[lang, " ".join(p)] = (a, left, right, n, score)
    return out


@pytest.mark.parametrize(("longest", "least", "absorbed"), [(2, 1, 50), (3, 3, 50), (4, 2, 80)])
def test_collocations(spark, monkeypatch, longest, least, absorbed):
    monkeypatch.setattr(collocations, "HELD", 50)  # counts come in many parts
    rng = random.Random(longest)
    words = ["A", "b", "c", "dd", "é"]
    docs = [(rng.choice(["x", "y", None]), "".join(rng.choice(words) + rng.choice("      \t.,\n") for _ in range(40))) for _ in range(60)]
    docs += [("x", None), ("x", ""), ("x", " . "), ("z", "A b c")]
    frame = spark.createDataFrame(docs, "lang string, text string").coalesce(2)
    found = collocations.collocations(frame, longest, least, absorbed).collect()
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in found} == plain_collocations(docs, longest, least, absorbed)
    assert len(found) > 20


def test_long_texts_in_stretches(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["a", "bb", "c."]) + rng.choice([" ", " ", "\n"]) for _ in range(500)).encode()
    for n in (1, 2, 3):
        monkeypatch.setattr(collocations, "STRETCH", 1 << 24)
        whole = next(iter(collocations.stretches(text, n)))
        want = collections.Counter(tuple(whole[i : i + n]) for i in range(len(whole) - n + 1))
        monkeypatch.setattr(collocations, "STRETCH", 7)
        got = collections.Counter(tuple(w[i : i + n]) for w in collocations.stretches(text, n) for i in range(len(w) - n + 1))
        assert {k: v for k, v in got.items() if b"." not in k} == {k: v for k, v in want.items() if b"." not in k}


def test_products_beyond_64_bits(spark):
    counts = {
        1: spark.createDataFrame([("x", "a", 9 * 10**12), ("x", "b", 7 * 10**12)], "lang string, w1 string, f long"),
        2: spark.createDataFrame([("x", "a", "b", 6 * 10**12 + 1)], "lang string, w1 string, w2 string, f long"),
    }
    row = collocations.scored(counts, 2).first()
    assert row.score == 10**6 * (6 * 10**12 + 1) ** 2 // (9 * 10**12 * 7 * 10**12)


def test_first_of_each_in_steps(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MERGED", 2)
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(50), f"p{i:04}") for i in range(600)]
    frame = spark.createDataFrame(rows, "lang string, score int, phrase string").repartition(9)
    frame = frame.checkpoint() if spark.sparkContext.getCheckpointDir() else frame
    got = collocations.first_of_each(frame, "lang", [collocations.F.col("score").desc(), collocations.F.col("phrase")], 40).collect()
    for lang in "ab":
        want = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[1], r[2]))[:40]
        assert [(r.lang, r.score, r.phrase) for r in sorted((r for r in got if r.lang == lang), key=lambda r: r["rank"])] == want
