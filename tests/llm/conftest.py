"""Small tables with everything that may be odd in them, as folders like the given ones."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside, as columns of the input.
EXTRA = "row string, shard string, size long, id long, bucket long, mark long, node long, word string, text_ string"
LABELS = "doc_id long, quality int, toxic int, row string"
PAGES = "page_id long, url string, html string, first string"
ITEMS = "item_id long, text string, words string"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def odd_documents():
    """(doc_id, text, source): copies, near copies, shared passages, periodic and empty texts, nulls."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = sentence(rng, 200, vocabulary)
    near = base.split(" ")
    near[100] = "changed"
    passage = sentence(rng, 60, vocabulary)
    rows = [
        (0, base, "a"),
        (1, " ".join(near), "a"),
        (2, base, "b"),
        (3, base.upper(), "b"),
        (4, "x " * 90, "c"),
        (5, "x y " * 60, "c"),
        (6, None, "c"),
        (7, "", None),
        (8, " \t\r\n\x0b\x0c ", None),
        (9, "one two", "d"),
        (10, "one\ttwo", "d"),
        (11, sentence(rng, 40, vocabulary) + " " + passage + " " + sentence(rng, 40, vocabulary), "d"),
        (12, passage + "\n" + sentence(rng, 30, vocabulary), "e"),
        (13, sentence(rng, 30, vocabulary) + "  " + passage, "e"),
        (14, sentence(rng, 20000, vocabulary), "f"),
        (14, "same id, other text", "f"),
        (9, "one two", "d"),
        (None, "no id here", "g"),
        (None, "no id here", "g"),
        (15, "é ñ   ü x 漢字 \U0001f600", "é"),
        (16, sentence(rng, 34, vocabulary), "z"),
        (17, "y" * 30000, "z"),
        (-3, "negative id", "z"),
    ]
    for i in range(20, 70):
        rows.append((i, sentence(rng, rng.randrange(1, 120), vocabulary), rng.choice("abcdef")))
    return rows


def write(spark, folder, documents, labels, pages, items):
    docs = [(i, t, "en", s, None if t is None else len(t), "r", "s", 1, 2, 3, 4, 5, "w", "t") for i, t, s in documents]
    spark.createDataFrame(docs, f"{DOCS}, {EXTRA}").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*x, "r") for x in labels], LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(*x, "f") for x in pages], PAGES).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(*x, "w") for x in items], ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def odd_pages():
    rows = [
        (5, "http://a.example.com/x", "<p>same</p>"), (3, "http://b.example.com", "<p>same</p>"), (3, "http://b.example.com", "<p>same</p>"),
        (None, "https://user@A.Example.com.:80/", "<p>same</p>"), (1, None, None), (2, "", ""), (4, "no url", "\r\n\r\n"),
        (None, "http://x\r\ny.z", "alone"), (6, "ftp://h", "é " * 50000), (7, "http://h/", "WARC/1.1\r\n\r\n"),
    ]
    return rows + [(100 + i, f"http://s{i % 7}.d{i % 5}.org/{i}", f"<p>{i % 9}</p>") for i in range(60)]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    docs = odd_documents()
    labels = [(i, i % 3 != 0, i % 7 == 0) for i in range(0, 70, 2)]
    labels = [(i, int(q), int(t)) for i, q, t in labels] + [(None, 1, 0), (20, None, None), (20, 0, 1)]
    words = docs[11][1].split(" ")
    items = [(0, " ".join(words[40:80])), (1, None), (2, "one two"), (3, ""), (None, "no id " * 20), (4, "never seen words at all in here")]
    return write(spark, str(tmp_path_factory.mktemp("odd")), docs, labels, odd_pages(), items)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("none")), [], [], [], [])
