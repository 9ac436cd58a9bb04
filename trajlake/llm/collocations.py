"""Phrase collocations from sorted count streams.

Counts of all word sequences up to ``LONGEST`` words are kept as streams in two orders: by the first words
(prefix order), where a phrase lies beside the phrases it begins with, and by the last words (suffix order), where
it lies beside those it ends with. Sort-merge joins run the streams in lockstep: in prefix order they give
each phrase the counts of its left parts, in suffix order those of its right parts, and from the longer
phrases in both orders comes how often a phrase is extended. No join builds a hash table, so memory does not
grow with a vocabulary, and adaptive execution splits frequent first or last words.

A phrase is at most as frequent as any part of it, so a sequence is only counted where both its parts of one word less
reach ``LEAST``. Which do is known in the tasks from a bit set of fixed size over hashes; false hits
count a sequence in vain, the sums decide. Words are cut from whole texts; each task adds up what it sees
before anything is shuffled.

Null texts have no words and a null lang is ``und``, together with documents of that lang.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.llm.text import LOWER, UPPER, table, texts_of, written

#: Words of the longest candidates, and the least count of one.
LONGEST = 3
LEAST = 10
#: A candidate goes if a longer one that holds it has this share of its count, in percent.
ABSORBED = 50
#: Candidates that are returned per lang.
BEST = 2000
UNKNOWN = "und"
#: Bits of the set that tells which sequences are frequent, and those of one row of it.
BITS, ROW_BITS = 26, 16
#: Words that a task holds before it hands on their counts, and distinct ones.
HELD, DISTINCT = 2_000_000, 1_000_000
#: Bytes of a text that are cut into words at a time.
STRETCH = 1 << 24

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
END = b"."
#: Lower-cases A-Z and turns each separator into the first.
FOLD = bytes.maketrans(SEPARATORS + UPPER.encode(), END * len(SEPARATORS) + LOWER.encode())


def marked_words(text: bytes | None) -> list[bytes]:
    """The words of a text with ``END`` between its pieces. No word can hold a separator."""
    return text.translate(FOLD).replace(END, b" . ").split() if text else []


def stretches(text: bytes | None, n: int) -> Iterator[list[bytes]]:
    """``marked_words`` in stretches, each after the last ``n - 1`` of the one before: no sequence of ``n`` is met twice."""
    if text is None or len(text) <= STRETCH:
        yield marked_words(text)
        return
    carried: list[bytes] = []
    first = 0
    while first < len(text):
        last = text.find(b" ", first + STRETCH)
        last = len(text) if last < 0 else last
        words = carried + marked_words(text[first:last])
        yield words
        carried, first = words[len(words) - min(n - 1, len(words)) :], last


class Words(dict):
    """Numbers for words, given at first sight; 0 is ``END``."""

    def __init__(self) -> None:
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def columns(n: int) -> list[str]:
    return [f"w{i}" for i in range(1, n + 1)]


def slots(hashes: list[np.ndarray]) -> np.ndarray:
    """The bits of sequences, from their words' hashes; ``slot`` is the same in SQL."""
    out = hashes[0]
    for h in hashes[1:]:
        out = out * np.uint32(31) + h  # modulo 2 ** 32
    return out >> np.uint32(32 - BITS)


def slot(words: list[str]) -> Column:
    hashes = [F.crc32(F.concat("lang", F.lit(" "), w).cast("binary")) for w in words]
    out = hashes[0]
    for h in hashes[1:]:
        out = (out * 31 + h).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(out, 32 - BITS)


def bit_set(frequent: DataFrame, n: int) -> bytes:
    """A bit for each sequence of the table: 8 MB, however many there are. Each row is 8 KB of it."""

    def packed(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << ROW_BITS, dtype=bool)
        bits[group["slot"].to_numpy() & ((1 << ROW_BITS) - 1)] = True
        return pa.table({"part": group["part"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    hit = frequent.select(slot(columns(n)).alias("slot")).distinct()
    rows = hit.withColumn("part", F.shiftright("slot", ROW_BITS)).groupBy("part")
    whole = bytearray(1 << (BITS - 3))
    size = 1 << (ROW_BITS - 3)
    for part, bits in rows.applyInArrow(packed, "part long, bits binary").collect():
        whole[part * size : (part + 1) * size] = bits
    return bytes(whole)


def starts(ids: np.ndarray, n: int, hashes: np.ndarray | None, bits: np.ndarray | None) -> np.ndarray:
    """Where sequences of ``n`` words start that cross no end and whose parts may be frequent."""
    last = len(ids) - n + 1
    if last < 1:
        return np.empty(0, dtype=np.int64)
    good = np.ones(last, dtype=bool)
    for i in range(n):
        good &= ids[i : last + i] > 0
    if bits is not None:
        at = slots([hashes[ids[i : last + 1 + i]] for i in range(n - 1)])
        hit = (bits[at >> np.uint32(3)] >> (7 - (at & np.uint32(7))).astype(np.uint8)) & 1 > 0
        good &= hit[:-1] & hit[1:]
    return np.flatnonzero(good)


def counted(lang: str, words: Words, texts: list[np.ndarray], n: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(key, f) of the sequences of ``n`` in some texts; a key is lang and words joined by blanks, as words hold none."""
    known, ids = list(words), np.concatenate(texts)
    start = zlib.crc32(lang.encode() + b" ")
    hashes = None if bits is None else np.array([zlib.crc32(w, start) for w in known], dtype=np.uint32)
    at = starts(ids, n, hashes, bits)
    # A word more each time; what has been seen is numbered anew, so that keys stay small.
    keys, seen = ids[at].astype(np.int64), []
    for i in range(1, n):
        distinct, keys = np.unique(keys * len(known) + ids[at + i], return_inverse=True)
        seen.append(distinct)
    counts = np.bincount(keys, minlength=1)
    keys = np.flatnonzero(counts)
    counts, parts = counts[keys], []
    for distinct in reversed(seen):
        parts.append(distinct[keys] % len(known))
        keys = distinct[keys] // len(known)
    parts.append(keys)
    names = pa.array(known, pa.binary()).cast(pa.string())
    for first in range(0, len(counts), 100_000):
        some = slice(first, first + 100_000)
        taken = [names.take(pa.array(p[some])) for p in reversed(parts)]
        key = pc.binary_join_element_wise(pa.scalar(lang), *taken, " ")
        yield pa.RecordBatch.from_arrays([key, pa.array(counts[some])], ["key", "f"])


def sequences(docs: DataFrame, n: int, bits: bytes | None) -> DataFrame:
    """Counts of the sequences of ``n`` words; those with a part that is not in ``bits`` may be left out."""
    shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = None if shared is None else np.frombuffer(shared.value, dtype=np.uint8)
        words: dict[str, Words] = {}
        held: dict[str, list[np.ndarray]] = {}
        total = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch.column("text")), strict=True):
                for found in stretches(text, n):
                    numbers = words.setdefault(lang, Words()).__getitem__
                    # Texts end as pieces do.
                    ids = np.zeros(len(found) + 1, dtype=np.int32)
                    ids[:-1] = np.fromiter(map(numbers, found), dtype=np.int32, count=len(found))
                    held.setdefault(lang, []).append(ids)
                    total += len(found)
                    if total >= HELD or sum(map(len, words.values())) >= DISTINCT:
                        for x in held:
                            yield from counted(x, words[x], held[x], n, frequent)
                        words, held, total = {}, {}, 0
        for x in held:
            yield from counted(x, words[x], held[x], n, frequent)

    return docs.mapInArrow(run, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))


def split_keys(counts: DataFrame, n: int) -> DataFrame:
    """(lang, w1 .., f): the words are the last ``n`` parts of a key, whatever the lang holds."""
    phrase = F.substring_index("key", " ", -n)
    lang = F.expr(f"left(key, char_length(key) - char_length(substring_index(key, ' ', -{n})) - 1)")
    words = F.split(phrase, " ")
    return counts.select(lang.alias("lang"), *[words[i].alias(w) for i, w in enumerate(columns(n))], "f")


def released(spark: SparkSession) -> None:
    """Let the shuffle files of finished steps go, which Spark keeps until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def merged(left: DataFrame, counts: DataFrame, names: list[str], found: str, how: str = "inner") -> DataFrame:
    """``left`` with the count of the sequence in its columns ``names``: both sorted by it and merged."""
    right = counts.toDF("lang", *names, found)
    return left.join(right.hint("merge"), ["lang", *names], how)


def scored(counts: dict[int, DataFrame], n: int) -> DataFrame:
    """Phrases of ``n`` words with a, and l, r and score of their weakest cut."""
    words = columns(n)
    out = counts[n].withColumnRenamed("f", "a")
    for k in range(n - 1, 0, -1):
        out = merged(out, counts[k], words[:k], f"l{k}")
    for k in range(1, n):
        out = merged(out, counts[n - k], words[k:], f"r{k}")
    cuts = []
    for k in range(1, n):
        # At most 1,000,000, as no part is rarer than the whole; the products are exact in 38 digits.
        score = F.expr(f"(CAST(1000000 AS DECIMAL(38, 0)) * a * a) div (CAST(l{k} AS DECIMAL(19, 0)) * r{k})")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    cut = F.array_min(F.array(*cuts))
    return out.select("lang", *words, "a", cut.alias("cut")).select("lang", *words, "a", "cut.l", "cut.r", "cut.score")


def extended(counts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Of sequences of ``n``, the count of the most frequent one that begins, and that ends, with each shorter one."""
    words = columns(n)
    return tuple(counts.groupBy("lang", *part).agg(F.max("f")) for part in (words[:-1], words[1:]))


#: Parts that are put together at a time on the way to the first rows of a key.
MERGED = 32


def first_of_each(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key, with ``rank``: of each key and partition, then of ``MERGED`` of these, and so on.

    No task sorts more than ``MERGED * k`` rows of a key beyond those of one partition. ``rows`` is a written table.
    """
    parts = rows.rdd.getNumPartitions()
    rows = rows.withColumn("part", F.spark_partition_id())
    while True:
        own = Window.partitionBy(key, "part").orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
        if parts <= 1:
            return rows.drop("part")
        parts = -(-parts // MERGED)
        rows = rows.withColumn("part", F.call_function("div", F.col("part"), F.lit(MERGED)).cast("int"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, absorbed: int = ABSORBED) -> DataFrame:
    """All phrases of 2 to ``longest`` words that stand on their own: lang, phrase, a, l, r, n, score.

    ``docs`` has lang and text. A phrase that is a part of longer ones goes if one of them has the share
    ``absorbed`` of its count; one word more is enough to look at, as still longer ones are rarer.
    """
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    every = split_keys(written(sequences(texts, 1, None), "phrase-words"), 1)
    counts = {1: every.where(F.col("f") >= least)}
    for n in range(2, longest + 1):
        bits = bit_set(counts[n - 1], n - 1)
        released(docs.sparkSession)
        found = sequences(texts, n, bits).where(F.col("f") >= least)
        counts[n] = written(split_keys(found, n), "phrase-counts")
    released(docs.sparkSession)
    out = None
    for n in range(2, longest + 1):
        rows = scored(counts, n)
        if n < longest:
            prefix, suffix = extended(counts[n + 1], n + 1)
            rows = merged(merged(rows, prefix, columns(n), "after", "left"), suffix, columns(n), "before", "left")
            longer = F.greatest(F.coalesce("after", F.lit(0)), F.coalesce("before", F.lit(0)))
            rows = rows.where(100 * longer < absorbed * F.col("a"))
        rows = rows.select("lang", F.concat_ws(" ", *columns(n)).alias("phrase"), "a", "l", "r", "score")
        out = rows if out is None else out.unionAll(rows)
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    return out.join(total, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each lang of ``documents``, phrases of 2 or 3 words.

    Null and empty texts have no words, repeated rows count again, very long texts are read in stretches,
    ties go by the phrase's bytes. A null lang counts as ``und``. A lang without candidates has no rows.
    """
    found = written(collocations(table(spark, sf_dir, "documents", "lang", "text")), "phrases")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = first_of_each(found, "lang", order, BEST)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece
    FROM documents
),
lists AS (
    SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
),
words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM lists),
runs AS (
    SELECT lang, w1, lead(w1) OVER follow AS w2, lead(w1, 2) OVER follow AS w3 FROM words
    WINDOW follow AS (PARTITION BY piece ORDER BY i)
),
counts AS (
    SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM runs GROUP BY ALL
    UNION ALL
    SELECT lang, 2, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL
    SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL
),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (
    SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1 AND f >= 10
),
cuts AS (
    SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, cut,
        (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM candidates c JOIN (VALUES (1), (2)) AS places(cut) ON cut < c.k
    JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : cut], ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1 :], ' ')
),
weakest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
),
absorbed AS (
    SELECT DISTINCT c.lang, c.phrase FROM candidates c
    JOIN (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM candidates WHERE k = 3
    ) d ON d.lang = c.lang AND d.part = c.phrase
    WHERE 100 * d.a >= 50 * c.a
)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank,
    w.phrase, w.a, w.l, w.r, t.n, w.score
FROM weakest w JOIN totals t ON t.lang = w.lang
ANTI JOIN absorbed b ON b.lang = w.lang AND b.phrase = w.phrase
QUALIFY rank <= 2000
"""
