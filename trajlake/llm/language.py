"""Language of mixed texts: script ranges, word scores and a Viterbi path with a switching penalty.

A word is a run of letters. Its scripts (by code point ranges) leave the languages that use one of them as
candidates. Per language a chain over bytes, up to four at a time and smoothed by its own shorter
contexts, gives a word's log probability. The best path over a text's words pays ``SWITCH`` for each
change of language; its runs are the spans. The text's language is the one with the most letters.

The model is fitted on a bounded sample: about ``SAMPLE`` documents of each language, the first by a hash of
doc_id and text, all of them where there are fewer. It is a table of hashed counts, which falls from
``SLOT_BITS`` bits where there are so many languages that it would pass ``MODEL_BYTES``. Texts are read whole. Memory grows with
the words of a task's longest text only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.text import table

UNDETERMINED = "und"
SAMPLE = 5000
#: Cost of a change of language, and of a language whose scripts a word has none of, in nats.
SWITCH, FOREIGN = 10.0, 60.0
#: A language uses a script if it has this share of the language's letters.
USED = 0.001
SLOT_BITS = 16
MODEL_BYTES = 1 << 28
#: Weight of the shorter context, in occurrences.
BACK_OFF = 4.0
#: Distinct words whose scores a task keeps, of these those that are hashed at a time, and words on one path table.
CACHED, HASHED, TOGETHER = 400_000, 50_000, 2_000_000

LETTERS = re.compile(r"[^\W\d_]+")
# First and last code point of scripts' letters; whatever is elsewhere is one script, "other".
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("ipa", 0x0250, 0x02AF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("syriac", 0x0700, 0x074F),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x323AF),
]
NAMES = [*dict.fromkeys(name for name, _, _ in SCRIPTS), "other"]
LATIN = 1 << NAMES.index("latin")
#: Edges of the ranges in order, and the script from each one on.
EDGES = np.array([x for _, a, b in SCRIPTS for x in (a, b + 1)])
AFTER = np.array([len(NAMES) - 1, *[x for name, _, _ in SCRIPTS for x in (NAMES.index(name), len(NAMES) - 1)]])


def scripts_of(word: str) -> int:
    """A bit for each script of the word's letters."""
    if word.isascii():
        return LATIN
    at = np.searchsorted(EDGES, np.array([ord(c) for c in word]), side="right")
    return int(np.bitwise_or.reduce(np.left_shift(1, AFTER[at])))


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def n_letters(word: str) -> int:
    """Runs may hold signs such as raised digits, which are no letters."""
    return len(word) if word.isalpha() else sum(c.isalpha() for c in word)


def grams(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the bytes of words and of their contexts, and where each word begins.

    Per byte (each word's end is one) seven slots: the byte itself; the byte after one, two and three others
    and, before each, that context. What would lie before the word's beginning reads as its end mark.
    """
    data = np.frombuffer(b"\n" * 3 + b"\n".join(words) + b"\n", dtype=np.uint8).astype(np.uint64)
    mark = np.uint64(10)
    now, one = data[3:], data[2:-1]
    two = np.where(one == mark, mark, data[1:-2])
    three = np.where(two == mark, mark, data[:-3])
    odd, byte = np.uint64(0x9E3779B97F4A7C15), np.uint64(8)

    def slot(order: int, *parts: np.ndarray) -> np.ndarray:
        key = np.full(len(now), 1, dtype=np.uint64)
        for p in parts:
            key = (key << byte) | p
        return ((key * odd) >> np.uint64(64 - bits)) + np.uint64(order << bits)

    found = [
        slot(0, now), slot(1, one), slot(2, one, now), slot(3, two, one), slot(4, two, one, now),
        slot(5, three, two, one), slot(6, three, two, one, now),
    ]
    ends = np.flatnonzero(now == mark)
    return np.stack(found).astype(np.int64), np.concatenate([[0], ends[:-1] + 1])


ORDERS = 7


@dataclass
class Model:
    """Counts by language and slot, and the scripts each language uses, as bits."""

    langs: list[str]
    counts: np.ndarray
    scripts: list[int]
    bits: int

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        parts = [self.some_scores(words[i : i + HASHED]) for i in range(0, len(words), HASHED)]
        return np.concatenate([np.empty((0, len(self.langs)), dtype=np.float32), *parts])

    def some_scores(self, words: list[str]) -> np.ndarray:
        slots, begins = grams([w.encode("utf-8", "replace") for w in words], self.bits)
        out = np.empty((len(words), len(self.langs)), dtype=np.float32)
        used = np.array([scripts_of(w) for w in words])
        for i, counts in enumerate(self.counts):
            seen = counts[slots]
            p = (seen[0] + 1.0) / (counts[: 1 << self.bits].sum() + 256.0)
            for k in (1, 3, 5):
                p = (seen[k + 1] + BACK_OFF * p) / (np.maximum(seen[k], seen[k + 1]) + BACK_OFF)
            out[:, i] = np.add.reduceat(np.log(p), begins) - FOREIGN * ((used & self.scripts[i]) == 0)
        return out


def count_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n): counts of slots, and below zero those of scripts' letters."""
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            names, n = list(words), np.fromiter(words.values(), dtype=np.int64, count=len(words))
            total = np.zeros(ORDERS << bits)
            for first in range(0, len(names), HASHED):
                slots, begins = grams([w.encode("utf-8", "replace") for w in names[first : first + HASHED]], bits)
                weights = np.repeat(n[first : first + HASHED], np.diff([*begins, slots.shape[1]]))
                for some in slots:
                    total += np.bincount(some, weights=weights, minlength=ORDERS << bits)
            some = np.flatnonzero(total)
            letters: Counter = Counter()
            for word, k in words.items():
                scripts = scripts_of(word)
                for s in range(len(NAMES)):
                    if scripts >> s & 1:
                        letters[-1 - s] += k * n_letters(word)
            slot = [*some.tolist(), *letters]
            count = [*total[some].astype(np.int64).tolist(), *letters.values()]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(slot), pa.string()), "slot": slot, "n": count})
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > CACHED:
                yield from flush()
    yield from flush()


def sampled(docs: DataFrame, sizes: dict[str, int], sample: int) -> DataFrame:
    """About ``sample`` documents of each lang: those whose hash is below the share that gives so many.

    Broadcast is one row per language of the model.
    """
    shares = docs.sparkSession.createDataFrame([(x, sample / n) for x, n in sizes.items()], "lang string, share double")
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return docs.join(F.broadcast(shares), "lang").where(at < F.col("share")).select("lang", "text")


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of documents (doc_id, text, lang); no language if there are none.

    What comes to the driver is the summed table, of at most ``MODEL_BYTES``: one row per language and order.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = dict(known.groupBy("lang").count().collect())
    langs = sorted(sizes)
    room = MODEL_BYTES // (4 * ORDERS * max(1, len(langs)))
    bits = min(SLOT_BITS, max(4, int(math.log2(max(16, room)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count_words(batches, bits)

    found = sampled(known, sizes, sample).mapInArrow(run, "lang string, slot long, n long")
    sums = found.groupBy("lang", "slot").agg(F.sum("n").alias("n"))

    def packed(group: pa.Table) -> pa.Table:
        return pa.table({"lang": group["lang"][:1], "slots": [group["slot"].to_pylist()], "ns": [group["n"].to_pylist()]})

    rows = sums.withColumn("part", F.floor(F.col("slot") / F.lit(1 << bits))).groupBy("lang", "part")
    counts = np.zeros((len(langs), ORDERS << bits), dtype=np.float32)
    letters = np.zeros((len(langs), len(NAMES)))
    for lang, slots, ns in rows.applyInArrow(packed, "lang string, slots array<long>, ns array<long>").collect():
        slots, ns, i = np.array(slots), np.array(ns), langs.index(lang)
        counts[i, slots[slots >= 0]] = ns[slots >= 0]
        letters[i, -1 - slots[slots < 0]] = ns[slots < 0]
    used = letters > USED * letters.sum(axis=1, keepdims=True)
    scripts = [sum(1 << s for s in np.flatnonzero(u).tolist()) for u in used]
    return Model(langs, counts, scripts, bits)


def best_paths(scores: np.ndarray, ids: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best language of each word, for several texts at once; ties go to the lower language.

    ``ids`` are rows of ``scores``. A step takes the next word of every text that has one.
    """
    order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
    lengths = np.array([len(ids[i]) for i in order])
    flat = np.concatenate([ids[i] for i in order])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n = scores.shape[1]
    kind = np.uint8 if n < 256 else np.int32
    came = np.empty(len(flat), dtype=kind)
    moved = np.zeros((len(flat), n), dtype=bool)
    best = scores[flat[begins]].astype(np.float64)
    ends = np.empty(len(order), dtype=np.int64)
    active = len(order)
    for t in range(1, int(lengths[0]) + 1):
        still = int(np.searchsorted(-lengths, -t, side="left"))
        if still < active:
            ends[still:active] = best[still:active].argmax(axis=1)
            best, active = best[:still], still
        if not active:
            break
        at = begins[:active] + t
        top = best.argmax(axis=1)
        from_top = best[np.arange(active), top][:, None] - switch
        change = from_top > best
        came[at], moved[at] = top, change
        best = np.where(change, from_top, best) + scores[flat[at]]
    out = [np.empty(0, dtype=np.int64)] * len(ids)
    for k, i in enumerate(order):
        own = slice(int(begins[k]), int(begins[k] + lengths[k]))
        out[i] = backwards(came[own], moved[own], int(ends[k]))
    return out


def backwards(came: np.ndarray, moved: np.ndarray, state: int) -> np.ndarray:
    """A path from its end, a run at a time: a run reaches back to the last change to its language."""
    path = np.empty(len(came), dtype=np.int64)
    changes: dict[int, np.ndarray] = {}
    last = len(came)
    while last:
        if state not in changes:
            changes[state] = np.flatnonzero(moved[:, state])
        earlier = int(np.searchsorted(changes[state], last))
        begin = int(changes[state][earlier - 1]) if earlier else 0
        path[begin:last] = state
        state, last = int(came[begin]) if begin else state, begin
    return path


def spans(path: np.ndarray, letters: np.ndarray, langs: list[str]) -> list[dict]:
    """Runs of one language: first and last word (from 0) and letters."""
    begins = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
    lasts = np.concatenate([begins[1:], [len(path)]]) - 1
    sums = np.add.reduceat(letters, begins)
    return [
        {"first": int(a), "last": int(b), "lang": langs[path[a]], "letters": int(n)}
        for a, b, n in zip(begins, lasts, sums, strict=True)
    ]


SPANS = "array<struct<first: int, last: int, lang: string, letters: long>>"
SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string()), ("letters", pa.int64())])


class Numbers(dict):
    """Numbers of words, given at first sight; -1 for those without a letter."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[str] = []
        self.letters: list[int] = []

    def __missing__(self, word: str) -> int:
        letters = n_letters(word)
        self[word] = number = len(self.names) if letters else -1
        if letters:
            self.names.append(word)
            self.letters.append(letters)
        return number


def labelled(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``id`` and ``spans`` of ``docs`` (id, text): runs of words in one language; empty without letters or model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        numbers = Numbers()
        scores = model.scores([])

        def solved(texts: list[np.ndarray]) -> list[list[dict]]:
            nonlocal scores
            scores = np.concatenate([scores, model.scores(numbers.names[len(scores) :])])
            full = [x for x in texts if len(x)]
            paths = iter(best_paths(scores, full, switch) if full else [])
            letters = np.array(numbers.letters, dtype=np.int64)
            return [spans(next(paths), letters[x], model.langs) if len(x) else [] for x in texts]

        for batch in batches:
            found: list[list[dict]] = []
            texts: list[np.ndarray] = []
            total = 0
            for text in batch.column("text").to_pylist():
                words = words_of(text) if model.langs else []
                ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words))
                texts.append(ids[ids >= 0])
                total += len(ids)
                if total >= TOGETHER or len(numbers) >= CACHED:
                    found += solved(texts)
                    texts, total = [], 0
                    if len(numbers) >= CACHED:
                        numbers, scores = Numbers(), scores[:0]
            found += solved(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(SPAN))], ["id", "spans"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, spans {SPANS}")


#: Letters by language, most first; ties in the order of names.
LEADING = """
array_min(transform(array_distinct(spans.lang), x -> named_struct(
    'less', aggregate(filter(spans, s -> s.lang = x), 0L, (n, s) -> n - s.letters), 'lang', x)))
"""


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each of ``documents``, and the share of its letters that lie in spans of that language.

    Learns from documents with text, lang and doc_id whose crc32 of the doc_id, modulo 5, is not 0; for a row without
    doc_id ``held_out`` is false. Null texts and those without a letter are ``und`` with score 0; so is everything if
    there is nothing to learn from. Ties go to the lower language by code point. Repeated rows get a row each, very
    long texts are read whole.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")

    def remainder(doc_id: str) -> Column:
        return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5

    model = fitted(docs.where(remainder("doc_id") != 0))
    found = labelled(docs.select(F.col("doc_id").alias("id"), "text"), model).select("id", "spans", F.expr(LEADING).alias("lead"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["letters"])
    return found.select(
        F.col("id").alias("doc_id"),
        F.coalesce(remainder("id") == 0, F.lit(False)).alias("held_out"),
        F.coalesce("lead.lang", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.coalesce(-F.col("lead.less") / total, F.lit(0.0)).alias("score"),
    )
