"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Each place of a test item begins a seed: the shortest n-gram, of three words or more, that is rare
enough, by the shares its words have of the whole corpus, to turn up by chance once in ``BY_CHANCE`` words of the
corpus at most, all seeds taken together. So common words make longer seeds, and chance alignments grow with
the corpus alone, not with corpus times benchmark. Rarity depends on words, not on copies of the n-gram: copies
elsewhere take no seed from an edited copy.

One pass over the texts sums up word shares. A second finds the places that may hold a seed (bit filters
of fixed size) and keeps the words around them. An exact join then tells real hits, and the passages are
aligned with the item word by word; edited copies keep a high score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.text import lean, table, unpacked, with_id, written

#: Words per seed, at least.
GRAM = 3
#: Words of the corpus for each hit of a seed that chance may make.
BY_CHANCE = 1 << 13
#: Words are counted by hash in so many slots: the size of the counts whatever the vocabulary.
SLOTS = 1 << 18
#: Words that the corpus is taken to hold besides its own, so that words of a small corpus are not all common.
BESIDES = 1 << 14
#: Bits of the filter: its size whatever the benchmark's. A full filter only makes more work.
FILTER_BITS = 1 << 24
#: Words kept on either side of a hit, besides the longest item's length.
MARGIN = 8
#: Hits whose offsets to the item differ by less than this are aligned together.
OFFSET = 32
MATCH, MISMATCH, GAP = 1.0, -1.0, -1.0
#: Alignment score by the item's words from which a passage counts as a copy.
LEAST_SCORE = 0.4
#: Characters of texts whose words are hashed together (a longer text alone), and bytes of a word hashed so at most.
TOGETHER, SHORT = 1 << 20, 48
#: Words, padding included, that are aligned at a time.
CELLS = 1 << 19

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normal_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        data = word.encode("utf-8", "replace")
        value = zlib.crc32(data) << 32 | zlib.crc32(data[::-1], 7)
        if len(self) < 300_000:
            self[word] = value
        return value


def hashes(words: list[str], known: WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


@cache
def _in_words() -> np.ndarray:
    """For each code point, whether ``\\w`` matches it."""
    return np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@cache
def _crc_steps() -> np.ndarray:
    """The table of ``zlib.crc32``, a byte at a time."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1)
    return out


def _crcs(data: np.ndarray, at: np.ndarray, step: int, sizes: list[int], seed: int) -> np.ndarray:
    """``zlib.crc32`` from ``seed`` of stretches of ``data`` from ``at`` on, longest first: ``sizes[k]`` have more than k bytes."""
    steps = _crc_steps()
    out = np.full(len(at), seed ^ 0xFFFFFFFF, np.uint32)
    for k, n in enumerate(sizes):
        some = out[:n]
        out[:n] = steps[(some ^ data[at[:n] + step * k]) & 0xFF] ^ some >> 8
    return out ^ np.uint32(0xFFFFFFFF)


def span_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The values of ``WordHash`` for the words in UTF-8 at ``start`` .. ``end`` of ``data``, all words a byte at a time."""
    size = end - start
    order = np.argsort(-np.minimum(size, SHORT + 1).astype(np.int8), kind="stable")
    long_ = int(np.searchsorted(-size[order], -SHORT, "left"))
    out = np.zeros(len(start), np.uint64)
    for i in order[:long_]:
        word = data[start[i] : end[i]]
        out[i] = zlib.crc32(word) << 32 | zlib.crc32(word[::-1], 7)
    order = order[long_:]
    falling = -size[order]
    sizes = [int(np.searchsorted(falling, -k, "left")) for k in range(-int(falling[0]) if len(order) else 0)]
    letters = np.frombuffer(data, np.uint8)
    high = _crcs(letters, start[order], 1, sizes, 0).astype(np.uint64)
    out[order] = high << np.uint64(32) | _crcs(letters, end[order] - 1, -1, sizes, 7)
    return out


class Words:
    """The words of ``normal_words`` of some texts, hashed together."""

    def __init__(self, texts: list[str | None]) -> None:
        low = [t.lower() if t else "" for t in texts]
        self.text = "\n".join(low) + "\n"
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        turns = np.flatnonzero(np.diff(_in_words()[points], prepend=False))
        #: Where in ``text`` each word begins and ends.
        self.start, self.end = turns[::2], turns[1::2]
        data = self.text.encode()
        start, end = self.start, self.end
        if len(data) > len(points):
            width = (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000) + 1
            place = np.cumsum(width) - width
            start, end = place[start], place[end]
        self.hashes = span_hashes(data, start, end)
        #: The number of the first word of each text, and of all words.
        after = np.cumsum([len(t) + 1 for t in low])
        self.first = np.concatenate([[0], np.searchsorted(self.start, after)])

    def between(self, low: int, high: int) -> list[str]:
        return _WORD.findall(self.text[self.start[low] : self.end[high - 1]])


def hashed(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """The words of an Arrow column's texts, some texts at a time, with the place of the first of these."""
    first, texts, size = 0, [], 0
    for i, text in enumerate(column):
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size > TOGETHER:
            yield first, Words(texts)
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, Words(texts)


def longer(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hashes of n-grams that go on with a word each."""
    with np.errstate(over="ignore"):
        out = (grams ^ words) * _ODD
    return out ^ (out >> np.uint64(29))


def grams(each: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each n-gram of hashed words."""
    out = np.zeros(max(0, len(each) - n + 1), np.uint64)
    for k in range(n if len(out) else 0):
        out = longer(out, each[k : len(each) - n + 1 + k])
    return out


def _slots(each: np.ndarray) -> np.ndarray:
    return ((each * _ODD) >> np.uint64(46)).astype(np.int64)


@lean
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, words in hashed(batch.column(0)):
            total += np.bincount(_slots(words.hashes), minlength=SLOTS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])


def word_bits(docs: DataFrame) -> np.ndarray:
    """How rare a word of each slot is in all of ``docs``: minus the binary logarithm of its share."""
    counts = docs.select("text").mapInArrow(_word_counts, "slot long, n long")
    found = counts.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(SLOTS)
    total[found["slot"].to_numpy(np.int64)] = found["n"]
    return np.log2((total.sum() + BESIDES) / (total + 1)).astype(np.float32)


def seeds(each: np.ndarray, bits: np.ndarray, least: float) -> tuple[list[int], list[int], list[bool]]:
    """Of an item's hashed words: the place and hash of each seed and of its beginnings, and whether it is whole.

    A seed reaches ``least`` bits, or half of the item's if that is less, and ``GRAM`` words. Places too near the
    end for that begin none, but the first does always.
    """
    out: tuple[list[int], list[int], list[bool]] = ([], [], [])
    sums = np.concatenate([[0.0], np.cumsum(bits, dtype=np.float64)])
    ends = np.searchsorted(sums, sums[:-1] + min(least, sums[-1] / 2) - 1e-6)
    start = grams(each).view(np.int64)
    for at in range(len(start)):
        end = max(int(ends[at]), at + GRAM)
        if end > len(each):
            break
        gram = start[at : at + 1].view(np.uint64)
        for n in range(at + GRAM, end + 1):
            out[0].append(at)
            out[1].append(int(gram.view(np.int64)[0]))
            out[2].append(n == end)
            if n < end:
                gram = longer(gram, each[n : n + 1])
    return out


def item_seeds(items: DataFrame, bits: np.ndarray) -> DataFrame:
    """``item_id``, its number of words, and its seeds and their beginnings: ``gram`` at ``at``, ``whole`` or not.

    An item of fewer than ``GRAM`` words has none.
    """
    words = F.pandas_udf(lambda texts: texts.map(lambda t: len(normal_words(t))), "long")
    total = items.agg(F.sum(words("text"))).first()[0] or 0
    least = float(np.log2(BY_CHANCE) + np.log2(max(1, total)))
    # One number per slot.
    shared = items.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("words int, places array<int>, grams array<long>, whole array<boolean>")
    def split(texts: pd.Series) -> pd.DataFrame:
        known, rare = WordHash(), shared.value
        out = []
        for t in texts:
            each = hashes(normal_words(t), known)
            out.append((len(each), *seeds(each, rare[_slots(each)], least)))
        return pd.DataFrame(out, columns=["words", "places", "grams", "whole"])

    out = items.select("item_id", split("text").alias("s"))
    out = out.select("item_id", F.col("s.words").alias("words"), F.explode(F.arrays_zip("s.places", "s.grams", "s.whole")).alias("g"))
    return out.select("item_id", "words", F.col("g.places").alias("at"), F.col("g.grams").alias("gram"), F.col("g.whole").alias("whole"))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = np.unique(batch.column(0).to_numpy() & (FILTER_BITS - 1))
        word, bit = slots >> 6, np.uint64(1) << (slots & 63).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else []
        sums = np.add.reduceat(bit, first) if len(word) else bit
        yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(sums.view(np.int64))], ["word", "bits"])


def gram_filter(rows: DataFrame) -> np.ndarray:
    """The bit filter of all n-grams in ``gram``; at most ``FILTER_BITS / 64`` rows reach the driver."""
    parts = rows.select("gram").mapInArrow(_bits, "word long, bits long")
    found = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def inside(filter_: np.ndarray, found: np.ndarray) -> np.ndarray:
    slots = found & np.uint64(FILTER_BITS - 1)
    return (filter_[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def seed_hits(each: np.ndarray, whole: np.ndarray, begun: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in hashed words that may begin a seed, and the seeds' hashes; grows what may be the beginning of one.

    ``first`` has the number of the first word of each text, and of all words; no seed reaches into the next text.
    """
    first = np.array([0, len(each)]) if first is None else first
    found = grams(each)
    place = np.flatnonzero(inside(whole | begun, found))
    end = first[np.searchsorted(first, place, "right")]
    ends = place + GRAM <= end
    place, end = place[ends], end[ends]
    found, n = found[place], GRAM
    places, hits = [], []
    while len(place):
        done = inside(whole, found)
        places.append(place[done])
        hits.append(found[done])
        goes_on = inside(begun, found) & (place + n < end)
        place, found, end = place[goes_on], found[goes_on], end[goes_on]
        found = longer(found, each[place + n])
        n += 1
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, found = np.concatenate(places), np.concatenate(hits).view(np.int64)
    order = np.argsort(place, kind="stable")
    return place[order], found[order]


def passages(docs: DataFrame, whole: np.ndarray, begun: np.ndarray, reach: int) -> DataFrame:
    """The stretches of words around possible hits in ``docs`` (key, text): key, passage (words joined by blanks), hits.

    Stretches that overlap are one, so no word is kept twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast((whole, begun))

    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for at, words in hashed(batch.column(1)):
                hit, found = seed_hits(words.hashes, *shared.value, words.first)
                text = np.searchsorted(words.first, hit, "right") - 1
                apart = (np.diff(hit) > 2 * reach) | (np.diff(text) > 0)
                cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(hit)] if len(hit) else []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    t = int(text[a])
                    low, high = max(int(words.first[t]), int(hit[a]) - reach), min(int(words.first[t + 1]), int(hit[b - 1]) + reach)
                    key = batch.column(0)[at + t].as_py()
                    out.append((key, " ".join(words.between(low, high)), (hit[a:b] - low).tolist(), found[a:b].tolist()))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            types = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "passage", "places", "grams"])

    return docs.select("key", "text").mapInArrow(find, "key long, passage string, places array<int>, grams array<long>")


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each pair of word-number arrays: score, and where it ends in the text.

    All pairs go through the same row operations; a gap along the text is a running maximum.
    """
    n, m = max(map(len, items)), max(map(len, texts))
    a, b = np.full((len(items), n), -1), np.full((len(items), m), -2)
    for i, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    fall = GAP * np.arange(m + 1, dtype=np.float32)
    row = np.zeros((len(items), m + 1), np.float32)
    best, end = np.zeros(len(items), np.float32), np.zeros(len(items), np.int64)
    lanes = np.arange(len(items))
    for k in range(n):
        step = np.where(b == a[:, k : k + 1], np.float32(MATCH), np.float32(MISMATCH))
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + step, row[:, 1:] + np.float32(GAP))
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new - fall, axis=1) + fall
        place = row.argmax(axis=1)
        top = row[lanes, place]
        better = top > best
        best[better], end[better] = top[better], place[better]
    return best, end


def _flush(rows: list[tuple]) -> pa.RecordBatch:
    docs, names, items, texts = zip(*rows, strict=True)
    score, _ = align(list(items), list(texts))
    share = score / np.array([max(1, len(x)) for x in items])
    arrays = [pa.array(docs, pa.int64()), pa.array(names, pa.int64()), pa.array(share.astype(np.float64))]
    return pa.RecordBatch.from_arrays(arrays, ["key", "item_id", "score"])


@lean
def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    longest = 0
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            key, name, passage, low, high, item = (x.as_py() for x in row)
            words = normal_words(item)
            numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
            text = np.array([numbers.get(w, -3) for w in passage.split(" ")[max(0, low) : high]])
            widest = max(longest, len(words), len(text))
            if rows and widest * (len(rows) + 1) > CELLS:
                yield _flush(rows)
                rows, widest = [], max(len(words), len(text))
            longest = widest
            rows.append((key, name, np.array([numbers[w] for w in words]), text))
    if rows:
        yield _flush(rows)


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """What is to be aligned: ``key``, item_id, item_text, passage, and the words ``low`` .. ``high`` of it.

    ``docs`` has key and text. One row per passage, item and band of offsets, however many seeds they share.
    """
    item = written(item_seeds(items, word_bits(docs)), "seeds")
    longest = item.agg(F.max("words")).first()[0] or 0
    whole, begun = gram_filter(item.where("whole")), gram_filter(item.where("not whole"))
    found = passages(docs, whole, begun, longest + MARGIN)
    found = written(found.withColumn("stretch", F.monotonically_increasing_id()), "passages")
    hits = found.select("stretch", F.explode(F.arrays_zip("places", "grams")).alias("h"))
    hits = hits.select("stretch", F.col("h.places").alias("place"), F.col("h.grams").alias("gram"))
    near = hits.join(item.where("whole").drop("whole"), "gram").withColumn("offset", F.col("place") - F.col("at"))
    bands = near.groupBy("stretch", "item_id", "words", F.floor(F.col("offset") / OFFSET).alias("band")).agg(
        F.min("offset").alias("low"), F.max("offset").alias("high")
    )
    low, high = F.col("low") - MARGIN, F.col("high") + F.col("words") + MARGIN
    pairs = bands.select("stretch", "item_id", low.cast("long").alias("low"), high.cast("long").alias("high"))
    texts = items.select("item_id", F.col("text").alias("item_text"))
    ready = pairs.join(found.select("stretch", "key", "passage"), "stretch").join(texts, "item_id")
    return ready.select("key", "item_id", "passage", "low", "high", "item_text")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", least_score: float = LEAST_SCORE) -> DataFrame:
    """Pairs (``key``, item_id) with the alignment ``score``, at least ``least_score``.

    ``docs`` needs ``key`` (a long) and text, ``items`` item_id and text. Rows with the same key, or
    without one, count as one document; rows of one item_id as one item. Null and empty texts, items without
    item_id and items of fewer than ``GRAM`` words match nothing. Texts of any length are read whole.
    """
    pairs = candidates(docs.select(F.col(key).alias("key"), "text"), items)
    scores = pairs.mapInArrow(_aligned, "key long, item_id long, score double")
    best = scores.where(F.col("score") >= least_score).groupBy("key", "item_id").agg(F.max("score").alias("score"))
    return best.withColumnRenamed("key", key)


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a copy of an item. Copies are found, and dropped, by text."""
    rows = with_id(docs).withColumn("mark", F.xxhash64("row.text"))
    found = contaminated(rows.select("mark", F.col("row.text").alias("text")), items, "mark").select("mark").distinct()
    return unpacked(rows.join(found, "mark", "left_anti"), docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item: doc_id, item_id, score (1 is an exact copy).

    Rows without doc_id appear as one null doc_id. Empty tables give no rows.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
