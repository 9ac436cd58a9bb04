"""Scoring with a Brown class-based bigram model.

Exchange clustering puts the most frequent words into classes: in each round every word looks for the
class that would raise the likelihood of the class bigrams most, all words at once, and those that gain
most move. Every other word that occurs ``LEAST`` times joins the class that raises the likelihood most next to
these, however many such words there are: their neighbours' classes are counted, and their classes found,
as tables. Rarer words, which stand for those never seen, fall into classes by their ending. A text's
probability is the product of smoothed class transitions and word emissions, its end included.

Word counts cover all training text. The most frequent words, so many and so long at most, go to all
tasks; the others meet their counts and classes in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.text import byte_words, kth_largest, lean, table, texts_of, written

#: Words that are clustered in rounds, and the classes.
CLUSTERED, CLASSES = 4000, 64
#: Other words that occur so often at least join the class they gain most by.
LEAST = 3
#: Classes of the other words.
ENDINGS = 16
#: Words, of so many bytes at most, whose counts every task holds.
HELD, HELD_BYTES = 200_000, 64
#: Rounds, and the words that a class takes or gives up in one at most.
ROUNDS, AT_ONCE = 10, 16
#: Weight of the unigram class distribution in a transition.
SMOOTHING = 10.0
#: Bits of the filter of words that occur ``LEAST`` times: its size whatever the vocabulary. False hits only make work.
FILTER_BITS = 1 << 25
#: Words, and counts next to them, that are placed together.
PLACED, PLACED_COUNTS = 2048, 1 << 14
#: Bytes of texts whose words are told apart together (a longer text alone), and bytes of a word taken so at most.
TOGETHER, SHORT = 1 << 22, 48
#: Distinct words, and distinct pairs, that a task gathers before it hands them on.
GATHERED, GATHERED_PAIRS = 300_000, 3_000_000

#: Class numbers: clustered ones, the end of a text, endings.
END = CLASSES
ALL = CLASSES + 1 + ENDINGS
#: Word numbers in pairs: 0 is the end, then clustered words, then one for each ending.
NUMBERS = 1 + CLUSTERED + ENDINGS
#: What is counted next to a word: classes after it, classes before it, repetitions.
KINDS = 2 * ALL + 1
#: In a line: a word whose class a join will tell.
OPEN = 255


def words(data: bytes | None) -> list[bytes]:
    """Words in lower case; only A-Z has another case for ``bytes.lower``."""
    return byte_words(data.lower()) if data else []


def held_out(doc_id: Column) -> Column:
    """A row without doc_id is not held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(7)) == 2


_IN_WORD = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8), invert=True)
_BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_marks(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each word at ``start`` .. ``end`` of ``data``; all words go a byte at a time, longer ones alone."""
    size = end - start
    order = np.argsort(-np.minimum(size, SHORT + 1).astype(np.int8), kind="stable")
    falling = -size[order]
    long_ = int(np.searchsorted(falling, -SHORT, "left"))
    out = np.zeros(len(start), np.uint64)
    for i in order[:long_]:
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    order, falling = order[long_:], falling[long_:]
    letters, at = np.frombuffer(data, np.uint8), start[order]
    marks = np.zeros(len(order), np.uint64)
    for k in range(-int(falling[0]) if len(order) else 0):
        n = int(np.searchsorted(falling, -k, "left"))
        marks[:n] += _BYTES[letters[at[:n]]]
        marks[:n] *= _ODD
        at[:n] += 1
    out[order] = marks
    return out


class Tokens:
    """The words of some texts: the distinct ones, and which of these each word is, told apart by 64 bits."""

    def __init__(self, texts: list[bytes | None]) -> None:
        data = b"\n".join([*(x or b"" for x in texts), b""]).lower()
        turns = np.flatnonzero(np.diff(_IN_WORD[np.frombuffer(data, np.uint8)], prepend=False))
        start, end = turns[::2], turns[1::2]
        self.place, found = pd.factorize(word_marks(data, start, end))
        one = np.empty(len(found), np.int64)
        one[self.place] = np.arange(len(start))
        self.words = [data[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        #: The number of the first word of each text, and of all words.
        self.first = np.concatenate([[0], np.searchsorted(start, np.cumsum([len(x or b"") + 1 for x in texts]))])

    def line(self, numbers: dict[bytes, int]) -> np.ndarray:
        """The words' numbers, with 0 before and after each text."""
        each = np.fromiter(map(numbers.__getitem__, self.words), np.int64, len(self.words))
        texts = len(self.first) - 1
        out = np.zeros(len(self.place) + texts + 1, np.int64)
        out[np.arange(1, len(self.place) + 1) + np.repeat(np.arange(texts), np.diff(self.first))] = each[self.place]
        return out


def grouped(column: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """The words of an Arrow column's texts, some texts at a time, with the place of the first of these."""
    first, texts, size = 0, [], 0
    for i, text in enumerate(texts_of(column)):
        texts.append(text)
        size += len(text or b"")
        if size > TOGETHER:
            yield first, Tokens(texts)
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, Tokens(texts)


@lean
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}

    def out() -> pa.RecordBatch:
        found = pa.array(counts.keys(), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([found, pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for _, some in grouped(batch.column(0)):
            for word, n in zip(some.words, np.bincount(some.place, minlength=len(some.words)).tolist(), strict=True):
                counts[word] = counts.get(word, 0) + n
            if len(counts) > GATHERED:
                yield out()
                counts.clear()
    yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` and ``n`` over all rows of ``texts`` (one column)."""
    return texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Numbers(dict):
    """Word -> its number among the held ones (1, 2, ..), or minus its ending's number (-1, -2, ..)."""

    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word[-1:]) % ENDINGS


class Others(Numbers):
    """Word -> its number among the first ones, the number of its ending, or ``NUMBERS`` and more: its place in ``found``.

    Endings are for words that the filter ``often`` leaves out; ``found`` grows.
    """

    def __init__(self, first, often: np.ndarray) -> None:
        super().__init__(first)
        self.first, self.often, self.found = dict(self), often.astype("<i8").tobytes(), []

    def __missing__(self, word: bytes) -> int:
        slot = zlib.crc32(word) & (FILTER_BITS - 1)
        if not self.often[slot >> 3] >> (slot & 7) & 1:
            return CLUSTERED + 1 + zlib.crc32(word[-1:]) % ENDINGS
        self[word] = value = NUMBERS + len(self.found)
        self.found.append(word)
        return value

    def forget(self) -> None:
        self.clear()
        self.update(self.first)
        self.found = []


class Unheld(dict):
    """Word -> its number among the held ones (1, 2, ..), or -1."""

    def __missing__(self, word: bytes) -> int:
        return -1


def ending(word: Column) -> Column:
    """The class number of a word's last byte among the endings."""
    return F.pmod(F.crc32(F.substring(word.cast("binary"), -1, 1)), F.lit(ENDINGS)).cast("int")


def pair_counts(texts: DataFrame, held: list[str]) -> DataFrame:
    """How often a word number follows another: ``a``, ``b``, ``n``; texts begin and end at number 0."""
    shared = texts.sparkSession.sparkContext.broadcast(held[:CLUSTERED])

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers((w.encode(), i + 1) for i, w in enumerate(shared.value))
        codes, sums, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def out() -> pa.RecordBatch:
            a, b = np.divmod(codes, NUMBERS)
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums)], ["a", "b", "n"])

        def merge() -> None:
            nonlocal codes, sums, waiting, size
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            both, place = np.unique(np.concatenate([codes, new]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([sums, n])).astype(np.int64)
            codes, sums, waiting, size = both, total, [], 0

        for batch in batches:
            for _, some in grouped(batch.column(0)):
                line = some.line(numbers)
                line[line < 0] = CLUSTERED - line[line < 0]
                waiting.append(line[:-1] * NUMBERS + line[1:])
                size += len(line)
                if size > 2_000_000:
                    merge()
                    if len(codes) > GATHERED_PAIRS:
                        yield out()
                        codes, sums = codes[:0], sums[:0]
        if waiting:
            merge()
        yield out()

    return texts.mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _class_pairs(pairs: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Class bigram counts, a matrix of fixed size."""
    names = pairs.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALL * ALL, np.int64)
        for batch in batches:
            a, b, n = (c.to_numpy() for c in batch.columns)
            np.add.at(total, names.value[a] * ALL + names.value[b], n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    return _grid(pairs.mapInArrow(count, "cell long, n long"))


def _grid(cells: DataFrame) -> np.ndarray:
    sums = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(ALL * ALL)
    out[sums["cell"].to_numpy(np.int64)] = sums["n"]
    return out.reshape(ALL, ALL)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_class(own: int, after: np.ndarray, before: np.ndarray, twice: float, grid: np.ndarray) -> tuple[int, float]:
    """The class a word gains most by moving to, and the gain in log likelihood.

    ``after`` and ``before`` count the classes next to the word, ``twice`` its repetitions.
    """
    s, p = after.copy(), before.copy()
    s[own] -= twice
    p[own] -= twice
    g = grid.copy()
    g[own, :] -= s
    g[:, own] -= p
    g[own, own] -= twice
    # Wherever the word goes, its neighbours' classes have it next to them.
    row, col = g.sum(axis=1) + p, g.sum(axis=0) + s
    base, diag = _xlogx(g), np.arange(ALL)
    out, into = _xlogx(g + s[None, :]) - base, _xlogx(g + p[:, None]) - base
    gain = out.sum(axis=1) - out[diag, diag] + into.sum(axis=0) - into[diag, diag]
    gain += _xlogx(g[diag, diag] + s + p + twice) - base[diag, diag]
    gain -= _xlogx(row + s.sum() + twice) - _xlogx(row) + _xlogx(col + p.sum() + twice) - _xlogx(col)
    best = int(np.argmax(gain[:CLASSES]))
    return best, float(gain[best] - gain[own])


def settled(classes: np.ndarray, mass: np.ndarray, moves: pd.DataFrame) -> np.ndarray:
    """The classes after a round. The moves that gain most go first.

    Gains hold for one move at a time, so a class takes and gives up so many words at most, and takes
    no more than half of its own tokens anew.
    """
    out, taken, given, added = classes.copy(), np.zeros(ALL, int), np.zeros(ALL, int), np.zeros(ALL)
    for m in moves[moves["gain"] > 1e-6].sort_values(["gain", "word"], ascending=[False, True]).itertuples():
        to, own = int(m.to), int(classes[m.word])
        if taken[to] < AT_ONCE and given[own] < AT_ONCE and (not added[to] or added[to] + m.mass <= mass[to] / 2):
            taken[to] += 1
            given[own] += 1
            added[to] += m.mass
            out[m.word] = to
    return out


def exchange(pairs: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all word numbers after so many rounds, and the class bigram counts."""
    sc = pairs.sparkSession.sparkContext
    classes = np.concatenate([[END], np.arange(CLUSTERED) % CLASSES, CLASSES + 1 + np.arange(ENDINGS)])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value[0]
        # One row of counts for each word: classes after it, classes before it, repetitions.
        total = np.zeros((NUMBERS, 2 * ALL + 1), np.int64)
        for batch in batches:
            a, b, n = (c.to_numpy() for c in batch.columns)
            np.add.at(total, (a, names[b]), n)
            np.add.at(total, (b, ALL + names[a]), n)
            same = a == b
            np.add.at(total, (a[same], 2 * ALL), n[same])
        word, kind = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(kind), pa.array(total[word, kind])], ["word", "kind", "n"])

    def move(rows: pd.DataFrame) -> pd.DataFrame:
        names, grid = shared.value
        out = []
        for word, part in rows.groupby("word"):
            counts = np.zeros(2 * ALL + 1)
            counts[part["kind"]] = part["n"]
            to, gain = best_class(int(names[word]), counts[:ALL], counts[ALL : 2 * ALL], counts[-1], grid)
            out.append((int(word), to, gain, counts[:ALL].sum()))
        return pd.DataFrame(out, columns=["word", "to", "gain", "mass"])

    grid = _class_pairs(pairs, classes)
    for _ in range(rounds):
        shared = sc.broadcast((classes, grid))
        rows = pairs.mapInArrow(neighbours, "word long, kind long, n long").where(f"word between 1 and {CLUSTERED}")
        sums = rows.groupBy("word", "kind").agg(F.sum("n").alias("n")).withColumn("task", F.col("word") % 64)
        # One row per clustered word comes back.
        moves = sums.groupBy("task").applyInPandas(move, "word long, to long, gain double, mass double").toPandas()
        classes = settled(classes, grid.sum(axis=1), moves)
        grid = _class_pairs(pairs, classes)
    return classes, grid


def frequent(counts: DataFrame) -> np.ndarray:
    """The bit filter of the words that occur ``LEAST`` times; at most ``FILTER_BITS / 64`` rows reach the driver."""
    slot = F.crc32(F.col("word").cast("binary")).bitwiseAND(F.lit(FILTER_BITS - 1))
    slots = counts.where(F.col("n") >= LEAST).select(slot.alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    found = slots.groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[found["at"].to_numpy(np.int64)] = found["bits"]
    return out


def contexts(texts: DataFrame, held: list[str], classes: np.ndarray, often: np.ndarray) -> DataFrame:
    """For each ``word`` of the filter ``often``, the first ones aside: how often (``ns``) each class is next to it (``kinds``).

    Kinds are classes after it, classes before it, repetitions. A word has one row for each task that
    gathers it. ``classes`` are those of ``exchange``.
    """
    shared = texts.sparkSession.sparkContext.broadcast((held[:CLUSTERED], classes, often))

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, names, often = shared.value
        others = Others(((w.encode(), i + 1) for i, w in enumerate(first)), often)
        codes, sums, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merge() -> None:
            nonlocal codes, sums, waiting, size
            line = np.concatenate(waiting)
            kind = np.concatenate([names, np.array([CLASSES - Numbers()[w] for w in others.found], np.int64)])[line]
            at = np.flatnonzero(line >= NUMBERS)
            own = (line[at] - NUMBERS) * KINDS
            new = [own + kind[at + 1], own + ALL + kind[at - 1], own[line[at] == line[at + 1]] + 2 * ALL]
            new, n = np.unique(np.concatenate(new), return_counts=True)
            both, place = np.unique(np.concatenate([codes, new]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([sums, n]), minlength=len(both)).astype(np.int64)
            codes, sums, waiting, size = both, total, [], 0

        def out() -> pa.RecordBatch:
            word, kind = np.divmod(codes, KINDS)
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            cuts = pa.array(np.append(begin, len(word)).astype(np.int32))
            found = pa.array([others.found[i] for i in word[begin]], pa.binary()).cast(pa.string())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(t))) for x, t in ((kind, np.int16), (sums, np.int64))]
            return pa.RecordBatch.from_arrays([found, *lists], ["word", "kinds", "ns"])

        for batch in batches:
            for _, some in grouped(batch.column(0)):
                line = some.line(others)
                waiting.append(line)
                size += len(line)
                if size > 2_000_000 or len(others.found) > GATHERED:
                    merge()
                    if len(codes) > GATHERED_PAIRS or len(others.found) > GATHERED:
                        yield out()
                        codes, sums = codes[:0], sums[:0]
                        others.forget()
        if waiting:
            merge()
        yield out()

    return texts.mapInArrow(count, "word string, kinds array<short>, ns array<long>")


def _gains(sides: np.ndarray, others: np.ndarray, own: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """What each class gains by the classes on one side of words: a row for each word of ``sides``.

    ``grid`` counts the clustered classes (rows) with all on that side; ``others`` counts the other side.
    """
    out = np.zeros((len(sides), CLASSES))
    base = _xlogx(grid)
    word, kind = np.nonzero(sides)
    for low in range(0, len(word), PLACED_COUNTS):
        w, k = word[low : low + PLACED_COUNTS], kind[low : low + PLACED_COUNTS]
        before, was = grid.T[k], base.T[k]
        same = np.flatnonzero(k == own[w])
        before[same] -= others[w[same], :CLASSES]
        was[same] = _xlogx(before[same])
        before += sides[w, k][:, None]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        out[w[first]] += np.add.reduceat(_xlogx(before) - was, first, axis=0)
    return out


def placed_classes(own: np.ndarray, after: np.ndarray, before: np.ndarray, twice: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The classes of ``best_class`` for words whose own class is an ending, a row each; work goes by the classes next to them."""
    s, p, each = after.astype(float), before.astype(float), np.arange(len(own))
    s[each, own] -= twice
    p[each, own] -= twice
    gain = _gains(s, p, own, grid[:CLASSES]) + _gains(p, s, own, grid[:, :CLASSES].T)
    d, s0, p0, t = np.diag(grid)[:CLASSES], s[:, :CLASSES], p[:, :CLASSES], np.asarray(twice, float)[:, None]
    gain += _xlogx(d + s0 + p0 + t) + _xlogx(d) - _xlogx(d + s0) - _xlogx(d + p0)
    r, c = grid.sum(axis=1)[:CLASSES], grid.sum(axis=0)[:CLASSES]
    s1, p1 = s.sum(axis=1, keepdims=True) + t, p.sum(axis=1, keepdims=True) + t
    gain -= _xlogx(r + s1) - _xlogx(r) + _xlogx(c + p1) - _xlogx(c)
    return gain.argmax(axis=1)


def placed(found: DataFrame, grid: np.ndarray) -> DataFrame:
    """``word`` and ``kind``: the class that each word of ``contexts`` gains most by, if it occurs ``LEAST`` times."""
    shared = found.sparkSession.sparkContext.broadcast(grid)

    def named(words_: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        enough = np.flatnonzero(counts[:, :ALL].sum(axis=1) >= LEAST)
        counts, words_ = counts[enough], words_.take(pa.array(enough))
        own = np.array([CLASSES - Numbers()[w] for w in texts_of(words_)], np.int64)
        kinds = placed_classes(own, counts[:, :ALL], counts[:, ALL : 2 * ALL], counts[:, -1], shared.value)
        return pa.RecordBatch.from_arrays([words_, pa.array(kinds, pa.int32())], ["word", "kind"])

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last word so far, whose rows may go on.
        last, kept = None, None
        for batch in batches:
            for low in range(0, len(batch), PLACED):
                part = batch.slice(low, PLACED)
                names, sizes = part["word"], part["kinds"].value_lengths().to_numpy()
                new = np.append(True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False))
                row = np.cumsum(new) - 1
                code = np.repeat(row * KINDS, sizes) + part["kinds"].flatten().to_numpy()
                counts = np.bincount(code, part["ns"].flatten().to_numpy(), minlength=(row[-1] + 1) * KINDS).reshape(-1, KINDS)
                names = names.take(pa.array(np.flatnonzero(new)))
                if last is not None and last == names[0]:
                    counts[0] += kept
                elif last is not None:
                    names, counts = pa.concat_arrays([pa.array([last.as_py()], names.type), names]), np.vstack([kept, counts])
                last, kept = names[-1], counts[-1].copy()
                yield named(names[:-1], counts[:-1])
        if last is not None:
            yield named(pa.array([last.as_py()], pa.string()), kept[None])

    # A word's rows follow each other, so that they are added up one by one, however many there are.
    return found.repartition("word").sortWithinPartitions("word").mapInArrow(place, "word string, kind int")


@dataclass
class Model:
    held: list[str]
    counts: np.ndarray
    #: Classes of the end and of the held words.
    classes: np.ndarray
    #: log10 of a class after a class.
    steps: np.ndarray
    #: Tokens of each class, and for endings the number of words plus one besides.
    mass: np.ndarray
    tokens: int
    distinct: int


def class_lines(docs: DataFrame, named: DataFrame, held: list[str], n: np.ndarray, classes: np.ndarray, facts: tuple[int, int, int]) -> DataFrame:
    """Every document's words as classes (``line``, a byte each, the end first and last), and what its words' counts tell.

    ``emit`` is log10 of the emissions without their classes' mass. ``named`` holds the classes of all words;
    those of the held ones go to all tasks, the others meet theirs in a join. ``facts``: training texts,
    tokens, distinct words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((held, n, classes, facts))

    @lean
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, classes, (n_ends, tokens, distinct) = shared.value
        numbers = Unheld((w.encode(), i + 1) for i, w in enumerate(held))
        # By number, the words not held at the back.
        kind = np.append(classes, OPEN).astype(np.uint8)
        known = np.concatenate([[np.log10(n_ends + 1)], np.log10(n + 1), [0.0]])
        emit = np.concatenate([[0.0], np.log10(n + (classes[1:] > END)), [0.0]])
        floor = np.log10(tokens + distinct + 1)
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = list(zip(*out, strict=True)) or [[]] * 9
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            made[6] = made[6].cast(pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays(made, ["doc_id", "n_tokens", "n_held", "base", "emit", "line", "rare", "times", "spots"])

        for batch in batches:
            for at, some in grouped(batch.column(1)):
                lines, first = some.line(numbers), some.first.tolist()
                for i, (a, b) in enumerate(zip(first, first[1:], strict=False)):
                    line = lines[a + i : b + i + 2]
                    left = [some.words[j] for j in some.place[a:b][line[1:-1] < 0].tolist()]
                    rare = Counter(left)
                    place = {w: k for k, w in enumerate(rare)}
                    here = int((line[1:] > 0).sum()) + (n_ends > 0)
                    base = known[line[1:]].sum() - (b - a + 1) * floor
                    spots = [place[w] for w in left]
                    key = batch.column(0)[at + i].as_py()
                    out.append((key, b - a + 1, here, base, emit[line[1:]].sum(), kind[line].tobytes(), list(rare), list(rare.values()), spots))
                    if len(out) >= 500:
                        yield flush()
                        out.clear()
        yield flush()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for line, rare, spots, at, kinds in zip(*(batch[c] for c in ("line", "rare", "spots", "at", "kinds")), strict=True):
                codes = np.frombuffer(line.as_py(), np.uint8)
                if len(rare):
                    codes = codes.copy()
                    of = np.array([CLASSES - Numbers()[w.encode()] for w in rare.as_py()], np.uint8)
                    if at.is_valid:
                        of[at.values.to_numpy()] = kinds.values.to_numpy()
                    codes[codes == OPEN] = of[spots.values.to_numpy()]
                lines.append(codes.tobytes())
            kept = [batch[c] for c in ("doc_id", "n_tokens", "n_known", "base", "emit")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lines, pa.binary())], ["doc_id", "n_tokens", "n_known", "base", "emit", "line"])

    schema = "doc_id long, n_tokens long, n_held long, base double, emit double, line binary, rare array<string>, times array<int>, spots array<int>"
    each = docs.select("doc_id", "text").mapInArrow(one, schema)
    each = written(each.withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = each.select("row", F.posexplode(F.arrays_zip("rare", "times")).alias("at", "r"))
    rare = rare.select("row", "at", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    # Words never seen in training add log10(1), that is nothing; they grow unseen by the planner.
    seen = rare.hint("merge").join(named, "word")
    emitted = F.col("n") + F.when(F.col("kind") > END, 1).otherwise(0)
    sums = seen.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum(F.col("times") * F.log10(emitted)).alias("more_emit"),
        F.sum("times").alias("seen"), F.collect_list(F.struct("at", "kind")).alias("p"),
    )
    full = each.join(sums.hint("merge"), "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_held") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base"), (F.col("emit") + F.coalesce("more_emit", F.lit(0.0))).alias("emit"),
        "line", "rare", "spots", F.col("p.at").alias("at"), F.col("p.kind").alias("kinds"),
    )
    return full.mapInArrow(fill, "doc_id long, n_tokens long, n_known long, base double, emit double, line binary")


def _line_pairs(lines: DataFrame) -> np.ndarray:
    """Class bigram counts of ``line``, a matrix of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALL * ALL, np.int64)
        for batch in batches:
            for line in texts_of(batch.column(0)):
                codes = np.frombuffer(line, np.uint8).astype(np.int64)
                total += np.bincount(codes[:-1] * ALL + codes[1:], minlength=ALL * ALL)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    return _grid(lines.select("line").mapInArrow(count, "cell long, n long"))


def trained(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the rows of ``docs`` (doc_id, text) that are not held out, all words' counts and classes, and all rows' lines."""
    texts = docs.where(~held_out(F.col("doc_id"))).select("text")
    counts = written(word_counts(texts), "words")
    sums = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    rows = texts.count()
    is_short = F.octet_length("word") <= HELD_BYTES
    # One more than are held, so that words as frequent as that one stay out and the bound holds.
    limit = kth_largest(counts.where(is_short), "n", HELD + 1)
    is_held = is_short if limit is None else is_short & (F.col("n") > limit)
    top = counts.where(is_held).toPandas().sort_values(["n", "word"], ascending=[False, True])
    first = list(top["word"][:CLUSTERED])
    classes, grid = exchange(written(pair_counts(texts, first), "pairs"))
    others = placed(contexts(texts, first, classes, frequent(counts)), grid)
    clustered = counts.sparkSession.createDataFrame([(w, int(c)) for w, c in zip(first, classes[1:], strict=False)], "word string, first int")
    # Both sides grow with the vocabulary.
    named = counts.join(F.broadcast(clustered), "word", "left").hint("merge").join(others, "word", "left")
    kind = F.coalesce("first", "kind", F.lit(CLASSES + 1) + ending(F.col("word")))
    named = written(named.select("word", "n", kind.alias("kind")), "classes")
    top = named.where(is_held).toPandas().sort_values(["n", "word"], ascending=[False, True])
    held, n = list(top["word"]), top["n"].to_numpy(np.int64)
    classes = np.append(END, top["kind"].to_numpy(np.int64))
    facts = rows, int(sums[0] or 0) + rows, int(sums[1] or 0) + bool(rows)
    lines = written(class_lines(docs, named, held, n, classes, facts), "lines")
    grid = _line_pairs(lines.where(~held_out(F.col("doc_id"))))
    total = grid.sum(axis=0)
    # Words left to the endings.
    mass = total.copy()
    mass[CLASSES + 1 :] += 1
    for r in named.where(F.col("kind") > END).groupBy("kind").count().collect():
        mass[r["kind"]] += r["count"]
    share = (total + 1) / (total.sum() + ALL)
    steps = np.log10((grid + SMOOTHING * share[None, :]) / (grid.sum(axis=1, keepdims=True) + SMOOTHING))
    return Model(held, n, classes, steps, mass, *facts[1:]), named, lines


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the rows of ``docs`` (doc_id, text) that are not held out, and all words' counts and classes."""
    return trained(docs)[:2]


def score(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text), scored by the model of those not held out."""
    model, _, lines = trained(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.steps, model.mass))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, mass = shared.value
        share = np.log10(np.maximum(mass, 1))
        share[END] = 0.0
        for batch in batches:
            codes = [np.frombuffer(x, np.uint8) for x in texts_of(batch["line"])]
            found = [steps[c[:-1], c[1:]].sum() - share[c[1:]].sum() for c in codes]
            kept = [batch[c] for c in ("doc_id", "n_tokens", "n_known", "base", "emit")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.float64())], ["doc_id", "n_tokens", "n_known", "base", "emit", "steps"])

    found = lines.mapInArrow(scored, "doc_id long, n_tokens long, n_known long, base double, emit double, steps double")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (F.col("emit") + F.col("steps")).alias("score"),
    )


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty and has its end as only token. Rows without doc_id are training text.
    Repeated rows are scored one by one; an empty table gives no rows.
    """
    return score(table(spark, sf_dir, "documents", "doc_id", "text"))
