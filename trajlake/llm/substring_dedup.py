"""Substring dedup: words in repeated windows are removed, by suffix automata of reference shards.

Matching every document against the automata of all shards would take time that grows with the square
of the corpus, so documents are led to the shards that can match. Of each window's k-grams the one
with the smallest hash is its seed; equal windows have equal seeds. Where a seed is repeated, the words
around it that share a window with it form a passage. Passages met again as a whole need no more;
the others are the reference, and all passages of a seed are in one shard. A suffix automaton of the
seed's passages then tells, for every place in a passage, the longest run of words ending there that
also occurs elsewhere; runs as long as a window are removed.

A seed with very many different passages would need a very large automaton. Its windows are counted one
by one instead, by two hashes of 64 bits; the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.text import byte_words, table, texts_of, with_row, written

#: Words per window, and per seed.
WINDOW, SEED = 35, 16
#: Seeds that a window chooses from.
CHOICE = WINDOW - SEED + 1
#: Different passages of a seed from which windows are counted instead.
MANY = 500
#: Distinct words a task remembers at a time.
REMEMBERED = 200_000
#: Words whose seeds are sought together.
TOGETHER = 100_000

_P1, _P2, _P3 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_P2, -1, 1 << 64)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word) | 1
        if len(self) < REMEMBERED:
            self[word] = value
        return value


class Powers:
    """Powers of a number and of its inverse modulo 2**64, as far as they were asked for."""

    def __init__(self) -> None:
        self.size = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = 2 * n
            ones = np.ones(self.size, np.uint64)
            up, down = ones.copy(), ones.copy()
            up[1:], down[1:] = np.uint64(_P2), np.uint64(_INVERSE)
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_P3)
    return h ^ (h >> np.uint64(29))


def grams(hashes: np.ndarray) -> np.ndarray:
    n = max(0, len(hashes) - SEED + 1)
    out = np.zeros(n, np.uint64)
    for k in range(SEED):
        out = out * np.uint64(_P1) + hashes[k : k + n]
    return mixed(out)


def running(pick: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """The least or greatest of every n successive values, by doubling."""
    done = 1
    while 2 * done <= n:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def seeds(gram: np.ndarray, sound: np.ndarray) -> np.ndarray:
    """Places of the k-grams that are the smallest of some window; ``sound`` says which windows count.

    A place is chosen if its k-gram is the least of a window that holds it, all of equal ones.
    """
    least = np.where(sound, running(np.minimum, gram, CHOICE), np.uint64(0))
    pad = np.zeros(CHOICE - 1, np.uint64)
    return np.flatnonzero(running(np.maximum, np.concatenate([pad, least, pad]), CHOICE) == gram)


def stretch(at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that share a window with the seed at ``at``, in a text from ``begin`` to ``end``."""
    return np.maximum(at - (CHOICE - 1), begin), np.minimum(at + WINDOW, end)


def _found(rows: list[int], sizes: list[int], hashes: np.ndarray, powers: Powers) -> pa.RecordBatch:
    """The seeds of several texts whose words lie end to end."""
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(rows)), sizes)
    gram = grams(hashes)
    count = len(hashes) - WINDOW + 1
    at = seeds(gram, text[:count] == text[WINDOW - 1 :])
    of = text[at]
    begin = (ends - sizes)[of]
    low, high = stretch(at, begin, ends[of])
    up, down = powers.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes) * up[:-1], out=sums[1:])
    whole = (sums[high] - sums[low]) * down[low]
    # Passages cut off by a text's ends are told apart by where the seed lies in them.
    shape = ((at - low) * 64 + (high - at)).astype(np.uint64)
    around = mixed(whole + shape * np.uint64(_P1))
    # Periodic texts have the same seed and passage at very many places: one row for each text.
    place, seed = (at - begin).astype(np.int32), gram[at].view(np.int64)
    order = np.lexsort((place, around, seed, of))
    of, place, seed, around = of[order], place[order], seed[order], around[order].view(np.int64)
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (seed[1:] != seed[:-1]) | (around[1:] != around[:-1])
    first = np.flatnonzero(new)
    others = np.diff(np.append(first, len(of))) - 1
    offsets = np.append(0, np.cumsum(others)).astype(np.int32)
    more = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[~new]), mask=pa.array(others == 0))
    arrays = [pa.array(np.asarray(rows)[of[first]]), pa.array(place[first]), more, pa.array(seed[first]), pa.array(around[first])]
    return pa.RecordBatch.from_arrays(arrays, ["row", "at", "more", "seed", "around"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, powers = WordHash(), Powers()
    rows, sizes, waiting = [], [], []
    for batch in batches:
        for row, text in zip(batch.column(0).to_numpy(), texts_of(batch.column(1)), strict=True):
            words = byte_words(text)
            if len(words) < WINDOW:
                continue
            rows.append(row)
            sizes.append(len(words))
            waiting.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            if sum(sizes) > TOGETHER:
                yield _found(rows, sizes, np.concatenate(waiting), powers)
                rows, sizes, waiting = [], [], []
    if rows:
        yield _found(rows, sizes, np.concatenate(waiting), powers)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(batch), rows):
        yield batch.slice(start, rows)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in (part for whole in batches for part in slices(whole)):
        texts = [squeeze.compress(x or b"") for x in texts_of(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["row", "doc_id", "packed"])


def _words(packed: pa.Scalar, open_: zstandard.ZstdDecompressor) -> list[bytes]:
    return byte_words(open_.decompress(packed.as_py()))


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around each wanted seed, and how many of them come before it."""
    open_ = zstandard.ZstdDecompressor()
    for batch in (part for whole in batches for part in slices(whole)):
        out: list[tuple] = []
        for packed, wanted in zip(batch.column("packed"), batch.column("wanted"), strict=True):
            words = _words(packed, open_)
            for w in wanted.as_py():
                low, high = max(w["at"] - CHOICE + 1, 0), min(w["at"] + WINDOW, len(words))
                out.append((w["row"], w["at"], w["seed"], w["n"], w["at"] - low, b" ".join(words[low:high])))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["row", "at", "seed", "n", "before", "passage"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


PASSAGE = "row long, at int, seed long, n long, before int, passage binary"


class Automaton:
    """A suffix automaton of several word sequences.

    Each state knows the first and the last of the places where its runs of words end, so whether a run
    occurs anywhere besides a given place.
    """

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.first: list[int] = [1 << 62]
        self.last: list[int] = [-1]

    def _state(self, follow: dict[bytes, int], link: int, length: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.first.append(1 << 62)
        self.last.append(-1)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A copy of ``q`` for the runs that end shorter, between ``p`` and ``q``."""
        nxt, link = self.next, self.link
        clone = self._state(nxt[q].copy(), link[q], self.length[p] + 1)
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, words: list[bytes], place: int) -> list[int]:
        """Add a sequence whose first word is at ``place``; returns the state of each prefix."""
        nxt, link, length, first, last = self.next, self.link, self.length, self.first, self.last
        at, states = 0, []
        for i, word in enumerate(words):
            q = nxt[at].get(word)
            if q is not None:
                at = q if length[q] == length[at] + 1 else self._split(at, word, q)
            else:
                new = self._state({}, 0, length[at] + 1)
                p = at
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                at = new
            if place + i < first[at]:
                first[at] = place + i
            if place + i > last[at]:
                last[at] = place + i
            states.append(at)
        return states

    def close(self) -> None:
        """Hand places on from longer runs to their suffixes."""
        link, first, last = self.link, self.first, self.last
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[s]
            if first[s] < first[up]:
                first[up] = first[s]
            if last[s] > last[up]:
                last[up] = last[s]

    def repeated(self, states: list[int], least: int) -> list[bool]:
        """For each prefix, whether its last ``least`` words also end at another place."""
        link, length, first, last, out = self.link, self.length, self.first, self.last, []
        for s in states:
            while length[s] >= least and first[s] == last[s]:
                s = link[s]
            out.append(length[s] >= least)
        return out


def repeated_windows(group: list[tuple[int, int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """(row, at, mask) of the passages (row, at, n, before, words) of one seed that occur once as a whole.

    Bit ``o`` of the mask stands for the window that begins ``o`` words before the seed. A place is a
    document and a word's position in it, so passages that overlap in a document count their common
    words once.
    """
    automaton, kept = Automaton(), []
    number: dict[int, int] = {}
    for row, at, n, before, passage in sorted(group, key=lambda g: (g[0], g[1])):
        words = passage.split(b" ")
        place = (number.setdefault(row, len(number)) << 40) + at - before
        states = automaton.add(words, place)
        if n > 1:
            # It occurs more often than once, so its runs do: a second place that is nowhere else.
            for i, s in enumerate(states):
                automaton.last[s] = max(automaton.last[s], (len(number) << 40) + (1 << 39) + i)
        else:
            kept.append((row, at, before, states))
    automaton.close()
    for row, at, before, states in kept:
        mask = 0
        for start, hit in enumerate(automaton.repeated(states[WINDOW - 1 :], WINDOW)):
            if hit:
                mask |= 1 << (before - start)
        if mask:
            yield row, at, mask


MASK = "row long, at int, mask int"


def _masks(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32()], strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["row", "at", "mask"])


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their seed."""
    group: list[tuple[int, int, int, int, bytes]] = []
    seed = None
    for batch in batches:
        out: list[tuple] = []
        for row, at, key, n, before, passage in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != seed and group:
                out.extend(repeated_windows(group))
                group = []
            seed = key
            group.append((row, at, n, before, passage))
        yield _masks(out)
    yield _masks(list(repeated_windows(group)) if group else [])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes for each window whose first smallest k-gram is the passage's seed, with the window's bit.

    Every window has one such seed, so it is counted once however passages overlap.
    """
    known, powers = WordHash(), Powers()
    for batch in batches:
        out: list[tuple] = []
        for row, at, _, n, before, passage in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            words = passage.split(b" ")
            hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            up, down = powers.upto(len(words) + 1)
            count = len(words) - WINDOW + 1
            one, two = np.zeros(count, np.uint64), np.zeros(len(words) + 1, np.uint64)
            for k in range(WINDOW):
                one = one * np.uint64(_P1) + hashes[k : k + count]
            np.cumsum(mixed(hashes) * up[:-1], out=two[1:])
            second = mixed((two[WINDOW:] - two[:-WINDOW]) * down[:count])
            first = mixed(one)
            own = sliding_window_view(grams(hashes), CHOICE).argmin(axis=1) + np.arange(count)
            for i in np.flatnonzero(own == before):
                out.append((row, at, n, 1 << (before - int(i)), int(first[i].view(np.int64)), int(second[i].view(np.int64))))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        names = ["row", "at", "n", "mask", "one", "two"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def spans(mask: int, at: int, words: int) -> Iterator[int]:
    """Where the windows begin that a mask stands for."""
    for o in range(CHOICE):
        start = at - o
        if mask >> o & 1 and 0 <= start <= words - WINDOW:
            yield start


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    everything = (1 << CHOICE) - 1
    for batch in (part for whole in batches for part in slices(whole)):
        docs, total, gone, digests, texts = [], [], [], [], []
        for key, packed, found in zip(batch.column("doc_id"), batch.column("packed"), batch.column("found"), strict=True):
            words = _words(packed, open_)
            cover = np.zeros(len(words) + 1, np.int32)
            for f in found.as_py() or ():
                if f["mask"] == everything:
                    at = np.array([f["at"], *(f["more"] or ())])
                    np.add.at(cover, np.maximum(0, at - CHOICE + 1), 1)
                    np.add.at(cover, np.minimum(at + WINDOW, len(words)), -1)
                else:
                    for start in spans(f["mask"], f["at"], len(words)):
                        cover[start] += 1
                        cover[start + WINDOW] -= 1
            keep = np.cumsum(cover[:-1]) == 0
            text = b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)])
            docs.append(key.as_py())
            total.append(len(words))
            gone.append(int(len(words) - keep.sum()))
            digests.append(hashlib.sha256(text).hexdigest())
            texts.append(text)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip((docs, total, gone, digests, texts), types, strict=True)]
        columns[-1] = columns[-1].cast(pa.string())
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (row, doc_id, text) without the words of repeated windows.

    ``row`` is a long that is a row's own. Returns doc_id, n_words, n_removed, kept_sha256, and the
    words ``kept``. Texts of fewer words than a window are kept; a null text is empty.
    """
    rows = docs.select("row", "doc_id", "text")
    anchors = written(rows.select("row", "text").mapInArrow(_anchors, "row long, at int, more array<int>, seed long, around long"), "anchors")
    places = F.sum(F.when(F.col("more").isNull(), 1).otherwise(F.size("more") + 1))
    again = anchors.groupBy("seed").agg(places.alias("n"), F.min("around").alias("low"), F.max("around").alias("high")).where("n > 1")
    # As a table, so that the join deals out both sides and can split a seed that very many texts have.
    again = written(again.select("seed", (F.col("low") != F.col("high")).alias("several")), "again")
    found = anchors.join(again, "seed")
    # Everything below starts from this table: the places of repeated seeds.
    found = written(found.select("row", "at", "more", "seed", "around", "several"), "seeds")
    several = found.where("several")
    passages = several.groupBy("seed", "around").agg(places.alias("n"), F.min(F.struct("row", "at")).alias("place"))
    passages = written(passages, "passages")
    sizes = passages.groupBy("seed").agg(F.count(F.lit(1)).alias("size"))
    wanted = passages.join(sizes, "seed").select(
        F.col("place.row").alias("row"), (F.col("size") > MANY).alias("many"),
        F.struct(F.col("place.row").alias("row"), F.col("place.at").alias("at"), "seed", "n").alias("w"),
    )
    # Texts move once, packed; both uses below read the same exchange.
    packed = rows.mapInArrow(_packed, "row long, doc_id long, packed binary").repartition("row")

    def texts_of(some: DataFrame) -> DataFrame:
        lists = some.groupBy("row").agg(F.collect_list("w").alias("wanted"))
        return packed.join(lists, "row").mapInArrow(_passages, PASSAGE)

    few = texts_of(wanted.where("not many")).repartition("seed").sortWithinPartitions("seed").mapInArrow(_matched, MASK)
    windows = texts_of(wanted.where("many")).mapInArrow(_windows, "row long, at int, n long, mask int, one long, two long")
    twice = windows.groupBy("one", "two").agg(F.sum("n").alias("n")).where("n > 1").select("one", "two")
    many = windows.join(twice, ["one", "two"]).select("row", "at", "mask")
    whole = F.lit((1 << CHOICE) - 1).alias("mask")
    same = found.where("not several").select("row", "at", "more", whole)
    repeats = passages.where("n > 1").select("seed", "around")
    # A passage is in there once, so this adds no rows.
    met = several.join(repeats, ["seed", "around"]).select("row", "at", "more", whole)
    single = few.unionAll(many).select("row", "at", F.lit(None).cast("array<int>").alias("more"), "mask")
    marks = same.unionAll(met).unionAll(single).groupBy("row").agg(F.collect_list(F.struct("at", "more", "mask")).alias("found"))
    ready = packed.join(marks, "row", "left").select("doc_id", "packed", "found")
    return ready.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after removal: doc_id, n_words, n_removed, kept_sha256.

    Repeated rows are documents of their own, so their windows repeat. An empty table gives no rows.
    """
    docs = with_row(table(spark, sf_dir, "documents", "doc_id", "text"))
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
