"""Quality by importance resampling.

Two generative models over hashed n-grams, one of target text (documents labelled good and not toxic)
and one of all text, give every document a log importance weight; documents are then drawn without
replacement by Gumbel top-k: noise of scale 1 is added to the log weights, and the k largest sums are
drawn. k is a share of the documents, a parameter; if it is not given, that of good ones among the labels.

N-grams are words in lower case and runs of symbols, their first four and first five characters, and
pairs of word shapes (capitals, digits, repetition). A ratio compares the target's count with the one
the raw model expects, in both directions, and is drawn towards 1 by some standard errors of that count,
so that n-grams seen too seldom to tell say nothing. A text's log weight is that of ``TOKENS`` of its
tokens on average, so that length alone buys none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.text import give_back, kth_largest, lean, table, unpacked, with_id, written

#: Buckets for words, beginnings of either length, and shape pairs each: the model's size whatever the data.
BUCKETS = 1 << 18
PARTS = 4
#: The target model is fitted on at most so many labelled documents, those with the largest hashes.
TARGET_ROWS = 50_000
#: Added to the counts compared.
PRIOR = 0.5
#: Standard errors by which a log ratio is drawn towards 0.
CHANCE = 3.0
#: A log weight is the mean over a text's tokens times this.
TOKENS = 100.0
#: The log weight of a text without tokens, below any other: 4 ratios a token, none beyond the logarithm of 2^64.
LOWEST = -100_000.0
SEED = 11
#: Distinct words a task remembers at a time.
REMEMBERED = 300_000

TOKEN = re.compile(r"\w+|[^\w\s]+")


class Marks(dict):
    """Token -> its word's hash times 16 plus its shape; forgets when full."""

    def __missing__(self, token: str) -> int:
        if token[0].isalpha():
            shape = 1 if len(token) > 1 and token.isupper() else 2
        elif token[0].isalnum() or token[0] == "_":
            shape = 3
        else:
            shape = 4 + zlib.crc32(token[:2].encode("utf-8", "replace")) % 11
        mark = zlib.crc32(token.lower().encode("utf-8", "replace")) * 16 + shape
        if len(self) < REMEMBERED:
            self[token] = mark
        return mark


class Heads(dict):
    """Token -> the hashes of its first four and first five characters, in lower case; forgets when full."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        four = zlib.crc32(low[:4].encode("utf-8", "replace")) & (BUCKETS - 1)
        value = four * BUCKETS + (zlib.crc32(low[:5].encode("utf-8", "replace")) & (BUCKETS - 1))
        if len(self) < REMEMBERED:
            self[token] = value
        return value


def features(text: str, marks: Marks, heads: Heads) -> tuple[np.ndarray, int]:
    """Buckets of a text's n-grams, part after part, and its number of tokens."""
    tokens = TOKEN.findall(text)
    seen = np.fromiter(map(marks.__getitem__, tokens), np.int64, len(tokens))
    begin = np.fromiter(map(heads.__getitem__, tokens), np.int64, len(tokens))
    word, shape = seen >> 4, seen & 15
    shape[1:][word[1:] == word[:-1]] = 0
    pairs = shape[:-1] * 16 + shape[1:]
    word = (word * 0x9E3779B1) >> 11 & (BUCKETS - 1)
    return np.concatenate([word, BUCKETS + begin // BUCKETS, 2 * BUCKETS + begin % BUCKETS, 3 * BUCKETS + pairs]), len(tokens)


@lean
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks, heads = Marks(), Heads()
    raw, target = np.zeros(PARTS * BUCKETS, np.int64), np.zeros(PARTS * BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column(0), batch.column(1), strict=True):
            found, _ = features(text.as_py() or "", marks, heads)
            np.add.at(raw, found, 1)
            if good.as_py():
                np.add.at(target, found, 1)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


@dataclass
class Model:
    weights: np.ndarray
    #: doc_id and ``good`` of the labelled documents.
    labels: DataFrame


def good_labels(labels: DataFrame) -> DataFrame:
    """One row per labelled doc_id; ``good`` if every label says quality 1 and none says toxic."""
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(good).alias("good"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Both models, as one log ratio per bucket. Raw counts cover all documents."""
    judged = good_labels(labels)
    target = judged.where("good").select("doc_id", F.xxhash64("doc_id", F.lit(SEED)).alias("mark"))
    last = kth_largest(target, "mark", TARGET_ROWS)
    target = target if last is None else target.where(F.col("mark") >= last)
    # At most TARGET_ROWS numbers: their size is known whatever the data.
    known = F.broadcast(target.select("doc_id", F.lit(True).alias("good")))
    rows = docs.select("doc_id", "text").join(known, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = rows.mapInArrow(_counts, "bucket long, raw long, target long")
    # One row per bucket at most, from every task one at most before that.
    sums = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, seen = np.zeros(PARTS * BUCKETS), np.zeros(PARTS * BUCKETS)
    raw[sums["bucket"]], seen[sums["bucket"]] = sums["raw"], sums["target"]
    weights = np.zeros(PARTS * BUCKETS)
    for part in (slice(k * BUCKETS, (k + 1) * BUCKETS) for k in range(PARTS)):
        if seen[part].sum():
            due = raw[part] * (seen[part].sum() / raw[part].sum())
            ratio = np.log((seen[part] + PRIOR) / (due + PRIOR))
            weights[part] = np.sign(ratio) * np.maximum(np.abs(ratio) - CHANCE / np.sqrt(due + PRIOR), 0.0)
    return Model(weights.astype(np.float32), judged)


def ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles: their bits, those below the sign turned if negative."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def judged(docs: DataFrame, text: Column, key: Column, model: Model) -> DataFrame:
    """``docs`` with ``judged``: log_weight, and ``rank``, a number in the order of the Gumbel keys."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)

    @F.pandas_udf("log_weight double, rank long")
    def judge(texts: pd.Series, noise: pd.Series) -> pd.DataFrame:
        marks, heads, w = Marks(), Heads(), weights.value
        out = np.full(len(texts), LOWEST)
        for i, text in enumerate(texts):
            found, n = features(text or "", marks, heads)
            if n:
                out[i] = w[found].sum(dtype=np.float64) * TOKENS / n
        del marks, heads
        give_back()
        return pd.DataFrame({"log_weight": out, "rank": ordered(out + noise.to_numpy(np.float64))})

    even = (F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return docs.withColumn("judged", judge(text, -F.ln(-F.ln(even))))


def good_share(labels: DataFrame) -> float:
    """The share of good documents among the labelled ones (doc_id, ``good``); 1 without labels."""
    n, good = labels.agg(F.count(F.lit(1)), F.count_if("good")).first()
    return good / n if n else 1.0


def drawn(docs: DataFrame, text: Column, key: Column, model: Model, *columns: Column, share: float | None = None) -> DataFrame:
    """``columns`` and log_weight of the drawn rows of ``docs``: a ``share`` of them, or that of good labels.

    Rows that tie with the last one drawn are drawn too.
    """
    chosen = judged(docs, text, key, model).select(*columns, "judged.log_weight", F.col("judged.rank").alias("_rank"))
    found = written(chosen, "judged")
    rows = int(found.count() * (good_share(model.labels) if share is None else share) + 0.5)
    last = kth_largest(found, "_rank", rows) if rows else None
    kept = found.where("false") if last is None else found.where(F.col("_rank") >= last)
    return kept.drop("_rank")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The drawn documents, with the columns of ``docs``. Texts without tokens are drawn last."""
    model = fit(docs, labels)
    kept = drawn(with_id(docs), F.col("row.text"), F.col("row.doc_id"), model, F.col("row"))
    return unpacked(kept, docs.columns)


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws: doc_id, log_weight.

    As many are drawn as the labels' share of good documents says; without labels all, with none
    labelled good none. A null or empty text has the lowest log weight, ``LOWEST``, and is drawn only when
    all others are. Very long texts are read whole. Rows of one doc_id get the same noise (those without
    one too); equal rows are drawn together. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return drawn(docs, F.col("text"), F.col("doc_id"), model, F.col("doc_id"))
