"""What the operators share: the word rule, table reading and written intermediate tables."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.session import new_folder

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For ``str.translate``: lower-cases A-Z and nothing else.
TO_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a given table; only these are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def byte_words(data: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8. ``bytes.split`` knows the same six blanks as ``WORD``."""
    return data.split() if data else []


def texts_of(column: pa.Array) -> Iterator[bytes | None]:
    """The texts of an Arrow column in UTF-8, without decoding them."""
    for x in column.cast(pa.binary()):
        yield x.as_py()


def give_back() -> None:
    """Hands freed memory back to the system: Arrow's, and where C's library can, C's.

    Spark keeps a Python worker for the next task, with all that its allocators hold by then.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``made``, for ``mapInArrow``, so that a worker between two tasks is as small as before the first."""

    @functools.wraps(made)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from made(batches)
        finally:
            give_back()

    return run


def with_row(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs``, a table read from files, with each row's own number: that of its file and its place there.

    Unlike numbers by partition these stay the same when a table is read again in other splits, as
    happens when executors come or go. The files are listed on the driver, as any scan lists them.
    """
    files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    numbers = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "_file string, _number long")
    placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    found = placed.join(F.broadcast(numbers), "_file")
    return found.select(*docs.columns, (F.col("_number") * F.lit(1 << 40) + F.col("_index")).alias(name))


def with_id(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs`` in a struct, so that no name clashes) and ``id`` by ``with_row``."""
    columns = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    return with_row(docs.select(columns), "id")


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``with_id`` put away."""
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and cut off from what made it.

    Lost executors take nothing with them that later steps need.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kth_largest(ranks: DataFrame, column: str, k: int) -> int | None:
    """The ``k``-th largest of a column of longs; None if there are fewer.

    Counts 16 bits at a time: four small aggregations, whatever k is, and no task sorts anything.
    """
    known = 0
    left = k
    for shift in (48, 32, 16, 0):
        part = F.call_function("shiftright", F.col(column), F.lit(shift))
        if shift < 48:
            ranks = ranks.where(F.call_function("shiftright", F.col(column), F.lit(shift + 16)) == known)
        counts = sorted(((r[0], r[1]) for r in ranks.groupBy(part).count().collect()), reverse=True)
        for value, n in counts:
            if left <= n:
                known = value
                break
            left -= n
        else:
            return None
    return known
