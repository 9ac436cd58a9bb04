"""Reading free-text model answers about a video: lists of ``{"HH:MM:SS": [ids]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.clock import _c

# The mark of a code fence, the shape of a list of objects inside prose, and the
# fenced list that the strict reading accepts.
FENCE = "```"
LIST_IN_PROSE = r"(?s)(\[\s*\{.*?\}\s*(?:,\s*\{.*?\}\s*)*\])"
STRICT_FENCED_LIST = r"(?s)```json\s*(\[.*?\])\s*```"

ITEMS = "array<map<string,array<int>>>"
WRAPPED = "struct<events:array<map<string,array<int>>>>"
SINGLE = "map<string,array<int>>"
STRICT_JSON = {"allowSingleQuotes": "false"}


BLANKS = " \n\t\r\x0b\x0c"


def strip(col) -> Column:
    return F.trim(_c(col), F.lit(BLANKS))


def strip_fence(col) -> Column:
    """Text between the first and last line of a fenced block of three lines or more."""
    text = strip(col)
    inner = F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*)\n[^\n]*$", 1)
    fenced = text.startswith(FENCE) & text.rlike(r"(?s)^[^\n]*\n.*\n[^\n]*$")
    return F.when(fenced, strip(inner)).otherwise(text)


def list_in_prose(col) -> Column:
    """First list of objects inside the text; the text itself where there is none."""
    found = F.regexp_extract(_c(col), LIST_IN_PROSE, 1)
    return F.when(found == "", _c(col)).otherwise(found)


def _read_items(text: str) -> Column:
    """Items of a list, of an ``events`` wrapper or of a single object; null if it is neither."""
    t = F.col(text)
    single = F.from_json(t, SINGLE)
    return F.when(t.startswith("["), F.from_json(t, ITEMS)).when(
        t.startswith("{"),
        F.coalesce(F.from_json(t, WRAPPED)["events"], F.when(single.isNotNull(), F.array(single))),
    )


def _tidy(col) -> Column:
    return F.regexp_replace(_c(col), r",\s*([\]}])", "$1")


def with_items(rows: DataFrame, content: str, name: str = "items") -> DataFrame:
    """Add all items of a lenient answer: an empty list for an empty answer, null if unreadable.

    Single quotes and trailing commas are tolerated. An answer holding anything but lists of
    whole numbers stays null, for the quarantine. Every step is a column of its own, so each
    answer is stripped, matched and parsed once; prose is searched only where parsing failed.
    """
    void = (F.col("_raw") == "") | (F.col("_raw") == "[]")
    return (
        rows.withColumn("_raw", strip(F.coalesce(_c(content), F.lit(""))))
        .withColumn("_body", strip_fence("_raw"))
        .withColumn("_tidy", _tidy("_body"))
        .withColumn("_whole", F.when(void, F.array().cast(ITEMS)).otherwise(_read_items("_tidy")))
        .withColumn("_found", F.when(F.col("_whole").isNull(), _tidy(list_in_prose("_body"))))
        .withColumn(name, F.coalesce("_whole", _read_items("_found")))
        .drop("_raw", "_body", "_tidy", "_whole", "_found")
    )


def with_strict_items(rows: DataFrame, content: str, name: str = "items") -> DataFrame:
    """Add the items of a fenced ``json`` list or of a text that is a JSON list as a whole; else null."""
    bare = F.when(F.col("_text").startswith("[") & F.col("_text").endswith("]"), F.col("_text"))
    return (
        rows.withColumn("_text", strip(F.coalesce(_c(content), F.lit(""))))
        .withColumn("_fenced", F.regexp_extract("_text", STRICT_FENCED_LIST, 1))
        .withColumn("_json", F.when(F.col("_fenced") != "", F.col("_fenced")).otherwise(bare))
        .withColumn(name, F.from_json("_json", ITEMS, STRICT_JSON))
        .drop("_text", "_fenced", "_json")
    )


def last_entries(item) -> Column:
    """Entries of a map in which a repeated key counts only with its last value."""
    entries = F.map_entries(item)
    return F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + F.lit(2), F.size(entries)), lambda later: later["key"] == e["key"]
        ),
    )


def object_set(ids) -> Column:
    """Ids as a sorted list without repeats, so that equal sets are equal values."""
    return F.array_sort(F.array_distinct(ids))
