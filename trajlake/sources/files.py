"""Readers for trajectories, delimited text, model answers, event lists, truth and metrics files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions.answers import strip
from trajlake.functions.clock import parse_ts
from trajlake.schema import EVENT_ROW, METRICS_FILE, RESPONSE

# Candidate separators in the order that decides ties.
DELIMITERS = ("\t", ",", ";", "|", " ")
EVENT_LIST_SUFFIX = "_eventlist.jsonl"


def resolve(uri: str) -> str:
    """Object-store addresses through the S3A connector, everything else as it is."""
    return re.sub(r"^(s3|minio)://", "s3a://", uri.strip(), flags=re.IGNORECASE)


def artifact_uri(root: str, kind: str, name: str) -> str:
    """Where an artifact of a kind goes below an output root."""
    return f"{resolve(root).rstrip('/')}/{kind}/{name}"


def file_order() -> Column:
    """Order of rows as they stand in files: by file, by split, by place in the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def read_trajectory_text(spark: SparkSession, uri: str) -> DataFrame:
    """Rows of CSV or Parquet as they are stored, with ``seq``. The extension names the format."""
    path = resolve(uri)
    kind = path.rstrip("/").lower().rsplit(".", 1)[-1]
    if kind == "csv":
        raw = spark.read.option("header", True).csv(path)
    elif kind == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"neither .csv nor .parquet: {uri}")
    return raw.select("timestamp", "objid", "x", "y", "z", file_order().alias("seq"))


def _typed(rows: DataFrame) -> DataFrame:
    stamp = dict(rows.dtypes)["timestamp"]
    time = parse_ts("timestamp") if stamp == "string" else F.col("timestamp").cast("timestamp_ntz")
    numbers = [F.col(a).try_cast("double").alias(a) for a in ("x", "y", "z")]
    return rows.select(time.alias("timestamp"), "objid", *numbers, "seq")


def _whole() -> Column:
    cond = F.col("timestamp").isNotNull()
    for name in ("objid", "x", "y", "z"):
        cond = cond & F.col(name).isNotNull()
    return cond


def read_trajectory(spark: SparkSession, uri: str) -> DataFrame:
    """Typed rows of a CSV or Parquet trajectory with ``seq``; unreadable rows are left out."""
    return _typed(read_trajectory_text(spark, uri)).where(_whole())


def trajectory_rejects(spark: SparkSession, uri: str) -> DataFrame:
    """The rows that ``read_trajectory`` leaves out."""
    return _typed(read_trajectory_text(spark, uri)).where(~_whole())


def read_lines(spark: SparkSession, uri: str) -> DataFrame:
    """Text lines with their file and order."""
    return spark.read.text(resolve(uri)).select(
        "value", F.col("_metadata.file_path").alias("source"), file_order().alias("line_no")
    )


def sniff_delimiter(lines: DataFrame, source: str = "source", text: str = "value") -> DataFrame:
    """The separator of each source: the candidate that occurs most often, ties to the earlier one.

    Occurrences are summed on the map side, so a huge source is counted by many tasks.
    """

    def occurrences(d: str) -> Column:
        return F.length(text) - F.length(F.replace(F.col(text), F.lit(d), F.lit("")))

    sums = [F.sum(occurrences(d)).alias(f"_n{i}") for i, d in enumerate(DELIMITERS)]
    counted = lines.groupBy(source).agg(*sums)
    ranked = F.array_max(
        F.array(
            *[
                F.struct(F.coalesce(f"_n{i}", F.lit(0)).alias("n"), F.lit(-i).alias("rank"))
                for i in range(len(DELIMITERS))
            ]
        )
    )
    names = F.array(*[F.lit(d) for d in DELIMITERS])
    return counted.select(
        source, F.element_at(names, 1 - ranked["rank"]).alias("delimiter"), ranked["n"].cast("bigint").alias("occurrences")
    )


def delimited_cells(
    lines: DataFrame, source: str = "source", text: str = "value", delimiter: str | None = None
) -> DataFrame:
    """Cells of every non-blank line, cut at the source's own separator or at a given one."""
    kept = lines.withColumn("_line", strip(text)).where(F.col("_line") != "")
    if delimiter is not None:
        cut = kept.withColumn("delimiter", F.lit(delimiter))
    else:
        cut = kept.join(sniff_delimiter(lines, source, text).select(source, "delimiter"), source)
    by_space = F.split("_line", r"\s+")
    by_mark = F.transform(
        F.split(F.replace(F.col("_line"), F.col("delimiter"), F.lit("\u0001")), "\u0001"),
        strip,
    )
    cells = F.when(F.col("delimiter") == " ", by_space).otherwise(by_mark)
    return cut.withColumn("cells", cells).drop("_line")


def read_responses(spark: SparkSession, uri: str, *, multiline: bool = True) -> DataFrame:
    """Response documents, one per file (or per line with ``multiline`` off)."""
    return spark.read.schema(RESPONSE).json(resolve(uri), multiLine=multiline)


def response_chunks(responses: DataFrame) -> DataFrame:
    """One row per chunk answer, with its place in the document."""
    return responses.select(
        "id", "model", "execution_time", F.posexplode("chunk_responses").alias("chunk_pos", "_c")
    ).select("id", "model", "execution_time", "chunk_pos", F.col("_c.content").alias("content"))


def read_event_list(spark: SparkSession, uri: str) -> DataFrame:
    """Event list lines as stored, with ``line_no``; blank lines give no row."""
    return spark.read.schema(EVENT_ROW).json(resolve(uri)).select(
        "timestamp", "objid", "position", file_order().alias("line_no")
    )


def list_files(spark: SparkSession, uri: str, *, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """Files below a folder with size and time; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(resolve(uri)).select(
        F.col("path").alias("uri"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")
    )


def _bare(uri: Column) -> Column:
    """A path without what local file systems may put before it, and without a slash at its end."""
    return F.regexp_replace(F.regexp_replace(uri, "^file:/+", "/"), "(?<=.)/+$", "")


def file_stat(spark: SparkSession, folder: str, wanted: DataFrame, uri: str = "uri") -> DataFrame:
    """``wanted`` with what there is at each of its paths: ``found``, ``files``, ``size``, ``last_modified``.

    A path may be a file or a folder: all files at or below it count, and one that is missing has no
    files. Spark's scans leave empty files out, so these count as missing. ``folder`` is where all wanted paths lie; it is listed once, in parallel where it is large, and each file
    is counted for itself and the folders above it, summed on the map side. No path is asked for on its own.
    """
    parts = F.split("_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    listed = list_files(spark, folder).withColumn("_path", _bare(F.col("uri")))
    known = listed.select(F.explode(above).alias("_path"), "size", "last_modified").groupBy("_path").agg(
        F.count("*").alias("files"), F.sum("size").alias("size"), F.max("last_modified").alias("last_modified")
    )
    asked = wanted.withColumn("_path", _bare(F.col(uri)))
    return asked.join(known, "_path", "left").drop("_path").withColumns(
        {"found": F.col("files").isNotNull(), "files": F.coalesce("files", F.lit(0))}
    )


def latest_file(spark: SparkSession, uri: str, suffix: str = EVENT_LIST_SUFFIX) -> DataFrame:
    """The newest file or output folder with a suffix, by time and then by name."""
    found = list_files(spark, f"{uri.rstrip('/')}/*{suffix}")
    name = F.regexp_extract("uri", "(.*" + suffix.replace(".", r"\.") + ")", 1)
    return found.agg(F.max_by(name, F.struct(F.col("last_modified"), name)).alias("uri"))


def read_metrics(spark: SparkSession, uri: str, *, multiline: bool = True) -> DataFrame:
    """Metrics files matching a path or glob; unreadable ones come with null metrics.

    One document per file, or per line with ``multiline`` off.
    """
    return (
        spark.read.schema(METRICS_FILE)
        .json(resolve(uri), multiLine=multiline)
        .withColumn("file", F.col("_metadata.file_path"))
    )
