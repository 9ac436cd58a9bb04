"""The lake: trajectories in files clustered by time, with a manifest of small tables.

``<root>/data`` holds the rows: files of even size, each a range of instants, sorted by time; a crowded
instant may fill several. Chunks of equal length are a number computed from the first instant, not folders.
Below ``<root>/manifest``, ``instants`` has a row per file and instant and ``parts`` one per chunk and object,
both made from what was written; ``files`` is the zone map (first and last instant and rows of each file) and ``head`` one row of
facts. Readers take from the zone map the files that a range or a set of probes touches, and open no
others. All but the head grow with the data, so they are tables and not one document.

Lakes that come as ``manifest.json`` plus ``chunk_*.csv`` or ``.parquet`` files can be read, and written by
``export_lake``.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from trajlake.functions.clock import MICROS, floor_div, format_ts, instant, micros, parse_ts, trunc_ms
from trajlake.operators.asof import floor_times
from trajlake.operators.trajectory import chunk_parts, head_of_parts, object_ids, stats_of_parts
from trajlake.schema import MANIFEST
from trajlake.session import written
from trajlake.sources.files import read_trajectory, resolve

MANIFEST_DOCUMENT = "manifest.json"


def dataset_root(uri: str) -> str:
    """Folder of a dataset, given the folder or its manifest."""
    root = resolve(uri).rstrip("/")
    if root.lower().endswith("/" + MANIFEST_DOCUMENT):
        root = root[: -len(MANIFEST_DOCUMENT) - 1]
    return root


def write_lake(
    traj: DataFrame, uri: str, *, chunk_seconds: int = 60, hz: float | None = None, dataset: str = "", fmt: str = "parquet",
    files: int | None = None,
) -> str:
    """Write rows and manifest; returns the root.

    Rows are dealt out by ranges of time, so that neighbouring instants share a file: ``files`` of them, or as
    many as adaptive execution finds fit, which joins small neighbours. Text files cut timestamps to milliseconds, and what is written is what counts.
    """
    root = dataset_root(uri)
    rows = traj.select("timestamp", "objid", "x", "y", "z")
    by = (files, "timestamp", "objid") if files else ("timestamp", "objid")
    ordered = rows.repartitionByRange(*by).sortWithinPartitions("timestamp", "objid")
    if fmt == "parquet":
        ordered.write.parquet(f"{root}/data")
    elif fmt == "csv":
        ordered.withColumn("timestamp", format_ts("timestamp")).write.option("header", True).csv(f"{root}/data")
    else:
        raise ValueError(f"unknown format: {fmt}")
    spark = traj.sparkSession
    at = _rows(spark, fmt, f"{root}/data").select("timestamp", F.col("_metadata.file_name").alias("file"))
    at.groupBy("file", "timestamp").agg(F.count("*").alias("rows")).write.parquet(f"{root}/manifest/instants")
    instants = spark.read.schema(INSTANTS).parquet(f"{root}/manifest/instants")
    zones = instants.groupBy("file").agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.sum("rows").alias("rows")
    )
    # A row per file, as the driver of any scan holds: written from there in one piece.
    found = zones.withColumn("first_us", micros("first")).collect()
    origin = min((z["first_us"] for z in found), default=None)
    listed = spark.createDataFrame([z[:4] for z in found], FILES).coalesce(1)
    listed.write.parquet(f"{root}/manifest/files")
    chunked = _rows(spark, fmt, f"{root}/data").withColumn("chunk", _chunk(origin, chunk_seconds))
    chunk_parts(chunked).write.parquet(f"{root}/manifest/parts")
    head = head_of_parts(read_parts(spark, root), chunk_seconds=chunk_seconds, fmt=fmt, hz=hz, dataset=dataset)
    head.withColumn("origin_us", F.lit(origin).cast("bigint")).write.json(f"{root}/manifest/head")
    return root


HEAD = (
    "version int, dataset string, hz double, chunk_seconds bigint, format string, start string, end string, rows bigint, objects bigint, "
    "chunks bigint, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, origin_us bigint"
)
FILES = "file string, first timestamp_ntz, last timestamp_ntz, rows bigint"
INSTANTS = "file string, timestamp timestamp_ntz, rows bigint"
ROWS = "timestamp {}, objid string, x double, y double, z double"


def _chunk(origin: int | None, chunk_seconds: int) -> Column:
    return floor_div(micros("timestamp") - F.lit(origin).cast("bigint"), chunk_seconds * MICROS)


def _rows(spark: SparkSession, fmt: str, *paths: str) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], ROWS.format("timestamp_ntz"))
    if fmt == "csv":
        raw = spark.read.option("header", True).schema(ROWS.format("string")).csv(list(paths))
        return raw.select("*", "_metadata").withColumn("timestamp", parse_ts("timestamp"))
    return spark.read.schema(ROWS.format("timestamp_ntz")).parquet(*paths)


def read_manifest(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.schema(HEAD).json(f"{dataset_root(uri)}/manifest/head")


def read_files(spark: SparkSession, uri: str) -> DataFrame:
    """The zone map: ``file``, its ``first`` and ``last`` instant, and ``rows``."""
    return spark.read.schema(FILES).parquet(f"{dataset_root(uri)}/manifest/files")


def read_parts(spark: SparkSession, uri: str) -> DataFrame:
    """Facts per chunk and object."""
    return spark.read.parquet(f"{dataset_root(uri)}/manifest/parts")


def read_chunks(spark: SparkSession, uri: str) -> DataFrame:
    """``chunk``, its key, first and last instant, and rows."""
    fmt = read_manifest(spark, uri).first()["format"]
    stats = stats_of_parts(read_parts(spark, uri), fmt)
    return stats.select("chunk", "key", F.col("start_ts").alias("start"), F.col("end_ts").alias("end"), "rows")


def read_instants(spark: SparkSession, uri: str) -> DataFrame:
    """``file``, ``timestamp`` and ``rows`` of every frame of a lake; a frame that fills several files has a row in each."""
    return spark.read.schema(INSTANTS).parquet(f"{dataset_root(uri)}/manifest/instants")


def read_some(spark: SparkSession, uri: str, names: Iterable[str]) -> DataFrame:
    """Rows of the named files, with their ``chunk``; nothing else is opened or listed."""
    root = dataset_root(uri)
    head = read_manifest(spark, root).first()
    rows = _rows(spark, head["format"], *[f"{root}/data/{name}" for name in sorted(names)])
    found = rows.withColumn("chunk", _chunk(head["origin_us"], head["chunk_seconds"]))
    return found.select("timestamp", "objid", "x", "y", "z", "chunk")


def read_lake(
    spark: SparkSession,
    uri: str,
    *,
    start: datetime.datetime | None = None,
    end: datetime.datetime | None = None,
) -> DataFrame:
    """Rows of a lake with their ``chunk``; a time range opens only the files it touches, and skips row groups in them."""
    files = read_files(spark, uri)
    if start is not None:
        files = files.where(F.col("last") >= instant(start))
    if end is not None:
        files = files.where(F.col("first") <= instant(end))
    rows = read_some(spark, uri, [z["file"] for z in files.select("file").collect()])
    if start is not None:
        rows = rows.where(F.col("timestamp") >= instant(start))
    if end is not None:
        rows = rows.where(F.col("timestamp") <= instant(end))
    return rows


def read_manifest_document(spark: SparkSession, uri: str) -> DataFrame:
    """The one-row manifest of a lake kept as single files."""
    return spark.read.schema(MANIFEST).json(f"{dataset_root(uri)}/{MANIFEST_DOCUMENT}", multiLine=True)


def read_chunk_files(spark: SparkSession, uri: str, fmt: str = "csv") -> DataFrame:
    """Rows of a lake kept as ``chunk_*`` files of one format, with ``seq``."""
    return read_trajectory(spark, f"{dataset_root(uri)}/chunk_*.{fmt}")


def _chunk_of_instants(chunks: DataFrame, instants: DataFrame) -> DataFrame:
    """``probe_ts`` and ``chunk`` for every distinct instant."""
    starts = chunks.select(F.col("start").alias("frame_ts"), "chunk")
    found = floor_times(starts.select("frame_ts"), instants, bucket_seconds=3600)
    return found.join(starts, "frame_ts").select("probe_ts", "chunk")


def chunk_for_time(chunks: DataFrame, probes: DataFrame, time: str = "probe") -> DataFrame:
    """Add ``chunk``: the one with the latest start not after the probe, else the first."""
    found = _chunk_of_instants(chunks, probes.select(F.col(time).alias("probe_ts")))
    return probes.join(found.withColumnRenamed("probe_ts", time), time)


def asof_lake(spark: SparkSession, uri: str, probes: DataFrame, time: str = "probe") -> DataFrame:
    """Every probe with the rows of its frame, from the files that hold wanted frames only.

    Probe instants shrink to distinct milliseconds and find their frame among the manifest's instants.
    These wanted instants (a table in the shared folder) choose the files; inside them their first and last
    one skip row groups, and a bit set of their hashes, of fixed size, drops rows as they are read, before the join
    deals anything out.
    """
    cut = probes.withColumn("_probe", trunc_ms(time))
    instants = read_instants(spark, uri).select(F.col("timestamp").alias("frame_ts"), "file")
    found = written(floor_times(instants.select("frame_ts"), cut.select(F.col("_probe").alias("probe_ts"))), "frames")
    wanted = found.select("frame_ts").distinct().withColumn("wanted", F.lit(True))
    # A row per file: how many of its frames are wanted, and from when to when.
    hit = F.col("wanted").isNotNull()
    zones = instants.join(wanted, "frame_ts", "left").groupBy("file").agg(
        F.count("*").alias("frames"), F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("frame_ts"))).alias("low"),
        F.max(F.when(hit, F.col("frame_ts"))).alias("high"),
    ).where("hits > 0").collect()
    rows = read_some(spark, uri, [z["file"] for z in zones]).withColumnRenamed("timestamp", "frame_ts")
    if zones:
        rows = rows.where(F.col("frame_ts").between(instant(min(z["low"] for z in zones)), instant(max(z["high"] for z in zones))))
    if sum(z["hits"] for z in zones) * SPARSE < sum(z["frames"] for z in zones):
        rows = only_wanted(rows, wanted, "frame_ts")
    return cut.join(found.withColumnRenamed("probe_ts", "_probe"), "_probe").join(rows, "frame_ts").drop("_probe")


#: Bits of the set of wanted instants, and those in one element of it.
WANTED_BITS, WORD_BITS = 20, 6
#: The set is made where less than one of so many frames in the opened files is wanted.
SPARSE = 4


def only_wanted(rows: DataFrame, wanted: DataFrame, time: str) -> DataFrame:
    """``rows`` without most of those whose instant is not wanted, by a hashed bit set of 128 KB at any size.

    The set is a scalar for the scan. It only saves work: the join that follows decides.
    """

    def slot(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << WANTED_BITS))

    bit = F.pmod("s", F.lit(1 << WORD_BITS)).cast("int")
    words = wanted.select(slot(time).alias("s")).groupBy(F.shiftright("s", WORD_BITS).alias("i")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("w")
    )
    row = [0] * (1 << (WANTED_BITS - WORD_BITS))
    for i, w in words.collect():
        row[i] = w
    table = rows.sparkSession.createDataFrame([(row,)], "bits array<bigint>").scalar()
    word = F.element_at(table, (F.shiftright(slot(time), WORD_BITS) + 1).cast("int"))
    at = F.pmod(slot(time), F.lit(1 << WORD_BITS)).cast("int")
    return rows.where(F.call_function("shiftright", word, at).bitwiseAND(F.lit(1)) == 1)


# ---- lakes as single files ------------------------------------------------------------------

#: Above these sizes a lake is not written as one document and single files: HDFS holds 1,048,576 files in a folder.
EXPORT_CHUNKS, EXPORT_OBJECTS, EXPORT_CHUNK_ROWS = 1_000_000, 1_000_000, 20_000_000
#: Rows of a task that writes single files, and files named at a time.
EXPORT_TASK_ROWS, EXPORT_RENAMES = 500_000, 16


def export_lake(spark: SparkSession, uri: str, target: str, fmt: str = "csv") -> str:
    """Write a lake as ``manifest.json`` and one ``chunk_*`` file per chunk, for tools that read that form.

    Such a form has one document and one file per chunk whatever the data, so it is refused above
    ``EXPORT_CHUNKS`` chunks, ``EXPORT_OBJECTS`` objects or ``EXPORT_CHUNK_ROWS`` rows in one chunk. The document is written last,
    under another name, and then renamed: readers see a whole lake or none. Returns the document's path.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format: {fmt}")
    root, target = dataset_root(uri), dataset_root(target)
    head = read_manifest(spark, root).first()
    parts = read_parts(spark, root)
    if head["chunks"] > EXPORT_CHUNKS or head["objects"] > EXPORT_OBJECTS:
        raise ValueError(f"too large for one document: {head['chunks']} chunks, {head['objects']} objects")
    chunks = stats_of_parts(parts, fmt).orderBy("chunk").select(
        "chunk", "key", format_ts("start_ts").alias("start"), format_ts("end_ts").alias("end"), "rows"
    ).collect()
    if any(c["rows"] > EXPORT_CHUNK_ROWS for c in chunks):
        raise ValueError(f"a chunk has more than {EXPORT_CHUNK_ROWS} rows")
    rows = read_lake(spark, root)
    if fmt == "csv":
        rows = rows.withColumn("timestamp", format_ts("timestamp"))
    parting = f"{target}/_chunks"
    # A chunk is in one task and so in one file; tasks go with the rows, not with the chunks.
    tasks = max(1, min(len(chunks), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(head["rows"] or 0) // EXPORT_TASK_ROWS))))
    single = rows.repartition(tasks, "chunk").sortWithinPartitions("chunk", "timestamp", "objid").write.partitionBy("chunk")
    single.option("maxRecordsPerFile", 0).option("header", True).mode("overwrite").format(fmt).save(parting)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())

    def named(c: Row) -> None:
        (part,) = fs.globStatus(hadoop.Path(f"{parting}/chunk={c['chunk']}/part-*"))
        path = hadoop.Path(f"{target}/{c['key']}")
        if not fs.rename(part.getPath(), path):
            # There is one of an earlier export.
            fs.delete(path, False)
            fs.rename(part.getPath(), path)

    with ThreadPoolExecutor(EXPORT_RENAMES) as pool:
        list(pool.map(named, chunks))
    fs.delete(hadoop.Path(parting), True)
    document = {k: head[k] for k in ("version", "dataset", "hz", "chunk_seconds")} | {
        "format": fmt,
        "objids": sorted(r[0] for r in object_ids(parts).collect()),
        **{k: head[k] for k in ("start", "end", "rows")},
        "coord_min": [head[f"min_{a}"] for a in ("x", "y", "z")],
        "coord_max": [head[f"max_{a}"] for a in ("x", "y", "z")],
        "chunks": [{k: c[k] for k in ("key", "start", "end", "rows")} for c in chunks],
    }
    path, hidden = f"{target}/{MANIFEST_DOCUMENT}", f"{target}/.{MANIFEST_DOCUMENT}.{uuid.uuid4().hex}"
    out = fs.create(hadoop.Path(hidden), True)
    out.write(bytearray(json.dumps(document, ensure_ascii=False, indent=2).encode()))
    out.close()
    fs.delete(hadoop.Path(path), False)
    fs.rename(hadoop.Path(hidden), hadoop.Path(path))
    return path
