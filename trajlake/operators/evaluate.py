"""Predicted object sets against truth: verdicts, precision, recall, F1, averages, reports.

Three tables take part. ``truth`` has ``gt_id``, ``clock`` and ``objects``: one truth set per
``gt_id``, usually per video. ``files`` has ``source_file`` and the ``gt_id`` it is held against;
it also names files without any prediction. ``pred`` has ``source_file``, ``clock`` and
``objects``, distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions.answers import object_set


def ground_truth(lines: DataFrame, line_no: str = "line_no", text: str = "value", gt_id: str = "gt_id") -> DataFrame:
    """Truth from lines ``HH:MM:SS a,b``; shorter lines are skipped, a repeated clock's last line wins."""
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    rows = lines.withColumn("_parts", parts).where(F.size("_parts") >= 2)
    ids = F.transform(F.split(F.col("_parts")[1], ","), lambda s: F.trim(s).cast("int"))
    return (
        rows.select(
            F.col(gt_id).alias("gt_id"),
            F.col("_parts")[0].alias("clock"),
            F.col(line_no).alias("_line"),
            object_set(ids).alias("objects"),
        )
        .groupBy("gt_id", "clock")
        .agg(F.max_by("objects", "_line").alias("objects"))
    )


def verdicts(truth: DataFrame, pred: DataFrame, files: DataFrame) -> DataFrame:
    """Each predicted set as ``correct``, ``incorrect`` or ``extra``."""
    joined = pred.join(files, "source_file").join(
        truth.withColumnRenamed("objects", "truth"), ["gt_id", "clock"], "left"
    )
    verdict = (
        F.when(F.col("truth").isNull(), "extra")
        .when(F.col("truth") == F.col("objects"), "correct")
        .otherwise("incorrect")
    )
    return joined.select(
        "source_file", "gt_id", "clock", "truth", F.col("objects").alias("predicted"), verdict.alias("verdict")
    )


def missing(truth: DataFrame, pred: DataFrame, files: DataFrame) -> DataFrame:
    """Truth clocks a file has no prediction for, each file held against its own truth set."""
    due = files.join(truth, "gt_id").select("source_file", "gt_id", "clock", F.col("objects").alias("truth"))
    return due.join(pred.select("source_file", "clock").distinct(), ["source_file", "clock"], "left_anti")


def details(truth: DataFrame, pred: DataFrame, files: DataFrame) -> DataFrame:
    """Verdicts of all predicted sets and the missing clocks, in one table."""
    absent = (
        missing(truth, pred, files)
        .withColumn("predicted", F.lit(None).cast("array<int>"))
        .withColumn("verdict", F.lit("missing"))
    )
    return verdicts(truth, pred, files).unionByName(absent)


def metrics(truth: DataFrame, pred: DataFrame, files: DataFrame) -> DataFrame:
    """Counts, precision, recall and F1 per file; a set counts only if it matches exactly.

    Missing clocks are counted, never listed: the clocks of the truth set less those the file
    predicts anything for. So truth is not repeated per file.
    """
    # First per file and clock, merged on the map side, so that a file with most of the rows
    # is counted in many tasks.
    per_clock = verdicts(truth, pred, files).groupBy("source_file", "clock").agg(
        F.count_if(F.col("verdict") == "correct").alias("_tp"),
        F.count_if(F.col("verdict") != "correct").alias("_fp"),
        F.max(F.col("truth").isNotNull()).cast("int").alias("_met"),
    )
    per_file = per_clock.groupBy("source_file").agg(
        F.sum("_tp").alias("_tp"), F.sum("_fp").alias("_fp"), F.sum("_met").alias("_met")
    )
    clocks = truth.groupBy("gt_id").agg(F.count("*").alias("_clocks"))

    def number(name: str):
        return F.coalesce(name, F.lit(0)).cast("bigint")

    counts = (
        files.join(clocks, "gt_id", "left")
        .join(per_file, "source_file", "left")
        .select(
            "source_file",
            number("_tp").alias("tp"),
            number("_fp").alias("fp"),
            (number("_clocks") - number("_met")).alias("fn"),
        )
    )
    return with_scores(counts)


def with_scores(counts: DataFrame) -> DataFrame:
    """Add precision, recall and F1 to counts; 0 where a denominator is 0."""

    def share(part, whole):
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    scored = counts.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", share(F.col("tp"), F.col("tp") + F.col("fn"))
    )
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1_score", share(F.lit(2.0) * F.col("precision") * F.col("recall"), both))


def extra_clocks(truth: DataFrame, pred: DataFrame, files: DataFrame) -> DataFrame:
    """Predicted clocks that the file's truth set does not know."""
    predicted = pred.select("source_file", "clock").distinct().join(files, "source_file")
    return predicted.join(truth, ["gt_id", "clock"], "left_anti").select("source_file", "clock")


def all_clocks(truth: DataFrame, pred: DataFrame) -> DataFrame:
    return truth.select("clock").union(pred.select("clock")).distinct()


SCORES = ("precision", "recall", "f1_score")


def report(truth: DataFrame, pred: DataFrame, files: DataFrame) -> DataFrame:
    """A report as lines: per file one of kind ``metrics``, rounded, and one for each detail.

    A detail's kind is its verdict; a file's lines are as many as it has details, at every size.
    """
    rounded = F.struct(*[F.round(c, 2).alias(c) for c in SCORES])
    nothing = F.lit(None)
    heads = metrics(truth, pred, files).select(
        "source_file", F.lit("metrics").alias("kind"), rounded.alias("metrics"), nothing.cast("string").alias("clock"),
        nothing.cast("array<int>").alias("truth"), nothing.cast("array<int>").alias("predicted"),
    )
    lines = details(truth, pred, files).select(
        "source_file", F.col("verdict").alias("kind"), nothing.cast(heads.schema["metrics"].dataType).alias("metrics"), "clock", "truth", "predicted"
    )
    return heads.unionByName(lines)


def macro_average(scores: DataFrame) -> DataFrame:
    """Unweighted means over files."""
    return scores.agg(
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1_score")], F.count("*").alias("num_files")
    )


def average_report(scores: DataFrame) -> DataFrame:
    """The average with the figures of every file, a line each; ``source_file`` is null for the average."""
    names = list(SCORES)
    single = scores.select("source_file", *names, F.lit(1).cast("bigint").alias("num_files"))
    average = macro_average(scores).select(F.lit(None).cast("string").alias("source_file"), *names, "num_files")
    return single.unionByName(average)


def usable_metrics(files: DataFrame) -> DataFrame:
    """Metrics of the files that have all three figures."""
    names = ("precision", "recall", "f1_score")
    cols = [F.col(f"metrics.{n}").alias(n) for n in names]
    whole = files.where(" AND ".join(f"metrics.{n} IS NOT NULL" for n in names))
    return whole.select("source_file", *cols)


def unusable_metrics(files: DataFrame) -> DataFrame:
    names = ("precision", "recall", "f1_score")
    return files.where("NOT (" + " AND ".join(f"coalesce(metrics.{n} IS NOT NULL, false)" for n in names) + ")")
