"""Statistics of runs: means, spread, errors, percentiles by index, ratio of means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.session import written


def run_stats(runs: DataFrame, label: str = "label", values: tuple[str, ...] = ("wall_clock_s",)) -> DataFrame:
    """Per label: all runs, successful ones, failures, and means and population deviations of
    the successful ones. One successful run has deviation 0, none has null."""
    good = F.col("success")
    figures = []
    for v in values:
        figures += [
            F.avg(F.when(good, F.col(v))).alias(f"{v}_mean"),
            F.stddev_pop(F.when(good, F.col(v))).alias(f"{v}_std"),
        ]
    return runs.groupBy(label).agg(
        F.count("*").alias("runs_total"),
        F.count_if(good).alias("runs_success"),
        F.count_if(~good).alias("errors"),
        *figures,
    )


def run_errors(runs: DataFrame, label: str = "label") -> DataFrame:
    """Errors of the failed runs, one row each."""
    return runs.where(~F.col("success")).select(label, "error")


@F.pandas_udf(T.LongType())
def order_number(values: pd.Series) -> pd.Series:
    """Whole numbers in the order of the doubles, made of their bits; NaN comes last, -0.0 is 0.0."""
    x = values.to_numpy(dtype=np.float64) + 0.0
    bits = np.where(np.isnan(x), np.float64("nan"), x).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(T.DoubleType())
def ordered_value(numbers: pd.Series) -> pd.Series:
    """The doubles that ``order_number`` numbered."""
    n = numbers.to_numpy(dtype=np.int64)
    return pd.Series(np.where(n < 0, n ^ np.int64(0x7FFFFFFFFFFFFFFF), n).view(np.float64))


def percentile_index(rows: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """Per group the sorted value at index ``min(n - 1, int(q * n))``, exactly; nulls do not count.

    No group is sorted. Values are read as whole numbers in the same order, and four rounds count them by
    16 bits each: at most 65,536 counts per group and round, however the values are spread. NaN is
    greater than any number.
    """
    data = rows.where(F.col(value).isNotNull()).select(group, order_number(F.col(value).cast("double")).alias("_k"))
    data = written(data, "ordered")
    sizes = data.groupBy(group).agg(F.count("*").alias("_n"))
    index = F.least(F.col("_n") - 1, F.floor(F.lit(float(q)) * F.col("_n")).cast("bigint"))
    state = sizes.select(group, index.alias("_skip"), F.lit(0).cast("bigint").alias("_prefix"))
    running = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    for shift in (48, 32, 16, 0):
        inside = data.join(state, group)
        if shift < 48:
            inside = inside.where(F.call_function("shiftright", F.col("_k"), F.lit(shift + 16)) == F.col("_prefix"))
        bins = inside.groupBy(group, F.call_function("shiftright", F.col("_k"), F.lit(shift)).alias("_bin")).agg(
            F.count("*").alias("_n"), F.min("_skip").alias("_skip")
        )
        upto = bins.withColumn("_upto", F.sum("_n").over(running))
        held = upto.where((F.col("_upto") > F.col("_skip")) & (F.col("_upto") - F.col("_n") <= F.col("_skip")))
        left = (F.col("_skip") - (F.col("_upto") - F.col("_n"))).alias("_skip")
        state = written(held.select(group, left, F.col("_bin").alias("_prefix")), "bins")
    return state.select(group, ordered_value("_prefix").alias("percentile"))


def speedup(runs: DataFrame, slow: str, fast: str, label: str = "label", value: str = "wall_clock_s") -> DataFrame:
    """Mean of the successful slow runs over the mean of the successful fast ones."""
    good = F.col("success")

    def mean(name: str):
        return F.avg(F.when(good & (F.col(label) == name), F.col(value)))

    return runs.agg(F.try_divide(mean(slow), mean(fast)).alias("speedup"))
