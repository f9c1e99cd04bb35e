"""Evaluation statistics over rows ``(y, p)``."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ranks import at_or_under, cell_of


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)


def binary(df: DataFrame, bar: float, *by: str) -> DataFrame:
    """Confusion counts and accuracy, precision, recall, F1; a ratio without a base is 0."""
    hit = F.col("p") >= bar
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"), F.count_if(~hit & (F.col("y") == 0)).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": _ratio(tp + tn, F.col("n")), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def calibration(df: DataFrame, bins: int, closed: str = "right") -> DataFrame:
    """Rows per bin. right: (lo, hi] with the first closed; left: [lo, hi) with the last closed; drop: (lo, hi], p = 0 left out."""
    p = F.col("p")
    if closed == "left":
        b = F.least(F.floor(p * bins), F.lit(bins - 1))
    else:
        b = F.greatest(F.ceil(p * bins) - 1, F.lit(0))
    rows = df.where(p > 0) if closed == "drop" else df
    return rows.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("mean_y"))


def ece(df: DataFrame, bins: int, closed: str) -> DataFrame:
    t = calibration(df, bins, closed)
    return t.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n"), 4).alias("ece"))


def auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve by rank sums over distinct scores, ties at half.

    Negatives under a score are those of lower cells, from one row for each cell, and those under it in its own.
    """
    by = df.groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).withColumn("cell", cell_of(F.col("p")))
    before = lambda w: F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lower = by.groupBy("cell").agg(F.sum("neg").alias("neg")).select("cell", before(Window.orderBy("cell")).alias("lower"))
    by = by.withColumn("within", before(Window.partitionBy("cell").orderBy("p"))).join(lower, "cell").withColumn("under", F.col("lower") + F.col("within"))
    return by.agg(F.round(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def average_precision(df: DataFrame) -> DataFrame:
    """The mean over positives of the precision at their score, ties taken together; null without positives.

    Counts from a score upwards are those of higher cells, from one row for each cell, and those in its own.
    """
    by = df.groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count("*").alias("n")).withColumn("cell", cell_of(F.col("p")))
    upto = lambda c, w, last: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, last)), F.lit(0))
    cells = by.groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    over = Window.orderBy(F.desc("cell"))
    cells = cells.select("cell", upto("pos", over, -1).alias("pos_over"), upto("n", over, -1).alias("n_over"))
    own = Window.partitionBy("cell").orderBy(F.desc("p"))
    by = by.withColumns({"pos_own": upto("pos", own, 0), "n_own": upto("n", own, 0)}).join(cells, "cell")
    precision = (F.col("pos_own") + F.col("pos_over")) / (F.col("n_own") + F.col("n_over"))
    return by.agg(F.round(F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")), 6).alias("average_precision"))


def sweep(df: DataFrame, grid: list[float]) -> DataFrame:
    """Per threshold: share of rows under it and positives under it. Each row goes to one cell of the grid; the
    thresholds add up cells, so nothing is multiplied by the grid."""
    place = at_or_under(F.col("p"), grid)
    cells = df.groupBy(place.alias("at")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    spark = df.sparkSession
    ts = spark.createDataFrame([(i, float(g)) for i, g in enumerate(grid)], "k int, threshold double")
    out = ts.join(cells, F.col("at") <= F.col("k"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("skipped"), F.coalesce(F.sum("pos"), F.lit(0)).alias("missed"))
    return out


@F.pandas_udf(DoubleType())
def mcnemar(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided p-value from the two discordant counts."""
    def one(b: int, c: int) -> float:
        n, k = b + c, min(b, c)
        return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)

    return pd.Series([round(one(int(x), int(y)), 6) for x, y in zip(b, c)], dtype=float)
