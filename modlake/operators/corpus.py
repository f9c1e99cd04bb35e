"""Corpus preparation: keys, splits, leakage guards, caps, first-wins dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_of(group: Column, val: float, test: float) -> Column:
    """A group's split from the first 8 hex digits of its MD5: test, then val, then train."""
    u = F.conv(F.substring(F.md5(group), 1, 8), 16, 10).cast("double") / 4294967295.0
    return F.when(u < test, "test").when(u < test + val, "val").otherwise("train")


def first_wins(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def without_leaks(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    return train.join(held_out.select(key).distinct(), key, "left_anti")


def one_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows whose key has a single label."""
    both = df.groupBy(key).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a <> _b").select(key)
    return df.join(both, key, "left_anti")


def capped(df: DataFrame, group: str, cap: int, *order) -> DataFrame:
    """At most ``cap`` rows of each group, chosen by a fixed order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")


def most_of(df: DataFrame, key: str, value: str, priority: str) -> DataFrame:
    """key -> value, later sources winning."""
    return df.groupBy(key).agg(F.max_by(value, priority).alias(value))
