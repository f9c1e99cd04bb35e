"""Scored spans: which reject, which are shown, the riskiest window of each, and how they fall into form fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rejecting(spans: DataFrame, reject_min: float, floor: float) -> DataFrame:
    """Spans that refuse by themselves: not cleared before, over the bar, and over the floor if they are hardly sentences."""
    return spans.where(~F.col("prefilter") & (F.col("risk") >= reject_min) & (~F.col("low_syntax") | (F.col("risk") >= floor)))


def shown(spans: DataFrame, allow_max: float, most: int, rejected: Column) -> DataFrame:
    """Of the first ``most`` sentences ``(doc_id, k, risk)`` those over the bar; if none is and the text was not refused,
    the riskiest one, the first among equals."""
    head = spans.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))).where(F.col("r") <= most)
    over = F.col("risk") > allow_max
    head = head.withColumn("some", F.max(over).over(Window.partitionBy("doc_id"))).withColumn("best", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("risk"), "k")))
    return head.where(over | (~F.col("some") & ~rejected & (F.col("best") == 1))).drop("r", "some", "best")


def riskiest(windows: DataFrame) -> DataFrame:
    """Per span the window of most risk, the first among equals."""
    return windows.groupBy("doc_id", "span").agg(F.max(F.struct("risk", (-F.col("k")).alias("k"))).alias("m")).select("doc_id", "span", (-F.col("m.k")).alias("k"), F.col("m.risk").alias("risk"))


def not_touching(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Spans ``(doc_id, start, end)`` that no other span of their document overlaps."""
    o = others.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(o, (F.col("doc_id") == F.col("_d")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")


def in_fields(spans: DataFrame, fields: DataFrame) -> DataFrame:
    """Spans of a joined text cut at the fields ``(doc_id, field, from, to)`` they lie in, as offsets into each field."""
    both = spans.join(fields, "doc_id").where((F.col("start") < F.col("to")) & (F.col("from") < F.col("end")))
    return both.select("doc_id", "field", (F.greatest("start", "from") - F.col("from")).alias("start"), (F.least("end", "to") - F.col("from")).alias("end"))


def in_order(issues: Column) -> Column:
    """Issues by start, then end."""
    return F.array_sort(issues, lambda a, b: F.when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1)).when(a.end < b.end, -1).when(a.end > b.end, 1).otherwise(0))


def without(words: Column, drop: Column) -> Column:
    """Words without those at the given places (from 0), joined by single blanks."""
    return F.array_join(F.filter(words, lambda w, i: ~F.array_contains(drop, i)), " ")
