"""Exact ranks of large groups: counts by cells of the value first, then only the cells that are asked for in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 512  # for each power of two


def at_or_under(value: Column, grid: list[float]) -> Column:
    """How many numbers of a grid are at or under a value; the value is asked for once, not for each number; a null counts none."""
    return F.aggregate(F.transform(F.array(value), lambda v: F.size(F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: g <= v))), F.lit(0), lambda a, n: a + n)


def _steps(size: Column) -> Column:
    """A number that rises with a size above 0, CELLS steps for each power of two."""
    held = F.least(size, F.lit(1.7e308))
    power = F.floor(F.log2(held))
    return F.floor((held / F.pow(F.lit(2.0), power) + power) * CELLS)


def cell_of(value: Column) -> Column:
    """A whole number that never falls as the value rises; some 2 million of them at most, whatever the input.

    Cells keep the relative precision of values near 0 and of large ones, and of what probabilities near 1 lack of 1.
    """
    v = value.cast("double")
    below, above, last = -1100 * CELLS, 60 * CELLS, 2000 * CELLS
    return (
        F.when(F.isnan(v), last).when(v == 0, below).when(v < 0, -2200 * CELLS - _steps(-v)).when(v <= 0.5, _steps(v)).when(v < 1, -_steps(1 - v)).otherwise(above + _steps(v))
    ).cast("long")


def at_ranks(df: DataFrame, by: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``by, n`` and for each name the value at its rank (from 0, a function of n) in the group's order of values.

    Nulls do not count; a group of nulls only has no row; a null group is one of its own; an empty table gives no
    rows. No group is sorted whole: its counts by cell say which cell holds a rank, and only the rows of such cells
    are put in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).alias("_v"), cell_of(F.col(value)).alias("_cell"))
    whole = Window.partitionBy("_by")
    cells = rows.groupBy("_by", "_cell").agg(F.count("*").alias("_c"))
    cells = cells.withColumns({"_upto": F.sum("_c").over(whole.orderBy("_cell")), "n": F.sum("_c").over(whole)})
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("at")) for name, rank in ranks.items()]))
    asked = cells.withColumn("_a", asked).where((F.col("_a.at") < F.col("_upto")) & (F.col("_a.at") >= F.col("_upto") - F.col("_c")))
    asked = asked.select(F.col("_by").alias("_g"), F.col("_cell").alias("_k"), "n", "_a.name", (F.col("_a.at") - F.col("_upto") + F.col("_c")).alias("_at"))
    here = F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_cell") == F.col("_k"))
    few = rows.join(asked, here, "left_semi").groupBy("_by", "_cell", "_v").agg(F.count("*").alias("_c"))
    few = few.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_by", "_cell").orderBy("_v")))
    found = few.join(asked, here).where("_upto > _at").groupBy("_g", "n", "name").agg(F.min("_v").alias("_v"))
    return found.groupBy(F.col("_g").alias(by), "n").agg(*[F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])
