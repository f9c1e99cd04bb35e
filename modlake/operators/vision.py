"""Picture policy over embeddings: prompts, exemplars and the ordered verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def prompt_scores(images: DataFrame, prompts: list[tuple[str, list[float]]]) -> DataFrame:
    """``vec_id, label, score``: the best prompt of each label. Prompts are a fixed, short policy, held in the plan."""
    cols = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*[F.lit(float(x)) for x in v]).alias("v")) for label, v in prompts])
    rows = images.select("vec_id", F.explode(F.transform(cols, lambda p: F.struct(p.label.alias("label"), dot(F.col("u"), p.v).alias("s")))).alias("p"))
    return rows.groupBy("vec_id", F.col("p.label").alias("label")).agg(F.round(F.max("p.s"), 6).alias("score"))


def verdict(scores: DataFrame, bars: dict[str, float], temperature: float = 0.05) -> DataFrame:
    """Softmax over labels; the strongest label over its own bar, else the top label, and whether it refuses."""
    bar = F.create_map(*[x for k, v in bars.items() for x in (F.lit(k), F.lit(v))])
    e = scores.groupBy("vec_id").agg(F.collect_list(F.struct("score", "label")).alias("s"), F.max("score").alias("m"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp((x.score - F.col("m")) / temperature))
    p = F.transform("s", lambda x: F.struct(F.round(F.exp((x.score - F.col("m")) / temperature) / total, 6).alias("p"), x.label.alias("label")))
    e = e.withColumn("p", F.sort_array(p, asc=False))
    over = F.filter("p", lambda x: x.p >= F.coalesce(bar[x.label], F.lit(2.0)))
    pick = F.coalesce(F.try_element_at(over, F.lit(1)), F.element_at("p", 1))
    return e.select("vec_id", pick.label.alias("label"), pick.p.alias("p"), (F.size(over) > 0).alias("refused"))
