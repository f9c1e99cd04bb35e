"""Analytics over the decision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import at_ranks


def where_log(decision: str | None = None, modality: str | None = None, user: str | None = None, search: str | None = None, since: float | None = None, until: float | None = None, columns=("request_id", "user_id", "preview")) -> Column:
    """One predicate for page, counts and export: equality without case, LIKE over columns, half-open time range."""
    cond = F.lit(True)
    if decision:
        cond &= F.lower("decision") == decision.lower()
    if modality:
        cond &= F.lower(F.coalesce("modality", F.lit("text"))) == modality.lower()
    if user:
        cond &= F.col("user_id").cast("string") == user
    if search:
        any_ = F.lit(False)
        for c in columns:
            any_ |= F.coalesce(F.col(c).cast("string").ilike(f"%{search}%"), F.lit(False))
        cond &= any_
    if since is not None:
        cond &= F.col("created_at") >= since
    if until is not None:
        cond &= F.col("created_at") < until
    return cond


def kpis(log: DataFrame) -> DataFrame:
    """Counts by modality and decision, and the share of rejects among known decisions (null if there are none)."""
    n = lambda d: F.count_if(F.lower("decision") == d)
    out = log.groupBy(F.coalesce("modality", F.lit("text")).alias("modality")).agg(F.count("*").alias("total"), n("allow").alias("allowed"), n("revise").alias("revised"), n("reject").alias("rejected"))
    return out.withColumn("reject_rate", F.round(F.try_divide("rejected", F.col("allowed") + F.col("revised") + F.col("rejected")), 4))


def repeat_offenders(log: DataFrame, least: int, rate: float) -> DataFrame:
    """Users with at least ``least`` rejects that are at least ``rate`` of all their rows."""
    out = log.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.lower("decision") == "reject").alias("rejected"), F.max("created_at").alias("last_seen"))
    return out.withColumn("rate", F.round(F.col("rejected") / F.col("total"), 4)).where((F.col("rejected") >= least) & (F.col("rejected") / F.col("total") >= rate))


def rank_value(values: Column, q: float) -> Column:
    """Of sorted values the one at min(n - 1, int(q n))."""
    n = F.size(values)
    return F.element_at(F.sort_array(values), (F.least(n - 1, F.floor(n * q)) + 1).cast("int"))


def health(log: DataFrame) -> DataFrame:
    """Per modality: rows, rejects, mean and 95th-place latency. The place is found by rank, not by gathering a group."""
    kind = F.coalesce("modality", F.lit("text"))
    base = log.select(kind.alias("modality"), "decision", "latency_ms")
    place = at_ranks(base, "modality", "latency_ms", {"p95_ms": lambda n: F.least(n - 1, F.floor(n * 0.95))}).drop("n")
    agg = base.groupBy("modality").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "reject").alias("rejected"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"))
    return agg.join(place, "modality", "left")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins."""
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
