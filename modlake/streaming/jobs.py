"""Structured Streaming forms: windowed health, offenders, deduplicated intake, stream-static blocklist, decision mix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intake(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each request once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])


def hourly_health(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    return rows.groupBy(F.window("ts", "1 hour"), F.coalesce("modality", F.lit("text")).alias("modality")).agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "reject").alias("rejected"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"))


def sliding_offenders(log: DataFrame, least: int, late: str = "1 hour") -> DataFrame:
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    return rows.groupBy(F.window("ts", "24 hours", "1 hour"), "user_id").agg(F.count("*").alias("total"), F.count_if(F.col("decision") == "reject").alias("rejected")).where(F.col("rejected") >= least)


def not_blocked(stream: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Stream-static anti-join on the member's id."""
    return stream.join(blocklist.where("scope = 'member'").select(F.col("value").cast("long").alias("user_id")), "user_id", "left_anti")


def decision_mix(log: DataFrame) -> DataFrame:
    """Daily share of rejects with three-sigma limits around the mean of all days."""
    day = log.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "reject").alias("rejected"))
    mean = day.agg((F.sum("rejected") / F.sum("n")).alias("p"))
    sigma = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return day.join(F.broadcast(mean)).select("day", "n", "rejected", F.round(F.col("rejected") / F.col("n"), 6).alias("share"), F.round(F.greatest(F.lit(0.0), F.col("p") - 3 * sigma), 6).alias("low"), F.round(F.col("p") + 3 * sigma, 6).alias("high"))
