"""Blocked clients as a table ``(scope, value, reason, created_at)``: upserts, probes by priority, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Which scope decides if several block a caller, most telling first (fixed values).
SCOPES = ("member", "ip", "network")
SMALL = 200_000  # entries that are sent to all tasks at most: about 20 MB


def upserted(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """The list after ``changes``, which have ``blocked`` besides: the last word on a scope and value counts."""
    every = entries.withColumn("blocked", F.lit(True)).withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = Window.partitionBy("scope", "value").orderBy(F.desc("_new"), F.desc("created_at"), "reason")
    return every.withColumn("_r", F.row_number().over(last)).where("_r = 1 and blocked").drop("_r", "_new", "blocked")


def probed(calls: DataFrame, entries: DataFrame, member: str = "user_id", ip: str = "ip", network: str = "network") -> DataFrame:
    """``calls`` with ``blocked_scope`` and ``blocked_reason`` of the entry that decides, null if none fits.

    One equi-join per scope; the list is sent whole only if it is counted as small. Null callers fit nothing. An
    entry that is there twice counts once, with its smallest reason.
    """
    entries = entries.where(F.col("scope").isin(*SCOPES)).groupBy("scope", "value").agg(F.min(F.coalesce("reason", F.lit(""))).alias("reason"))
    small = entries.limit(SMALL + 1).count() <= SMALL
    out = calls
    for scope, column in zip(SCOPES, (member, ip, network)):
        own = entries.where(F.col("scope") == scope).select(F.col("value").alias(f"_{scope}"), F.col("reason").alias(f"_{scope}_reason"))
        out = out.join(F.broadcast(own) if small else own, F.col(column).cast("string") == F.col(f"_{scope}"), "left")
    scope = F.coalesce(*[F.when(F.col(f"_{s}").isNotNull(), F.lit(s)) for s in SCOPES])
    reason = F.coalesce(*[F.col(f"_{s}_reason") for s in SCOPES])
    return out.withColumns({"blocked_scope": scope, "blocked_reason": reason}).drop(*[c for s in SCOPES for c in (f"_{s}", f"_{s}_reason")])


def flagged(offenders: DataFrame, entries: DataFrame, member: str = "user_id") -> DataFrame:
    """Adds ``blocked``: whether the member is on the list already."""
    own = entries.where("scope = 'member'").select(F.col("value").alias("_m")).distinct()
    return offenders.join(own, F.col(member).cast("string") == F.col("_m"), "left").withColumn("blocked", F.col("_m").isNotNull()).drop("_m")
