"""Sinks: idempotent append, latest-wins upsert, dead letters, fan-out, fixed-width export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_new(df: DataFrame, path: str, key: str = "request_id") -> None:
    """Append rows whose key the table does not have: a second delivery changes nothing."""
    spark, rows = df.sparkSession, df.dropDuplicates([key])
    try:
        have = spark.read.parquet(path).select(key)
    except Exception as e:  # the table is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        rows = rows.join(have, key, "left_anti")
    rows.write.mode("append").parquet(path)


def fail_safe(write: Callable[[DataFrame], None], dead_letters: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch that cannot be stored goes to the dead-letter folder with the reason."""
    def run(df: DataFrame, batch: int) -> None:
        try:
            write(df)
        except Exception as e:
            df.withColumn("batch", F.lit(batch)).withColumn("reason", F.lit(str(e)[:500])).write.mode("append").parquet(dead_letters)

    return run


def fan_out(*writes: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: several sinks, each failing for itself; the last error is raised after all have been tried."""
    def run(df: DataFrame, batch: int) -> None:
        df.persist()
        failed = None
        for w in writes:
            try:
                w(df)
            except Exception as e:
                failed = e
        df.unpersist()
        if failed:
            raise failed

    return run


def fixed_width(df: DataFrame, columns: list[str], rows: int = 1000, widest: int = 40) -> str:
    """A text table of at most ``rows`` rows, for people to read."""
    got = df.select(*[F.substring(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "), 1, widest).alias(c) for c in columns]).limit(rows).collect()
    width = [max([len(c), *(len(r[c]) for r in got)]) for c in columns]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, width)).rstrip() for line in [columns, ["-" * w for w in width], *got])
