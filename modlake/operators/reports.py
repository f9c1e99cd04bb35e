"""Reports over scored rows and decisions: thresholds, places, agreement, leaks, relabelling and rate limits."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ranks import at_or_under, at_ranks


def _share(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(empty)), 6)


def places(df: DataFrame, by: str, value: str, percents: list[int]) -> DataFrame:
    """Per group the value at the rounded rank (half to even) of each percent; nulls do not count."""
    return at_ranks(df, by, value, {f"p{p}": lambda n, p=p: F.bround(F.lit(p / 100) * (n - 1)) for p in percents})


def grid_by(df: DataFrame, by: str, grid: list[float]) -> DataFrame:
    """Per group and threshold: recall of y = 1 and share of y = 0 at or over it. A row adds to one cell of the grid."""
    at = at_or_under(F.col("p"), grid)
    cells = df.groupBy(by, at.alias("at")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    steps = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(float(g)).alias("threshold")) for i, g in enumerate(grid)])).alias("s")
    over = cells.select("*", steps)
    hit = F.col("at") >= F.col("s.k")
    out = over.groupBy(by, F.col("s.threshold").alias("threshold")).agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("a"), F.sum("pos").alias("p"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("b"), F.sum("neg").alias("q"))
    return out.select(by, "threshold", _share(F.col("a"), F.col("p")).alias("recall"), _share(F.col("b"), F.col("q")).alias("fpr"))


def best_threshold(swept: DataFrame, worst_fpr: float) -> DataFrame:
    """Of thresholds whose worst false-positive share over all sets is small enough, the one of the best least recall; the lowest of ties."""
    per = swept.groupBy("threshold").agg(F.min("recall").alias("recall"), F.max("fpr").alias("fpr"))
    return per.where(F.col("fpr") <= worst_fpr).agg(F.max_by("threshold", F.struct("recall", -F.col("threshold"))).alias("threshold"), F.max("recall").alias("recall"))


def agreement(df: DataFrame, bar: float, other: Column, by: str) -> DataFrame:
    """Two by two with a reference scorer."""
    a = F.col("p") >= bar
    return df.groupBy(by).agg(F.count_if(a & other).alias("both"), F.count_if(a & ~other).alias("ours"), F.count_if(~a & other).alias("theirs"), F.count_if(~a & ~other).alias("neither"))


def head_metrics(df: DataFrame, mask: Column) -> DataFrame:
    """n, accuracy, recall, false-positive rate and log loss of the rows that carry this head's label."""
    hit, pos, q = F.col("p") >= 0.5, F.col("y") == 1, F.least(F.greatest("p", F.lit(1e-7)), F.lit(1 - 1e-7))
    out = df.where(mask).agg(F.count("*").alias("n"), F.count_if(hit == pos).alias("ok"), F.count_if(hit & pos).alias("tp"), F.count_if(pos).alias("pos"), F.count_if(hit & ~pos).alias("fp"), F.avg(F.when(pos, -F.log(q)).otherwise(-F.log(1 - q))).alias("loss"))
    return out.select("n", _share(F.col("ok"), F.col("n")).alias("accuracy"), _share(F.col("tp"), F.col("pos")).alias("recall"), _share(F.col("fp"), F.col("n") - F.col("pos")).alias("fpr"), F.round("loss", 6).alias("log_loss"))


def moved(df: DataFrame, base: Column, candidate: Column) -> DataFrame:
    """Changed decisions (numbers, higher is harder) and those that went the harmful way: harmful rows made softer, safe ones harder."""
    worse = ((F.col("y") == 1) & (candidate < base)) | ((F.col("y") == 0) & (candidate > base))
    return df.agg(F.count_if(base != candidate).alias("moved"), F.count_if(worse).alias("harmful"))


def label_conflicts(df: DataFrame, key: Column, label: str) -> DataFrame:
    """Per key its label if all rows agree on one, and whether they do not; rows without a label say nothing."""
    out = df.groupBy(key.alias("key")).agg(F.min(label).alias("a"), F.max(label).alias("b"))
    return out.select("key", F.when(F.col("a") == F.col("b"), F.col("a")).alias("label"), F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("conflict"))


def strictest_split(df: DataFrame, key: Column, split: str) -> DataFrame:
    """Every row of a key goes to the strictest split that any has: test over val over train. Adds ``key`` and ``strict``."""
    rank = F.when(F.col(split) == "test", 2).when(F.col(split) == "val", 1).otherwise(0)
    keyed = df.withColumn("key", key)
    top = keyed.groupBy(F.col("key").alias("_k")).agg(F.max(rank).alias("r"))
    strict = F.when(F.col("r") == 2, "test").when(F.col("r") == 1, "val").otherwise("train")
    return keyed.join(top, F.col("key").eqNullSafe(F.col("_k"))).drop("_k").withColumn("strict", strict).drop("r")


def refusal_report(df: DataFrame, by: str, refused: Column, cause: Column, example: str, most: int = 5) -> DataFrame:
    """Per category: rows, refused ones, their share, counts by cause and the first examples by order."""
    base = df.select(F.col(by), refused.alias("refused"), cause.alias("cause"), F.col(example).alias("example"))
    head = base.groupBy(by).agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"))
    causes = base.where("refused").groupBy(by, "cause").agg(F.count("*").alias("c")).groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cause", "c")))).alias("by_cause"))
    r = F.row_number().over(Window.partitionBy(by).orderBy("example"))
    first = base.where("refused").withColumn("r", r).where(F.col("r") <= most).groupBy(by).agg(F.sort_array(F.collect_list("example")).alias("examples"))
    return head.withColumn("pct", _share(F.lit(100.0) * F.col("refused"), F.col("n"))).join(causes, by, "left").join(first, by, "left")


def leak_premium(df: DataFrame, correct: Column, leaked: Column, by: str) -> DataFrame:
    """Accuracy of leaked and of clean rows per file (null without rows), and the difference in points."""
    out = df.groupBy(by).agg(F.count_if(leaked).alias("n_leaked"), F.count_if(~leaked).alias("n_clean"), F.avg(F.when(leaked, correct.cast("int"))).alias("a"), F.avg(F.when(~leaked, correct.cast("int"))).alias("b"))
    return out.select(by, "n_leaked", "n_clean", F.round("a", 6).alias("leaked"), F.round("b", 6).alias("clean"), F.round((F.col("a") - F.col("b")) * 100, 4).alias("premium"))


def set_scores(df: DataFrame, decision: str, by: str) -> DataFrame:
    """Per set: share of safe rows that pass and of harmful rows that do not; an empty side counts as 1."""
    safe, ok = F.col("y") == 0, F.col(decision) == "allow"
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(safe).alias("s"), F.count_if(safe & ok).alias("a"), F.count_if(~safe & ~ok).alias("c"))
    return out.select(by, "n", _share(F.col("a"), F.col("s"), 1.0).alias("allowed"), _share(F.col("c"), F.col("n") - F.col("s"), 1.0).alias("caught"), _share(F.col("a") + F.col("c"), F.col("n"), 1.0).alias("accuracy"))


def weak(df: DataFrame, floor: float) -> DataFrame:
    """Categories of which less than ``floor`` is caught."""
    return df.where(F.col("caught") < floor)


@F.pandas_udf(DoubleType())
def sigma_level(rate: pd.Series) -> pd.Series:
    """Long-term yield as a normal quantile with the usual shift of 1.5, held to 0..6; null stays null."""
    def one(r: float) -> float | None:
        if pd.isna(r):
            return None
        if r <= 1e-12 or r >= 1 - 1e-12:
            return 6.0 if r <= 1e-12 else 0.0
        return round(min(6.0, max(0.0, NormalDist().inv_cdf(1 - r) + 1.5)), 6)

    return pd.Series([one(r) for r in rate], dtype=float)


def in_share(key: Column, share: float) -> Column:
    """The same rows at every run and partitioning: a hash of the key under the share."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") < share * 2**32


def rehearsal(df: DataFrame, key: Column, shares: dict[str, float], by: Column, split: Column) -> DataFrame:
    """Train rows by their class's share; validation rows whole; a class without a share stays whole."""
    keep = F.lit(True)
    for name, share in shares.items():
        keep = F.when(by == name, in_share(key, share)).otherwise(keep)
    return df.where((split != "train") | keep)


def _waits(times: np.ndarray, admitted: list[float], limit: int, window: float) -> np.ndarray:
    """Waits of one key's rows in order of time; ``admitted`` has its last admitted times and is carried on.

    A row is refused while the limit-th last admitted time is within the window, and so are all that follow until it
    no longer is: such a run is found by search and filled at once.
    """
    out, i = np.zeros(len(times), np.int64), 0
    while i < len(times):
        if len(admitted) < limit or times[i] - admitted[-limit] > window:
            admitted.append(times[i])
            i += 1
            continue
        since = times[i : int(np.searchsorted(times, admitted[-limit] + window, "right")) + 1] - admitted[-limit]
        since = since[since <= window]
        out[i : i + len(since)] = (window - since).astype(np.int64) + 1
        i += len(since)
    del admitted[:-limit]
    return out


def rate_limited(df: DataFrame, key: str, at: str, tie: str, limit: int, window: float) -> DataFrame:
    """Adds ``wait``: 0 for an admitted row, else the seconds until the key is admitted again. Only admitted rows count.
    Rows of a key are read in order of time as a stream; the state is at most ``limit`` times for the key at hand.
    Null keys form one key; rows without a time are left out."""
    rows = df.where(F.col(at).isNotNull()).repartition(F.col(key)).sortWithinPartitions(key, at, tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, admitted = object(), []
        for b in batches:
            codes, times, waits = pd.factorize(b[key], use_na_sentinel=False)[0], b[at].to_numpy(float), []
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(b)]
            for start, end in zip(edges, edges[1:] if len(b) else []):
                own = None if pd.isna(b[key].iloc[start]) else b[key].iloc[start]
                if own != now:
                    now, admitted = own, []
                waits.append(_waits(times[start:end], admitted, limit, window))
            yield b.assign(wait=np.concatenate(waits) if waits else np.empty(0, np.int64))

    from pyspark.sql.types import LongType, StructType

    return rows.mapInPandas(run, StructType([*rows.schema.fields]).add("wait", LongType()))


def limits_plainly(rows: list[tuple], limit: int, window: float) -> list[int]:
    """The same over a small list of (key, time) in order; for tests."""
    admitted, out = defaultdict(list), []
    for k, t in rows:
        live = [x for x in admitted[k] if t - x <= window]
        out.append(int(window - (t - live[0])) + 1 if len(live) >= limit else 0)
        admitted[k] = live + ([t] if len(live) < limit else [])
    return out


def triggers(df: DataFrame, key: str, at: str, gain: Column, least: float, most: int) -> DataFrame:
    """Words whose removal lowers the risk enough; of each text the strongest, first of ties by place."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("gain"), at))
    return df.withColumn("gain", gain).where(F.col("gain") >= least).withColumn("r", r).where(F.col("r") <= most).drop("r")
