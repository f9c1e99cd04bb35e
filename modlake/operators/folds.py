"""Evaluation out of fold: near copies stay together, each row is scored by the model that has not seen its group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Rounds


def near_copy_groups(spark: SparkSession, rows: DataFrame, keys: dict[str, Column], id: str = "doc_id") -> DataFrame:
    """``id, group``: the smallest id among all rows that a chain of equal keys connects; null keys connect nothing.

    Each round gives every key the smallest group of its rows, and every row the smallest of its keys. Both are grouped
    minima that tasks combine before the shuffle; rounds end when no row has changed. Ids are one row's.
    """
    rounds = Rounds(spark, "groups")
    told = F.explode(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f"{name}:"), F.sha2(c.cast("string"), 256))) for name, c in keys.items())))
    edges = rounds.write(rows.select(F.col(id).alias("id"), told.alias("key")).where("key is not null"))
    state = rounds.write(rows.select(F.col(id).alias("id"), F.col(id).alias("group")))
    while True:
        least = edges.join(state, "id").groupBy("key").agg(F.min("group").alias("group"))
        reached = edges.join(least, "key").groupBy("id").agg(F.min("group").alias("reached"))
        after = rounds.write(state.join(reached, "id", "left").select("id", F.least("group", "reached").alias("group"), (F.col("reached") < F.col("group")).alias("changed")))
        rounds.free(state)
        state = after
        if state.where("changed").isEmpty():
            break
    return state.select(F.col("id").alias(id), "group")


def fold_of(group: Column, folds: int) -> Column:
    """A fold from the first 8 hex digits of the group's MD5."""
    return (F.conv(F.substring(F.md5(group.cast("string")), 1, 8), 16, 10).cast("long") % folds).cast("int")


def _rows(b: pa.RecordBatch) -> np.ndarray:
    """Features with a one before them."""
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
    return np.hstack((np.ones((len(b), 1)), x))


def _summed(partial: DataFrame, width: int) -> dict:
    """Sums of lists by key, position by position; the driver gets one number for each."""
    each = partial.select("key", F.posexplode("v").alias("i", "v")).groupBy("key", "i").agg(F.sum("v").alias("v")).collect()
    out: dict = {}
    for r in each:
        out.setdefault(r["key"], np.zeros(width))[r["i"]] = r["v"]
    return out


def fit_folds(matrix: DataFrame, dim: int, classes: list, folds: int, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights ``[fold, class, 1 + dim]`` of one-against-the-rest logistic models, each without the rows of its fold.

    All models come from one written ``matrix(x, y, fold)``. Steps follow the curvature bound of the logistic loss, a
    quarter of the Gram matrix, which is summed once for each fold; a step is one pass for the gradients of all models.
    What leaves a task is as large as the models, whatever it has read.
    """
    width = dim + 1

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, width, width))
        for b in batches:
            if len(b):
                x, fold = _rows(b), b.column("fold").to_numpy()
                for k in np.unique(fold):
                    sums[k] += x[fold == k].T @ x[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array(range(folds), pa.int32()), pa.array([s.ravel() for s in sums], pa.list_(pa.float64()))], ["key", "v"])

    of = _summed(matrix.select("x", "fold").mapInArrow(grams, "key int, v array<double>"), width * width)
    own = np.stack([of.get(k, np.zeros(width * width)).reshape(width, width) for k in range(folds)])
    penalty = ridge * np.diag([0.0] + [1.0] * dim)
    curve = (own.sum(0) - own) / 4 + penalty + 1e-9 * np.eye(width)
    place = {c: i for i, c in enumerate(classes)}
    weights = np.zeros((folds, len(classes), width))
    for _ in range(steps):
        now = weights

        def gradients(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(now.shape)
            for b in batches:
                if not len(b):
                    continue
                x, fold = _rows(b), b.column("fold").to_numpy()
                y = np.zeros((len(b), len(place)))
                y[np.arange(len(b)), [place[c] for c in b.column("y").to_pylist()]] = 1.0
                for k in range(folds):
                    seen = fold != k
                    sums[k] += (y[seen] - 1 / (1 + np.exp(-np.clip(x[seen] @ now[k].T, -30, 30)))).T @ x[seen]
            yield pa.RecordBatch.from_arrays([pa.array(range(sums.shape[0] * sums.shape[1]), pa.int32()), pa.array(list(sums.reshape(-1, width)), pa.list_(pa.float64()))], ["key", "v"])

        got = _summed(matrix.mapInArrow(gradients, "key int, v array<double>"), width)
        step = np.stack([got.get(i, np.zeros(width)) for i in range(folds * len(classes))]).reshape(weights.shape)
        weights = weights + np.stack([np.linalg.solve(curve[k], (step[k] - weights[k] @ penalty).T).T for k in range(folds)])
    return weights


def out_of_fold(spark: SparkSession, rows: DataFrame, groups: DataFrame, folds: int = 5, ridge: float = 1.0, steps: int = 25, id: str = "vec_id") -> DataFrame:
    """``id, fold, y, predicted, p`` of ``rows(id, x, y)``: the likeliest class by the models that saw nothing of the row's group.

    ``x`` are lists of the length of the first row's without nulls, others are left out like rows without ``y``; classes
    are few. Equal probabilities go to the smaller class. No usable rows give an empty result.
    """
    kinds = dict(rows.dtypes)
    schema = f"{id} {kinds[id]}, fold int, y {kinds['y']}, predicted {kinds['y']}, p double"
    good = rows.where("x is not null and y is not null").where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)) & (F.size("x") > 0))
    first = good.select(F.min(F.struct(F.col(id), F.size("x").alias("d")))["d"]).first()[0]
    if first is None:
        return spark.createDataFrame([], schema)
    matrix = Rounds(spark, "folds").write(good.where(F.size("x") == first).join(groups, id).select(id, F.col("x").cast("array<double>").alias("x"), "y", fold_of(F.col("group"), folds).alias("fold")))
    classes = sorted(r[0] for r in matrix.select("y").distinct().collect())
    weights = fit_folds(matrix.select("x", "y", "fold"), first, classes, folds, ridge, steps)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            fold = b.column("fold").to_numpy()
            p = 1 / (1 + np.exp(-np.clip(np.einsum("nd,ncd->nc", _rows(b), weights[fold]), -30, 30)))
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(id), b.column("fold"), b.column("y"), pa.array([classes[i] for i in best], b.column("y").type), pa.array(p[np.arange(len(b)), best])], [id, "fold", "y", "predicted", "p"])

    return matrix.select(id, "x", "y", "fold").mapInArrow(score, schema)


def class_report(scored: DataFrame) -> DataFrame:
    """``y, n, predicted, hit, recall, precision`` by class and, under a null class, combined; a ratio without a base is 0."""
    hit = F.count_if(F.col("y") == F.col("predicted"))
    n = scored.groupBy("y").agg(F.count("*").alias("n"), hit.alias("hit"))
    said = scored.groupBy(F.col("predicted").alias("y")).agg(F.count("*").alias("predicted"))
    each = n.join(said, "y", "full").select("y", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "predicted", "hit")))
    every = each.unionByName(each.agg(F.lit(None).cast(dict(each.dtypes)["y"]).alias("y"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "predicted", "hit"))))
    ratio = lambda base: F.round(F.coalesce(F.try_divide(F.col("hit"), F.col(base)), F.lit(0.0)), 6)
    return every.select("y", "n", "predicted", "hit", ratio("n").alias("recall"), ratio("predicted").alias("precision"))
