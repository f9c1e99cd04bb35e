"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, frugal

#: Each share with the value that a text of no length would have; longer texts outweigh it.
SHARES = {"upper": 0.02, "digit": 0.005, "blank": 0.15, "high": 0.03, "exclaim": 0.005, "pipe": 0.003, "symbol": 0.003, "comma_stop": 0.03, "other": 0.001, "line_repeats": 0.05, "word_repeats": 0.3, "capitals": 0.02, "marked": 0.01}
FEATURES = ("word_size", *SHARES)
_PRIOR = np.array(list(SHARES.values()))
_CLASS = np.full(256, 11)  # other


def _set(chars: bytes, k: int) -> None:
    _CLASS[list(chars)] = k


_set(b"abcdefghijklmnopqrstuvwxyz", 10)
_set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3)
_set(b"0123456789", 4)
_set(b" \t\n\r", 5)
_CLASS[128:] = 6
_set(b"!?", 7)
_set(b"|", 8)
_set(b"#$%&*@^~<>{}[]\\=+_`", 9)
_set(b",.;:'\"()-/", 12)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text: shares on a log-odds scale, word size on a log scale.

    Null and empty texts give those of no characters and no words.
    """
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    by_class = np.bincount(_CLASS, weights=np.bincount(data, minlength=256), minlength=13)
    words, lines = text.split(), text.split("\n")
    n, w = len(data), len(words)
    capitals = sum(1 for x in words if x.isupper() and len(x) > 1)
    marked = sum(1 for x in words if x[-1] in "!#$%&*|@^~")
    have = np.array([*by_class[[3, 4, 5, 6, 7, 8, 9, 12, 11]], len(lines) - len(set(lines)), w - len(set(words)), capitals, marked])
    of = np.array([n] * 9 + [len(lines), w, w, w])
    weight = np.array([40.0] * 9 + [5.0, 10.0, 10.0, 10.0])
    odds = np.log((have + weight * _PRIOR) / (of - have + weight * (1 - _PRIOR)))
    return [float(np.log((n - by_class[5] + 60) / (w + 10))), *odds.tolist()]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, x`` of every document; held_out by CRC-32 of the id's text (null id: as of an empty text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("doc_id").to_pylist()
            held = [zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 0 for k in keys]
            x = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "held_out", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, held_out boolean, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors of the shrunken covariances, their log-determinants and the log prior odds."""

    mean: np.ndarray
    factor: np.ndarray
    logdet: np.ndarray
    prior: float
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the tempered difference of the two Mahalanobis log-densities."""
        logs = []
        for k in (0, 1):
            z = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)
            logs.append(-0.5 * ((z * z).sum(axis=0) + self.logdet[k]))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) * self.temper + self.prior, -700, 700)))


def fit(rows: DataFrame, to_pooled: float = 0.3, to_diagonal: float = 0.2, ridge: float = 0.05, temper: float = 0.5) -> Discriminant | None:
    """From all rows ``(y, x)``; None unless both classes occur.

    Per class only its count, sums and sums of products are gathered: d + d(d+1)/2 numbers from each task. A class's
    covariance is drawn to the pooled one, then to its diagonal, and ``ridge`` times the pooled variances is added.
    """
    d = len(FEATURES)

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for pdf in frames:
            for k in (0, 1):
                own = pdf["x"][pdf["y"] == k]
                if len(own):
                    x = np.stack(own.to_list())
                    n[k] += len(x)
                    s[k] += x.sum(axis=0)
                    p[k] += x.T @ x
        for k in (0, 1):
            if n[k]:
                yield pd.DataFrame({"y": k, "k": np.arange(1 + d + d * d), "v": np.concatenate([[n[k]], s[k], p[k].ravel()])})

    got = rows.mapInPandas(moments, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros((2, 1 + d + d * d))
    sums[got["y"], got["k"]] = got["v"]
    n = sums[:, 0]
    if not n.all():
        return None
    mean = sums[:, 1 : 1 + d] / n[:, None]
    cov = sums[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (n[:, None, None] * cov).sum(axis=0) / n.sum()
    spread = np.maximum(np.diag(pooled), 1e-3)
    factor, logdet = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * cov[k] + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + ridge * np.diag(spread)
        factor.append(np.linalg.cholesky(c))
        logdet.append(2 * np.log(np.diag(factor[-1])).sum())
    return Discriminant(mean, np.array(factor), np.array(logdet), float(np.log(n[1] / n[0])), temper)


def learn(stats: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Fit on the labelled documents that are not held out; null labels and values other than 0 and 1 do not count.

    Repeated or contradicting labels of one doc_id count each, as do repeated documents.
    """
    marks = labels.where("quality in (0, 1)").select(F.col("doc_id"), F.col("quality").cast("int").alias("y"))
    return fit(stats.where("not held_out").join(marks, "doc_id").select("y", "x"))


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, bar: float = 0.3, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, repeated rows included.

    Scores are of whole texts; null texts are scored as empty ones. If the labels do not have both classes, the score
    is 0.5. An empty table gives no rows; other columns are not looked at. Statistics are computed once and written;
    the model (a few hundred numbers) is all that tasks are sent.
    """
    scratch = scratch or Scratch(spark, "quality")
    stats = scratch.write(document_statistics(docs))
    model = learn(stats, labels)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            known = model is not None and len(pdf)
            yield pdf[["doc_id", "held_out"]].assign(score=model.score(np.stack(pdf["x"].to_list())) if known else 0.5)

    kind = dict(docs.dtypes)["doc_id"]
    out = stats.mapInPandas(score, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= bar).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, bar: float = 0.3) -> DataFrame:
    """The documents that score ``bar`` or more, as they are; all of them if the labels do not have both classes.

    Scored where they are read: only statistics, not texts, are sent to meet the labels. Null texts are scored as
    empty ones, repeated rows each; an empty table gives no rows; columns of any other name are left alone.
    """
    model = learn(document_statistics(docs), labels)
    if model is None:
        return docs

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    return docs.where(score("text") >= bar)
