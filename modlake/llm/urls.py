"""URL filter: the longest matching rule decides; else a ratio of two character language models does."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: The rules of the contract: (host, path prefix, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
ORDERS, BASE, CHUNK, BINS = 6, 257, 11, 4096


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path. Null, or without ``://``: both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits, as host and path together, and its verdict; null if none does. The longest text wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _slices(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of the texts that have ``size`` characters or few more, so that arrays by byte stay small."""
    at = total = 0
    for k, text in enumerate(texts):
        total += len(text) + 1
        if total >= size:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts: whose it is, and its gram, the byte and the ORDERS - 1 before it as one exact number.

    A gram is a number to the base 257: 0 before the text, else the byte plus 1. Its last k + 1 digits are the gram
    of order k, those without the last one that gram's context.
    """
    blobs = [t.encode("utf-8") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(blobs), np.uint8).astype(np.int64) + 1
    sizes = np.array([len(b) for b in blobs], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gram = np.zeros(len(data), np.int64)
    for k in range(ORDERS - 1, -1, -1):
        back = np.zeros(len(data), np.int64)
        back[k:] = data[: len(data) - k]
        gram = gram * BASE + np.where(place >= k, back, 0)
    return owner, gram


class UrlModels:
    """Two variable-order Markov models over bytes, accepted and rejected, in one exact table of counts by gram.

    The probability of a byte after a context of k bytes is its count, plus ``weight`` times the probability after
    k - 1 bytes, over the context's count plus ``weight``: where a long context was not seen, shorter ones speak.
    The table ``(g, n0, n1)`` stays distributed and grows with the distinct grams; contexts never share a count.
    """

    def __init__(self, counts: DataFrame, scratch: Scratch, weight: float = 1.0):
        self.counts, self.scratch, self.weight = counts, scratch, weight

    def both(self) -> bool:
        """Whether there were examples of both verdicts."""
        got = self.counts.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
        return got[0] > 0 and got[1] > 0

    def _logs(self, grams: DataFrame) -> DataFrame:
        """``(g, lr)``: log-likelihood of the last byte of each gram under accepted less that under rejected.

        Goes up the orders: a gram meets the count of its context and the probability that its shorter gram has.
        At most 257 grams share a context or a next longer gram, so no join has a large key.
        """
        zero = F.lit(0).cast("long")
        every = self.scratch.write(self.counts.unionByName(grams.select("g", zero.alias("n0"), zero.alias("n1"))).groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
        below = None
        for k in range(ORDERS):
            own = every.groupBy((F.col("g") % BASE ** (k + 1)).alias("g")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
            own = own.withColumn("c", F.expr(f"g div {BASE}"))
            level = own.join(own.groupBy("c").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1")), "c").withColumn("s", F.col("g") % BASE**k)
            if below is None:
                level = level.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
            else:
                level = level.join(below.select(F.col("g").alias("s"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), "s")
            p = [(F.col(f"n{j}") + self.weight * F.col(f"q{j}")) / (F.col(f"c{j}") + self.weight) for j in (0, 1)]
            below = self.scratch.write(level.select("g", p[0].alias("p0"), p[1].alias("p1")))
        return below.select("g", (F.ln("p0") - F.ln("p1")).alias("lr"))

    def score(self, rows: DataFrame) -> DataFrame:
        """The rows with ``ratio``, the mean over the bytes of ``own`` of the log-likelihoods' difference.

        Rows are dealt to chunks of ``1 << CHUNK`` at most as they lie. Each distinct gram of a chunk goes once to the
        table and back, so that a gram in every URL costs a row by chunk and not one by URL.
        """
        rows = self.scratch.write(rows.withColumn("_chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK)))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, chunk = b.column("own").to_pylist(), b.column("_chunk").to_numpy()
                for c in np.unique(chunk):
                    mine = [texts[i] for i in np.flatnonzero(chunk == c)]
                    for lo, hi in _slices(mine):
                        g = np.unique(_grams(mine[lo:hi])[1])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), c, np.int64)), pa.array(g)], ["_chunk", "g"])

        grams = self.scratch.write(rows.select("own", "_chunk").mapInArrow(spread, "_chunk long, g long"))
        logs = grams.join(self._logs(grams), "g").select("_chunk", "g", "lr")

        def sums(left: pa.Table, right: pa.Table) -> pa.Table:
            g, lr = right.column("g").to_numpy(), right.column("lr").to_numpy()
            order = np.argsort(g)
            g, lr = g[order], lr[order]
            texts, ratio = left.column("own").to_pylist(), np.empty(left.num_rows)
            for lo, hi in _slices(texts):
                owner, gram = _grams(texts[lo:hi])
                n = np.bincount(owner, minlength=hi - lo)
                ratio[lo:hi] = np.bincount(owner, weights=lr[np.searchsorted(g, gram)], minlength=hi - lo) / n
            return left.append_column("ratio", pa.array(ratio))

        schema = T.StructType([*rows.schema.fields, T.StructField("ratio", T.DoubleType())])
        return self.scratch.write(rows.groupBy("_chunk").cogroup(logs.groupBy("_chunk")).applyInArrow(sums, schema)).drop("_chunk")

    def ratio(self, urls: list[str]) -> np.ndarray:
        """Ratios of a few URLs of the driver."""
        spark = self.counts.sparkSession
        got = self.score(spark.createDataFrame(list(enumerate(urls)), "k long, own string")).select("k", "ratio").orderBy("k").collect()
        return np.array([r.ratio for r in got])


def fit(rows: DataFrame, scratch: Scratch | None = None) -> UrlModels:
    """Counts over all rows ``(own, accepted)``: each batch counts its own grams, Spark adds them up by gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, yes = b.column("own").to_pylist(), b.column("accepted").to_pylist()
            for lo, hi in _slices(texts):
                owner, gram = _grams(texts[lo:hi])
                first = np.array(yes[lo:hi], bool)[owner]
                g, at = np.unique(gram, return_inverse=True)
                n0, n1 = np.bincount(at[first], minlength=len(g)), np.bincount(at[~first], minlength=len(g))
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n0.astype(np.int64)), pa.array(n1.astype(np.int64))], ["g", "n0", "n1"])

    scratch = scratch or Scratch(rows.sparkSession, "urls")
    got = rows.select("own", "accepted").mapInArrow(count, "g long, n0 long, n1 long")
    return UrlModels(scratch.write(got.groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))), scratch)


def threshold(rows: DataFrame, bins: int = BINS) -> float:
    """The ratio at which held-out URLs ``(ratio, accepted)`` are told apart best (balanced accuracy), from a histogram."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("ratio") + 16) * (bins / 32)))).cast("int")
    got = rows.groupBy(bin_.alias("bin")).agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no")).toPandas()
    yes, no = np.zeros(bins), np.zeros(bins)
    yes[got["bin"]], no[got["bin"]] = got["yes"], got["no"]
    if not yes.sum() or not no.sum():
        return 0.0
    good = (yes[::-1].cumsum()[::-1] / yes.sum()) + (no.cumsum() - no) / no.sum()  # accept from this bin on
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 * (32 / bins) - 16)


def judge_urls(spark: SparkSession, pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, ratio`` of every row; null or unusable URLs have empty host and path.

    Rules look at host and path, the models at the whole URL as it is (null as empty). URLs that a rule decides teach the two models (four fifths of them, by hash) and set the threshold (the rest);
    all others get the verdict of the models, ``allow`` if the ratio is at least the threshold. Without examples of
    both verdicts the ratio and the threshold are 0 and the verdict is ``allow``. Repeated rows are judged each; an
    empty table gives no rows; other columns are not looked at. What is shuffled are rows by chunk and distinct grams.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_ruled", verdict).withColumn("own", F.coalesce("url", F.lit(""))).drop("url")
    rows = rows.withColumn("_held", F.pmod(F.xxhash64("own"), F.lit(5)) == 0)
    scratch = Scratch(spark, "urls")
    rows = scratch.write(rows)
    accepted = (F.col("_ruled") == "allow").alias("accepted")
    models = fit(rows.where("_ruled is not null and not _held").select("own", accepted), scratch)
    both = models.both()
    out = models.score(rows) if both else rows.withColumn("ratio", F.lit(0.0))
    bar = threshold(out.where("_ruled is not null and _held").select("ratio", accepted)) if both else 0.0
    verdict = F.coalesce("_ruled", F.when(F.col("ratio") >= bar, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")
