"""Shared pieces: written scratch tables, word digests, membership bitmaps, connected components."""

from __future__ import annotations

import ctypes
import functools
import inspect
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but a space or the controls U+0009 to U+000D, which is what bytes.split() gives.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only where the session names none and is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints/modlake"


class Scratch:
    """Tables of one query, written as Parquet to the shared folder to cut lineage: a lost executor costs a reread only."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, *, partitions: int | None = None) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def free(self, *tables: DataFrame) -> None:
        """Deletes tables that no plan still to be run reads."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def frugal(function):
    """An Arrow function of a stage whose worker gives freed memory back to the system when the task or group ends.

    Workers outlive their task and wait for the next one; what their allocators keep would count against the executor
    while the stages after this one run.
    """

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    @functools.wraps(function)
    def batches(it):
        yield from function(it)
        give_back()

    @functools.wraps(function)
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        out = function(pdf)
        give_back()
        return out

    @functools.wraps(function)
    def groups(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = function(left, right)
        give_back()
        return out

    if inspect.isgeneratorfunction(function):
        return batches
    return group if len(inspect.signature(function).parameters) == 1 else groups


class WordDigests(dict):
    """A 64-bit digest of each word (XXH3), remembered for up to LIMIT words; then the memory starts anew.

    Words in any pattern are as good as random numbers, so equal digests are candidates for equal words; who must be
    sure compares the words, or another digest of them. XXH3 takes a fifth of the time of BLAKE2b, so a small memory
    will do.
    """

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        own = self[word] = xxhash.xxh3_64_intdigest(word)
        return own

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def among(rows: DataFrame, *key: str, most_bits: int = 26) -> Callable[..., Column]:
    """A test whether a row's key may be among those of ``rows``: a bitmap by hash, which misses none.

    It has 16 bits a row, but no more than ``1 << most_bits`` (8 MB): that is all that the driver and tasks get,
    whatever the input. A fuller bitmap lets more rows through to the exact join behind it and changes no result.
    """
    n = rows.count()
    bits = 1 << min(most_bits, max(16, (16 * n).bit_length()))
    h = F.pmod(F.xxhash64(*key), F.lit(bits))
    got = rows.select(h.alias("h")).groupBy(F.shiftright("h", 5).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(h, 32) as int)))").alias("b")).toPandas()
    words = np.zeros(bits // 32, np.uint32)
    words[got["w"]] = got["b"].astype(np.uint32)
    sent = rows.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def seen(h: pd.Series) -> pd.Series:
        at = h.to_numpy() % bits
        return pd.Series(sent.value[at >> 5] >> (at & 31).astype(np.uint32) & 1 == 1)

    return lambda *columns: seen(F.xxhash64(*columns))


def unlike(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from all ``columns``, in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive hashes; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, n, 1 << 14):  # parts that stay in the processor's cache
            part = out[a : a + (1 << 14)]
            for k in range(size):
                part *= np.uint64(0x9E3779B97F4A7C15)
                part += hashes[a + k : a + k + len(part)]
                part ^= part >> np.uint64(29)
            part[:] = mix(part)
    return out


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` for each end of ``edges(a, b)``: the smallest id reachable.

    Alternates large-star and small-star steps until nothing changes. Each step is a grouped minimum, with
    map-side combine, and an equi-join that adaptive execution can split; edges stay distributed throughout.
    Loops and repeated edges are fine; no edges give no rows.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == before:
            break
        before = tuple(state)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step = scratch.write(large)
        least = step.groupBy("a").agg(F.min("b").alias("m"))
        small = step.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = scratch.write(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        scratch.free(step)
        scratch.free(now)
        now = after
    least = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return least.unionByName(least.select(F.col("component").alias("id"), "component").distinct())
