"""Shaping of training rows: swaps, uploads, leaks, guards, span labels and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import reports


def mentions(text: Column, word: str) -> Column:
    """Whether a text has the word, in any case."""
    return text.rlike(rf"(?i)\b{word}\b")


def swapped_copies(rows: DataFrame, word: str, others: tuple[str, ...], share: float) -> DataFrame:
    """Copies that uncouple a pronoun from the label: safe rows without it get it for one of ``others``, unsafe rows with
    it get one of them, each pool sampled by a hash of the text. Labels stay; a copy that changes nothing is none.
    ``rows(id, text, label)``; the result has ``id, text, label, source``."""
    has, some = mentions(F.col("text"), word), F.lit(False)
    for o in others:
        some |= mentions(F.col("text"), o)
    into = F.coalesce(*[T.swap_pronoun(F.col("text"), o, word) for o in others])
    out = F.when(F.col("id") % 2 == 0, T.swap_pronoun(F.col("text"), word, others[0])).otherwise(T.swap_pronoun(F.col("text"), word, others[-1]))
    kept = reports.in_share(F.col("text"), share)
    safe = rows.where((F.col("label") == 0) & ~has & some & kept).withColumn("text", into)
    unsafe = rows.where((F.col("label") == 1) & has & kept).withColumn("text", out)
    return safe.unionByName(unsafe).where("text is not null").select("id", "text", "label", F.lit("pronoun_swap").alias("source"))


def upload(rows: DataFrame, split: Column, category: str, order: str = "id") -> DataFrame:
    """Uploaded rows, trimmed, blank ones dropped, each text once (the first in order); a null category gets the default."""
    own = rows.withColumn("text", F.trim("text")).where("text <> ''")
    first = Window.partitionBy("text").orderBy(order)
    own = own.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return own.withColumn("category", F.coalesce("category", F.lit(category))).withColumn("split", split)


def leaks(rows: DataFrame, held: DataFrame, key) -> DataFrame:
    """The rows whose key is among those of ``held``, the stricter side; both sides by the same key function."""
    keys = held.select(key(F.col("text")).alias("_k")).where("_k <> ''").distinct()
    return rows.withColumn("_k", key(F.col("text"))).join(keys, "_k", "left_semi").drop("_k")


def unseen(rows: DataFrame, held: DataFrame, key) -> DataFrame:
    """The rows whose key ``held`` does not have; a null text is not seen."""
    keys = held.select(key(F.col("text")).alias("_k")).distinct()
    return rows.withColumn("_k", key(F.col("text"))).join(keys, "_k", "left_anti").drop("_k")


def safe_enough(rows: DataFrame, held: DataFrame, blocked: Column, key, least: int) -> DataFrame:
    """Generated safe rows that may stay: long enough, not in an evaluation set, not held back by the gate."""
    return unseen(rows.where((F.length("text") >= least) & ~blocked), held, key)


def still_there(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``missing``: how many rows of a baseline an edit lost, repeats counted."""
    return before.select(key).exceptAll(after.select(key)).agg(F.count("*").alias("missing"))


def span_labels(spans: DataFrame) -> DataFrame:
    """``span, label``: a span that occurs in several documents has the worst label of them."""
    return spans.groupBy("span").agg(F.max("label").alias("label"))


def head_and_window(words: Column, size: int, seed: Column) -> Column:
    """A window of ``size`` words from a seeded place, the whole text if it has no more."""
    n = F.size(words)
    start = F.when(n > size, F.pmod(F.xxhash64(seed), n - size + 1)).otherwise(0).cast("int")
    return F.array_join(F.slice(words, start + 1, F.lit(size)), " ")


def reconciled(parts: list[DataFrame]) -> DataFrame:
    """Sets with either or both labels as one: a missing public label is the label itself."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("public_label", F.coalesce("public_label", "label"))
