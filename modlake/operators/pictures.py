"""Picture policy: exemplars, ordered verdicts, channels, reach of a mark, lists and statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PACK, SALTS = 1024, 32  # vectors of one length in one row; places at which packs meet
EPS = 1e-9  # more than sums of products in another order differ by, for lengths of 1


def _packed(rows: DataFrame) -> DataFrame:
    """``size, n, keys, us``: up to PACK vectors ``(key, u)`` of one length a row, as bytes of whole numbers and doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def flush(size: int) -> pa.RecordBatch:
            keys, us = held.pop(size)
            return pa.RecordBatch.from_arrays([pa.array([size]), pa.array([len(keys)]), pa.array([np.array(keys, np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(us).tobytes()], pa.binary())], ["size", "n", "keys", "us"])

        for b in batches:
            for key, u in zip(b.column("key").to_pylist(), b.column("u")):
                own = u.values.to_numpy(zero_copy_only=False).astype(np.float64)
                keys, us = held.setdefault(len(own), ([], []))
                keys.append(key)
                us.append(own)
                if len(keys) == PACK:
                    yield flush(len(own))
        for size in list(held):
            yield flush(size)

    return rows.select(F.col("key").cast("long").alias("key"), "u").mapInArrow(run, "size long, n long, keys binary, us binary")


def _nearest(u: np.ndarray, v: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest sum of products of each row of ``u`` with rows of ``v``, added up from the left, and its smallest id.

    Products of matrices add in an order of their own: they say which pairs come near the largest, and these are added
    up anew.
    """
    with np.errstate(invalid="ignore"):
        rough = u @ v.T
        slack = EPS * (1 + np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1).max())
    rough[np.isnan(rough)] = np.inf  # as in Spark, above all numbers
    at, of = np.nonzero(rough >= (rough.max(1) - np.nan_to_num(slack, nan=1.0, posinf=1.0))[:, None])
    sums = np.zeros(len(at))
    for k in range(u.shape[1]):
        sums += u[at, k] * v[of, k]
    order = np.lexsort((ids[of], -sums, ~np.isnan(sums), at))
    first = order[np.searchsorted(at[order], np.arange(len(u)))]
    return sums[first], ids[of[first]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            keys, ids = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["ids"], np.int64)
            u, v = np.frombuffer(r["us"]).reshape(len(keys), -1), np.frombuffer(r["vs"]).reshape(len(ids), -1)
            s, e = _nearest(u, v, ids)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([r["refuses"]] * len(keys)), pa.array(s), pa.array(e)], ["id", "refuses", "s", "e"])


def near_exemplars(pictures: DataFrame, exemplars: DataFrame, withdrawn: tuple[str, ...] = ()) -> DataFrame:
    """``id, block, allow, matched`` for each of ``pictures(id, u)``: the best similarity to ``exemplars(ex_id, u, action,
    category)`` of each action, at least 0, and the refusing one. Withdrawn categories do not speak; unit vectors of other
    length are like nothing.

    All pictures meet all marks, in products of packs of each, dealt to SALTS places; only maxima are kept, and nothing
    goes through the driver. Equal marks of one action meet once, as the smallest of their ids.
    """
    live = exemplars.where(~F.lower(F.trim("category")).isin(*withdrawn) if withdrawn else F.lit(True))
    live = live.where("size(u) > 0 and not exists(u, x -> x is null)").groupBy("u", F.coalesce(F.col("action") == "block", F.lit(False)).alias("refuses")).agg(F.min("ex_id").alias("key"))
    sides = [_packed(live.where(F.col("refuses") == own)).select("size", F.col("keys").alias("ids"), F.col("us").alias("vs"), F.lit(own).alias("refuses")) for own in (True, False)]
    marks = sides[0].unionByName(sides[1])
    packs = _packed(pictures.where("size(u) > 0 and not exists(u, x -> x is null)").select(F.col("id").alias("key"), "u"))
    packs = packs.withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(SALTS)))
    marks = marks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = packs.join(marks, ["size", "salt"]).select("keys", "us", "ids", "vs", "refuses").mapInArrow(_meet, "id long, refuses boolean, s double, e long")
    best = met.groupBy("id").agg(F.max(F.when(F.col("refuses"), F.struct("s", (-F.col("e")).alias("e")))).alias("b"), F.max(F.when(~F.col("refuses"), F.col("s"))).alias("a"))
    zero = F.lit(0.0)
    out = pictures.select("id").join(best, "id", "left")
    return out.select("id", F.greatest(F.coalesce("b.s", zero), zero).alias("block"), F.greatest(F.coalesce("a", zero), zero).alias("allow"), F.when(F.col("b.s") > 0, -F.col("b.e")).alias("matched"))


def channel(block: Column, allow: Column, probe: Column, over: Column, bar: float, margin: float, probe_bar: float, withdrawn: Column) -> Column:
    """Which channel refuses a picture, null if none: exemplars first, where the allowing side wins ties and the refusing
    one needs a margin; then the probe, unless its category is withdrawn; then the written policy."""
    overruled = (allow >= bar) & (allow >= block)
    refused = (block >= bar) & (block - allow >= margin)
    return F.when(overruled, None).when(refused, "exemplar").when(~withdrawn & (probe >= probe_bar), "probe").when(over, "policy")


def label_bars(scores: DataFrame, bars: DataFrame, default: float) -> DataFrame:
    """``scores(id, label, score)`` with each label's own bar, or the default, and whether it is reached."""
    out = scores.join(F.broadcast(bars), "label", "left").withColumn("bar", F.coalesce("bar", F.lit(default)))
    return out.withColumn("over", F.col("score") >= F.col("bar"))


def reach(pictures: DataFrame, marks: DataFrame, bar: float) -> DataFrame:
    """``category, n``: how many unmarked pictures a mark would catch, by category. ``marks(ex_id, u, action, category)``
    are left out of ``pictures(id, u, category)`` by id."""
    others = pictures.join(marks.select(F.col("ex_id").alias("id")), "id", "left_anti")
    near = near_exemplars(others, marks.withColumn("action", F.lit("block")))
    return near.where(F.col("block") >= bar).join(pictures.select("id", "category"), "id").groupBy("category").agg(F.count("*").alias("n"))


def most_alike(near: DataFrame, k: int) -> DataFrame:
    """The k rows of most similarity, smallest id first among equals."""
    return near.orderBy(F.desc("block"), "id").limit(k)


def where_images(category: str | None = None, action: str | None = None, selected: int | None = None, search: str | None = None) -> Column:
    """The list's filter: "all" or nothing does not filter; a search looks in file name and description."""
    out = F.lit(True)
    for column, value in (("category", category), ("action", action)):
        if value and value.lower() != "all":
            out &= F.col(column) == value.strip().lower()
    if selected is not None:
        out &= F.col("is_selected") == int(selected)
    if search and search.strip():
        out &= F.contains(F.lower("filename"), F.lit(search.strip().lower())) | F.contains(F.lower("description"), F.lit(search.strip().lower()))
    return out


def list_stats(images: DataFrame) -> DataFrame:
    """Totals by action and choice, and what the chosen ones teach; zeros for an empty list."""
    chosen, allow, block = F.col("is_selected") == 1, F.col("action") == "allow", F.col("action") == "block"
    return images.agg(F.count("*").alias("total"), F.count_if(allow).alias("allowed"), F.count_if(block).alias("blocked"), F.count_if(chosen).alias("selected"), F.count_if(chosen & allow).alias("teaching_allow"), F.count_if(chosen & block).alias("teaching_block"))


def by_channel(verdicts: DataFrame, marks: int = 4) -> DataFrame:
    """``set, cause, n, mark, m``: refusals by channel in each set, and the marks that fired most in it (ties: smallest)."""
    causes = verdicts.where("cause is not null").groupBy("set", "cause").agg(F.count("*").alias("n"))
    fired = verdicts.where("cause = 'exemplar'").groupBy("set", "matched").agg(F.count("*").alias("m"))
    top = fired.withColumn("r", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("m"), "matched"))).where(F.col("r") <= marks)
    top = top.groupBy("set").agg(F.array_sort(F.collect_list(F.struct("r", "matched"))).alias("t"))
    return causes.join(top, "set", "left").select("set", "cause", "n", F.coalesce(F.array_join(F.transform("t", lambda x: x.matched.cast("string")), ","), F.lit("")).alias("marks"))


def cluster_of(path: Column) -> Column:
    """A picture's group of near copies: its file's stem without last digits, or the stem if it has no more."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    cut = F.regexp_replace(stem, "[0-9]+$", "")
    return F.when(cut == "", stem).otherwise(cut)
