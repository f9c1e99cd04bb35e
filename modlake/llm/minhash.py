"""Near-duplicate documents: BagMinHash signatures of word-shingle bags, banded, then verified exactly."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordDigests, among, components, frugal, mix, rolling, unlike

SHINGLE, BAR, BANDS, ROWS = 5, 0.8, 20, 4
BLOCK = 2048  # rows of a bucket compared at a time


def shingle_bag(hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their counts; a text of fewer words than a shingle has one shingle, no words none."""
    if 0 < len(hashes) < size:
        hashes = np.concatenate([hashes, np.full(size - len(hashes), 0x5BD1E995, np.uint64)])
    return np.unique(rolling(hashes, size), return_counts=True)


def bag_of(text: str | None, words: WordDigests, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The bag of a text's shingles, by digest."""
    return shingle_bag(words.of((text or "").encode("utf-8").split()), size)


def exact_bag(text: str | None, size: int = SHINGLE) -> Counter:
    """The bag of a text's shingles, as the words themselves."""
    own = (text or "").encode("utf-8").split()
    own += [b""] * (size - len(own)) if 0 < len(own) < size else []
    return Counter(zip(*(own[k:] for k in range(size))))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags; two empty ones are alike."""
    total = a.total() + b.total()
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return shared / (total - shared) if total else 1.0


def bag_minhash(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """``[docs, size]`` signatures; two agree in a component with the weighted Jaccard similarity as probability.

    Weights are discretised to whole numbers. The range of weights is cut into [0,1), [1,2), [2,4), [4,8), ...; each
    part of each shingle has a Poisson process of its own whose rate is the part's length, and whose points have a
    place in the part and a component. A bag has the points below its weight; a component keeps the earliest. Parts
    give their points in order of time, so each stops at the first point after the latest kept by the document.
    """
    sig = np.full(docs * size, np.inf)
    level = np.zeros(len(weight), np.int64)
    level[weight > 1] = np.ceil(np.log2(weight[weight > 1])).astype(np.int64)
    parts = level + 1
    row = np.repeat(np.arange(len(weight)), parts)
    part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.where(part > 0, 1 << np.maximum(part - 1, 0), 0)
    length = np.maximum(start, 1)
    below, doc = weight[row] - start, owner[row]
    with np.errstate(over="ignore"):
        state = mix(shingle[row] + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        time = np.zeros(len(row))
        while len(state):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log1p(-(state >> np.uint64(11)).astype(np.float64) * 2.0**-53) / length
            latest = sig.reshape(docs, size).max(axis=1)
            live = time < latest[doc]
            if not live.all():
                state, time, length, below, doc = state[live], time[live], length[live], below[live], doc[live]
            other = mix(state ^ np.uint64(0xD6E8FEB86659FD93))
            at = doc * size + (other % np.uint64(size)).astype(np.int64)
            inside = (other >> np.uint64(16)) % length.astype(np.uint64) < below.astype(np.uint64)
            np.minimum.at(sig, at[inside], time[inside])
    return sig.reshape(docs, size)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, same, marks, keys``: a digest of the text, one byte per component, and one key per band.

    Texts are hashed whole, some hundred at a time. Without words there are no marks and no keys.
    """
    size = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordDigests()
        for b in batches:
            texts = b.column("text").to_pylist()
            same = [hashlib.md5((t or "").encode("utf-8")).digest() for t in texts]
            marks, keys = [], []
            for at in range(0, len(texts), 400):
                bags = [bag_of(t, words, shingle) for t in texts[at : at + 400]]
                owner = np.repeat(np.arange(len(bags)), [len(x[0]) for x in bags])
                sig = bag_minhash(owner, np.concatenate([x[0] for x in bags]), np.concatenate([x[1] for x in bags]), len(bags), size)
                bits = mix(sig.view(np.uint64))
                key = np.zeros((len(bags), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        key = mix(key * np.uint64(31) + bits.reshape(-1, bands, rows)[:, :, r] + np.arange(bands, dtype=np.uint64))
                for k, bag in enumerate(bags):
                    marks.append((bits[k] >> np.uint64(56)).astype(np.uint8).tobytes() if len(bag[0]) else None)
                    keys.append(key[k].view(np.int64) if len(bag[0]) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(same, pa.binary()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same", "marks", "keys"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, same binary, marks binary, keys array<long>")


def overlap(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags by digest; two empty ones are alike.

    Never under the similarity of the bags themselves, since shingles that share a digest only add to what is shared.
    """
    (x, n), (y, m) = one, other
    total = int(n.sum() + m.sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[i], m[j]).sum())
    return shared / (total - shared)


def verified(pairs: DataFrame, texts: DataFrame, bar: float = BAR, shingle: int = SHINGLE) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts ``(id, text)`` reach the bar, word by word; only texts of pairs are sent."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similarity(exact_bag(x.as_py(), shingle), exact_bag(y.as_py(), shingle)) >= bar for x, y in zip(b.column("ta"), b.column("tb"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ta, tb = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.hint("merge").join(ta, "a").hint("merge").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(frugal(run), f"a {kind}, b {kind}")


def _links_across(least: float, bar: float, shingle: int):
    """Within one cell of a bucket: links between texts that were in different components.

    Pairs whose marks agree enough are verified where they meet, the most alike first, unless a link found before has
    joined them or an earlier band has brought them together: first by digests, then word by word. Only links that
    join something are sent on.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        side, band = pdf["side"].to_numpy(), int(pdf["band"].iloc[0])
        marks = np.frombuffer(b"".join(pdf["marks"]), np.uint8).reshape(len(pdf), -1)
        keys, root = np.stack(pdf["keys"]), np.unique(pdf["component"], return_inverse=True)[1]
        words, bags, links = WordDigests(), {}, []
        left, right, text = np.flatnonzero(side != 1), np.flatnonzero(side != 0), pdf["text"].tolist()

        def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in bags:
                bags[i] = bag_of(text[i], words, shingle)
            return bags[i]

        for at in range(0, len(left), 64):
            own = left[at : at + 64]
            i, j = np.nonzero(root[own][:, None] != root[right][None, :])
            i, j = own[i], right[j]
            if side[0] == 2:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 65_536):
                x, y = i[k : k + 65_536], j[k : k + 65_536]
                alike = (marks[x] == marks[y]).mean(axis=1)
                good = (alike >= least) & ~(keys[x, :band] == keys[y, :band]).any(axis=1)
                x, y, alike = x[good], y[good], alike[good]
                for x, y in zip(*(z[np.argsort(-alike, kind="stable")].tolist() for z in (x, y))):
                    if root[x] != root[y] and overlap(bag(x), bag(y)) >= bar and similarity(exact_bag(text[x], shingle), exact_bag(text[y], shingle)) >= bar:
                        links.append((pdf["id"].iloc[x], pdf["id"].iloc[y]))
                        root[root == root[y]] = root[x]
        return pd.DataFrame(links, columns=["a", "b"])

    return run


HOT_KEYS = 1_000_000  # large buckets sent to all tasks at most: 32 MB


def _split_join(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows(band, key, ...)`` joined with the written table ``buckets(band, key, n, ...)``; no task gets a large bucket whole.

    Buckets of over BLOCK rows are few and go to where their rows are, if they are counted as few enough; the rest is
    joined by key.
    """
    key, large = ["band", "key"], buckets.where(F.col("n") > BLOCK)
    if large.limit(HOT_KEYS + 1).count() > HOT_KEYS:
        return rows.join(buckets, key)
    there = rows.join(F.broadcast(large), key)
    return there.unionByName(rows.join(F.broadcast(large.select(*key)), key, "left_anti").join(buckets.where(F.col("n") <= BLOCK), key))


def _one_text_each(sigs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """The signatures without those of further texts of a doc_id, and ``doc_id, first`` of such ids if there are any."""
    twice = sigs.groupBy("doc_id").agg(F.min("same").alias("first"), F.max("same").alias("last")).where("first <> last").select("doc_id", "first")
    twice = scratch.write(twice)
    if twice.isEmpty():
        return sigs, None
    return sigs.join(twice, "doc_id", "left").where("first is null or first = same").drop("first"), twice


def classes(spark: SparkSession, docs: DataFrame, scratch: Scratch, bar: float = BAR, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """``same, class_id`` for each distinct text (by digest): the smallest doc_id that chains of links reach.

    1. Documents with the same text become one, by digest, so copies never meet in a bucket.
    2. In each bucket every text is paired with the bucket's first one, and each text's most frequent such partner is
       verified.
    3. Buckets whose texts are then still in several components are gone through in cells of bounded size: pairs
       across components whose signatures agree well enough are verified there.

    Nothing is capped: every pair that shares a bucket is joined by links, verified, or estimated at over four
    standard deviations under the bar. What is sent is one pair per text, the texts of mixed buckets, and links.
    """
    kind = dict(docs.dtypes)["doc_id"]
    sigs = scratch.write(signatures(docs.where("doc_id is not null"), bands, rows, shingle))
    own, twice = _one_text_each(sigs, scratch)
    one = scratch.write(own.groupBy("same").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("marks").alias("marks"), F.first("keys").alias("keys")))
    buckets = one.select("id", F.posexplode("keys").alias("band", "key"))
    size = scratch.write(buckets.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1"))
    members = scratch.write(_split_join(buckets, size).select("band", "key", "n", "low", "id"))
    scratch.free(size)
    star = members.where("id <> low").groupBy(F.col("id").alias("a"), F.col("low").alias("b")).agg(F.count("*").alias("shared"))
    star = scratch.write(star)
    paired = scratch.write(star.select("a").unionByName(star.select(F.col("b").alias("a"))).distinct())
    texts = docs.select(F.col("doc_id").alias("id"), "text").where(among(paired, "a")("id")).hint("merge").join(paired, F.col("id") == F.col("a"), "left_semi")
    if twice is not None:
        texts = texts.join(twice, F.col("id") == F.col("doc_id"), "left").where(F.coalesce(F.col("first") == F.unhex(F.md5(F.coalesce("text", F.lit("")))), F.lit(True))).select("id", "text")
    texts = scratch.write(texts.dropDuplicates(["id"]))
    best = scratch.write(star.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b")))
    links = scratch.write(verified(best, texts, bar, shingle))
    scratch.free(star, paired)

    comp = scratch.write(components(spark, links, scratch))
    other = members.where("n = 2 and id <> low").join(best, (F.col("id") == F.col("a")) & (F.col("low") == F.col("b")), "left_anti").select("band", "key")
    open_ = members.where("n > 2").unionByName(members.join(other, ["band", "key"], "left_semi"))  # of two texts that were verified, no more is to be found
    of = scratch.write(open_.join(comp, "id", "left").select("band", "key", "n", "id", F.coalesce("component", "id").alias("component")))
    mixed = scratch.write(of.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.first("n").alias("n")).where("x <> y").select("band", "key", "n"))
    sigma = (bar * (1 - bar) / (bands * rows)) ** 0.5
    cells = _split_join(of.drop("n"), mixed).withColumn("cuts", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda c: F.struct(F.least("own", c).alias("row"), F.greatest("own", c).alias("col"), F.when(F.col("own") == c, 2).when(F.col("own") < c, 0).otherwise(1).alias("side")))
    cells = scratch.write(cells.withColumn("c", F.explode(cell)).select("band", "key", "c.*", "id", "component"))
    looks = one.select("id", "marks", "keys").join(texts.select("id", "text"), "id")
    meet = cells.hint("merge").join(looks, "id").groupBy("band", "key", "row", "col")
    more = scratch.write(meet.applyInPandas(_links_across(bar - 4.5 * sigma, bar, shingle), f"a {kind}, b {kind}"))
    scratch.free(texts, cells, of, mixed, members, best)
    if not more.isEmpty():
        old, comp = comp, scratch.write(components(spark, links.unionByName(more), scratch))
        scratch.free(old)
    scratch.free(links, more)
    named = scratch.write(one.join(comp, "id", "left").select("same", F.coalesce("component", "id").alias("class_id")))
    classed = own.select("doc_id", "same").join(named, "same").select("doc_id", "class_id")
    if twice is not None:
        classed = sigs.select("doc_id").join(classed.distinct(), "doc_id")
    out = scratch.write(classed.withColumn("kept", F.col("doc_id") == F.col("class_id")))
    scratch.free(sigs, one, comp, named)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, kept`` of every document: its class is named after the smallest doc_id in it.

    Two documents are linked if the bags of their five-word shingles have a weighted Jaccard similarity of 0.8 or
    more; classes are what links connect. Null texts count as empty; texts without words are alike only if they are
    the same. Texts of fewer than five words are one shingle. Rows that repeat a doc_id are one document, with
    the text of the smallest MD5 digest if they differ, and give one row each; a null id is a class of its own. An empty table gives no rows; other columns are not looked at.
    """
    out = classes(spark, docs, Scratch(spark, "minhash"), **options)
    alone = docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def keep_one(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents that name their class, with all columns; of rows that repeat such an id, all.

    Only documents that may go are sent by id: whoever a bitmap of the others rules out stays where it is read.
    """
    scratch = Scratch(spark, "kept")
    (gone,) = unlike(docs.columns, "gone")
    out = near_duplicates(spark, docs, **options)
    dropped = out.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept")
    dropped = scratch.write(dropped.select(F.col("doc_id").alias(gone)))
    maybe = among(dropped, gone)(F.col("doc_id"))
    return docs.where(~maybe).unionByName(docs.where(maybe).hint("merge").join(dropped, F.col("doc_id") == F.col(gone), "left_anti"))
