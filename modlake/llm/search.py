"""Exact top-k BM25 search: an inverted index per shard, block-max WAND over cursors, merged with global statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

K1, B = 1.2, 0.75
SHARD_DOCS, SHARD_BYTES, SHARD_TERMS = 8192, 1 << 25, 500_000
RANGE, LONG_SHARE, LONG_LEAST, LONG_BYTES = 32, 16, 16, 1 << 26
FIRST, STEP, GROUP, MANY, QUERY_BYTES, SALTS, EPS = 32, 2048, 32, 512, 1 << 25, 16, 2e-6

#: Terms are runs of ASCII letters and digits and of all bytes from 128 on; A-Z are folded to a-z, all else is a break.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order, repeats included."""
    return (text or "").encode("utf-8").translate(_FOLD).split()


class Numbers(dict):
    """Terms numbered as they come; the terms themselves are kept, so two never share a number."""

    def __missing__(self, term: bytes) -> int:
        own = self[term] = len(self)
        return own


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one range after the other."""
    n = end - start
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


class Shard:
    """Posting lists by term, each with its largest impact of all.

    Long lists, those of a 16th of all documents or more, stand side by side by document (the longest, up to 64 MB), with
    the largest impact of each in every range of 32 documents. ``touched`` counts postings read.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, docs: np.ndarray, tf: np.ndarray, mean: float):
        self.ids, self.n, self.docs = ids, len(ids), docs.astype(np.int64)
        self.list = np.append(0, np.cumsum(counts.astype(np.int64)))
        self.impact = tf * (K1 + 1)
        weight = (K1 * (1 - B + B * sizes / mean))[self.docs]
        weight += tf
        self.impact /= weight
        del weight
        self.best = np.maximum.reduceat(self.impact, self.list[:-1]) if len(self.docs) else np.empty(0)
        size = np.diff(self.list)
        long = np.flatnonzero(size >= max(LONG_LEAST, self.n // LONG_SHARE))
        long = long[np.argsort(-size[long], kind="stable")][: LONG_BYTES // (8 * max(1, self.n))]
        self.column = np.full(len(size), -1)
        self.column[long] = np.arange(len(long))
        self.long = np.zeros((self.n, len(long)))
        for j, t in enumerate(long.tolist()):
            own = slice(self.list[t], self.list[t + 1])
            self.long[self.docs[own], j] = self.impact[own]
        self.peak = np.maximum.reduceat(self.long, np.arange(0, self.n, RANGE), axis=0) if self.n else self.long
        self.touched = 0

    def top(self, terms: np.ndarray, idf: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents of this shard and of ``best``, and their scores (rounded to 6 places, then smallest id)."""
        return self.tops([(terms, idf)], k, [best])[0]

    def tops(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int, best: list[tuple[np.ndarray, np.ndarray] | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """:meth:`top` of many queries. Those whose long lists can give most in the same places share their pivots."""
        weights = np.zeros((len(asked), self.long.shape[1]))
        for own, (terms, idf) in zip(weights, asked):
            column = self.column[terms]
            own[column[column >= 0]] = idf[column >= 0]
        peak = weights @ self.peak.T
        near = np.argsort(peak.argmax(1), kind="stable") if self.n else np.empty(0, np.int64)
        out = [x or (np.empty(0, np.int64), np.empty(0)) for x in best]
        for at in range(0, len(near), GROUP):
            own = near[at : at + GROUP]
            for q, found in zip(own.tolist(), self._group([asked[q] for q in own], weights[own], peak[own], k, [out[q] for q in own])):
                out[q] = found
        return out

    def _group(self, asked: list, weights: np.ndarray, peak: np.ndarray, k: int, best: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Block-max WAND for a group of queries at once.

        The k-th best score so far of a query is a bar that all its results reach. Cursors run through its short lists. A
        document is a pivot if, for a query of the group, its sum and the block maxima that the long lists have in its
        range reach the bar: only there are long lists entered, for all queries of the group, and the other documents are
        passed over. The documents with the highest bounds are scored ahead, which sets the bar; then pivots are taken in
        order of document, with bars that rise.
        """
        total, bars = np.zeros((len(asked), self.n)), np.full(len(asked), 2 * EPS)
        bound = np.repeat(peak, RANGE, axis=1)[:, : self.n]
        first = max(FIRST, 4 * k)
        for j, (terms, idf) in enumerate(asked):
            terms, idf = terms[self.column[terms] < 0], idf[self.column[terms] < 0]
            if len(best[j][1]) == k:
                bars[j] = max(bars[j], best[j][1][-1])
            if peak[j].max() + (idf * self.best[terms]).sum() + EPS < bars[j]:
                bound[j] = -1.0  # nothing here can reach the bar
                continue
            posts = _ranges(self.list[terms], self.list[terms + 1])
            total[j] = np.bincount(self.docs[posts], self.impact[posts] * np.repeat(idf, self.list[terms + 1] - self.list[terms]), self.n)
            self.touched += len(posts)
            bound[j] += total[j]
            bound[j] += EPS
            if self.n > first:
                high = np.argpartition(bound[j], self.n - first)[self.n - first :]
                score = total[j, high] + self.long[high] @ weights[j]
                bars[j] = max(bars[j], np.partition(score, first - k)[first - k])
        n_long, found = np.count_nonzero(weights, axis=1).sum(), list(best)
        for at in range(0, self.n, STEP):
            pivots = at + np.flatnonzero((bound[:, at : at + STEP] >= bars[:, None]).any(0))
            if not len(pivots):
                continue
            self.touched += int(len(pivots) * n_long)
            scores = weights @ self.long[pivots].T
            scores += total[:, pivots]
            for j, own in enumerate(scores):
                hit = np.flatnonzero(own >= bars[j] - EPS)
                score = own[hit].round(6)
                hit, score = hit[score > 0], score[score > 0]
                if len(hit):
                    ids, score = np.append(found[j][0], self.ids[pivots[hit]]), np.append(found[j][1], score)
                    order = np.lexsort((ids, -score))[:k]
                    found[j] = ids[order], score[order]
                    if len(order) == k:
                        bars[j] = max(bars[j], found[j][1][-1])
        return found


def build_index(docs: DataFrame) -> DataFrame:
    """Rows of one shard each: ``n, total, terms`` and, as bytes, ``ids, sizes, counts, docs, tf``.

    A shard is what a task reads next to each other, up to 8192 documents, 32 MB of text or half a million terms: nothing
    is shuffled, and no source or group fills a shard with more than its share.
    """
    def flush(ids: list, numbers: Numbers, found: list) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in found], np.int64)
        key = np.sort(np.concatenate(found).astype(np.int64) << 16 | np.repeat(np.arange(len(ids)), sizes))
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        tf = np.diff(np.append(start, len(key)))
        key = key[start]
        counts = np.bincount(key >> 16, minlength=len(numbers))
        lead = np.zeros(len(ids), np.int64)
        np.maximum.at(lead, key & 0xFFFF, tf << 32 | key >> 16)
        order = np.lexsort((sizes, lead & 0xFFFFFFFF))  # documents alike next to each other: their ranges have low maxima
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        key = key >> 16 << 16 | place[key & 0xFFFF]
        own = np.argsort(key)
        key, tf, ids, sizes = key[own], tf[own], np.array(ids, np.int64)[order], sizes[order]
        arrays = [ids, sizes, counts.astype(np.uint32), (key & 0xFFFF).astype(np.uint16), tf.astype(np.min_scalar_type(tf.max(initial=0)))]
        terms = pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), pa.array(list(numbers), pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([int(sizes.sum())]), terms, *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], ["n", "total", "terms", "ids", "sizes", "counts", "docs", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, numbers, found, size = [], Numbers(), [], 0
        for b in batches:
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                own = terms_of(text.as_py())
                ids.append(key)
                found.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)))
                size += sum(map(len, own)) + len(own)
                if len(ids) >= SHARD_DOCS or size > SHARD_BYTES or len(numbers) > SHARD_TERMS:
                    yield flush(ids, numbers, found)
                    ids, numbers, found, size = [], Numbers(), [], 0
        if ids:
            yield flush(ids, numbers, found)

    schema = "n long, total long, terms array<binary>, ids binary, sizes binary, counts binary, docs binary, tf binary"
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _counts(index: DataFrame) -> DataFrame:
    """``term, df`` in shards, one row for each term of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([b.column("terms")[k].values, pa.array(np.frombuffer(b.column("counts")[k].as_buffer(), np.uint32).astype(np.int64))], ["term", "df"])

    return index.select("terms", "counts").mapInArrow(run, "term binary, df long")


def _asked(queries: DataFrame, counts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``query_id, text_key`` and, for each distinct query text, ``text_key, asked`` with the df of its terms.

    A term of a third of all queries is dealt to 16 places, so that no task joins it alone.
    """
    own = scratch.write(queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"), "text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column("text_key"), b.column("text")):
                terms = list(dict.fromkeys(terms_of(text.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(terms), pa.string()), pa.array(terms, pa.binary())], ["text_key", "term"])

    terms = own.groupBy("text_key").agg(F.first("text").alias("text")).mapInArrow(parse, "text_key string, term binary")
    terms = scratch.write(terms.withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(SALTS)).cast("int")))
    df = counts.groupBy("term").agg(F.sum("df").alias("df")).join(terms.select("term").distinct(), "term", "left_semi")
    df = df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = terms.join(df, ["term", "salt"]).groupBy("text_key").agg(F.collect_list(F.struct("term", "df")).alias("asked"))
    return own.select("query_id", "text_key"), scratch.write(asked.withColumn("size", F.aggregate("asked", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x.term) + 16)))


class Block:
    """Distinct queries as tasks get them, once each: their terms as numbers into the block's dictionary, with its idf."""

    def __init__(self, asked: pa.Table, n: int):
        lists = asked.column("asked").combine_chunks()
        flat = lists.flatten()
        code = flat.field("term").dictionary_encode()
        self.keys, self.terms = asked.column("text_key").to_pylist(), code.dictionary
        self.edges, self.codes = lists.offsets.to_numpy() - lists.offsets[0].as_py(), code.indices.to_numpy()
        df = np.zeros(len(self.terms))
        df[self.codes] = flat.field("df").to_numpy()
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))


def _find(sent: Broadcast[Block], mean: float, k: int):
    """The k best documents of a task's shards for each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = sent.value, {}
        for b in batches:
            for row in range(b.num_rows):
                raw = lambda c, kind: np.frombuffer(b.column(c)[row].as_buffer(), kind)  # noqa: B023, E731
                docs = raw("docs", np.uint16)
                shard = Shard(raw("ids", np.int64), raw("sizes", np.int64), raw("counts", np.uint32), docs, np.frombuffer(tf := b.column("tf")[row].as_buffer(), f"u{tf.size // max(1, len(docs)) or 1}"), mean)
                place = pc.fill_null(pc.index_in(block.terms, value_set=b.column("terms")[row].values), -1).to_numpy()
                for at in range(0, len(block.keys), MANY):
                    many = range(at, min(at + MANY, len(block.keys)))
                    own = [block.codes[block.edges[q] : block.edges[q + 1]] for q in many]
                    own = [c[place[c] >= 0] for c in own]
                    best.update(zip(many, shard.tops([(place[c], block.idf[c]) for c in own], k, [best.get(q) for q in many])))
        if best:
            many = [len(best[q][0]) for q in range(len(block.keys))]
            yield pa.RecordBatch.from_arrays([pa.array([key for key, m in zip(block.keys, many) for _ in range(m)], pa.string()), *(pa.array(np.concatenate([best[q][c] for q in range(len(block.keys))])) for c in (0, 1))], ["text_key", "doc_id", "score"])

    return run


def search(spark: SparkSession, docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, doc_id, score``: for each row of ``queries(query_id, text)`` the k best of all documents.

    BM25 (k1 1.2, b 0.75, idf ln(1 + (N - df + 0.5) / (df + 0.5))) over the distinct terms of the whole query text, with N, df and the
    mean length of all documents. Ranked by score, rounded to 6 places, then doc_id. Documents that share no term
    with a query are not given, so a query may have fewer than k rows; null and empty texts match nothing. Rows with
    a null id are left out; repeated rows are documents of their own. An empty table gives no rows; other columns are
    not looked at. Queries with the same text are searched once.

    Distinct queries are taken in blocks of about 32 MB, packed to a quarter of that. Each block is sent to every
    executor once, and every task takes its shards one after the other with the bar that the earlier ones have set; k
    rows a query and task go on.
    """
    scratch = Scratch(spark, "search")
    index = scratch.write(build_index(docs))
    n, total = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    mean = max(total / max(n, 1), 1e-9)
    own, asked = _asked(queries, _counts(index), scratch)
    size = asked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = max(1, -(-size // QUERY_BYTES))
    part = F.pmod(F.xxhash64("text_key"), F.lit(blocks))

    found = None
    for j in range(blocks):
        block = spark.sparkContext.broadcast(Block(asked.where(part == j).select("text_key", "asked").toArrow(), n))
        got = scratch.write(index.select("terms", "ids", "sizes", "counts", "docs", "tf").mapInArrow(_find(block, mean, k), "text_key string, doc_id long, score double"))
        block.unpersist()
        found = got if found is None else found.unionByName(got)
    rank = Window.partitionBy("text_key").orderBy(F.desc("score"), "doc_id")
    best = scratch.write(found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k))
    scratch.free(index, asked)
    return own.join(best, "text_key").select("query_id", "rank", "doc_id", "score")
