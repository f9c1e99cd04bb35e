"""Phrases that stand together more often than chance: suffix arrays of word ids per shard, counts merged by key."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

LEAST, LONGEST, TOP = 100, 5, 2000

#: Words of one suffix array. A longer text is gone through in several, each with the words that its last phrases need.
BLOCK = 1_000_000
#: Bytes of a text that are split into words at a time.
_CHUNK = 1 << 22

_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord("\n") if b in _DELIMITERS else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Stands between pieces. No word is a delimiter, so none is mistaken for it.
_BETWEEN = b"."
_GAP = re.compile(rb"[ \n]")


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text with ``_BETWEEN`` between pieces, a few megabytes at a time."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        cut = _GAP.search(text, at + _CHUNK)
        end = cut.start() if cut else len(text)
        yield text[at:end].replace(b"\n", b" . ").split(b" ")
        at = end


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` in the order of what starts there, by prefix doubling until ``depth`` words or all are told apart.

    Past the end stands id 0. Each round ranks by twice as many words: a pair of ranks is a number, sorted by numpy.
    """
    rank, known = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while known < depth and len(ids):
        after = np.zeros_like(rank)
        after[:-known] = rank[known:]
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([False], np.diff(key[order]) != 0)).cumsum() + 1
        rank = np.empty_like(rank)
        rank[order] = new
        if new[-1] == len(ids):
            break
        known *= 2
    return order


def intervals(ids: np.ndarray, starts: int, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(size, places, counts)``: each run of that many ids, none of them 0, that starts at one of the first ``starts`` places.

    In suffix order the runs that begin with the same words stand together: an interval in which neighbours share at
    least ``size`` words, its length the count.
    """
    ids = np.concatenate((ids, np.zeros(sizes.stop, ids.dtype)))
    order = suffix_order(ids, sizes.stop - 1)
    order = order[(order < starts) & (ids[order] != 0)]
    whole, shared = np.ones(len(order), bool), np.zeros(max(len(order) - 1, 0), np.int8)
    alike = np.ones(len(shared), bool)
    for k in range(sizes.stop - 1):
        word = ids[order + k]
        whole &= word != 0
        alike &= word[1:] == word[:-1]
        shared += alike
        if k + 1 in sizes:
            first = np.flatnonzero(np.concatenate(([True], shared < k + 1)) if len(order) else [])
            counts = np.diff(np.append(first, len(order)))
            real = whole[first]
            yield k + 1, order[first[real]], counts[real]


def _only_runs(ids: np.ndarray, least: int) -> np.ndarray:
    """The ids without runs between zeros that are shorter than ``least``, and with one zero between those that stay."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids != 0).view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    keep = np.zeros(len(ids) + 1, np.int8)
    keep[start[long]] += 1
    keep[np.minimum(end[long] + 1, len(ids))] -= 1  # a run and the zero after it
    return ids[keep[:-1].cumsum() > 0]


class _Shard:
    """Words of a shard as ids. 0 stands between pieces and for words that are too rare; texts of several languages share it."""

    def __init__(self, frequent: Callable[[int, bytes], bool]):
        self.frequent = frequent
        self.clear()

    def clear(self) -> None:
        self.names, self.langs, self.ids, self.arrays, self.n = [b""], [b""], {}, [], 0

    def add(self, lang: bytes, text: bytes) -> None:
        if lang not in self.ids:
            self.ids[lang] = _Ids(self, lang)
        of = self.ids[lang].__getitem__
        for words in tokens(text):
            self.arrays.append(np.fromiter(map(of, words), np.int32, len(words)))
            self.arrays[-1] = self.arrays[-1][self.arrays[-1] >= 0]
            self.n += len(self.arrays[-1])
        self.arrays.append(np.zeros(1, np.int32))
        self.n += 1

    def text(self) -> np.ndarray:
        return np.concatenate(self.arrays)


class _Ids(dict):
    def __init__(self, shard: _Shard, lang: bytes):
        super().__init__({b"": -1, _BETWEEN: 0})
        self.shard, self.lang, self.seed = shard, lang, seed_of(lang)

    def __missing__(self, word: bytes) -> int:
        own = 0
        if self.shard.frequent(self.seed, word):
            own = len(self.shard.names)
            self.shard.names.append(word)
            self.shard.langs.append(self.lang)
        self[word] = own
        return own


def seed_of(lang: bytes) -> int:
    return xxhash.xxh64_intdigest(lang, 42)


def bitmap(rows: DataFrame, most_bits: int = 26) -> Callable[[int, bytes], bool]:
    """Whether a phrase may be among ``rows(lang, phrase)``, by seed of its language; it misses none.

    A bitmap by hash with 16 bits a row, 8 MB at most whatever the input. A fuller one lets more phrases through, which
    the exact counts then drop: more rows are shuffled, the result is the same.
    """
    bits = 1 << min(most_bits, max(10, (16 * rows.count()).bit_length()))
    h = F.pmod(F.xxhash64("lang", "phrase"), F.lit(bits))
    got = rows.select(h.alias("h")).groupBy(F.shiftright("h", 3).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1, cast(pmod(h, 8) as int)))").alias("b")).toArrow()
    words = bytearray(bits // 8)
    for w, b in zip(got["w"].to_pylist(), got["b"].to_pylist(), strict=True):
        words[w] = b
    sent, digest = rows.sparkSession.sparkContext.broadcast(bytes(words)), xxhash.xxh64_intdigest

    def may_be(seed: int, phrase: bytes) -> bool:
        h = digest(phrase, seed) & (bits - 1)
        return sent.value[h >> 3] >> (h & 7) & 1 == 1

    return may_be


def _blocks(texts: DataFrame, per_block: Callable[[_Shard], Iterator[pa.RecordBatch]], frequent: Callable[[int, bytes], bool]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(frequent)
        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
                shard.add(lang.as_py(), text.as_py())
                if shard.n >= BLOCK:
                    yield from per_block(shard)
                    shard.clear()
        if shard.n:
            yield from per_block(shard)

    return _summed(texts.mapInArrow(run, "lang binary, phrase binary, n long"))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def _sent(shard: _Shard, ids: np.ndarray, sizes: range) -> Iterator[pa.RecordBatch]:
    """Counts of the shard's runs of ids, in suffix arrays of BLOCK places at most."""
    names, langs = pa.array(shard.names, pa.binary()), pa.array(shard.langs, pa.binary())
    for at in range(0, len(ids), BLOCK):
        part = ids[at : at + BLOCK + sizes.stop - 2]
        for size, places, counts in intervals(part, min(BLOCK, len(part)), sizes):
            for i in range(0, len(places), 100_000):
                some = places[i : i + 100_000]
                words = [names.take(pa.array(part[some + k])) for k in range(size)]
                phrase = pc.binary_join_element_wise(*words, b" ") if size > 1 else words[0]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(part[some])), phrase, pa.array(counts[i : i + 100_000])], ["lang", "phrase", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """``(lang, phrase, f)`` of all single words, and of each language's number of words under a null phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, Counter] = {}
        totals: Counter = Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                del own[b""], own[_BETWEEN]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.binary()), pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())], ["lang", "phrase", "n"])
            counts.clear()

        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
                lang = lang.as_py()
                for words in tokens(text.as_py()):
                    own = counts.setdefault(lang, Counter({b"": 0, _BETWEEN: 0}))
                    own.update(words)
                    totals[lang] += len(words) - words.count(b"") - words.count(_BETWEEN)
                    if sum(map(len, counts.values())) > 300_000:
                        yield from sent()
        yield from sent()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.binary()), pa.nulls(len(totals), pa.binary()), pa.array(totals.values(), pa.int64())], ["lang", "phrase", "n"])

    return _summed(texts.mapInArrow(run, "lang binary, phrase binary, n long"))


def pair_counts(texts: DataFrame, frequent_word: Callable[[int, bytes], bool]) -> DataFrame:
    """``(lang, phrase, f)`` of all pairs of words that may be frequent themselves."""
    return _blocks(texts, lambda shard: _sent(shard, _only_runs(shard.text(), 2), range(2, 3)), frequent_word)


def long_counts(texts: DataFrame, frequent_word: Callable[[int, bytes], bool], frequent_pair: Callable[[int, bytes], bool], longest: int) -> DataFrame:
    """``(lang, phrase, f)`` of all phrases of three words or more each pair of which may be frequent."""

    def per_block(shard: _Shard) -> Iterator[pa.RecordBatch]:
        ids, names, langs = _only_runs(shard.text(), 3), shard.names, shard.langs
        pair = ids[:-1].astype(np.int64) << 32 | ids[1:]
        distinct, which = np.unique(pair, return_inverse=True)
        seeds = {lang: seed_of(lang) for lang in shard.ids}
        good = np.fromiter((a > 0 < b and frequent_pair(seeds[langs[a]], names[a] + b" " + names[b]) for a, b in zip((distinct >> 32).tolist(), (distinct & 0xFFFFFFFF).tolist(), strict=True)), bool, len(distinct))[which]
        if good.any():
            out = np.zeros(2 * len(ids), ids.dtype)  # a zero between words whose pair is not frequent
            out[::2] = ids
            keep = np.ones(len(out), bool)
            keep[1:-2:2] = ~good
            yield from _sent(shard, _only_runs(out[keep], 3), range(3, longest + 1))

    return _blocks(texts, per_block, frequent_word)


def frequent_phrases(spark: SparkSession, docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, size, f)`` of all phrases of up to ``longest`` words that occur ``least`` times, and ``(lang, n)``.

    What occurs that often is made of words and pairs that do. So pairs are counted among frequent words, longer
    phrases among frequent pairs, each count exact over all documents.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    words = scratch.write(word_counts(texts).where((F.col("f") >= least) | F.col("phrase").isNull()))
    totals = words.where("phrase is null").select("lang", F.col("f").alias("n"))
    words = words.where("phrase is not null")
    frequent_word = bitmap(words)
    pairs = scratch.write(pair_counts(texts, frequent_word).where(F.col("f") >= least))
    long = scratch.write(long_counts(texts, frequent_word, bitmap(pairs), longest).where(F.col("f") >= least)) if longest > 2 else pairs.limit(0)
    every = words.unionByName(pairs).unionByName(long)
    return every.withColumn("size", F.size(F.split("phrase", " "))).select("lang", "phrase", "size", "f"), totals


def mine_phrases(spark: SparkSession, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` collocations.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and U+000A to U+000D and into words at blanks and tabs. A
    phrase of 2 to ``longest`` words that occurs a times, ``least`` or more, is a candidate; a cut after its first k
    words, whose parts occur l and r times, scores floor(1000 a n / (l r)); the lowest counts, the smallest k of equals.
    A candidate inside a longer one that occurs as often is dropped. Equal scores rank by a, then by the phrase's bytes.

    A null text is empty, a null language ``und``. Repeated rows count as often as they stand. A language
    without candidates has no rows; empty tables give none. Other columns are ignored.
    """
    scratch = Scratch(spark, "phrases")
    every, totals = frequent_phrases(spark, docs, scratch, least, longest)
    cut = every.where("size > 1").withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    part = lambda name, count: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    parts = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = parts.withColumn("score", F.expr("(1000BD * cast(f as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "f", "n")).alias("best"))
    # a longer phrase that occurs as often has one more word or contains one that does, which is a candidate too
    inner = every.where("size > 2").select("lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    alone = best.select("lang", "phrase", F.col("best.f").alias("f"), "best").join(inner.distinct(), ["lang", "phrase", "f"], "left_anti")
    out = alone.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each of many shares of a language, then the first of those: no task has a whole language
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))).orderBy(*order)
    out = out.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
