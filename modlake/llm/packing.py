"""Bounded-space online best-fit packing of token sequences."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, frugal
from .tokens import byte_symbols

CAPACITY, OPEN_BINS, SHARD_TOKENS = 4096, 512, 1 << 25


class WordTokenizer:
    """Ids of a lower-casing BPE that never looks past a blank: words are encoded once and remembered."""

    WORDS = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merges = self.model.model
        #: Printable ASCII but "<", where special tokens begin, and composed Latin letters: lower-casing is one to one.
        self.plain = regex.compile("[!-;=-~À-ÖØ-öø-ÿ]+")
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        by_byte = byte_symbols()
        self.symbols = {c: "".join(by_byte[b] for b in chr(c).encode("utf-8")) for c in range(256)}
        self.parts = Remembered(self._part, self.WORDS)
        self.seen = Remembered(self._learn, self.WORDS)

    def _learn(self, word: str) -> bytes:
        """A word of plain letters is normalised and cut here, and its parts merged by the library's model; any other
        goes through the whole library."""
        if not self.plain.fullmatch(word):
            return np.array(self.model.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.parts.__getitem__, self.cut.findall(word.lower())))

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.merges.tokenize(part.translate(self.symbols))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def batch(self, texts: list[str | None]) -> list[bytes]:
        get = self.seen.__getitem__
        return [b"".join(map(get, (t or "").replace("\n", " ").split(" "))) for t in texts]


class Remembered(dict):
    """Ids of words; a new word is learnt when it is asked for."""

    def __init__(self, learn, limit: int):
        self.learn, self.limit = learn, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self[word] = self.learn(word)
        return ids


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece of at most ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32`` (and ``ids`` if asked for).

    A null or empty text is its end id alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        step = capacity * 4
        for b in batches:
            keys, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for at in range(0, len(texts), 500):  # so that ids of a few hundred texts are held at a time
                rows: list[tuple] = []
                for key, ids in zip(keys[at : at + 500], words.batch(texts[at : at + 500])):
                    ids += end
                    for p, s in enumerate(range(0, len(ids), step)):
                        own = ids[s : s + step]
                        rows.append((key, p, s // 4, len(own) // 4, zlib.crc32(own), own))
                cols = [list(c) for c in zip(*rows)]
                kinds = [b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                out = [pa.array(c, k) for c, k in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays(out if with_ids else out[:5], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class BestFit:
    """Open bins in lists by free space; a bitset of the spaces that have bins finds the tightest fit at once."""

    def __init__(self, capacity: int = CAPACITY, bins: int = OPEN_BINS):
        self.capacity, self.bins = capacity, bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask, self.n_open, self.made = 0, 0, 0

    def put(self, length: int) -> tuple[int, int]:
        """``(bin, offset)`` for a piece of 1 to ``capacity`` tokens."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            own = self._take(free)
        else:
            if self.n_open >= self.bins:  # the fullest closes
                self._take((self.mask & -self.mask).bit_length() - 1)
            own, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(own)
            self.mask |= 1 << left
            self.n_open += 1
        return own, self.capacity - free

    def _take(self, free: int) -> int:
        own = self.by_free[free].pop()
        self.n_open -= 1
        if not self.by_free[free]:
            self.mask ^= 1 << free
        return own

    def open_bins(self) -> set[int]:
        return {b for bins in self.by_free for b in bins}


def pack(spark: SparkSession, pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, bins: int = OPEN_BINS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces ``(doc_id, piece, start, length, ids_crc32)``.

    Pieces are dealt to shards of about ``shard_tokens`` tokens by a hash, so no source, key or run of lengths fills
    a shard; each shard packs its stream in hash order with ``bins`` open bins. What is in bins still open at the end
    of a shard is dealt once more to 1/32 as many shards, so the ends of shards waste next to nothing. ``pieces`` is
    read twice and should be a written table. Lengths are 1 to ``capacity``; repeated rows are packed each.
    """
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    kind = dict(pieces.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"

    def packer(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_order", "doc_id", "piece"], kind="stable")
            fit = BestFit(capacity, bins)
            put = [fit.put(n) for n in pdf["length"].tolist()]
            own = np.array([p[0] for p in put], np.int64)
            still = np.zeros(fit.made + 1, bool)
            still[list(fit.open_bins())] = True
            base = (level << 62) + (int(pdf["_shard"].iloc[0]) << 36)
            out = pdf.drop(columns=["_shard", "_order"])
            return out.assign(sequence_id=base + own, offset=[p[1] for p in put], open=still[own])
        return run

    def level(df: DataFrame, k: int, shards: int) -> DataFrame:
        order = F.xxhash64("doc_id", "piece", F.lit(k))
        dealt = df.select("doc_id", "piece", "start", "length", "ids_crc32", order.alias("_order")).withColumn("_shard", F.pmod(F.shiftright("_order", 7), F.lit(shards)).cast("int"))
        return dealt.groupBy("_shard").applyInPandas(packer(k), schema)

    shards = max(1, -(-total // shard_tokens))
    first = scratch.write(level(pieces, 0, shards))
    if shards == 1:
        return first.drop("open")
    second = level(first.where("open"), 1, -(-shards // 32))
    return first.where("not open").unionByName(second).drop("open")


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Tokenise whole documents, cut those longer than a sequence and pack all pieces.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null or empty texts are one end id;
    an empty table gives no rows; other columns are not looked at. Tokens themselves are not shuffled: only these
    narrow rows are. ``cut_pieces(..., with_ids=True)`` gives the ids to lay down in that order.
    """
    scratch = Scratch(spark, "packing")
    return pack(spark, scratch.write(cut_pieces(docs, vocabulary)), scratch, **options)
