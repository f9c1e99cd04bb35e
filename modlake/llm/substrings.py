"""Substring dedup with fixed-block anchors: aligned blocks are indexed, every rolling window probes them, and hits
are extended to maximal repeats of whole windows."""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, among, frugal, mix, rolling, unlike

WINDOW = 13
CHUNK_BITS = 11  # documents of a chunk: 2048
PROBES = 1_000_000  # that one bucket is meant to hold
PART = 3_000_000  # probes held by a task before it sends them
SLICE = 1 << 20  # bytes of text gone through at once, but for one longer text
LONG = 64  # bytes of a word that are digested eight at a time for all words at once; longer words go one by one

#: What the first pass leaves of a document or chunk.
_DONE, _PENDING, _WINDOWS = 0, 1, 2


class Anchors:
    """Hashes of blocks, kept to ``32 + bits`` bits: the top ``bits`` choose the bucket, 32 stand in it.

    A window of w words holds a whole aligned block of (w + 1) // 2 words wherever it starts. The number of buckets
    follows the input, and so does the number of bits; a chance hit costs a look at a window and nothing else.
    """

    def __init__(self, window: int, bits: int):
        self.window, self.block, self.bits = window, (window + 1) // 2, bits

    def rolled(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the rolling blocks of documents that have a window, and which places begin one."""
        at = np.flatnonzero((words.left >= self.block) & (words.n >= self.window)[words.of])
        return rolling(words.hashes, self.block)[at] >> np.uint64(32 - self.bits), at

    def short(self, windows: np.ndarray) -> np.ndarray:
        """The 32 bits of window hashes behind those that choose the bucket."""
        return (windows >> np.uint64(32 - self.bits)).astype(np.uint32)

    def placed(self, windows: np.ndarray) -> np.ndarray:
        """Bucket and short hash as one number."""
        return windows >> np.uint64(32 - self.bits)

    def candidates(self, words: Words, hits: Places) -> np.ndarray:
        """Starts of the windows around the hits."""
        rolled, at = self.rolled(words)
        hit = np.zeros(len(words), bool)
        hit[at[hits.of(rolled) >= 0]] = True
        return np.flatnonzero(_near(hit, 0, self.window - self.block) & (words.left >= self.window))


class Words:
    """The words of some documents, one after the other, as places in the bytes of their texts; of a null text none."""

    def __init__(self, text: pa.Array):
        text = pc.fill_null(text.cast(pa.string()), "")
        edge = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset) if len(text) else np.zeros(1, np.int32)
        data = text.buffers()[2]
        self.raw = np.zeros(int(edge[-1] - edge[0]) + 8, np.uint8)  # eight more, so that eight can be read anywhere
        if data is not None:
            self.raw[:-8] = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]]
        edge = edge - edge[0]
        inside = ~_BLANK[self.raw[:-8]]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        own = edge[:-1][np.diff(edge) > 0]  # two texts without a blank between them are no single word
        begin[own] = inside[own]
        end[own[1:] - 1] = inside[own[1:] - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        last = np.searchsorted(self.start, edge[1:])
        self.n = np.diff(last, prepend=0)  # words of each document
        self.of = np.repeat(np.arange(len(text)), self.n)
        self.left = last[self.of] - np.arange(len(self.of))  # words from each to the end of its document

    def __len__(self) -> int:
        return len(self.start)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return self.digests(0, np.arange(len(self)))

    def digests(self, kind: int, at: np.ndarray) -> np.ndarray:
        """A 64-bit digest of each of the words at ``at``, 0 for the others; the two kinds are independent. Different
        words of one length up to eight bytes have different digests, others as good as random ones."""
        start, size = self.start[at], (self.end - self.start)[at]
        own = mix(size.astype(np.uint64) + _SEEDS[kind])
        eight = np.lib.stride_tricks.sliding_window_view(self.raw, 8)
        some, k = np.flatnonzero(size <= LONG), 0
        while len(some):
            block = eight[start[some] + k].view("<u8").ravel() & _MASKS[np.minimum(size[some] - k, 8)]
            own[some] = mix(own[some] ^ block if kind == 0 else own[some] + block * _SEEDS[0])
            k += 8
            some = some[size[some] > k]
        for j in np.flatnonzero(size > LONG).tolist():
            own[j] = xxhash.xxh3_64_intdigest(self.raw[start[j] : start[j] + size[j]], int(_SEEDS[kind]))
        out = np.zeros(len(self), np.uint64)
        out[at] = own
        return out

    def checks(self, at: np.ndarray, window: int) -> np.ndarray:
        """A second number of each window, from digests of its words apart from those of the first."""
        begin = np.zeros(len(self), bool)
        begin[at] = True
        return rolling(self.digests(1, np.flatnonzero(_near(begin, window - 1, 0))), window)[at].astype(np.uint32)

    def kept(self, keep: np.ndarray) -> list[memoryview]:
        """For each document the bytes of the words to keep, with one space between."""
        start, end, of = self.start[keep], self.end[keep], self.of[keep]
        apart = end[:-1][of[1:] == of[:-1]]  # a blank stands there, since a word of the same text follows
        step = np.zeros(len(self.raw), np.int8)
        step[start] = 1
        step[end] -= 1
        take = np.cumsum(step, dtype=np.int8).view(bool)
        take[apart] = True
        raw = self.raw.copy()
        raw[apart] = 32
        out = memoryview(raw[take])
        n = np.bincount(of, minlength=len(self.n))
        edge = np.cumsum(np.bincount(of, end - start + 1, minlength=len(self.n)).astype(np.int64) - (n > 0)).tolist()
        return [out[a:b] for a, b in zip([0, *edge], edge)]


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _near(flags: np.ndarray, before: int, after: int) -> np.ndarray:
    """For each place whether a flag stands there, up to ``before`` places before it or up to ``after`` behind it."""
    n = np.cumsum(flags, dtype=np.int32)
    n = np.concatenate([np.zeros(before + 1, np.int32), n, np.full(after, n[-1] if len(n) else 0, np.int32)])
    return n[before + 1 + after :] > n[: len(flags)]


class Places:
    """Places in a sorted array without repeats, for many values in any order: by a table of slots, and by search where
    two share a slot."""

    def __init__(self, among: np.ndarray):
        self.among, self.width = among, np.uint64(61 - len(among).bit_length())
        own, place = self._slot(among), np.arange(len(among), dtype=np.int32)
        self.table = np.full(1 << 64 - int(self.width), -1, np.int32)
        self.table[own] = place
        self.lost = np.flatnonzero(self.table[own] != place)
        self.shared = np.zeros(len(self.table), bool)
        self.shared[own[self.lost]] = True

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return (values * _SEEDS[0] >> self.width).astype(np.int64)

    def of(self, values: np.ndarray) -> np.ndarray:
        """For each value its place, or -1."""
        if not len(self.among):
            return np.full(len(values), -1)
        slot = self._slot(values)
        at = self.table[slot]
        at[self.among[at] != values] = -1
        again = np.flatnonzero((at < 0) & self.shared[slot])
        if len(again):
            place = _found(values[again], self.among[self.lost])
            at[again] = np.where(place < 0, -1, self.lost[place])
        return at


def _found(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each value its place in a sorted array, or -1."""
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[at] == values, at, -1)


def _packed(values: np.ndarray) -> bytes:
    """Ascending 32-bit values as their steps, three bytes each where all steps fit; the first byte says which."""
    steps = np.diff(values, prepend=np.uint32(0))
    if len(steps) and steps.max() >> 24:
        return b"\4" + values.astype("<u4").tobytes()
    return b"\3" + steps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1)
    if data[0] == 4:
        return raw.view("<u4")
    steps = np.zeros((len(raw) // 3, 4), np.uint8)
    steps[:, :3] = raw.reshape(-1, 3)
    return np.cumsum(steps.view("<u4").ravel(), dtype=np.uint32)


def _probe(anchors: Anchors, window: int):
    """Per chunk and bucket: the distinct hashes of all rolling blocks; of each, whether it is an aligned one (that is
    the index) and whether two documents have it."""

    def flush(chunk: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key = np.sort(np.concatenate(held))
        block = key >> np.uint64(CHUNK_BITS + 1)
        start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        end = np.append(start[1:], len(key)) - 1
        aligned = np.bitwise_or.reduceat(key & np.uint64(1), start).astype(bool)
        several = (key[start] ^ key[end]) >> np.uint64(1) != 0
        block = block[start]
        bucket = (block >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(bucket)]
        rows = [(int(bucket[a]), chunk, _packed(block[a:b].astype(np.uint32)), np.packbits(aligned[a:b]).tobytes(), np.packbits(several[a:b]).tobytes()) for a, b in zip(edges, edges[1:])]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "chunk", "probes", "aligned", "several"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, chunk = [], 0, None
        for b in batches:
            for own, part in _slices(b):
                if own != chunk or size > PART:
                    yield from flush(chunk, held)
                    held, size, chunk = [], 0, own
                part = part.filter(pc.and_(part.column("text").is_valid(), part.column("doc_id").is_valid()))
                words = Words(part.column("text"))
                rolled, at = anchors.rolled(words)
                if len(rolled):
                    key = rolled << np.uint64(CHUNK_BITS + 1) | (part.column("at").to_numpy().astype(np.uint64) << np.uint64(1))[words.of[at]]
                    key |= ((words.n[words.of] - words.left)[at] % anchors.block == 0).astype(np.uint64)
                    held.append(key)
                    size += len(key)
        yield from flush(chunk, held)

    return run


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """In one bucket: the hashes that are an aligned block somewhere and that two documents have, for each chunk its own."""
    probes = [_unpacked(p) for p in pdf["probes"]]
    bits = lambda c: np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(pdf[c], probes)])
    key = np.concatenate(probes, dtype=np.uint64)
    key <<= np.uint64(2)
    key |= bits("aligned") << np.uint8(1) | bits("several")
    key.sort()
    value = key >> np.uint64(2)
    start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    hit = (np.bitwise_or.reduceat(key & np.uint64(2), start) > 0) & (np.add.reduceat(1 + (key & np.uint64(1)).astype(np.int64), start) > 1)
    hits = value[start[hit]].astype(np.uint32)
    if not len(hits):
        return pd.DataFrame({"chunk": [], "hits": []})
    top = np.uint64(int(pdf["bucket"].iloc[0]) << 32)
    own = [p[_found(p, hits) >= 0] for p in probes]
    out = [(c, (o.astype(np.uint64) | top).tobytes()) for c, o in zip(pdf["chunk"], own) if len(o)]
    return pd.DataFrame(out, columns=["chunk", "hits"])


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges, one after the other, and whose range each is of."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - (np.cumsum(n) - n)[of] + start[of], of


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows in a row of one chunk, with SLICE bytes of text at most, or one longer text more."""
    chunk = batch.column("chunk").to_numpy()
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().cumsum(dtype=np.int64) // SLICE
    start = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (size[1:] != size[:-1]))) if len(chunk) else np.empty(0, np.int64)
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(chunk)]):
        yield int(chunk[a]), batch.slice(a, b - a)


def _closed(part: pa.RecordBatch) -> bytes:
    """Documents as they are sent and kept between the passes: about half the bytes that the block codecs need."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(part)
    return sink.getvalue().to_pybytes()


def _opened(docs: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(docs).read_next_batch()


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for chunk, part in _slices(b):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_closed(part.select(["at", "doc_id", "text"]))], pa.binary())], ["chunk", "docs"])


def _sha256(kept: list[memoryview]) -> list[str]:
    return [hashlib.sha256(k).hexdigest() for k in kept]


def _extend(anchors: Anchors, digests: bool):
    """For one chunk: hashes of the windows around hits, with the smallest and largest of its documents that have each."""

    def run(docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        chunk, rows, sent = int(docs["chunk"].iloc[0]), [], []
        known = Places(np.unique(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(h, np.uint64) for h in hits["hits"])])))
        for part in map(_opened, docs["docs"]):
            words, ids = Words(part.column("text")), part.column("doc_id")
            at = anchors.candidates(words, known)
            at = at[ids.is_valid().to_numpy(zero_copy_only=False)[words.of[at]]]
            pending = np.zeros(len(part), bool)
            if len(at):
                pending[words.of[at]] = True
                sent.append((rolling(words.hashes, anchors.window)[at], words.checks(at, anchors.window), pc.fill_null(ids, 0).to_numpy()[words.of[at]]))
                rows.append((_PENDING, chunk, *[None] * 4, _closed(part.filter(pa.array(pending))), *[None] * 6))
            kept = _sha256(words.kept(~pending[words.of])) if digests else [None] * len(part)
            done = zip(part.column("at").to_pylist(), ids.to_pylist(), words.n.tolist(), kept, pending.tolist())
            rows += [(_DONE, chunk, at_, doc, n, k, *[None] * 7) for at_, doc, n, k, p in done if not p]
        if sent:
            window, check, of = (np.concatenate(x) for x in zip(*sent))
            order = np.argsort(window)
            if ((window[order[1:]] == window[order[:-1]]) & (check[order[1:]] != check[order[:-1]])).any():
                order = np.lexsort((check, window))
            window, check, of = window[order], check[order], of[order]
            start = np.flatnonzero(np.append(True, (window[1:] != window[:-1]) | (check[1:] != check[:-1])))
            window, check, low, high = window[start], check[start], np.minimum.reduceat(of, start), np.maximum.reduceat(of, start)
            bucket = (window >> np.uint64(64 - anchors.bits)).astype(np.int64)
            for m in np.split(np.arange(len(window)), np.flatnonzero(np.diff(bucket)) + 1):
                names, place = np.unique(np.concatenate([low[m], high[m]]), return_inverse=True)
                place = place.astype(np.uint16).reshape(2, -1)
                low_, more = place[0], place[0] ^ place[1]  # mostly the same: then it takes no room
                rows.append((_WINDOWS, chunk, *[None] * 5, int(bucket[m[0]]), anchors.short(window[m]).tobytes(), check[m].tobytes(), low_.tobytes(), more.tobytes(), zlib.compress(names, 1)))
        return pd.DataFrame(rows, columns=["what", "chunk", "at", "doc_id", "n_words", "kept_sha256", "docs", "bucket", "windows", "checks", "low", "high", "names"], dtype=object).astype({"at": "Int32", "doc_id": "Int64", "n_words": "Int64", "bucket": "Int64"})

    return run


def _least(pdf: pd.DataFrame) -> pd.DataFrame:
    """In one bucket of windows: for each chunk those that start in a document smaller than one of its own."""
    parts = [[np.frombuffer(x, t) for x in pdf[c]] for c, t in (("windows", np.uint32), ("checks", np.uint32), ("low", np.uint16), ("high", np.uint16))]
    parts.append([np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["names"]])
    window, check = np.concatenate(parts[0]), np.concatenate(parts[1])
    low = np.concatenate([n[i] for n, i in zip(parts[4], parts[2])])
    high = np.concatenate([n[i ^ j] for n, i, j in zip(parts[4], parts[2], parts[3])])
    order = np.lexsort((check, window))
    value, other = window[order], check[order]
    start = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (other[1:] != other[:-1])))
    least = np.empty(len(window), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], start), np.diff(np.append(start, len(value))))
    use = least < high
    out, at = [], 0
    for chunk, w in zip(pdf["chunk"], parts[0]):
        m = slice(at, at + len(w))
        at += len(w)
        if use[m].any():
            names, place = np.unique(least[m][use[m]], return_inverse=True)
            place = place.astype(np.min_scalar_type(len(names)))
            out.append((chunk, int(pdf["bucket"].iloc[0]), window[m][use[m]].tobytes(), check[m][use[m]].tobytes(), place.tobytes(), zlib.compress(names, 1)))
    return pd.DataFrame(out, columns=["chunk", "bucket", "windows", "checks", "first", "names"])


def _unpack_known(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows with their bucket in front, checks and first documents of one row that _least gave."""
    window, names = np.frombuffer(row.windows, np.uint32), np.frombuffer(zlib.decompress(row.names), np.int64)
    place = np.frombuffer(row.first, f"u{len(row.first) // len(window)}")
    return window.astype(np.uint64) | np.uint64(row.bucket << 32), np.frombuffer(row.checks, np.uint32), names[place]


def _cut(anchors: Anchors, digests: bool):
    """For one chunk: take out of each pending document the words of windows that start in a smaller one."""

    def run(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(known):
            window, check, first = (np.concatenate(x) for x in zip(*map(_unpack_known, known.itertuples())))
            order = np.argsort(window)
            window, check, first = window[order], check[order], first[order]
            start = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
            end, places = np.append(start[1:], len(window)), Places(window[start])
        for chunk, part in zip(docs["chunk"], map(_opened, docs["docs"])):
            words, ids = Words(part.column("text")), part.column("doc_id").to_numpy()
            gone = np.zeros(len(words), bool)
            if len(known):
                at = np.flatnonzero(words.left >= anchors.window)
                found = places.of(anchors.placed(rolling(words.hashes, anchors.window)[at]))
                at, found = at[found >= 0], found[found >= 0]
                place, of = _ranges(start[found], end[found])
                same = (check[place] == words.checks(at, anchors.window)[of]) & (first[place] < ids[words.of[at]][of])
                gone[at[of[same]]] = True
                gone = _near(gone, anchors.window - 1, 0)
            removed = np.bincount(words.of[gone], minlength=len(part))
            kept = words.kept(~gone)
            kept = _sha256(kept) if digests else [str(k, "utf-8") if n else None for k, n in zip(kept, removed.tolist())]
            rows += zip([chunk] * len(part), part.column("at").to_pylist(), ids.tolist(), words.n.tolist(), removed.tolist(), kept)
        return pd.DataFrame(rows, columns=["chunk", "at", "doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, scratch: Scratch, window: int = WINDOW, digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """``chunk, at, doc_id, n_words, n_removed, kept`` per row of ``docs(chunk, at, doc_id, text)``; see numbered(). With it
    the written table that it reads.

    A word goes if a window of ``window`` words that covers it, in the same document, also starts in a document with
    a smaller doc_id. ``kept`` is what is left: its SHA-256 for every document if ``digests``, else its text for
    documents that lose words, null for the others.

    1. Each chunk sends the distinct hashes of its rolling blocks, 4 bytes each, to buckets; the aligned ones are the
       index. Buckets answer each chunk with its hits.
    2. Each chunk goes through its texts again: windows around hits are sent with the chunk's smallest and largest
       document; documents without hits are done.
    3. Buckets of windows answer with the smallest document of each, and pending documents are cut.

    A bucket's size follows from the number of buckets, not from the data: one passage in every document is one hash
    from each chunk. Blocks only find candidates; windows are told apart by bucket and 32 bits of a hash of their
    words' digests, and by 32 bits of a hash of second digests of them: 68 to 84 bits, and no pattern of words favours a
    collision. 128 bits are not affordable within the disk budget (README).
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(20, max(4, int(np.ceil(np.log2(max(1, total / 6 / PROBES))))))
    anchors = Anchors(window, bits)
    rows = docs.select("chunk", "at", "doc_id", "text")
    probes = rows.mapInArrow(frugal(_probe(anchors, window)), "bucket long, chunk long, probes binary, aligned binary, several binary")
    hits = probes.groupBy("bucket").applyInPandas(frugal(_meet), "chunk long, hits binary")
    schema = "what int, chunk long, at int, doc_id long, n_words long, kept_sha256 string, docs binary, bucket long, windows binary, checks binary, low binary, high binary, names binary"
    rows = rows.mapInArrow(frugal(_zipped), "chunk long, docs binary")
    first = scratch.write(rows.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInPandas(frugal(_extend(anchors, digests)), schema))
    windows = first.where(F.col("what") == _WINDOWS).select("bucket", "chunk", "windows", "checks", "low", "high", "names")
    known = windows.groupBy("bucket").applyInPandas(frugal(_least), "chunk long, bucket long, windows binary, checks binary, first binary, names binary")
    pending = first.where(F.col("what") == _PENDING).select("chunk", "docs")
    cut = pending.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(frugal(_cut(anchors, digests)), "chunk long, at int, doc_id long, n_words long, n_removed long, kept string")
    done = first.where(F.col("what") == _DONE).select("chunk", "at", "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("kept_sha256").alias("kept"))
    return done.unionByName(cut), first


def numbered(docs: DataFrame, scratch: Scratch, stored: bool) -> tuple[DataFrame, str, str]:
    """The documents with two more columns, named apart from theirs: their chunk and place among its up to 2048 rows.

    The rows of a stored Parquet table have a fixed place in their file. Others are written first, since a second
    reading could give them in another order.
    """
    n, chunk, at = unlike(docs.columns, "_n", "_chunk", "_at")
    if stored:
        place = F.col("_metadata.row_index")
        return docs.withColumns({chunk: F.xxhash64("_metadata.file_path", F.shiftright(place, CHUNK_BITS)), at: (place % (1 << CHUNK_BITS)).cast("int")}), chunk, at
    rows = scratch.write(docs.withColumn(n, F.monotonically_increasing_id()))
    return rows.withColumns({chunk: F.shiftright(n, CHUNK_BITS), at: (F.col(n) % (1 << CHUNK_BITS)).cast("int")}).drop(n), chunk, at


def substring_digests(spark: SparkSession, docs: DataFrame, window: int = WINDOW, stored: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row; see remove_repeats.

    Words are runs of anything but U+0020 and U+0009 to U+000D, unchanged. A null text has no words; texts of fewer
    than ``window`` words lose none; repeats inside one document or in rows with its own id do not count; rows with a
    null id lose nothing and count for nothing. doc_id is a whole number. An empty table gives no rows. ``stored`` says
    that ``docs`` is a Parquet table as Spark read it, which spares a copy of it.
    """
    scratch = Scratch(spark, "substrings")
    rows, chunk, at = numbered(docs, scratch, stored)
    rows = rows.select(F.col(chunk).alias("chunk"), F.col(at).alias("at"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(spark, rows, scratch, window, digests=True)[0].select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def drop_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, stored: bool = False) -> DataFrame:
    """All documents, with all columns; those that lose words get the others, joined by one space, as their text.

    Nulls, repeated rows and empty tables as in substring_digests. Only documents that may lose words are sent by
    place; the others stay where they are read.
    """
    scratch = Scratch(spark, "substrings")
    rows, chunk, at = numbered(docs, scratch, stored)
    (kept,) = unlike(rows.columns, "_kept")
    cut, first = remove_repeats(spark, rows.select(F.col(chunk).alias("chunk"), F.col(at).alias("at"), F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch, window)
    cut = scratch.write(cut.where("n_removed > 0").select(F.col("chunk").alias(chunk), F.col("at").alias(at), F.col("kept").alias(kept)))
    scratch.free(first)
    own = [F.col(f"`{c}`") for c in docs.columns]
    maybe = among(cut, chunk, at)(chunk, at)
    out = rows.where(maybe).hint("merge").join(cut, [chunk, at], "left").withColumn("text", F.coalesce(kept, "text"))
    return out.select(*own).unionByName(rows.where(~maybe).select(*own))
