"""Product-quantised vector codes: integer Lloyd rounds with Hamerly's bounds, exact to the last tie."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024

#: Integers up to here are exact as doubles. Where squared distances could pass it, components are Python integers.
_EXACT = 2.0**53
#: Sums leave a task in digits to this base, each of which fits a long.
_DIGIT = 1 << 56

_STATE = "vec_id {vec_id}, label {label}, embedding {embedding}, own array<smallint>, upper array<double>, lower array<double>"


def whole(rows: pa.Array, wide: bool) -> np.ndarray:
    """floor(1024 x) of each component of equally long vectors, ``[row, component]``: doubles, or Python integers if wide."""
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    if not wide:
        return np.floor(x * SCALE)
    out = np.empty(x.shape, object)
    for at, value in np.ndenumerate(x):
        top, bottom = value.as_integer_ratio()
        out[at] = top * SCALE // bottom
    return out


def distances(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances ``[part, entry]`` of integers, exact."""
    return (part * part).sum(1)[:, None] - 2 * part.dot(book.T) + (book * book).sum(1)[None, :]


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


class Codebook:
    """The entries of one part position and how far each moved in the last round."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries, self.wide = entries, entries.dtype == object
        if before is not None and not self.wide:
            step = entries - before
            self.moved = _up(np.sqrt((step * step).sum(1)))
            order = np.argsort(-self.moved, kind="stable")
            self.farthest = order[0]
            self.next_move = self.moved[order[1]] if len(order) > 1 else 0.0

    def scan(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry (the lowest index of equals), bounds of the distances to it and to the second nearest."""
        n = len(part)
        own, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
        for i in range(0, n, 4096):
            at = slice(i, i + 4096)
            d = distances(part[at], self.entries)
            own[at] = best = d.argmin(1)
            if self.wide:
                continue  # no bounds that doubles might not hold: such parts are scanned in each round
            rows = np.arange(len(d))
            upper[at] = _up(np.sqrt(d[rows, best]))
            d[rows, best] = np.inf
            lower[at] = _down(np.sqrt(d.min(1)))
        return own, upper, lower

    def carried(self, part: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Assignments and bounds after the entries moved; a part is scanned only if its bounds do not tell strictly.

        By the triangle inequality the own entry is at most ``upper + its move`` away and every other one at least
        ``lower - the largest move of another``. Bounds are rounded outwards, so upper < lower proves the own entry
        nearer than all others. Equal bounds prove nothing, as a tie goes to the lower index.
        """
        if self.wide:
            return self.scan(part)
        own = own.astype(np.int64)
        upper = _up(upper + self.moved[own])
        lower = _down(lower - np.where(own == self.farthest, self.next_move, self.moved[self.farthest]))
        loose = np.flatnonzero(upper >= lower)
        gap = part[loose] - self.entries[own[loose]]
        upper[loose] = _up(np.sqrt((gap * gap).sum(1)))
        loose = loose[upper[loose] >= lower[loose]]
        own[loose], upper[loose], lower[loose] = self.scan(part[loose])
        return own, upper, lower


def _list(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, width, dtype=np.int32), pa.array(values.ravel()))


def _rows(b: pa.RecordBatch, column: str) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(b), PARTS)


def assign(state: DataFrame, books: list[Codebook], schema: str) -> DataFrame:
    """The state with the entry of each part and its bounds brought up to date; all parts are scanned if it has none."""
    first, wide = "own" not in state.columns, books[0].wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            parts = np.split(whole(b.column("embedding"), wide), PARTS, axis=1)
            had = None if first else [_rows(b, c) for c in ("own", "upper", "lower")]
            new = [book.scan(x) if first else book.carried(x, *(h[:, p] for h in had)) for p, (book, x) in enumerate(zip(books, parts, strict=True))]
            own, upper, lower = (np.stack(columns, 1) for columns in zip(*new, strict=True))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "label", "embedding")), _list(own.astype(np.int16)), _list(upper), _list(lower)], ["vec_id", "label", "embedding", "own", "upper", "lower"])

    return state.mapInArrow(run, schema)


def means(state: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """Each entry replaced by the floor of its parts' mean; unused entries stay.

    A task sums its own rows, so it sends a row for each component of the codebooks at most, whatever it has read. The
    sums meet by component; the driver gets as many numbers as the codebooks have.
    """
    wide, (entries, width) = books[0].wide, books[0].entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), object)
        for b in batches:
            if not len(b):
                continue
            own = _rows(b, "own")
            for p, x in enumerate(np.split(whole(b.column("embedding"), wide), PARTS, axis=1)):
                used, place, n = np.unique(own[:, p], return_inverse=True, return_counts=True)
                total = np.zeros((len(used), width), object if wide else np.int64)
                np.add.at(total, place, x if wide else x.astype(np.int64))
                counts[p, used] += n
                sums[p, used] += total.astype(object)
        keys, digits = [], []
        for p, e in zip(*np.nonzero(counts), strict=True):
            for k in range(width):
                rest, place = sums[p, e, k], 0
                while True:
                    keys.append((p, e, k, place, counts[p, e]))
                    if -_DIGIT <= rest < _DIGIT:
                        digits.append(rest)
                        break
                    rest, digit = divmod(rest, _DIGIT)
                    digits.append(digit)
                    place += 1
        if keys:
            columns = [pa.array(c) for c in np.array(keys, np.int64).T]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digits, pa.int64())], ["part", "entry", "k", "place", "n", "total"])

    sent = state.select("own", "embedding").mapInArrow(run, "part long, entry long, k long, place long, n long, total long")
    met = sent.groupBy("part", "entry", "k", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    counts, sums = {}, {}
    for row in met.collect():
        if row["place"] == 0:
            counts[row["part"], row["entry"]] = row["n"]
        at = row["part"], row["entry"], row["k"]
        sums[at] = sums.get(at, 0) + int(row["total"]) * _DIGIT ** row["place"]
    out = [book.entries.copy() for book in books]
    for (p, e, k), total in sums.items():
        out[p][e, k] = total // counts[p, e]
    return [Codebook(new, book.entries) for new, book in zip(out, books, strict=True)]


def _measured(state: DataFrame, books: list[Codebook], kinds: dict[str, str]) -> DataFrame:
    """Codes, and the exact squared distance of each vector to what its code stands for (null if no long holds it)."""
    wide = books[0].wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            own, error = _rows(b, "own"), 0
            for p, x in enumerate(np.split(whole(b.column("embedding"), wide), PARTS, axis=1)):
                gap = x - books[p].entries[own[:, p]]
                error = error + (gap * gap).sum(1)
            code = [bytes(row).hex() for row in own.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code), pa.array([e if e < 1 << 63 else None for e in map(int, error)], pa.int64())], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def encode_vectors(spark: SparkSession, embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` for each vector that is kept.

    Components become floor(1024 x) and vectors are cut into 4 parts. Lloyd's rounds run in exact integers from the
    256 smallest vec_ids: each part goes to its nearest entry, the lower index of equals, by Hamerly's bounds where
    they tell strictly and a scan of the codebook otherwise; entries become floors of means.

    Vectors that are null or hold null or non-finite components are dropped, and so are those whose length is not that
    of the vector with the smallest vec_id, or no positive multiple of 4. Repeated rows are coded one by one and count as often in
    the means; a vec_id that several rows share gives one first entry, the smallest of their vectors. Rows with a null
    vec_id are coded but give none; if no row has a vec_id there are no entries and the result is empty. Fewer than 256
    ids give as many entries. ``error`` and ``label_error`` are exact, and null where no long holds them. Other columns
    are ignored.
    """
    kinds = dict(embeddings.dtypes)
    schema = _STATE.format(**kinds)
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % PARTS == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = embeddings.select("vec_id", "label", "embedding").where(F.coalesce(fine, F.lit(False)))
    empty = spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    ids = [r[0] for r in kept.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    if not ids:
        return empty
    dim = kept.where(F.col("vec_id") == F.lit(ids[0])).agg(F.min(F.struct(F.size(v).alias("dim"), v.alias("embedding")))["dim"]).first()[0]
    kept = kept.where(F.size(v) == dim)
    largest = kept.agg(F.max(F.greatest(F.array_max(v), -F.array_min(v)).cast("double"))).first()[0]
    wide = dim / PARTS * (2 * (largest * SCALE + 1)) ** 2 >= _EXACT if largest < 2.0**60 else True
    first = kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").toArrow()
    books = [Codebook(x) for x in np.split(whole(first["embedding"].combine_chunks(), wide), PARTS, axis=1)]

    scratch, state = Scratch(spark, "codes"), kept
    for _ in range(rounds):
        old, state = state, scratch.write(assign(state, books, schema))
        if old is not kept:
            scratch.free(old)
        books = means(state, books)
    old, state = state, assign(state, books, schema)
    rows = scratch.write(_measured(state, books, kinds))
    scratch.free(old)
    digest = hashlib.sha256(",".join(str(int(c)) for book in books for c in book.entries.ravel()).encode()).hexdigest()
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    held = F.when((F.count("*") == F.count("error")) & (total <= F.lit((1 << 63) - 1)), total.cast("long"))
    by_label = rows.groupBy("label").agg(held.alias("label_error")).select(F.col("label").alias("of"), "label_error")
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
