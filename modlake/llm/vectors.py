"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components

TABLES, FUNCTIONS, CELL, BAR = 12, 2, 2048, 0.93


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the number of columns is a power of two. Orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def signature(x: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, seed: int = 7) -> np.ndarray:
    """``[row, table, function, 2]``: nearest and second nearest vertex of the cross-polytope after a pseudo-random rotation.

    A rotation is three rounds of random signs and a Hadamard transform. Vertex 2i is the i-th axis, 2i + 1 its opposite.
    """
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    signs = np.random.default_rng(seed).integers(0, 2, (tables, functions, 3, size)) * 2.0 - 1.0
    out = np.empty((n, tables, functions, 2), np.int32)
    for t in range(tables):
        for f in range(functions):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t, f, r])
            size_of = np.abs(y)
            two = np.argpartition(-size_of, 1, axis=1)[:, :2]
            swap = np.take_along_axis(size_of, two, 1)
            two = np.where((swap[:, :1] < swap[:, 1:]), two[:, ::-1], two)
            out[:, t, f] = 2 * two + (np.take_along_axis(y, two, 1) < 0)
    return out


def _probes(sig: np.ndarray, base: int) -> np.ndarray:
    """``[row, table, probe]`` bucket numbers, the own one first: each function by its first or second vertex."""
    out = np.zeros((*sig.shape[:2], 1), np.int64)
    for f in range(sig.shape[2]):
        out = (out[:, :, None, :] * base + sig[:, :, f, :, None]).reshape(*sig.shape[:2], 2 ** (f + 1))
    return out


def _usable(embeddings: DataFrame) -> DataFrame:
    v = F.col("embedding")
    good = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return embeddings.where(F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull())


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow below
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def candidates(vectors: DataFrame, tables: int, functions: int) -> DataFrame:
    """Rows ``(group, dim, label, table, bucket, probe, id, sig, embedding)``: each vector in its own bucket and those it probes."""
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs, labels = b.column("vec_id"), b.column("embedding"), b.column("label")
            sizes = np.array([len(v) for v in vecs])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                for part in np.array_split(at, max(1, len(at) // 1000)):
                    x = _unit([vecs[i].as_py() for i in part])
                    base = 4 * (1 << max(1, (int(d) - 1).bit_length()))
                    sig = signature(x, tables, functions)
                    probes = _probes(sig, base)
                    n, _, p = probes.shape
                    where = pa.array(np.repeat(part, tables * p))
                    yield pa.RecordBatch.from_arrays(
                        [labels.take(where), pa.array(np.full(n * tables * p, d, np.int32)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), p), n)), pa.array(probes.ravel()), pa.array(np.tile(np.arange(p, dtype=np.int32), n * tables)), ids.take(where)],
                        ["label", "dim", "tab", "bucket", "probe", "vec_id"],
                    )

    return vectors.select("vec_id", "embedding", "label").mapInArrow(run, f"label {kinds['label']}, dim int, tab int, bucket long, probe int, vec_id {kinds['vec_id']}")


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that the links i-j connect it with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root = root[root]
        if (before == root).all():
            return root


def _pairs(x: np.ndarray, group: np.ndarray, stored: np.ndarray, bar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (probing, stored) of one group with cosine >= bar; rows are sorted by group, stored ones first.

    Small groups are gone through together, 50,000 pairs at a time; large ones by products of blocks.
    """
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(starts, len(group)))
    held = np.add.reduceat(stored.astype(np.int64), starts)
    big = held * (sizes - held) > 200_000
    for g in np.flatnonzero(big):
        s, q = np.arange(starts[g], starts[g] + held[g]), np.arange(starts[g] + held[g], starts[g] + sizes[g])
        for at in range(0, len(q), 512):
            for to in range(0, len(s), 2048):
                qs, ss = q[at : at + 512], s[to : to + 2048]
                i, j = np.nonzero(x[qs] @ x[ss].T >= bar - 1e-9)
                yield _exact(x, qs[i], ss[j], bar)
    of = np.repeat(np.arange(len(starts)), sizes)
    q = np.flatnonzero(~stored & ~big[of] & (held[of] > 0))
    many = held[of[q]]
    ends = np.cumsum(many)
    at = 0
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 50_000, "right")))
        k = many[at:to]
        i = np.repeat(q[at:to], k)
        j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts[of[q[at:to]]], k)
        yield _exact(x, i, j, bar)
        at = to


def _exact(x: np.ndarray, i: np.ndarray, j: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray]:
    good = np.einsum("ij,ij->i", x[i], x[j]) >= bar
    return i[good], j[good]


def verify(tables: int, functions: int, bar: float):
    """For partitions sorted by cell, stored rows first: ``vec_id, n, low`` from the links of each cell.

    n counts a vector's links with the pairs that meet first in this cell; low is the smallest vector that it is
    connected with among the cells looked at together. Pairs stay inside; at most one row per vector goes on.
    """
    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        vec = t.column("vec_id").combine_chunks()
        ids = vec.to_numpy(zero_copy_only=False)
        stored = t.column("stored").to_numpy()
        group, table, dims = t.column("cell").to_numpy(), t.column("tab").to_numpy(), t.column("dim").to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x = _unit(t.column("embedding").combine_chunks().take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d))
            base = 4 * (1 << max(1, (int(d) - 1).bit_length()))
            unique, row, place = np.unique(ids[at], return_index=True, return_inverse=True)
            sigs: dict[int, np.ndarray] = {}
            links, ii, jj = np.zeros(len(unique), np.int64), [], []
            for i, j in _pairs(x, np.unique(group[at], return_inverse=True)[1], stored[at], bar):
                p, q = place[i], place[j]
                other = p != q
                i, p, q = i[other], p[other], q[other]
                if not len(p):
                    continue
                need = np.unique(np.concatenate([p, q]))
                new = np.array([k for k in need if int(k) not in sigs], np.int64)
                for part in np.array_split(new, max(1, len(new) // 1000)):
                    sigs.update(zip(part.tolist(), _probes(signature(x[row[part]], tables, functions), base)))
                own = np.stack([sigs[int(k)] for k in need])
                a, b = own[np.searchsorted(need, p)], own[np.searchsorted(need, q)]
                over, back = (a == b[:, :, :1]).any(axis=2), (b == a[:, :, :1]).any(axis=2)  # by table: do they meet?
                here = table[at][i]
                earlier = ((over | back) & (np.arange(tables) < here[:, None])).any(axis=1)
                twice = back[np.arange(len(p)), here] & (unique[q] < unique[p])  # and the other way round, which counts
                np.add.at(links, p[~(earlier | twice)], 1)
                np.add.at(links, q[~(earlier | twice)], 1)
                once = np.unique(p * len(unique) + q)
                ii.append(once // len(unique))
                jj.append(once % len(unique))
                if sum(map(len, ii)) > 1_000_000:
                    root = _joined(len(unique), np.concatenate(ii), np.concatenate(jj))
                    ii, jj = [np.arange(len(unique))], [root]
            if ii:
                root = _joined(len(unique), np.concatenate(ii), np.concatenate(jj))
                hit = np.flatnonzero((links > 0) | (root != np.arange(len(unique))))
                yield pa.RecordBatch.from_arrays([pa.array(unique[hit], vec.type), pa.array(links[hit]), pa.array(unique[root[hit]], vec.type)], ["vec_id", "n", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            cell = rest.column("cell").to_numpy()
            last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if last >= 20_000:
                yield from done(rest.slice(0, last))
                rest = rest.slice(last)
        if rest is not None:
            yield from done(rest)

    return run


def link_vectors(spark: SparkSession, embeddings: DataFrame, bar: float = BAR, tables: int = TABLES, functions: int = FUNCTIONS, cell: int = CELL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row; links join vectors of one label with cosine >= ``bar``.

    Vectors that are null, empty or zero or have null or non-finite components, and rows without label or id, link
    with nothing; so do vectors of different length. Rows that repeat an id count as one vector, the first in order
    of label and components, and give one row each. An empty table gives no rows; other columns are not looked at.

    Buckets of over ``cell`` rows are laid out as a grid of cells of about that size, so a label or group that holds
    a third of all rows is spread over many tasks; pairs are counted where they are verified and never sent.
    """
    scratch = Scratch(spark, "vectors")
    kind = dict(embeddings.dtypes)["vec_id"]
    good = _usable(embeddings).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*")
    good = scratch.write(good)
    spread = scratch.write(candidates(good, tables, functions))
    key = ["label", "dim", "tab", "bucket"]
    size = spread.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("probe") == 0).alias("k"))
    size = size.where("n > 1 and k > 0").withColumn("cuts", F.ceil(F.col("n") / cell).cast("int")).drop("n", "k")
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    stored = F.transform(every, lambda c: F.struct(F.lit(True).alias("stored"), F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int").alias("row"), c.cast("int").alias("col")))
    probing = F.transform(every, lambda c: F.struct(F.lit(False).alias("stored"), c.cast("int").alias("row"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("cuts")).cast("int").alias("col")))
    cells = spread.join(size, key).withColumn("c", F.explode(F.when(F.col("probe") == 0, F.concat(stored, probing)).otherwise(probing)))
    cells = cells.select(F.xxhash64(*key, "c.row", "c.col").alias("cell"), "dim", "tab", "c.stored", "vec_id").join(good.select("vec_id", "embedding"), "vec_id")
    cells = cells.repartition(_parts(spark), "cell").sortWithinPartitions("cell", F.desc("stored"))
    found = scratch.write(cells.mapInArrow(verify(tables, functions, bar), f"vec_id {kind}, n long, low {kind}"))
    scratch.free(spread)
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    groups = components(spark, found.select(F.col("vec_id").alias("a"), F.col("low").alias("b")), scratch).withColumnRenamed("id", "vec_id")
    out = embeddings.select("vec_id").join(links, "vec_id", "left").join(groups, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
