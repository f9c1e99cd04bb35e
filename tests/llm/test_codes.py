"""Vector codes against Lloyd's rounds said plainly in Python integers."""

import hashlib
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from modlake.llm import codes


def plain(rows, rounds=codes.ROUNDS):
    """``[(vec_id, label, code, error, label_error, digest)]`` of ``(vec_id, embedding, label)`` rows."""
    kept = [(i, v, lab) for i, v, lab in rows if v and len(v) % 4 == 0 and all(x is not None and isfinite(x) for x in v)]
    ids = sorted({i for i, _, _ in kept if i is not None})[:256]
    if not ids:
        return []
    dim = min(len(v) for i, v, _ in kept if i == ids[0])
    kept = [(i, v, lab) for i, v, lab in kept if len(v) == dim]
    first = [min(v for j, v, _ in kept if j == i) for i in ids if any(j == i for j, _, _ in kept)]
    cut = lambda v: [[floor(Fraction(x) * 1024) for x in v][p * dim // 4 : (p + 1) * dim // 4] for p in range(4)]
    books = [[cut(v)[p] for v in first] for p in range(4)]
    parts = [cut(v) for _, v, _ in kept]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(4):
            groups = {}
            for x in parts:
                groups.setdefault(nearest(x[p], p), []).append(x[p])
            new.append([[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for (i, _, lab), x in zip(kept, parts, strict=True):
        own = [nearest(x[p], p) for p in range(4)]
        out.append((i, lab, bytes(own).hex(), sum(far(x[p], books[p][own[p]]) for p in range(4))))
    sums = {}
    for _, lab, _, e in out:
        sums[lab] = sums.get(lab, 0) + e
    held = lambda e: e if e < 1 << 63 else None
    return sorted(((i, c, held(e), held(sums[lab]), digest) for i, lab, c, e in out), key=str)


def coded(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, own string, code int")
    return sorted((tuple(r) for r in codes.encode_vectors(spark, df.repartition(3)).collect()), key=str)


def test_codes_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.1, 8)], int(i) % 3 if i % 7 else None) for i in rng.permutation(400)]
    assert coded(spark, rows) == plain(rows)


def test_ties_copies_and_vectors_that_drop_out(spark):
    grid = [[float(a), float(b), 0.0, 0.0] for a in range(6) for b in range(6)]  # distances tie everywhere
    rows = [(i, v, 1) for i, v in enumerate(grid)] * 2 + [(None, grid[3], None), (3, grid[9], 2)]
    rows += [(100, None, 1), (101, [1.0, None, 1.0, 1.0], 1), (102, [1.0, float("nan"), 0.0, 0.0], 1), (103, [float("inf")] * 4, 1), (104, [1.0] * 8, 1), (105, [1.0] * 3, 1), (-5, [1.0] * 5, 1), (-6, [], 1)]
    assert coded(spark, rows) == plain(rows)
    assert coded(spark, rows[-8:-4]) == [] and coded(spark, []) == [] and coded(spark, [(None, [1.0] * 4, 1)]) == []


def test_components_that_doubles_do_not_square_exactly(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4) * 10.0 ** rng.integers(0, 9)], 0) for i in range(30)]
    assert coded(spark, rows, "double") == plain(rows)
    rows += [(40, [1e300, -1e300, 3.0, 4.0], 1), (41, [1e300, 1e299, 3.0, 4.5], 1)]
    assert coded(spark, rows, "double") == plain(rows)


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 300, (5000, 4)))
    before = codes.Codebook(x[:64])
    own, upper, lower = before.scan(x)
    after = codes.Codebook(np.floor(np.array([x[own == e].mean(0) for e in range(64)])), before.entries)
    scanned = []
    scan, after.scan = after.scan, lambda part: (scanned.append(len(part)), scan(part))[1]
    new, up, low = after.carried(x, own, upper, lower)
    best = codes.distances(x, after.entries)
    assert (new == best.argmin(1)).all() and sum(scanned) < len(x)
    rest = np.sort(np.sqrt(best), axis=1)
    assert (up >= rest[:, 0]).all() and (low <= rest[:, 1]).all()


@pytest.mark.parametrize("n", [1, 2, 257])
def test_few_vectors(spark, n):
    rows = [(i, [float(i % 5), 0.5, -0.25, float(i)], None) for i in range(n)]
    assert coded(spark, rows) == plain(rows)
