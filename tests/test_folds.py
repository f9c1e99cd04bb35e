"""Near-copy groups against a union of sets, out-of-fold models against fits of one fold after another."""

import random

import numpy as np
from pyspark.sql import functions as F

from modlake.operators import folds


def test_groups_equal_joined_sets(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *"abcdefghijklmnopqrstuvwxyz"]), rng.choice([None, *map(str, range(40))])) for i in rng.sample(range(1000), 70)] + [(5000 + i, f"k{i // 2}", f"m{(i + 1) // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, a string, b string")
    got = {r.doc_id: r.group for r in folds.near_copy_groups(spark, df, {"a": F.col("a"), "b": F.col("b")}).collect()}
    group = {i: {i} for i, _, _ in rows}
    for i, a, b in rows:
        for j, c, d in rows:
            if (a is not None and a == c) or (b is not None and b == d):
                if group[i] is not group[j]:
                    both = group[i] | group[j]
                    for k in both:
                        group[k] = both
    assert got == {i: min(group[i]) for i in group}
    assert len({got[5000 + i] for i in range(40)}) == 1  # a long chain
    assert folds.near_copy_groups(spark, df.limit(0), {"a": F.col("a")}).count() == 0


def test_each_row_is_scored_by_models_that_did_not_see_its_group(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (3, 5))
    rows = []
    for i in range(300):
        y = int(rng.integers(0, 3))
        rows.append((i, [float(v) for v in centres[y] + rng.normal(0, 0.8, 5)], y, i // 3))
    bad = [(900, None, 1, 900), (901, [1.0] * 5, None, 901), (902, [1.0] * 4, 1, 902), (903, [float("nan")] * 5, 1, 903)]
    df = spark.createDataFrame([r[:3] for r in rows + bad], "vec_id long, x array<double>, y int").repartition(4)
    groups = spark.createDataFrame([(r[0], r[3]) for r in rows + bad], "vec_id long, group long")
    got = {r.vec_id: r for r in folds.out_of_fold(spark, df, groups, 4, steps=12).collect()}
    assert set(got) == set(range(300))
    assert all(got[3 * g].fold == got[3 * g + 1].fold == got[3 * g + 2].fold for g in range(100)) and len({r.fold for r in got.values()}) == 4
    x = np.hstack((np.ones((300, 1)), np.array([r[1] for r in rows])))
    y, fold = np.array([r[2] for r in rows]), np.array([got[i].fold for i in range(300)])
    penalty = np.diag([0.0] + [1.0] * 5)
    for k in range(4):
        seen, p = fold != k, np.zeros((300, 3))
        curve = np.linalg.inv(x[seen].T @ x[seen] / 4 + penalty + 1e-9 * np.eye(6))
        for c in range(3):
            w = np.zeros(6)
            for _ in range(12):
                w = w + curve @ (x[seen].T @ ((y[seen] == c) - 1 / (1 + np.exp(-x[seen] @ w))) - penalty @ w)
            p[:, c] = 1 / (1 + np.exp(-x @ w))
        for i in np.flatnonzero(~seen):
            assert got[i].predicted == p[i].argmax() and abs(got[i].p - p[i].max()) < 1e-8
    report = {r.y: r for r in folds.class_report(spark.createDataFrame(list(got.values()))).collect()}
    said = np.array([got[i].predicted for i in range(300)])
    for c in range(3):
        assert (report[c].n, report[c].predicted, report[c].hit) == ((y == c).sum(), (said == c).sum(), ((y == c) & (said == c)).sum())
        assert report[c].recall == round(((y == c) & (said == c)).sum() / (y == c).sum(), 6)
    assert report[None].n == 300 and report[None].hit == (y == said).sum()
    assert folds.out_of_fold(spark, df.limit(0), groups, 4).count() == 0
