import random

from pyspark.sql import functions as F

from modlake.functions import text as T
from modlake.operators import reports


def test_rate_limit_matches_plain_reading(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, "a", "b"]) if i % 3 else "hot", float(rnd.randint(0, 400))) for i in range(600)]
    df = spark.createDataFrame(rows + [(999, "a", None)], "id long, k string, at double")
    got = {r["id"]: r["wait"] for r in reports.rate_limited(df, "k", "at", "id", 3, 50.0).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    want = dict(zip((r[0] for r in order), reports.limits_plainly([(r[1], r[2]) for r in order], 3, 50.0)))
    assert got == want and 0 < sum(w > 0 for w in want.values()) < 600
    assert reports.rate_limited(df.limit(0), "k", "at", "id", 3, 50.0).count() == 0


def test_sigma_level(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (0.00427,), (None,)], "r double")
    got = [r[0] for r in df.select(reports.sigma_level("r")).collect()]
    assert got[:3] == [6.0, 0.0, 1.5] and round(got[3], 2) == 4.13 and got[4] is None  # 4270 per million is published as 4.13


def test_words_and_entries(spark):
    df = spark.createDataFrame([("you are bad", 8, 11), ("bad you", 0, 3), ("a b c", 2, 3)], "t string, a int, b int")
    assert [r[0] for r in df.select(T.drop_word(F.col("t"), F.col("a"), F.col("b"))).collect()] == ["you are", " you", "a c"]
    raw = spark.createDataFrame([("[2001:db8::1]:443",), (" 203.0.113.7:51 ",), ("2001:db8::1",), (None,)], "v string")
    assert [r[0] for r in raw.select(T.clean_entry(F.col("v"))).collect()] == ["2001:db8::1", "203.0.113.7", "2001:db8::1", ""]
    names = spark.createDataFrame([("Parties",), ("weapons",), ("glass",), ("self_harm",)], "c string")
    assert [r[0] for r in names.select(T.category_key(F.col("c"))).collect()] == ["party", "weapon", "glass", "selfharm"]


def test_places_round_half_to_even_and_ties(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 1.0, 2.0, 9.0)] + [("h", None), ("h", 4.0)], "g string, v double")
    assert {(r["g"], r["n"], r["p50"], r["p95"]) for r in reports.places(df, "g", "v", [50, 95]).collect()} == {("g", 4, 2.0, 9.0), ("h", 1, 4.0, 4.0)}


def test_strictest_split_keeps_null_keys_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "train", 7), (2, None, "test", 8), (3, "x", "val", 9)], "id int, t string, split string, r0 int")
    got = reports.strictest_split(df, F.col("t"), "split")
    assert {(r["id"], r["strict"], r["r0"]) for r in got.collect()} == {(1, "test", 7), (2, "test", 8), (3, "val", 9)}


def test_ranks_of_negative_tied_and_missing_values(spark):
    from modlake.operators.ranks import at_ranks

    values = [-5.0, -5.0, 0.0, 0.25, 0.2500001, 3.0, 1e9, None]
    rows = [("a", v) for v in values] + [(None, 7.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    every = {f"r{k}": lambda n, k=k: F.lit(k) for k in range(7)}
    got = {r.g: r for r in at_ranks(df, "g", "v", every).collect()}
    assert [got["a"][f"r{k}"] for k in range(7)] == sorted(v for v in values if v is not None) and got["a"].n == 7
    assert got[None].r0 == 7.0 and got[None].r1 is None and "b" not in got
    assert at_ranks(df.limit(0), "g", "v", every).count() == 0


def test_cells_rise_with_values_and_tell_saturated_scores_apart(spark):
    import math
    import random

    from modlake.operators.ranks import cell_of

    rng = random.Random(8)
    values = [0.0, -0.0, 1.0, 0.5, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, math.nextafter(1, 0), math.nextafter(0.5, 0), math.nextafter(0.5, 1), math.nextafter(1, 2)]
    values += [s * 2.0 ** rng.uniform(-60, 60) for s in (1, -1) for _ in range(300)] + [1 - 2.0 ** -rng.uniform(0, 52) for _ in range(300)] + [rng.random() for _ in range(300)]
    cells = {r.v: r.c for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", cell_of(F.col("v")).alias("c")).collect()}
    told = [cells[v] for v in sorted(values)]
    assert told == sorted(told) and min(told) > -(1 << 21) and max(told) < 1 << 21
    assert len({cells[v] for v in values if 0.998 < v < 1}) > 100 and len({cells[v] for v in values if 0 < v < 0.0019}) > 100


def test_marks_meet_pictures_in_packs(spark):
    """Equal to all pairs added up from the left; copies, other lengths, nulls and no numbers among them."""
    import random

    from pyspark.sql import functions as F

    from modlake.operators import pictures, vision

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8 if i % 9 else 5)]) for i in range(1500)]
    rows += [(2000 + i, rows[i * 7 + 1][1]) for i in range(150)] + [(3000, [1.0, None] * 4), (3001, None), (3002, []), (3003, [float("nan")] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "id long, x array<double>").select("id", vision.unit(F.col("x")).alias("u")).localCheckpoint()
    marks = df.where("id % 3 = 0").select(F.col("id").alias("ex_id"), "u", F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("action"), F.lit("a").alias("category"))
    got = {r.id: (r.block, r.allow, r.matched) for r in pictures.near_exemplars(df, marks).collect()}
    assert len(got) == len(rows)
    units = {r.id: r.u for r in df.collect()}
    marked = [(r.ex_id, r.action, r.u) for r in marks.collect()]

    def dot(a, b):
        s = 0.0
        for x, y in zip(a, b):
            s += x * y
        return s

    for i in [*range(0, 1500, 13), *range(2000, 2150, 5), 3000, 3001, 3002]:
        u = units[i]
        seen = [(dot(u, v), -e, a) for e, a, v in marked if e != 3003 and u and v and len(u) == len(v) and None not in u and None not in v]
        block, allow = max([x[:2] for x in seen if x[2] == "block"], default=(0.0, None)), max([x[0] for x in seen if x[2] == "allow"], default=0.0)
        if not u or len(u) == 5 or None in u:  # 3003 is no number and has the length of the others
            assert got[i] == (max(block[0], 0.0), max(allow, 0.0), -block[1] if block[0] > 0 else None), i
        else:
            assert got[i][0] == max(block[0], 0.0) and got[i][2] == (-block[1] if block[0] > 0 else None), i
    assert got[3003][0] != got[3003][0] and "Broadcast" not in pictures.near_exemplars(df, marks)._jdf.queryExecution().optimizedPlan().toString()
