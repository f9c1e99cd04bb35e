"""Noise is the same however rows are dealt out, keeps to its rates and changes only what it says."""

from pyspark.sql import functions as F

from modlake.functions import spans
from modlake.operators import noise

TEXT = "The seller is fast. They have a great shop and the 🙂 price was fair. Then it ends."


def test_noise_does_not_depend_on_partitions_and_keeps_its_rates(spark):
    df = spark.range(4000).withColumn("t", F.lit(TEXT))
    d = noise.Draws(F.col("id"))
    every = df.select("id", noise.noise(F.col("t"), d).alias("n"), noise.obfuscate(F.col("t"), d).alias("o"))
    one, other = ({r.id: (r.n, r.o) for r in every.repartition(k).collect()} for k in (1, 7))
    again = {r.id: (r.n, r.o) for r in df.repartition(5).orderBy(F.desc("id")).select("id", noise.noise(F.col("t"), d).alias("n"), noise.obfuscate(F.col("t"), d).alias("o")).collect()}
    assert one == other == again
    share = lambda f: sum(f(*v) for v in one.values()) / 4000
    assert 0.045 < share(lambda n, o: n.isupper()) < 0.075 and 0.045 < share(lambda n, o: n.islower()) < 0.11  # run-ons without an article too
    assert 0.18 < share(lambda n, o: o != TEXT) < 0.26 and 0.30 < share(lambda n, o: n != TEXT) < 0.50
    seeded = {r.id: r.n for r in df.select("id", noise.noise(F.col("t"), noise.Draws(F.col("id"), 1)).alias("n")).collect()}
    assert sum(seeded[i] != one[i][0] for i in seeded) > 800


def test_disguises_are_read_back(spark):
    d = noise.Draws(F.col("id"))
    rows = spark.range(600).select(noise.leetspeak(F.lit(TEXT), d, 1.0).alias("l"), noise.spaced(F.lit(TEXT), d).alias("s")).collect()
    signs = {c for s in noise.DISGUISES.values() for c in s}
    for r in rows:
        assert len(r.l) == len(TEXT) and all(a == b or b in signs and b in noise.DISGUISES[a.lower()] for a, b in zip(TEXT, r.l, strict=True))
        assert r.s != TEXT and "".join(c for c in r.s if c not in " .-*") == "".join(c for c in TEXT if c not in " .-*")
    changed = [sum(a != b for a, b in zip(TEXT.split(" "), r.l.split(" "), strict=True)) for r in rows]
    assert 7 < sum(changed) / len(changed) < 11
    assert any(spans.deobfuscate(r.l) != r.l for r in rows)


def test_slips_are_those_named(spark):
    d = noise.Draws(F.col("id"))
    words = lambda f: {tuple(r[0]) for r in spark.createDataFrame([(TEXT,)], "t string").select(f(F.split("t", " "))).collect()}
    assert words(lambda w: noise._without_articles(w, F.lit(2))) == {tuple(TEXT.replace("The seller", "seller", 1).replace("a great", "great").split(" "))}
    assert words(lambda w: noise._swapped(w, noise.SWAPS)) == {tuple(TEXT.replace("is", "are", 1).split(" "))}
    assert words(noise._run_on) == {tuple(TEXT.replace("fast. They", "fast, they").replace("fair. Then", "fair, then").split(" "))}
    rows = [r.g for r in spark.range(500).select(noise.bad_grammar(F.lit(TEXT), d).alias("g")).collect()]
    assert len(set(rows)) > 40 and sum(g == TEXT for g in rows) < 60  # two swaps may undo each other


def test_short_and_missing_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " ", "a", "🙂", "the", "a b"] * 60)], "id long, t string")
    d = noise.Draws(F.col("id"))
    for r in df.select("t", noise.noise(F.col("t"), d).alias("n"), noise.obfuscate(F.col("t"), d).alias("o"), noise.bad_grammar(F.col("t"), d).alias("g"), noise.spaced(F.col("t"), d).alias("s"), noise.leetspeak(F.col("t"), d).alias("l")).collect():
        assert all((x is None) == (r.t is None) for x in r[1:])
        assert (r.o, r.s, r.l) == (r.t, r.t, r.t)
