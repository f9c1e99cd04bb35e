"""Word lists by token, against a matcher that walks one token after another."""

import random
import time

import regex
from pyspark.sql import functions as F

from modlake.functions import spans
from modlake.operators import gate
from modlake.operators.terms import Terms, lexicon_hit, places, tokens


def walk(terms, norm):
    """``[(first token, tokens)]`` by the rules as they are stated."""
    token = r"[\w\p{M}]+(?:['-][\w\p{M}]+)*"
    listed = {tuple(t.split(" ")) for x in terms if (t := spans.normalise(x)[0]) and regex.fullmatch(f"{token}(?: {token})*", t)}
    words, i, out = regex.findall(token, norm), 0, []
    while i < len(words):
        w, n = words[i], 0
        if (w,) in listed:
            n = 1
        elif len(w) > 3 and w.endswith("es") and w[:-2].endswith(("s", "x", "z", "ch", "sh")) and (w[:-2],) in listed:
            n = 1
        elif len(w) > 2 and w.endswith("s") and not w.endswith("ss") and (w[:-1],) in listed:
            n = 1
        else:
            n = max((k for k in range(2, len(words) - i + 1) if tuple(words[i : i + k]) in listed), default=0)
        if n:
            out.append((i, n))
        i += n or 1
    return out


TERMS = ["idiot", "two words", "two words more", "words", "ass", "box", "mp3", "re-do", "don't", "a b c d", "b c", "s", "xs", "तुम", "s&m", "c++"]


def test_finds_equal_a_walk_over_tokens(spark):
    rng = random.Random(1)
    parts = ["idiot", "idiots", "idiot's", "idiot-like", "two", "words", "word", "more", "ass", "asses", "assess", "boxes", "boxs", "mp3s", "re-do", "re", "do", "don't", "dont", "a", "b", "c", "d", "s", "ss", "xs", "xses", "तुम", "तु", "s&m", "c++", ",", ".", "é"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", ", ", "-", "'", "  ", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["two, words", "idiot's idea", "idiot-like", "mp3s", "", None]
    t = Terms(TERMS)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("n", spans.folded(F.col("t"))).withColumn("p", places(tokens(F.coalesce("n", F.lit(""))), [t, Terms(["zzz"])]))
    for r in df.select("i", "n", t.fires(F.col("p"), F.col("n")).alias("f"), t.count(F.col("p"), F.col("n")).alias("c")).collect():
        if r.n is None:
            continue
        assert r.n == spans.normalise(texts[r.i])[0]
        odd = len(regex.findall(r"(?<![\w\p{M}])(?:s&m|c\+\+)(?![\w\p{M}])", r.n))
        assert (r.c, bool(r.f)) == (len(walk(TERMS, r.n)) + odd, len(walk(TERMS, r.n)) + odd > 0), texts[r.i]
        assert len(t.spans(r.n)) == r.c


def test_folding_in_the_jvm_equals_python(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aAÀßÿŒœ ×÷\n\t\x1c\x85\x0b‘’“–ª²µİſ­​ﬁＡ.’'") for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", spans.folded(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: None if t is None else spans.normalise(t)[0] for i, t in enumerate(texts)}


def test_a_longer_list_costs_no_more(spark):
    df = spark.range(20000).select(F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 5003).cast("string")) for k in range(1, 40)]).alias("n")).withColumn("t", tokens(F.col("n"))).cache()
    df.count()

    def took(n):
        t = Terms([f"v{i}" for i in range(n)] + [f"v{i} x" for i in range(n)])
        out = df.select(t.fires(places(F.col("t"), [t]), F.col("n")).alias("f")).groupBy("f").count()
        out.collect()
        began = time.time()
        assert [tuple(r) for r in out.collect()] == [(False, 20000)]
        return time.time() - began

    few, many = took(20), took(6000)
    assert many < 4 * few + 4


def test_gate_rules_by_token(spark):
    rules = [
        gate.Rule("w", "c", "flag", "words", terms=("idiot", "two words", "mp3")),
        gate.Rule("t", "c", "revise", "targeted", terms=("useless", "waste of space"), subjects=("you", "he")),
        gate.Rule("p", "c", "flag", "pattern", pattern="b[ao]d", terms=("c++",)),
    ]
    texts = ["idiot's idea", "idiot-like", "Two, words", "mp3s", "useless. you", "he's a waste, of space", "youth useless", "you useless useless", "xc++x abad", "तुम useless you।", "You\n are. Useless"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = gate.check(df, rules)
    got = {r.doc_id: [(m.rule_id, m.hits) for m in r.gate_matches] for r in out.collect()}
    assert got == {0: [], 1: [], 2: [("w", 1)], 3: [("w", 1)], 4: [], 5: [("t", 1)], 6: [], 7: [("t", 2)], 8: [("p", 2)], 9: [("t", 1)], 10: []}
    at = {(r.doc_id, r.rule_id, r.start, r.end) for r in gate.located(out, rules).collect()}
    assert at == {(2, "w", 0, 10), (3, "w", 0, 4), (5, "t", 7, 22), (7, "t", 4, 11), (7, "t", 12, 19), (8, "p", 1, 4), (8, "p", 7, 10), (9, "t", 4, 11)}


def test_lexicon_reads_look_alikes(spark):
    texts = ["an 1d10t", "idiots", "x idiot9", "IDIOT!", "a bad-word", "bad word", "ab", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lexicon_hit(F.col("t"), ["idiot", "bad-word", "ab"]).alias("h"))
    assert [r.i for r in df.collect() if r.h] == [0, 2, 4]
