"""Personal data against patterns as the contract writes them, and against planted cases."""

import random
import re

from pyspark.sql import functions as F

from modlake.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]
            if good():
                out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(out)


def spans(spark, texts, what="base"):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, _m0 int")
    return {r["doc_id"]: [tuple(s) for s in r[what]] for r in pii.find_spans(spark, df.repartition(3)).collect()}


EDGES = [
    None, "", "a@b", "a@b.c", "x a@b.c. y", "a@b.com_x@y.com", "a@b.c@d.e@f.g", "é.a@b.cé", "..@-.-", "a@b..c", "%@a.b-", "1.2.3.4", "1.2.3.4.5.6.7.8", "1.2.3", "999.1.1.1", "000255.0.0.1 256.1.1.1", "1.2.3.4.5",
    "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111  1111 1111 1111", "4111111111111112", "0000 0000 0000", "1" * 19, "0" * 20, "+1 (377) 555-0271", "+1 (377) 555-0271 4111111111111111", "+12345678", "+123456789", "+1234567890123456",
    "++1 234 567 890+49 30 1234567", "+1 ((((((", "+1-2-3-4-5-6-7-8-9(", "🙂 a@b.cd 🙂 10.0.0.1 🙂🙂+49 (30) 123-4567", "a@b.c\n10.0.0.1\r\n4111 1111 1111 1111", "١٢٣.١.١.١", "a@b.c" * 3, "1.2.3.4 " * 5,
]


def test_base_equals_the_plain_patterns(spark):
    rng = random.Random(4)
    alphabet = ["a", "Z", "9", "0", "25", "4111", "1111", ".", "@", "+", "-", " ", "(", ")", "_", "%", "é", "🙂", "\n", "1"]
    texts = EDGES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    got = spans(spark, texts)
    assert sum(map(len, got.values())) > 80
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_long_texts_take_no_time_out_of_proportion(spark):
    """Each of these makes a plain backtracking pattern quadratic or too deep."""
    n = 20_000
    texts = ["a" * n, "1" * n, "a@" + "b." * n, "1 " * n, "+1" * n, "+1" + "(" * n, "1.2.3." * (n // 6), "a@b.c " * (n // 12), "é" * n + " a@b.cd"]
    assert spans(spark, texts) == {i: plain(t) for i, t in enumerate(texts)}


def learning_docs(n=1500):
    rng = random.Random(5)

    def card():
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return body + next(d for d in "0123456789" if luhn(body + d))

    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}"
    made = [phone, card, lambda: f"{rng.choice('abc')}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4))]
    noise = [lambda: "".join(rng.choice("0123456789abcdef") for _ in range(18)), lambda: str(rng.randint(1900, 2030)), lambda: "the", lambda: str(rng.randint(10**15, 10**16)), lambda: "v1.2.3", lambda: f"{rng.randint(256, 999)}.1.1.1", lambda: "x@y"]
    return [" word ".join(rng.choice(made if rng.random() < 0.4 else noise)() for _ in range(6)) for _ in range(n)]


def test_candidates_add_what_base_matches_run_together(spark):
    texts = [*learning_docs(), "say +1 (269) 555-3296 4111111111111111 now", "say (377) 555-0271 now", "an jürgen.7@mail3.example.com da", "clean text of 2024, chapter 12, v1.2.3", "deadbeef0123456789abcd 1234567890123456", "user.5 (at) mail4.example.com"]
    n = len(texts) - 6
    got, base = spans(spark, texts, "spans"), spans(spark, texts)
    assert all(set(base[i]) <= set(got[i]) and got[i] == sorted(got[i]) for i in got)
    assert got[n] == [(4, pii.PHONE, 21), (22, pii.CARD, 38)] and base[n] == []
    assert got[n + 1] == [(4, pii.PHONE, 18)]
    assert (3, pii.EMAIL, 29) in got[n + 2] and (5, pii.EMAIL, 29) in base[n + 2]
    assert got[n + 3] == [] and got[n + 4] == []
    assert got[n + 5] == [(0, pii.EMAIL, 30 - 1)]


def test_nothing_is_added_without_examples(spark):
    assert spans(spark, ["call (377) 555-0271", None, ""], "spans") == {0: [], 1: [], 2: []}
    assert spans(spark, [], "spans") == {}


def test_redaction_keeps_the_rest_and_other_columns(spark):
    texts = [*learning_docs(400), "🙂 a.1@mail1.example.com, 10.0.0.1!", None, "", "plain"]
    df = spark.createDataFrame([(None if i % 50 == 7 else i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, _base int")
    rows = {r["_base"]: r for r in pii.redact(spark, df).collect()}
    assert len(rows) == len(texts) and pii.redact(spark, df).columns == df.columns
    assert [rows[i].text for i in range(400, 404)] == ["🙂 [email], [ip]!", None, "", "plain"]
    assert rows[7].doc_id is None


def test_calibration_is_isotonic():
    assert pii.calibrated([(0, 0, 9), (1, 9, 1), (2, 5, 5), (3, 99, 1)], 0.9) == 3
    assert pii.calibrated([(0, 1, 9), (5, 20, 0)], 0.9) == 5
    assert pii.calibrated([], 0.9) is None and pii.calibrated([(0, 0, 1)], 0.9) is None


def test_trees_equal_a_plain_second_order_boosting(spark):
    rng = random.Random(6)
    rows = [(1, [rng.randint(0, 3) for _ in range(len(pii.FEATURES))]) for _ in range(60)]
    rows = [(fold, f, rng.randint(0, 3), rng.randint(0, 3) + 1 + 3 * (f[1] > 1)) for fold, f in rows]
    cells = spark.createDataFrame(rows, "fold int, f array<int>, pos long, neg long")
    tree = pii._grown(cells, F.lit(0.0))
    g, h = [(p - n) / 2 for _, _, p, n in rows], [(p + n) / 4 for _, _, p, n in rows]
    worth = lambda at: sum(g[i] for i in at) ** 2 / (sum(h[i] for i in at) + pii.SMOOTH)
    every = range(len(rows))
    gains = {(k, v): worth([i for i in every if rows[i][1][k] <= v]) + worth([i for i in every if rows[i][1][k] > v]) for k in range(len(pii.FEATURES)) for v in range(3)}
    assert max(gains, key=gains.get) == (tree.feature, tree.most)
