"""Collocations against counts said plainly."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from modlake.llm import phrases


def plain(docs, least, longest=5, top=2000):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if not any(m == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), b in f.items()):
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    rows = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        rows += [(lang, i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(rows)


def mined(spark, docs, **how):
    df = spark.createDataFrame([(i, t, lang, i, "x") for i, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string, rank int, phrase string")
    return sorted(tuple(r) for r in phrases.mine_phrases(spark, df.repartition(3), **how).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 50)
    monkeypatch.setattr(phrases, "_CHUNK", 30)


def some_docs(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "the", "The", "straße", "ÄB", "äb", "zürich", "x y", "🙂"]
    made = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "!?"]) for _ in range(rng.randint(0, 90)))
    return [(made(), rng.choice(["en", "en", "de", None, "und"])) for _ in range(n)] + [(None, "en"), ("", None), (None, None), ("one two three one two three one two three", "xx")] * 3


def test_phrases_equal_a_plain_version(spark):
    docs = some_docs(1)
    want = plain(docs, 6)
    assert len(want) > 50 and mined(spark, docs, least=6) == want
    assert mined(spark, docs, least=6, top=7) == plain(docs, 6, top=7)


def test_texts_longer_than_a_shard(spark):
    """In this process: tasks run elsewhere and do not see a patched size."""
    text = " ".join(random.Random(2).choices("p q r s".split(), k=700))
    shard = phrases._Shard(lambda seed, word: True)
    shard.add(b"en", text.encode())
    ids = shard.text()
    whole = Counter()
    for size, places, counts in phrases.intervals(ids, len(ids), range(2, 6)):
        whole.update({tuple(ids[p : p + size]): c for p, c in zip(places, counts, strict=True)})
    words = text.split()
    assert sorted(whole.values()) == sorted(Counter(tuple(words[i : i + k]) for k in range(2, 6) for i in range(len(words) - k + 1)).values())


def test_parts_of_a_shard_meet_without_loss(small_blocks):
    text = " ".join(random.Random(3).choices("p q r s".split(), k=700)) + ". p q\nr s  \t p"
    shard = phrases._Shard(lambda seed, word: True)
    shard.add(b"en", text.encode())
    got = Counter()
    for b in phrases._sent(shard, phrases._only_runs(shard.text(), 2), range(2, 6)):
        for p, c in zip(b.column("phrase").to_pylist(), b.column("n").to_pylist(), strict=True):
            got[p.decode()] += c
    want = Counter()
    for piece in re.split(r"[.\n]", text):
        words = piece.split()
        want.update(" ".join(words[i : i + k]) for k in range(2, 6) for i in range(len(words) - k + 1))
    assert got == want


def test_suffix_order_is_that_of_the_words():
    ids = np.array([2, 1, 2, 1, 2, 1, 3, 0, 2, 1, 2], np.int32)
    padded = lambda i, k: [*ids[i : i + k], *[0] * 9][:k]
    for depth in (1, 2, 5, 8):
        got = [padded(i, depth) for i in phrases.suffix_order(ids, depth)]
        assert got == sorted(got)


def test_scores_past_64_bits(spark):
    n = 3_000_000_000_000
    got = spark.sql(f"select (1000BD * cast({n} as decimal(17,0)) * cast({n + 1} as decimal(17,0))) div (cast({n} as decimal(18,0)) * cast(7 as decimal(18,0))) s").first().s
    assert got == 1000 * n * (n + 1) // (n * 7)


def test_bitmap_misses_none(spark):
    rows = [("en", f"w{i} ü") for i in range(300)] + [("de", "x")]
    seen = phrases.bitmap(spark.createDataFrame(rows, "lang string, phrase string"))
    assert all(seen(phrases.seed_of(a.encode()), b.encode()) for a, b in rows)
    assert sum(seen(phrases.seed_of(b"en"), f"v{i}".encode()) for i in range(1000)) < 200


def test_empty_tables_and_rare_phrases(spark):
    assert mined(spark, [], least=2) == [] and mined(spark, [(None, None), ("", "en")], least=1) == []
    assert mined(spark, [("a b c", "en")], least=2) == []
    assert mined(spark, [("a b c a b c", "en")], least=2) == plain([("a b c a b c", "en")], 2)
