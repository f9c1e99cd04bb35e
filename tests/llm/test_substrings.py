"""Substring dedup: texts in slices, odd blanks, large ids, and work that no longer goes word by word."""

import cProfile
import hashlib
import pstats
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
from modlake.llm import substrings  # noqa: E402
from tests.llm.test_llm import brute_substrings  # noqa: E402

WORDS = ["a", "b", "é", "\x1c", "\x85x", "abcdefgh", "abcdefghi", "x" * 17, "y" * 64, "z" * 65, "z" * 200, "\x01", "日本語" * 9]


def texts(seed, n=40):
    """Null, empty and blank texts, blanks of all kinds, words around the lengths that matter, passages in common."""
    r = random.Random(seed)
    words, out = WORDS[: r.randint(2, len(WORDS))], []
    for _ in range(n):
        some = "".join(r.choice(words) + r.choice([" ", " ", "\r\n", "\x0b\x0c "]) for _ in range(r.randint(1, 60)))
        out.append(r.choice([None, "", "\n\t", *[r.choice(["", " ", "\t\t"]) + some[: r.choice([None, -1])]] * 9]))
    for _ in range(n // 2):
        a, b = r.randrange(n), r.randrange(n)
        out[b] = f"{out[b] or ''} {out[a] or ''}"
    return out


def steps(rows, window, digests, chunks=2):
    """The operator's steps by themselves, in this process."""
    anchors, n = substrings.Anchors(window, 4), len(rows)
    table = pa.table({"doc_id": pa.array([k for k, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "chunk": pa.array(np.arange(n) * chunks // n, pa.int64()), "at": pa.array(range(n), pa.int32())})
    frame = lambda f: pa.Table.from_batches(f(iter(table.to_batches()))).to_pandas()
    probes, docs = frame(substrings._probe(anchors, window)), frame(substrings._zipped)
    hits = pd.concat([substrings._meet(g) for _, g in probes.groupby("bucket")])
    first = pd.concat([substrings._extend(anchors, digests)(g, hits[hits["chunk"] == c]) for c, g in docs.groupby("chunk")])
    known = pd.concat([substrings._least(g) for _, g in first[first["what"] == substrings._WINDOWS].groupby("bucket")])
    cut = [substrings._cut(anchors, digests)(g[["chunk", "docs"]], known[known["chunk"] == c]) for c, g in first[first["what"] == substrings._PENDING].groupby("chunk")]
    done = first[first["what"] == substrings._DONE]
    return [*((r.doc_id, r.n_words, 0, r.kept_sha256) for r in done.itertuples()), *((r.doc_id, r.n_words, r.n_removed, r.kept) for d in cut for r in d.itertuples())]


@pytest.mark.parametrize("size", [1, 300, substrings.SLICE])
@pytest.mark.parametrize("digests", [True, False])
def test_slices_of_any_size(monkeypatch, size, digests):
    monkeypatch.setattr(substrings, "SLICE", size)
    for seed in range(6):
        rows, window = list(zip(random.Random(seed).sample(range(2**62, 2**62 + 1000), 40), texts(seed))), 3 + seed % 4
        want = brute_substrings(rows, window)
        assert sum(x[1] for x in want.values())
        kept = lambda gone, text: hashlib.sha256(text.encode()).hexdigest() if digests else text if gone else None
        assert sorted(steps(rows, window, digests)) == sorted((k, n, gone, kept(gone, text)) for k, (n, gone, text) in want.items())


def test_no_function_is_called_for_each_word():
    calls = []
    for n in (500, 500, 2000):  # the first warms up
        r = random.Random(3)
        passage = [f"w{r.randrange(5000)}" for _ in range(n)]
        rows = [(k, " ".join([*(f"{k}o{i}" for i in range(n)), *passage])) for k in range(20)]
        counted = cProfile.Profile()
        got = counted.runcall(steps, rows, 13, True, 1)
        assert sum(gone for _, _, gone, _ in got) == 19 * n
        calls.append(pstats.Stats(counted).total_calls)
    assert calls[2] - calls[1] < 20 * 2 * 1500 / 10


def test_places_of_values_that_share_slots():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 100_000):
        among = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        values = np.concatenate([among[r.permutation(len(among))], r.integers(0, 2**63, 1000).astype(np.uint64)])
        places = substrings.Places(among)
        want = {v: k for k, v in enumerate(among.tolist())}
        assert places.of(values).tolist() == [want.get(v, -1) for v in values.tolist()]
        assert n < 100_000 or len(places.lost)


def test_large_ids_and_odd_blanks(spark):
    rows = list(zip(random.Random(9).sample(range(2**53 + 1, 2**53 + 999), 40), texts(9)))
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.substring_digests(spark, docs, 5).collect()}
    want = brute_substrings(rows, 5)
    assert set(got) == {None, *want} and got[None].n_removed == 0
    for k, (n, gone, kept) in want.items():
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest()), k
