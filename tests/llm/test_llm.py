"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from modlake.llm import lines, minhash, packing, pieces, quality, search, substrings, tokens, urls, vectors  # noqa: E402

RNG = random.Random(5)
VOCABULARY = ["the", "of", "and", "Ähre", "naïve", "x1", "don't", "one,", "two.", "(three)", "日本", "é", "😀", "A!", "z"] + [f"w{i}" for i in range(60)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [prose(RNG.randint(20, 120)) for _ in range(40)]
    near = [b + " " + prose(2) for b in base[:8]]
    texts = base + near + base[:5] + [None, "", " ", "\n\n", "one", "a  b \n c", prose(9000), "x<|endoftext|>y <s>", "\x00 \u3000 é e\u0301"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", "clash", 1) for k, t in rows], "doc_id long, text string, lang string, source string, line string, component long")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_token_counts(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in tokens.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()}
    for k, t in rows:
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (want, len((t or "").encode()), want > 512)
    assert tokens.count_tokens(nothing, P.path("byte_bpe_50k.json")).count() == 0


def test_token_counts_random():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokens.MergeCounter(P.path("byte_bpe_50k.json"))
    for _ in range(400):
        t = "".join(RNG.choice("ab 'sTé\n\t 12.!😀\u3000\u00a0the") for _ in range(RNG.randint(0, 40)))
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_pieces(spark, docs, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in pieces.encode_pieces(docs, P.path("piece_bpe_32k.model")).collect()}
    for k, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        ends = struct.unpack(f"<{2 * len(ids) - 4}I", got[k].spans)
        assert max(ends, default=0) == len((t or "").encode())
        assert list(struct.unpack(f"<{len(ids)}I", got[k].ids)) == ids and got[k].decoded == library.decode(ids)


def test_piece_spans_cover_the_text():
    m = pieces.PieceModel(P.path("piece_bpe_32k.model"))
    for t in ("a déjà  日本", "😀 x\n", " two  spaces", "▁ mark", "a b\nc 😀日 éd " + "x" * 70):
        spans = m.spans(t)
        import pyarrow as pa

        sizes, ids, start, end = m.encode_all(pa.array(["b", t, None, t]))
        assert list(zip(ids, start, end))[sizes[0] : sizes[0] + sizes[1]] == spans and sizes[2] == 0 and sizes[3] == sizes[1]
        assert [i for i, _, _ in spans] == m.encode(t)[1:-1]
        edges = sorted({s for _, s, _ in spans} | {len(t.encode())})
        assert edges[0] == 0 and all(s <= e for _, s, e in spans) and max(e for _, _, e in spans) == len(t.encode())


def _trie(entries):
    """A character map with one unit for each byte path, laid out by first fit."""
    units, pool = {}, b""
    tree = {}
    for key, new in entries.items():
        node = tree
        for b in key.encode():
            node = node.setdefault(b, {})
        node[None] = len(pool)
        pool += new.encode() + b"\0"
    free = [256]

    def lay(node, at, label):
        base = free[0]
        free[0] += 256
        offset = at ^ base
        units[at] = label | (offset << 10 if offset < 1 << 21 else 0) | (256 if None in node else 0)
        for b, child in node.items():
            if b is None:
                units[base] = node[None] | 1 << 31
            else:
                lay(child, base ^ b, b)

    lay(tree, 0, 0)
    size = max(units) + 1
    return struct.pack("<I", size * 4) + struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size))) + pool


def test_longest_prefix_normalisation():
    m = pieces.PieceModel(P.path("piece_bpe_32k.model"))
    m.map = pieces.CharacterMap(_trie({"ﬁ": "fi", "e\u0301": "é", "e": "E", "\u3000": " "}))
    text, source = m.normalise("ﬁ e\u0301e\u3000x")
    assert text == "▁fi▁éE▁x"
    assert source == [0, 0, 0, 3, 4, 7, 8, 11, 12]


def test_packing(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack_documents(spark, docs, P.path("word_bpe_49k.json")).collect()
    check_packing(got, {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows})
    small = packing.pack_documents(spark, docs, P.path("word_bpe_49k.json"), bins=3, shard_tokens=6000).collect()
    check_packing(small, {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}, loose=True)
    assert packing.pack_documents(spark, nothing, P.path("word_bpe_49k.json")).count() == 0


def check_packing(got, ids, loose=False):
    seen, sequences = Counter(), {}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * 4096 and len(own) == r.length
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {k: len(v) for k, v in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert loose or len(sequences) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = packing.BestFit(capacity=10, bins=2)
    assert [fit.put(n) for n in (6, 7, 3, 4, 9, 8)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
    assert fit.put(5) == (4, 0) and fit.put(1) == (3, 8)  # bin 2, with one token free, was the fullest


def test_urls(spark):
    url = ["http://A.example.ORG/es/1?x", "https://b.org", "http://x.com/fr/9#a", "http://x.com/de/", "nourl", None, "http://notcom/fr/", "http://q.net/zz", "a://b://c", "http://example.org/en/1"]
    many = [f"http://h{i}.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(200)]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(url + many)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge_urls(spark, pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(10)] == [
        ("a.example.org", "/es/1", "example.org/es/"), ("b.org", "", None), ("x.com", "/fr/9", "com/fr/"), ("x.com", "/de/", "com/de/"), ("", "", None), ("", "", None),
        ("notcom", "/fr/", None), ("q.net", "/zz", None), ("b:", "//c", None), ("example.org", "/en/1", "example.org/en/1"),
    ]
    assert got[0].verdict == "block" and got[2].verdict == "allow" and {r.verdict for r in got.values()} == {"allow", "block"}
    assert urls.judge_urls(spark, pages.where("false")).count() == 0


def test_url_models_tell_apart(spark):
    text = [(f"h.example/{w}/{i}", w == "good") for i in range(300) for w in ("good", "evil")]
    model = urls.fit(spark.createDataFrame(text, "own string, accepted boolean"))
    ratio = model.ratio(["x.example/good/7777", "x.example/evil/7777"])
    assert ratio[0] > 0 > ratio[1]


def test_url_model_counts_are_exact(spark):
    """Six-digit ids fill any table of fixed size: each context must keep its own counts."""
    rng = random.Random(8)
    text = [(f"h.com/{rng.randrange(10**6):06d}", rng.random() < 0.5) for _ in range(20000)] + [("é\n", True), ("", False)]
    before, after = Counter(), Counter()
    for own, yes in text:
        data = [0] * 5 + [b + 1 for b in own.encode() + b"\n"]
        for i in range(5, len(data)):
            for k in range(6):
                before[yes, tuple(data[i - k : i])] += 1
                after[yes, tuple(data[i - k : i + 1])] += 1

    def mean(own):
        data, total = [0] * 5 + [b + 1 for b in own.encode() + b"\n"], 0.0
        for i in range(5, len(data)):
            for yes in (True, False):
                p = 1 / 256
                for k in range(6):
                    p = (after[yes, tuple(data[i - k : i + 1])] + p) / (before[yes, tuple(data[i - k : i])] + 1)
                assert p <= 1
                total += np.log(p) if yes else -np.log(p)
        return total / (len(data) - 5)

    probes = [own for own, _ in text[:20]] + ["", "é\n", "h.com/12", "日本", "h.com/000000x"]
    got = urls.fit(spark.createDataFrame(text, "own string, accepted boolean")).ratio(probes)
    assert np.allclose(got, [mean(x) for x in probes], atol=1e-9)


def test_url_models_see_the_whole_url(spark):
    """URLs that differ in query string or fragment only, or have no host, are told apart."""
    known = [f"http://h.com/{'fr' if i % 2 else 'de'}/{i}?cat={'good' if i % 2 else 'evil'}#{'top' if i % 2 else 'end'}" for i in range(300)]
    asked = ["http://q.net/view?cat=good", "http://q.net/view?cat=evil", "http://q.net/a#top", "http://q.net/a#end", "cat=good#top", "cat=evil#end", None, ""]
    pages = spark.createDataFrame(list(enumerate(asked + known)), "page_id long, url string")
    got = [r for r in urls.judge_urls(spark, pages).orderBy("page_id").collect()][:8]
    assert all(got[i].ratio > got[i + 1].ratio for i in (0, 2, 4)) and got[6].ratio == got[7].ratio
    assert [r.verdict for r in got[:6]] == ["allow", "block"] * 3 and [r.rule for r in got] == [None] * 8


def _components(n, links):
    root = list(range(n))
    for i, j in sorted(links):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("cell", [2048, 16])
def test_vectors(spark, cell):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 16))
    x = np.concatenate([x, x[:30] + 0.2 * r.normal(size=(30, 16)), x[:4], np.repeat(x[:1], 40, 0) + 0.02 * r.normal(size=(40, 16))])
    label = [int(i % 2) for i in range(len(x))]
    data = [(i, [float(np.float32(v)) for v in row], label[i], "q") for i, row in enumerate(x)]
    n = len(data)
    data += [(n, None, 1, "q"), (n + 1, [0.0] * 16, 1, "q"), (n + 2, [float("nan")] * 16, 1, "q"), (n + 3, data[0][1], None, "q"), (n + 4, [1.0, None], 0, "q"), (n + 5, [], 0, "q")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, low string")
    u = np.array([d[1] for d in data[:n]], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = {(i, j) for i in range(n) for j in range(i) if label[i] == label[j] and u[i] @ u[j] >= 0.93}
    assert len(want) > 100
    got = {g.vec_id: g for g in vectors.link_vectors(spark, df, cell=cell).collect()}
    root = _components(len(data), want)
    for i in range(len(data)):
        assert got[i].n_links == sum(i in p for p in want), i
        assert got[i].component_id == root[i] and got[i].kept == (root[i] == i)


def _bag(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    w += ["\0"] * (5 - len(w)) if 0 < len(w) < 5 else []
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def _alike(a, b):
    both = sum((a | b).values())
    return (sum((a & b).values()) / both if both else None)


def test_near_duplicates(spark, docs, rows):
    bags = [_bag(t) for _, t in rows]
    links = set()
    for i, (_, t) in enumerate(rows):
        for j in range(i):
            s = _alike(bags[i], bags[j])
            if (rows[j][1] or "") == (t or "") or s is not None and s >= 0.8:
                links.add((i, j))
    root = _components(len(rows), links)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark, docs).collect()}
    assert [got[i] for i in range(len(rows))] == root and len(set(root)) < len(root) - 10
    assert minhash.keep_one(spark, docs).count() == len(set(root))
    assert minhash.near_duplicates(spark, docs.where("false")).count() == 0


def test_near_duplicates_in_mixed_buckets(spark, monkeypatch):
    """A chain: neighbours are alike, far ones are not, and buckets hold several components at first."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(1)
    words = [f"c{i}" for i in range(140)]
    texts = []
    for k in range(30):
        texts.append(" ".join(words))
        for _ in range(2):
            words[rng.randrange(140)] = f"n{k}{rng.random()}"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bags = [_bag(t) for t in texts]
    root = _components(30, {(i, j) for i in range(30) for j in range(i) if _alike(bags[i], bags[j]) >= 0.8})
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark, df).collect()}
    assert [got[i] for i in range(30)] == root


def test_bag_minhash_estimates():
    r = np.random.default_rng(0)
    h, w = r.integers(0, 2**63, 200).astype(np.uint64), r.integers(1, 20, 200)
    v = np.where(r.random(200) < 0.6, w, r.integers(1, 50, 200))
    s = minhash.bag_minhash(np.repeat([0, 1], 200), np.concatenate([h, h]), np.concatenate([w, v]), 2, 8000)
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.03


def brute_substrings(rows, window=13):
    words = {k: [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x] for k, t in rows}
    first = {}
    for k, w in words.items():
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, k), k)
    out = {}
    for k, w in words.items():
        gone = {i + d for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k for d in range(window)}
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_substrings(spark, docs, rows):
    want = brute_substrings(rows)
    got = {r.doc_id: r for r in substrings.substring_digests(spark, docs).collect()}
    for k, (n, gone, kept) in want.items():
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest()), k
    assert sum(x[1] for x in want.values()) > 500
    out = {r.doc_id: r.text for r in substrings.drop_repeats(spark, docs).collect()}
    assert all(out[k] == (want[k][2] if want[k][1] else t) for k, t in rows)
    assert substrings.substring_digests(spark, docs.where("false")).count() == 0


def test_lines(spark):
    same = "A notice about nothing at all"
    texts = [f"{same}\nown {k} words here now\nSeen on page {k} of many\nCall Ann{'abcdefgh'[k]} now for free help today\n\nlast {'uvwxyzst'[k]}" for k in range(8)] + [None, "", same]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, same, 1)], "doc_id long, text string, gone int")
    got = {r.doc_id: r for r in lines.drop_template_lines(spark, df).collect()}
    assert got[0].text == texts[0] and got[0]["_n_dropped"] == 0
    for k in range(1, 8):
        assert got[k].text == f"Call Ann{'abcdefgh'[k]} now for free help today\n\nlast {'uvwxyzst'[k]}"
    looser = {r.doc_id: r for r in lines.drop_template_lines(spark, df, leading=1).collect()}
    assert looser[3].text == f"\nlast {'uvwxyzst'[3]}"
    assert got[8].text is None and got[9].text == "" and got[10].text == "" and got[None].text == same


def test_lines_with_several_varying_words(spark):
    """Both fields take a new value each time; the bar of 0.8 allows 2 of 11 tokens and 4 of 20, but not 3 of 11."""
    name = lambda k, c: "qrstuvwxyz"[k] + c
    two = [f"Posted in the {name(k, 'a')} section of our paper by {name(k, 'b')} today" for k in range(8)]
    four = [" ".join(["All", "you", "see"] + [name(k, "cdef"[j]) if j < 4 else f"w{'abcdefghijklm'[j]}" for j in range(12)] + ["and", "so", "it", "is", "."]) for k in range(8)]
    three = [f"This is a {name(k, 'g')} line of {name(k, 'h')} words with {name(k, 'i')} ." for k in range(8)]
    df = spark.createDataFrame([(k, "\n".join(x)) for k, x in enumerate(zip(two, four, three))], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.drop_template_lines(spark, df).collect()}
    assert got == {0: "\n".join([two[0], four[0], three[0]])} | {k: three[k] for k in range(1, 8)}
    same_town = [(k, f"Posted in the {'ab'[k % 2]}x section of our paper by {name(k, 'b')} today") for k in range(10)]
    got = lines.drop_template_lines(spark, spark.createDataFrame(same_town, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.text} == {0}


def test_quality(spark):
    rng = random.Random(2)
    good, bad = [prose(40, rng) for _ in range(150)], [prose(40, rng).upper() + " !!! $$$ ###" for _ in range(150)]
    texts = [t for pair in zip(good, bad) for t in pair] + [None, ""]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(300)] + [(7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_documents(spark, df, labels).collect()}
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert np.mean([got[k].predicted == 1 - k % 2 for k in range(300) if got[k].held_out]) > 0.95
    assert {r.doc_id for r in quality.keep_good(spark, df, labels).collect()} == {k for k, r in got.items() if r.predicted}
    assert {r.score for r in quality.score_documents(spark, df, labels.where("quality = 1")).collect()} == {0.5}


def test_search(spark, docs, rows):
    words = {k: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t or "") for k, t in rows}
    words = {k: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w] for k, w in words.items()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(x for w in words.values() for x in set(w))
    queries = docs.where("doc_id % 5 = 0").selectExpr("doc_id as query_id", "text")
    got = {}
    for r in search.search(spark, docs, queries, 7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.doc_id, r.score)
    for q in range(0, n, 5):
        scores = {}
        for k, w in words.items():
            tf = Counter(w)
            s = sum(np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(words[q]) if x in tf)
            if s > 0:
                scores[k] = s
        best = sorted(scores, key=lambda k: (-round(scores[k], 6), k))[:7]
        own = [got.get(q, {}).get(i + 1) for i in range(len(best))]
        assert np.allclose([x[1] for x in own], [scores[k] for k in best], atol=2e-6)


def test_pruning_changes_nothing():
    """Long lists are entered at pivots only: most of their postings are never read, and the result is that of all."""
    r = np.random.default_rng(1)
    n = 4000
    shares = [0.9, 0.8, 0.7, 0.6, 0.5] + [0.004] * 12
    lists = [np.flatnonzero(r.random(n) < p) for p in shares]
    lists[5] = lists[6] = lists[7] = lists[5][:14]  # a few documents stand out
    docs, counts, sizes = np.concatenate(lists), np.array(list(map(len, lists))), r.integers(20, 400, n)
    shard = search.Shard(np.arange(n), sizes, counts, docs, r.integers(1, 6, len(docs)), 200.0)
    idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))
    total = np.bincount(shard.docs, shard.impact * np.repeat(idf, counts), n).round(6)
    want = np.lexsort((np.arange(n), -total))[:10]
    ids, scores = shard.top(np.arange(len(lists)), idf, 10)
    assert ids.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert shard.touched < len(docs) / 3
    before = shard.touched
    high = (np.arange(10) + n, np.full(10, total.max() + 1))
    assert sorted(shard.top(np.arange(len(lists)), idf, 10, high)[0]) == high[0].tolist() and shard.touched - before < len(docs) / 3


@pytest.mark.parametrize("alike", [True, False])
def test_many_queries_share_a_shard(alike):
    """Queries taken in groups find what each finds in all documents, also after the bars of an earlier shard."""
    r = np.random.default_rng(5)
    n, kinds = 900, 4
    kind = np.sort(r.integers(0, kinds, n)) if alike else r.integers(0, kinds, n)
    lists = [np.flatnonzero((kind == t % kinds) & (r.random(n) < 0.7) | (r.random(n) < 0.01)) for t in range(60)]
    docs, counts = np.concatenate(lists), np.array(list(map(len, lists)))
    shard = search.Shard(r.permutation(n), r.integers(20, 90, n), counts, docs, r.integers(1, 4, len(docs)), 50.0)
    idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))
    full = np.zeros((60, n))
    full[np.repeat(np.arange(60), counts), docs] = shard.impact
    asked = [np.flatnonzero((np.arange(60) % kinds == q % kinds) & (r.random(60) < 0.5)) for q in range(70)] + [np.empty(0, np.int64)]
    high = (np.arange(9) + n, np.full(9, 1e6))
    best = [high if q % 10 == 3 else (np.array([n]), np.array([0.5])) if q % 10 == 4 else None for q in range(71)]
    for q, (ids, scores) in enumerate(shard.tops([(t, idf[t]) for t in asked], 9, best)):
        total = (idf[asked[q]] @ full[asked[q]]).round(6)
        old = best[q] or (np.empty(0, np.int64), np.empty(0))
        own, score = np.append(old[0], shard.ids[total > 0]), np.append(old[1], total[total > 0])
        want = np.lexsort((own, -score))[:9]
        assert ids.tolist() == own[want].tolist() and np.allclose(scores, score[want], atol=2e-6)
    if alike:  # of documents of the other kinds next to none is looked at
        assert shard.touched < 0.7 * n * sum(map(len, asked))


@pytest.mark.parametrize("seed", range(12))
def test_pruning_on_random_lists(seed):
    r = np.random.default_rng(seed)
    n, k = int(r.integers(1, 300)), int(r.integers(1, 12))
    lists = [np.flatnonzero(r.random(n) < p) for p in r.random(30) ** 4]
    lists = [x for x in lists if len(x)] or [np.array([0])]
    docs, counts = np.concatenate(lists), np.array(list(map(len, lists)))
    shard = search.Shard(np.arange(n) // 2, r.integers(1, 40, n), counts, docs, r.integers(1, 4, len(docs)), 20.0)
    idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))
    asked = np.flatnonzero(r.random(len(lists)) < 0.7)
    total = np.zeros(n)
    for t in asked:
        at = slice(shard.list[t], shard.list[t + 1])
        total[shard.docs[at]] += shard.impact[at] * idf[t]
    total = total.round(6)
    hit = np.flatnonzero(total > 0)
    want = hit[np.lexsort((shard.ids[hit], -total[hit]))][:k]
    ids, scores = shard.top(asked, idf[asked], k)
    assert np.allclose(scores, total[want], atol=2e-6) and sorted(ids) == sorted(shard.ids[want])
