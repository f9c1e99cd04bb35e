"""Span functions, rules, sinks and streaming forms on small cases."""

import re

from pyspark.sql import functions as F

from modlake.functions import spans
from modlake.functions import text as T
from modlake.operators import gate
from modlake.sources import readers, sinks
from modlake.streaming import jobs


def test_normalise_maps_back():
    norm, at = spans.normalise("  Ｆull​width  ﬁ ’s\n")
    assert norm == "fullwidth fi 's" and [at[0], at[4]] == [2, 7] and len(at) == len(norm)


def test_results_leave_python_in_slices(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spans, "SLICE", 10)
    texts = ["Ab c.", None, "", "x" * 30, "d  e"]
    got = list(spans.sliced([(pa.array(texts),)], lambda t: spans.word_spans(t or ""), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
    assert [len(x) for x in got] == [4, 1]
    assert [[(w["start"], w["end"]) for w in row] for x in got for row in x.to_pylist()] == [spans.word_spans(t or "") for t in texts]


def test_spans_say_their_own_text(spark):
    long = "né " * 400_000 + "end. Ünd so!"
    df = spark.createDataFrame([(1, "One two.\nThree, four!"), (2, None), (3, long)], "id int, text string")
    rows = df.select("id", spans.said_words("text").alias("w"), spans.said_sentences("text").alias("s"), spans.normal_map("text").alias("n"), spans.deobfuscated("text").alias("d")).orderBy("id").collect()
    assert [x.own for x in rows[0].s] == ["One two", "Three, four"] and [(x.start, x.own) for x in rows[0].w][2] == (9, "Three,")
    assert rows[1].w == [] and rows[1].s == [] and rows[1].n == ("", []) and rows[1].d is None
    assert [(x.start, x.end, x.own) for x in rows[2].w] == [(s, e, long[s:e]) for s, e in spans.word_spans(long)]
    assert (rows[2].n.norm, rows[2].n.idx) == spans.normalise(long) and rows[2].d == long


def test_scan_units_join_fragments():
    t = "Yes. This is a full sentence. No!\nShort\nAnother whole line here."
    assert [t[s:e] for s, e in spans.scan_units(t)] == ["Yes. This is a full sentence. No", "Short", "Another whole line here"]
    assert spans.scan_units("") == [] and spans.scan_units("...") == []


def test_deobfuscate_keeps_length():
    assert spans.deobfuscate("c0py IDI0T R0lex w4tches 2024 $ 0TP @ccount") == "copy IDIOT Rolex watches 2024 $ OTP account"
    same = "Hello! 5kg at 3pm, A4 paper, 330W A16 i5 CO2 1st 4pcs"
    assert spans.deobfuscate(same) == same


def test_sentences_need_a_blank_or_the_end():
    t = "Pay 3.5 kg at www.site.com now. Next!  Last॥ one\n... \nend"
    assert [t[s:e] for s, e in spans.sentences(t)] == ["Pay 3.5 kg at www.site.com now", "Next", "Last", "one", "end"]


def test_units_join_by_line():
    t = "Hi. Yes. One two three. No. Four five six. Go.\nA b. C"
    assert [t[s:e] for s, e in spans.scan_units(t)] == ["Hi. Yes. One two three", "No. Four five six. Go", "A b. C"]


def test_windows_only_of_longer_texts(spark):
    rows = spark.createDataFrame([("a b",), ("a b c d e f",), ("a b c d e f g",), ("",)], "t string")
    got = [r[0] for r in rows.select(T.windows(F.filter(F.split("t", " "), lambda x: x != ""), 4, 2)).collect()]
    assert got == [[], ["a b c d", "c d e f"], ["a b c d", "c d e f", "e f g"], []]


def test_wilson_of_no_trials(spark):
    lo, hi = T.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(lo, hi).first()) == (0.0, 1.0)
    lo, hi = T.wilson(F.lit(5), F.lit(5))
    got = tuple(spark.range(1).select(lo, hi).first())
    assert 0.5 < got[0] < got[1] <= 1.0


def test_gate_reads_what_is_meant(spark):
    rules = [
        gate.Rule("w", "c", "block", "words", terms=("Bad", "two words", "box", "glass"), file_terms=("listed", "spared"), excluded=frozenset({"spared", "bad"})),
        gate.Rule("t", "c", "revise", "targeted", terms=("Useless",), subjects=("You", "he")),
    ]
    text = ["b\u200bad", "ｂａｄ", "ébad", "bads", "badly", "two  Words", "two wordss", "boxes", "glasses", "glasss", "listed", "spared", "he's useless", "yous useless", "You. useless", "useless, you", "कbad", None]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id int, text string")
    got = {r.doc_id: [m.rule_id for m in r.gate_matches] for r in gate.check(df, rules).collect()}
    assert [k for k, v in got.items() if v == ["w"]] == [0, 1, 3, 5, 7, 8, 10] and [k for k, v in got.items() if v == ["t"]] == [12, 15]
    at = {(r.doc_id, r.start, r.end) for r in gate.located(gate.check(df, rules), rules).collect()}
    assert at == {(0, 0, 4), (1, 0, 3), (3, 0, 4), (5, 0, 10), (7, 0, 5), (8, 0, 7), (10, 0, 6), (12, 5, 12), (15, 0, 7)}


def test_normalise_against_one_character_at_a_time():
    import random

    rng = random.Random(0)
    for _ in range(300):
        t = "".join(rng.choice("aÉß \n\t\u00a0\u200bﬁＡ’.\u3000") for _ in range(rng.randint(0, 12)))
        norm, at = spans.normalise(t)
        assert norm == " ".join("".join(spans._folded(c) for c in t).split()) and len(at) == len(norm)
        assert all(x == " " and t[i].isspace() or x in spans._folded(t[i]) for x, i in zip(norm, at)) and at == sorted(at)


def test_gate_stops_at_first_block(spark):
    rules = [gate.Rule("r", "c", "flag", terms=("odd",), kind="words"), gate.Rule("b1", "c", "block", pattern="bad"), gate.Rule("b2", "c", "block", pattern="worse"), gate.Rule("off", "c", "block", kind="words"), gate.Rule("s", "c", "revise", pattern="hm", surfaces=("post",))]
    df = spark.createDataFrame([(1, "bad and worse, odd", "post"), (2, "Odds hm", "post"), (3, "hm", "job"), (4, None, None), (5, "oddly hm", None)], "id int, text string, surface string")
    got = {r.id: [m.rule_id for m in r.gate_matches] for r in gate.check(df, rules, surface="surface").collect()}
    assert got == {1: ["b1"], 2: ["s", "r"], 3: [], 4: [], 5: ["s"]}


def test_csv_keeps_blanks_and_line_ends(spark, tmp_path):
    (tmp_path / "eval_a.csv").write_text('text,label,group,note,public_label\n"two\nlines, ""quoted""",1,NA,,0\n')
    r = readers.labelled_csv(spark, str(tmp_path)).first()
    assert (r.text, r.group, r.note, r.file) == ('two\nlines, "quoted"', "NA", "", "eval_a.csv")


def test_requests(spark):
    raw = ['{"content": "x", "content_type": "post"}', '{"content": " ", "content_type": "post"}', '{"content": "x", "content_type": "no"}', "nonsense", None]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    wrong = readers.requests(F.col("raw"), ("post",))[1]
    assert [r[0] for r in df.select(wrong).collect()] == [None, "content is required", "unknown content_type", "not JSON", "not JSON"]


def test_append_twice_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "request_id string, n int")
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_stream_intake_and_dead_letters(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:01:00")], "request_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.intake(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))

    def broken(df):
        raise RuntimeError("store is away")

    q = stream.writeStream.foreachBatch(sinks.fail_safe(broken, str(tmp_path / "dlq"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "dlq")).count() == 2


def test_file_kinds_and_hashtags(spark):
    df = spark.createDataFrame([(b"%PDF-1.7",), (b"\x89PNG....",), (b"....ftypisom",), (b"RIFF....WEBP",), (b"x",)], "content binary")
    assert [r[0] for r in df.select(T.file_kind(F.col("content"))).collect()] == ["pdf", "image", "video", "image", "unknown"]
    assert spark.range(1).select(T.hashtag_words(F.lit("#SaveTheDate2024_now"))).first()[0] == "Save The Date 2024 now"


def test_what_a_row_needs_is_made_once(spark):
    """Words and tokens by window and place, the gate by rule, scores by threshold: each stands in the plan once."""
    from modlake.operators import evaluation, reports

    docs = spark.createDataFrame([("all in all rights reserved a b c", "src0"), ("", None), (None, "x")], "text string, source string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    split = docs.select(T.windows(F.split("text", " "), 2, 1).alias("w"))
    assert plan(split).count("split(") == 1 and [len(r.w) if r.w is not None else None for r in split.collect()] == [7, 0, 0]
    matches = gate.check(docs, gate.DEFAULT_RULES, surface="source").select(F.explode_outer("gate_matches").alias("m")).where("m is not null")
    assert [(r.m.rule_id, r.m.hits) for r in matches.collect()] == [("licence.notice", 1)]
    assert plan(matches).count("regexp_extract_all(coalesce") == 1
    scored = spark.range(10).select(F.lit("a").alias("g"), F.col("id").alias("y"), T.code_sum_score(F.concat(F.lit("x"), F.col("id"))).alias("p"))
    for df in (evaluation.sweep(scored, [0.1, 0.2]), reports.grid_by(scored, "g", [0.1, 0.2])):
        assert "ascii" in plan(df) and not re.search(r"array\(0\.1[^\n]*ascii", plan(df))
