"""Which words make a span risky: scores of the span without each word, then greedy removal, for all documents at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import word_places
from ..sources.shared import Rounds


@dataclass(frozen=True)
class WordScan:
    """Limits for one document; ``max_calls`` counts scores asked for, remembered ones too."""

    min_contribution: float = 0.10
    max_triggers: int = 5
    max_spans: int = 5
    max_words: int = 60
    max_candidates: int = 10
    max_calls: int = 40
    window_words: int = 40
    window_stride: int = 20
    greedy_candidates: int = 12


class Memo:
    """Scores of texts, each distinct text scored once in all rounds; texts are known by their SHA-256."""

    def __init__(self, rounds: Rounds, scorer: Callable[[Column], Column]):
        self.rounds, self.scorer, self.tables = rounds, scorer, []

    def _known(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return out

    def score(self, rows: DataFrame, text: str) -> DataFrame:
        """The rows with ``risk``."""
        told = rows.withColumn("_digest", F.sha2(F.col(text), 256))
        new = told.select("_digest", F.col(text).alias("_text")).dropDuplicates(["_digest"])
        if self.tables:
            new = new.join(self._known(), "_digest", "left_anti")
        self.tables.append(self.rounds.write(new.select("_digest", self.scorer(F.col("_text")).cast("double").alias("risk"))))
        return told.join(self._known(), "_digest").drop("_digest")


def _held(risk: Column) -> Column:
    """Risks as greedy removal compares them: as far from 0 and 1 as their logits are finite."""
    return F.least(F.greatest(risk, F.lit(1e-9)), F.lit(1 - 1e-9))


def _windows(words: Column, size: int, stride: int) -> Column:
    """``(start, end)`` of overlapping windows over more than ``size`` words; the last ends with the words."""
    n = F.size(words)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda i: (i == 0) | (i + (size - stride) < n))
    return F.transform(starts, lambda i: F.struct(F.get(words, i)["start"].alias("start"), F.get(words, F.least(i + size, n) - 1)["end"].alias("end")))


def regions(docs: DataFrame, issues: DataFrame, memo: Memo, scan: WordScan, allow_max: float) -> DataFrame:
    """``doc_id, n, start, end, origin, region, words`` of the riskiest issues of each document over ``allow_max``.

    The region is the issue, or of a longer one its riskiest window (the first of equals), which begins at ``origin``.
    """
    place = Window.partitionBy("doc_id").orderBy(F.desc("risk"), "start", "end")
    flagged = issues.where(F.col("risk") > allow_max).withColumn("n", F.row_number().over(place)).where(F.col("n") <= scan.max_spans)
    spans = flagged.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "n", "start", "end", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("span"))
    spans = memo.rounds.write(spans.withColumn("places", word_places(F.col("span"))))
    keys = ["doc_id", "n", "start", "end"]
    cut = lambda at: F.substr("span", F.col(at)["start"] + 1, F.col(at)["end"] - F.col(at)["start"])
    long = spans.where(F.size("places") > scan.window_words).select(*keys, "span", F.posexplode(_windows(F.col("places"), scan.window_words, scan.window_stride)).alias("k", "w"))
    scored = memo.score(long.select(*keys, "k", "w", cut("w").alias("region")), "region")
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("w", "region"), F.struct("risk", -F.col("k"))).alias("b"))
    found = best.select(*keys, (F.col("start") + F.col("b.w.start")).alias("origin"), F.col("b.region").alias("region"))
    found = found.unionByName(spans.where(F.size("places") <= scan.window_words).select(*keys, F.col("start").alias("origin"), F.col("span").alias("region")))
    found = found.withColumn("words", F.slice(word_places(F.col("region")), 1, scan.max_words))
    return found.where(F.size("words") >= 2)


def affordable(found: DataFrame, scan: WordScan) -> DataFrame:
    """The regions with ``keep``, how many of their words may be scored, and ``remaining``, what their document has left.

    Regions are served in order: each costs one score of its own and one for each word. The first that has room for
    under two words ends the service of its document.
    """
    served = "array<struct<n:int,keep:int>>"

    def serve(acc: Column, r: Column) -> Column:
        room = scan.max_calls - acc["spent"] - 1
        keep = F.least(r["words"], F.lit(scan.max_candidates), room)
        go = ~acc["over"] & (room >= 2)
        kept = F.struct((acc["spent"] + 1 + keep).alias("spent"), F.lit(False).alias("over"), F.array_append(acc["out"], F.struct(r["n"].alias("n"), keep.alias("keep"))).alias("out"))
        return F.when(go, kept).otherwise(F.struct(acc["spent"].alias("spent"), F.lit(True).alias("over"), acc["out"].alias("out")))

    order = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", F.size("words").alias("words")))).alias("r"))
    told = order.select("doc_id", F.aggregate("r", F.struct(F.lit(0).alias("spent"), F.lit(False).alias("over"), F.array().cast(served).alias("out")), serve).alias("a"))
    rows = told.select("doc_id", F.greatest(scan.max_calls - F.col("a.spent"), F.lit(0)).alias("remaining"), F.inline("a.out"))
    return found.join(rows, ["doc_id", "n"])


def shortlisted(found: DataFrame, prefilter: Callable[[Column], Column] | None) -> DataFrame:
    """``..., j, place, variant``: of each region the ``keep`` words without which the pre-filter finds least, in reading order.

    Without a pre-filter, and of a region that has no more words, the first ones stay.
    """
    words = found.select("*", F.posexplode("words").alias("at", "place")).withColumn("variant", T.drop_word(F.col("region"), F.col("place.start"), F.col("place.end")))
    asked = F.when(F.size("words") > F.col("keep"), prefilter(F.col("variant"))) if prefilter else F.lit(0)
    region = Window.partitionBy("doc_id", "n")
    kept = words.withColumn("_r", F.row_number().over(region.orderBy(asked, "at"))).where(F.col("_r") <= F.col("keep"))
    return kept.withColumn("j", F.row_number().over(region.orderBy("at")) - 1).drop("_r", "at", "words")


def _greedy(state: DataFrame, memo: Memo, scan: WordScan, allow_max: float) -> DataFrame:
    """Rounds of removal over all open regions at once; a region ends as ``done`` or ``dead``, or open when calls ran out."""
    rounds = memo.rounds
    for _ in range(scan.max_triggers):
        going = (F.col("status") == "open") & (F.col("remaining") > 0)
        ended = F.when(F.col("risk") <= allow_max, "done").when(F.size("removed") >= scan.max_triggers, "dead")
        state = state.withColumn("status", F.when(going, F.coalesce(ended, F.lit("next"))).otherwise(F.col("status")))
        state = rounds.write(state)
        pending = state.where("status = 'next'")
        if pending.isEmpty():
            break
        batch = pending.select("doc_id", "n", "words", "removed", "remaining", F.posexplode(F.array_except("candidates", "removed")).alias("q", "j"))
        batch = batch.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "q"))).where(F.col("turn") <= F.col("remaining"))
        gone = F.array_append("removed", F.col("j"))
        texts = batch.select("doc_id", "n", "j", "turn", F.array_join(F.transform(F.filter("words", lambda w: ~F.array_contains(gone, w["j"])), lambda w: w["word"]), " ").alias("rest"))
        scored = rounds.write(memo.score(texts, "rest").drop("rest"))
        best = scored.groupBy("doc_id", "n").agg(F.min(F.struct(_held(F.col("risk")).alias("held"), "turn", "j", "risk")).alias("best"))
        used = scored.groupBy("doc_id").agg(F.count("*").alias("used"))
        after = state.join(best, ["doc_id", "n"], "left").join(used, "doc_id", "left")
        found = F.col("best").isNotNull()
        state = after.select(
            *(c for c in state.columns if c not in ("removed", "risk", "remaining", "status")),
            F.when(found, F.array_append("removed", F.col("best.j"))).otherwise(F.col("removed")).alias("removed"),
            F.coalesce("best.risk", "risk").alias("risk"),
            (F.col("remaining") - F.coalesce("used", F.lit(0))).cast("int").alias("remaining"),
            F.when(found, "open").when(F.col("status") == "next", "dead").otherwise(F.col("status")).alias("status"),
        )
    return state


def analyse_words(spark: SparkSession, docs: DataFrame, issues: DataFrame, scorer: Callable[[Column], Column], allow_max: float, prefilter: Callable[[Column], Column] | None = None, scan: WordScan = WordScan()) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, start, end, contribution)`` of words, and ``(doc_id, start, end, triggers)`` of issues that words explain.

    ``docs`` are ``(doc_id, text)`` with one row an id, ``issues`` ``(doc_id, start, end, risk)``. Of each document the
    riskiest issues over ``allow_max`` are looked at within its budget. A word's contribution is the risk of its region
    less that of the region without it. Words that contribute ``min_contribution`` trigger; if none does, words go one
    by one, the one after whose removal the rest scores least first (the first of equals), until what is left of the
    shortlisted words, joined by blanks, scores ``allow_max`` or less. If ``max_triggers`` words or the budget do not
    suffice, no word is marked. Issues of null or missing texts have no words.

    All documents go through a round together: a round is one join with the scores that are not known yet. What a
    document has left to spend travels with its rows.
    """
    rounds = Rounds(spark, "occlusion")
    memo = Memo(rounds, scorer)
    found = rounds.write(affordable(regions(docs.where("text is not null"), issues, memo, scan, allow_max), scan))
    keys = ["doc_id", "n", "start", "end", "origin", "remaining"]
    words = rounds.write(shortlisted(found, prefilter))
    texts = words.select("doc_id", "n", "j", F.col("variant").alias("asked")).unionByName(found.select("doc_id", "n", F.lit(-1).alias("j"), F.col("region").alias("asked")))
    scored = rounds.write(memo.score(texts, "asked").drop("asked"))
    base = scored.where("j = -1").select("doc_id", "n", F.col("risk").alias("base"))
    word = words.select(*keys, "j", "place", F.substr("region", F.col("place.start") + 1, F.col("place.end") - F.col("place.start")).alias("word")).join(scored, ["doc_id", "n", "j"]).join(base, ["doc_id", "n"])
    word = rounds.write(word)
    contributions = word.select("doc_id", (F.col("origin") + F.col("place.start")).alias("start"), (F.col("origin") + F.col("place.end")).alias("end"), F.round(F.col("base") - F.col("risk"), 6).alias("contribution"))

    spans = word.groupBy(*keys).agg(F.first("base").alias("base"), F.array_sort(F.collect_list(F.struct("j", "place", "word", "risk"))).alias("words"))
    least = lambda ws, at: F.transform(F.array_sort(F.transform(ws, lambda w: F.struct(at(w["risk"]).alias("r"), w["j"].alias("j")))), lambda x: x["j"])
    single = F.filter("words", lambda w: F.col("base") - w["risk"] >= scan.min_contribution)
    ranked = least(F.col("words"), _held)
    spans = spans.withColumn("single", F.slice(least(single, lambda r: r), 1, scan.max_triggers)).withColumn("ranked", ranked)
    state = spans.select(
        *keys, "words",
        F.slice("ranked", 1, min(scan.greedy_candidates, scan.max_candidates)).alias("candidates"),
        F.when(F.size("single") > 0, F.col("single")).otherwise(F.slice("ranked", 1, 1)).alias("removed"),
        F.get("words", F.get("ranked", F.lit(0)))["risk"].alias("risk"),
        F.when(F.size("single") > 0, "done").otherwise("open").alias("status"),
    )
    state = _greedy(state, memo, scan, allow_max)
    place = lambda j: F.get("words", j)["place"]
    triggers = F.transform(F.array_sort("removed"), lambda j: F.struct((F.col("origin") + place(j)["start"]).alias("start"), (F.col("origin") + place(j)["end"]).alias("end")))
    return contributions, state.where("status = 'done'").select("doc_id", "start", "end", triggers.alias("triggers"))
