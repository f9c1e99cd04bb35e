"""Routing, severity and the text cascade as one staged plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..sources.shared import Rounds
from . import gate
from .occlusion import Memo

SEVERITY = {"allow": 0, "revise": 1, "reject": 2}


def route(score: Column, allow_max: Column, reject_min: Column, floor: Column | None = None) -> Column:
    """0 allow, 1 revise, 2 reject; never milder than ``floor``."""
    level = F.when(score <= allow_max, 0).when(score >= reject_min, 2).otherwise(1)
    return level if floor is None else F.greatest(level, floor)


def name_of(level: Column) -> Column:
    return F.when(level == 0, "allow").when(level == 1, "revise").when(level == 2, "reject")


def severity_of(risk: Column, decision: Column, bar: Column) -> Column:
    high = F.least(F.lit(0.80), bar + 0.30)
    return F.when(decision == "allow", "none").when(risk.isNull(), "high").when(risk >= high, "critical").when(risk >= bar, "high").when(decision == "revise", "medium").otherwise("low")


#: Function words that show a span to be a sentence; a service passes its own list.
MARKERS = ("i you he she it we they me him her us them my your his its our their this that these those who what which is are was were be been have has had do does did will would can could shall should may might must "
           "not no and or but if because as of at by for with about to from in on off out up down over under than then").split()  # fmt: skip


def has_syntax(span: Column, markers: Iterable[str] = MARKERS) -> Column:
    """Whether a span has the words of a sentence; a list of names or a heading has not, and scores of it mean little."""
    words = F.regexp_extract_all(F.lower(span), F.lit(r"([a-z\x{900}-\x{97F}]+)"), F.lit(1))
    commas = F.length(span) - F.length(F.replace(span, F.lit(","), F.lit("")))

    def counted(w: Column) -> Column:
        bent = F.filter(w, lambda x: (F.length(x) >= 5) & x.rlike("(?:ing|ed|ize|ise)$"))
        return F.struct(F.size(w).alias("n"), F.size(F.filter(w, lambda x: x.isin(*markers))).alias("m"), F.size(bent).alias("bent"), commas.alias("commas"))

    def judged(c: Column) -> Column:
        n, share = c["n"], c["m"] / F.greatest(c["n"], F.lit(1))
        listing = (c["commas"] >= 3) & (c["commas"] / F.greatest(n, F.lit(1)) > 0.20) & (share < 0.15)
        bare = ((n >= 15) & (c["m"] + c["bent"] < 2)) | ((n >= 25) & (share < 0.10))
        return F.when((n == 0) | listing, False).when(n < 10, True).when(bare, False).otherwise(c["m"] + c["bent"] >= 1)

    return F.transform(F.transform(F.array(words), counted), judged)[0]


def apart(spans: Column) -> Column:
    """Spans ``(start, end, kind, risk, ...)`` of which no two overlap: sentences before windows, riskiest first, ties by place.

    Spans are chosen within chains of overlapping ones, since none of another chain is in their way. A fold copies what
    it holds at each step, so it holds the numbers of those kept.
    """
    placed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), F.when(x["kind"] == "sentence", 0).otherwise(1).alias("k"), (-x["risk"]).alias("r"), x.alias("x"))))
    upto = lambda n: F.slice(F.sequence(F.lit(0), n), F.lit(1), n)
    block = lambda i: F.floor(i / 512).cast("int")

    def measured(ys: Column) -> Column:
        """With the largest end before each block of 512."""
        ends = F.transform(ys, lambda y: y["e"])
        before = F.transform(upto(block(F.array_size(ys) - 1) + 1), lambda b: F.array_max(F.slice(ends, F.lit(1), b * 512)))
        return F.struct(ys.alias("ys"), ends.alias("ends"), before.alias("before"))

    def chained(m: Column) -> Column:
        reach = lambda i: F.greatest(F.get(m["before"], block(i)), F.array_max(F.slice(m["ends"], block(i) * 512 + 1, i % 512)))
        firsts = F.filter(upto(F.array_size(m["ys"])), lambda i: F.coalesce(F.get(m["ys"], i)["s"] >= reach(i), F.lit(True)))
        return F.struct(m["ys"].alias("ys"), firsts.alias("firsts"))

    def chosen(c: Column) -> Column:
        first = lambda g: F.coalesce(F.get(c["firsts"], g), F.array_size(c["ys"]))
        return F.flatten(F.transform(F.transform(upto(F.array_size(c["firsts"])), lambda g: F.slice(c["ys"], first(g) + 1, first(g + 1) - first(g))), kept))

    def kept(ys: Column) -> Column:
        ranked = F.transform(F.array_sort(F.transform(ys, lambda y, i: F.struct(y["k"].alias("k"), y["r"].alias("r"), i.alias("i")))), lambda y: y["i"])
        meet = lambda i, j: (F.get(ys, i)["s"] < F.get(ys, j)["e"]) & (F.get(ys, j)["s"] < F.get(ys, i)["e"])
        keep = lambda own, i: F.when(F.exists(own, lambda j: meet(i, j)), own).otherwise(F.array_append(own, i))
        return F.transform(F.array_sort(F.aggregate(ranked, F.array().cast("array<int>"), keep)), lambda i: F.get(ys, i)["x"])

    # one element at each step, so that what is made once has a name below
    return F.transform(F.transform(F.transform(F.array(placed), measured), chained), chosen)[0]


@dataclass(frozen=True)
class Scan:
    """What is read besides the whole text. ``low_syntax_min`` is the bar of spans that are hardly sentences.

    All units of a text are read, whatever its length; ``most_units`` is for a service that wants a limit.
    """

    subjects: tuple[str, ...] = ("he", "she", "his", "her", "him", "they", "them", "their")
    most_segments: int = 3
    most_units: int | None = None
    window_words: int = 40
    window_stride: int = 20
    low_syntax_min: float = 0.90
    revise_on_middle: bool = True
    highlight_on_reject: bool = True
    markers: tuple[str, ...] = tuple(MARKERS)


_ENTRY = "array<struct<start:int,end:int,kind:string,risk:double,low_syntax:boolean,by:string>>"


def _read(parts: DataFrame, memo: Memo) -> DataFrame:
    """Parts with ``risk``: that of the riskier of their readings."""
    keys = ["doc_id", "start", "end", "kind", "low_syntax"]
    readings = parts.select(*keys, F.explode(F.array_distinct(F.array("own", "other"))).alias("reading"))
    return memo.score(readings, "reading").groupBy(*keys).agg(F.max("risk").alias("risk"))


def _parts(live: DataFrame, find: Callable[[str], list]) -> DataFrame:
    found = live.select("doc_id", F.explode_outer(spans.read_parts(find)("text", "view")).alias("p"))
    return found.where("p is not null").select("doc_id", "p.*")


def scan_units(live: DataFrame, scan: Scan) -> DataFrame:
    """``doc_id, start, end, kind, shown, own, other, low_syntax``: sentences where there are two or more, and windows of long ones."""
    size, stride, most = scan.window_words, scan.window_stride, scan.most_units
    units = _parts(live, lambda text: spans.windows_over(text, size, stride)[:most])
    return units.withColumn("low_syntax", ~has_syntax(F.col("shown"), scan.markers))


def cascade(docs: DataFrame, rules: list, scorer: Callable[[Column], Column], levels: DataFrame, allow_max: float = 0.3, reject_min: float = 0.7, prefilter: Callable[[Column], Column] | None = None, clear_below: float = 0.0, scan: Scan = Scan()) -> DataFrame:
    """``doc_id, decision, decided_by, risk, severity, matches, issues, scores`` of documents ``(doc_id, text, surface)``.

    Surfaces (``levels``: surface, enabled, allow_max, reject_min; null thresholds inherit) may be disabled, which
    allows. A gate block rejects without a score. The others are scored whole, as written and with look-alikes as
    letters, then the segments that address someone, then sentences and windows. A segment that rejects ends the
    reading. Spans that the pre-filter finds under ``clear_below`` in every reading are recorded with its score and
    never escalate. ``scores`` are all spans scanned, ``issues`` those that decided, of which no two overlap.

    The gate runs once, its rows are written, and so are the segments and units that are read of them; each of the three
    readings is one join with the scores of texts that are not known yet. ``doc_id`` is one row's. Null texts are empty.
    """
    rounds = Rounds(docs.sparkSession, "cascade")
    memo = Memo(rounds, scorer)
    base = docs.withColumn("text", F.coalesce("text", F.lit(""))).join(levels, "surface", "left").withColumn("on", F.coalesce("enabled", F.lit(True)))
    base = base.withColumn("lo", F.coalesce("allow_max", F.lit(allow_max))).withColumn("hi", F.coalesce("reject_min", F.lit(reject_min)))
    base = gate.check(base.withColumn("view", spans.revealed(F.col("text"))), rules, surface="surface")
    base = rounds.write(base.select("doc_id", "text", "view", "on", "lo", "hi", "blocked", F.when(F.col("needs_revision"), 1).otherwise(0).alias("floor"), F.size("gate_matches").alias("matches")))
    live = base.where(F.col("on") & ~F.col("blocked"))
    bars = live.select("doc_id", "lo", "hi", "floor")

    readings = live.select("doc_id", F.explode(F.array_distinct(F.array("text", "view"))).alias("reading"))
    whole = memo.score(readings, "reading").groupBy("doc_id").agg(F.max("risk").alias("whole")).join(bars, "doc_id")
    model = route(F.col("whole"), F.col("lo"), F.col("hi"))
    whole = rounds.write(whole.select("*", model.alias("model"), F.greatest(model, "floor").alias("level")))

    said = live.join(whole.where("level < 2").select("doc_id"), "doc_id", "left_semi")
    subjects, most = scan.subjects, scan.most_segments
    parts = rounds.write(_parts(said, lambda text: [(s, e, "segment") for s, e in spans.addressed_segments(text, subjects, most)]).withColumn("low_syntax", F.lit(False)))
    segments = _read(parts, memo).join(bars, "doc_id").withColumn("level", route(F.col("risk"), F.col("lo"), F.col("hi"))).where("level > 0")
    entry = lambda by=None: F.struct("start", "end", "kind", "risk", "low_syntax", F.lit(by).cast("string").alias("by"))
    segments = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(entry().alias("e"), "level"))).alias("x"))
    refusing = F.filter("x", lambda s: s["level"] == 2)
    segments = segments.select("doc_id", F.when(F.size(refusing) > 0, 2).otherwise(1).alias("seg_level"), F.transform(F.when(F.size(refusing) > 0, F.slice(refusing, 1, 1)).otherwise(F.col("x")), lambda s: s["e"]).alias("seg_issues"))
    state = rounds.write(whole.join(segments, "doc_id", "left"))

    reading = (F.col("level") < 2) & (F.coalesce("seg_level", F.lit(0)) < 2)
    scanned = state.where((reading | (F.col("model") == 2)) if scan.highlight_on_reject else reading).select("doc_id")
    units = rounds.write(scan_units(live.join(scanned, "doc_id", "left_semi"), scan))
    if prefilter is None:
        scored = _read(units, memo).withColumn("by", F.lit(None).cast("string"))
    else:
        shown = F.col("shown")
        clean = F.substr("other", F.lit(1), F.length("shown"))
        asked = F.greatest(prefilter(shown), prefilter(clean), prefilter(F.col("bare")))
        units = rounds.write(units.withColumn("bare", spans.revealed(shown)).withColumn("asked", asked.cast("double")).drop("bare"))
        cleared = units.where(F.col("asked") < clear_below).select("doc_id", "start", "end", "kind", "low_syntax", F.col("asked").alias("risk"), F.lit("prefilter").alias("by"))
        scored = _read(units.where(F.col("asked") >= clear_below), memo).withColumn("by", F.lit(None).cast("string")).unionByName(cleared)
    entries = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", F.round("risk", 6).alias("risk"), "low_syntax", "by"))).cast(_ENTRY).alias("scores"))

    none = F.array().cast(_ENTRY)
    out = base.select("doc_id", "on", "blocked", "matches", F.col("hi").alias("bar")).join(state, "doc_id", "left").join(entries, "doc_id", "left").withColumn("scores", F.coalesce("scores", none))
    by_model = F.filter("scores", lambda x: x["by"].isNull())
    rejecting = F.filter(by_model, lambda x: (x["risk"] >= F.col("hi")) & (x["risk"] > F.col("lo")) & (~x["low_syntax"] | (x["risk"] >= scan.low_syntax_min)))
    risky = F.filter(by_model, lambda x: (x["risk"] > F.col("lo")) & ~x["low_syntax"])
    out = out.withColumn("rejecting", rejecting).withColumn("seg_issues", F.coalesce("seg_issues", none)).withColumn("seg_level", F.coalesce("seg_level", F.lit(0)))
    before = F.greatest("level", "seg_level")
    middle = (before == 0) & (F.size("rejecting") == 0) & F.lit(scan.revise_on_middle)
    out = out.withColumn("risky", F.when(middle, risky).otherwise(none))
    sentence = F.when(F.size("rejecting") > 0, 2).when(F.size("risky") > 0, 1).otherwise(0)
    level = F.when(~F.col("on"), 0).when(F.col("blocked"), 2).otherwise(F.greatest(before, sentence))
    by = (
        F.when(~F.col("on"), "disabled").when(F.col("blocked"), "gate").when(F.col("level") == level, F.when(F.col("model") == level, "model").otherwise("gate"))
        .when(F.col("seg_level") == level, "targeted").otherwise("sentence")
    )
    issues = F.when(F.size("rejecting") > 0, apart(F.col("rejecting"))).otherwise(F.concat("seg_issues", apart(F.col("risky"))))
    out = out.select("doc_id", name_of(level).alias("decision"), by.alias("decided_by"), "whole", "bar", "matches", F.when(F.col("on") & ~F.col("blocked"), issues).otherwise(none).alias("issues"), "scores")
    risk = F.when(~F.col("decided_by").isin("gate", "disabled"), F.greatest("whole", F.array_max(F.transform("issues", lambda x: x["risk"]))))
    out = out.withColumn("risk", F.round(risk, 6))
    return out.select("doc_id", "decision", "decided_by", "risk", severity_of(F.col("risk"), F.col("decision"), F.col("bar")).alias("severity"), "matches", "issues", "scores")
