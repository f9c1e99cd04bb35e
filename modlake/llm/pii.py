"""Personal data: exact base patterns, and candidates from wide generators chosen by boosted trees. JVM-side throughout."""

from __future__ import annotations

from dataclasses import dataclass
from math import floor, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, unlike

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The base patterns, said so that no text makes them slow or deep: quantifiers are possessive wherever nothing could be given
# back, and a run is tried where it starts only. A run of an address's first part may also start where the last match
# ended (\G). Each finds the very matches of the plain pattern.
_BASE = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    CARD: r"[0-9](?:[ -]?+[0-9])++",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
_HINT = {EMAIL: r"@", IP: r"[0-9]\.[0-9]", CARD: r"[0-9][ -]?[0-9]", PHONE: r"\+[0-9]"}

#: Addresses with letters of any script, without a full domain, or with the @ and dots spelt out.
_EMAIL_LIKE = r"(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]++(?:@| ?[\[(]at[\])] ?)[\p{L}\p{N}-]++(?:(?:\.| ?[\[(]dot[\])] ?)[\p{L}\p{N}-]++)*+"
_EMAIL_LIKE_HINT = r"@|[\[(]at[\])]"
#: Between two groups of digits of one number; a number has GROUPS of them at most.
_JOINT = r"^[ \x{A0}().\-/]{1,3}\z"
GROUPS = 8

_CUES = r"(?i)(?:(mail)|(\bip\b|host|server|address)|(card|visa|credit|karte|carte|tarjeta)|(tel|phone|fon|call|fax|mobil))[^\p{L}]{0,6}\z"

#: Features of a candidate, in order; each is a small whole number.
FEATURES = ("kind", "length", "groups", "first", "last", "longest", "blank", "dash", "dot", "bracket", "other", "plus", "valid", "letter_before", "letter_after", "cue")
TREES, DEPTH, RATE, SMOOTH = 10, 3, 0.4, 1.0
#: A candidate is redacted if its calibrated probability is as high as this.
SURE = 0.9

_SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Code points of a stretch of text; a candidate is held against the base spans of three of them.
_STRETCH = 4096


def _located(pieces: Column, matches: Column) -> Column:
    """``(start, end, match)`` of each match, code points; pieces are what stands before, between and after them.

    Runs over 512 matches at a time, so that no list that grows by appending gets long.
    """
    made = "array<struct<start:int,end:int,match:string>>"
    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))).alias("spans"))

    def block(acc: Column, some: Column) -> Column:
        own = F.aggregate(some, F.struct(acc["at"].alias("at"), F.array().cast(made).alias("spans")), one)
        return F.struct(own["at"].alias("at"), F.array_append(acc["blocks"], own["spans"]).alias("blocks"))

    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(matches) - 1, F.lit(0)) / 512).cast("int"))
    blocks = F.transform(starts, lambda b: F.transform(F.slice(matches, b * 512 + 1, F.lit(512)), lambda m, i: F.struct(F.length(F.get(pieces, b * 512 + i)).alias("gap"), m.alias("match"))))
    return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{made}>").alias("blocks")), block)["blocks"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether up to 20 digits pass the Luhn test."""
    padded = F.lpad(digits, 20, "0")

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(padded, i, F.lit(1))
        return total + F.when(i % 2 == 1, F.translate(digit, "0123456789", "0246813579")).otherwise(digit).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), add) % 10 == 0


def _octet(part: Column) -> Column:
    """Whether digits say a number of at most 255."""
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.lpad(F.left(bare, F.lit(3)), 3, "0").cast("int") <= 255)


def _passes(kind: int, match: Column) -> Column:
    digits = _digits(match)
    if kind == IP:
        return F.forall(F.split(match, r"\."), _octet)
    if kind == CARD:
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == PHONE:
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _kept(kind: int, spans: Column) -> Column:
    """The matches that pass their kind's test, as spans."""
    return F.transform(F.filter(spans, lambda x: _passes(kind, x["match"])), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _matches(text: Column, hint: str, pattern: str) -> Column:
    """The matches of a pattern; it is not tried where the text lacks the hint."""
    return F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _around(text: Column, matches: Column, pattern: str) -> Column:
    """What stands before, between and after the matches."""
    return F.when(F.size(matches) > 0, F.split(text, pattern, -1)).otherwise(F.array(F.lit("")))


def _ends(pieces: Column) -> Column:
    """The first and last characters of pieces: all that features look at, however long a piece is."""
    return F.transform(pieces, lambda p: F.struct(F.left(p, F.lit(4)).alias("head"), F.right(p, F.lit(40)).alias("tail")))


def _features(kind: int, sizes: Column, joints: Column, plus: Column, valid: Column, before: Column, after: Column) -> Column:
    """See FEATURES; ``sizes`` are the lengths of the parts, ``joints`` is what stands between them."""
    flag = lambda c: c.cast("int")
    most = lambda c, n: F.least(c, F.lit(n))
    cue = F.lit(0)
    for k in (4, 3, 2, 1):
        cue = F.when(F.regexp_extract(before, _CUES, k) != "", k).otherwise(cue)
    beside = r"[\p{L}\p{N}_@]"
    return F.array(
        F.lit(kind), most(F.aggregate(sizes, F.lit(0), lambda a, x: a + x), 24), most(F.size(sizes), 9), most(F.element_at(sizes, 1), 12), most(F.element_at(sizes, -1), 12), most(F.array_max(sizes), 20),
        flag(joints.contains(" ")), flag(joints.contains("-")), flag(joints.contains(".")), flag(joints.rlike(r"[()\[]")), flag(joints.rlike(r"[^ \-.()]")), flag(plus), flag(valid),
        flag(F.right(before, F.lit(1)).rlike(beside)), flag(F.left(after, F.lit(1)).rlike(beside)), F.when(before.rlike(_CUES), cue).otherwise(0),
    )


def _candidate(kind: int, start: Column, end: Column, f: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), f.alias("f"))


def _emails(spans: Column, ends: Column) -> Column:
    """A candidate of each address-like match."""

    def one(x: Column, i: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(x["match"], r" ?[\[(]at[\])] ?", "@"), r" ?[\[(]dot[\])] ?", ".")
        labels = F.split(F.substring_index(plain, "@", -1), r"\.")
        sizes = F.transform(labels, lambda y: F.length(y))
        f = _features(EMAIL, sizes, F.lit(""), F.lit(False), (F.size(labels) > 1) & F.element_at(labels, -1).rlike(r"^\p{L}{2,}\z"), F.get(ends, i)["tail"], F.get(ends, i + 1)["head"])
        return _candidate(EMAIL, x["start"], x["end"], f)

    return F.transform(spans, one)


def _runs(groups: Column, ends: Column) -> Column:
    """Each run of up to GROUPS groups of digits that may be one number, with what it is made of and stands in."""

    def one(i: Column, j: Column) -> Column:
        own = F.slice(groups, i + 1, j - i + 1)
        return F.struct(
            F.get(groups, i)["start"].alias("start"), F.get(groups, j)["end"].alias("end"),
            F.transform(own, lambda g: g["match"]).alias("own"), F.transform(F.slice(ends, i + 2, j - i), lambda e: e["head"]).alias("joints"),
            F.get(ends, i)["tail"].alias("before"), F.get(ends, j + 1)["head"].alias("after"),
        )

    def from_one(i: Column) -> Column:
        return F.transform(F.sequence(i, F.least(i + GROUPS - 1, F.size(groups) - 1)), lambda j: one(i, j))

    first = F.slice(F.sequence(F.lit(0), F.size(groups)), F.lit(1), F.size(groups))  # 0 to size - 1, none if there are no groups
    return F.flatten(F.transform(first, lambda i: F.filter(from_one(i), lambda r: F.forall(r["joints"], lambda x: x.rlike(_JOINT)))))


def _numbers(runs: Column) -> Column:
    """Candidates of each run: an address of a host, a card, a phone with the sign or bracket before it."""

    def measured(r: Column) -> Column:
        return F.struct(r.alias("r"), F.array_join(r["own"], "").alias("digits"), F.array_join(r["joints"], "").alias("between"), F.transform(r["own"], lambda x: F.length(x)).alias("sizes"), F.regexp_extract(r["before"], r"(\+?\(?)\z", 1).alias("sign"))

    def kinds(m: Column) -> Column:
        r, n = m["r"], F.length(m["digits"])

        def of(kind: int, fits: Column, valid: Column, sign: Column) -> Column:
            before = F.left(r["before"], F.length(r["before"]) - F.length(sign))
            f = _features(kind, m["sizes"], m["between"], sign.contains("+"), valid, before, r["after"])
            return F.when(fits, _candidate(kind, r["start"] - F.length(sign), r["end"], f))

        none = F.lit("")
        return F.array(
            of(IP, F.size(m["sizes"]) == 4, F.forall(r["own"], _octet) & F.forall(r["joints"], lambda x: x == "."), none),
            of(CARD, n.between(12, 19), _luhn(m["digits"]), none),
            of(PHONE, n.between(7, 15), F.lit(True), m["sign"]),
        )

    return F.filter(F.flatten(F.transform(F.transform(runs, measured), kinds)), lambda c: c.isNotNull())


def _stretches(base: Column) -> Column:
    """The base spans by the stretch of text that they start in; one that is longer than a stretch stands in all it covers."""
    last = F.floor(F.coalesce(F.array_max(F.transform(base, lambda b: b["end"])), F.lit(0)) / _STRETCH).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.filter(base, lambda b: (F.floor(b["start"] / _STRETCH) == k) | ((b["end"] - b["start"] > _STRETCH) & (b["start"] < (k + 1) * _STRETCH) & (b["end"] > k * _STRETCH))))


def _meets(stretches: Column, c: Column) -> Column:
    """The base spans that share a character with a candidate."""
    first, last = F.floor(c["start"] / _STRETCH).cast("int"), F.floor(c["end"] / _STRETCH).cast("int")
    near = F.flatten(F.slice(stretches, F.greatest(first, F.lit(1)), last - first + 2))
    return F.filter(near, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


def propose(docs: DataFrame, text: str, base: str, candidates: str) -> DataFrame:
    """The documents with two more columns: the base spans and the candidates, each with its features and its label.

    A candidate's label is 1 if it is a base span or a base phone without its country code, null if it shares
    characters with base spans otherwise, else 0.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found, parts = docs, {}
    steps = unlike(docs.columns, *(f"{a}{k}" for k in range(6) for a in ("_m", "_p", "_s")), "_r", "_g")
    for k in range(6):
        hint, pattern = (_HINT[k], _BASE[k]) if k < 4 else ((_EMAIL_LIKE_HINT, _EMAIL_LIKE), ("[0-9]", "[0-9]++"))[k - 4]
        m, p, s = steps[3 * k : 3 * k + 3]
        found = found.withColumn(m, _matches(t, hint, pattern))
        found = found.withColumn(p, _around(t, F.col(m), pattern)).withColumn(s, _located(F.col(p), F.col(m)))
        parts[k] = s
        if k >= 4:
            found = found.withColumn(p, _ends(F.col(p)))
    found = found.withColumn(base, F.array_sort(F.concat(*(_kept(k, F.col(parts[k])) for k in range(4)))))
    runs, near = steps[18:]
    found = found.withColumn(runs, _runs(F.col(parts[5]), F.col(steps[16]))).withColumn(near, _stretches(F.col(base)))
    every = F.concat(_emails(F.col(parts[4]), F.col(steps[13])), _numbers(F.col(runs)))

    def labelled(c: Column) -> Column:
        met = _meets(F.col(near), c)
        same = F.exists(met, lambda b: (b["kind"] == c["kind"]) & (b["end"] == c["end"]) & ((b["start"] == c["start"]) | ((c["kind"] == PHONE) & (b["start"] < c["start"]) & (c["start"] - b["start"] <= 5))))
        wider = (c["kind"] == EMAIL) & F.forall(met, lambda b: (b["kind"] == EMAIL) & (c["start"] <= b["start"]) & (b["end"] <= c["end"]))
        label = F.when(same, 1).when(F.size(met) == 0, 0)
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["f"].alias("f"), label.alias("label"), ((F.size(met) == 0) | wider).alias("free"))

    found = found.withColumn(candidates, F.transform(every, labelled))
    return found.drop(*steps)


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    most: int
    low: Leaf | Split
    high: Leaf | Split


def _walk(tree: Leaf | Split, f: Column, at_leaf) -> Column:
    """What ``at_leaf`` says of the leaf that features fall into; it gets the leaf and its number (root 1, children 2n and 2n + 1)."""

    def below(t: Leaf | Split, n: int) -> Column:
        if isinstance(t, Leaf):
            return at_leaf(t, n)
        return F.when(F.get(f, F.lit(t.feature)) <= t.most, below(t.low, 2 * n)).otherwise(below(t.high, 2 * n + 1))

    return below(tree, 1)


@dataclass(frozen=True)
class Model:
    """Boosted trees over FEATURES and, by kind, the margin from which a candidate is redacted (none: no candidate is)."""

    start: float
    trees: tuple
    thresholds: tuple

    def margin(self, f: Column) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + _walk(tree, f, lambda leaf, _: F.lit(leaf.value))
        return total


def _grown(cells: DataFrame, margin: Column) -> Leaf | Split:
    """One tree of second-order boosting. Each level is one sum by node, feature and value, a few thousand rows at most."""
    p = 1 / (1 + F.exp(-margin))
    whole = lambda c: F.sum(F.round(c * 1e6).cast("long")).alias("s")  # noqa: E731  sums of integers do not depend on order
    told = cells.select("f", (F.col("pos") * (1 - p) - F.col("neg") * p).alias("g"), ((F.col("pos") + F.col("neg")) * p * (1 - p)).alias("h"))
    tree: Leaf | Split = Leaf(0.0)
    worth = lambda g, h: g * g / (h + SMOOTH)
    value = lambda g, h: RATE * g / (h + SMOOTH)
    for _ in range(DEPTH):
        node = _walk(tree, F.col("f"), lambda _, n: F.lit(n))
        rows = told.select(node.alias("node"), F.posexplode("f").alias("feature", "value"), "g", "h").groupBy("node", "feature", "value").agg(whole(F.col("g")).alias("g"), whole(F.col("h")).alias("h")).collect()
        sums: dict = {}
        for r in rows:
            sums.setdefault(r["node"], {}).setdefault(r["feature"], []).append((r["value"], r["g"] / 1e6, r["h"] / 1e6))

        def split(t: Leaf | Split, n: int, sums: dict = sums) -> Leaf | Split:
            if isinstance(t, Split):
                return Split(t.feature, t.most, split(t.low, 2 * n), split(t.high, 2 * n + 1))
            if n not in sums:
                return t
            g, h = (sum(v[k] for v in sums[n][0]) for k in (1, 2))
            best = (1e-3, t)
            for feature, values in sorted(sums[n].items()):
                left_g = left_h = 0.0
                for v, own_g, own_h in sorted(values)[:-1]:
                    left_g, left_h = left_g + own_g, left_h + own_h
                    gain = worth(left_g, left_h) + worth(g - left_g, h - left_h) - worth(g, h)
                    if gain > best[0]:
                        best = gain, Split(feature, v, Leaf(value(left_g, left_h)), Leaf(value(g - left_g, h - left_h)))
            return best[1]

        tree = split(tree, 1)
    return tree


def calibrated(bins: list[tuple[int, int, int]], sure: float) -> int | None:
    """The lowest bin from which on the isotonic probability is ``sure``, of ``(bin, positives, negatives)``; None if none is."""
    pools: list[list[int]] = []  # lowest bin, positives, negatives: probabilities rise from pool to pool
    for b, pos, neg in sorted(bins):
        pools.append([b, pos, neg])
        while len(pools) > 1 and pools[-2][1] * (pools[-1][1] + pools[-1][2]) >= pools[-1][1] * (pools[-2][1] + pools[-2][2]):
            _, pos, neg = pools.pop()
            pools[-1][1] += pos
            pools[-1][2] += neg
    return next((b for b, pos, neg in pools if pos >= sure * (pos + neg)), None)


def learn(candidates: DataFrame, scratch: Scratch) -> Model:
    """A model from ``(fold, f, label)`` of all labelled candidates: trees on the folds but 0, thresholds on fold 0.

    Equal features meet in one row with their counts, so boosting reads a small table. Without examples of both labels,
    or without a bin of held-out scores that is sure, a kind has no threshold.
    """
    counted = candidates.where("label is not null").groupBy("fold", "f").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    cells = scratch.write(counted)
    learnt = cells.where("fold <> 0")
    pos, neg = (x or 0 for x in learnt.agg(F.sum("pos"), F.sum("neg")).first())
    if not pos or not neg:
        return Model(0.0, (), (None,) * len(KINDS))
    model = Model(log(pos / neg), (), ())
    for _ in range(TREES):
        model = Model(model.start, (*model.trees, _grown(learnt, model.margin(F.col("f")))), ())
    margin = F.least(F.greatest(F.floor(model.margin(F.col("f")) * 100), F.lit(-2000)), F.lit(2000))
    held = cells.where("fold = 0").select(F.get("f", F.lit(0)).alias("kind"), margin.cast("int").alias("bin"), "pos", "neg").groupBy("kind", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
    least = [calibrated([(r["bin"], r["pos"], r["neg"]) for r in held if r["kind"] == k], SURE) for k in range(len(KINDS))]
    scratch.free(cells)
    return Model(model.start, model.trees, tuple(None if b is None else b / 100 for b in least))


def chosen(model: Model, base: Column, candidates: Column) -> Column:
    """All spans in order: the base ones, and candidates over their threshold that meet none of them.

    A longer address may hold a base one. Of candidates that share characters the first stays, of those that start
    together the best scored, then the longest.
    """
    scored = F.transform(F.filter(candidates, lambda c: c["free"]), lambda c: F.struct(c["start"].alias("start"), (-model.margin(c["f"])).alias("cost"), (-c["end"]).alias("back"), c["kind"].alias("kind")))

    def passes(x: Column) -> Column:
        out = F.lit(False)
        for k, least in enumerate(model.thresholds):
            if least is not None:
                out = out | ((x["kind"] == k) & (-x["cost"] >= least))
        return out

    def sweep(acc: Column, x: Column) -> Column:
        span = F.struct(x["start"].alias("start"), x["kind"].alias("kind"), (-x["back"]).alias("end"))
        return F.when(x["start"] >= acc["at"], F.struct((-x["back"]).alias("at"), F.array_append(acc["spans"], span).alias("spans"))).otherwise(acc)

    added = F.aggregate(F.array_sort(F.filter(scored, passes)), F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans")), sweep)["spans"]
    return F.array_sort(F.array_distinct(F.concat(base, added)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _fold(docs: DataFrame) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)), F.lit(1)).cast("int")


def find_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` of each document: its base spans and all spans, ``(start, kind, end)`` in code points.

    Base spans are the leftmost matches of each kind's pattern that pass its test. Generators propose wider candidates
    (addresses of any script or spelt out, every run of groups of digits); boosted trees, learnt from all candidates
    of this table that a base span labels, score them, and those over their kind's calibrated threshold are added.
    One row a document, repeated rows too. Null and empty texts have no spans. A null doc_id learns with the others.
    """
    scratch = Scratch(spark, "pii")
    found = scratch.write(propose(docs.select("doc_id", "text"), "text", "base", "candidates").select("doc_id", "base", "candidates"))
    model = learn(found.select(_fold(found).alias("fold"), F.explode("candidates").alias("c")).select("fold", "c.f", "c.label"), scratch)
    return found.select("doc_id", "base", chosen(model, F.col("base"), F.col("candidates")).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents, all columns, with each span of ``text`` replaced by its kind in brackets; a null text stays null.

    Spans that share characters become one, named by the first. The model is that of :func:`find_spans`.
    """
    scratch = Scratch(spark, "pii")
    found = scratch.write(propose(docs.select("doc_id", "text"), "text", "base", "candidates").select("doc_id", "candidates"))
    model = learn(found.select(_fold(found).alias("fold"), F.explode("candidates").alias("c")).select("fold", "c.f", "c.label"), scratch)
    scratch.free(found)
    base, candidates, spans = unlike(docs.columns, "_base", "_candidates", "_spans")
    out = propose(docs, "text", base, candidates).withColumn(spans, chosen(model, F.col(base), F.col(candidates)))
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)

    def add(acc: Column, s: Column) -> Column:
        grown = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        own = F.struct(s["end"].alias("at"), F.array_append(F.array_append(acc["out"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])), F.concat(F.lit("["), name(s["kind"]), F.lit("]"))).alias("out"))
        return F.when(s["start"] < acc["at"], grown).otherwise(own)

    parts = F.aggregate(F.col(spans), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), add)
    masked = F.when(F.size(spans) == 0, F.col("text")).otherwise(F.concat(F.array_join(parts["out"], ""), F.substr(F.col("text"), parts["at"] + 1, F.length("text"))))
    return out.withColumn("text", masked).select(*docs.columns)
