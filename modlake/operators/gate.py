"""The rule gate: declarative rules of three kinds and three actions over documents."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import SPAN, folded, normalise, trimmed
from .terms import TOKEN, Terms, places, tokens

ACTIONS = ("block", "revise", "flag")


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression; words: whole words or phrases; targeted: a subject and a term in one sentence.

    ``excluded`` takes terms out of ``file_terms`` only: what a rule lists itself stays.
    """

    id: str
    category: str
    action: str
    kind: str = "pattern"
    pattern: str = ""
    terms: tuple[str, ...] = ()
    subjects: tuple[str, ...] = ()
    surfaces: tuple[str, ...] | None = None
    file_terms: tuple[str, ...] = ()
    excluded: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        if self.action not in ACTIONS or self.kind not in ("pattern", "words", "targeted"):
            raise ValueError(f"rule {self.id}: unknown action or kind")

    @functools.cached_property
    def listed(self) -> Terms:
        out = {normalise(t)[0] for t in self.excluded}
        return Terms([*self.terms, *(t for t in self.file_terms if normalise(t)[0] not in out)])

    @functools.cached_property
    def named(self) -> frozenset[str]:
        return frozenset(normalise(x)[0] for x in self.subjects)

    @property
    def active(self) -> bool:
        return bool(self.pattern or self.listed) and (self.kind != "targeted" or bool(self.subjects))

    @property
    def expression(self) -> str:
        """Of a pattern rule: its pattern, or a listed term anywhere. For Java and the ``regex`` package."""
        parts = [self.pattern] if self.pattern else []
        return "|".join(f"(?:{p})" for p in (*parts, *map(re.escape, self.listed.listed)))


_ENDS = r"[.!?]+(?=\s|\z)|[।॥]+"


def _subject(rule: Rule, toks: Column) -> Column:
    """Whether a subject is among tokens, as it is or before an apostrophe."""
    return F.exists(toks, lambda t: t.isin(*rule.named) | F.substring_index(t, "'", 1).isin(*rule.named))


def _addressed(rule: Rule, norm: Column) -> Column:
    """Of each sentence with a subject: it and its places."""
    told = F.transform(F.split(norm, _ENDS), lambda s: F.struct(s.alias("s"), tokens(s).alias("t")))
    return F.transform(F.filter(told, lambda x: _subject(rule, x["t"])), lambda x: F.struct(x["s"].alias("s"), places(x["t"], [rule.listed]).alias("p")))


def fires(rule: Rule, norm: Column, found: Column) -> Column:
    """Whether a rule fires on normalised text, given the places of all lists in it."""
    if rule.kind == "pattern":
        return norm.rlike("(?i)" + rule.expression)
    listed = rule.listed.fires(found, norm)
    if rule.kind == "words":
        return listed
    # sentences are looked at only where the text has a term at all
    return F.when(listed, F.exists(_addressed(rule, norm), lambda x: rule.listed.fires(x["p"], x["s"]))).otherwise(False)


def hits(rule: Rule, norm: Column, found: Column) -> Column:
    if rule.kind == "pattern":
        return F.regexp_count(norm, F.lit("(?i)" + rule.expression))
    if rule.kind == "words":
        return rule.listed.count(found, norm)
    return F.aggregate(_addressed(rule, norm), F.lit(0), lambda a, x: a + rule.listed.count(x["p"], x["s"]))


def check(docs: DataFrame, rules: list[Rule], text: str = "text", surface: str | None = None) -> DataFrame:
    """Adds ``gate_matches`` (array of rule_id, category, action, hits), ``blocked``, ``needs_revision`` and ``flagged``.

    Texts are normalised once, so that widths, case and invisible characters hide nothing. Rules run in order of
    action, then of the list, up to the first block, which is then the only match. A rule without surfaces, or a row
    without one, is not restricted. Null texts match nothing.
    """
    norm, found = "_norm", "_found"
    while norm in docs.columns or found in docs.columns:
        norm, found = "_" + norm, "_" + found
    order = sorted((r for r in rules if r.active), key=lambda r: ACTIONS.index(r.action))

    def says(r: Rule) -> Column:
        out = F.coalesce(fires(r, F.col(norm), F.col(found)), F.lit(False))
        return (F.col(surface).isNull() | F.col(surface).isin(*r.surfaces)) & out if r.surfaces is not None and surface else out

    def report(r: Rule) -> Column:
        return F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.action).alias("action"), hits(r, F.col(norm), F.col(found)).cast("int").alias("hits"))

    none = F.array().cast("array<struct<rule_id:string,category:string,action:string,hits:int>>")
    others = [F.when(says(r), report(r)) for r in order if r.action != "block"]
    reports = F.filter(F.array(*others), lambda m: m.isNotNull()) if others else none
    chain = None
    for r in order:
        if r.action == "block":  # the first that fires ends the reading
            chain = F.when(says(r), F.array(report(r))) if chain is None else chain.when(says(r), F.array(report(r)))
    out = docs.withColumn(norm, folded(F.col(text)))
    out = out.withColumn(found, places(tokens(F.coalesce(norm, F.lit(""))), [r.listed for r in order if r.kind != "pattern"]))
    out = out.withColumn("gate_matches", reports if chain is None else chain.otherwise(reports)).drop(norm, found)
    has = lambda a: F.exists("gate_matches", lambda m: m.action == a)
    return out.withColumn("blocked", has("block")).withColumn("needs_revision", has("revise")).withColumn("flagged", has("flag"))


def match_spans(text: str | None, rule: Rule) -> list[tuple[int, int]]:
    """Where a rule's finds stand in the text as written; of a targeted rule the terms of sentences with a subject."""
    norm, source = normalise(text or "")
    if rule.kind == "pattern":
        found = [m.span() for m in regex.finditer(rule.expression, norm, regex.I)]
    elif rule.kind == "words":
        found = rule.listed.spans(norm)
    else:
        edges = [0, *(x for m in regex.finditer(_ENDS.replace(r"\z", r"\Z"), norm) for x in m.span()), len(norm)]
        said = lambda a, b: any(t in rule.named or t.split("'")[0] in rule.named for t in regex.findall(TOKEN, norm, pos=a, endpos=b))
        found = [s for a, b in zip(edges[::2], edges[1::2]) if said(a, b) for s in rule.listed.spans(norm, a, b)]
    return [trimmed(text, source[a], source[b - 1] + 1) for a, b in found if b > a]


def located(docs: DataFrame, rules: list[Rule], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, rule_id, start, end`` of every find of the rules that fired on the rows of check(); only these are read again."""
    by_id = {r.id: r for r in rules}

    @F.pandas_udf(SPAN)
    def spans(texts: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e} for s, e in match_spans(t, by_id[i])] for t, i in zip(texts, ids)])

    # outer, since a filter for lists that are empty would run the gate and the search a second time
    fired = docs.select(key, text, F.explode_outer("gate_matches.rule_id").alias("rule_id")).where("rule_id is not null")
    return fired.select(key, "rule_id", F.explode_outer(spans(text, "rule_id")).alias("s")).where("s is not null").select(key, "rule_id", "s.start", "s.end")


#: A small pack of our own words, in kind like a moderation service's.
DEFAULT_RULES = [
    Rule("abuse.words", "abuse", "block", "words", terms=("idiot", "scum", "moron")),
    Rule("abuse.targeted", "abuse", "block", "targeted", terms=("pathetic", "useless"), subjects=("you", "they", "he", "she", "it")),
    Rule("spam.shortener", "spam", "flag", "pattern", pattern=r"\b(?:bit\.ly|tinyurl\.com|t\.co)/\w+"),
    Rule("contact.mail", "contact", "revise", "pattern", pattern=r"[\w.+-]+@[\w-]+\.\w+"),
    Rule("secret.key", "secret", "block", "pattern", pattern=r"\bakia[0-9a-z]{16}\b"),
    Rule("licence.notice", "licence", "flag", "words", terms=("all rights reserved", "released under the mit license")),
    Rule("shouting", "style", "flag", "pattern", pattern=r"!!\s+\w+!!", surfaces=("src0", "src1")),
]
