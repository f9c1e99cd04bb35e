"""Word lists of any size against texts: sets of tokens looked up once a token, so that a longer list costs no more."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cached_property

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import normalise

_W = r"[\p{L}\p{M}\p{N}_]"
#: A token: letters, marks, numbers and underscores, with apostrophes and hyphens inside. For Java and the regex package.
TOKEN = rf"{_W}++(?:['-]{_W}++)*+"
_CLEAN = regex.compile(rf"{TOKEN}(?: {TOKEN})*")
_TOKENS = regex.compile(TOKEN)


def tokens(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(TOKEN), F.lit(0))


def _forms(word: str) -> set[str]:
    """A listed word and the tokens that read as its plural: -s but not -ss, -es only after s, x, z, ch, sh."""
    out = {word}
    if len(word) > 1 and not word.endswith("s"):
        out.add(word + "s")
    if len(word) > 1 and word.endswith(("s", "x", "z", "ch", "sh")):
        out.add(word + "es")
    return out


class Terms:
    """Listed words and phrases over normalised text, found on whole tokens from left to right, none overlapping.

    At a token a listed word or its plural wins, else the longest phrase that begins there. What stands between the
    tokens of a phrase does not matter. Terms with other symbols are found as written where no token character touches
    them.
    """

    def __init__(self, terms: Iterable[str]):
        self.listed = sorted({n for t in terms if (n := normalise(t)[0])})
        clean = [tuple(t.split(" ")) for t in self.listed if _CLEAN.fullmatch(t)]
        self.words = frozenset(form for t in clean if len(t) == 1 for form in _forms(t[0]))
        self.phrases = {n: frozenset(" ".join(t) for t in clean if len(t) == n) for n in sorted({len(t) for t in clean} - {1}, reverse=True)}
        self.starts = frozenset(t[0] for t in clean if len(t) > 1)
        odd = sorted((t for t in self.listed if not _CLEAN.fullmatch(t)), key=lambda t: (-len(t), t))
        self.odd = rf"(?<!{_W})(?:{'|'.join(map(re.escape, odd))})(?!{_W})" if odd else None

    def __bool__(self) -> bool:
        return bool(self.listed)

    @cached_property
    def first(self) -> frozenset[str]:
        """Tokens at which a find may begin."""
        return self.words | self.starts

    def length(self, m: Column) -> Column:
        """Tokens of the find at a place of :func:`places`, 0 if there is none."""
        out = F.lit(0)
        for n in reversed(self.phrases):  # the longest is asked first
            out = F.when(F.array_join(F.slice(m["next"], 1, n), " ").isin(*self.phrases[n]), n).otherwise(out)
        if self.phrases:
            out = F.when(F.get(m["next"], F.lit(0)).isin(*self.starts), out).otherwise(0)
        return F.when(F.get(m["next"], F.lit(0)).isin(*self.words), 1).otherwise(out) if self.words else out

    def fires(self, found: Column, norm: Column) -> Column:
        """Whether anything is found, given :func:`places` of the text."""
        out = F.exists(found, lambda m: self.length(m) > 0)
        return out | norm.rlike(self.odd) if self.odd else out

    def count(self, found: Column, norm: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            n = self.length(m)
            return F.when((m["at"] >= acc["free"]) & (n > 0), F.struct((m["at"] + n).alias("free"), (acc["n"] + 1).alias("n"))).otherwise(acc)

        n = F.aggregate(found, F.struct(F.lit(0).alias("free"), F.lit(0).alias("n")), step)["n"]
        return n + F.regexp_count(norm, F.lit(self.odd)) if self.odd else n

    def spans(self, norm: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
        """The finds in part of one text, as offsets."""
        end = len(norm) if end is None else end
        found, out, i = list(_TOKENS.finditer(norm, start, end)), [], 0
        while i < len(found):
            n = 1 if found[i][0] in self.words else 0
            if not n and found[i][0] in self.starts:
                n = next((k for k in self.phrases if " ".join(t[0] for t in found[i : i + k]) in self.phrases[k]), 0)
            if n:
                out.append((found[i].start(), found[i + n - 1].end()))
            i += n or 1
        if self.odd:
            out += [m.span() for m in regex.finditer(self.odd, norm, pos=start, endpos=end)]
        return sorted(out)


def places(toks: Column, lists: Iterable[Terms]) -> Column:
    """``(at, next)`` of each token at which a find of any list may begin: its number, and it with those after it.

    All lists share this one pass over the tokens; what they ask afterwards is asked of these places only.
    """
    lists = [t for t in lists if t.first]
    first = frozenset().union(*(t.first for t in lists)) if lists else frozenset({""})
    longest = max((n for t in lists for n in t.phrases), default=1)

    def of(own: Column) -> Column:
        marked = F.filter(F.transform(own, lambda t, i: F.struct(i.alias("at"), t.alias("t"))), lambda m: m["t"].isin(*first))
        return F.transform(marked, lambda m: F.struct(m["at"].alias("at"), F.slice(own, m["at"] + 1, F.lit(longest)).alias("next")))

    # one element, so that the tokens are made once and not for each place
    return F.transform(F.array(toks), of)[0]


def lexicon_hit(text: Column, lexicon: Iterable[str], lookalikes: str = "$@013457!", letters: str = "saoieasti", least: int = 3) -> Column:
    """Whether a listed term stands in the text, lower-cased and with look-alikes as letters, no a-z touching it.

    Terms under ``least`` characters are left out. Terms of letters a-z are looked up run by run, whatever their
    number; others, few in such lists, are found by a pattern. Null texts have none.
    """
    terms = sorted({t.strip().lower() for t in lexicon if len(t.strip()) >= least})
    plain, other = [t for t in terms if re.fullmatch("[a-z]+", t)], [t for t in terms if not re.fullmatch("[a-z]+", t)]
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), lookalikes, letters)
    out = F.exists(F.split(bare, "[^a-z]+"), lambda w: w.isin(*plain)) if plain else F.lit(False)
    return out | bare.rlike(rf"(?<![a-z])(?:{'|'.join(map(re.escape, sorted(other, key=len, reverse=True)))})(?![a-z])") if other else out
