"""Noise for training texts: the same for a row however rows are dealt out, since each draw is a hash of key, name and place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What letters are disguised as.
DISGUISES = {"a": ["4", "@"], "e": ["3"], "i": ["1", "!"], "o": ["0"], "s": ["5", "$"], "t": ["7"]}
ARTICLES = ("the", "a", "an", "The", "A", "An")
#: Pairs that people mix up; a corpus of another language passes its own.
SWAPS = {"is": "are", "are": "is", "was": "were", "were": "was", "has": "have", "have": "has", "do": "does", "does": "do", "their": "there", "your": "you're", "its": "it's", "then": "than", "to": "too"}
ENDINGS = ("!!", "!!!", " :)", " 🙏", " 👍", ".")


class Draws:
    """Uniform numbers in [0, 1) by row key, name and place; nothing depends on partitions or on order."""

    def __init__(self, key: Column, seed: int = 0):
        self.key, self.seed = key.cast("string"), seed

    def __call__(self, name: str, *place: Column | int) -> Column:
        places = [p.cast("long") if isinstance(p, Column) else F.lit(p).cast("long") for p in place]
        h = F.xxhash64(F.lit(self.seed).cast("long"), self.key, F.lit(name), *places)
        return h.bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))

    def below(self, n: Column | int, name: str, *place: Column | int) -> Column:
        """A whole number from 0 to n - 1."""
        return F.floor(self(name, *place) * n).cast("int")


def _one_of(items: tuple | list, u: Column) -> Column:
    return F.get(F.array(*map(F.lit, items)), F.floor(u * len(items)).cast("int"))


def _chars(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))


def _words(text: Column, change: Callable[[Column], Column]) -> Column:
    """The words between single blanks, changed as an array and joined again; the array is made once."""
    return F.transform(F.array(F.split(text, " ")), lambda w: F.array_join(change(w), " "))[0]


def leetspeak(text: Column, draws: Draws, rate: float = 0.35) -> Column:
    """Words of over three characters, each with this rate, get half of their letters a e i o s t disguised."""

    def letter(c: Column, i: Column, j: Column) -> Column:
        out = c
        for plain, signs in DISGUISES.items():
            out = F.when(F.lower(c) == plain, _one_of(signs, draws("leet.sign", i, j))).otherwise(out)
        return F.when(draws("leet.letter", i, j) < 0.5, out).otherwise(c)

    def word(w: Column, i: Column) -> Column:
        return F.when((F.length(w) > 3) & (draws("leet.word", i) < rate), F.array_join(F.transform(_chars(w), lambda c, j: letter(c, i, j)), "")).otherwise(w)

    return _words(text, lambda ws: F.transform(ws, word))


def spaced(text: Column, draws: Draws) -> Column:
    """One or two of the words of over three characters have a blank, point, dash or star between their characters."""

    def change(ws: Column) -> Column:
        long = F.filter(F.transform(ws, lambda w, i: F.struct(draws("spaced.rank", i).alias("u"), i.alias("i"), F.length(w).alias("n"))), lambda x: x["n"] > 3)
        chosen = F.transform(F.slice(F.array_sort(long), F.lit(1), 1 + draws.below(2, "spaced.count")), lambda x: x["i"])
        told = F.transform(F.array(chosen), lambda at: F.transform(ws, lambda w, i: F.when(F.array_contains(at, i), F.array_join(F.transform(_chars(w), lambda c, j: F.when(j == 0, c).otherwise(F.concat(_one_of((" ", ".", "-", "*"), draws("spaced.sign", i)), c))), "")).otherwise(w)))
        return told[0]

    return _words(text, change)


def _without_articles(ws: Column, most: Column) -> Column:
    at = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(*ARTICLES) & (i < F.size(ws) - 1), i)), lambda i: i.isNotNull())
    return F.transform(F.array(F.slice(at, F.lit(1), most)), lambda gone: F.filter(ws, lambda w, i: ~F.array_contains(gone, i)))[0]


def _swapped(ws: Column, swaps: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in swaps.items() for x in pair))
    first = F.array_min(F.filter(F.transform(ws, lambda w, i: F.when(w.isin(*swaps), i)), lambda i: i.isNotNull()))
    return F.transform(F.array(first), lambda at: F.transform(ws, lambda w, i: F.when(i == at, table[w]).otherwise(w)))[0]


def _run_on(ws: Column) -> Column:
    """The first two full stops before another word become commas, and what follows goes on in lower case."""
    at = F.slice(F.filter(F.transform(ws, lambda w, i: F.when(w.rlike(r"[^.]\.\z") & (i < F.size(ws) - 1), i)), lambda i: i.isNotNull()), F.lit(1), F.lit(2))

    def change(at: Column) -> Column:
        ended = lambda w, i: F.when(F.array_contains(at, i), F.concat(F.left(w, F.length(w) - 1), F.lit(","))).otherwise(w)
        begun = lambda w, i: F.when(F.array_contains(at, i - 1), F.concat(F.lower(F.left(w, F.lit(1))), F.substr(w, F.lit(2), F.length(w)))).otherwise(w)
        return F.transform(ws, lambda w, i: begun(ended(w, i), i))

    return F.transform(F.array(at), change)[0]


def bad_grammar(text: Column, draws: Draws, swaps: dict[str, str] = SWAPS) -> Column:
    """One to three slips: articles lost, a form mixed up, no full stop or capital, a run-on, a doubled word."""

    def slip(t: Column, k: Column) -> Column:
        r = draws("grammar.kind", k)

        def doubled(ws: Column) -> Column:
            i = draws.below(F.size(ws), "grammar.word", k)
            return F.when(F.size(ws) > 3, F.concat(F.slice(ws, F.lit(1), i + 1), F.slice(ws, i + 1, F.size(ws)))).otherwise(ws)

        bare = F.regexp_replace(t, r"[.!?]+\z", "")
        plain = F.concat(F.lower(F.left(bare, F.lit(1))), F.substr(bare, F.lit(2), F.length(bare)))
        return (
            F.when(r < 0.30, _words(t, lambda ws: _without_articles(ws, 1 + draws.below(3, "grammar.articles", k)))).when(r < 0.70, _words(t, lambda ws: _swapped(ws, swaps)))
            .when(r < 0.80, plain).when(r < 0.90, _words(t, _run_on)).otherwise(_words(t, doubled))
        )

    return F.aggregate(F.sequence(F.lit(0), draws.below(3, "grammar.count")), text, slip)


def noise(text: Column, draws: Draws, swaps: dict[str, str] = SWAPS) -> Column:
    """Changes of the surface that leave the label as it is: a quarter get bad grammar, then 6 % each go to capitals, to
    small letters and to another ending, and 4 % lose a character. Null stays null."""
    own = F.when(draws("noise.grammar") < 0.25, bad_grammar(text, draws, swaps)).otherwise(text)
    r = draws("noise.kind")

    def change(t: Column) -> Column:
        i = draws.below(F.greatest(F.length(t) - 1, F.lit(1)), "noise.place")
        lost = F.concat(F.left(t, i), F.substr(t, i + 2, F.length(t)))
        ended = F.concat(F.regexp_replace(t, r"\.+\z", ""), _one_of(ENDINGS, draws("noise.ending")))
        return F.when(r < 0.06, F.upper(t)).when(r < 0.12, F.lower(t)).when(r < 0.18, ended).when(r < 0.22, lost).otherwise(t)

    return F.transform(F.array(own), change)[0]


def obfuscate(text: Column, draws: Draws) -> Column:
    """15 % of texts in leetspeak, 7 % with spaced words, the others as they are."""
    r = draws("obfuscate.kind")
    return F.when(r < 0.15, leetspeak(text, draws)).when(r < 0.22, spaced(text, draws)).otherwise(text)
