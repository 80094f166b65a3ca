"""Fuzzy search: a needle as a subsequence of names, without regard to case and accents, scored by its best alignment.

The alignment is dynamic programming as a fold over a name's characters: its state is, for each letter of the needle, the
best score with that letter at the last character and the best so far, each with the places it took. All of it is SQL expressions.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The weights of the score.
MATCH, CONSECUTIVE = 16.0, 34.0
START, WORD_START, CAMEL, DIGIT_START, EXACT = 24.0, 20.0, 14.0, 10.0, 32.0
LEADING, LEADING_MOST, INNER, TRAILING = -2.0, -30.0, -3.0, -1.0
#: Cells of needle times name beyond which the first alignment is scored instead of the best.
CELLS = 512 * 64
NEVER = -1e15


def _fold_char(c: str) -> str:
    low = c.lower() if len(c.lower()) == 1 else c
    base = "".join(x for x in unicodedata.normalize("NFD", low) if not 0x300 <= ord(x) <= 0x36F)
    return base if len(base) == 1 else low


#: Letters of the alphabets with accents, and what each folds to; made by the rule above.
ACCENTED = "".join(chr(i) for a, b in ((0xC0, 0x24F), (0x370, 0x52F), (0x1E00, 0x1FFF)) for i in range(a, b + 1) if _fold_char(chr(i)) != chr(i))
PLAIN = "".join(_fold_char(c) for c in ACCENTED)


def fold(c: Column) -> Column:
    """Lower case without accents, character by character, so places stay what they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ACCENTED, "abcdefghijklmnopqrstuvwxyz" + PLAIN)


def fold_text(text: str) -> str:
    return "".join(map(_fold_char, text))


def _bonus(own: Column, before: Column) -> Column:
    """Of a letter after another, by what begins there: a word, a capital, a number."""
    return (
        F.when(~before.rlike(r"[\p{L}\p{N}]"), WORD_START)
        .when((before == F.lower(before)) & (own != F.lower(own)), CAMEL)
        .when(~before.rlike(r"\p{Nd}") & own.rlike(r"\p{Nd}"), DIGIT_START)
        .otherwise(0.0)
    )


def _better(a: Column, b: Column) -> Column:
    """The alignment with the higher score; of equal ones the first."""
    return F.when(a["score"] >= b["score"], a).otherwise(b)


def fuzzy_match(needle: str, name: Column) -> Column:
    """struct(score, places): the best alignment of the needle with a name, places counted from 0; null where it isn't a subsequence.

    An empty needle fits every name with score 0. A null name fits nothing. Of alignments that score the same,
    the one with later places is taken, except that a run goes on.
    """
    kind = "struct<score:double,places:array<int>>"
    if needle == "":
        return F.when(name.isNotNull(), F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("places")).cast(kind))
    letters = list(fold_text(needle))
    m, n = len(letters), F.length(name)
    number = F.array(*map(F.lit, letters))
    at = lambda a, i: F.get(a, F.lit(i))
    none = F.struct(F.lit(NEVER).alias("score"), F.array().cast("array<int>").alias("places"))
    plus = lambda s, x: F.struct((s["score"] + x).alias("score"), s["places"].alias("places"))
    to = lambda s, x, j: F.struct((s["score"] + x).alias("score"), F.concat(s["places"], F.array(j)).alias("places"))

    # what a fold needs of each character, made once: itself, its place, what a match there begins with
    own = F.split(name, "")
    zipped = F.arrays_zip(F.split(fold(name), "").alias("c"), own.alias("own"), F.concat(F.array(F.lit("")), F.slice(own, 1, F.greatest(n - 1, F.lit(0)))).alias("before"))
    cells = F.transform(zipped, lambda x, j: F.struct(x["c"].alias("c"), j.alias("j"), F.when(j == 0, START).otherwise(_bonus(x["own"], x["before"])).alias("bonus")))
    leading = lambda x: F.greatest(x["j"] * LEADING, F.lit(LEADING_MOST)) + MATCH + x["bonus"]

    def column(state: Column, x: Column) -> Column:
        """The state after one more character."""
        hit = []
        for i, letter in enumerate(letters):
            if i == 0:
                here = F.struct(leading(x).alias("score"), F.array(x["j"]).alias("places"))
            else:
                # a run that goes on, or a step from the best so far
                here = _better(to(at(state["hit"], i - 1), CONSECUTIVE, x["j"]), to(at(state["best"], i - 1), MATCH + x["bonus"], x["j"]))
            hit.append(F.when(x["c"] == letter, here).otherwise(none).cast(kind))
        gaps = F.array(*(plus(at(state["best"], i), TRAILING if i == m - 1 else INNER) for i in range(m)))
        return _bind(F.array(*hit), lambda h: F.struct(h.alias("hit"), F.zip_with(h, gaps, _better).alias("best")))

    empty = F.array(*[none] * m).cast(f"array<{kind}>")
    best = F.aggregate(cells, F.struct(empty.alias("hit"), empty.alias("best")), column, lambda s: at(s["best"], m - 1))

    def first(state: Column, x: Column) -> Column:
        """The first places that fit, one letter after another, and their score."""
        skipped = x["j"] - F.coalesce(F.try_element_at(state["places"], F.lit(-1)), F.lit(-1)) - 1
        more = F.when(F.size(state["places"]) == 0, leading(x)).when(skipped == 0, CONSECUTIVE).otherwise(skipped * INNER + MATCH + x["bonus"])
        return F.when(F.get(number, F.size(state["places"])) == x["c"], to(state, more, x["j"]).cast(kind)).otherwise(state)

    greedy = F.aggregate(cells, F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("places")).cast(kind), first)
    whole = F.struct(F.lit(MATCH + START + (m - 1) * CONSECUTIVE + EXACT).alias("score"), F.sequence(F.lit(0), F.lit(m - 1)).alias("places")).cast(kind)

    def choose(g: Column) -> Column:
        fits = F.size(g["places"]) == m
        left = (n - 1 - F.try_element_at(g["places"], F.lit(-1))) * TRAILING
        return F.when(fits & (n == m), whole).when(fits & (n * m > CELLS), plus(g, left).cast(kind)).when(fits, best)

    return F.when((n >= m) & (n > 0), _bind(greedy, choose))


def _bind(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), f), 0)


def fuzzy_rank(items: DataFrame, needle: str, name: str, order: str, k: int | None = None) -> DataFrame:
    """``items`` that the needle fits, with score and ranges (half-open), best first, equal scores by ``order``; ``k`` of them at most."""
    found = items.withColumn("__m", fuzzy_match(needle, F.col(name))).where("__m is not null")
    found = found.select(*items.columns, F.col("__m.score").alias("score"), ranges(F.col("__m.places")).alias("ranges")).orderBy(F.desc("score"), order)
    return found if k is None else found.limit(k)


def ranges(places: Column) -> Column:
    """Places that follow each other as half-open ranges."""
    one = lambda a, b: F.struct(a.alias("start"), b.alias("end"))

    def add(out, p):
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(one(last["start"], p + 1)))
        return F.when(last["end"] == p, joined).otherwise(F.concat(out, F.array(one(p, p + 1))))

    return F.aggregate(places, F.array().cast("array<struct<start:int,end:int>>"), add)
