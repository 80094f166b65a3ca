"""Fuzzy search against every alignment of short names, and its defined cases."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tickloom.operators import search


def bonus(name, j):
    if j == 0:
        return 24
    a, b = name[j - 1], name[j]
    if not re.match(r"[^\W_]", a):
        return 20
    if a == a.lower() and b != b.lower():
        return 14
    return 10 if not a.isdigit() and b.isdigit() else 0


def score(name, places):
    """A run goes on for 34, or is a step like any other if that gives more."""
    total = max(-2 * places[0], -30) + 16 + bonus(name, places[0])
    for a, b in zip(places, places[1:]):
        total += max(34, 16 + bonus(name, b)) if b == a + 1 else -3 * (b - a - 1) + 16 + bonus(name, b)
    return total - (len(name) - 1 - places[-1])


def best(needle, name):
    low, low_name = search.fold_text(needle), search.fold_text(name)
    if len(low) == len(low_name):
        return 16 + 24 + 34 * (len(low) - 1) + 32 if low == low_name else None
    found = [score(name, p) for p in combinations(range(len(name)), len(low)) if all(low_name[j] == c for c, j in zip(low, p))]
    return max(found, default=None)


NAMES = ["SuperTrend", "Média Móvel", "Bollinger", "exponential Moving Average", "EMA", "ema", "rsi14", "RSI 14", "a-b_c", "ÀÉÎ õü", "aaa", "ab", "", "x" * 30 + "ema", "日本 ema", "İstanbul"]


@pytest.mark.parametrize("needle", ["ema", "st", "media", "14", "bol", "a", "ÉMA", "aa", "xyz", "日", "e a"])
def test_best_of_all_alignments(spark, needle):
    rng = random.Random(needle)
    names = NAMES + ["".join(rng.choice("aeMmst 14_É") for _ in range(rng.randrange(1, 14))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = {r.i: r.m for r in df.select("i", search.fuzzy_match(needle, F.col("name")).alias("m")).collect()}
    for i, name in enumerate(names):
        want = best(needle, name)
        assert (got[i] and got[i].score) == want, (needle, name, got[i], want)
        if want is not None:
            p = got[i].places
            assert [search.fold_text(name[j]) for j in p] == list(search.fold_text(needle)) and p == sorted(set(p))
            assert len(name) == len(needle) or score(name, p) == want


def test_rank_ranges_and_the_rest(spark):
    df = spark.createDataFrame(list(enumerate([*NAMES, None])), "i int, name string")
    ranked = search.fuzzy_rank(df, "ema", "name", "i").collect()
    assert [r.name for r in ranked][:2] == ["EMA", "ema"] and [tuple(x) for x in ranked[0].ranges] == [(0, 3)]
    assert [tuple(x) for r in ranked if r.name.startswith("exp") for x in r.ranges] == [(0, 1), (12, 13), (19, 20)]
    assert [r.i for r in search.fuzzy_rank(df, "", "name", "i").collect()] == list(range(len(NAMES)))  # as they came
    assert len(search.fuzzy_rank(df, "e", "name", "i", 3).collect()) == 3
    long = spark.createDataFrame([("e" + "x" * 40_000 + "ma",)], "name string")
    (row,) = long.select(search.fuzzy_match("ema", F.col("name")).alias("m")).collect()  # the first alignment
    assert row.m.places == [0, 40_001, 40_002] and row.m.score == 16 + 24 - 3 * 40_000 + 16 + 34
