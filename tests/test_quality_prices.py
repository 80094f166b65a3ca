"""Verdicts by hand for each rule of a profile; levels and texts of prices by plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators import prices, quality
from tickloom.operators.analytics import Sessions

#: Monday 2024-01-01 12:00 UTC, 09:00 three hours behind.
MONDAY = 1_704_110_400
FUTURES = Sessions({d: (9 * 60, 18 * 60 + 35) for d in range(1, 6)})


def verdict(spark, times, period=3600, sides=True, **profile):
    rows = [("A", t, 1.0 if sides else None, 1.0) for t in times]
    (r,) = quality.report(spark.createDataFrame(rows, "symbol string, time long, buy_volume double, sell_volume double"), period, quality.Profile(**profile)).collect()
    return r


def test_each_rule(spark):
    hours = [MONDAY + 3600 * i for i in range(9)]
    assert verdict(spark, hours).verdict == "OK"
    # incomplete hours fail by the last bar; days don't
    r = verdict(spark, hours, incomplete_from=hours[-1])
    assert r.verdict == "FAILED" and r.reasons == ["intraday bars lack trades"]
    assert verdict(spark, hours, incomplete_from=hours[-1] + 1).verdict == "OK"
    assert verdict(spark, hours, 86_400, incomplete_from=0).verdict == "OK"
    # a rule for the period, and only for it
    rules = (quality.PeriodRule(60, "FAILED"), quality.PeriodRule(300, "CAUTION", "by hand"), quality.PeriodRule(900, vetted=(None, 0)))
    assert verdict(spark, hours, rules=rules).verdict == "OK"
    assert verdict(spark, hours, 60, rules=rules).verdict == "FAILED"
    assert verdict(spark, hours, 300, rules=rules).reasons == ["by hand"]
    # the rule's window comes before the profile's
    assert verdict(spark, hours, 900, rules=rules, vetted=(0, None)).unvetted == 9
    assert verdict(spark, hours, vetted=(0, None)).unvetted == 0
    r = verdict(spark, hours, vetted=(hours[1], hours[6]))
    assert r.unvetted == 3 and r.verdict == "CAUTION"
    # sides count only where a least share is declared, and both must be there; they needn't make up the volume
    assert verdict(spark, hours, sides=False).verdict == "OK" and verdict(spark, hours, sides=False).side_share == 0
    assert verdict(spark, hours, sides=False, least_sides=0.1).verdict == "CAUTION"
    assert verdict(spark, hours, least_sides=1.0).verdict == "OK"


def test_bars_outside_sessions(spark):
    inside = [MONDAY + 60 * i for i in range(99)]
    night = MONDAY - 6 * 3600
    assert verdict(spark, inside, 60, sessions=FUTURES).verdict == "OK"
    assert verdict(spark, [*inside, night], 60, sessions=FUTURES, tolerated_outside=0.02).verdict == "OK"  # one of a hundred
    assert verdict(spark, [*inside, night], 60, sessions=FUTURES).verdict == "CAUTION"
    assert verdict(spark, [*inside[:19], night], 60, sessions=FUTURES, tolerated_outside=0.02).verdict == "FAILED"  # a twentieth
    assert verdict(spark, [night], 60).outside == 0  # none declared
    with pytest.raises(ValueError):
        verdict(spark, inside, 60, rules=(quality.PeriodRule(60, "fine"),))


def plain_ticks(bottom, top, target=6, log=False):
    if not top > bottom or not math.isfinite(top - bottom):
        return []
    if log and bottom > 0:
        a, b = math.floor(math.log10(bottom)), math.ceil(math.log10(top))
        n = b - a
        kept, stride = ((1, 2, 5), 1) if n <= 2 else ((1, 5), 1) if n <= 4 else ((1,), max(1, math.ceil(n / target)))
        found = [m * 10.0**k for k in range(a, b + 1, stride) for m in kept if bottom * (1 - 1e-9) <= m * 10.0**k <= top * (1 + 1e-9)] if n > 0 else []
        if len(found) >= 3:
            return found
    raw = (top - bottom) / target
    size = 10 ** math.floor(math.log10(raw))
    step = next(x for x in (5, 2.5, 2, 1) if raw / size >= x or x == 1) * size
    out, p = [], math.ceil(bottom / step) * step
    while p <= top + step * 0.001:
        out.append(p)
        p += step
    return out


@pytest.mark.parametrize("log", [False, True])
def test_levels(spark, log):
    ranges = [(90.0, 110.0), (0.0, 1.0), (-5.0, 7.0), (1.0, 1.0), (2.0, 1.0), (0.5, 5000.0), (1.0, 1e12), (99.9, 100.1), (1e-7, 2e-7), (5.0, 5e5), (float("nan"), 1.0), (None, 1.0), (1.0, float("inf")), (10.0, 1000.0)]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(ranges)], "symbol string, bottom double, top double")
    got = prices.price_ticks(df, logarithmic=log).collect()
    for i, (a, b) in enumerate(ranges):
        mine = sorted(r.tick for r in got if r.symbol == str(i))
        assert mine == pytest.approx(plain_ticks(a, b, log=log) if a is not None and b is not None and a == a else [], rel=1e-9, abs=1e-12), (a, b)


def test_texts(spark):
    assert [prices.decimals_from_tick(t) for t in (0.25, 0.5, 0.01, 0.005, 5, 1, 0, -1, 1e-12, float("nan"), 1e-8)] == [2, 1, 2, 3, 0, 0, 0, 0, 0, 0, 8]
    df = spark.createDataFrame([(1.375,), (100.0,), (-2.5,), (float("nan"),), (None,), (float("inf"),)], "p double")
    text = lambda **k: [r[0] for r in df.select(prices.format_price(F.col("p"), **k)).collect()]
    assert text(tick=0.25) == ["1.50", "100.00", "-2.50", "—", "—", "—"]
    assert text(tick=5.0) == ["0", "100", "0", "—", "—", "—"]
    assert text() == ["1.38", "100.00", "-2.50", "—", "—", "—"]
    assert text(precision=1)[0] == "1.4" and text(tick=0.5, precision=3)[0] == "1.500"
    auto = prices.auto_scale(spark.createDataFrame([(1.0, 3.0), (2.0, 2.0), (None, 1.0)], "lo double, hi double"))
    assert sorted((round(r.bottom, 9), round(r.top, 9)) for r in auto.collect()) == [(0.9, 3.1), (1.0, 3.0)]
