"""Indicators against known values and against plain loops."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickloom.operators import state
from tickloom.operators.indicators import REGISTRY, indicator

BARS = "symbol string, time long, open double, high double, low double, close double, volume double, buy_volume double, sell_volume double"
# These closes, the bars of the tests named ..._known, and what is wanted of them there. They are the widely
# published worked examples of each indicator, on which other implementations are checked as well, so they must stay as they are.
CLOSES = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.1, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46.0, 46.03, 46.41, 46.22, 45.64]


def of_closes(spark, closes, symbol="A"):
    return spark.createDataFrame([(symbol, 1_600_000_000 + 60 * i, c, c, c, c, 1.0, None, None) for i, c in enumerate(closes)], BARS)


def of_hlc(spark, rows):
    return spark.createDataFrame([("A", 60 * i, c, h, low, c, 100.0, 60.0, 40.0) for i, (h, low, c) in enumerate(rows)], BARS)


def values(df, column):
    return [r[column] for r in df.orderBy("symbol", "time").collect()]


def near(got, want, digits=4):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None)
        assert g is None or round(abs(g - w), digits) == 0


def test_ema_known(spark):
    want = [None] * 4 + [44.104, 44.346, 44.597333, 44.871556, 45.19437, 45.48958, 45.623053, 45.758702, 45.709135, 45.899423, 46.026282, 46.017521]
    near(values(indicator(of_closes(spark, CLOSES[:16]), "ema", n=5), "ema_value"), want)


def test_rsi_known(spark):
    got = values(indicator(of_closes(spark, CLOSES), "rsi", n=14), "rsi_value")
    assert got[:14] == [None] * 14
    near(got[14:], [70.4641, 66.2496, 66.4809, 69.3469, 66.2947, 57.915], 3)


def test_atr_known(spark):
    rows = [(48.7, 47.79, 48.16), (48.72, 48.14, 48.61), (48.9, 48.39, 48.75), (48.87, 48.37, 48.63), (48.82, 48.24, 48.74), (49.05, 48.64, 49.03)]
    near(values(indicator(of_hlc(spark, rows), "atr", n=3), "atr_value"), [None, None, 0.666667, 0.611111, 0.600741, 0.53716])


def test_supertrend_known(spark):
    rows = [(10, 8, 9), (12, 9, 11), (11, 7, 8), (13, 10, 12), (12, 11, 11.5), (14, 9, 13), (13, 11, 11), (12, 9, 9.5), (10, 6, 6.5)]
    got = state.supertrend(of_hlc(spark, [tuple(map(float, r)) for r in rows]), 3, 1.0)
    near(values(got, "value"), [None, None, 6, 7.833333333, 8.722222222, 8.722222222, 8.987654321, 8.987654321, 11.338820302])
    near(values(got, "direction"), [None, None, 1, 1, 1, 1, 1, 1, -1])


def test_flat_series(spark):
    flat = of_closes(spark, [5.0] * 40)
    assert values(indicator(flat, "rsi"), "rsi_value")[-1] == 50
    assert values(indicator(flat, "stoch_rsi"), "stoch_rsi_k")[-1] is None
    assert values(indicator(flat, "cci"), "cci_value")[-1] == 0
    assert values(indicator(flat, "williams_r"), "williams_r_value")[-1] == -50


def test_every_indicator_keeps_rows_and_warms_up(spark):
    rows = [(10 + math.sin(i) + 1, 10 + math.sin(i) - 1, 10 + math.sin(i)) for i in range(120)]
    bars = of_hlc(spark, rows)
    for name, spec in REGISTRY.items():
        got = indicator(bars, name)
        assert got.columns == ["symbol", "time", *(f"{name}_{k}" for k in spec.outputs)], name
        last = got.orderBy("time").collect()[-1]
        assert all(last[f"{name}_{k}"] is not None for k in spec.outputs if name != "pivot_points"), name


def test_long_recursion_equals_loop(spark):
    """Over many blocks of the windowed form."""
    xs = [math.sin(i * 0.7) * 5 + i % 11 for i in range(2000)]
    n, e, want = 5, None, []
    for i, x in enumerate(xs):
        e = sum(xs[:n]) / n if i == n - 1 else (e + 2 / (n + 1) * (x - e) if e is not None else None)
        want.append(e)
    near(values(indicator(of_closes(spark, xs), "ema", n=n), "ema_value"), want, 9)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 200), min_size=30, max_size=60))
def test_wma_property(spark, closes):
    got = values(indicator(of_closes(spark, closes), "wma", n=7), "wma_value")
    want = [None] * 6 + [sum((k + 1) * x for k, x in enumerate(closes[i - 6 : i + 1])) / 28 for i in range(6, len(closes))]
    near(got, want, 8)


def test_bad_bars_are_dropped(spark):
    bars = of_closes(spark, [1.0, float("nan"), 2.0, float("inf"), 3.0])
    assert indicator(bars, "sma", n=2).count() == 3


def test_unknown_parameter(spark):
    with pytest.raises(ValueError):
        indicator(of_closes(spark, [1.0]), "sma", wrong=3)


def test_empty(spark):
    empty = spark.createDataFrame([], BARS)
    assert indicator(empty, "macd").count() == 0
    assert state.renko(empty).count() == 0


def test_psar_turns(spark):
    rows = [(10.0 + i, 9.0 + i, 9.5 + i) for i in range(10)] + [(18.0 - 2 * i, 16.0 - 2 * i, 16.5 - 2 * i) for i in range(6)]
    got = values(state.psar(of_hlc(spark, rows)), "value")
    assert got[0] is None and got[1] == 9.0
    assert got[5] < rows[5][1] and got[-1] > rows[-1][0]


def test_renko_reverses_after_two(spark):
    bars = of_closes(spark, [10.0, 11.0, 12.5, 11.4, 10.0, 9.0]).selectExpr("*", "1D AS brick")
    got = state.scan(bars, state.Renko, "symbol string, time long, open double, high double, low double, close double").orderBy("time").collect()
    assert [(r.open, r.close) for r in got] == [(10, 11), (11, 12), (11, 10), (10, 9)]
