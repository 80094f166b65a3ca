"""Steps of streams give what the windows of batch jobs give."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import alerts as A
from tickloom.operators.indicators import indicator
from tickloom.operators.state import scan
from tickloom.plans.catalog import KINDS, _samples
from tickloom.sources import tables as S
from tickloom.streaming import kernels as K

VALUE = "symbol string, time long, value double"
PAIRS = {
    "sma": lambda: K.Close(K.Mean(20)), "ema": lambda: K.Close(K.ema(20)), "rma": lambda: K.Close(K.wilder(14)), "stddev": lambda: K.Close(K.Deviation(20)),
    "atr": lambda: K.Atr(14), "rsi": lambda: K.Rsi(14),
}


@pytest.fixture(scope="module")
def bars(spark, data):
    return S.bars(spark, data).cache()


@pytest.mark.parametrize("name", [*PAIRS, "macd"])
def test_same_as_batch(bars, name):
    got = {(r.symbol, r.time): r.value for r in scan(bars.select("symbol", "time", "high", "low", "close"), PAIRS.get(name, K.Macd), VALUE).collect()}
    column = "macd_macd" if name == "macd" else f"{name}_value"
    want = {(r.symbol, r.time): r[column] for r in indicator(bars, name).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (w is None) == (g is None or g != g) and (w is None or abs(g - w) < 1e-8)


@pytest.mark.parametrize("kind", list(KINDS))
def test_alerts_same_as_batch(spark, data, kind):
    s = _samples(spark, data)
    alert = KINDS[kind][0]
    got = scan(s, lambda: K.AlertMachine(alert), "symbol string, alert string, kind string, time long, value double")
    want = A.evaluate(s, [alert])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_preview_and_rearm():
    step = K.Close(K.Mean(2))
    bar = lambda c: {"symbol": "A", "time": 0, "high": c, "low": c, "close": c}
    step(bar(1.0))
    assert step.preview(bar(3.0)) == 2.0 and step.preview(bar(5.0)) == 3.0
    m = K.AlertMachine(A.Alert("x", "CROSS_ABOVE", level=2.0, once=True))
    fired = [bool(m({"symbol": "A", "time": t, "value": v})) for t, v in enumerate([1.0, 3.0, 1.0, 3.0])]
    assert fired == [False, True, False, False]
    m.rearm()
    assert [bool(m({"symbol": "A", "time": t, "value": v})) for t, v in enumerate([1.0, 3.0])] == [False, True]
