"""JSON bodies in three dialects."""

import json

from tickloom.sources import payloads as P


def bodies(spark, **by):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in by.items()], "source string, body string")


def test_bars_refuse_whole_bodies(spark):
    ok = {"time": 60, "open": 1, "high": 2, "low": 0.5, "close": 1.5}
    good, bad = P.parse_bars(bodies(spark, a=[ok, ok | {"time": 120, "volume": 3}], b=[ok, {"time": 1}], c="nonsense", d=[]))
    assert [(r.time, r.volume) for r in good.orderBy("time").collect()] == [(60, None), (120, 3.0)]
    assert sorted((r.source, r.cause) for r in bad.collect()) == [("b", "DECODING"), ("c", "DECODING")]


def test_desk(spark):
    cols = ["close", "bar_epoch", "open", "high", "low", "volume", "buy_vol", "sell_vol"]
    rows = [[5, 100, 1, 9, 1, 10, 6, 4], [6, 100, 1, 9, 1, 10, 6, 4], [7, 160, 1, 9, 1, 10, 1, 1], [8, 130, 1, 9, 1, 10, 1, 1]]
    good, bad = P.parse_desk(bodies(spark, a={"cols": cols, "rows": rows}, b={"cols": ["open"], "rows": []}), 60)
    assert [(r.time, r.close, r.buy_volume) for r in good.orderBy("time").collect()] == [(100, 5.0, 6.0), (160, 7.0, None)]
    assert [r.source for r in bad.collect()] == ["b"]


def test_daily_pairs(spark):
    cols = ["bar_epoch", "open", "high", "low", "close", "buy_vol", "sell_vol"]
    body = bodies(spark, a={"cols": cols, "rows": [[0, 1, 1, 1, 1, 2, 3], [3600, 1, 1, 1, 2, None, None], [86_400, 1, 1, 1, 3, 1, 1]]})
    assert [r.close for r in P.parse_desk(body, 86_400)[0].orderBy("time").collect()] == [2.0, 3.0]
    assert [r.close for r in P.parse_desk(body, 86_400, True)[0].orderBy("time").collect()] == [1.0, 3.0]


def test_terminal(spark):
    c = {"open": 1, "high": 1, "low": 1, "close": 1}
    good, _ = P.parse_terminal(bodies(spark, a=[c | {"timestamp": t} for t in (0, 60, 60, 120)]), 10_800, 10_920)
    assert [r.time for r in good.orderBy("time").collect()] == [10_800, 10_860]


def test_bad_rows_are_skipped_alone(spark):
    c = {"open": 1, "high": 1, "low": 1, "close": 1}
    good, bad = P.parse_terminal(bodies(spark, a=[c | {"timestamp": 0}, {"timestamp": 60, "open": 1}, c | {"timestamp": 120}, c], b=[c | {"timestamp": 0}, None]), 0, 20_000)
    assert [(r.source, r.time) for r in good.orderBy("time").collect()] == [("a", 10_800), ("a", 10_920)]
    assert [r.source for r in bad.collect()] == ["b"]
    cols = ["bar_epoch", "open", "high", "low", "close"]
    good, _ = P.parse_desk(bodies(spark, a={"cols": cols, "rows": [[0, 1, 1, 1, 1], [60, 1, None, 1, 1], [50, 1, 1, 1, 2]]}), 60)
    assert [(r.time, r.close) for r in good.orderBy("time").collect()] == [(0, 1.0), (50, 2.0)]


def test_daily_records_are_held_against_the_last_kept(spark):
    cols = ["bar_epoch", "open", "high", "low", "close", "buy_vol", "sell_vol"]
    hour = 3600
    body = bodies(spark, a={"cols": cols, "rows": [[0, 1, 1, 1, 1, 2, 3], [8 * hour, 1, 1, 1, 2, None, None], [16 * hour, 1, 1, 1, 3, None, None]]})
    assert [r.close for r in P.parse_desk(body, 86_400, True)[0].orderBy("time").collect()] == [1.0, 3.0]
    assert [r.close for r in P.parse_desk(body, 86_400)[0].orderBy("time").collect()] == [3.0]


def test_contract(spark):
    s = spark.createDataFrame([(1, "WIN$", "Mini sem ajuste"), (2, "WIN$N", "Índice por LIQUÍDEZ (WINQ26)"), (3, "WIN@", "Índice por liquidez (WINV26)"), (4, "DOL", "Dollar")], "seq int, name string, description string")
    assert P.active_contract(s, "WIN").first().contract == "WINQ26"
    assert P.active_contract(s, "DOL").first().contract == "DOL"
    assert P.active_contract(s, "XXX").first().contract is None


def test_windows():
    w = P.backfill_window(1000, 10, 5)
    assert w == (950, 1000) and P.previous_window(w) == (900, 950)
    assert P.reached_start(None, w, 10) and P.reached_start(960, w, 10) and not P.reached_start(950, w, 10)
    assert P.shared_periods() == [60, 300, 900, 1800, 3600, 86_400]
