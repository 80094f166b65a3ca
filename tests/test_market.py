"""Bars, order flow, alignment, analytics and alerts on small tables."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tickloom.functions import columns as C
from tickloom.operators import alerts as A
from tickloom.operators import align, analytics, orderflow, resample
from tickloom.sources import tables as S

TRADES = "symbol string, seq long, time long, price double, size double, side string"


def test_bars_ties_and_absent_volume(spark):
    t = spark.createDataFrame(
        [("A", 1, 100, 5.0, None, None), ("A", 2, 100, 6.0, None, "buy"), ("A", 3, 110, 7.0, None, None), ("A", 4, 110, 4.0, None, None), ("A", 5, 130, 9.0, 2.0, "sell"), ("A", 6, 140, float("nan"), 1.0, "buy")], TRADES
    )
    a, b = resample.trades_to_bars(t, 60).orderBy("time").collect()
    assert (a.time, a.open, a.high, a.low, a.close, a.volume) == (60, 5.0, 7.0, 4.0, 7.0, None)
    assert (b.open, b.volume, b.buy_volume, b.sell_volume) == (9.0, 2.0, None, 2.0)
    assert resample.trades_to_bars(t, 0).count() == 0


def test_rollup_is_associative_and_keeps_volume(spark, data):
    m1 = S.bars(spark, data, 60)
    cols = ["symbol", "time", "open", "high", "low", "close", "volume"]
    direct = resample.rollup(m1, 60, 900).select(cols)
    stepped = resample.rollup(resample.rollup(m1, 60, 300), 300, 900).select(cols)
    assert direct.exceptAll(stepped).count() == 0 == stepped.exceptAll(direct).count()
    assert m1.agg(F.sum("volume")).first() == direct.agg(F.sum("volume")).first()
    assert resample.rollup(m1, 60, 100).count() == 0


def test_timeframes():
    assert resample.next_timeframe("H1") == "H4" and resample.previous_timeframe("M1") is None
    assert resample.rollable(3600)[0] == "H1"


def test_asof(spark):
    probes = spark.createDataFrame([("A", t) for t in (5, 10, 14, 15, 30)], "symbol string, time long")
    marks = spark.createDataFrame([("A", 10, 1.0), ("A", 20, 2.0)], "symbol string, time long, v double")
    back = {r.time: r.asof_v for r in align.asof_backward(probes, marks, "v").collect()}
    assert back == {5: None, 10: 1.0, 14: 1.0, 15: 1.0, 30: 2.0}
    near = {r.time: r.near_v for r in align.asof_nearest(probes, marks, "v").collect()}
    assert near == {5: 1.0, 10: 1.0, 14: 1.0, 15: 1.0, 30: 2.0}


def test_nearest_over_blocks_is_a_plain_loop(spark):
    rng = random.Random(4)
    # blocks of 10: many without marks, times below zero and at edges, a mark without value, a key without marks, probes and marks without time
    marks = [(k, t, None if t % 7 == 0 else float(t)) for k in "AB" for t in rng.sample(range(-300, 300), 12)] + [("A", None, 5.0), ("B", 400, 4.0)]
    probes = [(k, i, None if i % 25 == 0 else rng.choice([rng.randrange(-400, 500), 10 * rng.randrange(-40, 50)])) for k in "ABC" for i in range(200)]
    got = align.asof_nearest(spark.createDataFrame(probes, "symbol string, seq long, time long"), spark.createDataFrame(marks, "symbol string, time long, v double"), "v", block=10)

    def near(key, time):
        of = [(abs(t - time), t, v) for k, t, v in marks if k == key and t is not None] if time is not None else []
        _, t, v = min(of, default=(None, None, None))
        return v, t

    assert got.columns == ["symbol", "seq", "time", "near_v", "near_time"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == [(k, i, t, *near(k, t)) for k, i, t in sorted(probes, key=lambda r: r[:2])]


def test_nearest_takes_time_in_proportion(spark):
    n = 60_000
    probes = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("time"))
    marks = probes.where("time % 100 = 0").withColumn("v", F.col("time").cast("double"))
    began = time.perf_counter()
    # all in one block; when each row went through all later ones this took minutes
    got = align.asof_nearest(probes, marks, "v", block=n).where("abs(time - near_time) <= 50 or time > near_time and near_time = 59900").count()
    assert got == n and time.perf_counter() - began < 60


def test_value_area_grows_to_the_larger_neighbour(spark):
    p = spark.createDataFrame([(float(i), float(t)) for i, t in enumerate([1, 5, 3, 10, 3, 4, 9, 1])], "price double, total double")
    r = orderflow.value_area(p, 0.5).first()
    # 10, then up (3 = 3), then up 4, then up 9
    assert (r.poc, r.val, r.vah, r.volume) == (3.0, 3.0, 6.0, 26.0)


def test_columnar_roundtrip_and_refusal(spark):
    cells = spark.createDataFrame([(1, 10, 1.0, 1.0, 0.0, 0.0, 0.0), (1, 20, 2.0, 0.0, 0.0, 0.0, 0.0), (1, 30, 3.0, 0.0, 2.0, 1.0, 0.0)], "grid int, ts_ms long, price double, bid double, ask double, buy double, sell double")
    enc = orderflow.encode_columnar(cells)
    back = orderflow.decode_columnar(enc)
    assert sorted(r.ts_ms for r in back.collect()) == [10, 30]
    bad = enc.withColumn("axes", F.col("axes").withField("t", F.reverse("axes.t")))
    assert orderflow.decode_columnar(bad).count() == 0


def test_splice_prefers(spark):
    h = spark.createDataFrame([(60 * i, 1.0, 1.0, 1.0, float(i), 1.0) for i in range(5)], "time long, open double, high double, low double, close double, volume double")
    v = spark.createDataFrame([(60 * i, 1.0, 1.0, 1.0, 100.0 + i, 1.0) for i in range(3, 8)] + [(301, 1.0, 1.0, 1.0, 9.0, 1.0)], h.schema)
    got = {r.time: (r.close, r.origin) for r in align.splice(h, v, 60, diverging="merge").collect()}
    assert got[180] == (3.0, "archive") and got[240] == (104.0, "live") and got[420] == (107.0, "live") and 301 not in got
    assert {r.close for r in align.splice(h, v, 60, "archive", diverging="merge").where("time = 240").collect()} == {4.0}
    with pytest.raises(ValueError):
        align.splice(h, v, 60, "none")


def test_splice_of_incoherent_sources(spark):
    kind = "time long, open double, high double, low double, close double, volume double"
    h = spark.createDataFrame([(60 * i, 1.0, 1.0, 1.0, 100.0, 1.0) for i in range(5)], kind)

    def live(factor, at=range(3, 8)):
        return spark.createDataFrame([(60 * i, 1.0, 1.0, 1.0, 100.0 * factor, 1.0) for i in at], kind)

    def got(v, side, **k):
        return sorted((r.time, r.close, r.origin) for r in align.splice(h, v, 60, diverging=side, **k).collect())

    assert got(live(1.01), "archive") == [(60 * i, 100.0, "archive") for i in range(5)]
    assert got(live(1.01), "live") == [(60 * i, 101.0, "live") for i in range(3, 8)]
    assert got(live(1.0005), "archive") == got(live(1.0005), "merge") != got(live(1.01), "archive")
    assert [r[2] for r in got(live(1.01), "merge")] == ["archive"] * 4 + ["live"] * 4
    with pytest.raises(ValueError):
        align.splice(h, live(1.0), 60, diverging="none")
    row = align.splice_report(h, live(1.0), 60).first()
    assert tuple(row) == (240, 5, 3, 1, 1, 0, None, None, 420, True)
    assert tuple(align.splice_report(h, live(1.01), 60, diverging="archive").first()) == (None, 5, 0, 0, 0, 0, None, None, None, False)
    assert tuple(align.splice_report(h, live(1.0, [7, 8]), 60).first()) == (420, 5, 2, 0, 0, 0, 300, 420, 480, None)
    # without an archive the live series is all there is
    assert align.splice(h.limit(0), live(1.0), 60).count() == 5


def test_daily_splice_keeps_the_time_of_the_archive(spark):
    kind = "time long, open double, high double, low double, close double, volume double"
    h = spark.createDataFrame([(86_400 * i, 1.0, 1.0, 1.0, 5.0, 1.0) for i in range(3)], kind)
    v = spark.createDataFrame([(86_400 * i + 10_800, 2.0, 2.0, 2.0, 5.0, 1.0) for i in range(2, 4)], kind)
    assert sorted((r.time, r.open, r.origin) for r in align.splice(h, v, 86_400).collect()) == [(0, 1.0, "archive"), (86_400, 1.0, "archive"), (172_800, 2.0, "live"), (270_000, 2.0, "live")]
    assert align.splice_report(h, v, 86_400).first().forming == 270_000


@pytest.mark.parametrize("name", ["splice_series", "splice_coherence", "splice_incoherent", "splice_report"])
def test_splices_equal_their_sql(spark, data, name):
    import duckdb

    from tickloom.plans import catalog

    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    want = c.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(map(str, (tuple(r[k] for k in names) for r in catalog.queries()[name](spark, data).collect()))) == sorted(map(str, want.fetchall()))


def test_correlation_needs_twenty(spark):
    def series(n, f):
        return spark.createDataFrame([("A", i, float(f(i))) for i in range(n)], "symbol string, time long, close double")

    f = lambda i: 10 + i % 7
    assert analytics.returns_correlation(series(15, f), series(15, f)).first().r is None
    assert abs(analytics.returns_correlation(series(40, f), series(40, lambda i: 2 * f(i))).first().r - 1) < 1e-9
    assert analytics.returns_correlation(series(40, f), series(40, lambda i: 3)).first().r is None


def test_sessions(spark):
    # 1970-01-01 was a Thursday; the session is 9 to 18 at three hours behind UTC
    t = spark.createDataFrame([("A", 12 * 3600), ("A", 11 * 3600), ("A", 21 * 3600), ("A", 2 * 86_400 + 13 * 3600)], "symbol string, time long")
    kept, gone = analytics.split_by_session(t, 3600, analytics.WEEKDAYS)
    assert [r.time for r in kept.collect()] == [12 * 3600] and gone.count() == 3
    assert analytics.split_by_session(t, 3600, analytics.Sessions())[1].count() == 0


def test_alerts(spark):
    rows = [("A", i, float(v), float(v) + 0.5, float(v) - 0.5, 10.0) for i, v in enumerate([8, 9, 11, 11, 9, 12, 12])]
    s = spark.createDataFrame(rows, "symbol string, time long, value double, high double, low double, reference double")
    def times(*alerts):
        return sorted(r.time for r in A.evaluate(s, list(alerts)).collect())

    assert times(A.Alert("x", "CROSS_ABOVE", level=10.0, once=False)) == [2, 5]
    assert times(A.Alert("x", "CROSS_ABOVE", level=10.0)) == [2]  # once is the default
    assert times(A.Alert("x", "TOUCH", level=11.2, once=False)) == [2]
    assert times(A.Alert("x", "SERIES_CROSS", once=False)) == [2, 4, 5]
    assert times(A.Alert("x", "PERCENT_CHANGE", percent=30.0, once=False)) == [2, 5]
    with pytest.raises(ValueError):
        times(A.Alert("x", "NONE"))


def test_formats(spark):
    one = spark.range(1)
    r = one.select(C.round_to_tick(F.lit(10.13), 0.25).alias("a"), C.group_price(F.lit(0.3), 0.1).alias("b"), C.short_number(F.lit(1234.0)).alias("c"), C.grouped_integer(F.lit(1234567)).alias("d"), C.clock(F.lit(0).cast("long"), "UTC", "Z").alias("e")).first()
    assert (r.a, round(r.b, 9), r.c, r.d, r.e) == (10.25, 0.3, "1.2k", "1.234.567", "01/01/1970 00:00:00 Z")


def test_days_with_a_session_are_kept_whole(spark):
    # 2024-01-05 was a Friday; times of day in the sessions' zone
    at = lambda day, hour: 1_704_412_800 + day * 86_400 + hour * 3600 + 10_800
    rows = [("a", at(0, 3)), ("a", at(0, 12)), ("a", at(0, 22)), ("a", at(1, 12)), ("a", at(2, 22)), ("a", at(3, 1))]
    kept, gone = analytics.split_by_session(spark.createDataFrame(rows, "symbol string, time long"), 3600, analytics.WEEKDAYS, whole_days=True)
    assert sorted(r.time for r in kept.collect()) == [at(0, 3), at(0, 12), at(0, 22), at(3, 1)] and gone.count() == 2


def test_grids_with_values_that_are_no_numbers_give_none(spark):
    cells = spark.createDataFrame([("g", 1, 10.0, 1.0, 2.0, 0.0, 0.0), ("h", 1, 10.0, float("nan"), 2.0, 0.0, 0.0)], "grid string, ts_ms long, price double, bid double, ask double, buy double, sell double")
    assert {r.grid for r in orderflow.decode_columnar(orderflow.encode_columnar(cells)).collect()} == {"g"}


def test_sides_that_are_no_numbers_do_not_count(spark):
    from tickloom.operators.indicators import indicator

    rows = [("a", 60 * i, 1.0, 1.0, 1.0, 1.0, 3.0, float("nan") if i == 1 else 2.0, 1.0) for i in range(4)]
    bars = spark.createDataFrame(rows, "symbol string, time long, open double, high double, low double, close double, volume double, buy_volume double, sell_volume double")
    assert [r[2] for r in indicator(bars, "cvd").orderBy("time").collect()][-1] == 3.0


def test_indicators_by_steps_are_known_by_name(spark, data):
    from tickloom.operators import state
    from tickloom.operators.indicators import indicator
    from tickloom.sources.tables import bars

    b = bars(spark, data)
    for name in ("supertrend", "psar", "kama"):
        got = {(r.symbol, r.time): r[2] for r in indicator(b, name).collect()}
        assert got == {(r.symbol, r.time): r.value for r in getattr(state, name)(b).collect()} and got
    with pytest.raises(ValueError, match="unknown indicator"):
        indicator(b, "nothing")


def test_places_among_bars(spark):
    bars = spark.createDataFrame([("A", 10), ("A", 20), ("A", 40), ("B", 7)], "symbol string, time long")
    probes = spark.createDataFrame([("A", t) for t in (0, 10, 15, 30, 40, 60)] + [("B", 1), ("B", 9), ("C", 5)], "symbol string, time long")
    got = {(x.symbol, x.time): x.place for x in align.time_to_index(probes, bars).collect()}
    assert got == {("A", 0): -1, ("A", 10): 0, ("A", 15): 0.5, ("A", 30): 1.5, ("A", 40): 2, ("A", 60): 3, ("B", 1): 0, ("B", 9): 0, ("C", 5): None}
    exact = {(x.symbol, x.time): x.place for x in align.time_to_index(probes, bars, between=False).collect()}
    assert {k for k, v in exact.items() if v is not None} == {("A", 10), ("A", 40)}
    places = spark.createDataFrame([("A", float(x)) for x in (-1, 0, 0.5, 1.5, 2, 3, "nan")] + [("B", 4.0), ("C", 0.0)], "symbol string, place double")
    back = [(x.symbol, x.place_time) for x in align.index_to_time(places, bars).collect()]
    assert sorted(back, key=str) == sorted([("A", 0.0), ("A", 10.0), ("A", 15.0), ("A", 30.0), ("A", 40.0), ("A", 60.0), ("A", None), ("B", 7.0), ("C", None)], key=str)


def test_days_steps_and_totals(spark):
    d = spark.createDataFrame([("2026-02-28",), ("2026-02-31",), ("2026-2-3",), ("x",), (None,)], "day string")
    got = d.select(C.valid_day(F.col("day")), C.shift_day(F.col("day"), 1), C.day_label(F.col("day")), C.day_label(F.col("day"), "iso")).collect()
    assert tuple(got[0]) == (True, "2026-03-01", "28/02/2026", "2026-02-28")
    assert all(tuple(x) == (False, None, None, None) for x in got[1:])
    assert [x[0] for x in spark.createDataFrame([(12345,), (-5,), (0,)], "n long").select(C.signed_integer(F.col("n"))).collect()] == ["+12.345", "-5", "0"]
    assert orderflow.zoom_step(10, 110, 0.5) == 0 and orderflow.zoom_step(11, 110, 0.5) == 1.0 and orderflow.zoom_step(1e9, 110, 0.5) == 500 and orderflow.zoom_step(0, 110, 1) == 0
    levels = spark.createDataFrame([(1, 5.0, 3.0), (1, 5.0, 3.0), (2, 1.0, 4.0)], "candle long, candle_buy double, candle_sell double")
    assert tuple(orderflow.footprint_totals(levels).first()) == (2, 3, 6.0, 7.0, -1.0, "seller")
    assert tuple(orderflow.footprint_totals(levels.limit(0)).first()) == (0, 0, 0.0, 0.0, 0.0, "even")
