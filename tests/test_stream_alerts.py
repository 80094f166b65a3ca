"""Alerts over polled series, through restarts: what is new fires once, and a changed past fires as a full run does."""

import random

from tickloom.operators.alerts import Alert, with_references
from tickloom.streaming.alerts import stream_alerts
from tickloom.streaming.indicators import typed_state
from tickloom.streaming.kernels import AlertMachine

ALERTS = [
    Alert("up", "CROSS_ABOVE", level=100.0), Alert("once", "CROSS_BELOW", level=100.0, once=True), Alert("touch", "TOUCH", level=104.0, once=False), Alert("in", "ENTER_ZONE", low=96.0, high=98.0, once=False),
    Alert("change", "PERCENT_CHANGE", percent=3.0, once=False), Alert("series", "SERIES_CROSS", once=False), Alert("many", "CROSS_ABOVE", level=99.0, once=False),
]
SCHEMA = "symbol string, poll long, time long, value double, high double, low double, reference double"


def run(symbol, series):
    machines = [AlertMachine(a) for a in ALERTS]
    out = []
    for t, v, h, low, ref in series:
        for m in machines:
            out += [(symbol, e["alert"], e["time"], e["value"]) for e in m({"symbol": symbol, "time": t, "value": v, "high": h, "low": low, "reference": ref})]
    return sorted(out)


def series(n, seed):
    rng, v, out = random.Random(seed), 100.0, []
    for i in range(n):
        v += rng.uniform(-2, 2)
        out.append((60 * i, v, v + 1, v - 1, 100.0 if i % 3 else None))
    return out


def test_polls(spark, tmp_path):
    a, b = series(90, 1), series(60, 2)
    moved = [(0, 50.0, 51.0, 49.0, 100.0), *a[1:]]
    forming = [*a[:39], (a[39][0], 99.5, 99.6, 99.4, None)]  # closes as a[39] later
    polls = [{"A": forming, "B": b}, {"A": a[:70]}, {"A": a, "B": b}, {"A": moved}, {"A": moved, "B": b[:20]}, {"A": [*moved, (60 * 90, 120.0, 121.0, 119.0, 100.0)]}]

    def feed():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        with typed_state(spark):
            q = stream_alerts(stream, ALERTS).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None

    for k, poll in enumerate(polls):
        rows = [(s, k, *bar) for s, bars in poll.items() for bar in bars]
        random.Random(k).shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (1, 5):
            feed()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    of = lambda s, e: sorted((r.symbol, r.alert, r.time, r.value) for r in got if r.symbol == s and r.epoch == e)
    assert of("A", 0) == run("A", [*forming, *a[40:]]) and len(of("A", 0)) > 10
    assert of("A", 1) == run("A", polls[5]["A"])  # the first bar differs: fired anew, then went on
    assert of("B", 0) == run("B", b) and of("B", 1) == run("B", b[:20])
    assert {(r.symbol, r.epoch) for r in got} == {("A", 0), ("A", 1), ("B", 0), ("B", 1)}
    assert {r.poll for r in got if r.epoch == 1 and r.symbol == "A"} == {3, 5}  # the fourth brought nothing new


def test_references_by_time(spark):
    s = spark.createDataFrame([("A", 1, 2.0), ("A", 2, 3.0), ("B", 1, 4.0)], "symbol string, time long, value double")
    r = spark.createDataFrame([("A", 2, 9.0), ("A", 2, 9.0), ("B", 7, 8.0)], "symbol string, time long, reference double")
    assert sorted(map(tuple, with_references(s, r).select("symbol", "time", "reference").collect())) == [("A", 1, None), ("A", 2, 9.0), ("B", 1, None)]
