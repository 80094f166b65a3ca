"""All indicators over a stream, restarted between its files, equal their batch queries bar by bar; forming bars leave no trace."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators, state
from tickloom.plans import base_sql, catalog
from tickloom.sources import tables as S
from tickloom.streaming.indicators import stream_indicators, typed_state
from tickloom.streaming.steps import STEPS, Steps


@pytest.fixture(scope="module")
def streamed(spark, data, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("stream"))
    bars = S.bars(spark, data).withColumn("closed", F.lit(True)).withColumn("seq", F.lit(1)).cache()
    # before each third bar closes it is seen forming, twice; an older bar comes again, and one without a price
    forming = bars.where(F.col("time") / 3600 % 3 == 0).withColumn("closed", F.lit(False)).withColumn("seq", F.lit(0))
    noise = bars.where(F.col("time") / 3600 % 5 == 0)
    old, broken = noise.withColumn("seq", F.lit(2)).withColumn("close", F.col("close") * 2), noise.withColumn("seq", F.lit(0)).withColumn("close", F.lit(float("nan")))
    cuts = bars.agg(F.percentile_approx("time", [0.3, 0.6])).collect()[0][0]
    parts = [(None, cuts[0]), cuts, (cuts[1], None)]

    def run():
        stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
        with typed_state(spark):
            q = stream_indicators(stream, {n: {} for n in STEPS}).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/c").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    for k, (a, b) in enumerate(parts):
        part = bars.unionByName(forming).unionByName(forming).unionByName(old).unionByName(broken)
        part = part if a is None else part.where(F.col("time") > a)
        part = part if b is None else part.where(F.col("time") <= b)
        part.coalesce(1).write.mode("append").parquet(f"{home}/in")
        if k:  # twice: the second from where the first stopped
            run()
    rows = spark.read.parquet(f"{home}/out").collect()
    return {(r.symbol, r.time): r for r in rows if not r.is_partial}, [r for r in rows if r.is_partial], bars.count(), forming.count()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    return c


def close(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-6 * max(1.0, abs(a)))


def test_every_indicator_has_a_step():
    assert set(STEPS) == set(indicators.REGISTRY) and len(STEPS) == 45


@pytest.mark.parametrize("name", sorted(STEPS))
def test_stream_equals_batch(spark, data, duck, streamed, name):
    bars, _, n, _ = streamed
    assert len(bars) == n
    query = catalog.NAMES.get(name, name)
    query = "kama_10" if name == "kama" else query
    if query in catalog.ORACLE:  # which tests hold against the batch query
        got = duck.execute(catalog.ORACLE[query])
        names = [d[0] for d in got.description]
        want = [dict(zip(names, r)) for r in got.fetchall()]
    else:
        want = [r.asDict() for r in getattr(state, name)(S.bars(spark, data)).collect()]
    assert len(want) == n
    for r in want:
        for k in indicators.REGISTRY[name].outputs:
            assert close(r.get(f"{name}_{k}", r.get(k)), bars[r["symbol"], r["time"]][f"{name}_{k}"]), (r, k)


def test_forming_bars_are_previews(streamed):
    bars, partial, _, n = streamed
    assert len(partial) == 2 * n > 20
    for r in partial:
        assert {k: v for k, v in r.asDict().items() if k != "is_partial"} == {k: v for k, v in bars[r.symbol, r.time].asDict().items() if k != "is_partial"}


def test_state_is_numbers_and_queues(duck):
    got = duck.execute(f"SELECT * FROM ({base_sql.bars()}) WHERE symbol = 'S1' ORDER BY time")
    names = [d[0] for d in got.description]
    rows = [dict(zip(names, r)) for r in got.fetchall()]
    whole, wanted = Steps({n: {} for n in STEPS}), {n: {} for n in STEPS}
    for b in rows:
        whole.update(b)
    numbers, queues = whole.dump()
    assert all(isinstance(x, float) for x in numbers) and all(isinstance(x, float) for q in queues for x in q)
    assert max(map(len, queues)) <= 52 and len(numbers) < 400  # the longest window
    again = Steps(wanted)
    again.load(numbers, queues)
    assert again.preview(rows[-1]) == whole.preview(rows[-1]) == whole.update(rows[-1])


def test_parameters_are_held_to_their_ranges():
    s = lambda name, **given: indicators.settings(name, given)
    assert s("sma", n=float("nan"))["n"] == 20 and s("sma", n=0)["n"] == 1 and s("sma", n=9e9)["n"] == 5000 and s("sma", n=2.5)["n"] == 3
    assert s("bollinger", mult=float("nan"))["mult"] == 2.0 and s("bollinger", mult=99)["mult"] == 10 and s("bollinger", mult=-1)["mult"] == 0.1
    assert s("supertrend", mult=99)["mult"] == 20 and s("psar", step=0, most=7) == {"step": 0.001, "most": 1}
    assert s("ema", n=None)["n"] == 20 and s("ema", n="7")["n"] == 20
    with pytest.raises(ValueError):
        s("sma", period=3)
