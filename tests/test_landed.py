"""Landed bodies and messages as data sources give what the parsers give, and open only what was asked for."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tickloom.sources import landed, payloads
from tickloom.streaming.upsert import BarTable

BAD = ["[{", "{}", "null", '[{"time": 1}]', '[{"time": 7200, "open": 1, "high": 1, "low": 1, "close": null}]', '[{"time": 7200, "open": 1, "high": 1, "low": 1, "close": "2"}]', '[{"time": 7200, "open": NaN, "high": 1, "low": 1, "close": 1}]', "[null]", "", "5"]


def bar(t, p=1.0, **more):
    return {"time": t, "open": p, "high": p + 1, "low": p - 1, "close": p, **more}


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    landed.register(spark)
    home = tmp_path_factory.mktemp("landed")
    for symbol in ("A", "B"):
        for period in (60, 3600):
            for k in range(4):
                start, end = k * 10 * period, (k + 1) * 10 * period
                folder = home / f"symbol={symbol}" / f"period={period}" / f"start={start}" / f"end={end}"
                os.makedirs(folder)
                bars = [bar(t, float(t), volume=2) for t in range(start, end, period)]
                bars[0] |= {"volume": None, "buyVolume": 1.5, "sellVolume": "x", "more": [1]}
                (folder / "body-0.json").write_text(json.dumps(bars))
                (folder / "_SUCCESS").write_text("")
    folder = home / "symbol=C" / "period=3600" / "start=0" / "end=36000"
    os.makedirs(folder)
    for i, body in enumerate([*BAD, "[]", json.dumps([bar(3600), bar(99_999_999)])]):
        (folder / f"{i:02d}.json").write_text(body)
    return str(home)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_the_parser(spark, source):
    bodies = spark.read.text(source, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("body"))
    good, bad = payloads.parse_bars(bodies)
    part = lambda k: F.regexp_extract("source", rf"{k}=([^/]+)/", 1)
    want = good.select(part("symbol"), part("period").cast("long"), *good.columns[1:], part("start").cast("long").alias("s"), part("end").cast("long").alias("e")).where("time >= s and time < e").drop("s", "e")
    got = spark.read.format("landed_bars").load(source)
    assert rows(got) == rows(want) and got.count() == 161
    refused = spark.read.format("landed_bars").option("refused", True).load(source)
    names = lambda df: sorted(r.source.rsplit("/", 1)[1] for r in df.collect())
    # an empty file has no row in the text source
    assert names(refused) == sorted(names(bad) + ["08.json"]) and len(names(refused)) == len(BAD)
    assert {r.cause for r in refused.collect()} == {"DECODING"}


def test_only_windows_asked_for_are_opened(spark, source):
    reader = landed.LandedReader({"path": source, "symbol": "A", "period": "60", "start": "700", "end": "1300"})
    assert [(w.symbol, w.period, w.start) for w in reader.partitions()] == [("A", 60, 600), ("A", 60, 1200)]
    df = spark.read.format("landed_bars").load(source).where("symbol = 'B' and period = 3600 and time >= 40000 and time < 80000")
    assert df.rdd.getNumPartitions() == 2  # of seventeen windows
    assert sorted(r.time for r in df.collect()) == [t for t in range(0, 144_000, 3600) if 40_000 <= t < 80_000]
    assert spark.read.format("landed_bars").load(source).where("symbol in ('A', 'C') and time = 3600").count() == 2  # minute bars end before
    assert spark.read.format("landed_bars").load(source).where("symbol = 'B' and time < 600").count() == 11
    assert spark.read.format("landed_bars").load(f"{source}/nothing").count() == 0


def test_messages_are_taken_or_set_aside_one_by_one(spark, tmp_path):
    landed.register(spark)
    os.makedirs(tmp_path / "in")
    table = BarTable(spark, f"file://{tmp_path}/t")
    aside = []

    def feed(batch, version):
        batch = batch.persist()
        aside.extend(tuple(r) for r in batch.where("cause is not null").select("raw", "cause").collect())
        table.merge(batch.where("cause is null"), version)
        batch.unpersist()

    def run():
        q = spark.readStream.format("landed_messages").load(str(tmp_path / "in")).writeStream.foreachBatch(feed).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    def land(name, *lines):
        (tmp_path / "in" / f".{name}").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
        os.rename(tmp_path / "in" / f".{name}", tmp_path / "in" / name)

    land("0001", bar(60, 1.0, symbol="A"), "not json", bar(60, 2.0, symbol="A"), {"symbol": "A", "time": 120}, "", bar(120, 3.0, symbol="A"))
    land("0002", bar(60, 9.0, symbol="A"), bar(60, 4.0), bar(120, 5.0, symbol="A"), "[1]")
    run()
    assert sorted((r.symbol, r.time, r.close) for r in table.read().collect()) == [("A", 60, 2.0), ("A", 120, 5.0)]
    assert sorted(c for _, c in aside) == ["DECODING", "INVALID", "INVALID", "INVALID"] and ("not json", "DECODING") in aside
    land("0003", bar(180, 6.0, symbol="A"), bar(60, 7.0, symbol="B"))
    run()  # from the offset of the query before
    assert sorted((r.symbol, r.time, r.close) for r in table.read().collect()) == [("A", 60, 2.0), ("A", 120, 5.0), ("A", 180, 6.0), ("B", 60, 7.0)]
    assert len(aside) == 4
