"""Streams give what batches give."""

from pyspark.sql import functions as F

from tickloom.operators import resample
from tickloom.operators.state import scan
from tickloom.sources import tables as S
from tickloom.streaming import jobs


def _run(df, name, spark, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_ticks_to_bars(spark, data, tmp_path):
    t = S.trades(spark, data).withColumn("ts", F.timestamp_seconds("time"))
    # a tick far later lets the watermark pass all others
    end = t.limit(1).withColumn("time", F.lit(4_000_000_000)).withColumn("ts", F.timestamp_seconds("time")).withColumn("symbol", F.lit("END"))
    t.unionByName(end).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    got = _run(jobs.ticks_to_bars(stream, 3600), "bars_stream", spark).where("symbol <> 'END'")
    want = resample.trades_to_bars(S.trades(spark, data), 3600).select(got.columns)
    assert got.count() == want.count() > 0
    assert got.select("symbol", "time", "high", "low", "volume").exceptAll(want.select("symbol", "time", "high", "low", "volume")).count() == 0


def test_states_over_files(spark, data, tmp_path):
    bars = S.bars(spark, data, 86_400).select("symbol", "time", "close").cache()
    cuts = [r.time for r in bars.select("time").distinct().orderBy("time").collect()]
    path = str(tmp_path / "in")
    for k, part in enumerate((cuts[:10], cuts[10:20], cuts[20:])):
        bars.where(F.col("time").isin(part)).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    schema = "symbol string, time long, value double"
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    got = _run(jobs.run_steps(stream, lambda: jobs.Ema(5), schema), "ema_stream", spark)
    want = scan(bars, lambda: jobs.Ema(5), schema)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    fired = _run(jobs.run_steps(stream, lambda: jobs.CrossAlert(245.0), schema), "alert_stream", spark)
    assert fired.exceptAll(scan(bars, lambda: jobs.CrossAlert(245.0), schema)).count() == 0


def test_preview_leaves_state():
    e = jobs.Ema(2)
    for t, x in enumerate([1.0, 3.0, 5.0]):
        e({"symbol": "A", "time": t, "close": x})
    before = e.e
    assert e.preview(9.0) != before and e.e == before
