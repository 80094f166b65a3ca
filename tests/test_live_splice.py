"""Polls that arrive in files give, after each, the rows and the report of the batch splice."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import align
from tickloom.sources import tables as S
from tickloom.streaming.live_splice import BAR, LiveSplice
from tickloom.streaming.upsert import last_updates


def rows(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("factor, precedence, diverging", [(1.0002, "cut", "archive"), (1.05, "cut", "live"), (1.05, "live", "merge")])
def test_each_prefix_equals_the_batch_splice(spark, data, tmp_path, factor, precedence, diverging):
    bars = S.bars(spark, data, by_symbol=False).select(*BAR).where("volume is not null").orderBy("time").limit(120)
    bars.coalesce(1).write.parquet(f"{tmp_path}/bars")
    bars = spark.read.parquet(f"{tmp_path}/bars")
    times = [r.time for r in bars.select("time").collect()]
    cut = times[len(times) // 2]
    archive = bars.where(F.col("time") <= cut)
    # polls overlap: each begins two bars before the end of the one before, whose last bar was still forming; one is off the grid
    live = bars.where(F.col("time") > times[len(times) // 2 - 6]).withColumn("close", F.col("close") * factor)
    live = live.unionByName(live.limit(1).withColumn("time", F.lit(times[-1] + 3600 + 17)))
    after = [r.time for r in live.orderBy("time").collect()]
    step = len(after) // 3 + 1
    polls = []
    for k in range(3):
        part = live.where(F.col("time").isin(after[max(0, k * step - 2) : (k + 1) * step]))
        last = after[min((k + 1) * step, len(after)) - 1]
        polls.append(part.withColumn("volume", F.when(F.col("time") == last, F.col("volume") / 2).otherwise(F.col("volume"))).withColumn("seq", F.lit(k * 100_000) + F.row_number().over(Window.orderBy("time"))))
    spliced = LiveSplice(spark, f"file://{tmp_path}/s", lambda: ("one", archive), 3600, precedence, diverging)
    schema = polls[0].schema
    if precedence != "cut" or diverging != "archive":  # one poll of them all
        polls = [polls[0].unionByName(polls[1]).unionByName(polls[2])]
    for k, poll in enumerate(polls):
        poll.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(spliced.sink()).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None and spliced.versions() == list(range(k + 1))
        seen = polls[0]
        for p in polls[1 : k + 1]:
            seen = seen.unionByName(p)
        last_updates(seen.withColumn("symbol", F.lit("x"))).select(*BAR).coalesce(1).write.parquet(f"{tmp_path}/now{k}")
        now = spark.read.parquet(f"{tmp_path}/now{k}")
        how = {"precedence": precedence, "diverging": diverging}
        assert rows(spliced.read()) == rows(align.splice(archive, now, 3600, **how))
        assert rows(spliced.report()) == rows(align.splice_report(archive, now, 3600, **how))
    if len(polls) == 1:
        return
    spliced.merge(polls[2], 2)  # again
    assert rows(spliced.read()) == rows(align.splice(archive, now, 3600, **how))
    longer = bars.where(F.col("time") <= times[len(times) // 2 + 3])
    later = LiveSplice(spark, f"file://{tmp_path}/s", lambda: ("two", longer), 3600, precedence, diverging)
    later.merge(polls[2].limit(0), 3)  # the archive has grown
    assert rows(later.read()) == rows(align.splice(longer, now, 3600, **how))
