"""Audits of bars against an official settlement and against another source: a status for each check, with a few offenders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Relative errors: equal, and what still passes for a revision.
EQUAL, REVISED = 1e-9, 0.001
#: Common bars as a share of the shorter series; percent by which closes may differ in the mean; bounds of the ratio of volumes.
COVERED, APART, SAME_UNIT = 0.8, 0.15, (0.5, 2.0)
EXAMPLES = 3
RESULT = ("symbol", "check", "status", "n", "value", "examples")


def settlement(bars: DataFrame, official: DataFrame) -> DataFrame:
    """(symbol, check, status, n, value, examples): closes of daily bars against official ones (symbol, day, last_price, traded_qty).

    Of several official rows of a day the one with the most traded counts. n is the days compared, value the worst
    relative error: OK if all are equal, WARN up to a thousandth, FAIL beyond, with the first days beyond as examples.
    Days after the last official one aren't published yet and don't count; without any common day it is a WARN.
    """
    one = official.where("day is not null and last_price is not null and traded_qty is not null").groupBy("symbol", "day").agg(F.max_by("last_price", "traded_qty").alias("official"))
    b = bars.select("symbol", "time", "close", F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd").alias("day"))
    both = b.join(one, ["symbol", "day"], "left").withColumn("error", F.abs(F.col("close") - F.col("official")) / F.nullif("official", F.lit(0.0)))
    worst = F.max("error")
    status = F.when(F.count("error") == 0, "WARN").when(F.count_if(F.col("error") < EQUAL) == F.count("error"), "OK").when(worst <= REVISED, "WARN").otherwise("FAIL")
    s = both.groupBy("symbol").agg(status.alias("status"), F.count("error").alias("n"), worst.alias("value"))
    return _with_examples(s, both.where(F.col("error") > REVISED), "settlement")


def _with_examples(found: DataFrame, offenders: DataFrame, check: str) -> DataFrame:
    """The first offending times of each symbol: ranked with a limit, so no task gathers them all."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("time"))
    few = offenders.select("symbol", "time").withColumn("__k", rank).where(F.col("__k") <= EXAMPLES).groupBy("symbol").agg(F.sort_array(F.collect_list("time")).alias("examples"))
    joined = found.join(few, "symbol", "left").withColumn("check", F.lit(check))
    return joined.withColumn("examples", F.coalesce("examples", F.array().cast("array<long>"))).select(*RESULT)


def agreement(archive: DataFrame, live: DataFrame, period: int) -> DataFrame:
    """The same columns for coverage, close and volume of two sources of the same symbols, in the buckets that both have.

    coverage: common bars as a share of the shorter source; close: mean difference in percent of the first common close;
    volume: the upper median of the ratio. Examples are the first common bars whose closes differ by more than is allowed in the mean,
    or whose ratio is out of bounds. Without a common bar, or a comparable volume, it is a WARN.
    """
    bucket = F.floor(F.col("time") / period).alias("b")
    a = archive.groupBy("symbol", bucket).agg(F.max_by(F.struct("close", "volume"), "time").alias("a"))
    v = live.select("symbol", bucket, "time", F.struct("close", "volume").alias("v"))
    sizes = archive.groupBy("symbol").agg(F.count("*").alias("na")).join(live.groupBy("symbol").agg(F.count("*").alias("nv")), "symbol")
    ok = (F.col("a.volume") > 0) & (F.col("v.volume") > 0)
    both = v.join(a, ["symbol", "b"]).select("symbol", "time", F.abs(F.col("v.close") - F.col("a.close")).alias("gap"), F.col("a.close").alias("close"), F.when(ok, F.col("v.volume") / F.nullif(F.col("a.volume"), F.lit(0.0))).alias("ratio"))
    s = both.groupBy("symbol").agg(F.count("*").alias("n"), (100 * F.avg("gap") / F.nullif(F.min_by("close", "time"), F.lit(0.0))).alias("apart"), F.min_by("close", "time").alias("level"), F.count("ratio").alias("nr"), F.expr("percentile_disc(0.500000000001) WITHIN GROUP (ORDER BY ratio)").alias("ratio"))
    s = sizes.join(s, "symbol", "left").withColumn("covered", F.col("n") / F.least("na", "nv"))
    none = F.col("n").isNull()
    inside = (F.col("ratio") > SAME_UNIT[0]) & (F.col("ratio") < SAME_UNIT[1])
    checks = [
        ("coverage", F.when(none, "WARN").when(F.col("covered") < COVERED, "FAIL").otherwise("OK"), F.col("n"), F.col("covered")),
        ("close", F.when(none, "WARN").when(F.col("apart") < APART, "OK").otherwise("FAIL"), F.col("n"), F.col("apart")),
        ("volume", F.when(F.coalesce("nr", F.lit(0)) == 0, "WARN").when(inside, "OK").otherwise("FAIL"), F.col("nr"), F.col("ratio")),
    ]
    wide = both.join(s.select("symbol", "level"), "symbol")
    off = {
        "close": wide.where(100 * F.col("gap") / F.nullif("level", F.lit(0.0)) >= APART),
        "volume": wide.where(~((F.col("ratio") > SAME_UNIT[0]) & (F.col("ratio") < SAME_UNIT[1]))),
        "coverage": wide.limit(0),
    }
    out = None
    for check, status, n, value in checks:
        rows = _with_examples(s.select("symbol", status.alias("status"), F.coalesce(n, F.lit(0)).alias("n"), value.alias("value")), off[check], check)
        out = rows if out is None else out.unionByName(rows)
    return out
