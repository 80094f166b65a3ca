"""Asset-level analytics: correlation, performance, seasonality, consensus, sessions, quality and audit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, offset_day
from .align import align

DAY = 86_400
#: Days that a year must cover for its curve to be drawn.
LEAST_DAYS = 60
WINDOWS = {"7d": 7, "30d": 30, "91d": 91, "182d": 182, "365d": 365}


def base100(bars: DataFrame) -> DataFrame:
    """(symbol, time, value): closes as percent of the symbol's first; nothing if that is zero."""
    first = F.first("close").over(Window.partitionBy("symbol").orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("f", first).where(finite(F.col("f")) & (F.col("f") != 0)).select("symbol", "time", (100 * F.col("close") / F.nullif("f", F.lit(0.0))).alias("value"))


def returns_correlation(a: DataFrame, b: DataFrame, least: int = 20) -> DataFrame:
    """One row (n, r): Pearson correlation of simple returns at common times; null under ``least`` pairs or without variance."""
    w = Window.orderBy("time")
    both = align(a, b).withColumn("pa", F.lag("a").over(w)).withColumn("pb", F.lag("b").over(w)).where("pa <> 0 and pb <> 0")
    r = both.select((F.col("a") / F.nullif("pa", F.lit(0.0)) - 1).alias("x"), (F.col("b") / F.nullif("pb", F.lit(0.0)) - 1).alias("y"))
    s = r.agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return s.select("n", F.when((F.col("n") >= least) & (F.col("vx") > 0) & (F.col("vy") > 0), F.least(F.greatest(F.col("c") / F.nullif(F.sqrt(F.col("vx") * F.col("vy")), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))).alias("r"))


def correlation_label(r: Column) -> Column:
    """strong, moderate, weak or none, and its sign."""
    a = F.abs(r)
    word = F.when(a >= 0.7, "strong").when(a >= 0.4, "moderate").when(a >= 0.15, "weak").otherwise("none")
    return F.when(r.isNull(), "unknown").when(a < 0.15, word).otherwise(F.concat(word, F.when(r > 0, " positive").otherwise(" negative")))


def performance(bars: DataFrame) -> DataFrame:
    """(symbol, window, start, change): percent change over each window of days and the year so far.

    Null unless history reaches the window's limit within max(3 days, 3 %), or where the start would be the last
    bar itself or lies further from the limit than the window is long.
    """
    last = bars.groupBy("symbol").agg(F.max("time").alias("end"), F.max_by("close", "time").alias("close"), F.min("time").alias("begin"))
    year = F.unix_seconds(F.to_timestamp(F.concat(F.year(F.timestamp_seconds("end")), F.lit("-01-01"))))
    each = F.array(*(F.struct(F.lit(k).alias("window"), (F.col("end") - d * DAY).alias("limit"), F.lit(d * DAY).cast("double").alias("span")) for k, d in WINDOWS.items()), F.struct(F.lit("ytd").alias("window"), year.alias("limit"), (F.col("end") - year).cast("double").alias("span")))
    limits = last.select("symbol", "end", "begin", F.col("close").alias("now"), F.explode(each).alias("w")).select("symbol", "end", "begin", "now", "w.*")
    # six limits a symbol: an equi-join on the symbol and a conditional maximum, no as-of search
    on = bars.select(F.col("symbol").alias("s"), "time", "close").join(limits, F.col("s") == F.col("symbol"))
    start = F.coalesce(F.max(F.when(F.col("time") <= F.col("limit"), F.struct("time", "close"))), F.min(F.struct("time", "close")))
    g = on.groupBy("symbol", "window", "limit", "span", "end", "begin", "now").agg(start.alias("b"))
    slack = F.greatest(F.lit(3.0 * DAY), 0.03 * F.col("span"))
    fine = (F.col("begin") <= F.col("limit") + slack) & (F.col("b.time") < F.col("end")) & (F.abs(F.col("b.time") - F.col("limit")) <= F.col("span")) & (F.col("b.close") != 0)
    return g.select("symbol", "window", F.col("b.time").alias("start"), F.when(fine, 100 * (F.col("now") / F.nullif("b.close", F.lit(0.0)) - 1)).alias("change"))


def seasonality(bars: DataFrame, years: int = 3) -> DataFrame:
    """(symbol, year, day, change, covered): percent since each year's first bar, for the last years with two bars at least."""
    t = F.timestamp_seconds("time")
    b = bars.select("symbol", "time", "close", F.year(t).alias("year"), F.dayofyear(t).alias("day"))
    per = b.groupBy("symbol", "year").agg(F.min_by("close", "time").alias("first"), F.count("*").alias("n"), F.count_distinct("day").alias("covered")).where("n >= 2 and first <> 0")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("year")))
    kept = per.withColumn("k", rank).where(F.col("k") <= years)
    return b.join(kept, ["symbol", "year"]).select("symbol", "year", "day", "time", (100 * (F.col("close") / F.nullif("first", F.lit(0.0)) - 1)).alias("change"), "covered")


def seasonality_usable(curves: DataFrame, least: int = LEAST_DAYS) -> DataFrame:
    """(symbol, usable): whether any year of ``seasonality`` covers enough days to be drawn."""
    return curves.groupBy("symbol").agg(F.max(F.col("covered") >= least).alias("usable"))


def change_within(open_: Column, close: Column) -> tuple[Column, Column]:
    """A bar's change, and in percent of its open; null where the open is zero."""
    return close - open_, 100 * (close - open_) / F.nullif(open_, F.lit(0.0))


def vote_oscillator(v: Column) -> Column:
    return F.when(v <= 30, 1).when(v >= 70, -1).when(v.isNotNull(), 0)


def vote_average(price: Column, average: Column) -> Column:
    return F.when(price > average * 1.001, 1).when(price < average * 0.999, -1).when(average.isNotNull() & price.isNotNull(), 0)


def consensus(votes: DataFrame, columns: list[str]) -> DataFrame:
    """Add score ((buys - sells) / voters) and a label; nulls don't vote."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0))
    voters = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    score = total / F.nullif(voters.cast("double"), F.lit(0.0))
    s = F.col("score")
    label = F.when(s.isNull(), "none").when(s >= 0.5, "strong buy").when(s >= 0.15, "buy").when(s <= -0.5, "strong sell").when(s <= -0.15, "sell").otherwise("neutral")
    return votes.withColumn("score", score).withColumn("label", label)


# ---- sessions and quality


@dataclass(frozen=True)
class Sessions:
    """Open minutes by weekday (0 is Sunday), at a fixed offset from UTC in seconds. No weekdays: always open."""

    hours: dict[int, tuple[int, int]] = field(default_factory=dict)
    offset: int = -10_800


WEEKDAYS = Sessions({d: (9 * 60, 18 * 60) for d in range(1, 6)})


def touches_session(time: Column, period: int, sessions: Sessions) -> Column:
    """Whether [time, time + period) meets an open session."""
    if not sessions.hours:
        return F.lit(True)
    local = time + sessions.offset
    days = F.sequence(F.floor(local / DAY), F.floor((local + period - 1) / DAY))
    def open_on(d):
        # 1970-01-01 was a Thursday
        weekday = F.pmod(d + 4, F.lit(7))
        out = F.lit(False)
        for k, (a, b) in sessions.hours.items():
            out = out | ((weekday == k) & (local < d * DAY + b * 60) & (local + period > d * DAY + a * 60))
        return out

    return F.exists(days, open_on)


def split_by_session(bars: DataFrame, period: int, sessions: Sessions, whole_days: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bars that meet a session, and those that don't.

    With ``whole_days``, those that meet a day with a session: a bar before the opening isn't one of a day without trading.
    """
    if whole_days:
        sessions = Sessions({d: (0, 24 * 60) for d in sessions.hours}, sessions.offset)
    ok = touches_session(F.col("time"), period, sessions)
    return bars.where(ok), bars.where(~ok)


def volume_coverage(bars: DataFrame, official: DataFrame, offset: int = -10_800) -> DataFrame:
    """One row: days, median and worst share of the official volume, and days under 0.9. official: (day, volume)."""
    own = bars.groupBy(offset_day(F.col("time"), offset).alias("day")).agg(F.sum("volume").alias("own"))
    both = own.join(official, "day").where(F.col("volume") > 0).withColumn("share", F.coalesce("own", F.lit(0.0)) / F.nullif("volume", F.lit(0.0)))
    return both.agg(F.count("*").alias("days"), F.median("share").alias("median_share"), F.min("share").alias("worst_share"), F.count_if(F.col("share") < 0.9).alias("low_days"))


def ohlc_audit(bars: DataFrame, period: int) -> DataFrame:
    """(check, failed, total): geometry of bars, the grid of times, repeats, volumes and sides, in one pass."""
    dup = F.count("*").over(Window.partitionBy("symbol", "time")) > 1
    rules = {
        "high_below": F.col("high") < F.greatest("open", "close", "low"),
        "low_above": F.col("low") > F.least("open", "close", "high"),
        "off_grid": F.pmod("time", F.lit(period)) != 0,
        "repeated": F.col("dup"),
        "negative_volume": F.col("volume") < 0,
        "sides_over_volume": F.coalesce("buy_volume", F.lit(0.0)) + F.coalesce("sell_volume", F.lit(0.0)) > F.col("volume") * (1 + 1e-9),
    }
    one = bars.withColumn("dup", dup).agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("failed"), "total") for k in rules))).alias("x")).select("x.*")


def median_step(bars: DataFrame, most: int = 400) -> DataFrame:
    """(symbol, step): the median of the last positive steps in time."""
    w = Window.partitionBy("symbol").orderBy("time")
    d = bars.withColumn("d", F.col("time") - F.lag("time").over(w)).withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("time"))))
    return d.where((F.col("d") > 0) & (F.col("r") <= most)).groupBy("symbol").agg(F.median("d").alias("step"))


def separators(bars: DataFrame, unit: str = "day", zone: str = "UTC") -> DataFrame:
    """Bars at which the day, week (from Monday), month or year changes in a zone."""
    if unit not in ("day", "week", "month", "year"):
        raise ValueError(f"unknown unit {unit!r}")
    k = F.date_trunc(unit, F.from_utc_timestamp(F.timestamp_seconds("time"), zone))
    w = Window.partitionBy("symbol").orderBy("time")
    return bars.withColumn("k", k).withColumn("before", F.lag("k").over(w)).where("before is not null and k <> before").select("symbol", "time")


def autoscale(bars: DataFrame, start: int, end: int, pad: float = 0.05) -> DataFrame:
    """One row per symbol: lowest and highest price of a range of time, padded."""
    s = bars.where(F.col("time").between(start, end)).groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    room = (F.col("hi") - F.col("lo")) * pad
    return s.select("symbol", (F.col("lo") - room).alias("lo"), (F.col("hi") + room).alias("hi"))


# ---- levels


FIB_RETRACEMENT = (0, 0.236, 0.382, 0.5, 0.618, 0.786, 1)
FIB_EXTENSION = (1, 1.272, 1.618, 2, 2.618)
FIB_TIMES = (1, 2, 3, 5, 8, 13, 21)


def levels_between(anchors: DataFrame, levels: tuple, *keep: str) -> DataFrame:
    """(symbol, level, price, and what is kept of the anchors): prices between (and beyond) two anchors p0 and p1."""
    lv = F.explode(F.array(*(F.lit(float(x)) for x in levels)))
    return anchors.withColumn("level", lv).select("symbol", "level", *keep, (F.col("p0") + (F.col("p1") - F.col("p0")) * F.col("level")).alias("price"))


def fib_fan(anchors: DataFrame, levels: tuple = FIB_RETRACEMENT) -> DataFrame:
    """(symbol, level, price, slope): rays from the first anchor through each level at the second one's time; slope is null if both are at one time."""
    return levels_between(anchors, levels, "t0", "t1", "p0").select("symbol", "level", "price", ((F.col("price") - F.col("p0")) / F.nullif((F.col("t1") - F.col("t0")).cast("double"), F.lit(0.0))).alias("slope"))


def fib_time_zones(anchors: DataFrame) -> DataFrame:
    k = F.explode(F.array(*(F.lit(x) for x in FIB_TIMES)))
    return anchors.withColumn("k", k).select("symbol", "k", (F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("k")).alias("time"))


def position_target(entry: Column, stop: Column, reward: float = 2.0) -> Column:
    return entry - (stop - entry) * min(max(reward, 0.1), 20.0)


def channel_line(p0: Column, p1: Column, ratio: float) -> tuple[Column, Column]:
    shift = (p1 - p0) * (min(max(abs(ratio), 0.05), 10.0) * (1 if ratio >= 0 else -1))
    return p0 + shift, p1 + shift


def trend_line(time: Column, t0: Column, p0: Column, t1: Column, p1: Column) -> Column:
    return p0 + (p1 - p0) * (time - t0) / F.nullif(t1 - t0, F.lit(0))


def replay(bars: DataFrame, position: int) -> DataFrame:
    """The first ``position`` bars of each symbol."""
    return bars.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("time"))).where(F.col("rn") <= position).drop("rn")


def replay_until(bars: DataFrame, time: int) -> DataFrame:
    return bars.where(F.col("time") <= time)
