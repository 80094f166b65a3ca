"""Ticks to bars, bars to longer bars, and the list of time frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, finite_bars

#: Seconds by name. A week starts at a multiple of its seconds (a Thursday), and a month has 30 days.
TIMEFRAMES = {"M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14_400, "D1": 86_400, "W1": 604_800, "MN1": 2_592_000}


def bucket(time: Column, step: int) -> Column:
    """Start of the half-open bucket [k step, (k + 1) step) that a time is in."""
    return (F.floor(time / step) * step).cast("long")


def trades_to_bars(trades: DataFrame, step: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One bar per symbol and bucket of (symbol, seq, time, price, size, side).

    Among trades of the first (last) time of a bucket, the one that came first gives the open (close).
    Volumes are null, not zero, where no trade has one. A step under 1 gives no bars.
    """
    good = trades.where(finite(F.col("time")) & finite(F.col("price")) & F.lit(step >= 1))
    size = F.when(finite(F.col("size")), F.col("size"))
    return good.groupBy(*keys, bucket(F.col("time"), max(step, 1)).alias("time")).agg(
        F.min_by("price", F.struct("time", "seq")).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", F.struct(F.col("time"), -F.col("seq"))).alias("close"),
        F.sum(size).alias("volume"),
        F.sum(F.when(F.col("side") == "buy", size)).alias("buy_volume"),
        F.sum(F.when(F.col("side") == "sell", size)).alias("sell_volume"),
    )


def can_roll(from_step: int, to_step: int) -> bool:
    return from_step >= 1 and to_step >= from_step and to_step % from_step == 0


def rollup(bars: DataFrame, from_step: int, to_step: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars of a longer period from those of a shorter one that divides it; else no bars."""
    good = finite_bars(bars).where(F.lit(can_roll(from_step, to_step)))
    sums = [F.sum(F.when(finite(F.col(c)), F.col(c))).alias(c) for c in ("volume", "buy_volume", "sell_volume")]
    return good.groupBy(*keys, bucket(F.col("time"), max(to_step, 1)).alias("b")).agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), *sums
    ).withColumnRenamed("b", "time")


def rollable(step: int) -> list[str]:
    """Time frames that bars of ``step`` seconds can be rolled up to."""
    return [name for name, s in TIMEFRAMES.items() if can_roll(step, s)]


def next_timeframe(name: str) -> str | None:
    names = list(TIMEFRAMES)
    k = names.index(name) + 1
    return names[k] if k < len(names) else None


def previous_timeframe(name: str) -> str | None:
    names = list(TIMEFRAMES)
    k = names.index(name) - 1
    return names[k] if k >= 0 else None


def daily_amplitude(bars: DataFrame, day: Column, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return bars.groupBy(*keys, day.alias("day")).agg((F.max("high") - F.min("low")).alias("amplitude"), F.count("*").alias("n"))
