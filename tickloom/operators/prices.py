"""Prices as text, and the levels of a price scale."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, round_to_tick

PLACEHOLDER = "—"


def decimals_from_tick(tick: float) -> int:
    """Digits after the point that a tick needs, ten at most; none from 1 on, or for what is no tick."""
    if not math.isfinite(tick) or tick <= 0 or tick >= 1:
        return 0
    return next((k for k in range(10) if abs(round(tick * 10**k) - tick * 10**k) <= 1e-9), 10)


def format_price(price: Column, tick: float | None = None, precision: int | None = None) -> Column:
    """A price at its tick, with the tick's digits (or ``precision``; two without either); a dash for what isn't a number."""
    known = tick is not None and math.isfinite(tick) and tick > 0
    digits = min(20, precision) if precision is not None and precision >= 0 else decimals_from_tick(tick) if known else 2
    value = round_to_tick(price, tick) if known else price
    return F.when(finite(price), F.format_string(f"%.{digits}f", value.cast("double"))).otherwise(PLACEHOLDER)


def auto_scale(ranges: DataFrame, pad: float = 0.05) -> DataFrame:
    """``ranges`` (lo, hi) with bottom and top: padded, or one to each side of a single price; rows without finite prices go."""
    room = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) * pad)
    return ranges.where(finite(F.col("lo")) & finite(F.col("hi"))).withColumn("top", F.col("hi") + room).withColumn("bottom", F.col("lo") - room)


def _linear(target: int) -> Column:
    raw = (F.col("top") - F.col("bottom")) / target
    size = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    norm = raw / size
    step = F.when(norm >= 5, 5.0).when(norm >= 2.5, 2.5).when(norm >= 2, 2.0).otherwise(1.0) * size
    # whole steps from the first within the range; a thousandth of a step past its top still counts
    one = F.struct(step.alias("s"), F.ceil(F.col("bottom") / step).alias("a"), F.floor(F.col("top") / step + 0.001).alias("b"))
    return F.get(F.transform(F.array(one), lambda x: F.when(x["a"] <= x["b"], F.transform(F.sequence(x["a"], x["b"]), lambda k: k * x["s"])).otherwise(F.array().cast("array<double>"))), 0)


def _log(target: int) -> Column:
    low, high = F.floor(F.log10("bottom")), F.ceil(F.log10("top"))
    n = high - low
    stride = F.when(n <= 4, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(n / max(1, target))))
    kept = F.when(n <= 2, F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0))).when(n <= 4, F.array(F.lit(1.0), F.lit(5.0))).otherwise(F.array(F.lit(1.0)))
    levels = F.flatten(F.transform(F.sequence(low, high, stride.cast("long")), lambda k: F.transform(kept, lambda m: m * F.pow(F.lit(10.0), k))))
    inside = F.filter(levels, lambda p: (p >= F.col("bottom") * (1 - 1e-9)) & (p <= F.col("top") * (1 + 1e-9)))
    return F.when((F.col("bottom") > 0) & (F.col("top") > F.col("bottom")) & (n > 0) & (n <= 320), inside)


def price_ticks(ranges: DataFrame, target: int = 6, logarithmic: bool = False, key: str = "symbol") -> DataFrame:
    """(symbol, tick): about ``target`` levels of each range (bottom, top), at steps of 1, 2, 2.5 or 5 times a power of ten.

    Logarithmic: 1, 2 and 5 times each power of ten over up to two decades, 1 and 5 up to four, and beyond powers
    alone; where that gives fewer than three levels, or a price isn't positive, the linear ones. A range that is empty,
    turned round or not finite has none.
    """
    fine = ranges.where(finite(F.col("bottom")) & finite(F.col("top")) & (F.col("top") > F.col("bottom")))
    ticks = _linear(target)
    if logarithmic:
        log = _log(target)
        ticks = F.when(F.size(F.coalesce(log, F.array().cast("array<double>"))) >= 3, log).otherwise(ticks)
    return fine.select(key, F.explode(ticks).alias("tick"))
