"""Operators with a state from bar to bar, as steps that batch jobs and streams share.

A batch job sorts each symbol's bars within its partition and hands them to a step one by one, holding
the state of one symbol at a time, however long its series is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import Chain


def scan(df: DataFrame, make: Callable[[], Callable[[dict], list[dict]]], schema: str, key: str = "symbol", order: str = "time") -> DataFrame:
    """Run a step over the rows of each key in order; each call returns the rows to emit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = None, None
        names = [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            out: list[dict] = []
            for row in frame.to_dict("records"):
                if step is None or row[key] != now:
                    now, step = row[key], make()
                out += step(row)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


class SuperTrend:
    """Bands around the middle of a bar that only tighten until the close breaks the one in force."""

    def __init__(self, mult: float = 3.0):
        self.mult, self.bands, self.side, self.close = mult, None, 1, None

    def __call__(self, row: dict) -> list[dict]:
        head = {"symbol": row["symbol"], "time": row["time"]}
        atr = row["atr"]
        if atr is None or atr != atr:
            return [head | {"value": None, "direction": None}]
        middle = (row["high"] + row["low"]) / 2
        up, down = middle + self.mult * atr, middle - self.mult * atr
        if self.bands is not None:
            before_up, before_down = self.bands
            # a band loosens only after the close before has passed it
            if self.close <= before_up:
                up = min(up, before_up)
            if self.close >= before_down:
                down = max(down, before_down)
            if self.side > 0 and row["close"] < before_down:
                self.side = -1
            elif self.side < 0 and row["close"] > before_up:
                self.side = 1
        self.bands, self.close = (up, down), row["close"]
        return [head | {"value": down if self.side > 0 else up, "direction": float(self.side)}]


class ParabolicSar:
    def __init__(self, step: float = 0.02, most: float = 0.2):
        self.step, self.most = step, max(step, most)
        self.past: list[tuple[float, float]] = []  # (high, low) of the last two bars
        self.first_close = self.sar = None

    def __call__(self, row: dict) -> list[dict]:
        high, low, close = row["high"], row["low"], row["close"]
        value = None
        if self.first_close is None:
            self.first_close = close
        elif self.sar is None:
            (h, l), self.long = self.past[-1], close >= self.first_close
            self.sar, self.extreme = (l, max(h, high)) if self.long else (h, min(l, low))
            self.pace = self.step
            value = self.sar
        else:
            sar = self.sar + self.pace * (self.extreme - self.sar)
            highs, lows = zip(*self.past)
            sar = min(sar, *lows) if self.long else max(sar, *highs)
            if low < sar if self.long else high > sar:
                sar, self.extreme, self.pace = self.extreme, low if self.long else high, self.step
                self.long = not self.long
            elif high > self.extreme if self.long else low < self.extreme:
                self.extreme = high if self.long else low
                self.pace = min(self.pace + self.step, self.most)
            self.sar = value = sar
        self.past = [*self.past[-1:], (high, low)]
        return [{"symbol": row["symbol"], "time": row["time"], "value": value}]


class AdaptiveAverage:
    """e += rate (x - e), where the rate comes with each row; starts from the value before the first rate."""

    def __init__(self):
        self.e = self.before = None

    def __call__(self, row: dict) -> list[dict]:
        x, rate = row["x"], row["rate"]
        if rate is not None and rate == rate:
            self.e = self.before if self.e is None else self.e
            self.e += rate * (x - self.e)
        self.before = x
        return [{"symbol": row["symbol"], "time": row["time"], "value": self.e}]


class Renko:
    """Bricks of one size: on in the same direction after one size, back after two."""

    def __init__(self):
        self.level, self.way, self.clock = None, 0, None

    def __call__(self, row: dict) -> list[dict]:
        size, price = row["brick"], row["close"]
        if size is None or not size > 0:
            return []
        if self.level is None:
            self.level = price
            return []
        out = []
        while True:
            gap = price - self.level
            way = 1 if gap > 0 else -1
            turning = self.way not in (0, way)
            if abs(gap) < (2 * size if turning else size):
                return out
            start = self.level + way * size if turning else self.level
            end = start + way * size
            self.clock = row["time"] if self.clock is None else max(row["time"], self.clock + 1)
            out.append({"symbol": row["symbol"], "time": self.clock, "open": start, "high": max(start, end), "low": min(start, end), "close": end})
            self.level, self.way = end, way


def supertrend(bars: DataFrame, n: int = 10, mult: float = 3.0) -> DataFrame:
    c = Chain(bars)
    atr = c.rma(c.true_range(), n)
    rows = c.df.select("symbol", "time", "high", "low", "close", F.col(atr).alias("atr"))
    return scan(rows, lambda: SuperTrend(mult), "symbol string, time long, value double, direction double")


def psar(bars: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    return scan(bars.select("symbol", "time", "high", "low", "close"), lambda: ParabolicSar(step, most), "symbol string, time long, value double")


def kama(bars: DataFrame, n: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    c = Chain(bars)
    before, back = c.lag("close"), c.lag("close", n)
    path = c.put(f"sum(abs(close - {before})) OVER {c.last(n)}")
    e = c.put(f"CASE WHEN {back} IS NULL THEN NULL WHEN {path} = 0 THEN 0 ELSE abs(close - {back}) / nullif({path}, 0) END")
    a, b = 2 / (fast + 1), 2 / (slow + 1)
    rate = c.put(f"pow({e} * {a - b!r}D + {b!r}D, 2)")
    rows = c.df.select("symbol", "time", F.col("close").alias("x"), F.col(rate).alias("rate"))
    return scan(rows, AdaptiveAverage, "symbol string, time long, value double")


def brick_size(bars: DataFrame, multiple: float = 1.0) -> DataFrame:
    """(symbol, brick): the mean step from close to close, times a multiple; null if there is no step."""
    c = Chain(bars)
    before = c.lag("close")
    mean = F.avg(F.abs(F.col("close") - F.col(before)))
    return c.df.groupBy("symbol").agg(F.when(mean > 0, mean * multiple).alias("brick"))


def renko(bars: DataFrame, multiple: float = 1.0) -> DataFrame:
    rows = bars.join(brick_size(bars, multiple), "symbol").select("symbol", "time", "close", "brick")
    return scan(rows, Renko, "symbol string, time long, open double, high double, low double, close double")


def heikin_ashi(bars: DataFrame) -> DataFrame:
    """Candles of averages. The open halves the way to the close before: a recursive average, so windows do."""
    c = Chain(bars)
    ha = c.put("(open + high + low + close) / 4")
    before = c.lag(ha)
    start = c.put(f"CASE WHEN {before} IS NULL THEN (open + close) / 2 ELSE {before} END")
    op = c.recursive(start, 1, 0.5)
    return c.df.select(
        "symbol", "time", F.col(op).alias("open"), F.greatest("high", op, ha).alias("high"), F.least("low", op, ha).alias("low"), F.col(ha).alias("close")
    )
