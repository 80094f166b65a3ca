"""Structured Streaming forms: ticks to bars, states of indicators and alerts per symbol.

The steps of ``operators.state`` run here as they do in batch; the state is the pickled step, kept by Spark
under the symbol, so a restarted query goes on where its checkpoint stands.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ticks_to_bars(trades: DataFrame, step: int = 60, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of (symbol, seq, ts, price, size, side), each emitted once the watermark has passed it."""
    size = F.when(~F.isnan("size"), F.col("size"))
    bars = (
        trades.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", f"{step} seconds").alias("w"))
        .agg(
            F.min_by("price", F.struct("ts", "seq")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", F.struct(F.col("ts"), -F.col("seq"))).alias("close"), F.sum(size).alias("volume"),
            F.sum(F.when(F.col("side") == "buy", size)).alias("buy_volume"), F.sum(F.when(F.col("side") == "sell", size)).alias("sell_volume"),
        )
    )
    return bars.select("symbol", F.unix_seconds("w.start").alias("time"), "open", "high", "low", "close", "volume", "buy_volume", "sell_volume")


def run_steps(rows: DataFrame, make: Callable[[], Callable[[dict], list[dict]]], schema: str, key: str = "symbol", order: str = "time") -> DataFrame:
    """A step over a stream of rows, with its state per key; rows not later than the last one seen are dropped."""
    names = [c.split()[0] for c in schema.split(", ")]

    def feed(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, last = pickle.loads(state.get[0]) if state.exists else (make(), None)
        frame = pd.concat(list(frames)).sort_values(order)
        out: list[dict] = []
        for row in frame.to_dict("records"):
            if last is None or row[order] > last:
                last = row[order]
                out += step(row)
        state.update((pickle.dumps((step, last)),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(key).applyInPandasWithState(feed, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


class Ema:
    """The recursive average as a step: the mean of the first n, then e += k (x - e)."""

    def __init__(self, n: int, field: str = "close"):
        self.n, self.field, self.k, self.e, self.head = n, field, 2 / (n + 1), None, []

    def __call__(self, row: dict) -> list[dict]:
        x = row[self.field]
        if self.e is not None:
            self.e += self.k * (x - self.e)
        else:
            self.head.append(x)
            if len(self.head) == self.n:
                self.e = sum(self.head) / self.n
        return [{"symbol": row["symbol"], "time": row["time"], "value": self.e}]

    def preview(self, x: float) -> float | None:
        """The value as if x closed now; the state stays."""
        return None if self.e is None else self.e + self.k * (x - self.e)


class CrossAlert:
    """Fires when a price crosses a level upward."""

    def __init__(self, level: float):
        self.level, self.before = level, None

    def __call__(self, row: dict) -> list[dict]:
        v, p = row["close"], self.before
        if v is None or v != v:
            return []
        self.before = v
        return [{"symbol": row["symbol"], "time": row["time"], "value": v}] if p is not None and p <= self.level < v else []
