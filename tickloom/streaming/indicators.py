"""Indicators over a stream of bars, with typed state for each symbol and values of bars that are still forming."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .steps import Steps

PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume", "buy_volume", "sell_volume")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def typed_state(spark: SparkSession):
    """While a query with ``transformWithState`` starts: the state store that it needs; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> Iterator[dict]:
    """A key's rows of one micro-batch, sorted; a field without a number is None."""
    frames = list(rows)
    whole = pd.concat(frames) if len(frames) > 1 else frames[0]
    whole = whole.sort_values(by, kind="stable")
    columns = [whole[c].tolist() for c in whole.columns]
    for values in zip(*columns):
        yield {c: None if v is None or v != v else v for c, v in zip(whole.columns, values)}


def usable(bar: dict) -> bool:
    return all(bar[c] is not None and math.isfinite(bar[c]) for c in PRICES)


class IndicatorProcessor(StatefulProcessor):
    """Steps over each symbol's bars; between micro-batches their numbers and queues are the state."""

    def __init__(self, wanted: dict[str, dict]):
        self.wanted = wanted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("steps", "last long, numbers array<double>, queues array<array<double>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps, last = Steps(self.wanted), None
        if self.state.exists():
            last, numbers, queues = self.state.get()
            steps.load(numbers, queues)
        out = []
        for bar in in_order(rows, ["time", "seq"]):
            if not usable(bar):
                continue
            if not bar["closed"]:
                out.append((key[0], bar["time"], True, *steps.preview(bar)))
            elif last is None or bar["time"] > last:
                last = bar["time"]
                out.append((key[0], last, False, *steps.update(bar)))
        self.state.update((last, *steps.dump()))
        yield pd.DataFrame(out, columns=["symbol", "time", "is_partial", *steps.columns])

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame, wanted: dict[str, dict]) -> DataFrame:
    """(symbol, time, is_partial, <name>_<output>, ...): a row for each bar of a stream.

    bars: (symbol, time, open, high, low, close, volume, buy_volume, sell_volume, closed, seq). A closed bar
    changes the state; one not later than the last closed bar of its symbol is ignored, as are bars without finite
    prices. A bar that isn't closed gives a row with ``is_partial``, as if it closed as it stands, and leaves the
    state alone; it may come any number of times. ``seq`` orders the rows of one time within a micro-batch. Start
    the query within ``typed_state``.
    """
    columns = Steps(wanted).columns
    schema = ", ".join(["symbol string", "time long", "is_partial boolean", *(f"{c} double" for c in columns)])
    rows = bars.where(F.col("symbol").isNotNull() & F.col("time").isNotNull())
    rows = rows.select("symbol", F.col("time").cast("long"), *(F.col(c).cast("double") for c in FIELDS), F.coalesce("closed", F.lit(True)).alias("closed"), F.col("seq").cast("long"))
    return rows.groupBy("symbol").transformWithStateInPandas(IndicatorProcessor(wanted), schema, "append", "none")
