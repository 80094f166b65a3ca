"""Replay of a series under commands: play, pause, speed, elapsed time, steps and jumps, as a stream or in batch.

A controller's state is four numbers for each session. A command says from which position to which it went; the bars
it showed are those ranks, joined by (symbol, rank). Times are turned into positions by an index of as many buckets as there are bars, with
a row for each bucket, empty or not, so that a stream can look them up by equality.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import scan
from .indicators import in_order

KINDS = ("play", "pause", "speed", "elapsed", "step", "seek", "seek_time")
MOVED = "session string, symbol string, seq long, from_position long, position long, playing boolean, at_end boolean"


class Controller:
    """Where a session is. ``x`` is milliseconds for elapsed, bars a second for speed, bars or a position for the rest."""

    def __init__(self, position: int = 0, carry: float = 0.0, playing: bool = False, speed: float = 1.0):
        self.position, self.carry, self.playing, self.speed = position, carry, playing, speed

    def _to(self, position: float, length: int) -> None:
        self.position = min(max(math.trunc(position), 0), length)
        self.carry = 0.0
        self.playing = self.playing and self.position < length

    def __call__(self, row: dict) -> list[dict]:
        kind, x, length = row["kind"], row["x"], row["length"] or 0
        number = x is not None and math.isfinite(x)
        before = self.position = min(self.position, length)
        if kind == "play":
            self.carry, self.playing = 0.0, self.position < length
        elif kind == "pause":
            self.playing = False
        elif kind == "speed":
            self.speed = x if number and x > 0 else 0.0
        elif kind == "elapsed" and self.playing and number and x > 0 and self.speed > 0:
            exact = x / 1000 * self.speed + self.carry
            whole = math.floor(exact)
            if whole > 0:
                self._to(self.position + whole, length)
            self.carry = exact - whole
        elif kind == "step" and number:
            self._to(self.position + math.trunc(x), length)
        elif kind in ("seek", "seek_time"):
            # a jump to nowhere stays, but what was left over goes
            self._to(x if number else self.position if kind == "seek_time" else 0, length)
        return [{"session": row["session"], "symbol": row["symbol"], "seq": row["seq"], "from_position": before, "position": self.position, "playing": self.playing, "at_end": self.position >= length}]


def ranked(bars: DataFrame) -> DataFrame:
    """``bars`` with rank, from 1, by time within each symbol."""
    return bars.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy("time")))


def time_index(ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol, length, t0, width, top) of each symbol, and (symbol, bucket, before, times): as many buckets as bars at most."""
    facts = ranks.groupBy("symbol").agg(F.count("*").alias("length"), F.min("time").alias("t0"), F.max("time").alias("t1"))
    width = F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0") + 1) / F.col("length"))).cast("long")
    facts = facts.withColumn("width", width).withColumn("top", F.floor((F.col("t1") - F.col("t0")) / F.col("width"))).drop("t1")
    held = ranks.join(facts, "symbol").groupBy("symbol", F.floor((F.col("time") - F.col("t0")) / F.col("width")).alias("bucket")).agg(F.min("rank").alias("first"), F.collect_list("time").alias("times"))
    every = facts.select("symbol", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"))).alias("bucket"))
    after = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(0, Window.unboundedFollowing)
    joined = every.join(held, ["symbol", "bucket"], "left")
    return facts, joined.select("symbol", "bucket", (F.coalesce(F.first("first", True).over(after), F.col("length") + 1) - 1).alias("before"), F.coalesce("times", F.array().cast("array<long>")).alias("times"))


def _resolved(commands: DataFrame, facts: DataFrame, index: DataFrame) -> DataFrame:
    """Commands with their symbol's length, and positions for times."""
    c = commands.join(facts, "symbol", "left")
    jump = (F.col("kind") == "seek_time") & F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < 9e15)
    bucket = F.when(jump, F.least(F.floor((F.col("x") - F.col("t0")) / F.col("width")), F.col("top")))
    c = c.withColumn("bucket", bucket.cast("long")).join(index, ["symbol", "bucket"], "left")
    found = F.coalesce(F.col("before") + F.size(F.filter("times", lambda t: t <= F.col("x"))), F.lit(0))  # before the first bar: none
    x = F.when(F.col("kind") != "seek_time", F.col("x")).when(jump & F.col("length").isNotNull(), found.cast("double"))
    return c.select("session", "symbol", F.col("seq").cast("long"), "kind", x.alias("x"), F.col("length").cast("long"))


class ReplayProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("controller", "position long, carry double, playing boolean, speed double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        c = Controller(*self.state.get()) if self.state.exists() else Controller()
        out = []
        for row in in_order(rows, ["seq"]):
            row["length"] = int(row["length"] or 0)
            out += c(row)
        self.state.update((c.position, c.carry, c.playing, c.speed))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in MOVED.split(", ")])

    def close(self) -> None:
        pass


def replay_moves(commands: DataFrame, bars: DataFrame) -> DataFrame:
    """What each command did (``MOVED``): commands (session, symbol, seq, kind, x) over static bars (symbol, time, ...).

    Works on a stream of commands (start it within ``typed_state``) and on a batch. A session replays one symbol; of a symbol
    without bars, positions are 0 and at the end. Unknown kinds do nothing.
    """
    facts, index = time_index(ranked(bars.select("symbol", "time")))
    ready = _resolved(commands, facts, index)
    if commands.isStreaming:
        return ready.groupBy("session").transformWithStateInPandas(ReplayProcessor(), MOVED, "append", "none")

    def controller():
        c = Controller()
        return lambda row: c({k: None if isinstance(v, float) and v != v else v for k, v in row.items()})

    return scan(ready.withColumn("length", F.coalesce("length", F.lit(0))), controller, MOVED, key="session", order="seq")


def shown(moves: DataFrame, bars: DataFrame) -> DataFrame:
    """(session, seq, bar columns) of the bars that a move newly showed; a move back shows none."""
    one = moves.where("position > from_position").select("session", "seq", "symbol", F.explode(F.sequence(F.col("from_position") + 1, F.col("position"))).alias("rank"))
    return one.join(ranked(bars), ["symbol", "rank"])
