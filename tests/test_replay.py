"""Moves of a replay against a controller written out as a loop over the bars, in batch and as a stream that restarts."""

import math
import random

from pyspark.sql import functions as F

from tickloom.streaming.indicators import typed_state
from tickloom.streaming.replay import replay_moves, shown

SCHEMA = "session string, symbol string, seq long, kind string, x double"


class Plain:
    def __init__(self, times):
        self.times, self.pos, self.left, self.on, self.rate = times, 0, 0.0, False, 1.0

    def jump(self, p):
        self.pos, self.left = max(0, min(len(self.times), int(p))), 0.0
        if self.pos >= len(self.times):
            self.on = False

    def do(self, kind, x):
        ok = x is not None and math.isfinite(x)
        if kind == "play":
            self.left, self.on = 0.0, self.pos < len(self.times)
        elif kind == "pause":
            self.on = False
        elif kind == "speed":
            self.rate = x if ok and x > 0 else 0.0
        elif kind == "step" and ok:
            self.jump(self.pos + int(x))
        elif kind == "seek":
            self.jump(x if ok else 0)
        elif kind == "seek_time":
            self.jump(sum(t <= x for t in self.times) if ok and self.times else self.pos)
        elif kind == "elapsed" and self.on and ok and x > 0 and self.rate > 0:
            exact = x / 1000 * self.rate + self.left
            self.left = exact - math.floor(exact)
            self.pos = min(len(self.times), self.pos + math.floor(exact))
            if self.pos >= len(self.times):
                self.on = False


def commands(seed, times):
    rng = random.Random(seed)
    out = [("play", None), ("elapsed", 1500.0), ("elapsed", 499.0), ("elapsed", 1.0), ("speed", 2.5), ("elapsed", 333.0), ("elapsed", 333.0), ("speed", -1.0), ("elapsed", 9e3), ("speed", 3.0)]
    for _ in range(120):
        kind = rng.choice(["elapsed"] * 6 + ["step", "seek", "seek_time", "play", "pause", "speed", "dance"])
        x = {"elapsed": rng.uniform(-50, 900), "step": rng.uniform(-9, 9), "seek": rng.uniform(-5, 70), "seek_time": rng.choice([rng.uniform(times[0] - 99, times[-1] + 999), float(rng.choice(times)), float("nan")]), "speed": rng.choice([0.0, 0.5, 7.3, None])}.get(kind)
        out.append((kind, x))
    return out


def test_moves(spark, tmp_path):
    rng = random.Random(4)
    series = {"A": sorted(rng.sample(range(1000, 9000), 60)), "B": [100, 100_000, 100_001, 100_002], "C": [7]}
    bars = spark.createDataFrame([(s, t, float(t)) for s, ts in series.items() for t in ts], "symbol string, time long, close double").repartition(3)
    plans = {"one": "A", "two": "A", "three": "B", "four": "C", "five": "none"}
    rows, want = [], {}
    for session, symbol in plans.items():
        times = series.get(symbol, [])
        p = Plain(times)
        for i, (kind, x) in enumerate(commands(session, times or [1, 2])):
            before = p.pos
            p.do(kind, x)
            rows.append((session, symbol, i, kind, x))
            want[session, i] = (before, p.pos, p.on, p.pos >= len(times))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    moves = replay_moves(df, bars)
    got = {(r.session, r.seq): (r.from_position, r.position, r.playing, r.at_end) for r in moves.collect()}
    assert got == want
    news = shown(moves, bars).where("session = 'one'").collect()
    for (session, i), (a, b, *_) in want.items():
        if session == "one":
            assert sorted(r.time for r in news if r.seq == i) == series["A"][a:b]

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        with typed_state(spark):
            q = replay_moves(stream, bars).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None

    for a, b in ((0, 30), (30, 70), (70, 999)):
        df.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if a:
            run()
    assert {(r.session, r.seq): (r.from_position, r.position, r.playing, r.at_end) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
