"""Indicators as chains of SQL expressions over bars.

A ``Chain`` adds one expression after another as columns, all in windows over one symbol in time
order. The plain ones are SQL text; the recursive averages are written so that windows can compute
them in linear time: the weight of what lies C values back falls below 1e-17 for a suitable C, so the
value is a weighted sum within a block of C values and one carried number from the block before.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Chain:
    """Columns put on a table of bars, one by one."""

    def __init__(self, df: DataFrame, key: str = "symbol", time: str = "time"):
        self.df, self.key, self.time, self.n = df, key, time, 0

    def put(self, sql: str, name: str | None = None) -> str:
        if name is None:
            self.n += 1
            name = f"x{self.n}_"
        self.df = self.df.withColumn(name, F.expr(sql))
        return name

    # ---- windows as text

    def over(self, frame: str = "", extra: str = "") -> str:
        return f"(PARTITION BY {self.key}{', ' + extra if extra else ''} ORDER BY {self.time}{' ROWS BETWEEN ' + frame if frame else ''})"

    def last(self, n: int, extra: str = "") -> str:
        """The window of the last n rows."""
        return self.over(f"{n - 1} PRECEDING AND CURRENT ROW", extra)

    def so_far(self, extra: str = "") -> str:
        return self.over("UNBOUNDED PRECEDING AND CURRENT ROW", extra)

    # ---- kernels; each returns the name of a column, null until warm

    def lag(self, sql: str, n: int = 1) -> str:
        c = self.put(sql)
        return self.put(f"lag({c}, {n}) OVER {self.over()}")

    def agg(self, function: str, sql: str, n: int) -> str:
        """An aggregate of the last n values that aren't null, on rows whose value isn't null."""
        c = self.put(sql)
        w = self.last(n, f"({c} IS NULL)")
        return self.put(f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER {w} = {n} THEN {function}({c}) OVER {w} END")

    def sma(self, sql: str, n: int) -> str:
        return self.agg("avg", sql, n)

    def recursive(self, sql: str, n: int, k: float) -> str:
        """e += k (x - e) over the values that aren't null, from the mean of the first n of them."""
        c = self.put(sql)
        part = f"({c} IS NULL)"
        r = self.put(f"CASE WHEN {c} IS NOT NULL THEN row_number() OVER {self.over('', part)} END")
        if k >= 1:
            return self.put(f"CASE WHEN {r} >= {n} THEN {c} END")
        q = 1 - k
        size = max(2, math.ceil(-40 / math.log(q)))
        seed = self.put(f"avg({c}) OVER {self.last(n, part)}")
        term = self.put(f"CASE WHEN {r} < {n} THEN 0D WHEN {r} = {n} THEN {seed} ELSE {k!r}D * {c} END")
        pos = self.put(f"({r} - 1) % {size}")
        block = self.put(f"floor(({r} - 1) / {size})")
        within = self.put(f"sum({term} * pow({q!r}D, -{pos})) OVER {self.so_far(f'{part}, {block}')} * pow({q!r}D, {pos})")
        carried = self.put(f"last(CASE WHEN {pos} = {size - 1} THEN {within} END, true) OVER {self.over('UNBOUNDED PRECEDING AND 1 PRECEDING', part)}")
        return self.put(f"CASE WHEN {r} >= {n} THEN {within} + coalesce({carried}, 0D) * pow({q!r}D, {pos} + 1) END")

    def ema(self, sql: str, n: int) -> str:
        return self.recursive(sql, n, 2 / (n + 1))

    def rma(self, sql: str, n: int) -> str:
        return self.recursive(sql, n, 1 / n)

    def true_range(self) -> str:
        before = self.lag("close")
        return self.put(f"CASE WHEN {before} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {before}), abs(low - {before})) END")

    def wma(self, sql: str, n: int) -> str:
        """Weights n for the newest down to 1, from an array of the window's values; streams keep two running sums instead."""
        c = self.put(sql)
        part = f"({c} IS NULL)"
        w = self.last(n, part)
        values = self.put(self.collect(c, w))
        return self.put(f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER {w} = {n} THEN {self.weigh(values)} / {n * (n + 1) / 2!r} END")

    # ---- what differs between engines

    def collect(self, c: str, window: str) -> str:
        return f"array_agg({c}) OVER {window}"

    def weigh(self, values: str) -> str:
        return f"aggregate(transform({values}, (x, i) -> x * (i + 1)), 0D, (a, x) -> a + x)"

    def deviation(self, values: str, mean: str) -> str:
        return f"aggregate({values}, 0D, (a, x) -> a + abs(x - {mean}))"

    def pair(self, a: str, b: str) -> str:
        return f"struct({a}, {b})"


class DuckChain(Chain):
    """The same chains as DuckDB SQL text, with recursive averages as plain folds over lists."""

    def __init__(self, base: str, key: str = "symbol", time: str = "time"):
        self.levels, self.key, self.time, self.n = [f"s0 AS ({base})"], key, time, 0

    def put(self, sql: str, name: str | None = None) -> str:
        self.n += 1
        name = name or f"x{self.n}_"
        k = len(self.levels)
        self.levels.append(f"s{k} AS (SELECT *, {sql} AS {name} FROM s{k - 1})")
        return name

    def sql(self, select: str) -> str:
        return f"WITH {', '.join(self.levels)} SELECT {select} FROM s{len(self.levels) - 1}"

    def recursive(self, sql: str, n: int, k: float) -> str:
        c = self.put(sql)
        part = f"({c} IS NULL)"
        values = self.put(f"list({c}) OVER {self.so_far(part)}")
        first = f"list_avg({values}[1:{n}])"
        return self.put(
            f"CASE WHEN {c} IS NOT NULL AND len({values}) >= {n} THEN list_reduce(list_concat([{first}], {values}[{n + 1}:]), lambda e, x: e + {k!r} * (x - e)) END"
        )

    def collect(self, c: str, window: str) -> str:
        return f"list({c}) OVER {window}"

    def weigh(self, values: str) -> str:
        return f"list_sum(list_transform({values}, lambda x, i: x * i))"

    def deviation(self, values: str, mean: str) -> str:
        return f"list_sum(list_transform({values}, lambda x: abs(x - {mean})))"

    def pair(self, a: str, b: str) -> str:
        return f"row({a}, {b})"
