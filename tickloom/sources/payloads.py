"""Bars from JSON bodies of three dialects, and the active contract of a future.

Bodies come as rows (source, body), read by Spark from wherever they were landed. A body is taken whole or
refused whole; refusals are rows with a cause, so that a job can go on with the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, side_usable

BAR_FIELDS = "time double, open double, high double, low double, close double, volume double, buyVolume double, sellVolume double"
#: Labels of periods in seconds, by dialect.
DESK_PERIODS = {60: "1m", 300: "5m", 900: "15m", 1800: "30m", 3600: "1h", 86_400: "1d"}
TERMINAL_PERIODS = {60: "M1", 300: "M5", 900: "M15", 1800: "M30", 3600: "H1", 14_400: "H4", 86_400: "D1"}
#: A terminal's clock is three hours behind.
TERMINAL_OFFSET = 10_800
#: Daily records closer than this are two of one day.
PAIR_GAP = 12 * 3600
CAUSES = ("DENIED", "UNAVAILABLE", "TRANSPORT", "DECODING", "CANCELLED", "INVALID")


def cause_of_status(status: Column) -> Column:
    """Why a response has no bars, by its HTTP status; null for a good one."""
    return F.when(status.isin(401, 403), "DENIED").when(status.isin(404, 204), "UNAVAILABLE").when((status < 200) | (status >= 300), "TRANSPORT")


def symbol_accepted(symbol: Column) -> Column:
    return symbol.rlike("^[A-Za-z0-9]{1,16}$")


def shared_periods() -> list[int]:
    return [p for p in DESK_PERIODS if p in TERMINAL_PERIODS]


def backfill_window(until: int, period: int, n: int) -> tuple[int, int]:
    """The half-open window of the n bars before a time."""
    return until - n * period, until


def previous_window(window: tuple[int, int]) -> tuple[int, int]:
    return 2 * window[0] - window[1], window[0]


def reached_start(first: int | None, window: tuple[int, int], period: int) -> bool:
    """Whether a window's answer begins so late that nothing older is to be had."""
    return first is None or first >= window[0] + period


def _split(parsed: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(good, F.lit(False))
    return parsed.where(ok), parsed.where(~ok).select("source", F.lit("DECODING").alias("cause"))


def _good_bar(x: Column) -> Column:
    out = F.lit(True)
    for c in ("time", "open", "high", "low", "close"):
        out = out & finite(x[c])
    return out


def _finite_or_null(c: str, name: str) -> Column:
    return F.when(finite(F.col(c)), F.col(c)).alias(name)


def parse_bars(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars of bodies that are arrays of bar objects, and refusals (source, cause). One bad bar refuses its body."""
    parsed = bodies.select("source", F.from_json("body", f"array<struct<{BAR_FIELDS.replace(' ', ':')}>>".replace(",:", ",")).alias("a"))
    good, bad = _split(parsed, F.col("a").isNotNull() & F.forall("a", lambda x: x.isNotNull() & _good_bar(x)))
    b = good.select("source", F.explode("a").alias("b")).select("source", "b.*")
    return b.select("source", F.col("time").cast("long").alias("time"), "open", "high", "low", "close", _finite_or_null("volume", "volume"), _finite_or_null("buyVolume", "buy_volume"), _finite_or_null("sellVolume", "sell_volume")), bad


def _good_bar_columns() -> Column:
    """A time and four finite prices; of the desk's and the terminal's bodies, other rows are skipped alone."""
    out = F.lit(True)
    for c in ("time", "open", "high", "low", "close"):
        out = out & finite(F.col(c))
    return out


def _guard_sides(bars: DataFrame) -> DataFrame:
    ok = side_usable()
    return bars.withColumn("__ok", ok).withColumn("buy_volume", F.when(F.col("__ok"), F.col("buy_volume"))).withColumn("sell_volume", F.when(F.col("__ok"), F.col("sell_volume"))).drop("__ok")


def _rising(bars: DataFrame) -> DataFrame:
    """Rows later than all rows of their source before them (by ``pos``)."""
    before = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return bars.withColumn("__m", F.max("time").over(before)).where("__m is null or time > __m").drop("__m")


def collapse_daily_pairs(bars: DataFrame, prefer_sides: bool = False) -> DataFrame:
    """One of daily records closer than half a day: the later, or the earlier if only that has both sides.

    Each record is held against the last that was kept, so with ``prefer_sides`` an earlier one that stays
    doesn't hand its place on. A source's daily records, some thousands, meet in one row.
    """
    cols = [c for c in bars.columns if c != "source"]
    rows = bars.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("time", *(c for c in cols if c != "time")))).alias("rows"))
    both = lambda x: x["buy_volume"].isNotNull() & x["sell_volume"].isNotNull()

    def fold(kept, x):
        last = F.try_element_at(kept, F.lit(-1))
        near = F.coalesce(x["time"] - last["time"] < PAIR_GAP, F.lit(False))
        stays = F.lit(prefer_sides) & both(last) & ~both(x)
        return F.when(~near, F.concat(kept, F.array(x))).when(stays, kept).otherwise(F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x)))

    kept = F.aggregate("rows", F.filter("rows", lambda x: F.lit(False)), fold)
    return rows.select("source", F.explode(kept).alias("b")).select("source", *(F.col(f"b.{c}").alias(c) for c in cols))


def parse_desk(bodies: DataFrame, period: int, prefer_sides: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bars of ``{"cols": [...], "rows": [[...]]}``, columns found by name; later times only; pairs collapsed for daily bars."""
    parsed = bodies.select("source", F.from_json("body", "struct<cols:array<string>,rows:array<array<double>>>").alias("p")).select("source", "p.cols", "p.rows")
    need = ("bar_epoch", "open", "high", "low", "close")
    fine = F.col("rows").isNotNull() & F.forall("rows", lambda r: r.isNotNull() & (F.size(r) == F.size("cols")))
    for c in need:
        fine = fine & F.array_contains("cols", c)
    good, bad = _split(parsed, fine)
    cell = lambda c: F.when(F.array_position("cols", c) > 0, F.try_element_at("r", F.array_position("cols", c).cast("int")))
    rows = good.select("source", "cols", F.posexplode("rows").alias("pos", "r"))
    b = rows.select("source", "pos", cell("bar_epoch").cast("long").alias("time"), *(cell(c).alias(c) for c in need[1:]), cell("volume").alias("volume"), cell("buy_vol").alias("buy_volume"), cell("sell_vol").alias("sell_volume"))
    # a row without a time or a price is left out, before the times are looked at
    b = _guard_sides(_rising(b.where(_good_bar_columns()))).drop("pos")
    return (collapse_daily_pairs(b, prefer_sides) if period >= 86_400 else b), bad


def parse_terminal(bodies: DataFrame, start: int, end: int, volumes: bool = True) -> tuple[DataFrame, DataFrame]:
    """Bars of arrays of terminal candles in the half-open range [start, end), with times moved to UTC."""
    kind = "array<struct<timestamp:long,open:double,high:double,low:double,close:double,volume:double,buy_volume:double,sell_volume:double>>"
    parsed = bodies.select("source", F.from_json("body", kind).alias("a"))
    good, bad = _split(parsed, F.col("a").isNotNull() & F.forall("a", lambda x: x.isNotNull()))
    b = good.select("source", F.posexplode("a").alias("pos", "b")).select("source", "pos", (F.col("b.timestamp") + TERMINAL_OFFSET).alias("time"), "b.open", "b.high", "b.low", "b.close", *(F.when(F.lit(volumes), F.col(f"b.{c}")).alias(c) for c in ("volume", "buy_volume", "sell_volume")))
    return _guard_sides(_rising(b.where(_good_bar_columns() & (F.col("time") >= start) & (F.col("time") < end)))).drop("pos"), bad


def active_contract(symbols: DataFrame, root: str) -> DataFrame:
    """One row (contract): what the description of a continuous symbol names, else the root if it is listed.

    symbols: (seq, name, description); only symbols continued by liquidity count.
    """
    plain = F.lower(F.translate("description", "áàâãäéêëíïóôõöúüçÁÀÂÃÄÉÊËÍÏÓÔÕÖÚÜÇ", "aaaaaeeeiioooouucAAAAAEEEIIOOOOUUC"))
    named = F.regexp_extract("description", r"\(([A-Z]{3}[A-Z0-9]{1,6})\)", 1)
    hit = F.col("name").isin(*(root + x for x in ("$", "$N", "$D", "@"))) & plain.contains("por liquidez") & (named != "")
    return symbols.agg(F.coalesce(F.min_by(F.when(hit, named), F.when(hit, F.col("seq"))), F.max(F.when(F.col("name") == root, F.col("name")))).alias("contract"))
