"""Market tables derived from the relational tables: trades, bars, daily bars, pairs, depth cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import trades_to_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Whole seconds since 1970 of a timestamp without zone; the session's zone plays no part."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def trades(spark: SparkSession, sf_dir: str, by_symbol: bool = True, events: DataFrame | None = None) -> DataFrame:
    """Trades of the table ``events``, or of ``events`` as given: a stream of it, or a part."""
    e = table(spark, sf_dir, "events") if events is None else events
    side = F.when(F.col("event_type").isin("purchase", "click"), "buy").when(F.col("event_type").isin("error", "view"), "sell")
    return e.select(
        (F.concat(F.lit("S"), F.col("user_id") % 5) if by_symbol else F.lit("ALL")).alias("symbol"),
        F.col("event_id").alias("seq"),
        seconds("ts").alias("time"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        side.alias("side"),
    )


def bars(spark: SparkSession, sf_dir: str, step: int = 3600, by_symbol: bool = True) -> DataFrame:
    return trades_to_bars(trades(spark, sf_dir, by_symbol), step)


def daily(spark: SparkSession, sf_dir: str, by_priority: bool = False) -> DataFrame:
    """Daily bars of order prices; ``by_priority``: a symbol for each order priority."""
    o = table(spark, sf_dir, "orders")
    t = o.select(
        (F.col("o_orderpriority") if by_priority else F.lit("ALL")).alias("symbol"),
        F.col("o_orderkey").alias("seq"),
        seconds("cast(o_orderdate as timestamp_ntz)").alias("time"),
        F.col("o_totalprice").cast("double").alias("price"),
        F.lit(None).cast("double").alias("size"),
        F.lit(None).cast("string").alias("side"),
    )
    return trades_to_bars(t, 86_400)


def depth_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts_ms, price, bid, ask, buy, sell): a week by quantity grid of line numbers."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("double")
    pick = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0.0))
    open_ = F.col("l_returnflag") == "N"
    week = F.floor(seconds("cast(l_shipdate as timestamp_ntz)") / 604_800) * 604_800_000
    return li.groupBy(week.alias("ts_ms"), F.col("l_quantity").cast("double").alias("price")).agg(
        (100 * pick(open_ & (F.col("l_linestatus") == "O"))).alias("bid"),
        (100 * pick(open_ & (F.col("l_linestatus") == "F"))).alias("ask"),
        pick(F.col("l_returnflag") == "A").alias("buy"),
        pick(F.col("l_returnflag") == "R").alias("sell"),
    )
