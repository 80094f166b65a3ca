"""Queries over the market tables by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import alerts as A
from ..operators import align, analytics, audit, geometry, indicators, orderflow, prices, quality, resample, search, state
from ..operators.series import DuckChain
from ..sources import landed, shared
from ..sources import tables as S
from ..streaming.indicators import stream_indicators, typed_state
from ..streaming.upsert import BarTable
from . import base_sql as Q

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BAR = "symbol, time, open, high, low, close, volume, buy_volume, sell_volume"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, without a negative zero."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def r(sql: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({sql} AS DOUBLE), {digits}) + 0.0 AS {name}"


# ---- bars

VALUES = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("open", "high", "low", "close", "volume", "buy_volume", "sell_volume"))


@query(f"SELECT symbol, time, {VALUES} FROM ({Q.bars()})")
def bars_h1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.bars(spark, d))


@query(f"SELECT symbol, time, {VALUES} FROM ({Q.rollup(14_400, Q.bars())})")
def rollup_h1_h4(spark, d):
    return rounded(resample.rollup(S.bars(spark, d), 3600, 14_400).select(*BAR.split(", ")))


@query(f"SELECT symbol, time, {VALUES} FROM ({Q.rollup(86_400, Q.bars())})")
def rollup_d1(spark, d):
    return rounded(resample.rollup(S.bars(spark, d), 3600, 86_400).select(*BAR.split(", ")))


@query(f"SELECT symbol, time, {VALUES} FROM ({Q.bars(900)})")
def rollup_assoc_check(spark, d):
    """Minutes to five to fifteen: equal to bars of fifteen from the trades."""
    m5 = resample.rollup(S.bars(spark, d, 60), 60, 300)
    return rounded(resample.rollup(m5, 300, 900).select(*BAR.split(", ")))


@query(f"SELECT symbol, CAST(floor(time / 604800) * 604800 AS BIGINT) AS time, {r('sum(volume)', 'volume')}, {r('sum(buy_volume) - sum(sell_volume)', 'delta')} FROM ({Q.bars()}) GROUP BY 1, 2")
def bars_volume_split(spark, d):
    b = resample.rollup(S.bars(spark, d), 3600, resample.TIMEFRAMES["W1"])
    return rounded(b.select("symbol", "time", "volume", (F.col("buy_volume") - F.col("sell_volume")).alias("delta")))


@query(f"SELECT symbol, CAST(make_timestamp((time - 10800) * 1000000) AS DATE) AS day, count(*) AS n, {r('max(high)', 'high')}, {r('min(low)', 'low')} FROM ({Q.bars()}) GROUP BY 1, 2")
def market_day_bars(spark, d):
    """By the civil day in a zone three hours behind UTC."""
    b = S.bars(spark, d).groupBy("symbol", C.market_day(F.col("time")).alias("day"))
    return rounded(b.agg(F.count("*").alias("n"), F.max("high").alias("high"), F.min("low").alias("low")))


@query(f"SELECT symbol, CAST(make_timestamp((time - 10800) * 1000000) AS DATE) AS day, {r('max(high) - min(low)', 'amplitude')}, count(*) AS n FROM ({Q.bars()}) GROUP BY 1, 2")
def daily_amplitude(spark, d):
    return rounded(resample.daily_amplitude(S.bars(spark, d), C.offset_day(F.col("time"))))


# ---- indicators: one query each, from the registry

NAMES = {
    "sma": "sma_20", "wma": "wma_20", "ema": "ema_20", "rma": "rma_14", "dema": "dema_20", "tema": "tema_20", "hma": "hma_16", "vwma": "vwma_20", "lsma": "lsma_25", "trix": "trix_15",
    "rsi": "rsi_14", "stochastic": "stochastic_14_3", "cci": "cci_20", "williams_r": "williams_r_14", "roc": "roc_9", "momentum": "momentum_10", "atr": "atr_14", "stddev": "stddev_20",
    "bollinger": "bollinger_20_2", "keltner": "keltner_20_10_2", "macd": "macd_12_26_9", "adx": "adx_14", "donchian": "donchian_20", "mfi": "mfi_14", "cmf": "cmf_20", "ao": "awesome_osc",
    "aroon": "aroon_25", "chop": "choppiness_14", "bop": "bop_14", "force_index": "force_index_13", "elder_ray": "elder_ray_13",
}


def _indicator(name: str) -> None:
    def run(spark, d):
        return rounded(indicators.indicator(S.bars(spark, d), name))

    chain = DuckChain(Q.bars())
    out = indicators.REGISTRY[name].build(chain, **indicators.settings(name, {}))
    cols = ", ".join(r(sql, f"{name}_{k}") for k, sql in out.items())
    QUERIES[NAMES.get(name, name)] = run
    ORACLE[NAMES.get(name, name)] = chain.sql(f"symbol, time, {cols}")


for _name in [n for n, x in indicators.REGISTRY.items() if not x.steps]:
    _indicator(_name)


def _supertrend_sql() -> str:
    """A row after another, as a recursive query over places."""
    c = DuckChain(Q.bars())
    a = c.rma(c.true_range(), 10)
    base = c.sql(f"symbol, time, high, low, close, {a} AS atr")
    return f"""WITH RECURSIVE f AS MATERIALIZED ({base}), k AS MATERIALIZED (SELECT symbol, time, close, (high + low) / 2 + 3 * atr AS up, (high + low) / 2 - 3 * atr AS down, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k FROM f WHERE atr IS NOT NULL),
 s AS (SELECT symbol, time, k, close, up, down, 1 AS side FROM k WHERE k = 1 UNION ALL
  SELECT k.symbol, k.time, k.k, k.close, CASE WHEN s.close <= s.up THEN least(k.up, s.up) ELSE k.up END, CASE WHEN s.close >= s.down THEN greatest(k.down, s.down) ELSE k.down END, CASE WHEN s.side > 0 AND k.close < s.down THEN -1 WHEN s.side < 0 AND k.close > s.up THEN 1 ELSE s.side END
  FROM s JOIN k ON s.symbol = k.symbol AND k.k = s.k + 1)
 SELECT f.symbol, f.time, {r('CASE WHEN side > 0 THEN down ELSE up END', 'value')}, CAST(side AS DOUBLE) AS direction FROM f LEFT JOIN s ON f.symbol = s.symbol AND f.time = s.time"""


PSAR_SQL = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT symbol, time, high, low, close, row_number() OVER w AS k, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag(close) OVER w AS c1 FROM ({Q.bars()}) WINDOW w AS (PARTITION BY symbol ORDER BY time)),
 s AS (SELECT symbol, k, close >= c1 AS up, CASE WHEN close >= c1 THEN l1 ELSE h1 END AS sar, CASE WHEN close >= c1 THEN greatest(h1, high) ELSE least(l1, low) END AS extreme, 0.02::DOUBLE AS pace FROM b WHERE k = 2 UNION ALL
  SELECT symbol, k, CASE WHEN turn THEN NOT up ELSE up END, CASE WHEN turn THEN extreme ELSE near END, CASE WHEN turn THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(extreme, high) ELSE least(extreme, low) END,
   CASE WHEN turn THEN 0.02 WHEN (up AND high > extreme) OR (NOT up AND low < extreme) THEN least(pace + 0.02, 0.2) ELSE pace END
  FROM (SELECT *, CASE WHEN up THEN low < near ELSE high > near END AS turn FROM (SELECT b.symbol, b.k, b.high, b.low, s.up, s.extreme, s.pace, CASE WHEN s.up THEN least(s.sar + s.pace * (s.extreme - s.sar), b.l1, b.l2) ELSE greatest(s.sar + s.pace * (s.extreme - s.sar), b.h1, b.h2) END AS near
   FROM s JOIN b ON s.symbol = b.symbol AND b.k = s.k + 1)))
 SELECT b.symbol, b.time, {r('sar', 'value')} FROM b LEFT JOIN s ON b.symbol = s.symbol AND b.k = s.k"""

#: A step is a brick, or a bar further where none fits.
RENKO_SQL = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT symbol, time, close, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k, close - lag(close) OVER (PARTITION BY symbol ORDER BY time) AS d FROM ({Q.bars()})), z AS MATERIALIZED (SELECT symbol, 0.5 * avg(abs(d)) AS size FROM b GROUP BY 1 HAVING avg(abs(d)) > 0),
 s AS (SELECT b.symbol, 2::BIGINT AS k, size, close AS level, 0 AS way, NULL::BIGINT AS clock, false AS brick, NULL::DOUBLE AS start FROM b JOIN z ON b.symbol = z.symbol WHERE k = 1 UNION ALL
  SELECT symbol, CASE WHEN fits THEN k ELSE k + 1 END, size, CASE WHEN fits THEN begins + to_ * size ELSE level END, CASE WHEN fits THEN to_ ELSE way END, CASE WHEN fits THEN coalesce(greatest(time, clock + 1), time) ELSE clock END, fits, begins
  FROM (SELECT *, abs(close - level) >= CASE WHEN way NOT IN (0, to_) THEN 2 * size ELSE size END AS fits, CASE WHEN way NOT IN (0, to_) THEN level + to_ * size ELSE level END AS begins
   FROM (SELECT s.symbol, s.k, s.size, s.level, s.way, s.clock, b.time, b.close, CASE WHEN b.close > s.level THEN 1 ELSE -1 END AS to_ FROM s JOIN b ON s.symbol = b.symbol AND s.k = b.k)))
 SELECT symbol, clock AS time, {r('start', 'open')}, {r('greatest(start, level)', 'high')}, {r('least(start, level)', 'low')}, {r('level', 'close')} FROM s WHERE brick"""


@query(_supertrend_sql())
def supertrend_10_3(spark, d):
    return rounded(state.supertrend(S.bars(spark, d)))


@query(PSAR_SQL)
def psar(spark, d):
    return rounded(state.psar(S.bars(spark, d)))


def _kama_sql() -> str:
    c = DuckChain(Q.bars())
    before, back = c.lag("close"), c.lag("close", 10)
    path = c.put(f"sum(abs(close - {before})) OVER {c.last(10)}")
    e = c.put(f"CASE WHEN {back} IS NULL THEN NULL WHEN {path} = 0 THEN 0 ELSE abs(close - {back}) / nullif({path}, 0) END")
    rate = c.put(f"pow({e} * {2 / 3 - 2 / 31!r} + {2 / 31!r}, 2)")
    n = c.put(f"row_number() OVER {c.over()}")
    steps = c.put(f"list(struct_pack(e := close, k := coalesce({rate}, 1.0))) OVER {c.so_far()}")
    return c.sql(f"symbol, time, round(CASE WHEN {n} > 10 THEN (list_reduce({steps}[10:], lambda a, x: struct_pack(e := a.e + x.k * (x.e - a.e), k := x.k))).e END, 6) + 0.0 AS value")


@query(_kama_sql())
def kama_10(spark, d):
    return rounded(state.kama(S.bars(spark, d)))


@query(
    f"""WITH b AS ({Q.bars()}), h AS (SELECT *, (open + high + low + close) / 4 AS ha FROM b),
 l AS (SELECT *, lag(ha) OVER (PARTITION BY symbol ORDER BY time) AS p FROM h),
 s AS (SELECT *, list(CASE WHEN p IS NULL THEN (open + close) / 2 ELSE p END) OVER (PARTITION BY symbol ORDER BY time) AS xs FROM l),
 o AS (SELECT *, list_reduce(xs, lambda e, x: (e + x) / 2) AS op FROM s)
 SELECT symbol, time, {r('op', 'open')}, {r('greatest(high, op, ha)', 'high')}, {r('least(low, op, ha)', 'low')}, {r('ha', 'close')} FROM o"""
)
def heikin_ashi(spark, d):
    return rounded(state.heikin_ashi(S.bars(spark, d)))


@query(RENKO_SQL)
def renko(spark, d):
    return rounded(state.renko(S.bars(spark, d), 0.5))


@query(f"SELECT symbol, {r('avg(abs(close - p))', 'brick')} FROM (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS p FROM ({Q.bars()})) GROUP BY 1")
def brick_size(spark, d):
    return rounded(state.brick_size(S.bars(spark, d)))


@query(
    f"""SELECT symbol, time FROM (SELECT symbol, time, date_trunc('week', make_timestamp(time * 1000000)) AS k, lag(date_trunc('week', make_timestamp(time * 1000000))) OVER (PARTITION BY symbol ORDER BY time) AS p FROM ({Q.bars()}))
 WHERE p IS NOT NULL AND k <> p"""
)
def session_separators(spark, d):
    return analytics.separators(S.bars(spark, d), "week")


@query(f"SELECT symbol, median(s) + 0.0 AS step FROM (SELECT symbol, time - lag(time) OVER (PARTITION BY symbol ORDER BY time) AS s, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM ({Q.bars()})) WHERE s > 0 AND k <= 400 GROUP BY 1")
def median_step(spark, d):
    return analytics.median_step(S.bars(spark, d))


# ---- order flow

AXES = f"c AS ({Q.CELLS}), x AS (SELECT *, dense_rank() OVER (ORDER BY ts_ms) - 1 AS ti, dense_rank() OVER (ORDER BY price) - 1 AS pi FROM c)"


@query(f"WITH {AXES} SELECT min(ts_ms) AS ts_ms, (min(price) + max(price)) / 2 AS price, max(bid) AS bid, max(ask) AS ask, sum(buy) AS buy, sum(sell) AS sell FROM x GROUP BY ti // 4, pi // 5")
def depth_zoom_aggregate(spark, d):
    return orderflow.zoom(S.depth_cells(spark, d), 4, 5).drop("bt", "bp")


def _scale(source: str) -> str:
    return f"SELECT quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.99) AS p99, count(*) AS n, CAST(0.18 AS DOUBLE) AS alpha_min, CAST(0.92 AS DOUBLE) AS alpha_max, CAST(0.5 AS DOUBLE) AS gamma FROM ({source}) WHERE v > 0"


@query(_scale(f"SELECT bid AS v FROM ({Q.CELLS})"))
def color_scale(spark, d):
    return orderflow.color_scale(S.depth_cells(spark, d), "bid")


@query(_scale(f"SELECT unnest([bid, ask]) AS v FROM ({Q.CELLS})"))
def color_scale_pair(spark, d):
    return orderflow.color_scale(S.depth_cells(spark, d), "bid", "ask")


@query(_scale(f"SELECT abs(buy - sell) AS v FROM ({Q.CELLS})"))
def color_scale_delta(spark, d):
    return orderflow.color_scale(S.depth_cells(spark, d).withColumn("delta", F.abs(F.col("buy") - F.col("sell"))), "delta")


@query(
    f"""WITH c AS ({Q.CELLS}), s AS (SELECT quantile_disc(bid, 0.5) AS p50, quantile_disc(bid, 0.99) AS p99 FROM c WHERE bid > 0)
 SELECT ts_ms, price, round(CASE WHEN NOT bid > 0 THEN 0.0 WHEN p99 > p50 THEN 0.18 + 0.74 * pow(least(greatest((bid - p50) / nullif(p99 - p50, 0), 0.0), 1.0), 0.5) WHEN bid >= p99 THEN 0.92 ELSE 0.18 END, 6) + 0.0 AS alpha FROM c, s"""
)
def alpha_of(spark, d):
    cells = S.depth_cells(spark, d)
    scale = orderflow.color_scale(cells, "bid").select("p50", "p99")
    return rounded(cells.join(F.broadcast(scale), F.lit(True)).select("ts_ms", "price", orderflow.alpha_of(F.col("bid"), F.col("p50"), F.col("p99")).alias("alpha")))


@query(_scale(f"SELECT bid + ask AS v FROM ({Q.CELLS})"))
def color_scale_sum(spark, d):
    return orderflow.color_scale(S.depth_cells(spark, d), F.col("bid") + F.col("ask"))


@query(f"SELECT coalesce(quantile_disc(v, 0.9), 0) AS value FROM (SELECT unnest([bid, ask]) AS v FROM ({Q.CELLS})) WHERE v > 0")
def positive_quantile(spark, d):
    return orderflow.positive_quantile(S.depth_cells(spark, d), 0.9, "bid", "ask")


PRINT = f"""c AS ({Q.CELLS}), m AS (SELECT DISTINCT CAST(floor(ts_ms / 1000 / 2592000) * 2592000 AS BIGINT) AS candle FROM c),
 d AS (SELECT CAST(floor(ts_ms / 1000) AS BIGINT) AS time, floor(price / 5) * 5 AS price, buy, sell FROM c WHERE buy > 0 OR sell > 0),
 j AS (SELECT candle, price, buy, sell FROM d ASOF JOIN m ON d.time >= m.candle),
 l AS (SELECT candle, price, sum(buy) AS buy, sum(sell) AS sell, sum(buy) + sum(sell) AS total, sum(buy) - sum(sell) AS delta FROM j GROUP BY 1, 2),
 w AS (SELECT *, sum(buy) OVER p AS candle_buy, sum(sell) OVER p AS candle_sell, max(total) OVER p AS max_total, first_value(price) OVER (PARTITION BY candle ORDER BY total DESC, price) AS poc FROM l WINDOW p AS (PARTITION BY candle)),
 f AS (SELECT * FROM w WHERE total >= 0.02 * max_total QUALIFY row_number() OVER (PARTITION BY candle ORDER BY total DESC, price) <= 40)"""


def _footprint(spark, d):
    cells = S.depth_cells(spark, d)
    candles = cells.select(resample.bucket(F.floor(F.col("ts_ms") / 1000), 2_592_000).alias("time")).distinct()
    return orderflow.footprint(cells, candles, 5.0)


@query(f"WITH {PRINT} SELECT candle, price + 0.0 AS price, buy, sell, total, delta, candle_buy, candle_sell, max_total, poc + 0.0 AS poc, round(delta / nullif(total, 0), 6) + 0.0 AS imbalance FROM f")
def footprint_levels(spark, d):
    return rounded(_footprint(spark, d))


@query(f"WITH {PRINT} SELECT candle, any_value(candle_buy) AS buy, any_value(candle_sell) AS sell, any_value(poc) + 0.0 AS poc, count(*) AS levels FROM f GROUP BY 1")
def footprint_candles(spark, d):
    return _footprint(spark, d).groupBy("candle").agg(F.first("candle_buy").alias("buy"), F.first("candle_sell").alias("sell"), (F.first("poc") + 0.0).alias("poc"), F.count("*").alias("levels"))


@query(
    f"""WITH {PRINT}, k AS (SELECT candle, any_value(candle_buy) AS buy, any_value(candle_sell) AS sell, count(*) AS levels FROM f GROUP BY 1),
 t AS (SELECT count(*) AS candles, CAST(coalesce(sum(levels), 0) AS BIGINT) AS levels, coalesce(sum(buy), 0) AS buy, coalesce(sum(sell), 0) AS sell FROM k)
 SELECT candles, levels, buy, sell, buy - sell AS delta, CASE WHEN buy > sell THEN 'buyer' WHEN buy < sell THEN 'seller' ELSE 'even' END AS side FROM t"""
)
def footprint_totals(spark, d):
    return orderflow.footprint_totals(_footprint(spark, d))


@query(
    f"""WITH {PRINT}, g AS (SELECT candle, price, buy, lag(sell) OVER (PARTITION BY candle ORDER BY price) AS s FROM f)
 SELECT candle, price + 0.0 AS price, buy > 0 AND buy >= 1.5 * s AS buy_side, s > 0 AND s >= 1.5 * buy AS sell_side FROM g WHERE s IS NOT NULL AND ((buy > 0 AND buy >= 1.5 * s) OR (s > 0 AND s >= 1.5 * buy))"""
)
def diagonal_imbalance(spark, d):
    return orderflow.diagonal_imbalance(_footprint(spark, d), 1.5).withColumn("price", F.col("price") + 0.0)


PROFILE = f"p AS (SELECT price, sum(buy) AS buy, sum(sell) AS sell, sum(buy) + sum(sell) AS total, sum(buy) - sum(sell) AS delta FROM ({Q.CELLS}) GROUP BY 1 HAVING sum(buy) + sum(sell) > 0)"


@query(f"WITH {PROFILE} SELECT * FROM p")
def volume_profile(spark, d):
    return orderflow.volume_profile(S.depth_cells(spark, d))


SPAN_MS = (760_000_000_000, 860_000_000_000)


@query(f"SELECT price, sum(buy) AS buy, sum(sell) AS sell, sum(buy) + sum(sell) AS total, sum(buy) - sum(sell) AS delta FROM ({Q.CELLS}) WHERE ts_ms BETWEEN {SPAN_MS[0]} AND {SPAN_MS[1]} GROUP BY 1 HAVING sum(buy) + sum(sell) > 0")
def volume_profile_window(spark, d):
    return orderflow.volume_profile(S.depth_cells(spark, d), window=SPAN_MS)


@query(f"WITH {PROFILE} SELECT count(*) AS levels, sum(total) AS total, max(total) AS largest, first(price ORDER BY total DESC, price) AS poc, CAST(NULL AS VARCHAR) AS reason FROM p")
def profile_summary(spark, d):
    return orderflow.profile_summary(orderflow.volume_profile(S.depth_cells(spark, d)))


@query(
    f"""WITH {PROFILE}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM p)
 SELECT round(lo + (least(floor((price - lo) / ((hi - lo) / 20)), 19) + 0.5) * ((hi - lo) / 20), 6) + 0.0 AS price, sum(buy) AS buy, sum(sell) AS sell, sum(total) AS total, sum(delta) AS delta FROM p, e GROUP BY 1"""
)
def volume_profile_binned(spark, d):
    return rounded(orderflow.binned(orderflow.volume_profile(S.depth_cells(spark, d)), 20))


@query(
    f"""WITH RECURSIVE {PROFILE}, q AS (SELECT price, total, row_number() OVER (ORDER BY price) AS k FROM p), z AS (SELECT first(k ORDER BY total DESC, price) AS k0, sum(total) AS whole, max(k) AS n FROM q),
 g(lo, hi, got) AS (SELECT k0, k0, (SELECT total FROM q WHERE k = k0) FROM z UNION ALL
  SELECT CASE WHEN u IS NULL OR dn > u THEN lo - 1 ELSE lo END, CASE WHEN u IS NULL OR dn > u THEN hi ELSE hi + 1 END, got + CASE WHEN u IS NULL OR dn > u THEN dn ELSE u END
  FROM (SELECT g.lo, g.hi, g.got, (SELECT total FROM q WHERE k = g.hi + 1) AS u, (SELECT total FROM q WHERE k = g.lo - 1) AS dn, z.whole FROM g, z) WHERE got < 0.7 * whole AND (u IS NOT NULL OR dn IS NOT NULL))
 SELECT (SELECT price FROM q, z WHERE k = k0) AS poc, (SELECT price FROM q WHERE k = lo) AS val, (SELECT price FROM q WHERE k = hi) AS vah, got AS volume FROM g ORDER BY got DESC LIMIT 1"""
)
def value_area(spark, d):
    return orderflow.value_area(orderflow.volume_profile(S.depth_cells(spark, d)))


@query(
    f"""WITH {AXES}, s AS (SELECT price, ti, 'BID' AS side, bid AS q FROM x UNION ALL SELECT price, ti, 'ASK', ask FROM x), lim AS (SELECT greatest(quantile_disc(q, 0.9), 100) AS lim FROM s WHERE q > 0),
 i AS (SELECT *, ti - row_number() OVER (PARTITION BY price, side ORDER BY ti) AS isl FROM s WHERE q > 0), ru AS (SELECT price, side, count(*) AS n, max(q) AS q FROM i GROUP BY price, side, isl),
 f AS (SELECT price, side, max(q) AS quantity FROM ru WHERE n >= 3 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY price, side ORDER BY ti DESC) AS k FROM s),
 t AS (SELECT price, side, avg(q) FILTER (k <= 5) AS late, avg(q) FILTER (k > 5 AND k <= 10) AS early, count(*) AS n FROM b GROUP BY 1, 2),
 o AS (SELECT f.price, f.side, quantity, abs(f.price - 25.5) AS distance, f.price > 25.5 AS above, CASE WHEN n < 10 THEN 0.0 WHEN early > 0 THEN 100 * (late - early) / early WHEN late > 0 THEN 1000.0 ELSE 0.0 END AS change FROM f JOIN t ON f.price = t.price AND f.side = t.side, lim WHERE quantity >= lim)
 SELECT price, side, quantity, distance, above, round(change, 6) + 0.0 AS change, CASE WHEN change > 15 THEN 'GROWING' WHEN change < -15 THEN 'WITHDRAWING' ELSE 'STABLE' END AS trend FROM o
 QUALIFY row_number() OVER (PARTITION BY above ORDER BY distance, quantity DESC, side DESC) <= 4"""
)
def liquidity_walls(spark, d):
    return rounded(orderflow.walls(S.depth_cells(spark, d), 25.5))


@query(f"WITH c AS ({Q.CELLS}), l AS (SELECT * FROM c WHERE bid > 0 OR ask > 0) SELECT price, sum(bid) AS bid, sum(ask) AS ask FROM l WHERE ts_ms = (SELECT max(ts_ms) FROM l) GROUP BY 1")
def book_ladder(spark, d):
    return orderflow.ladder(S.depth_cells(spark, d))


def _days(spark, d):
    c = S.depth_cells(spark, d)
    year = F.year(F.timestamp_millis("ts_ms"))
    queued, done = (F.col("bid") > 0) | (F.col("ask") > 0), (F.col("buy") > 0) | (F.col("sell") > 0)
    pick = lambda f, cond: f(F.when(cond, F.col("ts_ms")))
    return c.groupBy(year.alias("year")).agg(pick(F.min, queued).alias("queue_from"), pick(F.max, queued).alias("queue_to"), pick(F.min, done).alias("exec_from"), pick(F.max, done).alias("exec_to"))


@query(
    f"""WITH c AS ({Q.CELLS}), y AS (SELECT CAST(year(make_timestamp(ts_ms * 1000)) AS INTEGER) AS year, min(ts_ms) FILTER (bid > 0 OR ask > 0) AS q0, max(ts_ms) FILTER (bid > 0 OR ask > 0) AS q1, min(ts_ms) FILTER (buy > 0 OR sell > 0) AS e0, max(ts_ms) FILTER (buy > 0 OR sell > 0) AS e1 FROM c GROUP BY 1)
 SELECT year, CASE WHEN q0 IS NULL AND e0 IS NULL THEN 'EMPTY' WHEN e0 IS NULL THEN 'QUEUE_ONLY' WHEN e0 > q0 + 604800000 OR e1 < q1 - 604800000 THEN 'PARTIAL' ELSE 'COMPLETE' END AS class,
 CAST(CASE WHEN e0 IS NULL AND q0 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN e0 - q0 >= 604800000 THEN 1 ELSE 0 END + CASE WHEN q1 - e1 >= 604800000 THEN 1 ELSE 0 END AS INTEGER) AS gaps FROM y"""
)
def coverage_view(spark, d):
    return orderflow.coverage_view(_days(spark, d), 604_800_000).select("year", "class", F.size("hatched").alias("gaps"))


@query(f"WITH c AS ({Q.CELLS}), l AS (SELECT *, CAST(year(make_timestamp(ts_ms * 1000)) AS INTEGER) AS grid FROM c WHERE bid <> 0 OR ask <> 0 OR buy <> 0 OR sell <> 0) SELECT grid, count(DISTINCT ts_ms) AS times, count(DISTINCT price) AS prices, count(*) AS cells, sum(bid) AS bid FROM l GROUP BY 1")
def columnar_encode(spark, d):
    grids = orderflow.encode_columnar(S.depth_cells(spark, d).withColumn("grid", F.year(F.timestamp_millis("ts_ms"))))
    total = F.aggregate("columns.b", F.lit(0.0), lambda a, x: a + x)
    n = lambda c: F.size(c).cast("long")
    return grids.select("grid", n("axes.t").alias("times"), n("axes.p").alias("prices"), n("columns.ti").alias("cells"), total.alias("bid"))


@query(f"SELECT CAST(year(make_timestamp(ts_ms * 1000)) AS INTEGER) AS grid, ts_ms, price, bid, ask, buy, sell FROM ({Q.CELLS}) WHERE bid <> 0 OR ask <> 0 OR buy <> 0 OR sell <> 0")
def columnar_decode_roundtrip(spark, d):
    return orderflow.decode_columnar(orderflow.encode_columnar(S.depth_cells(spark, d).withColumn("grid", F.year(F.timestamp_millis("ts_ms")))))


@query(f"WITH v AS (SELECT volume AS v FROM ({Q.bars()}) WHERE volume > 0), t AS (SELECT quantile_disc(v, 0.95) AS ceiling, count(*) AS n FROM v) SELECT ceiling, n, count(*) FILTER (v > ceiling) AS over FROM v, t GROUP BY 1, 2")
def histogram_ceiling(spark, d):
    return orderflow.histogram_limit(S.bars(spark, d), "volume", 95.0)


@query(f"SELECT symbol, {r('min(low) - 0.05 * (max(high) - min(low))', 'lo')}, {r('max(high) + 0.05 * (max(high) - min(low))', 'hi')} FROM ({Q.bars()}) WHERE time BETWEEN 1704500000 AND 1705500000 GROUP BY 1")
def autoscale(spark, d):
    return rounded(analytics.autoscale(S.bars(spark, d), 1_704_500_000, 1_705_500_000))


# ---- alignment and analytics


def _pair(spark, d):
    b = S.daily(spark, d, by_priority=True)
    return b.where("symbol = '1-URGENT'"), b.where("symbol = '2-HIGH'")


PAIR = f"b AS ({Q.daily(True)}), j AS (SELECT a.time, a.close AS a, c.close AS b FROM b a JOIN b c ON a.time = c.time WHERE a.symbol = '1-URGENT' AND c.symbol = '2-HIGH')"


@query(f"WITH {PAIR} SELECT * FROM j")
def align_on_time(spark, d):
    return align.align(*_pair(spark, d))


@query(f"WITH t AS ({Q.trades()}), b AS ({Q.bars()}) SELECT t.symbol, t.seq, t.time, b.open AS asof_open, b.time AS asof_time FROM t ASOF LEFT JOIN b ON t.symbol = b.symbol AND t.time >= b.time")
def asof_backward(spark, d):
    return align.asof_backward(S.trades(spark, d).select("symbol", "seq", "time"), S.bars(spark, d), "open")


PLACES = f"""b AS (SELECT symbol, time + 3600 AS time FROM ({Q.bars()})), n AS (SELECT symbol, time, row_number() OVER w - 1 AS n, lag(time) OVER w AS before, lead(time) OVER w AS after FROM b WINDOW w AS (PARTITION BY symbol ORDER BY time))"""


def _bar_ends(spark, d):
    return S.bars(spark, d).select("symbol", (F.col("time") + 3600).alias("time"))


@query(
    f"""WITH t AS ({Q.trades()}), {PLACES}, x AS (SELECT t.symbol, t.seq, t.time, n.n, n.time AS mark, n.before, n.after FROM t ASOF LEFT JOIN n ON t.symbol = n.symbol AND t.time >= n.time), z AS (SELECT symbol, time AS t0, after AS t1 FROM n WHERE n = 0)
 SELECT x.symbol, seq, time, {r('CASE WHEN n IS NULL THEN coalesce((time - t0) / (t1 - t0), 0) ELSE n + coalesce((time - mark) / coalesce(after - mark, mark - before), 0) END', 'place')} FROM x JOIN z ON x.symbol = z.symbol"""
)
def time_to_index(spark, d):
    return rounded(align.time_to_index(S.trades(spark, d).select("symbol", "seq", "time"), _bar_ends(spark, d)))


@query(
    f"""WITH {PLACES}, p AS (SELECT symbol, n, n * 1.25 - 2 AS place, max(n) OVER (PARTITION BY symbol) AS last FROM n), q AS (SELECT *, greatest(least(CAST(floor(place) AS BIGINT), last - 1), 0) AS base FROM p)
 SELECT q.symbol, {r('place', 'place')}, {r('m.time + coalesce((place - base) * (m.after - m.time), 0)', 'place_time')} FROM q JOIN n m ON q.symbol = m.symbol AND q.base = m.n"""
)
def index_to_time(spark, d):
    bars = _bar_ends(spark, d)
    places = bars.select("symbol", ((F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1) * 1.25 - 2).cast("double").alias("place"))
    return rounded(align.index_to_time(places, bars))


@query(
    f"""WITH t AS (SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day FROM orders)
 SELECT day, true AS valid, strftime(CAST(day AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') AS before, strftime(CAST(day AS DATE), '%d/%m/%Y') AS label FROM t"""
)
def market_days(spark, d):
    days = spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    day = F.col("day")
    return days.select("day", C.valid_day(day).alias("valid"), C.shift_day(day, -1).alias("before"), C.day_label(day).alias("label"))


@query(
    f"""WITH t AS ({Q.trades()}), b AS ({Q.bars()}), x AS (SELECT t.symbol, t.seq, t.time, p.open AS po, p.time AS pt FROM t ASOF LEFT JOIN b p ON t.symbol = p.symbol AND t.time >= p.time),
 y AS (SELECT x.*, n.open AS no, n.time AS nt FROM x ASOF LEFT JOIN b n ON x.symbol = n.symbol AND x.time < n.time)
 SELECT symbol, seq, time, CASE WHEN nt IS NULL OR (pt IS NOT NULL AND time - pt <= nt - time) THEN po ELSE no END AS near_open, CASE WHEN nt IS NULL OR (pt IS NOT NULL AND time - pt <= nt - time) THEN pt ELSE nt END AS near_time FROM y"""
)
def asof_nearest(spark, d):
    return align.asof_nearest(S.trades(spark, d).select("symbol", "seq", "time"), S.bars(spark, d), "open")


@query(
    f"""WITH {PAIR}, l AS (SELECT *, lag(a) OVER (ORDER BY time) AS pa, lag(b) OVER (ORDER BY time) AS pb FROM j)
 SELECT count(*) AS n, {r('corr(a / pa - 1, b / pb - 1)', 'r')} FROM l WHERE pa <> 0 AND pb <> 0"""
)
def returns_correlation(spark, d):
    return rounded(analytics.returns_correlation(*_pair(spark, d)))


@query(f"SELECT symbol, time, {r('100 * close / first_value(close) OVER (PARTITION BY symbol ORDER BY time)', 'value')} FROM ({Q.bars()})")
def base100(spark, d):
    return rounded(analytics.base100(S.bars(spark, d)))


@query(
    f"""WITH b AS ({Q.daily(True)}), l AS (SELECT symbol, max(time) AS te, arg_max(close, time) AS now, min(time) AS ts FROM b GROUP BY 1),
 y AS (SELECT *, CAST(epoch(date_trunc('year', make_timestamp(te * 1000000))) AS BIGINT) AS y0 FROM l),
 w AS (SELECT symbol, te, now, ts, unnest(['7d', '30d', '91d', '182d', '365d', 'ytd']) AS win, unnest([te - 7 * 86400, te - 30 * 86400, te - 91 * 86400, te - 182 * 86400, te - 365 * 86400, y0]) AS lim FROM y),
 s AS (SELECT w.*, coalesce(max(b.time) FILTER (b.time <= lim), min(b.time)) AS st FROM w JOIN b ON w.symbol = b.symbol GROUP BY ALL)
 SELECT s.symbol, win AS "window", st AS start, round(CASE WHEN ts <= lim + greatest(3.0 * 86400, 0.03 * (te - lim)) AND st < te AND abs(st - lim) <= te - lim AND b.close <> 0 THEN 100 * (now / b.close - 1) END, 6) + 0.0 AS change FROM s JOIN b ON b.symbol = s.symbol AND b.time = st"""
)
def performance_windows(spark, d):
    return rounded(analytics.performance(S.daily(spark, d, True)))


@query(
    f"""WITH b AS (SELECT *, CAST(year(make_timestamp(time * 1000000)) AS INTEGER) AS year, CAST(dayofyear(make_timestamp(time * 1000000)) AS INTEGER) AS day FROM ({Q.daily()})),
 p AS (SELECT symbol, year, arg_min(close, time) AS f, count(*) AS n, count(DISTINCT day) AS covered FROM b GROUP BY 1, 2 HAVING count(*) >= 2),
 k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY year DESC) <= 3)
 SELECT b.symbol, b.year, b.day, b.time, round(100 * (close / f - 1), 6) + 0.0 AS change, covered FROM b JOIN k ON b.symbol = k.symbol AND b.year = k.year"""
)
def seasonality(spark, d):
    return rounded(analytics.seasonality(S.daily(spark, d)))


@query(
    f"""WITH b AS ({Q.bars()}), s AS (SELECT symbol, time, close, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS m, CASE WHEN count(*) OVER k = 14 THEN (CASE WHEN max(high) OVER k - min(low) OVER k <= 0 THEN 50 ELSE 100 * (close - min(low) OVER k) / (max(high) OVER k - min(low) OVER k) END) END AS o FROM b
 WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS 19 PRECEDING), k AS (PARTITION BY symbol ORDER BY time ROWS 13 PRECEDING)),
 v AS (SELECT symbol, time, CASE WHEN o <= 30 THEN 1 WHEN o >= 70 THEN -1 WHEN o IS NOT NULL THEN 0 END AS vo, CASE WHEN close > m * 1.001 THEN 1 WHEN close < m * 0.999 THEN -1 WHEN m IS NOT NULL THEN 0 END AS va FROM s),
 z AS (SELECT *, (coalesce(vo, 0) + coalesce(va, 0)) / nullif(CAST((vo IS NOT NULL)::INT + (va IS NOT NULL)::INT AS DOUBLE), 0) AS score FROM v)
 SELECT symbol, time, round(score, 6) + 0.0 AS score, CASE WHEN score IS NULL THEN 'none' WHEN score >= 0.5 THEN 'strong buy' WHEN score >= 0.15 THEN 'buy' WHEN score <= -0.5 THEN 'strong sell' WHEN score <= -0.15 THEN 'sell' ELSE 'neutral' END AS label FROM z"""
)
def technical_consensus(spark, d):
    m = indicators.indicators(S.bars(spark, d), {"stochastic": {}, "sma": {}}, "close")
    v = m.select("symbol", "time", analytics.vote_oscillator(F.col("stochastic_k")).alias("vo"), analytics.vote_average(F.col("close"), F.col("sma_value")).alias("va"))
    return rounded(analytics.consensus(v, ["vo", "va"]).select("symbol", "time", "score", "label"))


CUT = 1_705_500_000


def _two(spark, d, factor: float):
    b = S.bars(spark, d, by_symbol=False).select("time", "open", "high", "low", "close", "volume")
    return b.where(F.col("time") < CUT), b.where(F.col("time") >= CUT - 5 * 3600).withColumn("close", F.col("close") * factor)


TWO = f"b AS ({Q.bars(3600, False)}), h AS (SELECT * FROM b WHERE time < {CUT}), v AS (SELECT time, open, high, low, close * 1.0005 AS close, volume FROM b WHERE time >= {CUT} - 18000)"


@query(
    f"""WITH {TWO}, z AS (SELECT max(time) AS m FROM h) SELECT coalesce(v.time, h.time) AS time, round(coalesce(v.open, h.open), 6) AS open, round(coalesce(v.high, h.high), 6) AS high, round(coalesce(v.low, h.low), 6) AS low, round(coalesce(v.close, h.close), 6) AS close,
 round(coalesce(v.volume, h.volume), 6) AS volume, CASE WHEN v.time IS NOT NULL THEN 'live' ELSE 'archive' END AS origin, h.time IS NOT NULL AND vv.time IS NOT NULL AS overlap
 FROM h FULL JOIN (SELECT v.* FROM v, z WHERE v.time >= m) v ON h.time = v.time LEFT JOIN v vv ON vv.time = coalesce(v.time, h.time)"""
)
def splice_series(spark, d):
    return rounded(align.splice(*_two(spark, d, 1.0005), 3600, diverging="archive"))


@query(f"WITH {TWO} SELECT time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, 'archive' AS origin, false AS overlap FROM h")
def splice_incoherent(spark, d):
    return rounded(align.splice(*_two(spark, d, 1.01), 3600, diverging="archive"))


@query(
    f"""WITH {TWO}, z AS (SELECT max(time) AS m FROM h), s AS (SELECT min(time) AS seam FROM v, z WHERE time >= m), p AS (SELECT max(h.time) AS t FROM h, s WHERE h.time < seam)
 SELECT seam, (SELECT count(*) FROM h) AS from_archive, (SELECT count(*) FROM v WHERE time > m) AS from_live, (SELECT count(*) FROM v WHERE time = m) AS overlapping, (SELECT count(*) FROM v WHERE time < m) AS dropped_by_cut, 0 AS off_grid,
 CASE WHEN seam - t > 3600 THEN t + 3600 END AS gap_from, CASE WHEN seam - t > 3600 THEN seam END AS gap_to, (SELECT max(time) FROM v) AS forming, true AS coherent FROM s, p, z"""
)
def splice_report(spark, d):
    return align.splice_report(*_two(spark, d, 1.0005), 3600, diverging="archive")


@query(
    f"""WITH {TWO}, j AS (SELECT h.close AS hc, v.close AS lc, CASE WHEN h.volume > 0 AND v.volume > 0 THEN v.volume / h.volume END AS q FROM h JOIN v ON h.time = v.time)
 SELECT count(*) AS n, {r('avg(abs(lc - hc))', 'gap')}, {r('avg(abs(lc - hc)) / avg(abs(hc))', 'relative_gap')}, {r('list_sort(list(q) FILTER (q IS NOT NULL))[count(q) // 2 + 1]', 'median_ratio')}, true AS coherent FROM j"""
)
def splice_coherence(spark, d):
    return rounded(align.coherence(*_two(spark, d, 1.0005), 3600))


OPEN = "(((d + 4) % 7) BETWEEN 1 AND 5 AND time - 10800 < d * 86400 + 64800 AND time - 10800 + 3600 > d * 86400 + 32400)"
INSIDE = f"s AS (SELECT *, {OPEN.replace('d ', 'd0 ').replace('(d0 ', '(d0 ')} OR {OPEN.replace('d ', 'd1 ')} AS inside FROM (SELECT *, CAST(floor((time - 10800) / 86400) AS BIGINT) AS d0, CAST(floor((time - 10800 + 3599) / 86400) AS BIGINT) AS d1 FROM ({Q.bars()})))"


#: A bar is kept if it meets a whole day that has a session.
TRADING_DAY = f"s AS (SELECT * FROM ({Q.bars()}) WHERE (CAST(floor((time - 10800) / 86400) AS BIGINT) + 4) % 7 BETWEEN 1 AND 5 OR (CAST(floor((time - 10800 + 3599) / 86400) AS BIGINT) + 4) % 7 BETWEEN 1 AND 5)"


@query(f"WITH {TRADING_DAY} SELECT symbol, time, {r('close', 'close')} FROM s")
def session_filter(spark, d):
    kept, _ = analytics.split_by_session(S.bars(spark, d), 3600, analytics.WEEKDAYS, whole_days=True)
    return rounded(kept.select("symbol", "time", "close"))


#: From when on hourly bars are known to be incomplete, and where the source was vetted, for the queries.
DEGRADED, VETTED = 1_706_000_000, (1_704_200_000, 1_706_500_000)
LEVEL_OF = "CASE WHEN {fail} THEN 'FAILED' WHEN {care} THEN 'CAUTION' ELSE 'OK' END"


def _quality_sql(fail: str, care: str, where: str = "true") -> str:
    share = "count(*) FILTER (buy_volume IS NOT NULL AND sell_volume IS NOT NULL) / count(*)"
    return f"""WITH {INSIDE}, q AS (SELECT symbol, count(*) AS n, count(*) FILTER (time < {VETTED[0]} OR time > {VETTED[1]}) AS unvetted, {share} AS ss, count(*) FILTER (NOT inside) AS outside, max(time) AS last FROM s WHERE {where} GROUP BY 1)
 SELECT symbol, n, unvetted, outside, {r('ss', 'side_share')}, {LEVEL_OF.format(fail=fail, care=care)} AS verdict FROM q"""


def _quality(spark, d, profile: quality.Profile, bars: DataFrame | None = None) -> DataFrame:
    q = quality.report(S.bars(spark, d) if bars is None else bars, 3600, profile)
    return rounded(q.select("symbol", "n", "unvetted", "outside", "side_share", "verdict"))


@query(_quality_sql("outside / n >= 0.05", "unvetted > 0 OR ss < 0.9 OR outside / n > 0.02"))
def quality_report(spark, d):
    """Vetted window, least share of sides, tolerance of bars outside sessions."""
    return _quality(spark, d, quality.Profile(sessions=analytics.WEEKDAYS, least_sides=0.9, tolerated_outside=0.02, vetted=VETTED))


@query(_quality_sql(f"last >= {DEGRADED}", "unvetted > 0", "symbol <> 'S1' OR time < 1705900000"))
def quality_degraded(spark, d):
    """Hourly bars that go on past the time from which they are incomplete fail, whatever else; one symbol ends before. No sessions are declared."""
    b = S.bars(spark, d).where((F.col("symbol") != "S1") | (F.col("time") < 1_705_900_000))
    q = quality.report(b, 3600, quality.Profile(incomplete_from=DEGRADED, vetted=VETTED))
    inside = analytics.touches_session(F.col("time"), 3600, analytics.WEEKDAYS)
    outside = b.groupBy("symbol").agg(F.count_if(~inside).alias("outside"))
    return rounded(q.drop("outside").join(outside, "symbol").select("symbol", "n", "unvetted", "outside", "side_share", "verdict"))


@query(_quality_sql("false", "true"))
def quality_by_period(spark, d):
    """A rule for the period: caution, and a vetted window that comes before the profile's."""
    rule = quality.PeriodRule(3600, "CAUTION", "hours are checked by hand", VETTED)
    return _quality(spark, d, quality.Profile(sessions=analytics.WEEKDAYS, tolerated_outside=1.0, vetted=(0, 1), rules=(rule, quality.PeriodRule(60, "FAILED"))))


@query(
    f"""WITH o AS (SELECT CAST(floor((time - 10800) / 86400) AS BIGINT) AS day, sum(volume) AS own FROM ({Q.bars(3600, False)}) GROUP BY 1), f AS (SELECT CAST(floor((time - 10800) / 86400) AS BIGINT) AS day, sum(size) + sum(seq) % 5000 AS official FROM ({Q.trades(False)}) GROUP BY 1),
 s AS (SELECT own / official AS sh FROM o JOIN f ON o.day = f.day WHERE official > 0) SELECT count(*) AS days, {r('median(sh)', 'median_share')}, {r('min(sh)', 'worst_share')}, count(*) FILTER (sh < 0.9) AS low_days FROM s"""
)
def volume_coverage(spark, d):
    t = S.trades(spark, d, False).groupBy(C.offset_day(F.col("time")).alias("day")).agg((F.sum("size") + F.sum("seq") % 5000).alias("volume"))
    return rounded(analytics.volume_coverage(S.bars(spark, d, by_symbol=False), t))


@query(
    f"""WITH b AS ({Q.bars()}), t AS (SELECT count(*) AS total, count(*) FILTER (high < greatest(open, close, low)) AS a, count(*) FILTER (low > least(open, close, high)) AS e, count(*) FILTER (time % 3600 <> 0) AS g, 0 AS u, count(*) FILTER (volume < 0) AS n,
 count(*) FILTER (coalesce(buy_volume, 0) + coalesce(sell_volume, 0) > volume * (1 + 1e-9)) AS s FROM b) SELECT unnest(['high_below', 'low_above', 'off_grid', 'repeated', 'negative_volume', 'sides_over_volume']) AS "check", unnest([a, e, g, u, n, s]) AS failed, total FROM t"""
)
def ohlc_audit(spark, d):
    return analytics.ohlc_audit(S.bars(spark, d), 3600)


OFFICIAL = f"""b AS ({Q.daily(True)}), c AS (SELECT symbol, time, close, strftime(make_timestamp(time * 1000000), '%Y-%m-%d') AS day FROM b),
 o AS (SELECT symbol, day, close * CASE WHEN symbol = '1-URGENT' THEN 1 WHEN symbol = '2-HIGH' AND time % 864000 = 0 THEN 1.0005 WHEN time % 864000 = 0 THEN 1.01 ELSE 1 END AS official FROM c WHERE time < 880000000 AND symbol <> '5-LOW')"""


@query(
    f"""WITH {OFFICIAL}, e AS (SELECT c.symbol, c.time, abs(c.close - official) / nullif(official, 0) AS error FROM c LEFT JOIN o ON c.symbol = o.symbol AND c.day = o.day)
 SELECT symbol, 'settlement' AS "check", CASE WHEN count(error) = 0 THEN 'WARN' WHEN count(*) FILTER (error < 1e-9) = count(error) THEN 'OK' WHEN max(error) <= 0.001 THEN 'WARN' ELSE 'FAIL' END AS status, count(error) AS n, {r('max(error)', 'value')},
 coalesce(array_to_string(list_sort(list(time) FILTER (error > 0.001))[1:3], ','), '') AS examples FROM e GROUP BY 1"""
)
def settlement_audit(spark, d):
    """Daily closes against official ones that are equal, a little off, far off or absent, by symbol."""
    b = S.daily(spark, d, True)
    symbol, tenth = F.col("symbol"), F.col("time") % 864_000 == 0
    factor = F.when(symbol == "1-URGENT", 1.0).when((symbol == "2-HIGH") & tenth, 1.0005).when(tenth, 1.01).otherwise(1.0)
    day = F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd").alias("day")
    best = b.where((F.col("time") < 880_000_000) & (symbol != "5-LOW")).select("symbol", day, (F.col("close") * factor).alias("last_price"), F.lit(2.0).alias("traded_qty"))
    less = best.withColumn("last_price", F.col("last_price") * 3).withColumn("traded_qty", F.lit(1.0))
    return rounded(audit.settlement(b, less.unionByName(best)).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",")))


@query(
    f"""WITH b AS ({Q.bars()}), a AS (SELECT * FROM b), v AS (SELECT symbol, time, close * CASE WHEN symbol = 'S1' THEN 1.002 ELSE 1.0005 END AS close, volume * CASE WHEN symbol = 'S2' THEN 34 ELSE 1 END AS volume FROM b WHERE symbol <> 'S3' OR time % 7200 = 0),
 p AS (SELECT a.symbol, a.time, abs(v.close - a.close) AS gap, a.close, CASE WHEN a.volume > 0 AND v.volume > 0 THEN v.volume / a.volume END AS ratio FROM a JOIN v ON a.symbol = v.symbol AND a.time = v.time),
 s AS (SELECT symbol, count(*) AS n, 100 * avg(gap) / arg_min(close, time) AS apart, arg_min(close, time) AS level, count(ratio) AS nr, list_sort(list(ratio) FILTER (ratio IS NOT NULL))[count(ratio) // 2 + 1] AS ratio FROM p GROUP BY 1),
 z AS (SELECT s.*, n / least((SELECT count(*) FROM a WHERE a.symbol = s.symbol), (SELECT count(*) FROM v WHERE v.symbol = s.symbol)) AS covered FROM s),
 f AS (SELECT p.symbol, coalesce(array_to_string(list_sort(list(time) FILTER (100 * gap / level >= 0.15))[1:3], ','), '') AS ec, coalesce(array_to_string(list_sort(list(time) FILTER (NOT (p.ratio > 0.5 AND p.ratio < 2)))[1:3], ','), '') AS ev FROM p JOIN s ON p.symbol = s.symbol GROUP BY 1)
 SELECT z.symbol, unnest(['coverage', 'close', 'volume']) AS "check", unnest([CASE WHEN covered < 0.8 THEN 'FAIL' ELSE 'OK' END, CASE WHEN apart < 0.15 THEN 'OK' ELSE 'FAIL' END, CASE WHEN ratio > 0.5 AND ratio < 2 THEN 'OK' ELSE 'FAIL' END]) AS status,
 unnest([n, n, nr]) AS n, unnest([round(covered, 6) + 0.0, round(apart, 6) + 0.0, round(ratio, 6) + 0.0]) AS value, unnest(['', ec, ev]) AS examples FROM z JOIN f ON z.symbol = f.symbol"""
)
def agreement_audit(spark, d):
    """Two sources whose closes, volumes or times differ, by symbol."""
    b = S.bars(spark, d).select("symbol", "time", "close", "volume")
    symbol = F.col("symbol")
    live = b.where((symbol != "S3") | (F.col("time") % 7200 == 0)).withColumn("close", F.col("close") * F.when(symbol == "S1", 1.002).otherwise(1.0005)).withColumn("volume", F.col("volume") * F.when(symbol == "S2", 34).otherwise(1))
    return rounded(audit.agreement(b, live, 3600).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",")))


#: Some lines and boxes for each symbol, from its own range.
DRAWINGS = f"""g AS (SELECT symbol, min(time) AS a, max(time) AS z, min(low) AS lo, max(high) AS hi FROM ({Q.bars()}) GROUP BY 1),
 dr AS (SELECT symbol, unnest(['segment', 'ray', 'line', 'horizontal', 'vertical', 'box']) AS shape, unnest([a + (z - a) // 5, a + (z - a) // 2, a + (z - a) // 3, a, a + ((z - a) // 7200) * 3600, a + (z - a) // 4]) AS t0, unnest([lo, hi, lo + (hi - lo) / 3, lo + (hi - lo) / 2, lo, lo + (hi - lo) / 4]) AS p0,
 unnest([z, a + (z - a) // 3, a + (z - a) // 2, a, a + ((z - a) // 7200) * 3600, a + (z - a) // 2]) AS t1, unnest([hi, lo + (hi - lo) / 2, lo + (hi - lo) / 2, lo, hi, hi]) AS p1 FROM g)"""


@query(
    f"""WITH b AS ({Q.bars()}), {DRAWINGS}, m AS (SELECT b.symbol, shape, time, low, high, t0, p0, t1, p1, p0 + (p1 - p0) * (time - t0) / nullif(CAST(t1 - t0 AS DOUBLE), 0) AS y FROM b JOIN dr ON b.symbol = dr.symbol)
 SELECT symbol, shape AS drawing, shape, time FROM m WHERE CASE shape WHEN 'segment' THEN time BETWEEN t0 AND t1 AND y BETWEEN low AND high WHEN 'ray' THEN time <= t0 AND y BETWEEN low AND high WHEN 'line' THEN y BETWEEN low AND high
 WHEN 'horizontal' THEN p0 BETWEEN low AND high WHEN 'vertical' THEN time = t0 ELSE time BETWEEN t0 AND t1 AND low <= p1 AND high >= p0 END"""
)
def touched_bars(spark, d):
    """Bars that some lines and boxes of their symbol pass through, met in cells of a day and 25 of price."""
    b = S.bars(spark, d)
    drawings = b.groupBy("symbol").agg(F.min("time").alias("a"), F.max("time").alias("z"), F.min("low").alias("lo"), F.max("high").alias("hi"))
    at = lambda k: f"a + (z - a) div {k}"
    mid = "a + ((z - a) div 7200) * 3600"
    rows = [
        ("segment", at(5), "lo", "z", "hi"), ("ray", at(2), "hi", at(3), "lo + (hi - lo) / 2"), ("line", at(3), "lo + (hi - lo) / 3", at(2), "lo + (hi - lo) / 2"),
        ("horizontal", "a", "lo + (hi - lo) / 2", "a", "lo"), ("vertical", mid, "lo", mid, "hi"), ("box", at(4), "lo + (hi - lo) / 4", at(2), "hi"),
    ]
    each = ", ".join(f"named_struct('drawing', '{s}', 'shape', '{s}', 't0', {t0}, 'p0', {p0}, 't1', {t1}, 'p1', {p1})" for s, t0, p0, t1, p1 in rows)
    return geometry.touched(b, drawings.select("symbol", F.explode(F.expr(f"array({each})")).alias("x")).select("symbol", "x.*"), 86_400, 25.0)


# ---- alerts and replay

LEVEL = 245.0


def _samples(spark, d):
    b = S.bars(spark, d)
    w = Window.partitionBy("symbol").orderBy("time").rowsBetween(-19, 0)
    return b.select("symbol", "time", F.col("close").alias("value"), "high", "low", F.avg("close").over(w).alias("reference"))


SAMPLES = f"""s AS (SELECT symbol, time, close AS value, high, low, avg(close) OVER (PARTITION BY symbol ORDER BY time ROWS 19 PRECEDING) AS reference FROM ({Q.bars()})),
 l AS (SELECT *, lag(value) OVER w AS p, lag(reference) OVER w AS rp, first_value(value) OVER w AS bl FROM s WINDOW w AS (PARTITION BY symbol ORDER BY time))"""
KINDS = {
    "cross_above": (A.Alert("a", "CROSS_ABOVE", level=LEVEL, once=False), f"p <= {LEVEL} AND value > {LEVEL}", False),
    "cross_below": (A.Alert("a", "CROSS_BELOW", level=LEVEL, once=False), f"p >= {LEVEL} AND value < {LEVEL}", False),
    "touch": (A.Alert("a", "TOUCH", level=LEVEL, once=False), f"low <= {LEVEL} AND high >= {LEVEL}", True),
    "enter_zone": (A.Alert("a", "ENTER_ZONE", low=200.0, high=300.0, once=False), "NOT (p BETWEEN 200 AND 300) AND value BETWEEN 200 AND 300", False),
    "exit_zone": (A.Alert("a", "EXIT_ZONE", low=200.0, high=300.0, once=False), "p BETWEEN 200 AND 300 AND NOT (value BETWEEN 200 AND 300)", False),
    "percent_change": (A.Alert("a", "PERCENT_CHANGE", percent=5.0, once=False), "100 * (value - bl) / nullif(bl, 0) >= 5", True),
    "series_cross": (A.Alert("a", "SERIES_CROSS", once=False), "(p - rp <= 0 AND value - reference > 0) OR (p - rp >= 0 AND value - reference < 0)", False),
}


def _alert(kind: str, alert: A.Alert, cond: str, lasting: bool) -> None:
    def run(spark, d):
        return rounded(A.evaluate(_samples(spark, d), [alert]))

    edge = "QUALIFY c AND NOT coalesce(lag(c) OVER (PARTITION BY symbol ORDER BY time), false)" if lasting else "WHERE c"
    QUERIES[f"alert_{kind}"] = run
    ORACLE[f"alert_{kind}"] = f"WITH {SAMPLES}, x AS (SELECT *, coalesce({cond}, false) AS c FROM l) SELECT symbol, 'a' AS alert, '{alert.kind}' AS kind, time, {r('value', 'value')} FROM x {edge}"


for _kind, _spec in KINDS.items():
    _alert(_kind, *_spec)


@query(f"SELECT symbol, time, {r('close', 'close')} FROM ({Q.bars()}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time) <= 100")
def replay_prefix(spark, d):
    return rounded(analytics.replay(S.bars(spark, d), 100).select("symbol", "time", "close"))


# ---- streams over the tables, run to their end


def _stream(spark, d, table: str) -> DataFrame:
    """A table as a stream of its files; a pattern, as the source takes no single file by its plain name."""
    return spark.readStream.schema(S.table(spark, d, table).schema).parquet(f"{d}/{table}.parque[t]")


@query(
    f"""WITH t AS (SELECT symbol, seq, CAST(floor(time / 3600) * 3600 AS BIGINT) AS time, price, size FROM ({Q.trades()})), m AS (SELECT *, max(time) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS top FROM t)
 SELECT symbol, time, {r('arg_max(price, seq)', 'close')}, {r('arg_max(size, seq)', 'volume')} FROM m WHERE time = top GROUP BY 1, 2"""
)
def live_upsert(spark, d):
    """Each trade as an update of its hour's bar: of the bars, what a versioned table holds after the stream."""
    t = S.trades(spark, d, events=_stream(spark, d, "events"))
    price = F.col("price")
    updates = t.select("symbol", resample.bucket(F.col("time"), 3600).alias("time"), *(price.alias(c) for c in ("open", "high", "low", "close")), F.col("size").alias("volume"), "seq")
    table = BarTable(spark, shared.folder(spark, "bars"))
    q = updates.writeStream.foreachBatch(table.sink()).option("checkpointLocation", shared.folder(spark, "bars-offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return rounded(table.read().select("symbol", "time", "close", "volume"))


STREAMED = ("macd", "hma", "lsma", "aroon", "ichimoku", "vwap_bands")


def _streamed_sql() -> str:
    chain = DuckChain(Q.bars())
    out = {f"{name}_{k}": sql for name in STREAMED for k, sql in indicators.REGISTRY[name].build(chain, **indicators.settings(name, {})).items()}
    return chain.sql("symbol, time, " + ", ".join(r(sql, c) for c, sql in out.items()))


@query(_streamed_sql())
def stream_of_indicators(spark, d):
    """Bars, landed in files, as a stream through the steps of some indicators."""
    bars = S.bars(spark, d).withColumn("closed", F.lit(True)).withColumn("seq", F.lit(0))
    path, out = shared.folder(spark, "bars"), shared.folder(spark, "indicators")
    bars.write.parquet(path)
    with typed_state(spark):
        q = stream_indicators(spark.readStream.schema(bars.schema).parquet(path), {name: {} for name in STREAMED}).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return rounded(spark.read.parquet(out).drop("is_partial"))


@query(f"SELECT symbol, time, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, {r('volume', 'volume')} FROM ({Q.bars()}) WHERE symbol = 'S3' AND time >= 1705000000")
def landed_bars(spark, d):
    """Bars landed as answers of a day each, and one symbol's late ones read back as a data source."""
    path, n = shared.folder(spark, "landed"), "format_string('%d', time - time % 86400"
    fields = F.struct("time", "open", "high", "low", "close", "volume", F.col("buy_volume").alias("buyVolume"), F.col("sell_volume").alias("sellVolume"))
    days = S.bars(spark, d).groupBy("symbol", F.lit(3600).alias("period"), F.expr(f"{n})").alias("start"), F.expr(f"{n} + 86400)").alias("end"))
    days.agg(F.to_json(F.collect_list(fields)).alias("value")).write.partitionBy("symbol", "period", "start", "end").text(path)
    landed.register(spark)
    bars = spark.read.format("landed_bars").load(path).where("symbol = 'S3' and time >= 1705000000")
    return rounded(bars.select("symbol", "time", "open", "high", "low", "close", "volume"))


# ---- levels and formats


def _anchors(spark, d):
    return S.bars(spark, d).groupBy("symbol").agg(F.min("low").alias("p0"), F.max("high").alias("p1"), F.min("time").alias("t0"), F.max("time").alias("t1"))


def _fib(levels) -> str:
    return f"SELECT symbol, k AS level, round(p0 + (p1 - p0) * k, 6) + 0.0 AS price FROM (SELECT symbol, min(low) AS p0, max(high) AS p1, unnest({[float(x) for x in levels]}::DOUBLE[]) AS k FROM ({Q.bars()}) GROUP BY 1)"


@query(_fib(analytics.FIB_RETRACEMENT))
def fib_retracement(spark, d):
    return rounded(analytics.levels_between(_anchors(spark, d), analytics.FIB_RETRACEMENT))


@query(_fib(analytics.FIB_EXTENSION))
def fib_extension(spark, d):
    return rounded(analytics.levels_between(_anchors(spark, d), analytics.FIB_EXTENSION))


@query(
    f"""WITH g AS (SELECT symbol, min(low) AS p0, max(high) AS p1, min(time) AS t0, max(time) AS t1, unnest({[float(x) for x in analytics.FIB_RETRACEMENT]}::DOUBLE[]) AS level FROM ({Q.bars()}) GROUP BY 1)
 SELECT symbol, level, {r('p0 + (p1 - p0) * level', 'price')}, {r('(p1 - p0) * level / nullif(CAST(t1 - t0 AS DOUBLE), 0)', 'slope')} FROM g"""
)
def fib_fan(spark, d):
    return rounded(analytics.fib_fan(_anchors(spark, d)))


@query(f"SELECT symbol, time, {r('close - open', 'change')}, {r('100 * (close - open) / nullif(open, 0)', 'percent')} FROM ({Q.bars()})")
def crosshair_change(spark, d):
    change, percent = analytics.change_within(F.col("open"), F.col("close"))
    return rounded(S.bars(spark, d).select("symbol", "time", change.alias("change"), percent.alias("percent")))


ENDS = f"e AS (SELECT symbol, min(low) AS p0, max(high) AS p1, min(time) AS t0, max(time) AS t1 FROM ({Q.bars()}) GROUP BY 1)"


@query(f"WITH b AS ({Q.bars()}), {ENDS} SELECT b.symbol, time, {r('p0 + (p1 - p0) * (time - t0) / nullif(t1 - t0, 0)', 'value')} FROM b JOIN e ON b.symbol = e.symbol")
def trend_line(spark, d):
    b = S.bars(spark, d).join(_anchors(spark, d), "symbol")
    return rounded(b.select("symbol", "time", analytics.trend_line(*(F.col(c) for c in ("time", "t0", "p0", "t1", "p1"))).alias("value")))


@query(f"WITH {ENDS} SELECT symbol, {r('p0 - 0.5 * (p1 - p0)', 'a')}, {r('p1 - 0.5 * (p1 - p0)', 'z')} FROM e")
def channel_line(spark, d):
    a, z = analytics.channel_line(F.col("p0"), F.col("p1"), -0.5)
    return rounded(_anchors(spark, d).select("symbol", a.alias("a"), z.alias("z")))


@query(
    f"""WITH n AS (SELECT symbol, time, close, row_number() OVER (PARTITION BY symbol ORDER BY time) AS rn FROM ({Q.bars()})), a AS (SELECT symbol, max(rn) AS k FROM n WHERE time <= 1705000000 GROUP BY 1)
 SELECT n.symbol, time, {r('close', 'close')} FROM n JOIN a ON n.symbol = a.symbol WHERE abs(rn - k) <= 5"""
)
def bars_near(spark, d):
    return rounded(align.neighbours(S.bars(spark, d), 1_705_000_000, 5).select("symbol", "time", "close"))


@query(f"SELECT symbol, time, {r('close', 'close')} FROM ({Q.bars()}) WHERE time <= 1705000000")
def replay_until(spark, d):
    return rounded(analytics.replay_until(S.bars(spark, d), 1_705_000_000).select("symbol", "time", "close"))


@query(f"SELECT symbol, max(covered) >= 60 AS usable FROM (SELECT symbol, year(make_timestamp(time * 1000000)) AS y, count(DISTINCT dayofyear(make_timestamp(time * 1000000))) AS covered, count(*) AS n, arg_min(close, time) AS f FROM ({Q.daily(True)}) GROUP BY 1, 2 HAVING count(*) >= 2) WHERE f <> 0 GROUP BY 1")
def seasonality_usable(spark, d):
    return analytics.seasonality_usable(analytics.seasonality(S.daily(spark, d, True), 100))


@query(f"SELECT symbol, k, min(time) + (max(time) - min(time)) * k AS time FROM ({Q.bars()}), (SELECT unnest({list(analytics.FIB_TIMES)}) AS k) GROUP BY 1, 2")
def fib_time_zones(spark, d):
    return analytics.fib_time_zones(_anchors(spark, d))


@query(f"SELECT symbol, {r('max(high) - (min(low) - max(high)) * 2', 'target')} FROM ({Q.bars()}) GROUP BY 1")
def position_target(spark, d):
    return rounded(_anchors(spark, d).select("symbol", analytics.position_target(F.col("p1"), F.col("p0")).alias("target")))


@query(f"SELECT symbol, time, round(floor(close / 0.25 + 0.5) * 0.25, 6) AS price FROM ({Q.bars()})")
def price_format(spark, d):
    return S.bars(spark, d).select("symbol", "time", F.round(C.round_to_tick(F.col("close"), 0.25), 6).alias("price"))


def _ticks(bounds: str, log: bool) -> str:
    nice = "CASE WHEN s / g >= 5 THEN 5 WHEN s / g >= 2.5 THEN 2.5 WHEN s / g >= 2 THEN 2 ELSE 1 END * g"
    linear = f"""b AS ({bounds}), s AS (SELECT *, (top - bottom) / 6 AS s, pow(10, floor(log10((top - bottom) / 6))) AS g FROM b WHERE top > bottom), p AS (SELECT symbol, top, bottom, {nice} AS step FROM s),
 lin AS (SELECT symbol, unnest(list_transform(range(CAST(floor(top / step + 0.001) - ceil(bottom / step) + 1 AS BIGINT)), lambda k: (ceil(bottom / step) + k) * step)) AS tick FROM p)"""
    if not log:
        return f"WITH {linear} SELECT symbol, round(tick, 6) + 0.0 AS tick FROM lin"
    return f"""WITH {linear}, d AS (SELECT *, CAST(floor(log10(bottom)) AS BIGINT) AS k0, CAST(ceil(log10(top)) AS BIGINT) AS k1 FROM b WHERE bottom > 0 AND top > bottom),
 e AS (SELECT *, unnest(range(k0, k1 + 1, CASE WHEN k1 - k0 <= 4 THEN 1 ELSE greatest(1, CAST(ceil((k1 - k0) / 6) AS BIGINT)) END)) AS k FROM d), f AS (SELECT *, unnest(CASE WHEN k1 - k0 <= 2 THEN [1, 2, 5] WHEN k1 - k0 <= 4 THEN [1, 5] ELSE [1] END) * pow(10, k) AS tick FROM e),
 lg AS (SELECT symbol, tick, count(*) OVER (PARTITION BY symbol) AS n FROM f WHERE tick >= bottom * (1 - 1e-9) AND tick <= top * (1 + 1e-9))
 SELECT symbol, round(tick, 6) + 0.0 AS tick FROM lg WHERE n >= 3 UNION ALL SELECT symbol, round(tick, 6) + 0.0 FROM lin WHERE symbol NOT IN (SELECT symbol FROM lg WHERE n >= 3)"""


BOUNDS = f"SELECT symbol, max(high) + 0.05 * (max(high) - min(low)) AS top, min(low) - 0.05 * (max(high) - min(low)) AS bottom FROM ({Q.bars()}) GROUP BY 1"
#: Under each price so many times its own hundredth: some symbols span few decades, some many.
DECADES = f"SELECT symbol, max(high) * 1.0 AS top, max(high) / pow(10, 1 + CAST(substr(symbol, 2) AS INTEGER) * 2) AS bottom FROM ({Q.bars()}) GROUP BY 1"


@query(_ticks(BOUNDS, False))
def price_ticks(spark, d):
    bounds = S.bars(spark, d).groupBy("symbol").agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
    return rounded(prices.price_ticks(prices.auto_scale(bounds)))


@query(_ticks(DECADES, True))
def price_ticks_log(spark, d):
    top = F.max("high")
    bounds = S.bars(spark, d).groupBy("symbol").agg(top.alias("top"), (top / F.pow(F.lit(10.0), 1 + F.expr("int(substring(symbol, 2))") * 2)).alias("bottom"))
    return rounded(prices.price_ticks(bounds, logarithmic=True))


@query(f"SELECT symbol, time, printf('%.2f', floor(close / 0.25 + 0.5) * 0.25) AS quarter, printf('%.0f', floor(close / 5 + 0.5) * 5) AS fives FROM ({Q.bars()})")
def price_text(spark, d):
    c = F.col("close")
    return S.bars(spark, d).select("symbol", "time", prices.format_price(c, tick=0.25).alias("quarter"), prices.format_price(c, tick=5.0).alias("fives"))


def _fuzzy(needle: str) -> str:
    """Every alignment of the needle, one join a letter, and the best of each name."""
    at = lambda j, d=0: f"substr(p_name, CAST({j} + 1 + {d} AS BIGINT), 1)"
    bonus = lambda j: f"CASE WHEN {j} = 0 THEN 24 WHEN NOT regexp_matches({at(j, -1)}, '[\\p{{L}}\\p{{N}}]') THEN 20 WHEN {at(j, -1)} = lower({at(j, -1)}) AND {at(j)} <> lower({at(j)}) THEN 14 WHEN NOT regexp_matches({at(j, -1)}, '\\p{{Nd}}') AND regexp_matches({at(j)}, '\\p{{Nd}}') THEN 10 ELSE 0 END"
    c = "c AS (SELECT p_partkey, p_name, len(p_name) AS n, unnest(range(len(p_name))) AS j FROM part)"
    steps = [f"a0 AS (SELECT p_partkey, p_name, n, j, greatest(-2 * j, -30) + 16 + {bonus('j')} AS score FROM c WHERE lower({at('j')}) = '{needle[0]}')"]
    for i, letter in enumerate(needle[1:], 1):
        more = f"CASE WHEN c.j = a.j + 1 THEN greatest(34, 16 + {bonus('c.j').replace('p_name', 'c.p_name')}) ELSE -3 * (c.j - a.j - 1) + 16 + {bonus('c.j').replace('p_name', 'c.p_name')} END"
        steps.append(f"a{i} AS (SELECT a.p_partkey, a.p_name, a.n, c.j, a.score + {more} AS score FROM a{i - 1} a JOIN c ON a.p_partkey = c.p_partkey AND c.j > a.j WHERE lower({at('c.j').replace('p_name', 'c.p_name')}) = '{letter}')")
    return f"WITH {c}, {', '.join(steps)}, b AS (SELECT p_partkey, p_name, max(score - (n - 1 - j)) AS score FROM a{len(needle) - 1} WHERE n > {len(needle)} GROUP BY 1, 2) SELECT p_partkey, p_name, CAST(score AS DOUBLE) AS score FROM b ORDER BY score DESC, p_partkey LIMIT 200"


@query(_fuzzy("lwi"))
def fuzzy_rank(spark, d):
    """The 200 part names that fit best."""
    return search.fuzzy_rank(S.table(spark, d, "part").select("p_partkey", "p_name"), "lwi", "p_name", "p_partkey", 200).drop("ranges")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
