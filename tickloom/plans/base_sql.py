"""DuckDB text of the derived tables, for the SQL equivalents of queries."""

TRADES = """SELECT {symbol} AS symbol, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS time, value AS price,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size,
 CASE WHEN event_type IN ('purchase', 'click') THEN 'buy' WHEN event_type IN ('error', 'view') THEN 'sell' END AS side FROM events"""

DAILY_TRADES = """SELECT {symbol} AS symbol, o_orderkey AS seq, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS time, CAST(o_totalprice AS DOUBLE) AS price,
 CAST(NULL AS DOUBLE) AS size, CAST(NULL AS VARCHAR) AS side FROM orders"""

AGG = """SELECT symbol, CAST(floor(time / {step}) * {step} AS BIGINT) AS time, first(price ORDER BY time, seq) AS open, max(price) AS high, min(price) AS low,
 first(price ORDER BY time DESC, seq) AS close, sum(size) AS volume, sum(size) FILTER (side = 'buy') AS buy_volume, sum(size) FILTER (side = 'sell') AS sell_volume
 FROM ({trades}) GROUP BY 1, 2"""

ROLL = """SELECT symbol, CAST(floor(time / {step}) * {step} AS BIGINT) AS t, first(open ORDER BY time) AS open, max(high) AS high, min(low) AS low,
 first(close ORDER BY time DESC) AS close, sum(volume) AS volume, sum(buy_volume) AS buy_volume, sum(sell_volume) AS sell_volume FROM ({bars}) GROUP BY 1, 2"""

CELLS = """SELECT CAST(floor(epoch(CAST(l_shipdate AS TIMESTAMP)) / 604800) * 604800000 AS BIGINT) AS ts_ms, CAST(l_quantity AS DOUBLE) AS price,
 CAST(100 * coalesce(sum(l_linenumber) FILTER (l_returnflag = 'N' AND l_linestatus = 'O'), 0) AS DOUBLE) AS bid,
 CAST(100 * coalesce(sum(l_linenumber) FILTER (l_returnflag = 'N' AND l_linestatus = 'F'), 0) AS DOUBLE) AS ask,
 CAST(1 * coalesce(sum(l_linenumber) FILTER (l_returnflag = 'A'), 0) AS DOUBLE) AS buy,
 CAST(1 * coalesce(sum(l_linenumber) FILTER (l_returnflag = 'R'), 0) AS DOUBLE) AS sell FROM lineitem GROUP BY 1, 2"""


def trades(by_symbol: bool = True) -> str:
    return TRADES.format(symbol="concat('S', user_id % 5)" if by_symbol else "'ALL'")


def bars(step: int = 3600, by_symbol: bool = True) -> str:
    return AGG.format(step=step, trades=trades(by_symbol))


def daily(by_priority: bool = False) -> str:
    return AGG.format(step=86_400, trades=DAILY_TRADES.format(symbol="o_orderpriority" if by_priority else "'ALL'"))


def rollup(step: int, of: str) -> str:
    return f"SELECT symbol, t AS time, open, high, low, close, volume, buy_volume, sell_volume FROM ({ROLL.format(step=step, bars=of)})"
