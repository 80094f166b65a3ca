"""The catalogue of technical indicators.

Each is registered with its parameters and a function that puts its outputs on a ``Chain``; it returns
the SQL of each output. Values are null until warm, never zero, and smoothers count only values that
their input has.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite_bars, price_of
from .series import Chain
from .state import kama, psar, supertrend


@dataclass(frozen=True)
class Indicator:
    name: str
    params: dict
    outputs: tuple[str, ...]
    build: Callable[..., dict[str, str]]
    #: Made by a step per bar from whole bars instead of expressions over windows.
    steps: bool = False


REGISTRY: dict[str, Indicator] = {}


def register_indicator(*outputs: str, **params):
    """Add an indicator: the function takes a chain and the parameters, whose defaults are given here."""

    def add(f: Callable[..., dict[str, str]]):
        REGISTRY[f.__name__] = Indicator(f.__name__, params, outputs, f)
        return f

    return add


def register_steps(f: Callable[..., DataFrame], *outputs: str, **params) -> None:
    """Add an indicator that a function makes from whole bars, a step per bar."""
    REGISTRY[f.__name__] = Indicator(f.__name__, params, outputs, f, True)


#: Least and greatest of parameters that aren't periods, by indicator where they differ; periods are from 1 to 5000.
RANGES = {"mult": (0.1, 10.0), "step": (0.001, 1.0), "most": (0.001, 1.0)}
OWN_RANGES = {("supertrend", "mult"): (0.1, 20.0)}
PERIOD = (1, 5000)


def settings(name: str, given: dict) -> dict:
    """Parameters with defaults, held to their ranges; periods are rounded, what isn't a finite number counts as not given, and unknown names are refused."""
    known = REGISTRY[name].params
    if unknown := set(given) - set(known):
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    out = {}
    for k, default in known.items():
        v = given.get(k, default)
        if isinstance(default, str):
            out[k] = v
            continue
        if not isinstance(v, (int, float)) or not math.isfinite(v):
            v = default
        low, high = PERIOD if isinstance(default, int) else OWN_RANGES.get((name, k), RANGES[k])
        v = min(max(v, low), high)
        out[k] = int(v + 0.5) if isinstance(default, int) else v
    return out


def indicator(bars: DataFrame, name: str, **given) -> DataFrame:
    """(symbol, time, <name>_<output>, ...) of one indicator over bars of any number of symbols."""
    if name not in REGISTRY:
        raise ValueError(f"unknown indicator {name!r}; one of {', '.join(sorted(REGISTRY))}")
    params = settings(name, given)
    if REGISTRY[name].steps:
        found = REGISTRY[name].build(finite_bars(bars), **params)
        return found.select("symbol", "time", *(F.col(k).alias(f"{name}_{k}") for k in REGISTRY[name].outputs))
    chain = Chain(finite_bars(bars))
    out = REGISTRY[name].build(chain, **params)
    return chain.df.select("symbol", "time", *(F.expr(sql).cast("double").alias(f"{name}_{k}") for k, sql in out.items()))


def indicators(bars: DataFrame, wanted: dict[str, dict], *keep: str) -> DataFrame:
    """(symbol, time, <keep>, <name>_<output>, ...) of some indicators in one chain, so bars are made and sorted once. Not of those that take a step per bar."""
    chain = Chain(finite_bars(bars))
    out = {}
    for name, given in wanted.items():
        if REGISTRY[name].steps:
            raise ValueError(f"{name} takes a step per bar: use indicator()")
        out |= {f"{name}_{k}": sql for k, sql in REGISTRY[name].build(chain, **settings(name, given)).items()}
    return chain.df.select("symbol", "time", *keep, *(F.expr(sql).cast("double").alias(c) for c, sql in out.items()))


VOL = "coalesce(CASE WHEN volume > 0 THEN volume END, 0)"
DAY = "floor(time / 86400)"
#: NaN is larger than any number to Spark; the cast is one that other engines read as well.
USABLE = "(buy_volume IS NOT NULL AND sell_volume IS NOT NULL AND buy_volume >= 0 AND sell_volume >= 0 AND buy_volume < CAST('infinity' AS DOUBLE) AND sell_volume < CAST('infinity' AS DOUBLE))"

# ---- averages


@register_indicator("value", n=20, src="close")
def sma(c, n, src):
    return {"value": c.sma(price_of(src), n)}


@register_indicator("value", n=20, src="close")
def ema(c, n, src):
    return {"value": c.ema(price_of(src), n)}


@register_indicator("value", n=20, src="close")
def wma(c, n, src):
    return {"value": c.wma(price_of(src), n)}


@register_indicator("value", n=14, src="close")
def rma(c, n, src):
    return {"value": c.rma(price_of(src), n)}


@register_indicator("value", n=20, src="close")
def dema(c, n, src):
    one = c.ema(price_of(src), n)
    two = c.ema(one, n)
    return {"value": f"2 * {one} - {two}"}


@register_indicator("value", n=20, src="close")
def tema(c, n, src):
    one = c.ema(price_of(src), n)
    two = c.ema(one, n)
    three = c.ema(two, n)
    return {"value": f"3 * {one} - 3 * {two} + {three}"}


@register_indicator("value", n=16, src="close")
def hma(c, n, src):
    half, full = c.wma(price_of(src), max(1, int(n / 2 + 0.5))), c.wma(price_of(src), n)
    return {"value": c.wma(f"2 * {half} - {full}", max(1, int(n**0.5 + 0.5)))}


@register_indicator("value", n=20, src="close")
def vwma(c, n, src):
    w = c.last(n)
    return {"value": f"CASE WHEN count(close) OVER {w} = {n} AND sum({VOL}) OVER {w} > 0 THEN sum({price_of(src)} * {VOL}) OVER {w} / nullif(sum({VOL}) OVER {w}, 0) END"}


@register_indicator("value", "slope", n=25, src="close")
def lsma(c, n, src):
    if n < 2:
        return {"value": price_of(src), "slope": "0"}
    w = c.last(n)
    # places in the window, from 0; sums over them are known, so a slope needs two weighted sums
    mean = c.put(f"avg({price_of(src)}) OVER {w}")
    values = c.put(c.collect(f"({price_of(src)})", w))
    weighed = c.put(c.weigh(values))
    slope = c.put(f"CASE WHEN count(close) OVER {w} = {n} THEN ({weighed} - {n * (n + 1) / 2!r} * {mean}) / {n * (n * n - 1) / 12!r} END")
    return {"value": f"{mean} + {slope} * {(n - 1) / 2!r}", "slope": slope}


@register_indicator("value", "signal", n=15, signal=9, src="close")
def trix(c, n, signal, src):
    three = c.ema(c.ema(c.ema(price_of(src), n), n), n)
    before = c.lag(three)
    value = c.put(f"100 * ({three} - {before}) / nullif({before}, 0)")
    return {"value": value, "signal": c.ema(value, signal)}


# ---- oscillators


def _gains(c, src, n):
    x = c.put(price_of(src))
    before = c.lag(x)
    up = c.rma(f"CASE WHEN {before} IS NOT NULL THEN greatest({x} - {before}, 0) END", n)
    down = c.rma(f"CASE WHEN {before} IS NOT NULL THEN greatest({before} - {x}, 0) END", n)
    return up, down


@register_indicator("value", n=14, src="close")
def rsi(c, n, src):
    up, down = _gains(c, src, n)
    return {"value": f"CASE WHEN {down} = 0 THEN CASE WHEN {up} = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + {up} / nullif({down}, 0)) END"}


@register_indicator("k", "d", n=14, smooth=3)
def stochastic(c, n, smooth):
    lo, hi = c.agg("min", "low", n), c.agg("max", "high", n)
    k = c.put(f"CASE WHEN {hi} - {lo} <= 0 THEN 50 ELSE 100 * (close - {lo}) / nullif({hi} - {lo}, 0) END")
    return {"k": k, "d": c.sma(k, smooth)}


@register_indicator("value", n=20)
def cci(c, n):
    x = c.put(price_of("hlc3"))
    mean, values = c.sma(x, n), c.put(c.collect(x, c.last(n)))
    spread = c.put(f"{c.deviation(values, mean)} / {n}")
    return {"value": f"CASE WHEN {mean} IS NULL THEN NULL WHEN {spread} = 0 THEN 0 ELSE ({x} - {mean}) / nullif(0.015 * {spread}, 0) END"}


@register_indicator("value", n=14)
def williams_r(c, n):
    lo, hi = c.agg("min", "low", n), c.agg("max", "high", n)
    return {"value": f"CASE WHEN {hi} - {lo} <= 0 THEN -50 ELSE -100 * ({hi} - close) / nullif({hi} - {lo}, 0) END"}


@register_indicator("value", n=9, src="close")
def roc(c, n, src):
    before = c.lag(price_of(src), n)
    return {"value": f"100 * ({price_of(src)} - {before}) / nullif({before}, 0)"}


@register_indicator("value", n=10, src="close")
def momentum(c, n, src):
    return {"value": f"{price_of(src)} - {c.lag(price_of(src), n)}"}


@register_indicator("macd", "signal", "histogram", fast=12, slow=26, signal=9, src="close")
def macd(c, fast, slow, signal, src):
    a, b = c.ema(price_of(src), fast), c.ema(price_of(src), slow)
    line = c.put(f"{a} - {b}")
    s = c.ema(line, signal)
    return {"macd": line, "signal": s, "histogram": f"{line} - {s}"}


@register_indicator("value", "signal", "hist", fast=12, slow=26, signal=9, src="close")
def ppo(c, fast, slow, signal, src):
    a, b = c.ema(price_of(src), fast), c.ema(price_of(src), slow)
    line = c.put(f"100 * ({a} - {b}) / nullif({b}, 0)")
    s = c.ema(line, signal)
    return {"value": line, "signal": s, "hist": f"{line} - {s}"}


@register_indicator("k", "d", n=14, window=14, smooth_k=3, smooth_d=3, src="close")
def stoch_rsi(c, n, window, smooth_k, smooth_d, src):
    up, down = _gains(c, src, n)
    x = c.put(f"100 * {up} / nullif({up} + {down}, 0)")
    lo, hi = c.agg("min", x, window), c.agg("max", x, window)
    raw = c.put(f"100 * ({x} - {lo}) / nullif({hi} - {lo}, 0)")
    k = c.sma(raw, smooth_k)
    return {"k": k, "d": c.sma(k, smooth_d)}


@register_indicator("up", "down", "osc", n=25)
def aroon(c, n):
    r = c.put(f"row_number() OVER {c.over()}")
    w = c.last(n)
    top = c.put(f"max_by({r}, {c.pair('high', r)}) OVER {w}")
    low = c.put(f"min_by({r}, {c.pair('low', f'-{r}')}) OVER {w}")
    up = c.put(f"CASE WHEN {r} >= {n} THEN 100.0 * ({n} - ({r} - {top})) / {n} END")
    down = c.put(f"CASE WHEN {r} >= {n} THEN 100.0 * ({n} - ({r} - {low})) / {n} END")
    return {"up": up, "down": down, "osc": f"{up} - {down}"}


@register_indicator("value", n=5, slow=34)
def ao(c, n, slow):
    return {"value": f"{c.sma(price_of('hl2'), n)} - {c.sma(price_of('hl2'), slow)}"}


@register_indicator("value", "media", n=14)
def bop(c, n):
    value = c.put("CASE WHEN high - low > 0 THEN (close - open) / nullif(high - low, 0) END")
    return {"value": value, "media": c.sma(value, n)}


@register_indicator("bull", "bear", n=13)
def elder_ray(c, n):
    e = c.ema("close", n)
    return {"bull": f"high - {e}", "bear": f"low - {e}"}


# ---- volatility and channels


@register_indicator("value", n=14)
def atr(c, n):
    return {"value": c.rma(c.true_range(), n)}


@register_indicator("value", n=20, src="close")
def stddev(c, n, src):
    return {"value": c.agg("stddev_pop", price_of(src), n)}


@register_indicator("upper", "middle", "lower", n=20, mult=2.0, src="close")
def bollinger(c, n, mult, src):
    m, s = c.sma(price_of(src), n), c.agg("stddev_pop", price_of(src), n)
    return {"upper": f"{m} + {mult} * {s}", "middle": m, "lower": f"{m} - {mult} * {s}"}


@register_indicator("upper", "middle", "lower", n=20, atr_n=10, mult=2.0)
def keltner(c, n, atr_n, mult):
    m, a = c.ema("close", n), c.rma(c.true_range(), atr_n)
    return {"upper": f"{m} + {mult} * {a}", "middle": f"CASE WHEN {a} IS NOT NULL THEN {m} END", "lower": f"{m} - {mult} * {a}"}


@register_indicator("upper", "middle", "lower", n=20)
def donchian(c, n):
    hi, lo = c.agg("max", "high", n), c.agg("min", "low", n)
    return {"upper": hi, "middle": f"({hi} + {lo}) / 2", "lower": lo}


@register_indicator("tenkan", "kijun", "senkou_a", "senkou_b", "chikou", short=9, mid=26, long=52)
def ichimoku(c, short, mid, long):
    middle = lambda n: c.put(f"({c.agg('max', 'high', n)} + {c.agg('min', 'low', n)}) / 2")
    t, k, b = middle(short), middle(mid), middle(long)
    return {"tenkan": t, "kijun": k, "senkou_a": f"({t} + {k}) / 2", "senkou_b": b, "chikou": "close"}


@register_indicator("value", n=14)
def chop(c, n):
    tr = c.true_range()
    hi, lo, total = c.agg("max", "high", n), c.agg("min", "low", n), c.agg("sum", tr, n)
    return {"value": f"CASE WHEN {hi} - {lo} > 0 AND {total} > 0 THEN 100 * log10({total} / nullif({hi} - {lo}, 0)) / log10({max(2, n)}) END"}


@register_indicator("adx", "plus_di", "minus_di", n=14)
def adx(c, n):
    h, low, close = c.lag("high"), c.lag("low"), c.lag("close")
    up, down = c.put(f"high - {h}"), c.put(f"{low} - low")
    plus = c.rma(f"CASE WHEN {h} IS NOT NULL THEN CASE WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE 0 END END", n)
    minus = c.rma(f"CASE WHEN {h} IS NOT NULL THEN CASE WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE 0 END END", n)
    tr = c.rma(f"CASE WHEN {close} IS NOT NULL THEN greatest(high - low, abs(high - {close}), abs(low - {close})) END", n)
    p, m = c.put(f"100 * {plus} / nullif({tr}, 0)"), c.put(f"100 * {minus} / nullif({tr}, 0)")
    dx = c.put(f"CASE WHEN {p} + {m} = 0 THEN 0 ELSE 100 * abs({p} - {m}) / nullif({p} + {m}, 0) END")
    return {"adx": c.rma(dx, n), "plus_di": p, "minus_di": m}


# ---- volume and order flow


@register_indicator("value")
def obv(c):
    before = c.lag("close")
    return {"value": f"sum(CASE WHEN close > {before} THEN coalesce(volume, 0) WHEN close < {before} THEN -coalesce(volume, 0) ELSE 0 END) OVER {c.so_far()}"}


@register_indicator("value")
def vwap(c):
    w = c.so_far(DAY)
    return {"value": f"CASE WHEN sum(coalesce(volume, 0)) OVER {w} > 0 THEN sum({price_of('hlc3')} * coalesce(volume, 0)) OVER {w} / nullif(sum(coalesce(volume, 0)) OVER {w}, 0) END"}


@register_indicator("upper", "value", "lower", mult=1.0)
def vwap_bands(c, mult):
    w = c.so_far(DAY)
    v = c.put(f"sum(coalesce(volume, 0)) OVER {w}")
    p = c.put(price_of("hlc3"))
    m = c.put(f"CASE WHEN {v} > 0 THEN sum({p} * coalesce(volume, 0)) OVER {w} / nullif({v}, 0) END")
    s = c.put(f"CASE WHEN {v} > 0 THEN sqrt(greatest(sum({p} * {p} * coalesce(volume, 0)) OVER {w} / nullif({v}, 0) - {m} * {m}, 0)) END")
    return {"upper": f"{m} + {mult} * {s}", "value": m, "lower": f"{m} - {mult} * {s}"}


@register_indicator("value", n=14)
def mfi(c, n):
    p = c.put(price_of("hlc3"))
    before = c.lag(p)
    flow = c.put(f"CASE WHEN {before} IS NOT NULL THEN {p} * coalesce(volume, 0) END")
    up = c.agg("sum", f"CASE WHEN {before} IS NULL THEN NULL WHEN {p} > {before} THEN {flow} ELSE 0 END", n)
    down = c.agg("sum", f"CASE WHEN {before} IS NULL THEN NULL WHEN {p} < {before} THEN {flow} ELSE 0 END", n)
    return {"value": f"CASE WHEN {up} + {down} > 0 THEN 100 * {up} / nullif({up} + {down}, 0) END"}


MULT = "CASE WHEN high - low > 0 THEN (2 * close - high - low) / nullif(high - low, 0) ELSE 0 END"


@register_indicator("value", n=20)
def cmf(c, n):
    w = c.last(n)
    return {"value": f"CASE WHEN count(close) OVER {w} = {n} AND sum(coalesce(volume, 0)) OVER {w} > 0 THEN sum({MULT} * coalesce(volume, 0)) OVER {w} / nullif(sum(coalesce(volume, 0)) OVER {w}, 0) END"}


@register_indicator("value")
def adl(c):
    return {"value": f"sum({MULT} * {VOL}) OVER {c.so_far()}"}


@register_indicator("value", n=13)
def force_index(c, n):
    before = c.lag("close")
    return {"value": c.ema(f"CASE WHEN {before} IS NOT NULL AND volume > 0 THEN (close - {before}) * volume END", n)}


@register_indicator("value", "media", smooth=1)
def delta(c, smooth):
    value = c.put(f"CASE WHEN {USABLE} THEN buy_volume - sell_volume END")
    return {"value": value, "media": c.sma(value, smooth)}


@register_indicator("value", "cobertura")
def cvd(c):
    w = c.so_far()
    return {"value": f"sum(CASE WHEN {USABLE} THEN buy_volume - sell_volume ELSE 0 END) OVER {w}", "cobertura": f"100.0 * sum(CASE WHEN {USABLE} THEN 1 ELSE 0 END) OVER {w} / count(close) OVER {w}"}


@register_indicator("value", "ema", n=9)
def delta_ratio(c, n):
    value = c.put(f"CASE WHEN {USABLE} AND buy_volume + sell_volume > 0 THEN 100 * (buy_volume - sell_volume) / nullif(buy_volume + sell_volume, 0) END")
    return {"value": value, "ema": c.ema(value, n)}


LEVELS = {
    "r3": "{h} + 2 * ({p} - {l})", "r2": "{p} + ({h} - {l})", "r1": "2 * {p} - {l}", "pp": "{p}",
    "s1": "2 * {p} - {h}", "s2": "{p} - ({h} - {l})", "s3": "{l} - 2 * ({h} - {p})",
}


@register_indicator(*LEVELS)
def pivot_points(c):
    """Levels of the last day before this one that has bars: carried over the first bar of each day."""
    day = c.put(DAY)
    w = c.so_far(day)
    hi, lo = c.put(f"max(high) OVER {w}"), c.put(f"min(low) OVER {w}")
    before = c.lag(day)
    fresh = c.put(f"CASE WHEN {before} <> {day} THEN 1 ELSE 0 END")
    ph, pl, pc = (c.put(f"CASE WHEN {fresh} = 1 THEN {c.lag(x)} END") for x in (hi, lo, "close"))
    h, low, close = (c.put(f"max({x}) OVER {c.so_far(day)}") for x in (ph, pl, pc))
    p = c.put(f"({h} + {low} + {close}) / 3")
    return {k: v.format(h=h, l=low, p=p) for k, v in LEVELS.items()}


# ---- a step per bar

register_steps(supertrend, "value", "direction", n=10, mult=3.0)
register_steps(psar, "value", step=0.02, most=0.2)
register_steps(kama, "value", n=10, fast=2, slow=30)
