"""Column helpers with the null rules of market data: absent, not yet known and zero differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price of a bar by name.
PRICES = {
    "open": "open",
    "high": "high",
    "low": "low",
    "close": "close",
    "hl2": "(high + low) / 2",
    "hlc3": "(high + low + close) / 3",
    "ohlc4": "(open + high + low + close) / 4",
}


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))


def price_of(name: str) -> str:
    """SQL for one of the seven price sources."""
    if name not in PRICES:
        raise ValueError(f"unknown price source {name!r}; one of {', '.join(PRICES)}")
    return PRICES[name]


def half_up(c: Column) -> Column:
    """Rounding with halves toward plus infinity."""
    return F.floor(c + 0.5)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def finite_bars(bars):
    """Bars whose time and prices are all finite."""
    ok = finite(F.col("time"))
    for c in ("open", "high", "low", "close"):
        ok = ok & finite(F.col(c))
    return bars.where(ok)


def side_usable(coverage: float = 0.9) -> Column:
    """Whether a bar's buy and sell volumes can be trusted: both there, none negative, and nearly all of the volume."""
    buy, sell, vol = F.col("buy_volume"), F.col("sell_volume"), F.col("volume")
    both = finite(buy) & finite(sell) & (buy >= 0) & (sell >= 0)
    whole = vol.isNull() | (vol <= 0) | ((buy + sell) / F.nullif(vol, F.lit(0.0)) >= coverage)
    return F.coalesce(both & whole, F.lit(False))


def round_to_tick(price: Column, tick: float) -> Column:
    return half_up(price / tick) * tick


def group_price(price: Column, step: float) -> Column:
    """The multiple of ``step`` at or below a price, proof against 1e-9 of noise; a step that isn't positive changes nothing."""
    if step <= 0:
        return price
    return F.floor(half_up(price / step * 1e9) / 1e9) * step


def short_number(c: Column) -> Column:
    """1234 as 1.2k, 1234567 as 1.2M."""
    a = F.abs(c)
    return (
        F.when(a >= 1e6, F.format_string("%.1fM", c / 1e6)).when(a >= 1e3, F.format_string("%.1fk", c / 1e3)).otherwise(F.format_string("%.0f", c.cast("double")))
    )


def grouped_integer(c: Column) -> Column:
    """12345 as 12.345 (point between thousands)."""
    return F.translate(F.format_number(c, 0), ",", ".")


def clock(ms: Column, zone: str = "America/Sao_Paulo", label: str = "BRT") -> Column:
    """Milliseconds since 1970 as dd/MM/yyyy HH:mm:ss and a label, in a time zone."""
    t = F.from_utc_timestamp(F.timestamp_millis(ms), zone)
    return F.concat(F.date_format(t, "dd/MM/yyyy HH:mm:ss"), F.lit(f" {label}"))


def market_day(seconds: Column, zone: str = "America/Sao_Paulo") -> Column:
    """The civil day of a time in a time zone."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone))


def offset_day(seconds: Column, offset: int = -10_800) -> Column:
    """The civil day at a fixed offset from UTC."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((seconds + offset) / 86_400).cast("int"))


def valid_day(day: Column) -> Column:
    """Whether a text is a day of the calendar, as yyyy-MM-dd."""
    whole = day.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.coalesce(whole & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), F.lit(False))


def shift_day(day: Column, days: int) -> Column:
    """The day so many calendar days later, as text; null for what is no day."""
    return F.when(valid_day(day), F.date_format(F.date_add(F.try_to_date(day, "yyyy-MM-dd"), days), "yyyy-MM-dd"))


def day_label(day: Column, form: str = "dmy") -> Column:
    """A day as dd/MM/yyyy, or as it is (``iso``); null for what is no day."""
    return F.when(valid_day(day), day if form == "iso" else F.date_format(F.try_to_date(day, "yyyy-MM-dd"), "dd/MM/yyyy"))


def signed_integer(c: Column) -> Column:
    """12345 as +12.345, -5 as -5, 0 as 0."""
    return F.concat(F.when(c > 0, "+").otherwise(""), grouped_integer(c))
