"""Whether a source of bars can be trusted for a period: a profile of what is known of it, and a verdict for each symbol."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from .analytics import DAY, Sessions, touches_session

VERDICTS = ("OK", "CAUTION", "FAILED")
#: The share of bars outside sessions from which on it looks like a wrong time zone.
WRONG_ZONE = 0.05


@dataclass(frozen=True)
class PeriodRule:
    """What is known of one period. ``status`` is OK, CAUTION or FAILED; ``vetted`` comes before the profile's."""

    period: int
    status: str = "OK"
    reason: str | None = None
    vetted: tuple[int | None, int | None] | None = None


@dataclass(frozen=True)
class Profile:
    """Checks that aren't declared aren't made.

    ``vetted``: first and last time at which the source was checked, None for an open end. ``least_sides``: the least
    share of bars with both a buy and a sell volume. ``tolerated_outside``: the share of bars outside ``sessions`` that may
    be. ``incomplete_from``: from when on bars shorter than a day lack trades.
    """

    sessions: Sessions | None = None
    vetted: tuple[int | None, int | None] | None = None
    least_sides: float | None = None
    tolerated_outside: float = 0.0
    incomplete_from: int | None = None
    rules: tuple[PeriodRule, ...] = ()

    def rule(self, period: int) -> PeriodRule | None:
        return next((r for r in self.rules if r.period == period), None)


def incomplete(profile: Profile, period: int, until: Column) -> Column:
    """Whether bars up to a time reach into where the source lacks trades; never for a day or longer."""
    if period >= DAY or profile.incomplete_from is None:
        return F.lit(False)
    return F.coalesce(until >= profile.incomplete_from, F.lit(False))


def _outside(time: Column, window: tuple[int | None, int | None] | None) -> Column:
    out = F.lit(False)
    if window:
        out = out | (time < window[0]) if window[0] is not None else out
        out = out | (time > window[1]) if window[1] is not None else out
    return F.coalesce(out, F.lit(False))


def report(bars: DataFrame, period: int, profile: Profile) -> DataFrame:
    """One row for each symbol: n, unvetted, outside, sideless (counts of bars), side_share, reasons, verdict.

    Incomplete bars fail by the last bar's time alone; a period's rule gives its own status; bars outside the
    vetted window and too few sides are a caution; bars outside sessions beyond what is tolerated are a caution, and fail
    from a twentieth of all bars on. The worst counts. All in one grouped aggregate.
    """
    rule = profile.rule(period)
    window = rule.vetted if rule and rule.vetted else profile.vetted
    time = F.col("time")
    stray = ~touches_session(time, period, profile.sessions) if profile.sessions else F.lit(False)
    sides = finite(F.col("buy_volume")) & finite(F.col("sell_volume"))
    s = bars.groupBy("symbol").agg(
        F.count("*").alias("n"), F.max("time").alias("__last"), F.count_if(_outside(time, window)).alias("unvetted"), F.count_if(stray).alias("outside"), F.count_if(~sides).alias("sideless")
    )
    share = (F.col("n") - F.col("sideless")) / F.col("n")
    out = F.col("outside") / F.col("n")
    over = out > profile.tolerated_outside
    few = share < profile.least_sides if profile.least_sides is not None else F.lit(False)
    status = rule.status if rule else "OK"
    if status not in VERDICTS:
        raise ValueError(f"unknown status {status!r}; one of {', '.join(VERDICTS)}")
    checks = [
        (incomplete(profile, period, F.col("__last")), "FAILED", F.lit("intraday bars lack trades")),
        (F.lit(status != "OK"), status, F.lit((rule.reason if rule else None) or f"period is marked {status.lower()}")),
        (F.col("unvetted") > 0, "CAUTION", F.concat(F.col("unvetted").cast("string"), F.lit(" bars outside the vetted window"))),
        (few, "CAUTION", F.lit("sides are missing")),
        (over & (out >= WRONG_ZONE), "FAILED", F.lit("outside sessions: the time zone may be wrong")),
        (over & (out < WRONG_ZONE), "CAUTION", F.lit("some bars outside sessions")),
    ]
    reasons = F.filter(F.array(*(F.when(c, text) for c, _, text in checks)), lambda x: x.isNotNull())
    worst = lambda level: F.exists(F.array(*(F.coalesce(c, F.lit(False)) for c, v, _ in checks if v == level) or [F.lit(False)]), lambda x: x)
    verdict = F.when(worst("FAILED"), "FAILED").when(worst("CAUTION"), "CAUTION").otherwise("OK")
    return s.select("symbol", "n", "unvetted", "outside", "sideless", share.alias("side_share"), reasons.alias("reasons"), verdict.alias("verdict"))
