"""Price alerts: the batch form of a machine that arms, fires and arms again.

Kinds that happen at an instant fire at each row where they hold. Those that last (touch, percent change) fire
where they begin to hold. An alert that fires once fires at its first such row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite

KINDS = ("CROSS_ABOVE", "CROSS_BELOW", "TOUCH", "ENTER_ZONE", "EXIT_ZONE", "PERCENT_CHANGE", "SERIES_CROSS")


@dataclass(frozen=True)
class Alert:
    id: str
    kind: str
    level: float | None = None
    low: float | None = None
    high: float | None = None
    percent: float | None = None
    once: bool = True


def _holds(alert: Alert) -> tuple[Column, bool]:
    """The condition at a row, and whether it lasts."""
    v, p = F.col("value"), F.col("before")
    inside = lambda x: (x >= alert.low) & (x <= alert.high)
    if alert.kind == "CROSS_ABOVE":
        return (p <= alert.level) & (v > alert.level), False
    if alert.kind == "CROSS_BELOW":
        return (p >= alert.level) & (v < alert.level), False
    if alert.kind == "TOUCH":
        return (F.coalesce("low", "value") <= alert.level) & (F.coalesce("high", "value") >= alert.level), True
    if alert.kind == "ENTER_ZONE":
        return ~inside(p) & inside(v), False
    if alert.kind == "EXIT_ZONE":
        return inside(p) & ~inside(v), False
    if alert.kind == "PERCENT_CHANGE":
        change = 100 * (v - F.col("baseline")) / F.nullif("baseline", F.lit(0.0))
        return (change >= alert.percent) if alert.percent >= 0 else (change <= alert.percent), True
    if alert.kind == "SERIES_CROSS":
        d, e = F.col("before") - F.col("reference_before"), F.col("value") - F.col("reference")
        return ((d <= 0) & (e > 0)) | ((d >= 0) & (e < 0)), False
    raise ValueError(f"unknown kind {alert.kind!r}; one of {', '.join(KINDS)}")


def evaluate(samples: DataFrame, alerts: list[Alert]) -> DataFrame:
    """(symbol, alert, kind, time, value) of each firing. samples: (symbol, time, value, high, low, reference)."""
    w = Window.partitionBy("symbol").orderBy("time")
    s = samples.where(finite(F.col("time")) & finite(F.col("value")))
    s = s.withColumn("before", F.lag("value").over(w)).withColumn("reference_before", F.lag("reference").over(w))
    s = s.withColumn("baseline", F.first("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # all alerts in one pass over the samples: a column each, then an array of those that fire
    fired = []
    for k, a in enumerate(alerts):
        cond, lasting = _holds(a)
        s = s.withColumn(f"c{k}", F.coalesce(cond, F.lit(False)))
        fires = F.col(f"c{k}") & ~F.coalesce(F.lag(f"c{k}").over(w), F.lit(False)) if lasting else F.col(f"c{k}")
        s = s.withColumn(f"f{k}", fires)
        if a.once:
            s = s.withColumn(f"f{k}", F.col(f"f{k}") & (F.sum(F.col(f"f{k}").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1))
        fired.append(F.when(F.col(f"f{k}"), F.struct(F.lit(a.id).alias("alert"), F.lit(a.kind).alias("kind"))))
    return s.select("symbol", "time", "value", F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("x")).select("symbol", "x.alert", "x.kind", "time", "value")


def alert_levels(alert: Alert) -> list[float]:
    return sorted(x for x in (alert.level, alert.low, alert.high) if x is not None)


def with_references(samples: DataFrame, references: DataFrame) -> DataFrame:
    """``samples`` with the reference (symbol, time, reference) of their own time; null where there is none."""
    one = references.groupBy("symbol", "time").agg(F.first("reference").alias("reference"))
    return samples.drop("reference").join(one, ["symbol", "time"], "left")
