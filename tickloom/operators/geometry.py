"""Drawings over bars: which bars a line or a box touches, and distances from points to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite


def valid_anchor(time: Column, price: Column) -> Column:
    return finite(time) & finite(price)


def _along(px, py, ax, ay, bx, by) -> Column:
    """Where on a line through two points another is nearest, as a share of the way; null where the two are one."""
    dx, dy = bx - ax, by - ay
    return ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))


def _distance_at(t: Column, px, py, ax, ay, bx, by) -> Column:
    t = F.coalesce(t, F.lit(0.0))
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def distance_to_segment(px, py, ax, ay, bx, by) -> Column:
    """From a point to the segment between two others; to the one point if they are the same."""
    return _distance_at(F.least(F.greatest(_along(px, py, ax, ay, bx, by), F.lit(0.0)), F.lit(1.0)), px, py, ax, ay, bx, by)


def distance_to_ray(px, py, ax, ay, bx, by) -> Column:
    """The same for a ray from the first through the second."""
    return _distance_at(F.greatest(_along(px, py, ax, ay, bx, by), F.lit(0.0)), px, py, ax, ay, bx, by)


def distance_to_line(px, py, ax, ay, bx, by) -> Column:
    return _distance_at(_along(px, py, ax, ay, bx, by), px, py, ax, ay, bx, by)


def distance_to_outline(px, py, x1, y1, x2, y2) -> Column:
    """To the nearest of a rectangle's four sides, from inside as from outside."""
    return F.least(*(distance_to_segment(px, py, *side) for side in ((x1, y1, x2, y1), (x2, y1, x2, y2), (x2, y2, x1, y2), (x1, y2, x1, y1))))


SHAPES = ("segment", "ray", "line", "horizontal", "vertical", "box")


def touched(bars: DataFrame, drawings: DataFrame, time_cell: int, price_cell: float) -> DataFrame:
    """(symbol, drawing, shape, time): bars whose range from low to high, at their time, a drawing passes through.

    drawings: (symbol, drawing, shape, t0, p0, t1, p1), two anchors. A ray goes on past the second, a line past both, a horizontal
    has its first price at all times, a vertical all prices at its first time; a box is its inside with the edge.
    Bars and drawings meet in cells of time and price: a drawing goes to the cells that it passes in each stretch of time, a bar to those
    that its range covers, and what meets is checked exactly, once. Drawings reach no further than the bars of
    their symbol, so none has endless cells. Drawings with an anchor that isn't finite, of other shapes or of
    symbols without bars, and bars that aren't finite, touch nothing.
    """
    b = bars.where(finite(F.col("time")) & finite(F.col("low")) & finite(F.col("high")) & (F.col("low") <= F.col("high")))
    reach = b.groupBy("symbol").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.min("low").alias("lowest"), F.max("high").alias("highest"))
    shape, t0, t1, p0, p1 = (F.col(c) for c in ("shape", "t0", "t1", "p0", "p1"))
    d = drawings.where(valid_anchor(t0, p0) & valid_anchor(t1, p1) & shape.isin(*SHAPES)).join(reach, "symbol")
    # times that a drawing reaches, within those of the bars
    rising = t0 <= t1
    open_left = (shape == "horizontal") | (shape == "line") & (t0 != t1) | (shape == "ray") & ~rising
    open_right = (shape == "horizontal") | (shape == "line") & (t0 != t1) | (shape == "ray") & (t1 > t0)
    start = F.when(shape == "vertical", t0).when(open_left, F.col("first")).otherwise(F.least(t0, t1))
    end = F.when(shape == "vertical", t0).when(open_right, F.col("last")).otherwise(F.greatest(t0, t1))
    d = d.withColumn("start", F.greatest(start, F.col("first"))).withColumn("end", F.least(end, F.col("last"))).where("start <= end")
    slope = (p1 - p0) / F.nullif((t1 - t0).cast("double"), F.lit(0.0))

    def low_high(a: Column, z: Column) -> tuple[Column, Column]:
        """The drawing's prices between two times."""
        at = lambda t: F.when(shape == "horizontal", p0).otherwise(p0 + slope * (t - t0))
        whole_low = F.when((shape == "vertical") | (shape.isin("ray", "line") & (t0 == t1)), _upright(shape, t0, p0, t1, p1, F.col("lowest"), True)).otherwise(F.least(p0, p1))
        whole_high = F.when((shape == "vertical") | (shape.isin("ray", "line") & (t0 == t1)), _upright(shape, t0, p0, t1, p1, F.col("highest"), False)).otherwise(F.greatest(p0, p1))
        upright = shape.isin("vertical", "box") | ((t0 == t1) & (shape != "horizontal"))
        return F.when(upright, whole_low).otherwise(F.least(at(a), at(z))), F.when(upright, whole_high).otherwise(F.greatest(at(a), at(z)))

    cell = lambda t: F.floor(t / time_cell).cast("long")
    level = lambda p: F.floor(p / price_cell).cast("long")
    d = d.withColumn("tc", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    low, high = low_high(F.greatest(F.col("start"), F.col("tc") * time_cell), F.least(F.col("end"), (F.col("tc") + 1) * time_cell))
    d = d.withColumn("a", F.greatest(low, F.col("lowest"))).withColumn("z", F.least(high, F.col("highest"))).where("a <= z")
    # a cell more at each end, for what rounding moves over an edge
    d = d.withColumn("pc", F.explode(F.sequence(level(F.col("a") - 1e-9 * F.abs("a")), level(F.col("z") + 1e-9 * F.abs("z")))))
    b = b.select("symbol", "time", "low", "high", cell(F.col("time")).alias("tc"), F.explode(F.sequence(level(F.col("low")), level(F.col("high")))).alias("pc"))
    met = b.join(d.select("symbol", "drawing", "shape", "t0", "p0", "t1", "p1", "start", "end", "lowest", "highest", "tc", "pc"), ["symbol", "tc", "pc"])
    time = F.col("time")
    at_low, at_high = low_high(time, time)
    hit = time.between(F.col("start"), F.col("end")) & (at_low <= F.col("high")) & (at_high >= F.col("low"))
    return met.where(hit).select("symbol", "drawing", "shape", "time").distinct()


def _upright(shape, t0, p0, t1, p1, edge: Column, lower: bool) -> Column:
    """The end of an upright drawing: the bars' own edge where it goes on, else its anchors."""
    goes_on = (shape == "vertical") | (shape == "line") & (p0 != p1) | (shape == "ray") & (p1 < p0 if lower else p1 > p0)
    pick = F.least if lower else F.greatest
    return F.when(goes_on, edge).otherwise(pick(p0, p1))
