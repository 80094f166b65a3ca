"""Order-book and execution grids: zoom, colour scales, footprints, volume profiles, walls, ladders, coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, group_price


def clean(c: str) -> Column:
    """A quantity: what isn't a finite positive number counts as zero."""
    return F.when(finite(F.col(c)) & (F.col(c) > 0), F.col(c).cast("double")).otherwise(F.lit(0.0))


def with_indices(cells: DataFrame) -> DataFrame:
    """Cells with ti and pi, their places on the axes of times and prices.

    Axes are distinct values, numbered once each and joined back: no window over all cells.
    """
    t = cells.select("ts_ms").distinct().withColumn("ti", F.row_number().over(Window.orderBy("ts_ms")) - 1)
    p = cells.select("price").distinct().withColumn("pi", F.row_number().over(Window.orderBy("price")) - 1)
    return cells.join(t, "ts_ms").join(p, "price")


def zoom_factor(min_px: float, px: float, visible: float, axis: int) -> int:
    """How many units of an axis one drawn cell takes."""
    per_unit = px / max(1, int(visible))
    return min(max(-int(-min_px // per_unit), 1), max(axis, 1))


def zoom(cells: DataFrame, time_factor: int, price_factor: int) -> DataFrame:
    """Cells grouped by factors: the largest bid and ask, the sums of buys and sells; labelled by first time and middle price."""
    g = with_indices(cells).withColumn("bt", F.floor(F.col("ti") / time_factor)).withColumn("bp", F.floor(F.col("pi") / price_factor))
    return g.groupBy("bt", "bp").agg(
        F.min("ts_ms").alias("ts_ms"),
        ((F.min("price") + F.max("price")) / 2).alias("price"),
        F.max(clean("bid")).alias("bid"),
        F.max(clean("ask")).alias("ask"),
        F.sum(clean("buy")).alias("buy"),
        F.sum(clean("sell")).alias("sell"),
    )


def zoom_within(cells: DataFrame, window: tuple[int, int, float, float], px: tuple[float, float], visible: tuple[int, int], min_px: float, max_cells: int) -> tuple[DataFrame, int, int]:
    """Zoom of the cells in a window (from, to in time, from, to in price) to at most ``max_cells``; the factors as well.

    If there are too many, the least size of a drawn cell doubles, up to 12 times; all tries are counted in one job.
    """
    t0, t1, p0, p1 = window
    seen = with_indices(cells).where(F.col("ts_ms").between(t0, t1) & F.col("price").between(p0, p1))
    axes = cells.agg(F.count_distinct("ts_ms").alias("t"), F.count_distinct("price").alias("p")).first()
    tries = [(zoom_factor(min_px * 2**k, px[0], visible[0], axes.t), zoom_factor(min_px * 2**k, px[1], visible[1], axes.p)) for k in range(13)]
    counts = seen.agg(*(F.count_distinct(F.floor(F.col("ti") / a), F.floor(F.col("pi") / b)).alias(f"n{k}") for k, (a, b) in enumerate(tries))).first()
    for k, (a, b) in enumerate(tries):
        if counts[k] <= max_cells:
            return zoom(seen.select(*cells.columns), a, b), a, b
    return zoom(seen.select(*cells.columns).limit(0), *tries[-1]), *tries[-1]


def _positive(cells: DataFrame, columns) -> DataFrame:
    each = (c if isinstance(c, Column) else F.col(c) for c in columns)
    return cells.select(F.explode(F.array(*(c.cast("double") for c in each))).alias("v")).where(finite(F.col("v")) & (F.col("v") > 0))


def positive_quantile(cells: DataFrame, q: float, *columns: str | Column) -> DataFrame:
    """One row (value): of the positive values of columns the one of rank ceil(q n); 0 if there are none. ``q`` is held to 0 and 1."""
    q = min(max(q, 0.0), 1.0) if math.isfinite(q) else 0.5
    return _positive(cells, columns).agg(F.coalesce(F.expr(f"percentile_disc({q!r}D) WITHIN GROUP (ORDER BY v)"), F.lit(0.0)).alias("value"))


def above_scale(v: Column, p50: Column, p99: Column) -> Column:
    """Whether a value lies past the end of a scale that has two ends."""
    return F.coalesce(finite(v) & (p99 > p50) & (v > p99), F.lit(False))


def has_variation(p50: Column, p99: Column) -> Column:
    return F.coalesce(p99 > p50, F.lit(False))


def color_scale(cells: DataFrame, *columns: str | Column, low: float = 0.18, high: float = 0.92, gamma: float = 0.5) -> DataFrame:
    """One row: p50 and p99 (values that occur, of rank ceil(q n)) of the positive values of columns (or of sums and differences of them), and how to shade."""
    return _positive(cells, columns).agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("p50"),
        F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY v)").alias("p99"),
        F.count("*").alias("n"),
    ).select("p50", "p99", "n", F.lit(low).alias("alpha_min"), F.lit(high).alias("alpha_max"), F.lit(min(max(gamma, 0.05), 8.0)).alias("gamma"))


def alpha_of(v: Column, p50: Column, p99: Column, low: float = 0.18, high: float = 0.92, gamma: float = 0.5) -> Column:
    """Opacity of a value: from ``low`` at p50 to ``high`` at p99; none for what isn't positive."""
    t = F.least(F.greatest((v - p50) / F.nullif(p99 - p50, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    flat = F.when(v >= p99, F.lit(high)).otherwise(F.lit(low))
    return F.when(~(v > 0), F.lit(0.0)).when(p99 > p50, low + (high - low) * F.pow(t, F.lit(gamma))).otherwise(flat)


def footprint(cells: DataFrame, candles: DataFrame, step: float, least: float = 0.02, most: int = 40) -> DataFrame:
    """Price levels per candle of executed cells, with candle totals, the largest level, and what is pruned left out.

    candles: (time) in seconds; each lasts to the next. Totals are taken before pruning.
    """
    done = cells.select(F.lit("x").alias("symbol"), F.floor(F.col("ts_ms") / 1000).cast("long").alias("time"), group_price(F.col("price"), step).alias("level"), clean("buy").alias("buy"), clean("sell").alias("sell")).where("buy > 0 or sell > 0")
    marks = candles.select(F.lit("x").alias("symbol"), "time", F.col("time").alias("candle"))
    from .align import asof_backward

    # only distinct times go through the window by one key, not all cells
    times = asof_backward(done.select("symbol", "time").distinct(), marks, "candle").where("asof_candle is not null").select("time", "asof_candle")
    placed = done.groupBy("time", "level").agg(F.sum("buy").alias("buy"), F.sum("sell").alias("sell")).join(times, "time")
    levels = placed.groupBy(F.col("asof_candle").alias("candle"), F.col("level").alias("price")).agg(F.sum("buy").alias("buy"), F.sum("sell").alias("sell"))
    levels = levels.withColumn("total", F.col("buy") + F.col("sell")).withColumn("delta", F.col("buy") - F.col("sell"))
    w = Window.partitionBy("candle")
    ranked = (
        levels.withColumn("candle_buy", F.sum("buy").over(w)).withColumn("candle_sell", F.sum("sell").over(w)).withColumn("max_total", F.max("total").over(w))
        .withColumn("poc", F.max_by("price", F.struct(F.col("total"), -F.col("price"))).over(w))
        .where(F.col("total") >= least * F.col("max_total"))
        .withColumn("rank", F.row_number().over(w.orderBy(F.desc("total"), "price")))
        .where(F.col("rank") <= most)
    )
    return ranked.withColumn("imbalance", F.col("delta") / F.nullif("total", F.lit(0.0))).drop("rank")


def diagonal_imbalance(levels: DataFrame, factor: float = 3.0) -> DataFrame:
    """Listed levels whose buys are ``factor`` times the sells one level down, or that those sells outweigh as much."""
    w = Window.partitionBy("candle").orderBy("price")
    below = levels.withColumn("sell_below", F.lag("sell").over(w))
    buy = (F.col("buy") > 0) & (F.col("buy") >= factor * F.col("sell_below"))
    sell = (F.col("sell_below") > 0) & (F.col("sell_below") >= factor * F.col("buy"))
    return below.where("sell_below is not null").select("candle", "price", F.coalesce(buy, F.lit(False)).alias("buy_side"), F.coalesce(sell, F.lit(False)).alias("sell_side")).where("buy_side or sell_side")


#: How many ticks a row of prices may hold.
ROW_TICKS = [1, 2, 5, 10, 25, 50, 100, 250, 500, 1000]


def zoom_step(ticks: float, height: float, tick: float, row: float = 11.0) -> float:
    """Price step of rows at least ``row`` high where ``ticks`` share ``height``; 0 if each tick has room or a size isn't positive."""
    if not all(math.isfinite(x) and x > 0 for x in (ticks, height, tick)):
        return 0.0
    rows = max(1, math.floor(height / row))
    return 0.0 if ticks <= rows else next((p for p in ROW_TICKS if p * rows >= ticks), ROW_TICKS[-1]) * tick


def footprint_totals(levels: DataFrame) -> DataFrame:
    """One row on a footprint's listed levels: candles, levels, buy, sell, delta and the side that it leans to."""
    by_candle = levels.groupBy("candle").agg(F.first("candle_buy").alias("buy"), F.first("candle_sell").alias("sell"), F.count("*").alias("levels"))
    total = by_candle.agg(F.count("*").alias("candles"), F.coalesce(F.sum("levels"), F.lit(0)).alias("levels"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("buy", "sell")))
    delta = F.col("buy") - F.col("sell")
    return total.withColumn("delta", delta).withColumn("side", F.when(delta > 0, "buyer").when(delta < 0, "seller").otherwise("even"))


def volume_profile(cells: DataFrame, step: float = 0.0, window: tuple[int, int] | None = None) -> DataFrame:
    """(price, buy, sell, total, delta) of all executed cells, or of those from the first to the last time of a window."""
    g = (cells if window is None else cells.where(F.col("ts_ms").between(*window))).groupBy(group_price(F.col("price"), step).alias("price")).agg(F.sum(clean("buy")).alias("buy"), F.sum(clean("sell")).alias("sell"))
    return g.withColumn("total", F.col("buy") + F.col("sell")).withColumn("delta", F.col("buy") - F.col("sell")).where("total > 0")


def profile_summary(profile: DataFrame) -> DataFrame:
    """One row (levels, total, largest, poc, reason): of levels as large the lowest price; a reason where there is no level."""
    top = F.max_by("price", F.struct(F.col("total"), -F.col("price")))
    s = profile.agg(F.count("*").alias("levels"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.coalesce(F.max("total"), F.lit(0.0)).alias("largest"), top.alias("poc"))
    return s.withColumn("reason", F.when(F.col("levels") == 0, "nothing was executed in the window"))


def binned(profile: DataFrame, bins: int = 50) -> DataFrame:
    """A profile in 10 to 150 rows of equal width, at their centres; as it is if it has no more rows than that."""
    bins = min(max(bins, 10), 150)
    edge = profile.agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.count("*").alias("levels"))
    width = (F.col("hi") - F.col("lo")) / bins
    row = F.least(F.floor((F.col("price") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    centre = F.when(F.col("levels") <= bins, F.col("price")).otherwise(F.col("lo") + (row + 0.5) * width)
    return profile.join(F.broadcast(edge), F.lit(True)).groupBy(centre.alias("price")).agg(*(F.sum(c).alias(c) for c in ("buy", "sell", "total", "delta")))


def value_area(profile: DataFrame, fraction: float = 0.7) -> DataFrame:
    """One row (poc, val, vah, volume): from the largest level (the lowest of equals) to the larger neighbour, up if equal, until ``fraction`` is in.

    Growing by the larger neighbour takes levels in an order that windows can tell: a level is reached, from
    its side, when the smallest level between it and the largest one is; so sides are merged by running minima.
    """
    fraction = min(max(fraction, 0.1), 0.95)
    top = profile.agg(F.max_by(F.struct("price", "total"), F.struct(F.col("total"), -F.col("price"))).alias("poc"), F.sum("total").alias("whole"))
    p = profile.join(F.broadcast(top), F.lit(True)).withColumn("up", F.col("price") > F.col("poc.price")).withColumn("away", F.abs(F.col("price") - F.col("poc.price")))
    side = Window.partitionBy("up").orderBy("away").rowsBetween(Window.unboundedPreceding, 0)
    # of two levels in wait the larger goes first: sorted by the running minimum of totals, falling; a side keeps its own order
    order = Window.orderBy(F.desc("least"), F.desc("up"), "away")
    taken = (
        p.where("away > 0").withColumn("least", F.min("total").over(side))
        .withColumn("before", F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.col("poc.total"))
        .where(F.col("before") < fraction * F.col("whole"))
    )
    reach = taken.agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.sum("total").alias("more"))
    return top.join(reach, F.lit(True)).select(
        F.col("poc.price").alias("poc"), F.least("lo", "poc.price").alias("val"), F.greatest("hi", "poc.price").alias("vah"), (F.coalesce("more", F.lit(0.0)) + F.col("poc.total")).alias("volume")
    )


def ladder(cells: DataFrame, latest: bool = True) -> DataFrame:
    """(price, bid, ask): the last time with a positive quantity, or all times."""
    q = cells.select("ts_ms", "price", clean("bid").alias("bid"), clean("ask").alias("ask")).where("bid > 0 or ask > 0")
    if latest:
        q = q.join(F.broadcast(q.agg(F.max("ts_ms").alias("ts_ms"))), "ts_ms")
    return q.groupBy("price").agg(F.sum("bid").alias("bid"), F.sum("ask").alias("ask"))


def walls(cells: DataFrame, current: float, least: float = 100.0, run: int = 3, window: int = 5, most: int = 4) -> DataFrame:
    """Prices with a large resting quantity over consecutive times, the nearest few above and below the current price.

    Runs of consecutive times come from the place of a time less the row's number; the trend compares the
    mean of the last ``window`` rows with that of as many before.
    """
    cells = with_indices(cells)
    sides = cells.select("price", "ti", F.explode(F.array(F.struct(F.lit("BID").alias("side"), clean("bid").alias("q")), F.struct(F.lit("ASK").alias("side"), clean("ask").alias("q")))).alias("s")).select("price", "ti", "s.side", "s.q")
    limit = sides.where("q > 0").agg(F.greatest(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY q)"), F.lit(least)).alias("limit"))
    island = Window.partitionBy("price", "side").orderBy("ti")
    runs = sides.where("q > 0").withColumn("island", F.col("ti") - F.row_number().over(island)).groupBy("price", "side", "island").agg(F.count("*").alias("n"), F.max("q").alias("q"))
    found = runs.where(F.col("n") >= run).groupBy("price", "side").agg(F.max("q").alias("quantity")).join(F.broadcast(limit), F.lit(True)).where(F.col("quantity") >= F.col("limit")).where(F.col("price") != current)
    back = F.row_number().over(Window.partitionBy("price", "side").orderBy(F.desc("ti")))
    trend = sides.withColumn("r", back).groupBy("price", "side").agg(
        F.avg(F.when(F.col("r") <= window, F.col("q"))).alias("late"), F.avg(F.when((F.col("r") > window) & (F.col("r") <= 2 * window), F.col("q"))).alias("early"), F.count("*").alias("rows")
    )
    change = F.when(F.col("rows") < 2 * window, 0.0).when(F.col("early") > 0, 100 * (F.col("late") - F.col("early")) / F.nullif("early", F.lit(0.0))).when(F.col("late") > 0, 1000.0).otherwise(0.0)
    above = F.col("price") > current
    out = found.join(trend, ["price", "side"]).withColumn("change", change).withColumn("distance", F.abs(F.col("price") - current)).withColumn("above", above)
    k = F.row_number().over(Window.partitionBy("above").orderBy("distance", F.desc("quantity"), F.desc("side")))
    name = F.when(F.col("change") > 15, "GROWING").when(F.col("change") < -15, "WITHDRAWING").otherwise("STABLE")
    return out.withColumn("k", k).where(F.col("k") <= most).select("price", "side", "quantity", "distance", "above", "change", name.alias("trend"))


def coverage_view(days: DataFrame, bucket_ms: int) -> DataFrame:
    """Hatched parts of days whose executions are missing: (…, class, hatched array of from, to).

    days: queue_from, queue_to, exec_from, exec_to in ms. A gap before the first execution is hatched from one bucket on.
    """
    q0, q1, e0, e1 = (F.col(c) for c in ("queue_from", "queue_to", "exec_from", "exec_to"))
    kind = F.when(q0.isNull() & e0.isNull(), "EMPTY").when(e0.isNull(), "QUEUE_ONLY").when((e0 > q0 + bucket_ms) | (e1 < q1 - bucket_ms), "PARTIAL").otherwise("COMPLETE")
    gaps = F.array(
        F.when(e0.isNull() & q0.isNotNull(), F.struct(q0.alias("from"), q1.alias("to"))),
        F.when(e0 - q0 >= bucket_ms, F.struct(q0.alias("from"), e0.alias("to"))),
        F.when(q1 - e1 >= bucket_ms, F.struct(e1.alias("from"), q1.alias("to"))),
    )
    return days.withColumn("class", kind).withColumn("hatched", F.filter(gaps, lambda x: x.isNotNull()))


def histogram_limit(values: DataFrame, column: str, q: float = 99.0) -> DataFrame:
    """One row (ceiling, n, over): the percentile of positive values if there are enough of them, else their maximum."""
    v = values.select(F.col(column).cast("double").alias("v")).where(finite(F.col("v")) & (F.col("v") > 0))
    enough = max(20, int(-(-100 // (100 - q))) + 1)
    top = v.agg(F.count("*").alias("n"), F.max("v").alias("m"), F.expr(f"percentile_disc({q / 100}) WITHIN GROUP (ORDER BY v)").alias("p")).select("n", F.when(F.col("n") >= enough, F.col("p")).otherwise(F.col("m")).alias("ceiling"))
    return v.join(F.broadcast(top), F.lit(True)).groupBy("ceiling", "n").agg(F.count(F.when(F.col("v") > F.col("ceiling"), 1)).alias("over"))


def encode_columnar(cells: DataFrame) -> DataFrame:
    """One row per grid key with axes and parallel columns; cells of four zeros are left out. cells: (grid, ts_ms, price, ...), one grid fits a row."""
    live = cells.where((F.col("bid") != 0) | (F.col("ask") != 0) | (F.col("buy") != 0) | (F.col("sell") != 0))
    g = live.groupBy("grid").agg(F.sort_array(F.collect_set("ts_ms")).alias("t"), F.sort_array(F.collect_set("price")).alias("p"), F.sort_array(F.collect_list(F.struct("ts_ms", "price", "bid", "ask", "buy", "sell"))).alias("c"))
    place = lambda axis, field: F.transform("c", lambda x: (F.array_position(axis, x[field]) - 1).cast("int"))
    return g.select("grid", F.struct("t", "p").alias("axes"), F.struct(place("t", "ts_ms").alias("ti"), place("p", "price").alias("pi"), F.col("c.bid").alias("b"), F.col("c.ask").alias("a"), F.col("c.buy").alias("c"), F.col("c.sell").alias("v")).alias("columns"))


def decode_columnar(grids: DataFrame) -> DataFrame:
    """Cells of encoded grids; a grid with anything wrong (axes not rising, lengths apart, places out of range, values that are no numbers) gives none."""
    def rising(a):
        return F.forall(F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x < y), lambda ok: F.coalesce(ok, F.lit(False)))

    t, p = F.col("axes.t"), F.col("axes.p")
    n = F.size("columns.ti")
    same = F.lit(True)
    for c in ("pi", "b", "a", "c", "v"):
        same = same & (F.size(f"columns.{c}") == n)
    inside = F.forall("columns.ti", lambda i: (i >= 0) & (i < F.size(t))) & F.forall("columns.pi", lambda i: (i >= 0) & (i < F.size(p)))
    numbers = F.lit(True)
    for c in ("b", "a", "c", "v"):
        numbers = numbers & F.forall(f"columns.{c}", finite)
    numbers = numbers & F.forall(t, finite) & F.forall(p, finite)
    good = grids.where(rising(t) & rising(p) & same & inside & numbers)
    z = F.arrays_zip(*(F.col(f"columns.{c}").alias(c) for c in ("ti", "pi", "b", "a", "c", "v")))
    return good.select("grid", "axes", F.explode(z).alias("z")).select(
        "grid", F.element_at("axes.t", F.col("z.ti") + 1).alias("ts_ms"), F.element_at("axes.p", F.col("z.pi") + 1).alias("price"), F.col("z.b").alias("bid"), F.col("z.a").alias("ask"), F.col("z.c").alias("buy"), F.col("z.v").alias("sell")
    )
