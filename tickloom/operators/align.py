"""Joins in time: equal times, as-of, nearest, and the splice of an archive with a live series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite


def first_per_time(df: DataFrame, key: str = "symbol", order: str | None = None) -> DataFrame:
    """Of the rows of one time the first (by ``order``)."""
    w = Window.partitionBy(key, "time").orderBy(order or "time")
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """(time, a, b): closes of two series at the times that both have."""
    x = first_per_time(a).select("time", F.col("close").alias("a"))
    y = first_per_time(b).select("time", F.col("close").alias("b"))
    return x.join(y, "time")


def _merged(probes: DataFrame, marks: DataFrame, key: str, value: str) -> DataFrame:
    left = probes.select(key, "time", F.struct(*probes.columns).alias("probe"), F.lit(None).cast(marks.schema[value].dataType).alias("mark"), F.lit(None).cast("long").alias("mark_time"), F.lit(1).alias("kind"))
    right = marks.select(key, "time", F.lit(None).cast(left.schema["probe"].dataType).alias("probe"), F.col(value).alias("mark"), F.col("time").alias("mark_time"), F.lit(0).alias("kind"))
    return left.unionByName(right)


def asof_backward(probes: DataFrame, marks: DataFrame, value: str, key: str = "symbol") -> DataFrame:
    """``probes`` with asof_<value> and asof_time of the last mark at or before each; null before the first. One shuffle, no range join."""
    w = Window.partitionBy(key).orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = _merged(probes, marks, key, value)
    seen = both.withColumn("b", F.last(F.when(F.col("kind") == 0, F.struct("mark", "mark_time")), True).over(w)).where("kind = 1")
    return seen.select("probe.*", F.col("b.mark").alias(f"asof_{value}"), F.col("b.mark_time").alias("asof_time"))


def asof_nearest(probes: DataFrame, marks: DataFrame, value: str, key: str = "symbol", block: int = 86_400) -> DataFrame:
    """``probes`` with the mark nearest in time; of two as near the earlier, and null for a probe without time.

    Rows meet by key and ``block`` of time, so one key is the work of many tasks. The last mark before a block
    and the first after it stand in the block too; they come from the ends of the blocks that have marks.
    """
    at = F.floor(F.col("time") / block).alias("block")
    mark = F.struct(F.col(value).alias("mark"), F.col("time").alias("mark_time"))
    own = marks.where("time is not null").select(key, at, mark.alias("m"))
    ends = own.groupBy(key, "block").agg(F.min_by("m", "m.mark_time").alias("first"), F.max_by("m", "m.mark_time").alias("last"))
    # a block of both kinds has two rows; its own marks among the edges change nothing
    blocks = probes.where("time is not null").select(key, at).distinct().unionByName(ends, allowMissingColumns=True)
    up, down = (Window.partitionBy(key).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("block"), F.desc("block")))
    edges = blocks.select(key, "block", F.array(F.last("last", True).over(up), F.last("first", True).over(down)).alias("ms")).select(key, "block", F.explode("ms").alias("m")).where("m is not null")
    right = own.unionByName(edges).select(key, "block", F.col("m.mark_time").alias("time"), "m", F.lit(0).alias("kind"))
    left = probes.select(key, at, "time", F.struct(*probes.columns).alias("probe"), F.lit(1).alias("kind"))
    # marks of a probe's own time stand before it, both up and down, so the later side has none of them; a frame that
    # ends at the last row instead would be gone through anew for each row
    w = Window.partitionBy(key, "block")
    up, down = (w.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in ((F.asc("time"), F.asc("kind")), (F.desc("time"), F.desc("kind"))))
    seen = left.unionByName(right, allowMissingColumns=True).withColumn("b", F.last("m", True).over(up)).withColumn("f", F.last("m", True).over(down)).where("kind = 1")
    earlier = F.col("f").isNull() | (F.col("b").isNotNull() & (F.col("time") - F.col("b.mark_time") <= F.col("f.mark_time") - F.col("time")))
    best = F.when(earlier, F.col("b")).otherwise(F.col("f"))
    return seen.select("probe.*", best.getField("mark").alias(f"near_{value}"), best.getField("mark_time").alias("near_time"))


def _numbered(bars: DataFrame, key: str) -> DataFrame:
    """(key, time, n, before, after): places from 0 and the times next to each."""
    w = Window.partitionBy(key).orderBy("time")
    return bars.select(key, "time").distinct().select(key, "time", (F.row_number().over(w) - 1).alias("n"), F.lag("time").over(w).alias("before"), F.lead("time").over(w).alias("after"))


def time_to_index(probes: DataFrame, bars: DataFrame, between: bool = True, key: str = "symbol") -> DataFrame:
    """``probes`` with the place of their time among the bars' times, counted from 0.

    Between two bars it is interpolated, beyond the ends it goes on at the step of the last two bars there;
    without ``between`` it is null unless a bar has just that time. A single bar is place 0 for all times,
    and without bars there is no place.
    """
    numbered = _numbered(bars, key)
    first = numbered.where("n = 0").select(key, F.col("time").alias("__t0"), F.col("after").alias("__t1"))
    marks = numbered.select(key, "time", F.struct("n", F.col("time").alias("at"), "before", "after").alias("bar"))
    placed = asof_backward(probes, marks, "bar", key).join(first, key, "left")
    at, time = F.col("asof_bar"), F.col("time").cast("double")
    step = F.coalesce(at.after - at["at"], at["at"] - at.before)
    inside = at.n + F.coalesce((time - at["at"]) / step, F.lit(0.0))
    ahead = F.when(F.col("__t0").isNotNull(), F.coalesce((time - F.col("__t0")) / (F.col("__t1") - F.col("__t0")), F.lit(0.0)))
    exact = F.when(at["at"] == time, at.n.cast("double"))
    place = F.when(at.isNull(), ahead).otherwise(inside) if between else exact
    return placed.withColumn("place", place).select(*probes.columns, "place")


def index_to_time(places: DataFrame, bars: DataFrame, place: str = "place", key: str = "symbol") -> DataFrame:
    """``places`` with the time (place_time) of a place among the bars' times: the way back from ``time_to_index``."""
    numbered = _numbered(bars, key)
    last = numbered.groupBy(key).agg(F.max("n").alias("__last"))
    base = F.greatest(F.least(F.floor(place), F.col("__last") - 1), F.lit(0)).cast("int")
    wanted = places.where(finite(F.col(place))).join(last, key, "left").withColumn("__n", base)
    bar = numbered.select(key, F.col("n").alias("__n"), F.col("time").alias("__at"), F.col("after").alias("__after"))
    found = wanted.join(bar, [key, "__n"], "left")
    time = F.col("__at") + F.coalesce((F.col(place) - F.col("__n")) * (F.col("__after") - F.col("__at")), F.lit(0.0))
    none = places.where(~finite(F.col(place))).withColumn("place_time", F.lit(None).cast("double"))
    return found.withColumn("place_time", time.cast("double")).select(*places.columns, "place_time").unionByName(none)


def neighbours(bars: DataFrame, time: int, span: int, key: str = "symbol") -> DataFrame:
    """Bars up to ``span`` places before or after the last bar at or before a time."""
    n = bars.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("time")))
    at = n.where(F.col("time") <= time).groupBy(key).agg(F.max("rn").alias("at"))
    return n.join(at, key).where(F.abs(F.col("rn") - F.col("at")) <= span).drop("at")


def coherence(history: DataFrame, live: DataFrame, period: int, price_tol: float = 0.001) -> DataFrame:
    """One row on how two series agree in the buckets that both have: n, mean gap of closes, relative to their level, upper median volume ratio, coherent."""
    b = F.floor(F.col("time") / period)
    h = history.groupBy(b.alias("b")).agg(F.max_by("close", "time").alias("hc"), F.max_by("volume", "time").alias("hv"))
    v = live.groupBy(b.alias("b")).agg(F.min_by("close", "time").alias("lc"), F.min_by("volume", "time").alias("lv"))
    both = h.join(v, "b").withColumn("r", F.when((F.col("hv") > 0) & (F.col("lv") > 0), F.col("lv") / F.nullif("hv", F.lit(0.0))))
    # the value of rank floor(n / 2) + 1 of n
    m = F.count("r")
    stats = both.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("lc") - F.col("hc"))).alias("gap"), F.avg(F.abs("hc")).alias("level"), m.alias("m"), F.sum(F.lit(0)).alias("z"))
    # counts of equal ratios are few rows next to the bars, and no row holds them all
    counts = both.where("r is not null").groupBy("r").count()
    rank = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    upper = counts.withColumn("upto", F.sum("count").over(rank)).join(F.broadcast(stats.select("m"))).where(F.col("upto") > F.floor(F.col("m") / 2)).agg(F.min("r").alias("median_ratio"))
    stats = stats.drop("z").join(F.broadcast(upper))
    rel = F.col("gap") / F.nullif("level", F.lit(0.0))
    fine = (F.col("n") == 0) | ((rel.isNull() | (rel <= price_tol)) & (F.col("median_ratio").isNull() | F.col("median_ratio").between(0.5, 2)))
    return stats.select("n", "gap", rel.alias("relative_gap"), "median_ratio", F.coalesce(fine, F.lit(False)).alias("coherent"))


DAY = 86_400


def usual_phase(history: DataFrame, period: int) -> DataFrame:
    """One row (phase): what most bars' times leave over a period; of equally usual ones the first seen. Null without bars."""
    phases = history.groupBy(F.pmod("time", F.lit(period)).alias("phase")).agg(F.count("*").alias("n"), F.min("time").alias("first"))
    return phases.agg(F.min_by("phase", F.struct(-F.col("n"), "first")).alias("phase"))


def _on_grid(history: DataFrame, live: DataFrame, period: int, by_bucket: bool, phase: int | None = None) -> DataFrame:
    """Live bars on the archive's usual phase; all of them where only the bucket counts or there is no archive."""
    if by_bucket:
        return live
    if phase is not None:
        return live.where(F.pmod("time", F.lit(period)) == phase)
    phase = usual_phase(history, period)
    return live.join(F.broadcast(phase)).where(F.col("phase").isNull() | (F.pmod("time", F.lit(period)) == F.col("phase"))).drop("phase")


def _buckets(history: DataFrame, live: DataFrame, period: int, precedence: str, diverging: str, by_bucket: bool | None, price_tol: float, phase: int | None = None) -> DataFrame:
    """A row for each bucket: b, h, v (bars of both sides), last (bucket of the archive), one (the only side taken, or null), coherent (null without common buckets)."""
    if precedence not in ("cut", "live", "archive"):
        raise ValueError(f"unknown precedence {precedence!r}")
    if diverging not in ("archive", "live", "merge"):
        raise ValueError(f"unknown side {diverging!r}")
    cols = ["open", "high", "low", "close", "volume"]
    bucket = F.floor(F.col("time") / period).alias("b")
    on_grid = _on_grid(history, live, period, period >= DAY if by_bucket is None else by_bucket, phase)
    row = F.struct("time", *cols)
    h = history.groupBy(bucket).agg(F.max_by(row, "time").alias("h"))
    v = on_grid.groupBy(bucket).agg(F.min_by(row, "time").alias("v"))
    last = h.agg(F.max("b").alias("last"))
    verdict = coherence(history, on_grid, period, price_tol).select(F.when(F.col("n") > 0, F.col("coherent")).alias("coherent"))
    one = F.when(~F.col("coherent") & F.lit(diverging != "merge"), F.lit(diverging)).alias("one")
    return h.join(v, "b", "full_outer").join(F.broadcast(last), F.lit(True), "left").join(F.broadcast(verdict.select("coherent", one)))


def splice(history: DataFrame, live: DataFrame, period: int, precedence: str = "cut", diverging: str = "archive", by_bucket: bool | None = None, price_tol: float = 0.001, phase: int | None = None) -> DataFrame:
    """Bars of an archive continued by a live series, one per bucket, with where each came from.

    Live bars off the archive's usual phase are dropped. ``cut``: live bars older than the archive's last
    bucket are dropped, and the live bar wins in that bucket; ``live``: live bars win; ``archive``: archive bars win.
    ``diverging``: what is taken where ``coherence`` finds the sources incompatible: ``archive`` or ``live`` alone
    (half a splice has a step at the seam), or ``merge`` them anyway. ``by_bucket`` (from a day on, if not given):
    the phase doesn't count, and a live bar that wins keeps the archive's time. ``phase``, if given, stands for the archive's usual one.
    """
    joined = _buckets(history, live, period, precedence, diverging, by_bucket, price_tol, phase)
    h, v, one = F.col("h"), F.col("v"), F.col("one")
    late = F.col("last").isNull() | (F.col("b") >= F.col("last"))
    taken = v.isNotNull() & (late if precedence == "cut" else F.lit(True))
    live_won = F.when(one == "live", True).when(one == "archive", False).otherwise(taken & h.isNull() if precedence == "archive" else taken)
    joined = joined.where(F.when(one == "live", v.isNotNull()).when(one == "archive", h.isNotNull()).otherwise(h.isNotNull() | taken))
    keeps = period >= DAY if by_bucket is None else by_bucket
    bar = v.withField("time", F.when(one.isNull(), h.getField("time")).otherwise(v.getField("time"))) if keeps else v
    bar = F.when(one.isNull() & h.isNotNull(), bar).otherwise(v)
    overlap = one.isNull() & h.isNotNull() & v.isNotNull()
    return joined.select(F.when(live_won, bar).otherwise(h).alias("w"), F.when(live_won, "live").otherwise("archive").alias("origin"), overlap.alias("overlap")).select("w.*", "origin", "overlap")


def splice_report(history: DataFrame, live: DataFrame, period: int, precedence: str = "cut", diverging: str = "archive", by_bucket: bool | None = None, price_tol: float = 0.001, gap_tol: int = 0, phase: int | None = None) -> DataFrame:
    """One row on a splice: seam (time of the first live bar used), bars by origin, live bars that overlap, fall to the cut or are off the grid, gap before the seam, the bar still forming, coherent."""
    j = _buckets(history, live, period, precedence, diverging, by_bucket, price_tol, phase)
    keeps = period >= DAY if by_bucket is None else by_bucket
    h, v = F.col("h").isNotNull(), F.col("v").isNotNull()
    used = v & (F.col("last").isNull() | (F.col("b") >= F.col("last")))
    taken = used if precedence == "cut" else v
    archive_time = h if keeps or precedence == "archive" else h & ~taken
    n = lambda c: F.count(F.when(c, 1))
    got = j.agg(
        F.first("one").alias("one"), F.first("coherent").alias("coherent"), n(h).alias("nh"), n(v).alias("nv"), n(h | taken).alias("bars"), n(taken & ~h).alias("fresh"), n(taken & h).alias("both"), n(v & ~taken).alias("cut"),
        F.min(F.when(used, F.col("v.time"))).alias("first_used"), F.min("v.time").alias("first_live"), F.max("v.time").alias("last_live"),
        F.max(F.when(h | taken, F.struct("b", used.alias("used"), F.when(archive_time, F.col("h.time")).otherwise(F.col("v.time")).alias("time")))).alias("top"),
    ).join(F.broadcast(live.agg(F.count("*").alias("given"))))
    before = history.join(F.broadcast(got.select("first_used"))).where(F.col("time") < F.col("first_used")).agg(F.max("time").alias("before"))
    one = F.col("one")

    def by_side(archive, live_, merged):
        return F.when(one == "archive", archive).when(one == "live", live_).otherwise(merged)

    no = F.lit(None).cast("long")
    gap = one.isNull() & (F.col("first_used") - F.col("before") > period + max(0, gap_tol))
    return got.join(F.broadcast(before)).select(
        by_side(no, F.col("first_live"), F.col("first_used")).alias("seam"),
        by_side(F.col("nh"), F.lit(0), F.col("bars") - F.col("fresh")).cast("long").alias("from_archive"),
        by_side(F.lit(0), F.col("nv"), F.col("fresh")).cast("long").alias("from_live"),
        by_side(F.lit(0), F.lit(0), F.col("both")).cast("long").alias("overlapping"),
        by_side(F.lit(0), F.lit(0), F.col("cut")).cast("long").alias("dropped_by_cut"),
        (F.col("given") - F.col("nv")).alias("off_grid"),
        F.when(gap, F.col("before") + period).alias("gap_from"),
        F.when(gap, F.col("first_used")).alias("gap_to"),
        by_side(no, F.col("last_live"), F.when(F.col("top.used"), F.col("top.time"))).alias("forming"),
        "coherent",
    )
