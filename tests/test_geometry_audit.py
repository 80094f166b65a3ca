"""Bars touched by drawings against all pairs, distances by plain geometry, audits by hand."""

import math
import random

from pyspark.sql import functions as F

from tickloom.operators import audit, geometry


def ends(d, t, lo, hi):
    """Lowest and highest price of a drawing at a time, or None; lo and hi stand for no end."""
    _, _, shape, t0, p0, t1, p1 = d
    if shape == "horizontal":
        return p0, p0
    if shape == "vertical":
        return (lo, hi) if t == t0 else None
    if shape == "box":
        return (min(p0, p1), max(p0, p1)) if min(t0, t1) <= t <= max(t0, t1) else None
    if t0 == t1:
        if t != t0:
            return None
        low, high = min(p0, p1), max(p0, p1)
        if p0 != p1 and (shape == "line" or shape == "ray" and p1 < p0):
            low = lo
        if p0 != p1 and (shape == "line" or shape == "ray" and p1 > p0):
            high = hi
        return low, high
    if shape == "segment" and not min(t0, t1) <= t <= max(t0, t1) or shape == "ray" and (t < t0 if t1 > t0 else t > t0):
        return None
    y = p0 + (p1 - p0) / float(t1 - t0) * (t - t0)
    return y, y


def test_touched_bars_equal_all_pairs(spark):
    rng = random.Random(6)
    bars = []
    for s in "AB":
        p = 50.0
        for i in range(150):
            p += rng.uniform(-2, 2)
            bars.append((s, 1000 + 60 * i, p - rng.uniform(0, 1), p + rng.uniform(0, 1)))
    drawings = []
    for i in range(120):
        t0, t1 = (rng.choice([1000 + 60 * rng.randrange(-40, 200), rng.randrange(0, 12_000)]) for _ in range(2))
        p0, p1 = rng.uniform(30, 70), rng.uniform(30, 70)
        if i % 5 == 0:
            t1 = t0
        if i % 11 == 0:
            p1 = p0
        drawings.append((rng.choice("AB"), i, rng.choice(geometry.SHAPES), t0, p0, t1, p1))
    odd = [("A", 900, "segment", 1000, float("nan"), 2000, 1.0), ("A", 901, "spiral", 1000, 50.0, 2000, 50.0), ("C", 902, "line", 1000, 50.0, 2000, 50.0), ("A", 903, "box", None, 0.0, 9000, 99.0)]
    more = [("A", 1, None, 1.0), ("A", 1060, float("nan"), 1.0), ("A", 1120, 5.0, 1.0)]
    b = spark.createDataFrame(bars + more, "symbol string, time long, low double, high double")
    d = spark.createDataFrame(drawings + odd, "symbol string, drawing int, shape string, t0 long, p0 double, t1 long, p1 double")
    want = []
    for dr in drawings:
        for s, t, low, high in bars:
            e = ends(dr, t, -1e9, 1e9) if s == dr[0] else None
            if e and e[0] <= high and e[1] >= low:
                want.append((s, dr[1], dr[2], t))
    for cells in ((600, 1.5), (100_000, 1000.0)):
        assert sorted(map(tuple, geometry.touched(b, d, *cells).collect())) == sorted(want)
    assert len({w[2] for w in want}) == 6
    plan = geometry.touched(b, d, 600, 1.5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_distances(spark):
    rows = [(3.0, 4.0, 0.0, 0.0, 6.0, 0.0), (9.0, 4.0, 0.0, 0.0, 6.0, 0.0), (-3.0, 4.0, 0.0, 0.0, 6.0, 0.0), (3.0, 4.0, 0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0, 6.0, 8.0)]
    df = spark.createDataFrame(rows, "px double, py double, ax double, ay double, bx double, by double")
    cols = [F.col(c) for c in df.columns]
    got = df.select(geometry.distance_to_segment(*cols), geometry.distance_to_ray(*cols), geometry.distance_to_line(*cols), geometry.distance_to_outline(*cols)).collect()
    want = [(4, 4, 4, 4), (5, 4, 4, 5), (5, 5, 4, 5), (5, 5, 5, 5), (0.2, 0.2, 0.2, 1)]
    assert [[round(x, 9) for x in r] for r in got] == [list(map(float, w)) for w in want]
    ok = df.select(geometry.valid_anchor(F.lit(1), F.lit(float("nan"))), geometry.valid_anchor(F.lit(None), F.lit(1.0)), geometry.valid_anchor(F.lit(1), F.lit(2.0))).first()
    assert tuple(ok) == (False, False, True)


DAY = 86_400


def test_settlement(spark):
    bars = [(s, i * DAY, 100.0 + i) for s in ("same", "near", "far", "none") for i in range(10)]
    official = [(s, f"1970-01-{i + 1:02d}", (100.0 + i) * f, q) for s, f in (("same", 1.0), ("near", 1.0005), ("far", 1.01)) for i in range(8) for q in (2.0,)]
    official += [("same", "1970-01-03", 7.0, 1.0), ("same", None, 7.0, 9.0), ("same", "1970-01-04", None, 9.0)]
    got = {r.symbol: r for r in audit.settlement(spark.createDataFrame(bars, "symbol string, time long, close double"), spark.createDataFrame(official, "symbol string, day string, last_price double, traded_qty double")).collect()}
    assert {s: (r.status, r.n) for s, r in got.items()} == {"same": ("OK", 8), "near": ("WARN", 8), "far": ("FAIL", 8), "none": ("WARN", 0)}
    assert got["far"].examples == [0, DAY, 2 * DAY] and got["near"].examples == [] and math.isclose(got["far"].value, 1 - 1 / 1.01)


def test_agreement(spark):
    kind = "symbol string, time long, close double, volume double"
    a = [("A", 60 * i, 100.0, 10.0) for i in range(10)] + [("B", 60 * i, 100.0, 0.0) for i in range(10)] + [("C", 0, 1.0, 1.0)]
    v = [("A", 60 * i + 5, 100.0 + (i == 7) * 3, 340.0) for i in range(10)] + [("B", 60 * i, 100.1, 10.0) for i in range(5, 15)] + [("C", 600, 1.0, 1.0)]
    got = {(r.symbol, r.check): (r.status, r.n, r.examples) for r in audit.agreement(spark.createDataFrame(a, kind), spark.createDataFrame(v, kind), 60).collect()}
    assert got["A", "coverage"] == ("OK", 10, []) and got["A", "close"] == ("FAIL", 10, [425]) and got["A", "volume"] == ("FAIL", 10, [5, 65, 125])
    assert got["B", "coverage"][:2] == ("FAIL", 5) and got["B", "close"][0] == "OK" and got["B", "volume"] == ("WARN", 0, [])
    assert {got["C", c][0] for c in ("coverage", "close", "volume")} == {"WARN"}
