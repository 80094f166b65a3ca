"""All indicators of the catalogue as steps over closed bars, for streams: what the windows give in batch, bar by bar.

A step is made of parts that each hold a few numbers and queues: running sums with their rounding errors,
sliding extremes as monotonic queues, recursive averages. ``dump`` lists a step's numbers and queues and ``load`` takes
them back, so the state that Spark keeps is typed and small: at most a window's values for each part.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

from ..operators.indicators import LEVELS, REGISTRY, settings
from ..operators.state import AdaptiveAverage, ParabolicSar, SuperTrend

NONE = math.nan  # in a state, of a number that isn't there yet


class Part:
    """Numbers and queues under the names in ``numbers`` and ``queues``."""

    numbers: tuple[str, ...] = ()
    queues: tuple[str, ...] = ()

    def dump(self, numbers: list, queues: list) -> None:
        numbers.extend(NONE if (v := getattr(self, k)) is None else float(v) for k in self.numbers)
        queues.extend([NONE if v is None else float(v) for v in getattr(self, k)] for k in self.queues)

    def load(self, numbers, queues) -> None:
        for k in self.numbers:
            v = next(numbers)
            setattr(self, k, None if v != v else v)
        for k in self.queues:
            q = getattr(self, k)
            q.clear()
            q.extend(None if v != v else v for v in next(queues))


class Total(Part):
    """A running sum with what rounding left out; ``add`` may take away as well."""

    numbers = ("sum", "rest")

    def __init__(self):
        self.sum = self.rest = 0.0

    def add(self, x: float) -> float:
        s = self.sum + x
        self.rest += (self.sum - s) + x if abs(self.sum) >= abs(x) else (x - s) + self.sum
        self.sum = s
        return self.value

    @property
    def value(self) -> float:
        return self.sum + self.rest


class Lag(Part):
    """What came n rows before, None included."""

    queues = ("last",)

    def __init__(self, n: int = 1):
        self.n, self.last = n, deque()

    def __call__(self, x):
        self.last.append(x)
        return self.last.popleft() if len(self.last) > self.n else None


class Held(Part):
    """One number, set by its owner."""

    numbers = ("x",)

    def __init__(self, x=None):
        self.x = x


class Window(Part):
    """The last n numbers; a missing one is passed over and gives nothing."""

    queues = ("last",)

    def __init__(self, n: int):
        self.n, self.last = n, deque()

    def __call__(self, x):
        if x is None:
            return None
        gone = None
        if len(self.last) == self.n:
            gone = self.last.popleft()
        self.last.append(x)
        return self.value(x, gone)

    def value(self, x, gone):
        raise NotImplementedError

    @property
    def full(self) -> bool:
        return len(self.last) == self.n


class Sum(Window):
    def __init__(self, n: int):
        super().__init__(n)
        self.total = Total()

    def dump(self, numbers, queues):
        super().dump(numbers, queues)
        self.total.dump(numbers, queues)

    def load(self, numbers, queues):
        super().load(numbers, queues)
        self.total.load(numbers, queues)

    def value(self, x, gone):
        if gone is not None:
            self.total.add(-gone)
        self.total.add(x)
        return self.total.value if self.full else None


class Mean(Sum):
    def value(self, x, gone):
        s = super().value(x, gone)
        return None if s is None else s / self.n


class Deviation(Window):
    """Population standard deviation, from the window itself: squares would lose digits."""

    def value(self, x, gone):
        if not self.full:
            return None
        m = math.fsum(self.last) / self.n
        return math.sqrt(math.fsum((v - m) ** 2 for v in self.last) / self.n)


class Spread(Window):
    """(mean, mean distance from it)."""

    def value(self, x, gone):
        if not self.full:
            return None
        m = math.fsum(self.last) / self.n
        return m, math.fsum(abs(v - m) for v in self.last) / self.n


class Weighed(Sum):
    """(sum weighed 1 for the oldest up to n, plain sum), by two running sums."""

    def __init__(self, n: int):
        super().__init__(n)
        self.weighed = Total()

    def dump(self, numbers, queues):
        super().dump(numbers, queues)
        self.weighed.dump(numbers, queues)

    def load(self, numbers, queues):
        super().load(numbers, queues)
        self.weighed.load(numbers, queues)

    def value(self, x, gone):
        before = self.total.value
        s = super().value(x, gone)
        if gone is not None:  # each weight falls by one, and the oldest goes with its own of one
            self.weighed.add(-before)
        self.weighed.add(len(self.last) * x)
        return None if s is None else (self.weighed.value, s)


class Extreme(Part):
    """(greatest, its row) of the last n: a queue of falling values; of equal ones the latest. Least, with ``sign`` -1."""

    numbers = ("row",)
    queues = ("rows", "values")

    def __init__(self, n: int, sign: int):
        self.n, self.sign, self.row, self.rows, self.values = n, sign, 0, deque(), deque()

    def at(self, x):
        if x is None:
            return None
        self.row += 1
        while self.values and self.sign * self.values[-1] <= self.sign * x:
            self.values.pop(), self.rows.pop()
        self.values.append(x), self.rows.append(self.row)
        if self.rows[0] <= self.row - self.n:
            self.values.popleft(), self.rows.popleft()
        return (self.values[0], self.rows[0]) if self.row >= self.n else None

    def __call__(self, x):
        found = self.at(x)
        return None if found is None else found[0]


class Smooth(Part):
    """e += k (x - e), from the mean of the first n."""

    numbers = ("seen", "e")

    def __init__(self, n: int, k: float):
        self.n, self.k, self.head, self.seen, self.e = n, k, Total(), 0, None

    def dump(self, numbers, queues):
        super().dump(numbers, queues)
        self.head.dump(numbers, queues)

    def load(self, numbers, queues):
        super().load(numbers, queues)
        self.head.load(numbers, queues)

    def __call__(self, x):
        if x is None:
            return None
        self.seen += 1
        if self.seen <= self.n:
            self.head.add(x)
            if self.seen < self.n:
                return None
            self.e = self.head.value / self.n
        else:
            self.e += self.k * (x - self.e)
        return self.e


class Whole(Part):
    """A step of ``operators.state`` as a part: its own fields, flattened."""

    def __init__(self, step, get: Callable, put: Callable):
        self.step, self.get, self.put = step, get, put

    def dump(self, numbers, queues):
        queues.append([NONE if v is None else float(v) for v in self.get(self.step)])

    def load(self, numbers, queues):
        self.put(self.step, [None if v != v else v for v in next(queues)])


# ---- one step for each indicator: parts are made through ``p``, which lists them

STEPS: dict[str, Callable] = {}


def step(f: Callable) -> Callable:
    STEPS[f.__name__.rstrip("_")] = f
    return f


def price(b: dict, src: str) -> float:
    if src == "hl2":
        return (b["high"] + b["low"]) / 2
    if src == "hlc3":
        return (b["high"] + b["low"] + b["close"]) / 3
    if src == "ohlc4":
        return (b["open"] + b["high"] + b["low"] + b["close"]) / 4
    return b[src]


def over(a, b):
    """a / b; nothing where either is missing or b is zero."""
    return None if a is None or b is None or b == 0 else a / b


def less(a, b):
    return None if a is None or b is None else a - b


def vol(b: dict) -> float:
    return b["volume"] or 0.0


def positive_vol(b: dict) -> float:
    v = b["volume"]
    return v if v is not None and v > 0 else 0.0


def ema_(p, n):
    return p(Smooth(n, 2 / (n + 1)))


def rma_(p, n):
    return p(Smooth(n, 1 / n))


def wma_(p, n):
    w = p(Weighed(n))

    def f(x):
        found = w(x)
        return None if found is None else found[0] / (n * (n + 1) / 2)

    return f


def range_(p):
    before = p(Lag())

    def f(b):
        c = before(b["close"])
        span = b["high"] - b["low"]
        return span if c is None else max(span, abs(b["high"] - c), abs(b["low"] - c))

    return f


def half(n: float) -> int:
    return max(1, int(n + 0.5))


@step
def sma(p, n, src):
    m = p(Mean(n))
    return lambda b: (m(price(b, src)),)


@step
def ema(p, n, src):
    e = ema_(p, n)
    return lambda b: (e(price(b, src)),)


@step
def wma(p, n, src):
    w = wma_(p, n)
    return lambda b: (w(price(b, src)),)


@step
def rma(p, n, src):
    e = rma_(p, n)
    return lambda b: (e(price(b, src)),)


@step
def dema(p, n, src):
    e1, e2 = ema_(p, n), ema_(p, n)

    def f(b):
        one = e1(price(b, src))
        return (less(None if one is None else 2 * one, e2(one)),)

    return f


@step
def tema(p, n, src):
    e1, e2, e3 = ema_(p, n), ema_(p, n), ema_(p, n)

    def f(b):
        one = e1(price(b, src))
        two = e2(one)
        three = e3(two)
        return (None if three is None else 3 * one - 3 * two + three,)

    return f


@step
def hma(p, n, src):
    short, full, last = wma_(p, half(n / 2)), wma_(p, n), wma_(p, half(n**0.5))

    def f(b):
        a, c = short(price(b, src)), full(price(b, src))
        return (last(None if a is None or c is None else 2 * a - c),)

    return f


@step
def vwma(p, n, src):
    flow, volume = p(Sum(n)), p(Sum(n))

    def f(b):
        a, v = flow(price(b, src) * positive_vol(b)), volume(positive_vol(b))
        return (a / v if v is not None and v > 0 else None,)

    return f


@step
def lsma(p, n, src):
    if n < 2:
        return lambda b: (price(b, src), 0.0)
    w = p(Weighed(n))

    def f(b):
        found = w(price(b, src))
        if found is None:
            return None, None
        mean = found[1] / n
        slope = (found[0] - n * (n + 1) / 2 * mean) / (n * (n * n - 1) / 12)
        return mean + slope * (n - 1) / 2, slope

    return f


@step
def trix(p, n, signal, src):
    e1, e2, e3, last, s = ema_(p, n), ema_(p, n), ema_(p, n), p(Lag()), ema_(p, signal)

    def f(b):
        three = e3(e2(e1(price(b, src))))
        before = last(three)
        value = over(None if before is None else 100 * (three - before), before)
        return value, s(value)

    return f


def gains(p, n, src):
    up, down, last = rma_(p, n), rma_(p, n), p(Lag())

    def f(b):
        x = price(b, src)
        before = last(x)
        if before is None:
            return None, None
        return up(max(x - before, 0.0)), down(max(before - x, 0.0))

    return f


@step
def rsi(p, n, src):
    g = gains(p, n, src)

    def f(b):
        up, down = g(b)
        if down is None:
            return (None,)
        return ((50.0 if up == 0 else 100.0) if down == 0 else 100 - 100 / (1 + up / down),)

    return f


def ends(p, n):
    hi, lo = p(Extreme(n, 1)), p(Extreme(n, -1))
    return lambda b: (hi(b["high"]), lo(b["low"]))


@step
def stochastic(p, n, smooth):
    e, d = ends(p, n), p(Mean(smooth))

    def f(b):
        hi, lo = e(b)
        k = None if hi is None else 50.0 if hi - lo <= 0 else 100 * (b["close"] - lo) / (hi - lo)
        return k, d(k)

    return f


@step
def cci(p, n):
    w = p(Spread(n))

    def f(b):
        x = price(b, "hlc3")
        found = w(x)
        return (None if found is None else 0.0 if found[1] == 0 else (x - found[0]) / (0.015 * found[1]),)

    return f


@step
def williams_r(p, n):
    e = ends(p, n)

    def f(b):
        hi, lo = e(b)
        return (None if hi is None else -50.0 if hi - lo <= 0 else -100 * (hi - b["close"]) / (hi - lo),)

    return f


@step
def roc(p, n, src):
    last = p(Lag(n))

    def f(b):
        before = last(price(b, src))
        return (over(None if before is None else 100 * (price(b, src) - before), before),)

    return f


@step
def momentum(p, n, src):
    last = p(Lag(n))
    return lambda b: (less(price(b, src), last(price(b, src))),)


@step
def macd(p, fast, slow, signal, src):
    a, c, s = ema_(p, fast), ema_(p, slow), ema_(p, signal)

    def f(b):
        line = less(a(price(b, src)), c(price(b, src)))
        mean = s(line)
        return line, mean, less(line, mean)

    return f


@step
def ppo(p, fast, slow, signal, src):
    a, c, s = ema_(p, fast), ema_(p, slow), ema_(p, signal)

    def f(b):
        quick, slow_ = a(price(b, src)), c(price(b, src))
        d = less(quick, slow_)
        line = over(None if d is None else 100 * d, slow_)
        mean = s(line)
        return line, mean, less(line, mean)

    return f


@step
def stoch_rsi(p, n, window, smooth_k, smooth_d, src):
    g, hi, lo, k_, d_ = gains(p, n, src), p(Extreme(window, 1)), p(Extreme(window, -1)), p(Mean(smooth_k)), p(Mean(smooth_d))

    def f(b):
        up, down = g(b)
        x = None if up is None else over(100 * up, up + down)
        top, low = hi(x), lo(x)
        k = k_(None if top is None else over(100 * (x - low), top - low))
        return k, d_(k)

    return f


@step
def aroon(p, n):
    hi, lo = p(Extreme(n, 1)), p(Extreme(n, -1))

    def f(b):
        top, low = hi.at(b["high"]), lo.at(b["low"])
        if top is None:
            return None, None, None
        up, down = 100.0 * (n - (hi.row - top[1])) / n, 100.0 * (n - (lo.row - low[1])) / n
        return up, down, up - down

    return f


@step
def ao(p, n, slow):
    a, c = p(Mean(n)), p(Mean(slow))
    return lambda b: (less(a(price(b, "hl2")), c(price(b, "hl2"))),)


@step
def bop(p, n):
    m = p(Mean(n))

    def f(b):
        span = b["high"] - b["low"]
        value = (b["close"] - b["open"]) / span if span > 0 else None
        return value, m(value)

    return f


@step
def elder_ray(p, n):
    e = ema_(p, n)

    def f(b):
        m = e(b["close"])
        return less(b["high"], m), less(b["low"], m)

    return f


@step
def atr(p, n):
    r, e = range_(p), rma_(p, n)
    return lambda b: (e(r(b)),)


@step
def stddev(p, n, src):
    s = p(Deviation(n))
    return lambda b: (s(price(b, src)),)


def band(m, s, mult):
    return (None, m, None) if m is None or s is None else (m + mult * s, m, m - mult * s)


@step
def bollinger(p, n, mult, src):
    m, s = p(Mean(n)), p(Deviation(n))
    return lambda b: band(m(price(b, src)), s(price(b, src)), mult)


@step
def keltner(p, n, atr_n, mult):
    m, r, a = ema_(p, n), range_(p), rma_(p, atr_n)

    def f(b):
        mean, width = m(b["close"]), a(r(b))
        return band(None if width is None else mean, width, mult)

    return f


@step
def donchian(p, n):
    e = ends(p, n)

    def f(b):
        hi, lo = e(b)
        return (None, None, None) if hi is None else (hi, (hi + lo) / 2, lo)

    return f


@step
def ichimoku(p, short, mid, long):
    parts = [ends(p, n) for n in (short, mid, long)]

    def f(b):
        t, k, c = (None if hi is None else (hi + lo) / 2 for hi, lo in (e(b) for e in parts))
        return t, k, None if t is None or k is None else (t + k) / 2, c, b["close"]

    return f


@step
def chop(p, n):
    r, e, s = range_(p), ends(p, n), p(Sum(n))

    def f(b):
        total, (hi, lo) = s(r(b)), e(b)
        if hi is None or not hi - lo > 0 or not total > 0:
            return (None,)
        return (100 * math.log10(total / (hi - lo)) / math.log10(max(2, n)),)

    return f


@step
def adx(p, n):
    h, low, c = p(Lag()), p(Lag()), p(Lag())
    plus, minus, tr, mean = rma_(p, n), rma_(p, n), rma_(p, n), rma_(p, n)

    def f(b):
        hb, lb, cb = h(b["high"]), low(b["low"]), c(b["close"])
        if hb is None:
            return None, None, None
        up, down = b["high"] - hb, lb - b["low"]
        a = plus(up if up > down and up > 0 else 0.0)
        d = minus(down if down > up and down > 0 else 0.0)
        t = tr(max(b["high"] - b["low"], abs(b["high"] - cb), abs(b["low"] - cb)))
        pd, md = over(None if a is None else 100 * a, t), over(None if d is None else 100 * d, t)
        dx = None if pd is None or md is None else 0.0 if pd + md == 0 else 100 * abs(pd - md) / (pd + md)
        return mean(dx), pd, md

    return f


@step
def obv(p):
    last, total = p(Lag()), p(Total())

    def f(b):
        before = last(b["close"])
        sign = 0 if before is None else (b["close"] > before) - (b["close"] < before)
        return (total.add(sign * vol(b)),)

    return f


def by_day(p, k):
    """k sums over the bars of one day."""
    day, sums = p(Held()), [p(Total()) for _ in range(k)]

    def f(b, *values):
        d = b["time"] // 86_400
        if d != day.x:
            day.x = d
            for s in sums:
                s.__init__()
        return [s.add(v) for s, v in zip(sums, values)]

    return f


@step
def vwap(p):
    day = by_day(p, 2)

    def f(b):
        flow, v = day(b, price(b, "hlc3") * vol(b), vol(b))
        return (flow / v if v > 0 else None,)

    return f


@step
def vwap_bands(p, mult):
    day = by_day(p, 3)

    def f(b):
        x, v = price(b, "hlc3"), vol(b)
        v, flow, squares = day(b, v, x * v, x * x * v)
        if not v > 0:
            return None, None, None
        m = flow / v
        return band(m, math.sqrt(max(squares / v - m * m, 0.0)), mult)

    return f


@step
def mfi(p, n):
    last, up_, down_ = p(Lag()), p(Sum(n)), p(Sum(n))

    def f(b):
        x = price(b, "hlc3")
        before = last(x)
        if before is None:
            return (None,)
        up, down = up_(x * vol(b) if x > before else 0.0), down_(x * vol(b) if x < before else 0.0)
        return (None if up is None or not up + down > 0 else 100 * up / (up + down),)

    return f


def place(b: dict) -> float:
    span = b["high"] - b["low"]
    return (2 * b["close"] - b["high"] - b["low"]) / span if span > 0 else 0.0


@step
def cmf(p, n):
    flow, volume = p(Sum(n)), p(Sum(n))

    def f(b):
        a, v = flow(place(b) * vol(b)), volume(vol(b))
        return (a / v if v is not None and v > 0 else None,)

    return f


@step
def adl(p):
    total = p(Total())
    return lambda b: (total.add(place(b) * positive_vol(b)),)


@step
def force_index(p, n):
    last, e = p(Lag()), ema_(p, n)

    def f(b):
        before = last(b["close"])
        return (e((b["close"] - before) * b["volume"] if before is not None and positive_vol(b) > 0 else None),)

    return f


def sides(b: dict) -> tuple[float, float] | None:
    buy, sell = b["buy_volume"], b["sell_volume"]
    return (buy, sell) if buy is not None and sell is not None and 0 <= buy < math.inf and 0 <= sell < math.inf else None


@step
def delta(p, smooth):
    m = p(Mean(smooth))

    def f(b):
        s = sides(b)
        value = s[0] - s[1] if s else None
        return value, m(value)

    return f


@step
def cvd(p):
    total, used, seen = p(Total()), p(Total()), p(Total())

    def f(b):
        s = sides(b)
        value = total.add(s[0] - s[1] if s else 0.0)
        return value, 100.0 * used.add(1.0 if s else 0.0) / seen.add(1.0)

    return f


@step
def delta_ratio(p, n):
    e = ema_(p, n)

    def f(b):
        s = sides(b)
        value = 100 * (s[0] - s[1]) / (s[0] + s[1]) if s and s[0] + s[1] > 0 else None
        return value, e(value)

    return f


@step
def pivot_points(p):
    day, hi, lo, close, h, low, c = (p(Held()) for _ in range(7))
    forms = {k: compile(v.format(h="h", l="l", p="p"), k, "eval") for k, v in LEVELS.items()}

    def f(b):
        d = b["time"] // 86_400
        if d != day.x:
            if day.x is not None:
                h.x, low.x, c.x = hi.x, lo.x, close.x
            day.x, hi.x, lo.x = d, b["high"], b["low"]
        hi.x, lo.x, close.x = max(hi.x, b["high"]), min(lo.x, b["low"]), b["close"]
        if h.x is None:
            return (None,) * len(forms)
        names = {"h": h.x, "l": low.x, "p": (h.x + low.x + c.x) / 3}
        return tuple(eval(x, {}, names) for x in forms.values())  # the catalogue's own formulas, in these three names

    return f


@step
def supertrend(p, n, mult):
    def put(s, x):
        s.bands, s.side, s.close = (None if x[0] is None else (x[0], x[1])), int(x[2]), x[3]

    r, a = range_(p), rma_(p, n)
    s = p(Whole(SuperTrend(mult), lambda s: [*(s.bands or (None, None)), s.side, s.close], put)).step

    def f(b):
        (out,) = s(b | {"atr": a(r(b))})
        return out["value"], out["direction"]

    return f


@step
def psar(p, step, most):
    names = ("first_close", "sar", "extreme", "pace")

    def get(s):
        return [*(getattr(s, k, None) for k in names), getattr(s, "long", None), *(x for pair in s.past for x in pair)]

    def put(s, x):
        for k, v in zip(names, x):
            setattr(s, k, v)
        s.long, s.past = bool(x[4]), list(zip(x[5::2], x[6::2]))

    s = p(Whole(ParabolicSar(step, most), get, put)).step
    return lambda b: (s(b)[0]["value"],)


@step
def kama(p, n, fast, slow):
    last, back, path = p(Lag()), p(Lag(n)), p(Sum(n))
    s = p(Whole(AdaptiveAverage(), lambda s: [s.e, s.before], lambda s, x: s.__dict__.update(e=x[0], before=x[1]))).step
    quick, calm = 2 / (fast + 1), 2 / (slow + 1)

    def f(b):
        x = b["close"]
        before, old = last(x), back(x)
        way = path(None if before is None else abs(x - before))
        rate = None
        if old is not None:
            rate = ((0.0 if way == 0 else abs(x - old) / way) * (quick - calm) + calm) ** 2
        return (s({"symbol": None, "time": None, "x": x, "rate": rate})[0]["value"],)

    return f


class Steps:
    """Some indicators over one symbol's bars: {name: parameters}; parameters not given are the catalogue's."""

    def __init__(self, wanted: dict[str, dict]):
        if unknown := set(wanted) - set(STEPS):
            raise ValueError(f"unknown indicator {', '.join(sorted(unknown))}")
        self.parts: list[Part] = []
        self.makers = [STEPS[name](self._part, **settings(name, given)) for name, given in wanted.items()]
        self.columns = [f"{name}_{k}" for name in wanted for k in REGISTRY[name].outputs]

    def _part(self, part: Part) -> Part:
        self.parts.append(part)
        return part

    def dump(self) -> tuple[list[float], list[list[float]]]:
        numbers, queues = [], []
        for part in self.parts:
            part.dump(numbers, queues)
        return numbers, queues

    def load(self, numbers: list[float], queues: list[list[float]]) -> None:
        a, b = iter(numbers), iter(queues)
        for part in self.parts:
            part.load(a, b)

    def update(self, bar: dict) -> list[float | None]:
        return [x for f in self.makers for x in f(bar)]

    def preview(self, bar: dict) -> list[float | None]:
        """The values as if a forming bar closed as it stands; the state stays."""
        kept = self.dump()
        try:
            return self.update(bar)
        finally:
            self.load(*kept)
