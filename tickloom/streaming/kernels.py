"""Indicators and alerts as steps with a small state, for streams; batch forms are in ``operators``.

A kernel takes one number at a time and gives a number, or None until it is warm; ``peek`` gives what it
would give without taking the number.
"""

from __future__ import annotations

import copy
import math
from collections import deque

from ..operators.alerts import Alert


class Kernel:
    def push(self, x: float) -> float | None:
        raise NotImplementedError

    def peek(self, x: float) -> float | None:
        return copy.deepcopy(self).push(x)


class Mean(Kernel):
    def __init__(self, n: int):
        self.last = deque(maxlen=n)

    def push(self, x):
        self.last.append(x)
        return math.fsum(self.last) / len(self.last) if len(self.last) == self.last.maxlen else None


class Deviation(Mean):
    """Population standard deviation of the last n."""

    def push(self, x):
        m = super().push(x)
        return None if m is None else math.sqrt(math.fsum((v - m) ** 2 for v in self.last) / len(self.last))


class Smooth(Kernel):
    """e += k (x - e), from the mean of the first n."""

    def __init__(self, n: int, k: float):
        self.k, self.head, self.e = k, Mean(n), None

    def push(self, x):
        self.e = self.head.push(x) if self.e is None else self.e + self.k * (x - self.e)
        return self.e


def ema(n: int) -> Smooth:
    return Smooth(n, 2 / (n + 1))


def wilder(n: int) -> Smooth:
    return Smooth(n, 1 / n)


class Steps:
    """A step over bars: emits (symbol, time, value); bars that aren't finite are left out."""

    def value(self, bar: dict) -> float | None:
        raise NotImplementedError

    def __call__(self, row: dict) -> list[dict]:
        if not all(isinstance(row[c], (int, float)) and math.isfinite(row[c]) for c in ("high", "low", "close")):
            return []
        return [{"symbol": row["symbol"], "time": row["time"], "value": self.value(row)}]

    def preview(self, row: dict) -> float | None:
        """The value if the forming bar closed as it stands."""
        return copy.deepcopy(self).value(row)


class Close(Steps):
    """A kernel over closes."""

    def __init__(self, kernel: Kernel):
        self.kernel = kernel

    def value(self, bar):
        return self.kernel.push(bar["close"])


class Atr(Steps):
    def __init__(self, n: int = 14):
        self.average, self.before = wilder(n), None

    def value(self, bar):
        p = self.before
        span = bar["high"] - bar["low"]
        self.before = bar["close"]
        return self.average.push(span if p is None else max(span, abs(bar["high"] - p), abs(bar["low"] - p)))


class Rsi(Steps):
    def __init__(self, n: int = 14):
        self.up, self.down, self.before = wilder(n), wilder(n), None

    def value(self, bar):
        p, self.before = self.before, bar["close"]
        if p is None:
            return None
        up, down = self.up.push(max(bar["close"] - p, 0.0)), self.down.push(max(p - bar["close"], 0.0))
        if up is None:
            return None
        if down == 0:
            return 100.0 if up else 50.0
        return 100 - 100 / (1 + up / down)


class Macd(Steps):
    """The line; ``signal`` has its average after each bar."""

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        self.fast, self.slow, self.average, self.signal = ema(fast), ema(slow), ema(signal), None

    def value(self, bar):
        a, b = self.fast.push(bar["close"]), self.slow.push(bar["close"])
        if a is None or b is None:
            return None
        self.signal = self.average.push(a - b)
        return a - b


class AlertMachine:
    """An alert from sample to sample: armed, then fired; kinds that last arm again once they no longer hold."""

    def __init__(self, alert: Alert):
        self.alert = alert
        self.rearm()

    def rearm(self) -> None:
        self.armed, self.before, self.reference, self.baseline = True, None, None, None

    def _inside(self, v: float) -> bool:
        return self.alert.low <= v <= self.alert.high

    def _holds(self, s: dict) -> bool:
        a, v, p = self.alert, s["value"], self.before
        if a.kind == "TOUCH":
            low, high = (s.get(k) if s.get(k) is not None else v for k in ("low", "high"))
            return low <= a.level <= high
        if a.kind == "PERCENT_CHANGE":
            change = 100 * (v - self.baseline) / self.baseline if self.baseline else None
            return change is not None and (change >= a.percent if a.percent >= 0 else change <= a.percent)
        if p is None:
            return False
        if a.kind == "CROSS_ABOVE":
            return p <= a.level < v
        if a.kind == "CROSS_BELOW":
            return p >= a.level > v
        if a.kind == "ENTER_ZONE":
            return not self._inside(p) and self._inside(v)
        if a.kind == "EXIT_ZONE":
            return self._inside(p) and not self._inside(v)
        if a.kind == "SERIES_CROSS":
            r, q = s.get("reference"), self.reference
            return r is not None and q is not None and ((p <= q and v > r) or (p >= q and v < r))
        raise ValueError(f"unknown kind {a.kind!r}")

    def __call__(self, s: dict) -> list[dict]:
        if s["value"] is None or not math.isfinite(s["value"]):
            return []
        if self.baseline is None:
            self.baseline = s["value"]
        holds = self._holds(s)
        self.before, self.reference = s["value"], s.get("reference")
        fires = holds and self.armed
        if fires:
            self.armed = not self.alert.once and self.alert.kind not in ("TOUCH", "PERCENT_CHANGE")
        elif not holds and not self.armed and not self.alert.once:
            self.armed = True
        return [{"symbol": s["symbol"], "alert": self.alert.id, "kind": self.alert.kind, "time": s["time"], "value": s["value"]}] if fires else []
