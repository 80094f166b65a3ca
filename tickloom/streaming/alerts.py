"""Alerts over series that are polled whole: only what is new is fed, unless the past has changed.

State for a symbol is a count of bars fed, a digest of them, and each alert's few fields, however long the series is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import Alert
from .kernels import AlertMachine

SAMPLE = ("value", "high", "low", "reference")
FIELDS = ("armed", "before", "reference", "baseline")
STATE = "fed long, digest string, epoch long, machines array<struct<armed:boolean,before:double,reference:double,baseline:double>>"
EVENT = "symbol string, poll long, epoch long, alert string, kind string, time long, value double"


def prefix_digest(frame: pd.DataFrame, n: int) -> str:
    """Of the first n bars: everything of those before the last, whose values may still have been forming, and its time."""
    past = np.ascontiguousarray(frame.loc[:, ["time", *SAMPLE]].iloc[: max(n - 1, 0)].to_numpy(np.float64))
    past[np.isnan(past)] = np.nan  # one pattern of bits
    last = frame["time"].iloc[n - 1 : n].to_numpy(np.int64)
    return hashlib.blake2b(past.tobytes() + last.tobytes(), digest_size=16).hexdigest()


class AlertProcessor(StatefulProcessor):
    def __init__(self, alerts: list[Alert]):
        self.alerts = alerts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alerts", STATE)

    def _machines(self, kept=None) -> list[AlertMachine]:
        out = [AlertMachine(a) for a in self.alerts]
        for machine, fields in zip(out, kept or []):
            for name, v in zip(FIELDS, fields):
                setattr(machine, name, v)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fed, digest, epoch, kept = self.state.get() if self.state.exists() else (0, "", 0, None)
        machines, out = self._machines(kept), []
        for poll, series in pd.concat(list(rows)).sort_values(["poll", "time"], kind="stable").groupby("poll", sort=True):
            if fed and (len(series) < fed or prefix_digest(series, fed) != digest):
                machines, fed, epoch = self._machines(), 0, epoch + 1  # the past is another one: from the start
            columns = [series[c].iloc[fed:].tolist() for c in ("time", *SAMPLE)]
            for time, *values in zip(*columns):
                sample = {"symbol": key[0], "time": time} | {c: None if v is None or v != v else v for c, v in zip(SAMPLE, values)}
                out += [(key[0], poll, epoch, e["alert"], e["kind"], e["time"], e["value"]) for m in machines for e in m(sample)]
            fed = len(series)
            digest = prefix_digest(series, fed)
        self.state.update((fed, digest, epoch, [tuple(getattr(m, f) for f in FIELDS) for m in machines]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])

    def close(self) -> None:
        pass


def stream_alerts(polls: DataFrame, alerts: list[Alert]) -> DataFrame:
    """Firings (symbol, poll, epoch, alert, kind, time, value) of polls: (symbol, poll, time, value, high, low, reference).

    A poll is a symbol's whole series as it is then. If what was fed stands as it was, the rest is fed; the
    newest bar fed may have changed its values since, as it was forming, and isn't fed again. If the series is
    shorter, or any bar before differs, all alerts are armed anew and the series is fed from its first bar: those
    firings have the next ``epoch``, and stand in place of all of earlier ones. ``reference`` is what a series
    crosses at the bar's own time (``operators.alerts.with_references``). Start the query within ``typed_state``.
    """
    rows = polls.where(F.col("symbol").isNotNull() & F.col("time").isNotNull())
    rows = rows.select("symbol", F.col("poll").cast("long"), F.col("time").cast("long"), *(F.col(c).cast("double") for c in SAMPLE))
    return rows.groupBy("symbol").transformWithStateInPandas(AlertProcessor(alerts), EVENT, "append", "none")
