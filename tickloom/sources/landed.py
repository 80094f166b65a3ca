"""Landed answers and messages as Spark data sources: ``spark.read.format("landed_bars")``, ``spark.readStream.format("landed_messages")``.

Answers lie in ``<path>/symbol=<s>/period=<seconds>/start=<t>/end=<t>/``, a file for each body: an array of bar
objects. A batch read makes one partition of each window's folder; those of other symbols and periods, or of windows outside the
times asked for, aren't opened, be it by options or by filters that Spark pushes down. A body is taken whole or refused whole, as by ``payloads.parse_bars``.

Messages lie in files of lines, a JSON object each, under ``<path>``; files are put there whole and in rising order of name.
A stream's offset is the last file taken. A line that isn't a good bar is set aside alone: its row has the text
and a cause, and no bar. Register both with ``register(spark)``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

BARS = "symbol string, period long, time long, open double, high double, low double, close double, volume double, buy_volume double, sell_volume double"
REFUSED = "source string, cause string"
MESSAGES = "symbol string, time long, open double, high double, low double, close double, volume double, buy_volume double, sell_volume double, seq long, raw string, cause string"
WINDOW = re.compile(r"symbol=([^/]+)/period=(\d+)/start=(-?\d+)/end=(-?\d+)/([^/]+)$")
PRICES = ("open", "high", "low", "close")


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    store, folder = pafs.FileSystem.from_uri("file:///" + path[6:].lstrip("/") if path.startswith("file:/") else path)
    return store, folder.rstrip("/")


def _number(x) -> float | None:
    """A finite number, or None."""
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) else None


def bar_of(x) -> tuple | None:
    """(time, open, high, low, close, volume, buy_volume, sell_volume) of a bar object; None if its time or a price isn't a finite number."""
    if not isinstance(x, dict):
        return None
    must = [_number(x.get(k)) for k in ("time", *PRICES)]
    if None in must:
        return None
    return (int(must[0]), *must[1:], *(_number(x.get(k)) for k in ("volume", "buyVolume", "sellVolume")))


def bars_of_body(body: str) -> list[tuple] | None:
    """All bars of a body, or None if it isn't an array or any bar is bad."""
    try:
        found = json.loads(body)
    except ValueError:
        return None
    if not isinstance(found, list):
        return None
    bars = [bar_of(x) for x in found]
    return None if None in bars else bars


@dataclass
class Window(InputPartition):
    symbol: str
    period: int
    start: int
    end: int
    files: tuple[str, ...]


class LandedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.refused = options["path"], options.get("refused", "false").lower() == "true"
        self.symbols = {options["symbol"]} if "symbol" in options else None
        self.periods = {int(options["period"])} if "period" in options else None
        # half-open, as windows are
        self.start, self.end = int(options.get("start", -(1 << 62))), int(options.get("end", 1 << 62))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the windows; Spark applies every filter to the rows as well."""
        if not self.refused:
            for f in filters:
                name = f.attribute[0] if hasattr(f, "attribute") else None
                if name in ("symbol", "period") and isinstance(f, (EqualTo, In)):
                    values = set(f.value if isinstance(f, In) else [f.value])
                    kept = f"{name}s"
                    setattr(self, kept, values if getattr(self, kept) is None else getattr(self, kept) & values)
                elif name == "time":
                    if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                        self.start = max(self.start, f.value)
                    elif isinstance(f, GreaterThan):
                        self.start = max(self.start, f.value + 1)
                    if isinstance(f, (EqualTo, LessThanOrEqual)):
                        self.end = min(self.end, f.value + 1)
                    elif isinstance(f, LessThan):
                        self.end = min(self.end, f.value)
        yield from filters

    def partitions(self) -> list[Window]:
        store, folder = open_store(self.path)
        windows: dict[tuple, list[str]] = {}
        for f in store.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)):
            m = WINDOW.search(f.path)
            if not f.is_file or not m or m[5].startswith(("_", ".")):
                continue
            symbol, period, start, end = m[1], int(m[2]), int(m[3]), int(m[4])
            if (self.symbols is None or symbol in self.symbols) and (self.periods is None or period in self.periods) and start < self.end and end > self.start:
                windows.setdefault((symbol, period, start, end), []).append(f.path)
        return [Window(*w, tuple(sorted(files))) for w, files in sorted(windows.items())]

    def read(self, window: Window | None) -> Iterator[tuple]:
        if window is None:  # Spark's one partition where there are none
            return
        store, _ = open_store(self.path)
        for path in window.files:
            with store.open_input_stream(path) as file:
                bars = bars_of_body(file.read().decode("utf-8", "replace"))
            if self.refused:
                if bars is None:
                    yield path, "DECODING"
            else:
                for bar in bars or []:
                    # of a window's answer only what it was asked for
                    if max(self.start, window.start) <= bar[0] < min(self.end, window.end):
                        yield (window.symbol, window.period, *bar)


class LandedBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_bars"

    def schema(self) -> str:
        return REFUSED if self.options.get("refused", "false").lower() == "true" else BARS

    def reader(self, schema) -> LandedReader:
        return LandedReader(dict(self.options))


@dataclass
class Lines(InputPartition):
    file: str
    number: int


def message_row(line: str, seq: int) -> tuple:
    """A message as a row: its bar, or its text and why it has none."""
    none = (None,) * 9
    try:
        x = json.loads(line)
    except ValueError:
        return (*none, seq, line, "DECODING")
    bar = bar_of(x)
    symbol = x.get("symbol") if isinstance(x, dict) else None
    if bar is None or not isinstance(symbol, str) or not symbol:
        return (*none, seq, line, "INVALID")
    return (symbol, *bar, seq, None, None)


class MessageReader(DataSourceStreamReader):
    """Offsets are {"files": how many files have been taken, "last": the last one's name}."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def _files(self) -> list[str]:
        store, folder = open_store(self.path)
        found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def initialOffset(self) -> dict:
        return {"files": 0, "last": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"files": len(files), "last": files[-1] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        new = [f for f in self._files() if start["last"] < f <= end["last"]]
        return [Lines(f, start["files"] + i) for i, f in enumerate(new)]

    def read(self, part: Lines) -> Iterator[tuple]:
        store, folder = open_store(self.path)
        with store.open_input_stream(f"{folder}/{part.file}") as file:
            text = file.read().decode("utf-8", "replace")
        # the place of a line orders updates: files by their number, lines within
        for i, line in enumerate(text.split("\n")):
            if line.strip():
                yield message_row(line, (part.number << 32) + i)

    def commit(self, end: dict) -> None:
        pass


class LandedMessages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_messages"

    def schema(self) -> str:
        return MESSAGES

    def streamReader(self, schema) -> MessageReader:
        return MessageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, and let it push filters down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (LandedBars, LandedMessages):
        spark.dataSource.register(source)
