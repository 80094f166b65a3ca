"""A series that goes on live: each poll's bars join the archive as it is at that time, and the seam is kept.

Every micro-batch merges its bars into a ``BarTable`` and splices that with the archive from the seam on: the part of the archive
before the seam is neither read nor written again. The state between batches is a file for each
version: where the splice begins, what the archive was known by (its usual phase, its buckets), and the folders with the
spliced rows and the report. As with the table, what that file names counts, so batches may fail or repeat.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align
from ..sources.shared import names, read_text, write_text
from .upsert import BarTable

BAR = ["time", "open", "high", "low", "close", "volume"]


class LiveSplice:
    """``archive`` gives (token, bars) as of now, one series; a new token says that the archive has changed."""

    def __init__(self, spark: SparkSession, path: str, archive: Callable[[], tuple[str, DataFrame]], period: int, precedence: str = "cut", diverging: str = "archive", price_tol: float = 0.001, gap_tol: int = 0, symbol: str = "LIVE"):
        self.spark, self.path, self.archive, self.period, self.symbol = spark, path.rstrip("/"), archive, period, symbol
        self.how = {"precedence": precedence, "diverging": diverging, "price_tol": price_tol}
        self.gap_tol = gap_tol
        self.table = BarTable(spark, f"{self.path}/live")

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names(self.spark, f"{self.path}/seams") if n.endswith(".json"))

    def _state(self, version: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/seams/{version:012d}.json"))

    def _facts(self, history: DataFrame) -> dict:
        """What the whole archive is needed for: read once for each of its tokens, times only."""
        bucket = F.floor(F.col("time") / self.period)
        top = [r.b for r in history.select(bucket.alias("b")).distinct().orderBy(F.desc("b")).limit(2).collect()]
        n = history.agg(F.count_distinct(bucket).alias("n")).collect()[0].n
        return {"phase": align.usual_phase(history, self.period).collect()[0].phase, "buckets": n, "from": top[-1] if top else None}

    def merge(self, batch: DataFrame, version: int) -> None:
        """Take the bars of a poll: (time, open, high, low, close, volume, seq)."""
        there = self.versions()
        if there and version < there[-1]:
            return
        self.table.merge(batch.withColumn("symbol", F.lit(self.symbol)), version)
        live = self.table.read(version).where(F.col("symbol") == self.symbol).select(*BAR)
        token, history = self.archive()
        before = max((v for v in there if v < version), default=None)
        kept = self._state(before) if before is not None else {}
        facts = kept["facts"] if kept.get("token") == token else self._facts(history)
        first = live.agg(F.min(F.floor(F.col("time") / self.period)).alias("b")).collect()[0].b
        start = min((b for b in (first, facts["from"]) if b is not None), default=0)
        late = history.where(F.col("time") >= start * self.period)
        rows = align.splice(late, live, self.period, **self.how, phase=facts["phase"])
        report = align.splice_report(late, live, self.period, **self.how, gap_tol=self.gap_tol, phase=facts["phase"])
        # buckets of the archive before the seam's neighbourhood
        here = late.agg(F.count_distinct(F.floor(F.col("time") / self.period)).alias("n")).collect()[0].n
        alone = ~F.coalesce("coherent", F.lit(True)) & F.lit(self.how["diverging"] == "live")
        report = report.withColumn("from_archive", F.when(alone, F.col("from_archive")).otherwise(F.col("from_archive") + facts["buckets"] - here))
        run = f"splices/{version:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{run}/rows")
        report.coalesce(1).write.parquet(f"{self.path}/{run}/report")
        write_text(self.spark, f"{self.path}/seams/{version:012d}.json", json.dumps({"token": token, "facts": facts, "start": start, "run": run}))

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``."""
        return self.merge

    def report(self, version: int | None = None) -> DataFrame:
        v = self.versions()[-1] if version is None else version
        return self.spark.read.parquet(f"{self.path}/{self._state(v)['run']}/report")

    def read(self, version: int | None = None) -> DataFrame:
        """The spliced series of a version, with where each bar came from; the archive as it is now before the seam."""
        v = self.versions()[-1] if version is None else version
        state = self._state(v)
        rows = self.spark.read.parquet(f"{self.path}/{state['run']}/rows")
        early = self.archive()[1].where(F.col("time") < state["start"] * self.period)
        early = early.groupBy(F.floor(F.col("time") / self.period).alias("b")).agg(F.max_by(F.struct(*BAR), "time").alias("w")).select("w.*", F.lit("archive").alias("origin"), F.lit(False).alias("overlap"))
        if self.how["diverging"] == "live":
            # where the live series stands alone, nothing of the archive comes before it
            early = early.join(F.broadcast(self.report(v).where("coherent is null or coherent").select("coherent"))).drop("coherent")
        return early.unionByName(rows)
