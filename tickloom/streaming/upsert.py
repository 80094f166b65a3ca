"""A versioned table of bars that a stream of updates is merged into, one version for each micro-batch.

An update with the time of its symbol's last bar replaces it, a later one is appended, and an older one is
ignored, in order of arrival. So only the last bar of a symbol can still change. The table keeps the two kinds apart:

* ``log``: bars that a later one has closed; each is written once, in the version that closed it;
* ``heads``: the last bar of each symbol, whole in every version.

A version is what its file in ``commits`` names, which is written last: a batch that fails leaves folders that
nothing names, and a batch that runs again starts from the version before it and gives the same rows.
Reading is the logs so far and one heads folder: no merge, and no shuffle. Merging moves a batch and the heads of its symbols.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import finite_bars
from ..sources.shared import names, read_text, remove, write_text


def last_updates(updates: DataFrame, key: str = "symbol", order: str = "seq") -> DataFrame:
    """Of updates, those that stand once all have been taken in order: of each bar the last that came before any later bar."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    taken = updates.withColumn("__top", F.max("time").over(w)).where("time = __top").drop("__top")
    rest = [c for c in updates.columns if c not in (key, "time")]
    kept = taken.groupBy(key, "time").agg(F.max_by(F.struct(*rest), order).alias("__b"))
    return kept.select(key, "time", *(F.col(f"__b.{c}").alias(c) for c in rest)).select(*updates.columns)


class BarTable:
    """Bars by (symbol, time) under a shared folder; ``columns`` are those of a bar besides the two."""

    def __init__(self, spark: SparkSession, path: str, columns: str = "open double, high double, low double, close double, volume double", key: str = "symbol"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = f"{key} string, time long, {columns}"
        self.names = [c.split()[0] for c in self.schema.split(", ")]

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names(self.spark, f"{self.path}/commits") if n.endswith(".json"))

    def _commit(self, version: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/commits/{version:012d}.json"))

    def _parquet(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def heads(self, version: int | None) -> DataFrame:
        return self._parquet([] if version is None else [f"{self.path}/{self._commit(version)['heads']}"])

    def read(self, version: int | None = None) -> DataFrame:
        """All bars as of a version (the newest, if not given)."""
        there = [v for v in self.versions() if version is None or v <= version]
        if not there:
            return self._parquet([])
        commits = [self._commit(v) for v in there]
        since = max((i for i, c in enumerate(commits) if c.get("whole")), default=0)
        return self._parquet([f"{self.path}/{c['log']}" for c in commits[since:]]).unionByName(self.heads(there[-1]))

    def merge(self, batch: DataFrame, version: int, order: str = "seq") -> None:
        """Take a batch of updates as a version. Versions before it stay as they are; merging one again replaces it.

        Bars without a finite time and prices are left out. A version that others have been built on isn't
        merged again, as its rows are already in them.
        """
        there = self.versions()
        if there and version < there[-1]:
            return
        before = max((v for v in there if v < version), default=None)
        heads = self.heads(before)
        fresh = last_updates(finite_bars(batch).where(F.col(self.key).isNotNull()).select(*self.names, F.col(order).cast("long").alias("__seq")), self.key, "__seq").drop("__seq")
        # against the heads: equal times replace, older ones go
        last = heads.select(F.col(self.key).alias("__k"), F.col("time").alias("__t"))
        ok = fresh.join(last, F.col(self.key) == F.col("__k"), "left").where("__t is null or time >= __t").drop("__k", "__t")
        bars = ok.withColumn("__new", F.lit(1)).unionByName(heads.withColumn("__new", F.lit(0)))
        w = Window.partitionBy(self.key)
        rest = [c for c in self.names if c not in (self.key, "time")]
        one = bars.groupBy(self.key, "time").agg(F.max_by(F.struct(*rest), "__new").alias("__b")).select(self.key, "time", "__b.*")
        one = one.withColumn("__open", F.col("time") == F.max("time").over(w))
        run = f"{version:012d}-{uuid.uuid4().hex}"
        out = f"{self.path}/data/{run}"
        # one pass over the merged rows: both kinds are written by it
        one.write.partitionBy("__open").parquet(out)
        for kind in ("false", "true"):
            self.spark.createDataFrame([], self.schema).write.mode("append").parquet(f"{out}/__open={kind}")
        write_text(self.spark, f"{self.path}/commits/{version:012d}.json", json.dumps({"log": f"data/{run}/__open=false", "heads": f"data/{run}/__open=true"}))

    def sink(self, order: str = "seq") -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``."""
        return lambda batch, version: self.merge(batch, version, order)

    def compact(self, files: int | None = None) -> None:
        """Write the closed bars of all versions as one log, from which readers of the newest version on start."""
        there = self.versions()
        if not there:
            return
        newest = self._commit(there[-1])
        heads = self.heads(there[-1]).select(self.key, "time")
        closed = self.read().join(heads, [self.key, "time"], "left_anti")
        run = f"data/{there[-1]:012d}-{uuid.uuid4().hex}"
        (closed.coalesce(files) if files else closed).write.parquet(f"{self.path}/{run}")
        write_text(self.spark, f"{self.path}/commits/{there[-1]:012d}.json", json.dumps(newest | {"log": run, "whole": True}))

    def vacuum(self) -> int:
        """Delete folders that no version names; not while a batch is being merged."""
        used = {p.split("/")[1] for v in self.versions() for p in (self._commit(v)["log"], self._commit(v)["heads"])}
        lost = [n for n in names(self.spark, f"{self.path}/data") if n not in used]
        for n in lost:
            remove(self.spark, f"{self.path}/data/{n}")
        return len(lost)
