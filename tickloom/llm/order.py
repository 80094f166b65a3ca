"""Places of rows in a global order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small


def numbered(df: DataFrame, group: list[str], order: list, pos: str = "pos", size: str | None = None) -> DataFrame:
    """``df`` with the place of each row (``pos``, from 0) within its group, in the given order; ``size``: rows of the group.

    Rows are dealt by ranges of (group, order, row), sorted, and written; each range counts its rows of a
    group, and the counts before a range, a row for each range and group, give where its places start. So a
    group may hold any share of the rows, and so may rows that tie in everything. ``df`` should be a written
    table: its rows are read twice.
    """
    names = [f"__o{i}" for i in range(len(order))]
    keyed = df.select("*", *(c.alias(n) for c, n in zip(order, names)), F.monotonically_increasing_id().alias("__row"))
    by = [*(F.col(g).asc_nulls_first() for g in group), *(F.col(n).asc_nulls_first() for n in names), F.col("__row")]
    ranged = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop(*names, "__row")
    # the low 33 bits of this id count the rows of a partition, here in sorted order
    ranged = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = materialize(ranged, "ranges")
    held = ranged.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if group else None
    if before is None:
        before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), "__part", (before - F.col("__first")).alias("__start"), *([F.sum("__n").over(w).alias(size)] if size else []))
    starts = materialize(starts, "range-starts")
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = ranged.join(small(starts.withColumnRenamed("__part", "__p")), same)
    out = out.withColumn(pos, F.col("__start") + F.col("__at")).drop("__p", "__part", "__at", "__start", *(f"__g{i}" for i in range(len(group))))
    out.written = (ranged, starts)
    return out
