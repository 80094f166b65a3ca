"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of a word in every operator here.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` names a folder that the driver and all executors share. Where it
    is unset and Spark runs in one process (tests), the session's own warehouse folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a looked-up table up to which it is sent to all tasks.
SMALL = 100_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, a written table, marked for broadcast if it has at most ``rows`` rows; they are counted here."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, whose ``count`` says how many of the ``total`` rows of left have its key.

    Keys that more than a thousandth of all rows have are fewer than a thousand, so they are sent to all
    tasks and no task gets such a key's rows; the rest meets in a shuffle. Both should be written tables.
    """
    hot = F.broadcast(right.where(F.col(count) * 1000 > total))
    rest = right.where(F.col(count) * 1000 <= total)
    return left.join(hot, keys).unionByName(left.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array and the n + 1 offsets into it."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def released(run):
    """``run``, a function of Arrow batches, that hands what Arrow's pool keeps back to the system after a task, as Spark keeps its workers."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def slices(offsets: np.ndarray, limit: int):
    """Consecutive runs (i, j) of rows whose texts hold about ``limit`` bytes together."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def row_key(id_col: str, text_col: str):
    """Tells rows apart that share an id: equal only for the same id and the same text."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column over one flat array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def binary_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow binary column: row i is the next ``lengths[i]`` items of ``values`` as bytes."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(np.asarray(lengths) * values.dtype.itemsize, out=offsets[1:])
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
