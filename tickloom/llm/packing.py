"""Packing documents into windows of bounded length, in bounded space.

Every task keeps a fixed number of open windows. The tail of a document (what is left after cutting
off full windows) goes to the open window that it fits best; if it fits none, a new window is opened,
and if all may be open already, the fullest is closed first. What is still open at the end of each
task is merged: the leftovers of some tens of tasks at a time are packed in the same way as wholes.

Defined cases: a null text is an empty one and has just its end id; null ids and repeated rows are
packed like any others; an empty table gives no pieces. Only the id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_array, materialize, released, table
from .token_files import id_and_text, token_batches

LENGTH = 2048
OPEN = 128
#: Tasks whose leftovers one task merges.
MERGED = 32

PIECES = "window long, offset long, doc_id long, start long, length long, doc_tokens long, open boolean, ids binary"


class Windows:
    """A bounded set of open windows; ``place`` returns (window, offset) for an item."""

    def __init__(self, first: int, length: int, most: int):
        self.next, self.length, self.most = first, length, most
        self.open: list[tuple[int, int]] = []  # (used, window), fullest last

    def place(self, size: int) -> tuple[int, int]:
        # the fullest window that still has room fits best
        k = bisect_left(self.open, (self.length - size + 1, -1)) - 1
        if k >= 0:
            used, window = self.open.pop(k)
        else:
            if len(self.open) == self.most:
                self.open.pop()
            used, window = 0, self.next
            self.next += 1
        if used + size < self.length:
            insort(self.open, (used + size, window))
        return window, used


def pack(tokens: DataFrame, length: int = LENGTH, open_windows: int = OPEN, read=None) -> DataFrame:
    """(sequence_id, offset, doc_id, start, length, doc_tokens, ids) per piece of (doc_id, n_tokens, ids).

    ``read`` makes Arrow batches of these columns from those of ``tokens``, if it has others, in the same task.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        task = TaskContext.get().partitionId()
        windows = Windows(task << 32, length, open_windows)
        # pieces of windows that may still grow are held back, at most open_windows * length ids
        held: dict[int, list[tuple]] = {}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], schema=schema)

        for batch in read(batches) if read else batches:
            out: list[tuple] = []
            for doc, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = ids.as_py()
                full = n - n % length
                for at in range(0, full, length):
                    out.append((windows.next, 0, doc, at, length, n, False, ids[4 * at : 4 * (at + length)]))
                    windows.next += 1
                if n > full:
                    window, offset = windows.place(n - full)
                    held.setdefault(window, []).append((window, offset, doc, full, n - full, n, False, ids[4 * full :]))
                if len(out) > 500:
                    yield batch_of(out)
                    out = []
            still = {w for _, w in windows.open}
            for w in [w for w in held if w not in still]:
                out += held.pop(w)
            if out:
                yield batch_of(out)
        for used, w in windows.open:
            yield batch_of([(*x[:6], True, x[7]) for x in held.pop(w)])
        for rows in held.values():
            yield batch_of(rows)

    pieces = materialize(tokens.mapInArrow(released(run), PIECES), "pieces")

    merged_schema = pa.schema([("old", pa.int64()), ("sequence_id", pa.int64()), ("base", pa.int64())])

    def merge(batches):
        # ids of merged sequences are negative: they can't be those of any task above
        windows = Windows(TaskContext.get().partitionId() << 32, length, open_windows)
        for batch in batches:
            got = [(w, *windows.place(used)) for w, used in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if got:
                old, seq, base = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(old), pa.array([-1 - s for s in seq]), pa.array(base)], schema=merged_schema)

    left = pieces.where("open").groupBy("window").agg(F.sum("length").alias("used"))
    group = F.floor(F.shiftright("window", 32) / F.lit(MERGED))
    # of each group's windows the fullest first; one group holds MERGED * OPEN rows of two numbers at most
    merged = (
        left.withColumn("task_group", group).repartition("task_group").sortWithinPartitions("task_group", F.desc("used"), "window")
        .select("window", "used").mapInArrow(merge, "old long, sequence_id long, base long")
    )
    columns = ["offset", "doc_id", "start", "length", "doc_tokens", "ids"]
    closed = pieces.where("not open").select(F.col("window").alias("sequence_id"), *columns)
    moved = pieces.where("open").join(materialize(merged, "merged"), F.col("window") == F.col("old"))
    return closed.unionByName(moved.withColumn("offset", F.col("offset") + F.col("base")).select("sequence_id", *columns))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Tokenize and pack: the pieces of all texts, with their ids; without ``keep``, workers forget the tokenizer's pieces after each task."""
    return pack(id_and_text(docs, id_col, text_col), length, read=lambda b: token_batches(b, tokenizer_path, end_id, keep=keep))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op5_packing": op5_packing}
ORACLE: dict[str, str] = {}
