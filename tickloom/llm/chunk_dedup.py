"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a place depends on the 32 bytes up to it: each step shifts it by one bit and adds a
number for the new byte. A chunk may end where the hash's leading bits are zero, so an insertion moves
the cuts next to it and no others. Chunks are as long as two bounds allow (the last takes a
shorter tail with it); equal ones (by a 128-bit
digest of the bytes) are one chunk, kept where it first starts by document id and place, and removed elsewhere.

Defined cases: a null text is an empty one, without chunks; of rows with one id, repeated or not, the
order is that of a hash of the text, and equal rows count as one place, so both keep what one would; a
null id comes last in the order of documents; an empty table gives an empty result. Only the id and text columns are read; others
pass through, but for those of the result's names, which are replaced (names that begin with two underscores are used inside).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_counted, materialize, row_key, slices, table, text_bytes

LEAST, MEAN_BITS, MOST = 32, 6, 256
SLICE = 1 << 18


def gear_table() -> np.ndarray:
    """A 32-bit number for each byte value, by the xorshift rule."""
    out, x = np.zeros(256, np.uint32), 0x9E3779B9
    for i in range(256):
        for shift, left in ((13, True), (17, False), (5, True)):
            x = (x ^ ((x << shift) if left else (x >> shift))) & 0xFFFFFFFF
        out[i] = x
    return out


_GEAR = gear_table()


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, of the 32 bytes up to it (fewer at the start)."""
    h, width = _GEAR[buf].astype(np.uint32), 1
    while width < 32:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width) if width < len(h) else 0
        h, width = wider, 2 * width
    return h


def cuts(buf: np.ndarray, offsets: np.ndarray, least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> list[list[int]]:
    """For each text in a run of texts, the ends of its chunks, counted from its start."""
    if not len(buf):
        return [[] for _ in offsets[1:]]
    good = np.flatnonzero(gear_hashes(buf) >> np.uint32(32 - bits) == 0) + 1
    lo = np.searchsorted(good, offsets[:-1] + least)
    hi = np.searchsorted(good, offsets[1:])
    out = []
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lo.tolist(), hi.tolist()):
        ends, at = [], a
        for g in good[i:j].tolist():
            while g - at > most:
                at += most
                ends.append(at - a)
            if g - at >= least:
                at = g
                ends.append(at - a)
        while b - at > most:
            at += most
            ends.append(at - a)
        if ends and b - at < least:
            ends[-1] = b - a  # a short tail is no chunk of its own: a full stop would repeat everywhere
        elif b > at:
            ends.append(b - a)
        out.append(ends)
    return out


def chunks(docs: DataFrame, least: int, bits: int, most: int) -> DataFrame:
    """(doc_id, row, start, size, d1, d2) per chunk of (doc_id, row, text)."""
    names = ["doc_id", "row", "start", "size", "d1", "d2"]

    def run(batches):
        for batch in batches:
            buf, offsets = text_bytes(batch.column(2))
            for i, j in slices(offsets, SLICE):
                local = offsets[i : j + 1] - offsets[i]
                part = buf[offsets[i] : offsets[j]]
                # a text's first hashes must not see the text before it, but chunks are 32 bytes at least, so no cut does
                raw = part.tobytes()
                ends = cuts(part, local, least, bits, most)
                n = np.fromiter(map(len, ends), np.int64, len(ends))
                if not n.sum():
                    continue
                end = np.fromiter((e for x in ends for e in x), np.int64, int(n.sum()))
                start = np.concatenate(([0], end[:-1]))
                start[(np.cumsum(n) - n)[n > 0]] = 0
                base = np.repeat(local[:-1], n)
                digest = b"".join([hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip((base + start).tolist(), (base + end).tolist())])
                d = np.frombuffer(digest, np.int64).reshape(-1, 2)
                at = pa.array(np.repeat(np.arange(i, j), n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(start), pa.array((end - start).astype(np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1])], names=names
                )

    return docs.mapInArrow(run, "doc_id long, row long, start long, size int, d1 long, d2 long")


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> DataFrame:
    """``docs`` with n_chunks, removed_spans (from, to in bytes) and kept_bytes per row."""
    if least < 32:
        raise ValueError("a chunk must be as long as the hash's window, 32 bytes, at least")
    docs = docs.drop("n_chunks", "removed_spans", "kept_bytes")
    keyed = docs.withColumn("__row", row_key(id_col, text_col))
    texts = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col("__row").alias("row"), F.col(text_col).alias("text"))
    cut = materialize(chunks(texts, least, bits, most), "chunks")
    # nulls sort first in structs, so the flag puts rows without an id last
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "start")
    first = cut.groupBy("d1", "d2").agg(F.count("*").alias("times"), F.min(place).alias("kept")).where("times > 1")
    late = (
        join_counted(cut, materialize(first, "repeated-chunks"), ["d1", "d2"], "times", cut.count())
        .where(~place.eqNullSafe(F.col("kept")))
        .groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__key"))
        .agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("__late"))
    )
    joined = keyed.join(late, F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__key")), "left").drop("__doc", "__key", "__row")
    at, late_at = joined.columns.index(text_col), joined.columns.index("__late")
    fields = [*docs.schema.fields, T.StructField("n_chunks", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.LongType())), T.StructField("kept_bytes", T.BinaryType())]

    def run(batches):
        for batch in batches:
            buf, offsets = text_bytes(batch.column(at))
            n = [len(c) for i, j in slices(offsets, SLICE) for c in cuts(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], least, bits, most)]
            spans, kept = [], []
            for k, gone in enumerate(batch.column(late_at).to_pylist()):
                raw = buf[offsets[k] : offsets[k + 1]].tobytes()
                edges: list[int] = []
                for x in gone or []:
                    a, b = x["start"], x["start"] + x["size"]
                    if edges and edges[-1] == a:
                        edges[-1] = b
                    else:
                        edges += [a, b]
                spans.append(edges)
                whole = [0, *edges, len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(whole[::2], whole[1::2])))
            own = [c for k, c in enumerate(batch.columns) if k != late_at]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=[f.name for f in fields])

    return joined.mapInArrow(run, T.StructType(fields))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pairs = F.size("removed_spans")
    removed = F.aggregate("removed_spans", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("k")), lambda a, x: F.struct((a.s + x * a.k).alias("s"), (-a.k).alias("k")), lambda a: a.s)
    return out.select(
        "doc_id",
        (F.octet_length("kept_bytes") + removed).cast("long").alias("n_bytes"),
        "n_chunks",
        removed.alias("n_removed"),
        (pairs / 2).cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


QUERIES = {"op8_chunk_dedup": op8_chunk_dedup}
ORACLE: dict[str, str] = {}
