"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint of 64 bits is the majority of the XXH64 (seed 42) of a text's word shingles. Texts of
one fingerprint are one class; classes whose fingerprints differ in at most two bits are linked.
Of two such fingerprints at least one of three blocks of bits is equal, so each is dealt three
times, by each block, with that block turned to the front. Each task then has tries of sorted
fingerprints and walks pairs of nodes down together, all pairs of one depth at a time: a pair adds one
for each bit in which its nodes part and is dropped beyond two. A block value that very many
fingerprints share is dealt again by three blocks of its other bits, which loses no pair either.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer
words than a shingle make one shingle; rows without an id are linked but never stand for a component,
whose id is null if none of its rows has one; repeated rows fall in one class; an empty table gives
an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_counted, materialize, released, row_key, slices, table, text_bytes
from .components import components
from .near_sets import set_links, with_bands

BITS = 64
BUDGET = 2
#: Fingerprints that share a block's value before its other bits are used to deal them.
CROWD = 20_000


def fingerprints(buf: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    """The fingerprint of every text in a run of texts, as signed 64-bit integers."""
    raw = buf.tobytes().lower()
    out = np.zeros(len(offsets) - 1, np.uint64)
    for n, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        words = raw[a:b].split()
        if not words:
            continue
        line = b" ".join(words)
        width = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(width)
        k = min(shingle, len(words))
        first, last = (ends - width)[: len(words) - k + 1], ends[k - 1 :] - 1
        cut = map(line.__getitem__, map(slice, first.tolist(), last.tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(42)), np.uint64, len(first))
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[n] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """``docs`` and one more column, the fingerprint of its text."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            buf, offsets = text_bytes(batch.column(at))
            parts = [fingerprints(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle) for i, j in slices(offsets, 1 << 21)]
            got = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*batch.schema.names, name])

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def trie_pairs(values: np.ndarray, groups: np.ndarray, fixed: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of places in ``values`` of one group whose bits differ in at most ``budget`` places.

    ``values``: distinct within each group, sorted by (group, value); the first ``fixed`` bits of a
    group's values are equal, so its trie starts below them.
    """
    edge = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if len(groups) else np.zeros(0, np.int64)
    lo = edge.astype(np.int64)
    hi = np.concatenate((edge[1:], [len(values)])).astype(np.int64) if len(edge) else lo
    big = hi - lo > 1
    # node pairs: [a, b) against [c, d); a == c is a node with itself
    a, b, c, d = lo[big], hi[big], lo[big], hi[big]
    err = np.zeros(len(a), np.int8)
    for depth in range(fixed, BITS):
        if not len(a):
            break
        zeros = np.concatenate(([0], np.cumsum((values >> np.uint64(BITS - 1 - depth)) & np.uint64(1) == 0)))
        m, n = a + zeros[b] - zeros[a], c + zeros[d] - zeros[c]
        itself = a == c
        nxt = [
            (a, m, c, n, err),
            (m, b, n, d, err),
            (a, m, n, d, err + 1),
            (m[~itself], b[~itself], c[~itself], n[~itself], err[~itself] + 1),
        ]
        a, b, c, d, err = (np.concatenate(x) for x in zip(*nxt))
        live = (err <= budget) & (b > a) & (d > c) & ~((a == c) & (b - a < 2))
        a, b, c, d, err = a[live], b[live], c[live], d[live], err[live]
    return a, c


def _blocks(width: int) -> list[tuple[int, int]]:
    """(first bit, bits) of three blocks of ``width`` bits."""
    w = [width // 3 + (k < width % 3) for k in range(3)]
    return [(0, w[0]), (w[0], w[1]), (w[0] + w[1], w[2])]


def _turned(value, first: int, keep: int):
    """Bits after the first ``keep`` turned so that bit ``first`` of them leads; ``keep`` leading bits stay."""
    low = BITS - keep
    if not first:
        return value
    mask = F.lit((1 << low) - 1 if low < 64 else -1)
    tail = value.bitwiseAND(mask)
    turned = F.shiftleft(tail, first).bitwiseAND(mask).bitwiseOR(F.shiftrightunsigned(tail, low - first))
    return turned if not keep else value.bitwiseAND(F.lit(~((1 << low) - 1))).bitwiseOR(turned)


def near_links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): pairs of distinct fingerprints, each once, that differ in at most two bits. prints: (fp), distinct."""
    def dealt(df: DataFrame, value: str, keep: int, name: str) -> DataFrame:
        """A row for each of three blocks: its number, the turned value, and the bits that are then fixed."""
        each = [F.struct(F.lit(k).alias(name), _turned(F.col(value), first, keep).alias("v"), F.lit(keep + bits).alias("fixed")) for k, (first, bits) in enumerate(_blocks(BITS - keep))]
        return df.withColumn("x", F.explode(F.array(*each)))

    top = dealt(prints, "fp", 0, "block").select("fp", "x.block", "x.v", "x.fixed").withColumn("head", F.expr("shiftrightunsigned(v, 64 - fixed)"))
    crowded = top.groupBy("block", "head").count().where(F.col("count") > crowd).select("block", "head", F.lit(True).alias("crowded"))
    marked = top.join(crowded, ["block", "head"], "left")
    calm = marked.where("crowded is null").select("fp", "v", "fixed", "block", "head", F.lit(0).alias("sub"), F.lit(0).cast("long").alias("subhead"))
    parts = []
    for block, (_, bits) in enumerate(_blocks(BITS)):
        again = dealt(marked.where(F.col("crowded") & (F.col("block") == block)).select("fp", "v", "block", "head"), "v", bits, "sub")
        parts.append(
            again.select("fp", F.col("x.v").alias("v"), F.col("x.fixed").alias("fixed"), "block", "head", (F.col("x.sub") + 1).alias("sub"))
            .withColumn("subhead", F.expr("shiftrightunsigned(v, 64 - fixed)"))
        )
    for p in parts:
        calm = calm.unionByName(p)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        cols = [b.select(["fp", "v", "fixed", "block", "head", "sub", "subhead"]) for b in batches]
        if not cols:
            return
        t = pa.Table.from_batches(cols)
        fp, v, fixed, block, head, sub, subhead = (t.column(k).to_numpy() for k in range(7))
        v = v.view(np.uint64)
        for f in np.unique(fixed):
            own = np.flatnonzero(fixed == f)
            own = own[np.lexsort((v[own], subhead[own], head[own], sub[own], block[own]))]
            keys = np.column_stack([x[own] for x in (block, sub, head, subhead)])
            new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
            i, j = trie_pairs(v[own], np.cumsum(new), int(f))
            x, y = fp[own[i]], fp[own[j]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)

    return calm.repartition("block", "head", "sub", "subhead").mapInArrow(released(run), "a long, b long").distinct()


def near_duplicates(prints: DataFrame, id_col: str = "doc_id", crowd: int = CROWD, more=None) -> DataFrame:
    """(fp, root, component_id, links): the classes of (id, fingerprint) rows, each with the smallest id that it reaches; root tells components apart.

    ``more``, a function of the links, gives others that make the components instead; links are then not counted.
    """
    classes = materialize(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id_col).alias("first_id")), "classes")
    links = materialize(near_links(classes.select("fp"), crowd), "near-links")
    roots = components(links if more is None else more(links))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = rooted.join(least, "root")
    if more is not None:
        return found.select("fp", "root", "component_id")
    degree = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("links"))
    return found.join(degree, "fp", "left").select("fp", "root", "component_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def simhash_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, links) per row of ``docs``."""
    prints = materialize(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", F.col("fingerprint").alias("fp")), "fingerprints")
    rows = prints.groupBy("fp").agg(F.count("*").alias("rows"))
    classes = materialize(near_duplicates(prints.withColumnRenamed("fp", "fingerprint")).join(rows, "fp"), "classes-of-prints")
    # a fingerprint that many rows share, as of blank texts or a licence, meets its class in every task
    return join_counted(prints, classes, ["fp"], "rows", prints.count()).select("doc_id", "fp", "component_id", "links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, words: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, or one of those without an id if all are.

    With ``similarity``, texts are also linked whose sets of shingles of ``words`` words are at least so similar.
    """
    printed = with_fingerprint(docs, text_col, "__print")
    printed = materialize(printed if similarity is None else with_bands(printed, text_col, words), "printed")
    more = None if similarity is None else lambda links: set_links(printed, links, text_col, words, similarity)
    classes = near_duplicates(printed.select(F.col(id_col).alias("doc_id"), F.col("__print").alias("fingerprint")), more=more)
    classes = classes.select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), F.col("component_id").alias("__least"))
    kept = printed.join(classes, F.col("__print") == F.col("__fp")).where(F.col(id_col).eqNullSafe(F.col("__least")))
    # rows that repeat an id; a component has few others left here
    again = F.row_number().over(Window.partitionBy("__root").orderBy(row_key(id_col, text_col)))
    return kept.withColumn("__again", again).where("__again = 1").select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


QUERIES = {"op4_simhash": op4_simhash}
ORACLE: dict[str, str] = {}
