"""Exact nearest neighbours by a block matrix join with int8 tiles.

Vectors are packed in blocks: one row holds some thousands of vectors as int8 with a scale each, and
as the floats they were (in four bytes if that is exact). Every block of queries meets every block of
candidates in a tile, a task's work of its own. In a tile the int8 product (exact, as it is summed in
float32 over at most 1024 components at a time, so under 2^24) gives each score up to a bound on the quantisation error, |q.c - q'.c'| <= |q - q'||c| + |q'||c - c'|. A pair survives if its upper bound
reaches the k-th best lower bound of its query; survivors are computed again in double precision and
go through a heap of k. The heaps of all tiles of a query are merged the same way.

Defined cases: vectors that are null, zero, or hold a null or a number that is not finite take no
part; vectors of different length never meet; vectors of no elements take no part; a null id is no
query but a candidate, last among ties; rows that repeat an id are queries and candidates each, and of the
candidates that equal a query in id and vector one, its own row, is left out, so equal rows find each other;
an empty table gives an empty result. Other columns than the first two are not allowed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Vectors in a block of queries and of candidates, and queries of a tile scored at a time (16 MB of scores).
QUERY_BLOCK = 4096
BLOCK = 8192
ROWS = 512
#: Components whose int8 products are summed in float32: 127 * 127 * 1024 is under 2^24.
EXACT = 1024

PACKED = "dim int, n int, ids binary, small binary, scales binary, slack binary, norms binary, floats binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, norm of what rounding lost, and norm of each row; the norms rounded up."""
    scale = np.abs(x).max(axis=1) / 127
    with np.errstate(invalid="ignore", over="ignore"):
        small = np.rint(x / scale[:, None]).astype(np.int8)
        lost = np.sqrt(((x - small * scale[:, None]) ** 2).sum(axis=1))
        norm = np.sqrt((x**2).sum(axis=1))
    return small, scale, lost * (1 + 1e-9), norm * (1 + 1e-9)


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of PACKED from (id, vector): each holds up to ``size`` vectors of one length."""
    names = [c.split()[0] for c in PACKED.split(", ")]

    def packed(dim: int, ids: list, rows: list) -> pa.RecordBatch:
        x = np.array(rows, np.float64)
        small, scale, lost, norm = quantise(x)
        # the largest long stands for a null id
        number = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        short = x.astype(np.float32)
        cells = [number, small, scale, lost, norm, short if (short == x).all() else x]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=names)

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not v or None in v:
                    continue
                a = np.asarray(v, np.float64)
                if not np.isfinite(a).all() or not a.any():
                    continue
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(a)
                if len(ids) == size:
                    yield packed(len(v), *held.pop(len(v)))
        for dim, (ids, rows) in held.items():
            yield packed(dim, ids, rows)

    return vectors.mapInArrow(run, PACKED)


def _unpack(row: dict) -> tuple[np.ndarray, ...]:
    n, dim = row["n"], row["dim"]
    f = lambda k: np.frombuffer(row[k], np.float64)
    floats = np.frombuffer(row["floats"], np.float32 if len(row["floats"]) == 4 * n * dim else np.float64).reshape(n, dim)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["small"], np.int8).reshape(n, dim), f("scales"), f("slack"), f("norms"), floats.astype(np.float64)


def tile_best(q: tuple, c: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best k candidates of each query of a tile: places of query and candidate, scores, and whether the two are equal."""
    qid, q8, qs, ql, qn, qx = q
    cid, c8, cs, cl, cn, cx = c
    parts = [(q8[:, d : d + EXACT].astype(np.float32), c8[:, d : d + EXACT].astype(np.float32).T) for d in range(0, q8.shape[1], EXACT)]
    places, found, exact, same = [], [], [], []
    for i in range(len(qid)):
        if i % ROWS == 0:
            scores = parts[0][0][i : i + ROWS] @ parts[0][1]
            for left, right in parts[1:]:
                scores = scores + (left[i : i + ROWS] @ right).astype(np.float64)
        near = scores[i % ROWS] * (qs[i] * cs)
        # |q'| <= |q| + what rounding lost; the last term is for the rounding of this arithmetic itself
        slack = ql[i] * cn + (qn[i] + ql[i]) * cl + 1e-12 * qn[i] * cn
        low = near - slack
        at = np.arange(len(cid)) if len(cid) <= k else np.flatnonzero(near + slack >= np.partition(low, -k)[-k])
        # one sum over the components in their order, so that equal vectors get equal scores
        score = np.add.accumulate(qx[i] * cx[at], axis=1)[:, -1]
        best = heapq.nsmallest(k, range(len(at)), key=lambda j: (-score[j], cid[at[j]]))
        own = at[best]
        places += [i] * len(best)
        found += own.tolist()
        exact += score[best].tolist()
        same += ((cid[own] == qid[i]) & (cx[own] == qx[i]).all(axis=1)).tolist()
    return np.array(places, np.int64), np.array(found, np.int64), np.array(exact, np.float64), np.array(same, bool)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` its k best of ``vectors``; both (id, vector)."""
    spark = vectors.sparkSession
    c = materialize(blocks(vectors, block).withColumn("c", F.monotonically_increasing_id()), "vector-blocks")
    # full blocks of queries: each block of candidates is sent once for each of them
    dealt = queries.repartition(max(1, -(-queries.count() // query_block)))
    q = materialize(blocks(dealt, query_block).withColumn("q", F.monotonically_increasing_id()), "query-blocks")
    # a tile is a row: the numbers of all blocks of one length (packed rows, few) are laid to each block of the other side
    payload = ("n", "ids", "small", "scales", "slack", "norms", "floats")
    facing = q.groupBy("dim").agg(F.collect_list("q").alias("qs"))
    left = c.join(facing, "dim").select("*", F.explode("qs").alias("q")).drop("qs")
    facing = c.groupBy(F.col("dim").alias("q_dim")).agg(F.collect_list("c").alias("cs"))
    right = q.join(facing, q.dim == F.col("q_dim")).select("q_dim", "q", F.explode("cs").alias("c"), *(F.col(x).alias(f"q_{x}") for x in payload))
    # a fixed number of tasks: tiles are few bytes and much work, so they shouldn't be put together
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = left.repartition(tasks, "q", "c").join(right.repartition(tasks, "q", "c"), ["q", "c"])
    names = ["q", "i", "query_id", "vec_id", "score", "same"]

    def run(batches):
        for batch in batches:
            for k_ in range(batch.num_rows):
                row = {n: v[0] for n, v in batch.slice(k_, 1).to_pydict().items()}
                cand = _unpack(row)
                quer = _unpack({n[2:]: v for n, v in row.items() if n.startswith("q_")})
                # one more than asked for, as a query's own row goes at the end
                i, j, s, same = tile_best(quer, cand, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), row["q"])), pa.array(i), pa.array(quer[0][i]), pa.array(cand[0][j]), pa.array(s), pa.array(same)], names=names)

    found = tiles.mapInArrow(run, "q long, i long, query_id long, vec_id long, score double, same boolean")

    def merge(key, rows):
        # at most k + 1 rows of each tile of one query
        vec, score, same = (rows.column(x).to_numpy() for x in ("vec_id", "score", "same"))
        best = heapq.nsmallest(k + 1, range(len(vec)), key=lambda j: (-score[j], vec[j], not same[j]))
        own = [j for j in best if same[j]][:1]
        best = [j for j in best if j not in own][:k]
        query = rows.column("query_id")[0].as_py()
        return pa.table({"query_id": pa.array([query] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()), "vec_id": pa.array(vec[best]), "score": pa.array(score[best])})

    best = found.groupBy("q", "i").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
    return best.withColumn("vec_id", F.when(F.col("vec_id") != np.iinfo(np.int64).max, F.col("vec_id")))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op9_vector_search": op9_vector_search}
ORACLE = {
    "op9_vector_search": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""
}
