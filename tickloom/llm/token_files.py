"""Token-ID files: blocks of a static range asymmetric numeral system (rANS).

Layout of a folder, written by Spark's own Parquet writer, so that a lost task leaves nothing half
written and any file system that Spark reads will do:

* ``model``: one row per token id with its frequency in 2^20ths, shared by all blocks;
* ``blocks``: one row per block. A block holds whole documents, in ascending id order, and is coded
  by itself: 4096 lanes run side by side, symbol i belongs to lane i mod 4096, each lane has a 64-bit
  state that sheds 32-bit words into one common stream. Every 128 rounds (524,288 symbols) the
  states, the place in the stream and the crc32 of the ids up to the next such point are kept, so
  that readers can start, or check, in the middle.

Defined cases: a null text is an empty one and has just its end id; documents of one id stand next
to each other, in no particular order but once in the file in a fixed one; a null id comes first;
an empty table gives a folder without blocks, which reads as no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_array, materialize, scratch, slices, table, text_bytes
from .tokens import encoder

BITS = 20
LANES = 4096
LOW = np.uint64(1 << 31)
#: Symbols of a block, about: a block ends with the document that reaches it.
BLOCK = 1 << 20
#: Rounds of all lanes between two checkpoints.
ROUNDS = 128
#: Pieces that a worker remembers here: tokenizing is most of the job, and its tasks hold little else.
PIECES = 600_000

BLOCK_SCHEMA = (
    "shard int, block int, n_tokens long, doc_ids array<bigint>, doc_tokens array<int>, "
    "states binary, words_at array<bigint>, crcs array<bigint>, words binary"
)


# ---- the coder


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies in 2^20ths for all ids of a count table; each id that occurs gets one at least."""
    seen = counts > 0
    if not seen.any():
        return np.zeros(len(counts), np.int64)
    total = 1 << BITS
    if seen.sum() > total:
        raise ValueError("more distinct ids than the table has room for")
    exact = counts / counts.sum() * (total - seen.sum())
    freq = np.where(seen, 1 + np.floor(exact), 0).astype(np.int64)
    # what rounding left over goes to the largest remainders, smaller ids first
    order = np.lexsort((np.arange(len(counts)), -np.where(seen, exact - np.floor(exact), -1)))
    freq[order[: total - freq.sum()]] += 1
    return freq


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """States at each checkpoint (one row each), words read before each, and the words."""
    rounds = -(-len(ids) // LANES)
    x = np.full(LANES, LOW, np.uint64)
    stream: list[np.ndarray] = []
    sent, states, before = 0, [], []
    shift = np.uint64(32 + 31 - BITS)
    for r in range(rounds - 1, -1, -1):
        s = ids[r * LANES : (r + 1) * LANES]
        f, c, y = freq[s], start[s], x[: len(s)]
        full = y >= (f << shift)
        if full.any():
            stream.append(y[full].astype(np.uint32))
            sent += len(stream[-1])
            y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[: len(s)] = (q << np.uint64(BITS)) + (y - q * f) + c
        if r % ROUNDS == 0:
            states.append(x.copy())
            before.append(sent)
    words = np.concatenate(stream[::-1]) if stream else np.zeros(0, np.uint32)
    return np.array(states[::-1], np.uint64).reshape(-1, LANES), [sent - b for b in before[::-1]], words


def decode_part(n: int, x: np.ndarray, words: np.ndarray, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """``n`` ids from the states and the words that follow a checkpoint."""
    out, x, at = np.empty(n, np.int32), x.copy(), 0
    slots, bits, half, low = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32), np.uint64((1 << 32) - 1)
    both = (freq << half) | start  # one lookup for the two
    for i in range(0, n, LANES):
        y = x[: min(LANES, n - i)]
        slot = y & slots
        s = symbol[slot]
        out[i : i + len(s)] = s
        of = both[s]
        y = (of >> half) * (y >> bits) + slot - (of & low)
        need = np.flatnonzero(y < LOW)
        if len(need):
            y[need] = (y[need] << half) | words[at : at + len(need)]
            at += len(need)
        x[: len(y)] = y
    return out


def tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = freq.astype(np.uint64)
    return f, np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.int32), freq)


# ---- the jobs


def token_batches(batches, tokenizer_path: str, end_id: int, narrow: bool = False, keep: bool = True, most: int = 300_000):
    """Arrow batches of (doc_id, n_tokens, ids) from those of (doc_id, text); ``narrow``: two bytes an id if all ids fit; without ``keep``, the worker forgets its pieces after the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    code = encoder(tokenizer_path, most)
    # the end id may be beyond the vocabulary
    kind = code.kind if narrow and end_id <= np.iinfo(code.kind).max else np.dtype("<u4")
    for batch in batches:
        column = batch.column(1)
        sizes = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))))
        for i, j in slices(sizes, 1 << 21):
            ids, n = code.encode([t or "" for t in column.slice(i, j - i).to_pylist()])
            flat = np.insert(ids.astype(kind), np.cumsum(n), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n + 1), binary_array(flat, n + 1)], schema=schema)
    if not keep:
        code.forget()


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers, the end id last."""
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda b: token_batches(b, tokenizer_path, end_id), "doc_id long, n_tokens long, ids binary")


def _ids_of(n: int, ids: pa.BinaryScalar) -> np.ndarray:
    data = ids.as_buffer()
    return np.frombuffer(data, np.uint16 if data.size == 2 * n else np.uint32)


def count_ids(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs; as many rows as the vocabulary has at most, so the driver may hold them."""

    def run(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            data, _ = text_bytes(batch.column(1))
            if not len(data):
                continue
            # all rows have the same bytes an id
            got = np.bincount(data.view(np.uint16 if len(data) == 2 * pc.sum(batch.column(0)).as_py() else np.uint32))
            if len(got) > len(total):
                total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
            total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    counted = tokens.select("n_tokens", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in counted.collect()}


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encode all texts in ascending id order into a folder of the format above."""
    spark = docs.sparkSession
    narrow = id_and_text(docs, id_col, text_col).mapInArrow(lambda b: token_batches(b, tokenizer_path, end_id, True, most=PIECES), "doc_id long, n_tokens long, ids binary")
    tokens = materialize(narrow, "token-ids")
    counts = count_ids(tokens)
    n = np.zeros(max(counts, default=0) + 1, np.int64)
    for k, v in counts.items():
        n[k] = v
    freq = quantise(n)
    spark.createDataFrame([(int(k), int(freq[k])) for k in np.flatnonzero(freq)], "id int, freq int").coalesce(1).write.parquet(f"{path}/model")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(freq)

    def run(batches):
        f, start, _ = tables(shared.value)
        shard, block, filled = TaskContext.get().partitionId(), 0, 0
        docs, sizes, held = [], [], []

        def close():
            nonlocal block, filled
            ids = np.concatenate(held)
            states, at, words = encode_block(ids, f, start)
            step = ROUNDS * LANES
            crcs = [zlib.crc32(ids[i : i + step].astype("<u4").tobytes()) for i in range(0, len(ids), step)]
            row = {"shard": [shard], "block": [block], "n_tokens": [len(ids)], "doc_ids": [docs[:]], "doc_tokens": [sizes[:]], "states": [states.tobytes()], "words_at": [at], "crcs": [crcs], "words": [words.tobytes()]}
            block, filled = block + 1, 0
            docs.clear(), sizes.clear(), held.clear()
            kinds = {"shard": pa.int32(), "block": pa.int32(), "n_tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()), "doc_tokens": pa.list_(pa.int32()), "states": pa.binary(), "words_at": pa.list_(pa.int64()), "crcs": pa.list_(pa.int64()), "words": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in row.items()], names=list(row))

        for batch in batches:
            for doc, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held.append(_ids_of(n, ids))
                docs.append(doc)
                sizes.append(len(held[-1]))
                filled += sizes[-1]
                if filled >= BLOCK:
                    yield close()
        if docs:
            yield close()

    ordered = tokens.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.crc32("ids"), "ids")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, doc_id, at, n_tokens, ids) of every document, ``at`` within its block; raises if a checksum is off."""
    model = spark.read.schema("id int, freq int").parquet(f"{path}/model").collect()  # the vocabulary at most
    freq = np.zeros(max((r.id for r in model), default=0) + 1, np.int64)
    for r in model:
        freq[r.id] = r.freq
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    names = ["shard", "block", "doc_id", "at", "n_tokens", "ids"]

    def run(batches):
        f, start, symbol = tables(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                n, step = row["n_tokens"], ROUNDS * LANES
                words = np.frombuffer(row["words"], np.uint32)
                states = np.frombuffer(row["states"], np.uint64).reshape(-1, LANES)
                parts = []
                for k, (x, at, crc) in enumerate(zip(states, row["words_at"], row["crcs"])):
                    parts.append(decode_part(min(step, n - k * step), x, words[at:], f, start, symbol).astype("<u4"))
                    if zlib.crc32(parts[-1].tobytes()) != crc:
                        raise ValueError(f"shard {row['shard']}, block {row['block']}, part {k}: checksum differs")
                ids, sizes = np.concatenate(parts), np.array(row["doc_tokens"], np.int64)
                m = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, row["shard"], np.int32)), pa.array(np.full(m, row["block"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), binary_array(ids, sizes)],
                    names=names,
                )

    return blocks.mapInArrow(run, "shard int, block int, doc_id long, at long, n_tokens long, ids binary")


def with_starts(decoded: DataFrame, path: str) -> DataFrame:
    """Rows of ``read_blocks``, or what was made of them, with start: the ids of all documents before this one."""
    # ids before each block: a running sum over shards, and one over the blocks of each shard
    sizes = decoded.sparkSession.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").select("shard", "block", "n_tokens")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    starts = (
        sizes.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(shards, "shard")
        .select("shard", "block", (F.col("before") + F.col("within")).alias("block_start"))
    )
    return decoded.join(starts, ["shard", "block"]).withColumn("start", F.col("block_start") + F.col("at")).drop("block_start", "at")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, doc_id, n_tokens, ids, start) of every document."""
    return with_starts(read_blocks(spark, path), path)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    # the digest is taken before the join, which then moves no ids
    digests = read_blocks(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return with_starts(digests, path).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op2_token_files": op2_token_files}
ORACLE: dict[str, str] = {}
