"""Importance resampling toward a target: documents whose n-grams are as frequent in the target's texts as in the corpus.

Features are the runs of one word, of two, and so on, as strings; a distinct-feature dictionary does the work.
A task takes its texts in slices of at most 16 MB and makes each slice's own dictionary, in which a document
is a list of (place in the dictionary, count). The dictionaries' strings are dealt by a mixing of their
words' hashes to as many groups as there are 16 MB of text, packed, a row for each slice and group. A group
has every occurrence of its strings, once for each slice, so it counts them over the whole corpus and the whole target,
hashes each distinct string once, adds the counts up by bucket, and answers each slice with the buckets of
its strings in their order. Gains are of as many rows as there are buckets; they are joined back to
the documents' feature counts slice by slice.

Defined cases: a null or empty text has no features and weight 0; a null id draws as the text ``null`` and
stands last among ties; repeated rows are scored each, and take part each; a text longer than a slice is a slice of its
own; empty tables give no rows or, for an empty target, gains from the corpus alone; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices, table, text_bytes
from .order import numbered

#: Bytes of text in a slice, which takes some 30 times as much in its task where arrays go as soon as they have served, and of text whose strings meet in one group.
SLICE = GROUP = 16 << 20
BUCKETS = 10_000

#: Bytes of a word after lower-casing A-Z; all others separate words. Bytes from 0x80 on are those of letters outside ASCII.
SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


# ---- packing of whole numbers


def pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte plane by byte plane."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


# ---- a slice


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words in order, and the place among them and the text of each word."""
    clean = np.frombuffer(buf.tobytes().translate(SPLIT), np.uint8)
    inside = clean != 32
    fresh = np.zeros(len(clean) + 1, bool)
    fresh[1:] = ~inside
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    del fresh
    # bytes of words stand together, so that word i ends where word i + 1 begins
    before = np.zeros(len(clean) + 1, np.int32)
    np.cumsum(inside, out=before[1:])
    ends = np.append(before[starts], before[-1]).astype(np.int32)
    del before
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(clean[inside])]).dictionary_encode()
    order = pc.sort_indices(column.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(np.searchsorted(starts, offsets)))
    return column.dictionary.take(pa.array(order)), rank[column.indices.to_numpy()] if len(starts) else np.zeros(0, np.int32), text


def grams(buf: np.ndarray, offsets: np.ndarray, n: int, groups: int):
    """Strings that end in a line feed and the group of each, by group; words and features of each text; and (text, place, count) of its distinct features."""
    words, ids, text = words_of(buf, offsets)
    m = len(offsets) - 1
    del buf
    mix = np.fromiter((zlib.adler32(w) ^ (len(w) << 7) for i in range(0, len(words), 1 << 16) for w in words.slice(i, 1 << 16).to_pylist()), np.uint64, len(words))
    strings, dealt, at, owner = [words], [mix], [ids], [text]
    now, base = ids, len(words)
    for k in range(1, n):
        # runs that go on: the run before, and the word after it in the same text
        same = text[k:] == text[: max(0, len(text) - k)]
        pair, inverse = np.unique(now[: len(same)][same].astype(np.int64) * (len(words) + 1) + ids[k:][same], return_inverse=True)
        inverse = inverse.astype(np.int32)
        a, b = pair // (len(words) + 1), pair % (len(words) + 1)
        strings.append(pc.binary_join_element_wise(strings[-1].take(pa.array(a)), words.take(pa.array(b)), b" "))
        dealt.append(dealt[-1][a] * np.uint64(0x9E3779B97F4A7C15) + mix[b])
        now = np.full(len(text), -1, np.int32)
        now[: len(same)][same] = inverse
        at.append(inverse + np.int32(base))
        owner.append(text[: len(same)][same])
        base += len(pair)
        del same, pair, inverse, a, b
    del now, ids
    h = np.concatenate(dealt)
    dealt.clear()
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    group = ((h >> np.uint64(32)) % np.uint64(groups)).astype(np.int32)
    del h
    order = np.argsort(group, kind="stable")
    place = np.empty(base, np.int32)
    place[order] = np.arange(base, dtype=np.int32)
    n_words, n_features = np.bincount(text, minlength=m), np.zeros(m, np.int64)
    # one 64-bit key a feature, sorted in place: of all arrays here the longest
    key = np.empty(sum(map(len, at)), np.int64)
    filled = 0
    for who, what in zip(owner, at):
        n_features += np.bincount(who, minlength=m)
        np.add(who.astype(np.int64) * max(base, 1), place[what], out=key[filled : filled + len(who)])
        filled += len(who)
    at.clear(), owner.clear()
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(first, append=len(key)).astype(np.int32)
    key = key[first]
    ended = pc.binary_join_element_wise(pa.concat_arrays(strings).take(pa.array(order)), b"", b"\n")
    return ended, group[order], n_words, n_features, (key // max(base, 1)).astype(np.int32), (key % max(base, 1)).astype(np.int32), count


SLICED = "kind string, target boolean, slice long, part int, strings binary, counts binary, doc_ids array<long>, n_words array<long>, n_features array<long>, entries array<int>, places binary"


def _sliced(batches, n: int, groups: int, target: bool):
    """A slice's dictionary, a row for each group of strings, and one row with its documents."""
    names = [x.split()[0] for x in SLICED.split(", ")]
    kinds = {"kind": pa.string(), "target": pa.bool_(), "slice": pa.int64(), "part": pa.int32(), "strings": pa.binary(), "counts": pa.binary(), "places": pa.binary(), "entries": pa.list_(pa.int32())}
    held, size, number = [], 0, 0
    squeeze = zstandard.ZstdCompressor(level=6)

    def close():
        nonlocal number
        whole = pa.Table.from_batches(held).combine_chunks()
        (batch,) = whole.to_batches() or [held[0]]
        ids, rows = batch.column(0), len(batch)
        ended, group, n_words, n_features, texts, places, count = grams(*text_bytes(batch.column(1)), n, groups)
        del whole, batch
        held.clear()
        # slices are numbered by task, so a task that runs again numbers them alike
        own = ((TaskContext.get().partitionId() * 2 + target) << 24) + number
        number += 1
        total = np.bincount(places, weights=count, minlength=len(ended)).astype(np.int64)
        data, ends = np.frombuffer(ended.buffers()[2], np.uint8) if len(ended) else np.zeros(0, np.uint8), np.frombuffer(ended.buffers()[1], np.int32)[: len(ended) + 1]
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(group)]):
            row = {"kind": "strings", "target": target, "slice": own, "part": int(group[a]), "strings": squeeze.compress(data[ends[a] : ends[b]].tobytes()), "counts": pack(total[a:b])}
            yield pa.RecordBatch.from_arrays([pa.array([row.get(c)], kinds.get(c, pa.list_(pa.int64()))) for c in names], names=names)
        if target:
            return
        entries = np.bincount(texts, minlength=rows).astype(np.int64)
        head = np.cumsum(entries) - entries
        step = np.diff(places, prepend=0)
        step[head[entries > 0]] = places[head[entries > 0]]
        row = {"kind": ["documents"], "target": [target], "slice": [own], "counts": [pack(count)], "places": [pack(step)]}
        lists = {"doc_ids": ids, "n_words": pa.array(n_words), "n_features": pa.array(n_features), "entries": pa.array(entries.astype(np.int32))}
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        yield pa.RecordBatch.from_arrays([one(lists[c]) if c in lists else pa.array(row.get(c, [None]), kinds[c]) for c in names], names=names)

    for batch in batches:
        _, offsets = text_bytes(batch.column(1))
        for i, j in slices(offsets, SLICE):
            more = int(offsets[j] - offsets[i])
            if held and size + more > SLICE:
                yield from close()
                held, size = [], 0
                pa.default_memory_pool().release_unused()
            held.append(batch.slice(i, j - i))
            size += more
    if held:
        yield from close()


# ---- a group of strings


ANSWERS = "kind string, slice long, part int, buckets binary, bucket array<int>, corpus array<long>, aims array<long>"


def _counted(key, blocks: pa.Table, buckets: int) -> pa.Table:
    """Of all blocks of a group: the bucket of every string, block by block, and the sums of each bucket."""
    (part,) = (k.as_py() for k in key)
    expand = zstandard.ZstdDecompressor()
    strings, counts = [], []
    for packed, c in zip(blocks.column("strings").to_pylist(), blocks.column("counts").to_pylist()):
        data = np.frombuffer(expand.decompress(packed), np.uint8)
        ends = np.flatnonzero(data == 10).astype(np.int64) + 1
        strings.append(pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(data)]))
        counts.append(unpack(c))
    sizes = np.array([len(c) for c in counts])
    total = np.concatenate(counts)
    counts.clear()
    coded = pa.concat_arrays(strings).dictionary_encode()
    strings.clear()
    at = coded.indices.to_numpy()
    # each distinct string once; its line feed isn't part of it
    distinct = (s[:-1] for i in range(0, len(coded.dictionary), 1 << 16) for s in coded.dictionary.slice(i, 1 << 16).to_pylist())
    bucket = (np.fromiter(map(zlib.crc32, distinct), np.int64, len(coded.dictionary)) % buckets).astype(np.int32)
    found = bucket[at]
    del coded, at
    target = np.repeat(blocks.column("target").to_numpy(zero_copy_only=False).astype(bool), sizes)
    sums = [np.bincount(found[side], weights=total[side], minlength=buckets).astype(np.int64) for side in (~target, target)]
    used = np.flatnonzero(sums[0] + sums[1])
    ends = np.cumsum(sizes)
    kept = [i for i, t in enumerate(blocks.column("target").to_pylist()) if not t]
    rows = [{"kind": "buckets", "slice": blocks.column("slice")[i].as_py(), "part": part, "buckets": pack(found[ends[i] - sizes[i] : ends[i]])} for i in kept]
    rows.append({"kind": "sums", "part": part, "bucket": used.astype(np.int32), "corpus": sums[0][used], "aims": sums[1][used]})
    pa.default_memory_pool().release_unused()
    kinds = {"kind": pa.string(), "slice": pa.int64(), "part": pa.int32(), "buckets": pa.binary(), "bucket": pa.list_(pa.int32()), "corpus": pa.list_(pa.int64()), "aims": pa.list_(pa.int64())}
    return pa.table({c: pa.array([r.get(c) for r in rows], kind) for c, kind in kinds.items()})


def _weighed(answers: pa.Table, docs: pa.Table, gains: np.ndarray) -> pa.Table:
    """Features and the floored mean gain of each document of a slice."""
    answers = answers.sort_by("part")
    bucket = [unpack(b) for b in answers.column("buckets").to_pylist()]
    gain = gains[np.concatenate(bucket)] if bucket else np.zeros(0, np.int64)
    out = []
    for row in docs.to_pylist():  # one row
        entries, step, count = np.array(row["entries"], np.int64), unpack(row["places"]), unpack(row["counts"])
        text = np.repeat(np.arange(len(entries)), entries)
        # places are steps from the one before within a document
        upto = np.cumsum(step, dtype=np.int64)
        ends = np.cumsum(entries)
        upto -= np.repeat(np.concatenate([[0], upto])[ends - entries], entries)
        total = np.bincount(text, weights=gain[upto] * count, minlength=len(entries)).astype(np.int64)
        n = np.array(row["n_features"], np.int64)
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        out.append(pa.table({"id": pa.array(row["doc_ids"], pa.int64()), "n_words": pa.array(row["n_words"], pa.int64()), "n_features": pa.array(n), "weight": pa.array(weight)}))
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("id", "n_words", "n_features", "weight")})
    return pa.concat_tables(out) if out else empty


def _bytes(texts: DataFrame) -> int:
    return texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0].n


def feature_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight) of every document: the floored mean of its features' gains, in thousandths."""
    spark = docs.sparkSession
    corpus = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    aim = target.select(F.lit(None).cast("long").alias("id"), F.col(f"`{target_col}`").alias("text"))
    groups = 1 + (_bytes(corpus) + _bytes(aim)) // GROUP
    made = corpus.mapInArrow(lambda b: _sliced(b, n, groups, False), SLICED).unionByName(aim.mapInArrow(lambda b: _sliced(b, n, groups, True), SLICED))
    path = scratch(spark, "slices")
    made.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    parts = spark.read.schema(SLICED).parquet(path)
    blocks = parts.where("kind = 'strings'").select("target", "slice", "part", "strings", "counts")
    answered = scratch(spark, "answers")
    blocks.groupBy("part").applyInArrow(lambda key, t: _counted(key, t, buckets), ANSWERS).write.partitionBy("kind").option("compression", "zstd").parquet(answered)
    _drop(spark, f"{path}/kind=strings")
    answers = spark.read.schema(ANSWERS).parquet(answered)
    sums = answers.where("kind = 'sums'").select(F.explode(F.arrays_zip("bucket", "corpus", "aims")).alias("x")).groupBy("x.bucket").agg(F.sum("x.corpus").alias("s"), F.sum("x.aims").alias("t"))
    # a row for each bucket, whatever the corpus holds
    held = np.zeros((buckets, 2))
    for r in sums.collect():
        held[r.bucket] = r.s, r.t
    s, t = held[:, 0], held[:, 1]
    gains = np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)
    shared = spark.sparkContext.broadcast(gains)
    by_slice = answers.where("kind = 'buckets'").select("slice", "part", "buckets").groupBy("slice")
    rows = parts.where("kind = 'documents'").select("slice", "doc_ids", "n_words", "n_features", "entries", "counts", "places").groupBy("slice")
    found = by_slice.cogroup(rows).applyInArrow(lambda a, d: _weighed(a, d, shared.value), "id long, n_words long, n_features long, weight long")
    found.folders = (path, answered)
    return found


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; ranks are those of the drawn ones.

    Of the documents with enough words, that percentage (floored) of highest scores is drawn: the weight
    with Gumbel noise from a hash of the seed and the id, so documents are drawn without
    replacement, with odds as their weights are.
    """
    spark = docs.sparkSession
    found = feature_weights(docs, target, id_col, text_col, target_col, n, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    path = scratch(spark, "scores")
    found.withColumn("score", F.col("weight") + noise).write.option("compression", "zstd").parquet(path)
    for folder in found.folders:
        _drop(spark, folder)
    scored = spark.read.schema("id long, n_words long, n_features long, weight long, score long").parquet(path)
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    placed = numbered(scored.where(fit), [], [-F.col("score"), F.col("id").isNull(), F.col("id")])
    rank = F.when(F.col("pos") < drawn, F.col("pos") + 1)
    out = placed.withColumn("rank", rank).drop("pos").unionByName(scored.where(~F.coalesce(fit, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))
    return out.withColumnRenamed("id", id_col)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


SQL_BYTES = "list_transform(range(CAST(length(hex(encode(f))) / 2 AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))"
SQL = f"""WITH table256 AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
 w AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
 v AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
 fw AS (SELECT id, f, count(*) AS n FROM (SELECT id, unnest(list_concat(ws, list_transform(range(len(ws) - 1), lambda i: ws[i + 1] || ' ' || ws[i + 2]))) AS f FROM w) GROUP BY 1, 2),
 fv AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(ws, list_transform(range(len(ws) - 1), lambda i: ws[i + 1] || ' ' || ws[i + 2]))) AS f FROM v) GROUP BY 1),
 dict AS (SELECT f, sum(s) AS s, sum(t) AS t FROM (SELECT f, n AS s, 0 AS t FROM fw UNION ALL SELECT f, 0, n FROM fv) GROUP BY 1),
 b AS (SELECT f, s, dict.t AS t, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {SQL_BYTES}), lambda a, x: xor(a >> 8, table256.t[(xor(a, x) & 255) + 1]))) % 10000 AS bucket FROM dict, table256),
 k AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM b GROUP BY 1), z AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM k),
 g AS (SELECT bucket, CAST(floor(1000 * ln((k.t + 1) * (z.s + 10000) / ((k.s + 1) * (z.t + 10000)))) AS BIGINT) AS gain FROM k, z),
 d AS (SELECT id, sum(n) AS n, sum(n * gain) AS total FROM fw JOIN b USING (f) JOIN g USING (bucket) GROUP BY 1),
 x AS (SELECT w.id, doc_id, len(ws) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight, CAST(('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) AS h FROM w LEFT JOIN d ON w.id = d.id),
 y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
 r AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM y WHERE n_words >= 20)
 SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * r.n // 100 THEN rank END AS rank FROM y LEFT JOIN r ON y.id = r.id"""

QUERIES = {"op13_importance_resampling": op13_importance_resampling}
ORACLE: dict[str, str] = {"op13_importance_resampling": SQL}
