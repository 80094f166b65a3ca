"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``length`` bytes around it also starts anywhere else in the corpus. The
strings (one starts at each byte) are dealt to tasks so that equal ones meet: each string has an
anchor, the place of its least hash of some bytes (128 of 400), and goes with the strings of all texts that have
the same anchor. Runs of strings with one anchor are cut out as segments, and equal segments are
counted and collapsed before anything is moved, so copies by the thousand cost two rows. An anchor
that occurs once can be dropped: none of its strings is repeated.

The segments left meet by anchor. There a suffix array of their strings is built by two-stage
sorting: only the suffixes smaller than their successors are sorted directly, the others are induced
from them by scanning the buckets of first bytes in order; then the common prefixes of neighbours in
the array tell which strings occur twice. An anchor with very many different segments is dealt again
by what the strings that start within 16 bytes of each other have in common. Where very many different
parts have that in common too, each of their strings is counted by its own digest, so no group that
meets in one task has more than ``crowd`` segments.

Strings of a second, shorter length can be sought in the same pass: then anchors are those of the shorter
strings (equal longer ones have them in common too), segments go on for as many bytes as the longer ones
need, filled up with 255 past a text's end, and the same common prefixes tell both.

Defined cases: a null text is an empty one; a text shorter than ``length`` loses nothing; rows that
repeat others count as occurrences of their own; a null id is an id like any other; an empty table
gives an empty result. Only the id and text columns are read; others pass through, but for those of the
result's names, which are replaced (names that begin with two underscores are used inside).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, join_counted, list_array, materialize, ragged, released, row_key, slices, table, text_bytes

LENGTH = 400
#: Bytes of the shorter strings whose repeats the query reports without removing them: passages of some 50 words.
PASSAGE = 240
#: Bits of a place within a slice of text; the rest of a packed key is the hash.
PLACE = 21
#: Bytes that one pass of array operations looks at (small enough for a cache).
SLICE = 1 << 17
#: Different segments of one anchor before they are dealt again.
CROWD = 4096
#: Strings that start so close share the key by which crowded anchors are dealt again.
STEP = 16
#: Rows of texts handled at a time where Python objects are made of them.
ROWS = 256
#: Bytes of segments sorted at a time.
CHUNK = 1 << 18
#: A byte that is in no UTF-8 text.
FILL = b"\xff"


def byte_hashes() -> np.ndarray:
    """A 64-bit number for each byte value, by the splitmix rule."""
    with np.errstate(over="ignore"):
        z = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_OF_BYTE = byte_hashes()
_BASE = 0xD6E8FEB86659FD93


def gram_of(length: int) -> int:
    """How many bytes an anchor hashes: the largest power of two up to a third of the strings' length."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the ``gram`` bytes, a power of two, that start at each place."""
    h, n, width, base = _OF_BYTE[buf], len(buf), 1, _BASE
    while width < gram:
        h = h[: n - 2 * width + 1] * np.uint64(base) + h[width : n - width + 1]
        width, base = 2 * width, base * base % (1 << 64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def runs(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: text, first start in the buffer, number, anchor's place, anchor's hash."""
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    gram = gram_of(length)
    h = gram_hashes(buf, gram)
    low = np.uint64((1 << PLACE) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    window, width = length - gram + 1, 1
    while 2 * width <= window:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < window:
        m = np.minimum(m[: len(m) - (window - width)], m[window - width :])
    starts = ragged(offsets[:-1][long], sizes[long] - length + 1)
    text = np.repeat(long, sizes[long] - length + 1)
    anchor = (m[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    return text[new], starts[new], np.diff(np.concatenate((new, [len(starts)]))), anchor[new], h[anchor[new]]


def _pieces(offsets: np.ndarray, length: int):
    """(texts i to j, from, to): slices of whole texts, or parts of a long one that share length - 1 bytes."""
    for i, j in slices(offsets, SLICE):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a < 1 << PLACE:
            yield i, j, a, b
            continue
        step = (1 << PLACE) - length
        for at in range(a, b - length + 1, step):
            yield i, j, at, min(b, at + step + length - 1)


def segments(docs: DataFrame, length: int, more: int = 0) -> DataFrame:
    """A row for each run: (doc_id, row, first, n, lead, key, d1, d2); d1, d2: a digest of the run's bytes and of ``more`` that follow."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "row", "first", "n", "lead", "key", "d1", "d2")])

    def run(batches):
        for batch in batches:
            buf, offsets = text_bytes(batch.column(2))
            ids, rows = batch.column(0), batch.column(1)
            for i, j, a, b in _pieces(offsets, length):
                local = np.clip(offsets[i : j + 1] - a, 0, b - a)
                text, first, n, anchor, h = runs(buf[a:b], local, length)
                if not len(first):
                    continue
                raw = buf[a : min(b + more, offsets[j])].tobytes()
                last = first + n + length - 1 + more
                over = np.maximum(last - (offsets[i + 1 : j + 1] - a)[text], 0)
                digest = b"".join([hashlib.blake2b(raw[x : y - z] + FILL * z if z else raw[x:y], digest_size=16).digest() for x, y, z in zip(first.tolist(), last.tolist(), over.tolist())])
                d = np.frombuffer(digest, np.int64).reshape(-1, 2)
                at = pa.array(text + i)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), rows.take(at), pa.array(first + a - offsets[text + i]), pa.array(n), pa.array(anchor - first), pa.array(h.view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1])],
                    schema=schema,
                )

    return docs.mapInArrow(released(run), ", ".join(f"{c} long" for c in schema.names))


# ---- the suffix array


def two_stage(buf: np.ndarray, sort: np.ndarray, length: int) -> np.ndarray:
    """Places that ``sort`` marks, in the order of the ``length`` bytes that start there.

    The places marked come in runs, and each run ends with a suffix that is smaller than its
    successor; so the successor of any other suffix is in the run as well.
    """
    n = len(buf)
    step = np.sign(buf[1:].astype(np.int16) - buf[:-1].astype(np.int16))
    # equal bytes take the type of what follows them
    known = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(known[::-1])[::-1]
    smaller = np.zeros(n, bool)
    smaller[:-1] = np.where(following < n, step[np.minimum(following, n - 2)] > 0, True)
    smaller[-1] = True
    raw = buf.tobytes()
    direct = np.flatnonzero(sort & smaller)
    direct = np.array(sorted(direct.tolist(), key=lambda i: raw[i : i + length]), np.int64)
    induced = sort & ~smaller
    first = buf[direct]
    cut = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(places: np.ndarray, bucket: int) -> np.ndarray:
        """Hand on the predecessors that are to be induced; those of this bucket are returned."""
        p = places[places > 0] - 1
        p = p[induced[p]]
        if not len(p):
            return p
        c = buf[p]
        p = p[np.argsort(c, kind="stable")]
        c = buf[p]
        edge = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]))
        mine = p[:0]
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if c[x] == bucket:
                mine = p[x:y]
            else:
                waiting[c[x]].append(p[x:y])
        return mine

    for bucket in range(256):
        wave = np.concatenate(waiting[bucket]) if waiting[bucket] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = induce(wave, bucket)
        own = direct[cut[bucket] : cut[bucket + 1]]
        if len(own):
            out.append(own)
            induce(own, bucket)
    return np.concatenate(out) if out else direct


def common_prefixes(buf: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Of each neighbour pair in ``order``, the common prefix, ``length`` at most."""
    view = np.lib.stride_tricks.sliding_window_view(buf, length)
    out = np.empty(max(len(order) - 1, 0), np.int64)
    for i in range(0, len(out), 4096):
        differs = view[order[i : i + 4096][: len(out) - i]] != view[order[i + 1 : i + 4097]]
        out[i : i + len(differs)] = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    return out


def repeated_strings(parts: list[bytes], length: int, shorter: int | None = None) -> list[np.ndarray]:
    """For each segment, which of its strings of ``length`` bytes also start elsewhere in the segments.

    With ``shorter``, those of its strings of so many bytes follow, segment by segment, and strings that run into ``FILL`` count for those alone.
    """
    n = np.array([len(p) - length + 1 for p in parts])
    # 255 is in no UTF-8 text and larger than all of it: the last byte of each segment is of the smaller type
    buf = np.frombuffer(FILL.join(parts) + FILL * (length + 1), np.uint8)
    at = np.cumsum(n + length) - (n + length)
    own = np.zeros(len(buf), bool)
    own[ragged(at, n)] = True
    # each run goes on to the next suffix of the smaller type
    sort = own.copy()
    rising = np.flatnonzero(buf[1:] > buf[:-1])
    last = at + n - 1
    stop = rising[np.searchsorted(rising, last)]
    sort[ragged(last, stop - last + 1)] = True
    order = two_stage(buf, sort, length)
    order = order[own[order]]
    common = common_prefixes(buf, order, length)
    out = []
    for wanted in [length, shorter] if shorter else [length]:
        same = common >= wanted
        hit = np.zeros(len(buf), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        if wanted == length and shorter:
            hit[: 1 - length] &= buf[length - 1 :] != FILL[0]
        out += [hit[a : a + k] for a, k in zip(at.tolist(), n.tolist())]
    return out


def _spans(mask: np.ndarray) -> list[int]:
    """First and last of each run of true, one after another."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    edge[1::2] -= 1
    return edge.tolist()


# ---- the jobs


def _cut(batches, length: int, crowd: int, more: int = 0):
    """Cut segments out of their texts, with ``more`` bytes that follow; those of crowded anchors in parts of STEP strings."""
    names = ["key", "d1", "d2", "copies", "pkey", "p1", "p2", "off", "bytes"]
    kinds = [pa.int64()] * 8 + [pa.binary()]
    # a few hundred rows at a time: the lists of wanted segments are larger as Python objects than as columns
    for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        buf, offsets = text_bytes(batch.column(0))
        for k, wanted in enumerate(batch.column(1).to_pylist()):
            text = buf[offsets[k] : offsets[k + 1]].tobytes() + FILL * more
            rows = []
            for w in wanted:
                first, n, lead = w["first"], w["n"], w["lead"]
                mine = (w["key"], w["d1"], w["d2"])
                if w["kinds"] <= crowd:
                    rows.append((*mine, w["copies"], *mine, 0, text[first : first + n + length - 1 + more]))
                    continue
                s = 0
                while s < n:
                    # starts as seen from the anchor, so that parts of other segments match
                    group = (s - lead) // STEP
                    e = min(n, (group + 1) * STEP + lead)
                    core = first + lead + group * STEP + STEP - 1
                    shared = hashlib.blake2b(text[core : core + length - STEP + 1], digest_size=8, key=str(group).encode()).digest()
                    part = text[first + s : first + e + length - 1 + more]
                    d = np.frombuffer(hashlib.blake2b(part, digest_size=16).digest(), np.int64)
                    rows.append((int(np.frombuffer(shared, np.int64)[0]), int(d[0]), int(d[1]), w["copies"], *mine, s, part))
                    s = e
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _sort(batches, lengths: tuple[int, int | None]):
    """Suffix arrays over chunks of whole groups; in: (key, d1, d2, copies, bytes), sorted by key.

    A segment that stands for several is in the array twice, so that its strings are found there.
    """
    names = ["key", "d1", "d2", "spans", "shorter"]
    held: list[tuple] = []
    size = 0

    def close():
        parts = [r[4] for r in held] + [r[4] for r in held if r[3] > 1]
        found = repeated_strings(parts, *lengths)
        both = [[_spans(f) for f in found[: len(held)]], [_spans(f) for f in found[len(parts) :][: len(held)]] or [[]] * len(held)]
        keep = [i for i, s in enumerate(zip(*both)) if any(s)]
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array([held[i][c] for i in keep], pa.int64()) for c in range(3)),
                *(list_array(np.array([x for i in keep for x in spans[i]], np.int32), np.array([len(spans[i]) for i in keep], np.int64), pa.int32()) for spans in both),
            ],
            names=names,
        )

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= CHUNK and row[0] != held[-1][0]:
                yield close()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield close()


def _strings(batches, length: int, shorter: int | None = None):
    """A row for each string of a part; in: (key, d1, d2, copies, bytes), out: (key, d1, d2, copies, bytes, at, s1, s2)."""
    for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        parts = batch.column(4).to_pylist()
        for size in [length, shorter] if shorter else [length]:
            # strings that run into what fills up a text's end are no strings of the text
            n = np.array([len(p.rstrip(FILL) if size == length else p[: len(p) - length + size]) - size + 1 for p in parts]).clip(0)
            digest = b"".join([hashlib.blake2b(p[i : i + size], digest_size=16).digest() for p, k in zip(parts, n.tolist()) for i in range(k)])
            d = np.frombuffer(digest, np.int64).reshape(-1, 2)
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in range(4)), pa.array(np.full(len(d), size, np.int32)), pa.array(ragged(np.zeros(len(n), np.int64), n), pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])],
                names=["key", "d1", "d2", "copies", "bytes", "at", "s1", "s2"],
            )


def _counted(parts: DataFrame, length: int, shorter: int | None = None) -> DataFrame:
    """(key, d1, d2, spans, shorter): what the suffix arrays give, by counting the strings of each part; equal ones add up before they are moved."""
    strings = materialize(parts.mapInArrow(lambda b: _strings(b, length, shorter), "key long, d1 long, d2 long, copies long, bytes int, at int, s1 long, s2 long"), "crowded-strings")
    repeated = strings.groupBy("bytes", "s1", "s2").agg(F.sum("copies").alias("n")).where("n > 1").select("bytes", "s1", "s2")
    found = strings.join(materialize(repeated, "repeated-strings"), ["bytes", "s1", "s2"])
    at = lambda size: F.flatten(F.collect_list(F.when(size, F.array("at", "at"))))
    return found.groupBy("key", "d1", "d2").agg(at(F.col("bytes") == length).alias("spans"), at(F.col("bytes") != length).alias("shorter"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, shorter: int | None = None) -> DataFrame:
    """(doc_id, row, starts, shorter_starts): first and last start of runs of repeated strings, of ``length`` bytes and of ``shorter``. docs: (doc_id, row, text)."""
    dealt, more = (shorter, length - shorter) if shorter else (length, 0)
    found = materialize(segments(docs, dealt, more), "segments")
    keys = materialize(found.groupBy("key").agg(F.count("*").alias("total")).where("total > 1"), "shared-keys")
    shared = materialize(join_counted(found, keys, ["key"], "total", found.count()).drop("total"), "shared-segments")
    discard(found, keys)

    one = F.min(F.struct("doc_id", "row", "first", "n", "lead")).alias("one")
    chosen = shared.groupBy("key", "d1", "d2").agg(F.count("*").alias("copies"), one)
    kinds = chosen.groupBy("key").agg(F.count("*").alias("kinds"))
    per_text = (
        chosen.join(kinds, "key")
        .select(F.col("one.doc_id").alias("w_id"), F.col("one.row").alias("w_row"), F.struct("key", "d1", "d2", "copies", "kinds", "one.first", "one.n", "one.lead").alias("w"))
        .groupBy("w_id", "w_row").agg(F.collect_list("w").alias("wanted"))
    )
    # rows that repeat each other have one key and are cut twice; their strings are repeated anyway
    texts = per_text.join(docs, F.col("w_id").eqNullSafe(F.col("doc_id")) & (F.col("w_row") == F.col("row"))).select("text", "wanted")
    cut = texts.mapInArrow(released(lambda b: _cut(b, dealt, crowd, more)), "key long, d1 long, d2 long, copies long, pkey long, p1 long, p2 long, off long, bytes binary")
    cut = materialize(cut, "cut-segments")
    plain = cut.where("off = 0 and key = pkey and d1 = p1 and d2 = p2").select("key", "d1", "d2", "copies", "bytes")
    again = cut.where("not (off = 0 and key = pkey and d1 = p1 and d2 = p2)").groupBy("key", "d1", "d2").agg(F.sum("copies").alias("copies"), F.first("bytes").alias("bytes"))
    # parts of one key that are too many for one suffix array
    full = cut.where("not (off = 0 and key = pkey and d1 = p1 and d2 = p2)").select("key", "d1", "d2").distinct().groupBy("key").count().where(F.col("count") > crowd)
    full = materialize(full.select("key"), "full-keys")
    met = plain.unionByName(again.join(full, "key", "left_anti")).repartition("key").sortWithinPartitions("key", "d1", "d2")
    sorted_ = met.mapInArrow(released(lambda b: _sort(b, (length, shorter))), "key long, d1 long, d2 long, spans array<int>, shorter array<int>")
    sorted_ = sorted_.unionByName(_counted(again.join(full, "key", "left_semi"), length, shorter))
    moved = lambda by: [F.transform(c, lambda x: x + F.col(by)).alias(c) for c in ("spans", "shorter")]
    marks = (
        cut.drop("bytes", "copies").join(sorted_, ["key", "d1", "d2"])
        .select(F.col("pkey").alias("key"), F.col("p1").alias("d1"), F.col("p2").alias("d2"), *moved("off"))
    )
    starts = shared.join(marks, ["key", "d1", "d2"]).select("doc_id", "row", *moved("first"))
    return starts.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("starts"), F.flatten(F.collect_list("shorter")).alias("shorter_starts"))


def _removed(starts: list[int] | None, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes, as (from, to)."""
    out: list[tuple[int, int]] = []
    if starts:
        for a, b in sorted(zip(starts[::2], starts[1::2])):
            b = min(b + length, size)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
    return out


def _whole(raw: bytes, edges: list[int]) -> list[int]:
    """Edges of kept runs (from, to, ...) moved inwards so that none starts or ends within a character of UTF-8."""
    out = edges[:]
    for k, at in enumerate(edges):
        if k % 2 == 0:
            while at < edges[k + 1] and raw[at] & 0xC0 == 0x80:
                at += 1
        elif at < len(raw):
            while at > out[k - 1] and raw[at] & 0xC0 == 0x80:
                at -= 1
        out[k] = at
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, crowd: int = CROWD, whole_characters: bool = False, shorter: int | None = None
) -> DataFrame:
    """``docs`` with removed_spans (array of from, to in bytes) and kept_bytes (the other bytes) per row.

    With ``whole_characters``, kept_bytes also loses what a cut within a character leaves of it, so it is UTF-8.
    With ``shorter``, less than ``length``, shorter_spans has the bytes that a string of so many bytes covers which also starts anywhere else; they stay.
    """
    if shorter and not 0 < shorter < length:
        raise ValueError(f"shorter strings of {shorter} bytes are sought along with those of {length}")
    added = {"removed_spans": T.ArrayType(T.LongType()), "kept_bytes": T.BinaryType()} | ({"shorter_spans": T.ArrayType(T.LongType())} if shorter else {})
    docs = docs.drop(*added)
    keyed = docs.withColumn("__row", row_key(id_col, text_col))
    texts = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col("__row").alias("row"), F.col(text_col).alias("text"))
    spans = repeated_spans(texts, length, crowd, shorter).select(F.col("doc_id").alias("__doc"), F.col("row").alias("__key"), F.col("starts").alias("__starts"), F.col("shorter_starts").alias("__shorter"))
    joined = keyed.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__key")), "left").drop("__doc", "__key", "__row")
    at, starts_at, shorter_at = (joined.columns.index(c) for c in (text_col, "__starts", "__shorter"))
    fields = [*docs.schema.fields, *(T.StructField(c, kind) for c, kind in added.items())]

    def run(batches):
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            buf, offsets = text_bytes(batch.column(at))
            spans, kept = [], []
            for k, starts in enumerate(batch.column(starts_at).to_pylist()):
                raw = buf[offsets[k] : offsets[k + 1]].tobytes()
                gone = _removed(starts, len(raw), length)
                spans.append([x for ab in gone for x in ab])
                edge = [0, *spans[-1], len(raw)]
                if whole_characters and gone:
                    edge = _whole(raw, edge)
                kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2])))
            new = [pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
            if shorter:
                sizes = np.diff(offsets).tolist()
                new.append(pa.array([[x for ab in _removed(starts, size, shorter) for x in ab] for starts, size in zip(batch.column(shorter_at).to_pylist(), sizes)], pa.list_(pa.int64())))
            own = [c for k, c in enumerate(batch.columns) if k not in (starts_at, shorter_at)]
            yield pa.RecordBatch.from_arrays([*own, *new], names=[f.name for f in fields])

    return joined.mapInArrow(released(run), T.StructType(fields))


def _covered(spans: str):
    """Bytes that the spans of a column (from, to, ...) cover."""
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("k"))
    return F.aggregate(spans, zero, lambda a, x: F.struct((a.s + x * a.k).alias("s"), (-a.k).alias("k")), lambda a: a.s)


def _count(spans: str):
    return (F.size(spans) / 2).cast("long")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of each text, by strings of ``LENGTH`` bytes; and, as it stays, what strings of ``PASSAGE`` bytes cover that start elsewhere too."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), shorter=PASSAGE)
    removed = _covered("removed_spans")
    return out.select(
        "doc_id",
        (F.octet_length("kept_bytes") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        _count("removed_spans").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
        _covered("shorter_spans").alias("n_passage_bytes"),
        _count("shorter_spans").alias("n_passages"),
    )


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLE: dict[str, str] = {}
