"""Texts whose sets of word shingles are similar, found by bands of least hashes and checked exactly.

The similarity of two texts is the share of shingles common to both sets among those of either. Each set
has ``BANDS`` keys of ``ROWS`` least hashes; a pair of similarity 0.8 shares none with a chance of 7e-6.
Sets that share a key meet in one task with sketches (parities of hash buckets). Two sketches never differ in
more bits than the sets differ in shingles, so what they rule out can't be similar; only the other pairs
become rows and are checked on the sets. Pairs that are connected already aren't: first those are checked
that would join most with least, then what is still apart. A crowded key's sets are dealt to blocks, and each
pair of blocks is a task's work, so no task holds more than two blocks of a key.

Defined cases: null, empty and blank texts have the empty set and no keys, so they are linked to each other
alone (equal sets are one); a text of fewer words than a shingle is one shingle; a long text's shingles are all
hashed, never a part of them; equal rows are one set; an empty table gives no links. Sketches have one width, so sets of more than some
4,500 shingles that share a key are all checked: the result is the same, the pairs of such a key are more.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, join_counted, list_array, materialize, released, text_bytes
from .components import members as members_of
from .components import stars

BANDS, ROWS = 30, 5
#: Shingles hashed at a time.
PART = 1024
#: Bits of a sketch.
BITS = 2048
#: Sets of one key in a block.
BLOCK = 2000


def shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; fewer words than a shingle make one."""
    w = text.lower().split()
    k = min(words, len(w))
    cut = map(b" ".join, zip(*(w[i:] for i in range(k)))) if k else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(42)), np.uint64))


def _factors() -> np.ndarray:
    return np.random.default_rng(42).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A key for each band of a set."""
    least = np.min([(h[i : i + PART] * factors[:, None]).min(axis=1) for i in range(0, len(h), PART)], axis=0)
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(raw[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def with_bands(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """``docs`` with __set (a digest of the set), __size and __bands (none for a text without words)."""
    at = docs.columns.index(text_col)
    fields = [*docs.schema.fields, T.StructField("__set", T.LongType()), T.StructField("__size", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType()))]

    def run(batches):
        factors = _factors()
        for batch in batches:
            buf, offsets = text_bytes(batch.column(at))
            digests, sizes, bands = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                h = shingles(buf[a:b].tobytes(), words)
                digests.append(int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True))
                sizes.append(len(h))
                bands.append(band_keys(h, factors) if len(h) else np.zeros(0, np.int64))
            keys = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            own = [pa.array(digests, pa.int64()), pa.array(sizes, pa.int64()), list_array(keys, np.array([len(x) for x in bands], np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[f.name for f in fields])

    return docs.mapInArrow(released(run), T.StructType(fields))


def sketch(h: np.ndarray) -> bytes:
    """The parity of the number of hashes in each of ``BITS`` buckets."""
    return np.packbits((np.bincount((h % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()


def _groups(batches, keys: int):
    """Runs of rows that are equal in the first columns, over the ends of batches."""
    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        k = np.column_stack([batch.column(c).to_numpy() for c in range(keys)])
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)]):
            if held and tuple(k[a]) != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(k[a])
    if held:
        yield last, pa.Table.from_batches(held)


def _meetings(band: int, within: bool, chunk, size, root, bands, bits, similarity: float):
    """(i, j, share of differing bits) of the rows of a group that may be similar, are apart, and share no earlier key."""
    found = []
    at = int(np.argmax(bands[0] == band))
    earlier = bands[:, :at]
    for i in range(len(size) - 1):
        rest = slice(i + 1, None)
        ok = (root[rest] != root[i]) & (np.minimum(size[rest], size[i]) >= np.maximum(size[rest], size[i]) * similarity - 1e-9)
        if not within:
            ok &= chunk[rest] != chunk[i]
        j = np.flatnonzero(ok) + i + 1
        if not len(j):
            continue
        differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) / (size[j] + size[i])
        ok = differ <= (1 - similarity) / (1 + similarity) + 1e-9
        j, differ = j[ok], differ[ok]
        if at:
            new = ~(earlier[j] == earlier[i]).any(axis=1)
            j, differ = j[new], differ[new]
        found.append((np.full(len(j), i), j, differ))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3


def _joining(i, j, differ, root):
    """Of the pairs those that join components, the likest first: fewer than there are rows."""
    above = {r: r for r in root.tolist()}

    def top(r):
        while above[r] != r:
            above[r] = r = above[above[r]]
        return r

    keep = []
    for k in np.argsort(differ, kind="stable").tolist():
        a, b = top(int(root[i[k]])), top(int(root[j[k]]))
        if a != b:
            above[a] = b
            keep.append(k)
    return i[keep], j[keep]


def _candidates(here: DataFrame, facts: DataFrame, similarity: float, joining: bool) -> DataFrame:
    """(a, b, fa, fb), a < b: pairs of one key that are apart and that sketches don't rule out. here: (band, set, n); facts: (set, size, fp, bands, sketch, root)."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = here.join(facts, "set").withColumn("chunk", F.pmod(F.xxhash64("set"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = dealt.select("band", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "set", "size", "fp", "root", "bands", "sketch")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64())])

    def run(batches):
        for (band, lo, hi), t in _groups(batches, 3):
            if len(t) < 2:
                continue
            chunk, sets, size, fp, root = (t.column(k).to_numpy() for k in range(3, 8))
            bands = t.column(8).combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            bits = text_bytes(t.column(9).combine_chunks())[0].view(np.uint64).reshape(-1, BITS // 64)
            i, j, differ = _meetings(band, lo == hi, chunk, size, root, bands, bits, similarity)
            if joining and len(i):
                i, j = _joining(i, j, differ, root)
            if len(i):
                turn = sets[i] > sets[j]
                i, j = np.where(turn, j, i), np.where(turn, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sets[i], sets[j], fp[i], fp[j])], schema=schema)

    return rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").mapInArrow(released(run), "a long, b long, fa long, fb long")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b, fa, fb) whose sets are similar, as (a, b) of fingerprints."""
    joined = pairs.join(sets.select(F.col("set").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("set").alias("b"), F.col("hashes").alias("hb")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return joined.select("fa", "fb", "ha", "hb").mapInArrow(released(run), "a long, b long")


def set_links(printed: DataFrame, links: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """(a, b) between fingerprints, with the components that ``links`` and those by similar sets make together. printed: __print and the columns of with_bands."""
    seen = printed.select("__print", "__set").distinct()
    # one fingerprint stands for each set
    stands = printed.groupBy("__set").agg(F.min("__print").alias("fp"), F.first("__size").alias("size"), F.first("__bands").alias("bands"))
    stands = materialize(stands, "sets")
    alike = seen.join(stands.select("__set", "fp"), "__set").where("fp <> __print").select(F.col("fp").alias("a"), F.col("__print").alias("b"))
    linked = stars(links.unionByName(alike))

    def rooted(members: DataFrame) -> DataFrame:
        """Members with the root of their fingerprint's component."""
        return members.join(members_of(linked), members.fp == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")

    def apart(sets: DataFrame) -> DataFrame:
        """(band, set, n): the sets of the n sets' buckets that hold several components."""
        members = sets.select(F.explode("bands").alias("band"), "set", "root")
        counted = members.groupBy("band").agg((F.min("root") < F.max("root")).alias("several"), F.count("*").alias("n"))
        several = materialize(counted.where("several").select("band", "n"), "buckets")
        total = sets.agg(F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()[0]
        found = materialize(join_counted(members.select("band", "set"), several, ["band"], "n", total), "apart")
        discard(several)
        return found

    # roots are found by set, before a set has a row for each of its bands
    rooted_sets = materialize(rooted(stands.withColumnRenamed("__set", "set")), "rooted-sets")
    here = apart(rooted_sets)
    wanted = materialize(here.select("set").distinct(), "wanted")
    texts = printed.select("__set", F.col(text_col).alias("text")).join(wanted, F.col("__set") == F.col("set"), "left_semi").groupBy("__set").agg(F.first("text").alias("text"))

    def hashes(batches):
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            got = [shingles(buf[a:b].tobytes(), words) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            own = [pa.array([h.tobytes() for h in got], pa.binary()), pa.array([sketch(h) for h in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own], names=["set", "hashes", "sketch"])

    sets = materialize(texts.mapInArrow(released(hashes), "set long, hashes binary, sketch binary"), "hashes")
    facts = materialize(rooted_sets.join(sets.select("set", "sketch"), "set"), "facts")
    discard(wanted, rooted_sets)
    tried = materialize(_candidates(here, facts, similarity, True), "pairs")
    linked = stars(linked.unionByName(_similar(tried, sets, similarity)))

    discard(here)
    again = materialize(rooted(facts.drop("root")), "facts")
    here = apart(again)
    rest = materialize(_candidates(here, again, similarity, False).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    discard(here, facts, again, tried)
    return linked.unionByName(_similar(rest, sets, similarity))
