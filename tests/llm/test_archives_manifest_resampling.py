"""Archives, the manifest and resampling against plain loops, over every case that their docstrings define."""

import hashlib
import io
import math
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tickloom.llm import merkle, order, resampling, warc

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- places


def test_places_in_a_hot_group(spark):
    rows = [("a" if i % 3 else None, i // 7, "x") for i in range(500)] + [("b", 1, "x")] * 90
    df = spark.createDataFrame(rows, "g string, k long, v string").repartition(5)
    got = order.numbered(df, ["g"], [F.col("k")], size="n").collect()
    for g in (None, "a", "b"):
        mine = sorted((r.pos, r.k) for r in got if r.g == g)
        want = sorted(k for h, k, _ in rows if h == g)
        assert [p for p, _ in mine] == list(range(len(want))) and [k for _, k in mine] == want
        assert {r.n for r in got if r.g == g} == {len(want)}
    assert sorted(r.pos for r in order.numbered(df, [], [F.col("k")]).collect()) == list(range(len(rows)))


# ---- the manifest


def leaf(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i // 16 * 16
        out.append((nodes[a:i], nodes[i + 1 : a + 16]))
        i //= 16
    return out


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in by[s]])
    top = climb([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            own = leaf(r)
            told = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            low = None if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            h = leaf(dict(r, text=low)) if told else own
            for left, right in path:
                h = H(*left, h, *right)
            out.append((r["doc_id"], own, trees[s][-1][0], root, H(*(x for a, b in path for x in a + b)), h, h == root))
    return sorted(out, key=str)


def told_manifest(df):
    altered = merkle.leaf_digest([merkle.lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in merkle.FIELDS])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(df, claim=F.when(tampered, altered))


def test_manifest_equals_whole_levels(spark):
    rng = random.Random(3)
    rows = [(i, "hot", "en", 5, f"Text {rng.randrange(10**6)}") for i in range(5000)]
    rows += [(i, f"s{i % 40}", None, i, "Ünï Ç" * (i % 3)) for i in range(700)]
    rows += [(7, None, "de", None, None), (8, None, None, 0, ""), (None, "hot", "en", 1, "no id"), (3, "hot", "en", 5, "same id"), (1, "alone", "en", 1, "A")]
    rows += [rows[0]] * 20 + [(None, None, None, None, None)] * 2 + [(9, "hot", "en", 300_000, "Long words " * 30_000)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    df = df.select("*", *(F.lit(-1).alias(c) for c in ("tree", "pos", "n", "digest", "block", "top", "above", "root", "leaf", "claim", "proof", "__row")))
    got = told_manifest(df).cache()
    want = brute_manifest([r.asDict() for r in spark.createDataFrame(rows, DOCS).collect()])
    assert sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got.collect()), key=str) == want
    assert 0 < sum(not w[-1] for w in want) < len(want)
    for r in got.where("verified").limit(20).collect():  # proofs as returned lead to the root
        path = [(x.left, x.right) for x in r.proof]
        assert merkle.proof_digest(path) == r.proof_sha256
        assert merkle.fold(r.leaf, path) == r.root or r.folded_root == r.root


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 100, 255, 256])
def test_traversal_keeps_to_its_bound(n):
    leaves = [H(str(i)) for i in range(n)]
    levels = climb(leaves)
    h = merkle.height_of(n)
    walk = merkle.Fractal(leaves, h, levels[-2] if h else [])
    for i in range(n):
        assert walk.path(i) == siblings(levels, i)
        assert sum(map(len, walk.existing)) + sum(map(len, walk.desired)) <= 2 * merkle.ARITY * max(1, h)


def test_manifest_of_nothing(spark):
    assert told_manifest(spark.createDataFrame([], DOCS)).count() == 0


# ---- resampling


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, n=2):
    w = split(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, n=2):
    s, t, bucket = Counter(), Counter(), lambda f: zlib.crc32(f.encode()) % 10000
    for _, text in docs:
        s.update(map(bucket, features(text, n)))
    for (text,) in target:
        t.update(map(bucket, features(text, n)))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000) / ((s[b] + 1.0) * (T + 10000))))
    out = []
    for doc, text in docs:
        f = features(text, n)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(H(f"7:{'null' if doc is None else doc}")[:8], 16)
        out.append([doc, len(split(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(fit[: 25 * len(fit) // 100])}
    return sorted((tuple(r) + (ranks.get(id(r)),) for r in out), key=str)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling_equals_a_plain_loop(spark, rows, n, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 1 << 14)  # many slices and groups
    monkeypatch.setattr(resampling, "GROUP", 1 << 14)
    docs = [(r[0], r[1]) for r in rows] + [(200, "Aa\x00b\x7fC é9 日本"), (201, "\n"), (202, "x" * 40_000), (203, " ".join(["same"] * 5000))]
    target = [(rows[0][1],), (None,), ("",), (rows[3][1] + " é9 only here",)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).select("*", *(F.lit(-1).alias(c) for c in ("id", "n_words", "weight", "score", "rank", "slice", "part", "kind", "pos")))
    a = spark.createDataFrame(target, "text string").withColumn("id", F.lit(-1))
    got = resampling.importance_resample(d, a, n=n).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    got = sorted((tuple(r) for r in got), key=str)
    assert got == brute_resample(docs, target, n)
    assert sum(r[-1] is not None for r in got) > 5


def test_a_slice_takes_few_times_its_text():
    r = random.Random(7)
    text = " ".join(f"w{r.randrange(20000)}" for _ in range(200_000)).encode()
    given = np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64)
    resampling.grams(*given, 2, 8)  # imports
    tracemalloc.start()
    resampling.grams(*given, 2, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(text)  # 21 while arrays stayed to the end


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    assert resampling.importance_resample(none, some).count() == 0
    (row,) = resampling.importance_resample(some, none).collect()
    assert row.n_features == 119 and row["rank"] is None
    assert resampling.importance_resample(none, none).count() == 0


def test_numbers_are_packed_whole():
    import numpy as np

    for x in ([], [0], [1, 2**32 - 1, 7]):
        assert resampling.unpack(resampling.pack(np.array(x, np.int64))).tolist() == x


# ---- archives


PAGES = "page_id long, url string, html string"


def brute_pages(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            h = (html or "").encode()
            first[h] = min(first.get(h, page), page)
    out = []
    for page, _, html in rows:
        h = (html or "").encode()
        again = len(h) >= 100 and first.get(h) is not None and first[h] != page
        out.append((page, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(8)
    body = lambda n: "<p>" + " ".join(rng.choice(["Straße", "page", "menu", "<a href='/x'>", "\r\n\r\n", "日本"]) for _ in range(n)) + "</p>"
    rows = [(i, f"http://h{i % 7}.example/{i}", body(40 + i % 300)) for i in range(400)]
    rows += [(1000 + i, "http://copy.example/", rows[5][2]) for i in range(200)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "http://x.example/a b\r\nEvil: 1", "short"), (2003, "u", "short"), (2004, "u", "x" * 99), (2005, "u", "x" * 99), (2006, "u", "y" * 100), (2007, "u", "y" * 100)]
    rows += [(None, "u", rows[9][2]), (None, "u", "only without id " * 20), (None, None, "only without id " * 20), rows[9], rows[9], (2010, "u", body(200_000))]
    return rows


@pytest.mark.parametrize("bound", [1 << 24, 1])
def test_archives_equal_a_plain_loop(spark, pages, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(warc, "SMALL", 1 if bound == 1 else 100_000)  # by broadcast, and by a shuffle
    df = spark.createDataFrame(pages, PAGES).repartition(3).select("*", *(F.lit(-1).alias(c) for c in ("digest", "first", "n", "key", "revisit")))
    path = f"file://{tmp_path}/w"
    index = warc.write_archives(df, path, archive=1 << 16)
    got = warc.read_archives(spark, path).cache()
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute_pages(pages)
    # every revisit's payload is to be had, and equals the page's
    whole = warc.resolve(got).select("page_id", F.decode("payload", "UTF-8").alias("html")).collect()
    assert sorted((r.page_id is not None, r.page_id or 0, r.html) for r in whole) == sorted((p is not None, p or 0, h or "") for p, _, h in pages)
    # records one by one from the index, with their targets
    some = index.where("page_id % 50 = 0")
    one = warc.fetch(some, path)
    assert sorted(map(str, one.drop("archive", "at").collect())) == sorted(map(str, got.where("page_id % 50 = 0").drop("archive", "at").collect())) and one.count() > 8
    assert got.where("page_id = 2002").collect()[0].target == "http://x.example/a%20b%0D%0AEvil:%201"


def test_files_are_read_by_any_zstandard_reader(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(pages, PAGES).coalesce(1), path, archive=1 << 20)
    (tmp_path / "w" / "archives" / "left-by-a-lost-attempt.warc.zst").write_bytes(b"half")
    assert warc.read_archives(spark, path).count() == len(pages)
    assert warc.vacuum(spark, path) == 1 and warc.vacuum(spark, path) == 0
    led = 0
    for file in (tmp_path / "w" / "archives").glob("*.zst"):
        data = file.read_bytes()
        mark, size = struct.unpack("<II", data[:8])
        if mark != warc.SKIPPABLE:
            continue
        led += 1
        words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        text = zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True).read()
        assert text.startswith(b"WARC/1.1\r\n") and text.count(b"\r\nWARC-Record-ID: ") > 1
    assert led


def test_damage_is_seen():
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False, "1970-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good.replace(b"payload\r\n", b"paXload\r\n"), good[:-3], b"x" + good):
        with pytest.raises(ValueError):
            warc.parse(bad)
    lead, frames = warc.frames([good] * 3)
    assert lead == b"" and [x for _, x in warc.read_frames(io.BytesIO(b"".join(frames)))] == [good] * 3
    with pytest.raises(ValueError):
        list(warc.read_frames(io.BytesIO(b"".join(frames)[:-5])))


def test_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    assert warc.write_archives(spark.createDataFrame([], PAGES), path).count() == 0 == warc.read_archives(spark, path).count()


# ---- a fingerprint that many rows share


def test_a_hot_fingerprint_meets_its_class_in_every_task(spark):
    from tickloom.llm import simhash

    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(30))) for i in range(600)] + [(1000 + i, "" if i % 2 else None) for i in range(500)]
    got = simhash.simhash_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    found = got.collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in rows)
    assert {r.component_id for r in found if r.doc_id >= 1000} == {1000} and all(r.component_id <= r.doc_id for r in found)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
