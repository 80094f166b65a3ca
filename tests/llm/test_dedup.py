"""Suffix arrays, fingerprints and chunks against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import chunk_dedup, near_sets, simhash, suffix_dedup
from tickloom.llm.components import components

L = suffix_dedup.LENGTH


def brute_spans(texts, length):
    seen = Counter(b[s : s + length] for b in texts for s in range(len(b) - length + 1))
    out = []
    for b in texts:
        m = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                m[s : s + length] = 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], m[: len(b)], [0]))))
        out.append(edge.tolist())
    return out


@pytest.mark.parametrize("crowd", [4096, 1])
def test_suffix_removal(docs, rows, crowd):
    texts = [(t or "").encode() for _, t, *_ in rows]
    want = Counter((r[0], t, tuple(s)) for r, t, s in zip(rows, texts, brute_spans(texts, L)))
    got = suffix_dedup.remove_repeats(docs, crowd=crowd).collect()
    assert Counter((r.doc_id, (r.text or "").encode(), tuple(r.removed_spans)) for r in got) == want
    assert any(s for _, _, s in want)
    for r in got:
        t, e = (r.text or "").encode(), [0, *r.removed_spans, len((r.text or "").encode())]
        assert bytes(r.kept_bytes) == b"".join(t[a:b] for a, b in zip(e[::2], e[1::2]))


@pytest.mark.parametrize("crowd", [4096, 1])
def test_shorter_strings_are_told_apart_in_the_same_pass(spark, docs, rows, crowd):
    rng = random.Random(8)

    def noise(n):
        return "".join(rng.choice("abcdefghé ") for _ in range(n))

    passage, end, tail = noise(330), noise(300), noise(700)
    # in the middle, at both ends of texts, as whole texts, one text's end in another's middle, copies
    odd = [noise(90) + passage + noise(500), passage + noise(410), noise(411) + end, noise(200) + end, end, passage, noise(50) + end + noise(600), tail, tail, noise(30) + tail, tail[:450], noise(245), noise(239)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = [(t or "").encode() for _, t, *_ in rows] + [t.encode() for t in odd]
    ids = [r[0] for r in rows] + [1000 + i for i in range(len(odd))]
    want = Counter((i, t, tuple(a), tuple(b)) for i, t, a, b in zip(ids, texts, brute_spans(texts, L), brute_spans(texts, 240)))
    got = suffix_dedup.remove_repeats(d, crowd=crowd, shorter=240).collect()
    assert Counter((r.doc_id, (r.text or "").encode(), tuple(r.removed_spans), tuple(r.shorter_spans)) for r in got) == want
    assert any(b and not a for _, _, a, b in want)


def test_shorter_strings_of_segments_that_end_with_their_text():
    rng = random.Random(9)
    for _ in range(30):
        texts = [bytes(rng.choice(b"ab" if rng.random() < 0.7 else b"abcz") for _ in range(rng.randrange(7, 60))) for _ in range(8)]
        texts.append(texts[0])
        hits = suffix_dedup.repeated_strings([t + b"\xff" * 5 for t in texts], 12, 7)
        for length, some in ((12, hits[:9]), (7, hits[9:])):
            seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
            for t, h in zip(texts, some):
                k = max(len(t) - length + 1, 0)
                assert h.tolist() == [seen[t[s : s + length]] > 1 for s in range(k)] + [False] * (len(t) - 6 - k)


def test_query_reports_passages_of_just_over_fifty_words(spark, tmp_path):
    rng = random.Random(10)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 7))) for _ in range(n))
    passage = words(52)
    assert 240 < len(passage) < L
    texts = [words(60) + " " + passage + " " + words(40), passage + " " + words(80), words(150), words(90)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert all(got[i].n_bytes == len(t) and got[i].n_removed == 0 for i, t in enumerate(texts))
    assert all(len(passage) <= got[i].n_passage_bytes <= len(passage) + 2 and got[i].n_passages == 1 for i in (0, 1))
    assert all(got[i].n_passage_bytes == got[i].n_passages == 0 for i in (2, 3))


def test_no_group_outgrows_the_crowd(spark, monkeypatch):
    rng = random.Random(6)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passage = noise(L + 20)
    texts = [noise(300) + passage + noise(300) for _ in range(40)]
    crowd = 8

    def bounded(batches, length):
        from collections import Counter

        from tickloom.llm.suffix_dedup import _sort

        held = list(batches)
        most = max(Counter(k for b in held for k in b.column(0).to_pylist()).values(), default=0)
        if most > crowd:
            raise ValueError(f"{most} segments in one group")
        yield from _sort(iter(held), length)

    monkeypatch.setattr(suffix_dedup, "_sort", bounded)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.removed_spans for r in suffix_dedup.remove_repeats(d, crowd=crowd).collect()}
    want = brute_spans([t.encode() for t in texts], L)
    assert [got[i] for i in range(40)] == want and all(want)


def test_two_stage_order_is_the_order_of_prefixes():
    rng = random.Random(1)
    for _ in range(30):
        text = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcz") for _ in range(300))
        parts = [text[i : i + 60] for i in range(0, 240, 30)]
        length = 12
        hits = suffix_dedup.repeated_strings(parts, length)
        seen = Counter(p[s : s + length] for p in parts for s in range(len(p) - length + 1))
        for p, h in zip(parts, hits):
            assert h.tolist() == [seen[p[s : s + length]] > 1 for s in range(len(p) - length + 1)]


def test_suffix_array_and_prefixes():
    buf = np.frombuffer(b"mississippi" * 3 + b"\xff" * 20, np.uint8)
    sort = np.zeros(len(buf), bool)
    sort[:33] = True
    order = suffix_dedup.two_stage(buf, sort, 8)
    raw = buf.tobytes()
    keys = [raw[i : i + 8] for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(33))
    want = [next((k for k in range(8) if a[k] != b[k]), 8) for a, b in zip(keys, keys[1:])]
    assert suffix_dedup.common_prefixes(buf, order, 8).tolist() == want


def test_long_text_is_cut_in_slices(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    filler = "".join(rng.choice("ijklmnop ") for _ in range((1 << suffix_dedup.PLACE) + 5000))
    at = (1 << suffix_dedup.PLACE) - 700
    d = spark.createDataFrame([(1, filler[:at] + passage + filler[at:]), (2, passage)], "doc_id long, text string")
    got = {r.doc_id: r.removed_spans for r in suffix_dedup.remove_repeats(d).collect()}
    assert got[2] == [0, 1000] and got[1][1] - got[1][0] >= 1000 and got[1][0] <= at


def brute_print(text, k=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(docs, rows):
    prints = [brute_print(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    want = Counter((r[0], p, least[find(i)]) for i, (r, p) in enumerate(zip(rows, prints)))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_documents(docs).collect())
    assert got == want


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_links_equal_all_pairs(spark, crowd):
    rng = random.Random(3)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(6):
            p ^= 1 << rng.randrange(64)
            prints.add(p)
    # many that share their first block
    prints |= {(0xABCDE << 44) | rng.getrandbits(20) for _ in range(40)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.near_links(df, crowd).collect()}
    assert got == {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2}


def test_components_of_paths(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and {got[100], got[200], got[300]} == {100}


@pytest.mark.parametrize("links, most", [([(i, 0) for i in range(1, 50)], 12), ([(i + 1, i) for i in range(40)], 60)])
def test_components_run_few_jobs(spark, links, most):
    # the driver keeps a record of every task; a star took 24 jobs, the path 74
    spark.sparkContext.setJobGroup(f"few-jobs-{most}", "components")
    try:
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"few-jobs-{most}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {x: 0 for x in range(len(links) + 1)} and 0 < len(jobs) <= most


def test_keep_one(docs, spark):
    kept = simhash.keep_one(docs)
    comp = simhash.simhash_documents(docs).where("doc_id <=> component_id").select("doc_id").distinct()
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in comp.collect())
    # rows without an id stand for themselves where no row of their component has one
    nameless = spark.createDataFrame([(None, "one two three four"), (None, "one two three four"), (None, "five six seven eight"), (1, "nine ten"), (1, "eleven twelve thirteen")], "doc_id long, text string")
    assert simhash.keep_one(nameless).count() == 4


def test_near_copies_of_similarity_08_are_linked(spark):
    rng = random.Random(8)
    texts = []
    for group in range(30):
        base = [f"v{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(base))
        for edits in (2, 4, 5, 8, 12):
            near = list(base)
            for at in rng.sample(range(200), edits):
                near[at] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(near))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    prints = [brute_print(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    wide = 0
    for i in range(len(texts)):
        for j in range(i):
            similar = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
            near = (prints[i] ^ prints[j]).bit_count() <= 2
            wide += similar and not near
            if similar or near:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert wide > 20
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, "").collect()) == [i for i in range(len(texts)) if find(i) == i]


@pytest.mark.parametrize("block", [7, 2000])
def test_a_crowd_of_texts_around_the_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(near_sets, "BLOCK", block)
    rng = random.Random(9)
    base = [f"v{k}" for k in range(150)]
    texts = []
    for _ in range(60):
        near = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 5)):
            near[at] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 or (brute_print(texts[i]) ^ brute_print(texts[j])).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    wanted = [i for i in range(len(texts)) if find(i) == i]
    assert 1 < len(wanted) < len(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, "").collect()) == wanted


def test_sketches_rule_out_no_similar_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 3000):
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate([a[n // 9 :], rng.integers(0, 1 << 63, n // 10, np.uint64)])
        x, y = (np.frombuffer(near_sets.sketch(h), np.uint8) for h in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


GEAR = chunk_dedup.gear_table().tolist()


def brute_chunks(b):
    out, at, h = [], 0, 0
    for i, c in enumerate(b):
        h = ((h << 1) + GEAR[c]) & 0xFFFFFFFF
        n = i + 1 - at
        if n >= chunk_dedup.LEAST and h >> (32 - chunk_dedup.MEAN_BITS) == 0 or n == chunk_dedup.MOST:
            out.append((at, i + 1))
            at = i + 1
    if out and 0 < len(b) - at < chunk_dedup.LEAST:
        out[-1] = (out[-1][0], len(b))
    elif at < len(b):
        out.append((at, len(b)))
    return out


def test_chunks(docs, rows):
    table = chunk_dedup.gear_table()
    assert len(set(table.tolist())) == 256
    texts = [(t or "").encode() for _, t, *_ in rows]
    cuts = {t: brute_chunks(t) for t in set(texts)}
    got = chunk_dedup.chunk_dedup(docs).collect()
    first, seen = {}, Counter()
    order = sorted({(r[0] is None, r[0] or 0, t) for r, t in zip(rows, texts)})
    for place in order:
        for a, b in cuts[place[2]]:
            first.setdefault(place[2][a:b], (place, a))
    for r in got:
        t = (r.text or "").encode()
        place = (r.doc_id is None, r.doc_id or 0, t)
        gone = [(a, b) for a, b in cuts[t] if first[t[a:b]] != (place, a)]
        m = np.zeros(len(t) + 2, int)
        for a, b in gone:
            m[a:b] = 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], m[: len(t)], [0])))).tolist()
        assert (r.n_chunks, r.removed_spans) == (len(cuts[t]), edge)
        seen[bool(edge)] += 1
    assert seen[True] and seen[False]


def test_empty_tables(none):
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert simhash.simhash_documents(none).count() == 0
    assert chunk_dedup.chunk_dedup(none).count() == 0


def test_extra_columns_pass(docs):
    more = docs.withColumn("row", F.lit(1)).withColumn("key", F.lit("k")).withColumn("starts", F.lit(2)).withColumn("fp", F.lit(3))
    assert suffix_dedup.remove_repeats(more).columns[: len(more.columns)] == more.columns
    assert chunk_dedup.chunk_dedup(more).columns[: len(more.columns)] == more.columns
    assert simhash.keep_one(more).columns == more.columns
