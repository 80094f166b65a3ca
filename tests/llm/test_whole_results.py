"""Operators and pipeline stages as wholes against plain loops; clashing columns, repeated rows, cut characters."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

import corpus_pipeline
from tickloom.llm import chunk_dedup, hmm_lm, mixing, near_sets, quality_rules, site_quality, suffix_dedup, vector_search

from test_dedup import brute_print, brute_spans


def brute_nearest(rows, queries, k):
    """rows, queries: (id, vector); of the rows that equal a query in both, one is its own."""
    out = []
    for qid, q in queries:
        scored = []
        own = True
        for i, v in rows:
            if len(v) != len(q):
                continue
            if own and i == qid and v == q:
                own = False
                continue
            total = 0.0
            for a, b in zip(q, v):
                total += a * b
            scored.append((-total, i))
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("dim", [8, 1536])
def test_search_with_repeated_ids_and_rows(spark, dim):
    rng = random.Random(dim)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(dim)]) for i in range(90)]
    rows += [rows[0], rows[0], (20, rows[3][1]), (20, rows[5][1]), (7, rows[40][1]), (40, [2.0 * x for x in rows[40][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = vector_search.nearest(df, df.where("vec_id % 20 = 0"), 10, query_block=3, block=17).collect()
    assert sorted(tuple(r) for r in got) == brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 10)


def test_mix_is_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken = F.sum(F.col("mix_copies") * F.col("mix_size")).alias("n")
    got = mixing.mix_sources(docs).groupBy("source").agg(F.first("mix_target").alias("t"), taken, F.median("mix_size").alias("middle")).collect()
    assert len(got) > 10
    for r in got:
        assert abs(r.n - r.t) <= max(0.05 * r.t, r.middle), r


def test_mix_makes_up_for_a_large_text_and_keeps_its_probability(spark):
    """A text of two thirds of the target: with it or without it, the small ones fill up, and it comes at its rate."""
    sizes = [600] + [20] * 60 + [3] * 40
    rows = [(i, "w " * n, "s") for i, n in enumerate(sizes)] + [(1000 + i, "v " * 30, "t") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).cache()
    large, probability = 0, None
    for seed in range(12):
        got = [r for r in mixing.mix_sources(d, seed=seed).collect() if r.source == "s"]
        target = got[0].mix_target
        assert abs(sum(r.mix_copies * r.mix_size for r in got) - target) <= 20
        probability = target / sum(sizes)
        large += next(r.mix_copies for r in got if r.doc_id == 0)
    assert abs(large / 12 - probability) < 0.3


def test_mix_draws_some_of_equal_rows(spark):
    """Fifty equal rows: as many as the target has room for, whatever the partitions, with maps among the columns."""
    rows = [(1, "w " * 100, "a")] * 50 + [(i, "w " * 100, "b") for i in range(2, 52)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("more", F.create_map(F.lit("k"), F.rand()))
    for parts in (1, 7):
        got = mixing.mix_sources(d.repartition(parts)).where("source = 'a'").collect()
        assert len(got) == 50
        assert abs(sum(r.mix_copies * r.mix_size for r in got) - got[0].mix_target) <= 100


def test_each_document_is_drawn_at_its_rate(spark):
    rows = [(i, "w " * (5 + i % 7), f"s{i % 3}") for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    drawn, rate = Counter(), {}
    for seed in range(10):
        for r in mixing.mix_sources(d, seed=seed).collect():
            drawn[r.doc_id % 3] += r.mix_copies
            rate[r.doc_id % 3] = r.mix_target / r.mix_source_size
    for s, n in drawn.items():
        assert abs(n / 300 - rate[s]) < 0.08


def test_clashing_columns(spark, docs):
    more = docs.select("*", *(F.lit(-1.5).alias(c) for c in ("evidence", "host_good", "path_good", "p_good", "kept", "removed_spans", "kept_bytes", "n_chunks", *mixing.RESULT, "fp", "root", "row", "key", "ids", "window", "votes", "slice", "word")))
    labels = spark.createDataFrame([(1, True), (2, False), (3, True), (54, False)], "doc_id long, good boolean")
    assert site_quality.site_quality(more, labels).where("evidence <> -1.5").count() > 0
    assert suffix_dedup.remove_repeats(more).where("size(removed_spans) > 0").count() > 0
    assert chunk_dedup.chunk_dedup(more).where("n_chunks > 1").count() > 0
    assert mixing.mix_sources(more).where("mix_size < 0 or mix_copies < 0").count() == 0
    assert quality_rules.quality_rules(more).count() == hmm_lm.score_documents(more, frequent=20, shared=8, states=2, rounds=1).count() == more.count()
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, more, "/root/testdata/sf0.001")
        assert out.columns == more.columns and out.where("evidence <> -1.5 or mix_size <> -1.5 or n_chunks <> -1.5 or removed_spans <> -1.5").count() == 0, name
    judged = corpus_pipeline.quality(spark, more, "/root/testdata/sf0.001")
    assert judged.columns == more.columns and judged.where("kept <> -1.5").count() == 0
    assert corpus_pipeline.pack(spark, more, "").count() >= more.count()


def test_stages_take_empty_tables(spark, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0


def test_cuts_spare_marks_and_whole_characters(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("aé日🙂 x") for _ in range(300))
    texts = ["a\ufffdb " + passage + "\ufffd end é", "ü" + passage + "ö", "é" + passage[3:], passage[5:-2] + "日", "\ufffd alone", "", None]
    schema = StructType([StructField("doc_id", StringType()), StructField("text", StringType())])
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], schema).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    got = {r.doc_id: r for r in corpus_pipeline.repeats(spark, d, "").collect()}
    assert brute_repeats([(i, t) for i, t in enumerate(texts)]) == {i: r.text for i, r in got.items()}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())
    assert got[0].text.startswith("a\ufffdb ") and "\ufffd" in got[0].text[3:]


def brute_repeats(rows):
    """Texts by id after stage 3: bytes of repeated strings go, and what is left of a character that a cut splits."""
    raw = [(t or "").encode() for _, t in rows]
    out = {}
    for (i, t), b, edges in zip(rows, raw, brute_spans(raw, corpus_pipeline.PASSAGE)):
        if not edges:
            out[i] = t
            continue
        gone = set()
        for a, e in zip(edges[::2], edges[1::2]):
            gone.update(range(a, e))
        kept, at = "", 0
        for c in b.decode():
            n = len(c.encode())
            if not gone & set(range(at, at + n)):
                kept += c
            at += n
        if kept:
            out[i] = kept
    return out


def test_stages_by_brute_force(spark, docs, rows):
    """Near duplicates, repeats and mix, each on the rows that it gets, against loops over those rows."""
    unique = [(i, *r[1:]) for i, r in enumerate(rows)]
    d = spark.createDataFrame(unique, docs.schema)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, "").collect())
    root = list(range(len(unique)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    low = [(t or "").encode().lower().split() for _, t, *_ in unique]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in low]
    prints = [brute_print(t) for _, t, *_ in unique]
    for i in range(len(unique)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 2 or sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert kept == [i for i in range(len(unique)) if find(i) == i]
    left = [unique[i] for i in kept]
    cut = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, d.where(F.col("doc_id").isin(kept)), "").collect()}
    assert cut == brute_repeats([(i, t) for i, t, *_ in left])
    taken = Counter(r.doc_id for r in corpus_pipeline.mix(spark, d, "").collect())
    want = {r.doc_id: r.mix_copies for r in mixing.mix_sources(d).collect()}
    assert taken == Counter({i: n for i, n in want.items() if n})


def test_posteriors_by_loops(spark):
    rng = random.Random(7)
    rows = [(i, f"h{rng.randrange(4)}", f"p{rng.randrange(3)}", rng.gauss(0.5, 2)) for i in range(300)] + [(300, None, None, 1.0), (301, "lone", "p", -2.0)]
    share = 0.7
    prior = math.log(share / (1 - share))
    p = [1 / (1 + math.exp(-(e + prior))) for *_, e in rows]
    paths, hosts = defaultdict(list), defaultdict(list)
    for (_, h, q, _), x in zip(rows, p):
        paths[h, q].append(x)
        hosts[h].append(x)
    overall = (sum(p) + 1) / (len(p) + 2)

    def strength(groups, spread):
        big = [g for g in groups if len(groups[g]) >= 2]
        n = sum(len(groups[g]) for g in big)
        s = sum(len(groups[g]) * (sum(groups[g]) / len(groups[g]) - overall) ** 2 for g in big)
        v = sum(spread[g] for g in big)
        return min(max(overall * (1 - overall) / max(s / n - v / n / (n / len(big)), 1e-9) - 1, 10), 1e6)

    within = {g: sum((x - sum(xs) / len(xs)) ** 2 for x in xs) for g, xs in paths.items()}
    of_host = defaultdict(float)
    for (h, _), x in within.items():
        of_host[h] += x
    a, b = strength(hosts, of_host), strength(paths, within)
    got = {r.doc_id: r for r in site_quality.judge(spark.createDataFrame(rows, "doc_id long, source string, lang string, evidence double"), "source", "lang", share).collect()}
    assert len(got) == len(rows)
    for (i, h, q, e), x in zip(rows, p):
        host = (sum(hosts[h]) + a * overall) / (len(hosts[h]) + a)
        path = (sum(paths[h, q]) - x + b * host) / (len(paths[h, q]) - 1 + b)
        good = 1 / (1 + math.exp(-(e + math.log(path / (1 - path)))))
        assert abs(got[i].host_good - host) < 1e-9 and abs(got[i].path_good - path) < 1e-9 and abs(got[i].p_good - good) < 1e-9
        assert got[i].kept == (good >= 0.5)


def test_rule_verdicts_by_loops(docs):
    """Expectation-maximisation over documents one by one gives the posteriors that counting patterns gives."""
    got = quality_rules.quality_rules(docs).collect()
    votes = [r.votes for r in got]
    m = len(votes[0])
    share, good, bad = 0.9, [0.999] * m, [0.2] * m

    def post(v):
        g, b = share, 1 - share
        for x, y, z in zip(v, good, bad):
            g *= y if x == 1 else 1 - y if x == -1 else 1
            b *= 1 - z if x == 1 else z if x == -1 else 1
        return g / (g + b)

    for _ in range(100):
        p = [post(v) for v in votes]
        share = min(max((sum(p) + 8) / (len(p) + 10), 0.05), 0.98)
        rate = lambda w, k, x: (sum(a for a, v in zip(w, votes) if v[k] == x) + 4) / (sum(a for a, v in zip(w, votes) if v[k]) + 5)
        q = [1 - x for x in p]
        good = [min(max(rate(p, k, 1), 0.55), 0.999) for k in range(m)]
        bad = [min(max(rate(q, k, -1), 0.05), 0.999) for k in range(m)]
    for r in got:
        want = post(r.votes)
        assert abs(r.p_good - want) < 1e-6
        assert r.kept == (not (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and want >= 0.5)


def test_whole_score_by_loops(spark, monkeypatch):
    """Forward probabilities of classes times the share of each word in its class, with a model that is known."""
    texts = ["a b a c", "b a dd ee", "a a b", "", None, "new words a", "ee ff a b b"] * 4
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = {}
    trained = hmm_lm.baum_welch

    def keep(*args):
        seen["model"] = trained(*args)
        return seen["model"]

    monkeypatch.setattr(hmm_lm, "baum_welch", keep)
    got = {r.doc_id: r for r in hmm_lm.score_documents(d, frequent=2, shared=3, states=2, rounds=2).collect()}
    m = seen["model"]
    from zlib import crc32

    words = [(t or "").encode().split() for t in texts]
    c = Counter(w for i, t in enumerate(words) if not got[i].held_out for w in t)
    top = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:2]]
    kind = lambda w: top.index(w) if w in top else 2 + crc32(w[-3:]) % 3
    tokens, types = Counter(), Counter()
    for w, n in c.items():
        tokens[kind(w)] += n
        types[kind(w)] += 1
    for i, t in enumerate(words):
        states, total = None, 0.0
        for k in [*map(kind, t), 5]:
            states = [m.start[z] * m.emit[k, z] for z in range(2)] if states is None else [sum(states[y] * m.move[y, z] for y in range(2)) * m.emit[k, z] for z in range(2)]
        total = math.log10(sum(states))
        total += sum(math.log10((c[w] + 1) / (tokens[kind(w)] + types[kind(w)] + 1)) for w in t if w not in top)
        assert abs(got[i].score - total) < 1e-9


def test_sets_of_odd_texts():
    """No words, fewer words than a shingle, repeats and a long text: all of their shingles, each once."""
    assert len(near_sets.shingles(b"", 5)) == len(near_sets.shingles(b" \n\t ", 5)) == 0
    assert len(near_sets.shingles(b"one Two", 5)) == 1 and (near_sets.shingles(b"one Two", 5) == near_sets.shingles(b"ONE two", 5)).all()
    assert len(near_sets.shingles(b"a " * 1000, 5)) == 1
    assert len(near_sets.shingles(b" ".join(b"%d" % i for i in range(30_000)), 5)) == 29_996


def test_odd_texts_in_bands(spark):
    texts = [None, "", " \n ", "one two", "ONE  two", " ".join(map(str, range(6000))), " ".join(map(str, range(6000))) + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_sets.with_bands(docs, "text", 5).collect()}
    assert [len(got[i]["__bands"]) for i in range(7)] == [0, 0, 0, 30, 30, 30, 30]
    assert len({got[i]["__set"] for i in range(3)}) == 1 and got[3]["__set"] == got[4]["__set"]
    assert got[5]["__size"] == 5996 and set(got[5]["__bands"]) & set(got[6]["__bands"])
    assert near_sets.with_bands(docs.limit(0), "text", 5).count() == 0
