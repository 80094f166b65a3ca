"""Token files, packing, language model, search, mixing, rules, classifier and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tickloom.llm import hmm_lm, mixing, packing, quality_rules, site_quality, token_files, vector_search
from tickloom.llm.common import scratch
from tickloom.llm.tokens import Encoder, encoder

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b", "a\n\nb \n c", "\n x", "don't  stop'LL", "x<|endoftext|>y z", "İstanbul ΣΑΣ ς Σ", "é é x́ ﬁ", "!\x1c! a", "123 4567 a1b2", " lead", "trail ", "tab\tx \ty", "A'S it's ' s", "日本語 テスト", "a\x00b \x7f", "🙂 ok🙂🙂", "x.\ny", "a\xa0 b", "end\n"]


@pytest.mark.parametrize("path", [WORD_FILE, BYTE_FILE])
def test_encoder_equals_library(path, rows):
    texts = ODD + [t or "" for _, t, *_ in rows]
    e = Encoder(path, most=50)
    for _ in range(2):
        ids, n = e.encode(texts)
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [e.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_workers_forget_pieces_after_a_task():
    path = public_tokenizers.path("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["some words again", None])], names=["doc_id", "text"])
    first = list(token_files.token_batches([batch], path, 1))
    assert len(encoder(path).known)
    again = list(token_files.token_batches([batch], path, 1, keep=False))
    assert again == first and not encoder(path).known and not encoder(path).known.old


def test_more_pieces_change_no_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["Some words, some again", None])], names=["doc_id", "text"])
    few = list(token_files.token_batches([batch], path, 2, True, most=1))
    assert list(token_files.token_batches([batch], path, 2, True, most=token_files.PIECES)) == few
    assert encoder(path, token_files.PIECES).most == token_files.PIECES > encoder(path).most


@pytest.mark.parametrize("path", [WORD_FILE, BYTE_FILE])
def test_accented_words_are_learnt_without_the_pattern(path, monkeypatch):
    e, words = Encoder(path), ["château", "ñandú", "ªº", "straße", "ƻǆ", "İx", "ÀÉ", "plain"]
    wanted = [e.whole.encode(w if e.lowered else " " + w, add_special_tokens=False).ids for w in words]
    assert [np.frombuffer(e.known[w], e.kind).tolist() for w in words] == wanted

    class Unused:
        def findall(self, text):
            raise AssertionError(text)

    monkeypatch.setattr("tickloom.llm.tokens._WORDS", Unused())
    monkeypatch.setattr("tickloom.llm.tokens._BYTES", Unused())
    e.forget()
    assert [np.frombuffer(e.known[w], e.kind).tolist() for w in words[:4]] == wanted[:4]


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 5, token_files.LANES, 3 * token_files.ROUNDS * token_files.LANES + 77):
        ids = np.minimum(rng.geometric(0.02, n), 3000).astype(np.uint32)
        f, start, symbol = token_files.tables(token_files.quantise(np.bincount(ids)))
        states, at, words = token_files.encode_block(ids, f, start)
        step = token_files.ROUNDS * token_files.LANES
        for k in reversed(range(len(states))):  # any part by itself
            assert (token_files.decode_part(min(step, n - k * step), states[k], words[at[k] :], f, start, symbol) == ids[k * step : (k + 1) * step]).all()
    assert token_files.quantise(np.array([0, 1, 10**9])).tolist()[0] == 0


def test_token_files(spark, docs, rows):
    path = scratch(spark, "t")
    token_files.write_tokens(docs, path, WORD_FILE, 2, shards=5)
    tk = Tokenizer.from_file(WORD_FILE)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    want = Counter((d, tuple(tk.encode(t or "", add_special_tokens=False).ids + [2])) for d, t, *_ in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)


def test_damage_is_found(spark, docs):
    path = scratch(spark, "t")
    token_files.write_tokens(docs, path, WORD_FILE, 2)
    bad = scratch(spark, "t")
    spark.read.parquet(f"{path}/model").write.parquet(f"{bad}/model")
    b = spark.read.parquet(f"{path}/blocks")
    b.withColumn("crcs", F.transform("crcs", lambda x: x + 1)).write.parquet(f"{bad}/blocks")
    with pytest.raises(Exception, match="checksum"):
        token_files.read_tokens(spark, bad).count()


def test_packing(docs, rows):
    tk = Tokenizer.from_file(BYTE_FILE)
    pieces = packing.pack_documents(docs, BYTE_FILE, 1, length=256).collect()
    want = Counter()
    for d, t, *_ in rows:
        want[(d, tuple(tk.encode(t or "", add_special_tokens=False).ids + [1]))] += 1
    by, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length
        by[(p.doc_id, p.doc_tokens)].append((p.start, tuple(ids)))
        seqs[p.sequence_id].append((p.offset, p.length))
    for d, ids in want:
        mine = sorted(by[(d, len(ids))])
        assert Counter(x for s, part in mine for x in part) == Counter(x for k, c in want.items() if k[0] == d and len(k[1]) == len(ids) for x in k[1] * c)
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256


def test_windows_are_bounded():
    w = packing.Windows(0, 100, 3)
    for k in range(500):
        window, offset = w.place(1 + (k * 37) % 100)
        assert len(w.open) <= 3 and offset < 100


def test_language_model(docs, rows):
    low = lambda t: [w for w in (t or "").encode().lower().split()] + [None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, t, *_ in rows if not held(d) for w in low(t))
    n, v = sum(c.values()), len(c)
    got = hmm_lm.score_documents(docs, frequent=50, shared=16, states=3, rounds=3).collect()
    assert len(got) == len(rows)
    want = Counter((d, held(d), len(low(t)), sum(c[w] > 0 for w in low(t)), round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in low(t)), 5)) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)


def test_forward_is_exact_and_sums_to_one():
    rng = np.random.default_rng(2)
    k, c = 3, 5
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm_lm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((c, k)), 0))
    from itertools import product

    for length in (1, 2, 4):
        seqs = [np.array(s) for s in product(range(c), repeat=length)]
        p = 10 ** m.log10(seqs)
        assert abs(p.sum() - 1) < 1e-9
        s = seqs[len(seqs) // 2]
        paths = sum(m.start[z[0]] * m.emit[s[0], z[0]] * np.prod([m.move[a, b] * m.emit[o, b] for a, b, o in zip(z, z[1:], s[1:])]) for z in product(range(k), repeat=length))
        assert abs(p[len(seqs) // 2] - paths) < 1e-12


def test_baum_welch_rises():
    rng = np.random.default_rng(3)
    tokens = np.array([40, 30, 20, 10, 5])
    obs = rng.integers(0, 4, (20, 30))
    obs[:10] %= 2
    lengths = np.full(20, 30)
    m, last = hmm_lm.Model.first(tokens, 3), -np.inf
    for _ in range(8):
        start, move, emit, score = m.expected(obs, lengths)
        assert score > last - 0.5 and abs(emit.sum() - obs.size) < 1e-6
        last, m = score, hmm_lm.Model.from_counts(start, move, emit, tokens)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[7] = v[3]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [1.0, None] * 8), (304, []), (320, [float("inf")] * 16), (340, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vector_search.nearest(df, df.where("vec_id % 20 = 0"), 20, query_block=4, block=50).orderBy("query_id", "rank").collect()
    x = v.astype(np.float64)
    want = []
    for q in range(0, 300, 20):
        s = np.add.accumulate(x[q] * x, axis=1)[:, -1]
        want += [(q, k + 1, i, s[i]) for k, i in enumerate(sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20])]
    assert [tuple(r) for r in got] == want
    assert vector_search.nearest(df.limit(0), df.limit(0)).count() == 0


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs).collect()
    size = lambda t: len((t or "").encode().split())
    per = Counter()
    for _, t, _, s, _ in rows:
        per[s] += size(t)
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, target, free = sum(per.values()), {}, set(order)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * per[s]}
        if not over:
            break
        target |= {s: 3.0 * per[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    for r in got:
        assert r.mix_size == size(r.text) and r.mix_source_size == per[r.source]
        assert abs(r.mix_target - target[r.source]) < 1e-6 * max(1, total)
        assert 0 <= r.mix_copies <= 3
        rate = target[r.source] / per[r.source] if per[r.source] else 0
        assert r.mix_copies in (int(rate + 1e-12), int(rate + 1e-12) + 1)
    assert mixing.emit_copies(mixing.mix_sources(docs)).count() == sum(r.mix_copies for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))


def brute_signals(t):
    w = [x.decode() for x in t.encode().split()]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, hit, seen, dup = Counter(win), set(), set(), 0
    for i, x in enumerate(win):
        if c[x] > 1:
            hit |= set(range(i, i + 5))
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(hit)


def test_rules(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs).collect())
    want = Counter()
    for d, t, *_ in rows:
        s = brute_signals(t or "")
        want[(d, *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
    assert got == want


def test_votes_recover_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.85
    votes = np.where(good[:, None], np.where(rng.random((20_000, 6)) < 0.98, 1, -1), np.where(rng.random((20_000, 6)) < 0.5, -1, 1))
    pattern, counts = np.unique(votes, axis=0, return_counts=True)
    share, right_good, right_bad = quality_rules.fit_votes(pattern, counts.astype(float))
    assert abs(share - 0.85) < 0.02 and np.abs(right_good - 0.98).max() < 0.02 and np.abs(right_bad - 0.5).max() < 0.05


def test_classifier_on_held_out_labels(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source", "lang")
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text", "source", "lang"))
    labels = site_quality.document_labels(spark, "/root/testdata/sf0.01").withColumn("doc_id", F.col("doc_id") + 10_000)
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    got = site_quality.site_quality(docs, train, keep=["doc_id", "source", "lang"]).join(test, "doc_id").select("kept", "good").collect()
    assert sum(r.kept == r.good for r in got) / len(got) > 0.85
    kept_good = [r.kept for r in got if r.good]
    assert sum(kept_good) / len(kept_good) > 0.95


def test_classifier_shrinks_sparse_sites(spark):
    rows = [(f"h{i % 2}", "p", 3.0 if i % 2 else -3.0) for i in range(400)] + [("rare", "p", -3.0)]
    got = site_quality.judge(spark.createDataFrame(rows, "source string, lang string, evidence double"), "source", "lang", 0.5)
    by = {r.source: r.path_good for r in got.groupBy("source").agg(F.avg("path_good").alias("path_good")).collect()}
    assert by["h0"] < 0.2 < by["rare"] < by["h1"]


def test_classifier_without_labels(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, good boolean")
    assert site_quality.site_quality(docs, labels).where("not kept").count() == 0


def test_empty_tables(spark, none):
    assert quality_rules.quality_rules(none).count() == 0
    assert hmm_lm.score_documents(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert packing.pack_documents(none, BYTE_FILE, 1).count() == 0
    assert site_quality.site_quality(none, spark.createDataFrame([(1, True)], "doc_id long, good boolean")).count() == 0
    path = scratch(spark, "t")
    token_files.write_tokens(none, path, WORD_FILE, 2)
    assert token_files.read_tokens(spark, path).count() == 0


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch(spark, "stage")
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        n.append(docs.count())
    assert n[0] > n[1] > n[2] >= n[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.agg(F.sum("length")).first()[0] > 0
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
