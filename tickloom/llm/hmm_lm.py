"""A hidden Markov language model of words, trained by Baum-Welch over all partitions.

Words fall in classes: the most frequent ones are a class each, the others share classes by the hash
of their last three bytes. A hidden Markov model runs over the classes; within a class a word has the
probability (c + 1) / (N_b + V_b + 1), with its training count c and the tokens and distinct words of its
class, which leaves one share for words not seen. Both together are a distribution over all texts.

The number of classes and states is a parameter, so tables that go to every task are bounded;
counts of words are not, and stay in Spark tables that grow with the corpus and are joined. Training
counts every token of the training rows; for Baum-Welch (not for scores) sequences are cut in windows of
128, which loses one transition in 128 and counts the state after each cut as a start. Scores come from the forward recursion over whole texts, scaled at each step, which is exact; it takes a step
a word, so the longest text of a batch says how long the batch takes.

Defined cases: a null text is an empty one, whose only token is its end; a null id counts as the empty
text when rows are split; rows that repeat each other count each and get equal scores; an empty table
gives an empty result, and without training rows every word is unknown. Only the id and text columns are read.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_array, materialize, row_key, table, text_bytes

#: Words with a class of their own, classes that the others share, and states. The end has a class too.
FREQUENT, SHARED, STATES = 4000, 1024, 6
ROUNDS = 6
WINDOW = 128
#: Texts, and bytes of text, whose words are counted together.
SLICE_TEXTS, SLICE_BYTES = 1 << 15, 1 << 23


# ---- counting words


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), (key % 7 == 2).alias("held_out"), F.col(text_col).alias("text"))


def _slices(offsets: np.ndarray):
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1
        j = min(max(j, i + 1), n, i + SLICE_TEXTS)
        yield i, j
        i = j


def _split(buf: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
    """Words of each text, with A-Z in lower case (bytes know no other case)."""
    raw = buf.tobytes().lower()
    return [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def word_rows(prepared: DataFrame) -> DataFrame:
    """Two kinds of rows. With a word: how often the slice's training texts hold it, and for each of the
    slice's texts that hold it the number of the text and how often, packed in one int. Without: a text
    of the slice by number, with its id and key."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("slice", pa.int64()), ("pairs", pa.list_(pa.int32())), ("doc_id", pa.int64()), ("row", pa.int64())])

    def run(batches):
        at, part = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            buf, offsets = text_bytes(batch.column(3))
            held = np.array(batch.column(2).to_pylist(), bool)
            for i, j in _slices(offsets):
                texts = _split(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sizes = np.fromiter(map(len, texts), np.int64, j - i)
                known: dict[bytes, int] = {}
                word = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
                pair, times = np.unique((word << 16) | np.repeat(np.arange(j - i), sizes), return_counts=True)
                w, text = pair >> 16, pair & 0xFFFF
                train = np.bincount(w, weights=times * ~held[i:j][text], minlength=len(known)).astype(np.int64)
                # more than 16 bits of repeats take more entries
                extra = times // 65536
                if extra.any():
                    more = np.repeat(np.arange(len(w)), extra + 1)
                    ends = np.cumsum(extra + 1) - 1
                    full = np.full(len(more), 65535)
                    full[ends] = times - 65535 * extra
                    w, text, times = w[more], text[more], full
                packed = ((text.astype(np.uint32) << np.uint32(16)) | times.astype(np.uint32)).view(np.int32)
                m, n = len(known), j - i
                ids = np.full(m, at + part, np.int64)
                lists = list_array(packed, np.bincount(w, minlength=m), pa.int32())
                none = lambda k, t: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.binary()), pa.array(train), pa.array(ids), lists, none(m, pa.int64()), none(m, pa.int64())], schema=schema)
                number = list_array(np.arange(n, dtype=np.int32), np.ones(n, np.int64), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [none(n, pa.binary()), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, at + part)), number, batch.column(0).slice(i, n), batch.column(1).slice(i, n)], schema=schema
                )
                part += 1

    return prepared.mapInArrow(run, "word binary, n long, slice long, pairs array<int>, doc_id long, row long")


# ---- classes


class Classes(dict):
    """The class of a word: looked up for frequent words, else by its last bytes; what was met is kept, up to a bound."""

    def __init__(self, frequent: list[bytes], shared: int):
        super().__init__((w, k) for k, w in enumerate(frequent))
        self.frequent, self.shared = frequent, shared
        self.end = len(frequent) + shared

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
            self.update((w, k) for k, w in enumerate(self.frequent))
        c = self[word] = len(self.frequent) + crc32(word[-3:]) % self.shared
        return c


def class_sizes(counts: DataFrame, frequent: list[bytes], shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct training words of each class; a bounded number of rows comes back."""
    n = len(frequent) + shared + 1

    def run(batches):
        classes = Classes(frequent, shared)
        total = np.zeros((2, n))
        for batch in batches:
            c = np.fromiter(map(classes.__getitem__, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            times = batch.column(1).to_numpy()
            total[0] += np.bincount(c, weights=times, minlength=n)
            total[1] += np.bincount(c, minlength=n)
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at].astype(np.int64)), pa.array(total[1][at].astype(np.int64))], names=["c", "n", "v"])

    got = counts.where("n > 0").select("word", "n").mapInArrow(run, "c long, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    tokens, types = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in got:
        tokens[r.c], types[r.c] = r.n, r.v
    return tokens, types


def class_sequences(prepared: DataFrame, frequent: list[bytes], shared: int) -> DataFrame:
    """(doc_id, row, held_out, classes): the classes of a text's words as little-endian unsigned 16-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("held_out", pa.bool_()), ("classes", pa.binary())])

    def run(batches):
        classes = Classes(frequent, shared)
        for batch in batches:
            buf, offsets = text_bytes(batch.column(3))
            for i, j in _slices(offsets):
                texts = _split(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                got = [np.fromiter(map(classes.__getitem__, t), np.uint16, len(t)).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), pa.array(got, pa.binary())], schema=schema)

    return prepared.mapInArrow(run, "doc_id long, row long, held_out boolean, classes binary")


# ---- the model


class Model:
    """Start (K), transition (K, K) and emission (C, K) probabilities; the last class is the end."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, tokens: np.ndarray, states: int, seed: int = 11) -> Model:
        """States that mostly stay, each with its own random view of the class counts."""
        rng = np.random.default_rng(seed)
        share = (tokens + 0.5)[:, None] * np.exp(rng.uniform(-1, 1, (len(tokens), states)))
        move = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, share / share.sum(axis=0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, tokens: np.ndarray) -> Model:
        """Expected counts to probabilities; a tenth of a token of each class's overall share keeps all possible."""
        share = (tokens + 0.5) / (tokens + 0.5).sum()
        emit = emit + 0.1 * len(tokens) * share[:, None]
        return cls((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def expected(self, obs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts over windows (rows of ``obs``, of falling length) and their log likelihood."""
        t, k = obs.shape[1], len(self.start)
        live = [int(np.searchsorted(-lengths, -x, "left")) for x in range(t)]  # windows longer than x
        seen = self.emit[obs]
        alpha, scale = np.zeros((t, len(obs), k)), np.ones((t, len(obs)))
        now = self.start * seen[:, 0]
        for x in range(t):
            n = live[x]
            if x:
                now = (alpha[x - 1, :n] @ self.move) * seen[:n, x]
            s = now[:n].sum(axis=1)
            alpha[x, :n], scale[x, :n] = now[:n] / s[:, None], s
        beta = np.ones((len(obs), k))
        move, gamma = np.zeros((k, k)), np.zeros((t, len(obs), k))
        for x in range(t - 1, -1, -1):
            n = live[x]
            gamma[x, :n] = alpha[x, :n] * beta[:n]
            if x:
                back = seen[:n, x] * beta[:n] / scale[x, :n, None]
                move += alpha[x - 1, :n].T @ back
                beta[:n] = back @ self.move.T
        there = np.arange(t)[:, None] < lengths[None, :]
        o = obs.T[there]
        emit = np.stack([np.bincount(o, weights=gamma[:, :, s][there], minlength=len(self.emit)) for s in range(k)], axis=1)
        return gamma[0].sum(axis=0), move * self.move, emit, float(np.log(scale[there]).sum())

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of whole sequences, by the forward recursion scaled at each step."""
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        lengths = np.array([len(sequences[i]) for i in order])
        out = np.zeros(len(order))
        now = None
        live = len(order)
        flat = np.concatenate([sequences[i] for i in order])
        at = np.cumsum(lengths) - lengths
        for x in range(int(lengths[0])):
            while live and lengths[live - 1] <= x:
                live -= 1
            seen = self.emit[flat[at[:live] + x]]
            now = self.start * seen if now is None else (now[:live] @ self.move) * seen
            s = now.sum(axis=1)
            now /= s[:, None]
            out[:live] += np.log10(s)
        result = np.empty(len(order))
        result[order] = out
        return result


def _windows(cells, end: int):
    """Class sequences with their end, cut in windows: (observations, lengths), longest first, some thousands at a time."""
    held: list[np.ndarray] = []

    def close():
        held.sort(key=len, reverse=True)
        lengths = np.array([len(x) for x in held])
        obs = np.full((len(held), int(lengths[0])), end, np.int64)
        for k, x in enumerate(held):
            obs[k, : len(x)] = x
        return obs, lengths

    for cell in cells:
        seq = np.append(np.frombuffer(cell, np.uint16), np.uint16(end))
        for i in range(0, len(seq), WINDOW):
            held.append(seq[i : i + WINDOW])
            if len(held) == 2048:
                yield close()
                held = []
    if held:
        yield close()


def baum_welch(sequences: DataFrame, tokens: np.ndarray, states: int, rounds: int) -> Model:
    """Train on (classes) rows: each round sums the expected counts of all partitions."""
    spark = sequences.sparkSession
    model, end, n = Model.first(tokens, states), len(tokens) - 1, len(tokens)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model.start, model.move, model.emit))

        def run(batches, shared=shared):
            m = Model(*shared.value)
            total = np.zeros(states + states * states + n * states)
            for batch in batches:
                for obs, lengths in _windows((c.as_buffer() for c in batch.column(0)), end):
                    start, move, emit, _ = m.expected(obs, lengths)
                    total += np.concatenate((start, move.ravel(), emit.ravel()))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

        summed = sequences.select("classes").mapInArrow(run, "place long, n double").groupBy("place").agg(F.sum("n").alias("n"))
        # as many rows as the model has numbers: the bound is states * (1 + states + classes)
        total = np.zeros(states + states * states + n * states)
        for r in summed.collect():
            total[r.place] = r.n
        start, move, emit = np.split(total, [states, states + states * states])
        model = Model.from_counts(start, move.reshape(states, states), emit.reshape(n, states), tokens)
        shared.unpersist()
    return model


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, shared: int = SHARED, states: int = STATES, rounds: int = ROUNDS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    spark = docs.sparkSession
    prepared = _prepared(docs, id_col, text_col)
    rows = materialize(word_rows(prepared), "word-rows")
    counts = materialize(rows.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    texts = prepared.agg(F.count(F.when(~F.col("held_out"), 1)).alias("n")).first().n
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    n_all, v_all = totals.n + texts, totals.v + (texts > 0)
    top = [bytes(r.word) for r in counts.where("n > 0").orderBy(F.desc("n"), "word").limit(frequent).collect()]

    tokens, types = class_sizes(counts, top, shared)
    tokens[-1], types[-1] = texts, int(texts > 0)
    sequences = materialize(class_sequences(prepared, top, shared), "class-sequences")
    model = baum_welch(sequences.where("not held_out"), tokens, states, rounds)

    # what the counts of its words add to each text; those with a class of their own add nothing within it
    own = spark.createDataFrame([(bytearray(w), True) for w in top], "word binary, own boolean")
    known = counts.where("n > 0").join(F.broadcast(own), "word", "left")
    known = known.select("word", F.log10(F.col("n") + 1).alias("log"), F.when(F.col("own"), 0).otherwise(1).alias("within"))
    # a frequent word has a row in each slice of text, which one task would get: the frequent ones, no more than a parameter, are sent to all tasks
    words, frequents = rows.where("word is not null").select("word", "slice", "pairs"), F.broadcast(own.select("word"))
    met = words.join(F.broadcast(known.where("within = 0")), "word").unionByName(words.join(frequents, "word", "left_anti").join(known.where("within = 1"), "word"))
    pair = met.select("slice", "log", "within", F.explode("pairs").alias("p"))
    times = F.col("p").bitwiseAND(65535)
    sums = pair.groupBy("slice", F.shiftrightunsigned("p", 16).alias("text")).agg(
        F.sum(times).alias("known"), F.sum(times * F.col("log")).alias("logs"), F.sum(times * F.col("log") * F.col("within")).alias("within")
    )
    ids = rows.where("word is null").select("slice", F.col("pairs")[0].alias("text"), "doc_id", "row")
    sums = ids.join(sums, ["slice", "text"], "left").groupBy(F.col("doc_id").alias("s_id"), F.col("row").alias("s_row")).agg(*(F.coalesce(F.first(c), F.lit(0)).alias(c) for c in ("known", "logs", "within")))

    room = np.where(np.arange(len(tokens)) >= len(top), np.log10(tokens + types + 1.0), 0.0)
    room[-1] = 0.0
    given = spark.sparkContext.broadcast((model.start, model.move, model.emit, room))
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("path", pa.float64()), ("room", pa.float64())])

    def run(batches):
        start, move, emit, room = given.value
        m, end = Model(start, move, emit), len(room) - 1
        for batch in batches:
            seqs = [np.append(np.frombuffer(c.as_buffer(), np.uint16), np.uint16(end)).astype(np.int64) for c in batch.column(3)]
            if seqs:
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(3)), pa.array([len(s) for s in seqs], pa.int64()), pa.array(m.log10(seqs)), pa.array([float(room[s].sum()) for s in seqs])], schema=schema
                )

    paths = sequences.mapInArrow(run, "doc_id long, row long, held_out boolean, n_tokens long, path double, room double")
    end_known = int(texts > 0)
    return paths.join(sums, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("row") == F.col("s_row"))).select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + end_known).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.log10(F.lit(texts + 1.0)) - F.col("n_tokens") * F.log10(F.lit(float(n_all + v_all + 1)))).alias("base_score"),
        (F.col("path") + F.col("within") - F.col("room")).alias("score"),
    )


def op3_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_hmm_lm": op3_hmm_lm}
ORACLE: dict[str, str] = {}
