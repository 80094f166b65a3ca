"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic classifier gives each document its own evidence: which of the telling words and word
beginnings it holds, and what its text looks like. It is fitted on a bounded sample of the labelled
rows (``SAMPLE`` at most, by hash of the id), which is small enough to be sent to all tasks, so that no
text is shuffled. Then hosts and paths within hosts have a share of good documents each, from the evidence of all
their documents: a path is shrunk to its host and a host to the corpus, each by a strength estimated
from how much such shares vary, so that a site with few documents says little. A document's posterior
odds are its own evidence times the odds of its path without itself.

In the documents table, which has no addresses, the host is the source and the path its language.

Defined cases: a null or empty text has no words and is judged by its looks; a null host or path is one of
its own; labels that are null, or of unknown documents, don't count; if a document has several labels,
each counts; without labels the evidence is nil and all documents are kept; rows that repeat each other
count each; an empty table gives an empty result. Other columns pass through, but for those of the result's
names, which are replaced (names that begin with two underscores are used inside). Labelled rows that repeat an
id are used up to twice the sample's bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_array, materialize, released, slices, small, table, text_bytes
from .quality_rules import measure

#: Features of words, labelled rows that weights are fitted on, and documents that a feature is in at least.
FEATURES, SAMPLE, LEAST = 1200, 20_000, 4
#: Bytes of a word's beginning.
STEM = 4
LOOKS = 12


def looks(m: dict[str, np.ndarray]) -> np.ndarray:
    """Numbers between 0 and 1 about a text's shape, most of them 0 for plain prose."""
    words, lines = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1)
    ramp = lambda x, a, b: np.clip((x - a) / (b - a), 0, 1)
    symbols, repeats = m["n_symbols"] / words, m["n_repeat_words"] / words
    upper, dup = m["n_upper"] / np.maximum(m["n_letters"], 1), m["n_dup_lines"] / lines
    letters = m["n_letters"] / np.maximum(m["word_chars"], 1)
    alpha, variety = m["n_alpha_words"] / words, m["n_distinct"] / words
    ended, mean = m["n_ended_lines"] / lines, m["word_chars"] / words
    many = m["n_words"] >= 15
    return np.stack(
        [
            ramp(symbols, 0.02, 0.15), ramp(repeats, 0.03, 0.2), ramp(upper, 0.15, 0.5), ramp(dup, 0.05, 0.3) * (lines >= 4), many * ramp(-letters, -0.85, -0.7),
            ramp(-alpha, -0.85, -0.6), many * ramp(-variety, -0.25, -0.1), many * ramp(-ended, -0.5, -0.1), ramp(-mean, -3, -2), ramp(mean, 9, 15), ramp(-m["n_words"], -12, -4.0), many * ramp(symbols, 0.15, 1),
        ],
        axis=1,
    )


def _features(raw: bytes) -> set[bytes]:
    """Words, and beginnings of words (marked by a zero byte), of a text in lower case."""
    words = set(raw.split())
    return words | {b"\0" + w[:STEM] for w in words}


def _each(batch: pa.RecordBatch, column: int):
    """Runs of texts: (first row, row after, lower-cased bytes of each, looks)."""
    buf, offsets = text_bytes(batch.column(column))
    for i, j in slices(offsets, 1 << 21):
        part, local = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        raw = part.tobytes().lower()
        yield i, j, [raw[a:b] for a, b in zip(local[:-1].tolist(), local[1:].tolist())], looks(measure(part, local))


def feature_counts(labelled: DataFrame) -> DataFrame:
    """(feature, good, bad): labelled documents that hold each feature. labelled: (text, good)."""

    def run(batches):
        counts: dict[bytes, list[int]] = {}

        def close():
            cols = list(zip(*counts.values()))
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["feature", "good", "bad"])
            counts.clear()
            return out

        for batch in batches:
            good = batch.column(1).to_pylist()
            for k, text in enumerate(batch.column(0).to_pylist()):
                for f in _features((text or "").encode().lower()):
                    counts.setdefault(f, [0, 0])[not good[k]] += 1
                if len(counts) > 1 << 18:
                    yield close()
        if counts:
            yield close()

    return labelled.select("text", "good").mapInArrow(released(run), "feature binary, good long, bad long").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def choose(labelled: DataFrame, features: int) -> list[bytes]:
    """The features whose counts among good and bad differ most, by the signed root of their chi-square part."""
    n = labelled.agg(F.count(F.when(F.col("good"), 1)).alias("g"), F.count("*").alias("n")).first()
    if not n.n:
        return []
    share = (n.g + 1) / (n.n + 2)
    total = F.col("good") + F.col("bad")
    gap = (F.col("good") - total * share) ** 2 / (total * share * (1 - share))
    counted = feature_counts(labelled).where(total >= LEAST)
    return [bytes(r.feature) for r in counted.orderBy(gap.desc(), "feature").limit(features).collect()]


def vectors(labelled: DataFrame, chosen: list[bytes]) -> DataFrame:
    """(id, good, features, looks): which of the chosen features each text holds."""
    at = {f: k for k, f in enumerate(chosen)}

    def run(batches):
        for batch in batches:
            for i, j, texts, seen in _each(batch, 1):
                held = [[at[f] for f in at.keys() & _features(t)] for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(held, pa.list_(pa.int32())), list_array(seen.ravel(), np.full(j - i, seen.shape[1]), pa.float64())],
                    names=["id", "good", "features", "looks"],
                )

    return labelled.select("id", "text", "good").mapInArrow(released(run), "id long, good boolean, features array<int>, looks array<double>")


def fit(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic regression, by gradient steps with momentum; the last column of ``x`` is all ones.

    Each row's loss counts the same, and the penalty holds all weights but the last as a normal prior would.
    ``x`` is the driver's largest array, so nothing here copies it.
    """
    w = np.zeros(x.shape[1], np.float32)
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    hold = np.full(len(w), penalty, np.float32)
    hold[-1] = 0
    # the step that the curvature of each coordinate's loss bounds, shared by coordinates that come together
    size = 0.25 * (x.T @ x.sum(axis=1)) + hold + 1e-6
    v, last = w.copy(), w.copy()
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        w = v - (x.T @ (p - y) + hold * v) / size
        v = w + k / (k + 3) * (w - last)
        last = w
    return w


def train(labelled: DataFrame, features: int = FEATURES) -> tuple[list[bytes], np.ndarray, float]:
    """Chosen features, weights, and the share of good rows that the constant stands for. labelled: (id, text, good), a bounded sample."""
    chosen = choose(labelled, features)
    # rows that repeat an id count each, so the bound holds here by the limit as well
    rows = vectors(labelled, chosen).orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE).toArrow() if chosen else None
    if rows is None or not len(rows):
        return chosen, np.zeros(len(chosen) + LOOKS + 1), 0.5
    x = np.zeros((len(rows), len(chosen) + LOOKS + 1), np.float32)
    held = rows["features"].combine_chunks()
    x[np.repeat(np.arange(len(rows)), np.diff(held.offsets.to_numpy())), held.flatten().to_numpy()] = 1
    x[:, len(chosen) : -1] = rows["looks"].combine_chunks().flatten().to_numpy().reshape(-1, LOOKS)
    x[:, -1] = 1
    y = rows["good"].to_numpy().astype(np.float32)
    return chosen, fit(x, y, penalty=0.5), float((y.sum() + 1) / (len(y) + 2))


def with_evidence(docs: DataFrame, text_col: str, chosen: list[bytes], weights: np.ndarray, share: float) -> DataFrame:
    """``docs`` with evidence: the log of how much likelier the text is among good than among bad documents."""
    place = docs.columns.index(text_col)
    given = docs.sparkSession.sparkContext.broadcast((chosen, weights, np.log(share / (1 - share))))

    def run(batches):
        chosen, w, prior = given.value
        of = dict(zip(chosen, w.tolist()))
        for batch in batches:
            parts = [np.zeros(0)]
            for _, _, texts, seen in _each(batch, place):
                words = np.array([sum(map(of.__getitem__, of.keys() & _features(t))) for t in texts])
                parts.append(words + seen @ w[len(chosen) : -1] + w[-1] - prior)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts))], names=[*batch.schema.names, "evidence"])

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField("evidence", T.DoubleType())]))


def _strength(groups: DataFrame, share: float) -> float:
    """How many documents a prior is worth: from the variance of the groups' shares beyond that of sampling."""
    r = groups.where("n >= 2").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("p") / F.col("n") - share) ** 2).alias("s"), F.sum(F.col("v")).alias("v")).first()
    if not r.n or r.k < 2:
        return 100.0
    between = max(r.s / r.n - r.v / r.n / (r.n / r.k), 1e-9)
    return float(np.clip(share * (1 - share) / between - 1, 10, 1e6))


def judge(scored: DataFrame, host_col: str, path_col: str, share: float, threshold: float = 0.5) -> DataFrame:
    """Add host_good, path_good, p_good and kept to rows with evidence."""
    prior = float(np.log(share / (1 - share)))
    p = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    paths = materialize(
        scored.select(F.col(host_col).alias("__host"), F.col(path_col).alias("__path"), p.alias("p"))
        .groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.var_pop("p").alias("var"))
        .withColumn("v", F.col("n") * F.col("var")).drop("var"),
        "paths",
    )
    hosts = paths.groupBy("__host").agg(*(F.sum(c).alias(c) for c in ("n", "p", "v")))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("p").alias("p")).first()
    overall = float(np.clip((whole.p + 1) / (whole.n + 2), 1e-3, 1 - 1e-3)) if whole.n else share
    of_host, of_path = _strength(hosts, overall), _strength(paths, overall)
    hosts = hosts.select(F.col("__host").alias("__h"), ((F.col("p") + of_host * overall) / (F.col("n") + of_host)).alias("host_good"))
    sites = materialize(paths.join(hosts, F.col("__host").eqNullSafe(F.col("__h"))).select("__host", "__path", F.col("n").alias("__n"), F.col("p").alias("__p"), "host_good"), "sites")
    # sites as few as counted there go to all tasks, so that no text moves and a hot site's rows stay where they are
    joined = scored.join(small(sites), F.col(host_col).eqNullSafe(F.col("__host")) & F.col(path_col).eqNullSafe(F.col("__path")))
    others = (F.col("__p") - p + of_path * F.col("host_good")) / (F.col("__n") - 1 + of_path)
    others = F.least(F.greatest(others, F.lit(1e-3)), F.lit(1 - 1e-3))
    odds = F.col("evidence") + F.log(others / (1 - others))
    return (
        joined.withColumn("path_good", others)
        .withColumn("p_good", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", F.col("p_good") >= threshold)
        .drop("__host", "__path", "__n", "__p")
    )


def site_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", features: int = FEATURES, sample: int = SAMPLE, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with evidence, host_good, path_good, p_good and kept; labels: (id, good)."""
    docs = docs.drop("evidence", "host_good", "path_good", "p_good", "kept")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("good").cast("boolean").alias("good")).where("id is not null and good is not null")
    known = materialize(known.orderBy(F.xxhash64("id"), "id", "good").limit(sample), "labels")
    texts = docs.select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).alias("text"))
    # broadcast: ``sample`` rows of two numbers at most
    labelled = materialize(texts.join(F.broadcast(known), F.col("d_id") == F.col("id")).select("id", "text", "good"), "labelled")
    chosen, weights, share = train(labelled, features)
    pa.default_memory_pool().release_unused()  # what held the sample's rows on the driver
    scored = materialize(with_evidence(docs, text_col, chosen, weights, share).select(*(keep or docs.columns), "evidence"), "evidence")
    # without labels there is no evidence, and documents are good unless shown otherwise
    return judge(scored, host_col, path_col, share if chosen else 0.9)


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents are those of quality 1 that aren't toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = site_quality(docs, document_labels(spark, sf_dir), keep=["doc_id", "source", "lang"])
    return out.select("doc_id", "kept", *(F.round(c, 6).alias(c) for c in ("evidence", "host_good", "path_good", "p_good")))


QUERIES = {"op7_site_quality": op7_site_quality}
ORACLE: dict[str, str] = {}
