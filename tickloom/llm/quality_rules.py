"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a document. Votes are counted by pattern over the whole
corpus (a grouped count; with R rules there are at most 3^R patterns, however many documents), and
expectation-maximisation on those counts estimates how accurate each rule is and how common good
documents are. The posterior probability that a document is good replaces all-must-pass filtering.

Defined cases: a null or empty text has no words and fails the base rule; a null id is kept as it
is; repeated rows get equal results; an empty table gives an empty result. Only the id and text
columns are read.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, table, text_bytes

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[0xC3:] = True  # lead bytes of letters outside ASCII
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True
END = np.zeros(256, bool)
END[list(b".!?:;\"')")] = True

#: Window of words whose repetition is counted.
WINDOW = 5
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_alpha_words", "n_ended_lines", "n_distinct")


def _repeated(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words per document that lie in a window found twice or more in that document."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return np.zeros(n_docs, np.int64)
    inside = doc[:n] == doc[WINDOW - 1 :]
    h = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        h = (h ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        h ^= h >> np.uint64(31)
    at = np.flatnonzero(inside)
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    cand = order[hit]
    covered = np.zeros(len(ids) + 1, np.int64)
    if len(cand):
        # the hash only proposes; equality is decided on the words themselves
        rows = np.column_stack([doc[cand], *(ids[cand + k] for k in range(WINDOW))])
        _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        real = cand[counts[inverse.ravel()] > 1]
        np.add.at(covered, real, 1)
        np.add.at(covered, real + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(covered)[:-1] > 0, minlength=n_docs).astype(np.int64)


def measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The signals of every text in a run of texts."""
    n = len(offsets) - 1
    raw = buf.tobytes()
    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    split = [t.split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, n)
    owner = np.repeat(np.arange(n), np.diff(offsets))

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n).astype(np.int64)

    known: dict[bytes, int] = {}
    number = count()
    ids = np.fromiter((known.setdefault(w, i) for words in split for w, i in zip(words, number)), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(n), n_words)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    letters = LETTER[buf]
    # words with a letter: of each word's letters, count the first
    space = SPACE[buf]
    starts = offsets[:-1][np.diff(offsets) > 0]
    begins = (~space) & np.concatenate(([True], space[:-1])) if len(buf) else np.zeros(0, bool)
    begins[starts] = ~space[starts]
    word_of = np.cumsum(begins)
    lettered = np.unique(word_of[letters], return_index=True)[1]
    return {
        "n_words": n_words,
        "word_chars": per_text(~space & ~CONTINUES[buf]),
        "n_symbols": per_text(SYMBOL[buf]),
        "n_dup_lines": np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, n),
        "n_repeat_words": _repeated(ids, doc, n),
        "n_lines": np.fromiter(map(len, lines), np.int64, n),
        "n_upper": per_text(UPPER[buf]),
        "n_letters": per_text(letters),
        "n_alpha_words": np.bincount(owner[np.flatnonzero(letters)[lettered]], minlength=n).astype(np.int64),
        "n_ended_lines": np.fromiter((sum(x.rstrip()[-1:] in b".!?:;\"')" for x in y) for y in lines), np.int64, n),
        "n_distinct": np.fromiter((len(set(x)) for x in split), np.int64, n),
    }


def signals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    fields = [pa.field("doc_id", pa.int64()), *(pa.field(s, pa.int64()) for s in SIGNALS)]

    def run(batches):
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, 1 << 21):
                got = measure(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(got[s]) for s in SIGNALS)], schema=pa.schema(fields))

    kind = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(s, T.LongType()) for s in SIGNALS)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kind)


def _vote(good, bad):
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")


def rules() -> dict:
    """Rule by name: an expression over the signals that is 1 (good), -1 (bad) or 0 (abstains)."""
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    lines = F.greatest(c("n_lines"), F.lit(1))
    mean = c("word_chars") / words
    upper = c("n_upper") / F.greatest(c("n_letters"), F.lit(1))
    variety = c("n_distinct") / words
    letters = c("n_letters") / F.greatest(c("word_chars"), F.lit(1))
    long_enough = c("n_words") >= 30
    return {
        "length": _vote(c("n_words") >= 40, c("n_words") < 12),
        "word_length": _vote((mean >= 3) & (mean <= 9), (mean < 2) | (mean > 15)),
        "symbols": _vote(c("n_symbols") <= 0.01 * words, c("n_symbols") > 0.1 * words),
        "dup_lines": _vote((c("n_dup_lines") == 0) & (c("n_lines") >= 3), (c("n_dup_lines") > 0.3 * lines) & (c("n_lines") >= 4)),
        "repeats": _vote((c("n_repeat_words") <= 0.02 * words) & long_enough, c("n_repeat_words") > 0.1 * words),
        "upper": _vote(upper <= 0.1, upper > 0.3),
        "variety": _vote((variety >= 0.35) & long_enough, variety < 0.1),
        "endings": _vote(c("n_ended_lines") >= 0.7 * lines, (c("n_ended_lines") < 0.1 * lines) & long_enough),
        "letters": _vote(letters >= 0.93, (letters < 0.75) & (c("n_words") >= 15)),
        "alpha_words": _vote(c("n_alpha_words") >= 0.85 * words, c("n_alpha_words") < 0.6 * words),
    }


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents and, per rule, P(votes good | good) and P(votes bad | bad), by EM.

    Starts from rules that hardly ever call a good document bad, as their thresholds are loose,
    and that each know one document in five of the bad ones, as every rule sees another fault.
    That also fixes which class is called good; pseudo-counts keep every estimate off 0 and 1.
    """
    share, right_good, right_bad = 0.9, np.full(votes.shape[1], 0.999), np.full(votes.shape[1], 0.2)
    up, down = votes == 1, votes == -1
    for _ in range(rounds):
        p = posterior(votes, share, right_good, right_bad)
        w, v = counts * p, counts * (1 - p)
        share = float(np.clip((w.sum() + 8) / (counts.sum() + 10), 0.05, 0.98))
        right_good = np.clip((w @ up + 4) / (w @ (up | down) + 5), 0.55, 0.999)
        right_bad = np.clip((v @ down + 4) / (v @ (up | down) + 5), 0.05, 0.999)
    return share, right_good, right_bad


def posterior(votes: np.ndarray, share: float, right_good: np.ndarray, right_bad: np.ndarray) -> np.ndarray:
    up, down = votes == 1, votes == -1
    good = np.log(share) + up @ np.log(right_good) + down @ np.log1p(-right_good)
    bad = np.log1p(-share) + up @ np.log1p(-right_bad) + down @ np.log(right_bad)
    return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Signals, votes, p_good, base_failed and kept per document."""
    spark = docs.sparkSession
    named = rules()
    voted = signals(docs, id_col, text_col)
    voted = materialize(voted.select("*", F.array(*named.values()).alias("votes")), "quality-signals")
    patterns = voted.groupBy("votes").count().collect()  # at most 3^10 rows
    schema = "votes array<int>, p_good double"
    if patterns:
        votes, counts = np.array([r[0] for r in patterns]), np.array([r[1] for r in patterns], float)
        p = posterior(votes, *fit_votes(votes, counts))
        judged = spark.createDataFrame([(list(map(int, v)), float(x)) for v, x in zip(votes, p)], schema)
    else:
        judged = spark.createDataFrame([], schema)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        voted.join(F.broadcast(judged), "votes")  # at most 3^10 rows, see above
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good")
    )


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE: dict[str, str] = {}
