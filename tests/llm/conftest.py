import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Documents with exact and near copies, shared passages, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    out = [(i, " ".join(words(rng, rng.randrange(20, 200))), "en", f"s{i % 3}") for i in range(40)]
    passage = " ".join(words(rng, 90))
    for i in range(40, 46):
        out.append((i, " ".join(words(rng, 30)) + "\n" + passage + "\n" + " ".join(words(rng, 25)), "de", "s0"))
    base = words(rng, 600)
    for i in range(46, 50):
        near = list(base)
        near[rng.randrange(600)] = "changed"
        out.append((i, " ".join(near), "en", "s1"))
    out += [(50 + i, out[3][1], "fr", "s2") for i in range(4)]
    out += [(54, None, None, None), (55, "", "en", None), (56, " \n\t ", "en", "s1"), (57, "Ünï Çödé 日本 🙂 <|endoftext|> x  y", "en", "s1"), (58, "a " * 3000, "en", "s1"), (59, "one two", "en", "s1"), (60, "z" * 900, "en", "s9")]
    out += [(61, " ".join(words(rng, 12_000)), "en", "s1"), (7, out[7][1], "en", "s1"), (None, "no id here at all", "en", "s1")]
    return [(d, t, la, s, None if t is None else len(t)) for d, t, la, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
