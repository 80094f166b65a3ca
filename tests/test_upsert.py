"""The versioned table against a plain loop over the updates in order, through restarts, repeats and failures."""

import random

import pytest

from tickloom.streaming.upsert import BarTable, last_updates

SCHEMA = "seq long, symbol string, time long, open double, high double, low double, close double, volume double"


def update(series, bar):
    """Equal time replaces, later appends, older is ignored."""
    if not series or bar[0] > series[-1][0]:
        series.append(bar)
    elif bar[0] == series[-1][0]:
        series[-1] = bar


def brute(rows):
    by = {}
    for _, s, *bar in sorted(rows):
        if s is not None and all(x == x and abs(x) != float("inf") for x in bar[1:5]):
            update(by.setdefault(s, []), tuple(bar))
    return sorted((s, *b) for s, series in by.items() for b in series)


def updates(n, seed=1):
    rng = random.Random(seed)
    out, now = [], {}
    for i in range(n):
        s = rng.choice(["A", "A", "A", "B", "C"])
        now[s] = now.get(s, 0) + rng.choice([0, 0, 60, 60, 120])
        t = now[s] - (rng.choice([60, 300]) if rng.random() < 0.2 else 0)
        p = float(rng.randrange(90, 110))
        out.append((i, s, t, p, p + 1, p - 1, p, float(rng.randrange(5))))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_equal_the_loop(spark, tmp_path):
    all_ = updates(300) + [(300, None, 1, 1.0, 1.0, 1.0, 1.0, 1.0), (301, "A", 10**6, float("nan"), 1.0, 1.0, 1.0, 1.0)]
    table = BarTable(spark, f"file://{tmp_path}/t")
    assert table.read().count() == 0
    for k in range(0, 302, 60):
        table.merge(spark.createDataFrame(all_[k : k + 60], SCHEMA).repartition(3), k // 60)
        assert rows(table.read()) == brute(all_[: k + 60])
    assert rows(table.read(2)) == brute(all_[:180])  # versions stay
    assert rows(last_updates(spark.createDataFrame(all_[:300], SCHEMA)).drop("seq")) == brute(all_[:300])
    table.compact(1)
    assert rows(table.read()) == brute(all_)
    more = updates(400)[300:]
    table.merge(spark.createDataFrame(more, SCHEMA), 9)
    assert rows(table.read()) == brute([r for r in all_ if r[1]] + more)
    assert table.vacuum() == 0 and rows(table.read(2)) == brute(all_[:180])  # all folders are of some version


def test_a_repeated_or_failed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    all_ = updates(120, 7)
    table = BarTable(spark, f"file://{tmp_path}/t")
    one, two = (spark.createDataFrame(all_[k : k + 60], SCHEMA) for k in (0, 60))
    table.merge(one, 0)
    monkeypatch.setattr("tickloom.streaming.upsert.write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.merge(two, 1)  # written, but not named by any version
    monkeypatch.undo()
    assert rows(table.read()) == brute(all_[:60])
    table.merge(two, 1)
    table.merge(two, 1)  # again, as after a restart
    table.merge(one, 0)  # long since built on
    assert rows(table.read()) == brute(all_)
    assert table.vacuum() == 2


def test_a_query_restarts_between_batches(spark, tmp_path):
    all_ = updates(200, 3)
    table = BarTable(spark, f"file://{tmp_path}/t")
    seen = []

    def feed(batch, version):
        seen.append(version)
        table.merge(batch, version)

    def run():
        q = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(feed).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    for k in range(4):
        spark.createDataFrame(all_[k * 50 : k * 50 + 50], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k % 2:
            run()  # two files each, from where the query before stopped
            assert rows(table.read()) == brute(all_[: k * 50 + 50])
    assert seen == [0, 1, 2, 3] and table.versions() == seen
    (tmp_path / "c" / "commits" / "3").unlink()  # as if it had ended before the last batch was marked done
    (tmp_path / "c" / "commits" / ".3.crc").unlink()
    run()
    assert seen == [0, 1, 2, 3, 3] and rows(table.read()) == brute(all_)
