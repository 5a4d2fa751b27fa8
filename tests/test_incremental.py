import pytest
from pyspark.sql import functions as F

from quiver.operators.incremental import ChangeState, StateConflict, taken_in
from quiver.operators.log import latest_segments, placed_records

COLS = "k long, k2 string, v string, `row` int"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect()) if df is not None else None


def state(spark, tmp_path, **kw):
    return ChangeState(spark, f"file://{tmp_path}/state", ["k", "k2"], **kw)


def key(r):
    return tuple((x is None, x) for x in r)


def test_only_new_and_changed_rows(spark, tmp_path):
    s = state(spark, tmp_path)
    seen = []
    first = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "x", 1), (2, None, None, 2), (None, None, "n", 3)], COLS)
    s.run(first, lambda df: seen.extend(df.collect()))
    assert len(seen) == 4 and s.version() == 1
    seen.clear()
    second = spark.createDataFrame([(1, "a", "x", 1), (2, None, "y", 2), (None, None, "n", 3), (5, "e", "z", 9)], COLS)
    s.run(second, lambda df: seen.extend(df.collect()))
    assert sorted(r.k for r in seen) == [2, 5]
    seen.clear()
    s.run(second, lambda df: seen.extend(df.collect()))
    assert seen == [] and s.version() == 3


def test_null_and_value_in_another_column_differ(spark, tmp_path):
    s = ChangeState(spark, f"file://{tmp_path}/s", ["k"])
    s.run(spark.createDataFrame([(1, None, "x")], "k int, a string, b string"), lambda df: df.count())
    changed = s.changed(s.hashed(spark.createDataFrame([(1, "x", None)], "k int, a string, b string")))
    assert changed.count() == 1


def test_failure_leaves_the_state_and_nothing_is_skipped(spark, tmp_path):
    s = state(spark, tmp_path)
    df = spark.createDataFrame([(1, "a", "x", 1)], COLS)

    def broken(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        s.run(df, broken)
    assert s.version() == 0 and s.read() is None
    assert s.run(df, lambda c: c.count()) == 1
    assert s.run(df, lambda c: c.count()) == 0


def test_two_runs_cannot_publish_the_same_version(spark, tmp_path):
    s = state(spark, tmp_path)
    df = spark.createDataFrame([(1, "a", "x", 1)], COLS)
    keyed = s.keyed(s.hashed(df))
    s.publish(keyed, base=0)
    with pytest.raises(StateConflict):
        s.publish(keyed, base=0)
    assert s.version() == 1


def test_empty_table_and_partial_runs(spark, tmp_path):
    s = state(spark, tmp_path)
    empty = spark.createDataFrame([], COLS)
    assert s.run(empty, lambda c: c.count()) == 0
    s.run(spark.createDataFrame([(1, "a", "x", 1)], COLS), lambda c: c.count())
    assert s.run(spark.createDataFrame([(2, "a", "x", 1)], COLS), lambda c: c.count()) == 1
    both = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "x", 1)], COLS)
    assert s.run(both, lambda c: c.count()) == 0


def test_segments_and_garbage(spark):
    seg = spark.createDataFrame(
        [(1, 10, 100, None, "2025-01-01"), (1, 10, 100, 50, "2025-01-02"), (1, 11, 103, None, "2025-01-01"), (1, 10, 100, None, "2025-01-01")],
        "shard_id long, segment_id long, base_lsn long, last_good_offset long, noted_at string",
    )
    assert rows(latest_segments(seg), "segment_id", "last_good_offset") == [(10, 50), (11, None)]
    rec = spark.createDataFrame(
        [(1, 10, 0, 0, None), (1, 10, 49, 1, None), (1, 10, 50, 2, None), (1, 11, 0, 0, 999), (1, 12, 0, 0, 7), (1, 12, 0, 0, None), (None, 10, 0, 0, None)],
        "shard_id long, segment_id long, byte_offset long, rec_no int, lsn long",
    )
    assert rows(placed_records(rec, seg, "rec_no"), "lsn") == [(7,), (100,), (101,), (103,)]


def test_taken_in_against_brute_force(spark):
    import random

    rng = random.Random(5)
    recs = [(s, l, rng.randint(0, 50)) for s in (1, 2) for l in range(0, 4000, 7)] + [(2, 10**12, 3), (1, 5, None)]
    runs = [(s, None, a := rng.randint(-10, 4000), a + rng.randint(-5, 900), rng.choice(["ok", "failed"]), rng.randint(0, 50)) for s in (1, 2) for _ in range(8)]
    runs += [(1, 9, None, None, "ok", 1), (2, 8, None, None, "ok", 1), (1, None, None, 50, "ok", 60), (1, None, 3, 5000, "running", 60)]
    snaps = [(9, 1, 40), (8, 2, None)]
    r = spark.createDataFrame(recs, "shard_id long, lsn long, earliest int")
    q = spark.createDataFrame(runs, "shard_id long, snapshot_id long, from_lsn long, upto_lsn long, status string, started_at int")
    s = spark.createDataFrame(snaps, "snapshot_id long, shard_id long, wal_lsn long")
    floor = {1: 40}

    def covered(shard, lsn, at):
        if lsn <= floor.get(shard, -1):
            return True
        return any(st == "ok" and sh == shard and sn is None and f is not None and f < lsn <= u and at is not None and at <= b for sh, sn, f, u, st, b in runs)

    got = sorted((x.shard_id, x.lsn) for x in taken_in(r, q, s, bucket=64).collect())
    assert got == sorted((a, b) for a, b, c in recs if covered(a, b, c))
    none = taken_in(r, q.filter(F.lit(False)), s)
    assert none.count() == 0


def test_a_key_with_several_contents_is_not_repeated(spark, tmp_path):
    s = ChangeState(spark, f"file://{tmp_path}/several", ["k"], ["v"])
    t = lambda *vs: spark.createDataFrame([(1, v) for v in vs], "k int, v string")
    out = lambda df: sorted(r.v for r in df.collect())
    assert s.run(t("x", "z"), out) == ["x", "z"]
    assert s.run(t("x", "z"), out) == []
    assert s.run(t("x", "y", "z"), out) == ["y"]
    assert s.run(t("w"), out) == ["w"]
    assert s.run(t("x"), out) == ["x"]  # back to an earlier content is a change


def test_run_failure_rerun_and_rows_that_arrive_meanwhile(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    put = lambda k, v: spark.createDataFrame([(k, v)], "k int, v string").write.mode("append").parquet(path)
    s = ChangeState(spark, f"file://{tmp_path}/meanwhile", ["k"])
    put(1, "a")

    def work(df):
        got = sorted(r.k for r in df.collect())
        if 2 not in arrived:
            arrived.append(2)
            put(2, "b")
        return got

    def broken(df):
        df.count()
        raise RuntimeError("lost")

    arrived: list = []
    with pytest.raises(RuntimeError):
        s.run(spark.read.parquet(path), broken)
    assert s.version() == 0
    assert s.run(spark.read.parquet(path), work) == [1]
    assert s.run(spark.read.parquet(path), work) == [2]  # it came during the run before
    assert s.run(spark.read.parquet(path), work) == []
