import random

from pyspark.sql import functions as F

from quiver.operators.cdc import EqualityDeleteTable, committed_mutations, last_checkpoints, touched_and_present


def test_order_and_repeats_make_no_difference(spark, tmp_path):
    rng = random.Random(1)
    changes = [(seq, rng.choice([None, 1, 2, 3, 4]), rng.choice(["put", "put", "del"]), f"v{seq}") for seq in range(60)]
    want = {}
    for seq, k, op, v in changes:
        want[k] = (seq, v) if op == "put" else None
    want = {k: v for k, v in want.items() if v}
    for n in range(2):
        t = EqualityDeleteTable(spark, f"file://{tmp_path}/t{n}", ["k"])
        feed = changes + rng.sample(changes, 20)
        rng.shuffle(feed)
        for part in (feed[:30], feed[30:]):
            t.append_rows(spark.createDataFrame([(k, s, v) for s, k, op, v in part if op == "put"], "k int, _seq long, v string"))
            t.append_deletes(spark.createDataFrame([(k, s) for s, k, op, v in part if op == "del"], "k int, _seq long"))
        assert {r.k: (r._seq, r.v) for r in t.current().collect()} == want


def test_delete_of_equal_sequence_and_empty(spark, tmp_path):
    t = EqualityDeleteTable(spark, f"file://{tmp_path}/t", ["k"])
    t.append_rows(spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, _seq long, v string"))
    t.append_deletes(spark.createDataFrame([(1, 5), (2, 6)], "k int, _seq long"))
    assert [r.k for r in t.current().collect()] == [1]
    e = EqualityDeleteTable(spark, f"file://{tmp_path}/e", ["k"])
    e.append_rows(spark.createDataFrame([], "k int, _seq long, v string"))
    e.append_deletes(spark.createDataFrame([], "k int, _seq long"))
    assert e.current().count() == 0


def test_touched_and_present(spark, tmp_path):
    t = EqualityDeleteTable(spark, f"file://{tmp_path}/t", ["k"])
    data = [(1, 0, "base"), (1, 5, "set"), (2, 0, "base"), (3, 4, "create"), (3, 6, "set"), (4, 0, "base"), (4, 7, "set"), (5, 3, "set"), (6, 0, "base"), (6, 9, "create")]
    t.append_rows(spark.createDataFrame(data, "k int, _seq long, what string"))
    t.append_deletes(spark.createDataFrame([(4, 6), (3, 5), (6, 8), (6, 8)], "k int, _seq long"))
    got = touched_and_present(t, F.col("what").isin("base", "create"), F.col("what") != "base")
    # 2 untouched; 3 deleted after its making; 4 set after its delete; 5 never made
    assert sorted((r.k, r.lsn) for r in got.collect()) == [(1, 5), (6, 9)]


def test_commits_and_checkpoints(spark):
    p = spark.createDataFrame([(1, 10, "mutation"), (1, 10, "tx_commit"), (1, 20, "mutation"), (2, 10, "mutation"), (1, None, "mutation"), (1, None, "tx_commit")], "shard_id long, tx_begin_lsn long, record_kind string")
    assert [(r.shard_id, r.tx_begin_lsn) for r in committed_mutations(p).collect()] == [(1, 10)]
    s = spark.createDataFrame([(1, 1, 5, 100), (1, 2, 9, None), (1, 3, 7, 50), (1, 3, 7, 50), (2, 4, 1, None)], "shard_id long, snapshot_id long, taken_at int, wal_lsn long")
    assert [tuple(r) for r in last_checkpoints(s).collect()] == [(1, 3, 50)]


def test_without_deletes_without_files_and_compacted(spark, tmp_path):
    t = EqualityDeleteTable(spark, f"file://{tmp_path}/t", ["k"], "k int, _seq long, v string")
    assert t.current().count() == 0
    t.append_rows(spark.createDataFrame([(1, 1, "a"), (1, 4, "b"), (2, 2, "c")], "k int, _seq long, v string"))
    assert sorted((r.k, r.v) for r in t.current().collect()) == [(1, "b"), (2, "c")]
    t.append(spark.createDataFrame([(2, 9, "d")], "k int, _seq long, v string"), spark.createDataFrame([(2, 5), (1, 6)], "k int, _seq long"))
    want = sorted((r.k, r.v) for r in t.current().collect())
    assert want == [(2, "d")]
    t.compact()
    assert sorted((r.k, r.v) for r in t.current().collect()) == want and t.rows().count() == 1
    t.append_rows(spark.createDataFrame([(1, 3, "late")], "k int, _seq long, v string"))  # older than its delete
    assert sorted((r.k, r.v) for r in t.current().collect()) == want
    bare = EqualityDeleteTable(spark, f"file://{tmp_path}/b", ["k"])
    assert bare.current().count() == 0
    bare.append_deletes(spark.createDataFrame([(1, 1)], "k int, _seq long"))
    assert bare.current().count() == 0
