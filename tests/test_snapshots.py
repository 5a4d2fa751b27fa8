import random

from pyspark.sql import functions as F

from quiver.operators.snapshots import as_set, consecutive, snapshot_changes

NODE = "snapshot_id long, id long, labels array<string>, name string, score double, at int"


def found(spark, info, nodes):
    pairs = consecutive(spark.createDataFrame(info, "snapshot_id long, shard_id long, taken_at int"), "shard_id", "taken_at")
    df = spark.createDataFrame(nodes, NODE)
    out = snapshot_changes(df, pairs, "id", [as_set("labels"), F.col("name"), F.col("score")])
    return sorted((r.snapshot_id, r.id, r.change_kind) for r in out.collect())


def test_kinds_nulls_sets_and_repeats(spark):
    info = [(2, 1, 10), (1, 1, 20), (1, 1, 20), (3, 2, 5)]  # 1 follows 2: order is by time
    nodes = [
        (2, 1, ["A", "B"], "x", 1.0, 0), (1, 1, ["B", "A", "A"], "x", 1.0, 9),  # same content
        (2, 2, [], None, None, 0), (1, 2, [], None, 0.5, 0), (1, 2, [], None, 0.5, 1),  # changed, repeated
        (2, 3, None, "y", None, 0),  # removed
        (1, 4, None, None, None, 0),  # added
        (2, 5, ["x"], None, 0.0, 0), (1, 5, None, "x", 0.0, 0),  # a null moved
        (3, 1, ["A"], "q", 1.0, 0), (9, 1, ["A"], "q", 1.0, 0), (1, None, ["A"], "q", 1.0, 0),
    ]
    assert found(spark, info, nodes) == [(1, 2, "changed"), (1, 3, "removed"), (1, 4, "added"), (1, 5, "changed")]


def test_empty(spark):
    assert found(spark, [(1, 1, 1), (2, 1, 2)], []) == []
    assert found(spark, [], [(1, 1, None, None, None, 0)]) == []


def test_against_brute_force(spark):
    rng = random.Random(2)
    info = [(s * 10 + i, s, rng.randint(0, 99)) for s in range(3) for i in range(5)]
    content, nodes = {}, []
    for snap, *_ in info:
        for k in range(30):
            if rng.random() < 0.7:
                c = (tuple(rng.sample("ABC", rng.randint(0, 3))), rng.choice([None, "n", "m"]), rng.choice([None, 1.5]))
                content[snap, k] = (frozenset(c[0]), *c[1:])
                nodes += [(snap, k, list(c[0]), c[1], c[2], rng.randint(0, 9))] * rng.choice([1, 1, 2])
    want = []
    for s in range(3):
        order = [x[0] for x in sorted((i for i in info if i[1] == s), key=lambda i: (i[2], i[0]))]
        for a, b in zip(order, order[1:]):
            for k in range(30):
                x, y = content.get((a, k)), content.get((b, k))
                if x != y:
                    want.append((b, k, "added" if x is None else "removed" if y is None else "changed"))
    assert found(spark, info, nodes) == sorted(want)


def test_several_contents_of_one_key_in_a_snapshot(spark):
    info = [(1, 1, 1), (2, 1, 2)]
    row = lambda snap, k, v: (snap, k, None, v, None, 0)
    names = [f"n{i}" for i in range(5)]
    nodes = [row(1, 1, n) for n in names] + [row(2, 1, n) for n in names] * 2
    assert found(spark, info, nodes) == []
    for gone in range(5):  # whichever hash lies in the middle
        some = [row(1, 1, n) for n in names] + [row(2, 1, n) for i, n in enumerate(names) if i != gone]
        assert found(spark, info, some) == [(2, 1, "changed")]
