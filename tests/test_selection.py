import math
import random

import pytest
from pyspark.sql import functions as F

from quiver.operators import selection
from quiver.operators.selection import select_rank
from quiver.workdir import materialise

MEDIAN = "floor((n + 1) / 2)"


def brute(rows, rank=lambda n: (n + 1) // 2):
    groups = {}
    for g, v, a, b in rows:
        if v is not None:
            groups.setdefault(g, []).append((v, a, b))
    order = lambda r: ((1, 0.0) if math.isnan(r[0]) else (0, r[0]), r[1], r[2])
    return {g: sorted(x, key=order)[rank(len(x)) - 1] for g, x in groups.items()}


def same(a, b):
    return (a[0] == b[0] or a[0] != a[0] and b[0] != b[0]) and a[1:] == b[1:]


@pytest.mark.parametrize("finish,buckets", [(4, 8), (2048, 4096), (0, 2)])
def test_against_brute_force(spark, finish, buckets):
    rng = random.Random(finish + buckets)
    rows = [("hot", rng.choice([0.0, 1.0, rng.random() * 1e6, -1e300, 1e300]), rng.randint(0, 3), i) for i in range(900)]
    rows += [("tied", 5.0, 2**62 + (i % 2), i) for i in range(200)]
    rows += [("odd", rng.choice([math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, 1e-323]), 0, i) for i in range(60)]
    rows += [(None, float(i), 0, i) for i in range(7)] + [("one", 3.5, 1, 1), ("null", None, 1, 1), ("null", 2.0, 1, 1)]
    rng.shuffle(rows)
    df = materialise(spark.createDataFrame(rows, "g string, v double, a long, b long"), "t")
    got = {r.g: (r.v, r.a, r.b) for r in select_rank(df, ["g"], ["v", "a", "b"], F.expr(MEDIAN), buckets, finish).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(same(got[g], want[g]) for g in want), [(g, got[g], want[g]) for g in want if not same(got[g], want[g])]


def test_other_ranks_and_extremes(spark):
    rows = [("g", 0.0, x, 0) for x in (-(2**63), 2**63 - 1, 0, 5, 6)]
    df = spark.createDataFrame(rows, "g string, v double, a long, b long")
    for k, want in enumerate([-(2**63), 0, 5, 6, 2**63 - 1], 1):
        assert select_rank(df, ["g"], ["v", "a"], F.lit(k), 4, 1).first().a == want
    assert select_rank(df, ["g"], ["v", "a"], F.lit(6)).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double, a long, b long")
    assert select_rank(df, ["g"], ["v", "a", "b"], F.expr(MEDIAN)).count() == 0


def test_weights_and_hot_groups(spark):
    rng = random.Random(31)
    rows = [("hot" if i % 3 else f"g{i % 40}", rng.randint(0, 400), rng.randint(1, 9)) for i in range(3000)]
    df = materialise(spark.createDataFrame(rows, "g string, v long, w int"), "weights")
    want = {}
    for g, v, w in rows:
        want.setdefault(g, []).extend([v] * w)
    want = {g: sorted(x)[(len(x) + 1) // 2 - 1] for g, x in want.items()}
    for small in (selection.SMALL, -1):  # with all cursors broadcast, and with those of hot groups only
        before, selection.SMALL = selection.SMALL, small
        try:
            out = select_rank(df, ["g"], ["v"], F.expr(MEDIAN), buckets=8, finish=16, weight="w").collect()
        finally:
            selection.SMALL = before
        assert {r.g: r.v for r in out} == want and len(out) == len(want)


def test_percentiles_hold_no_group_in_one_task(spark, monkeypatch):
    from quiver.engine import Engine
    from quiver.graph.property_graph import PropertyGraph
    from quiver.plans import compiler

    values = [random.Random(7).choice([i / 3, i, None]) for i in range(900)]
    g = PropertyGraph.of_rows(spark, [{"id": i, "labels": ["N"], "v": v if v is None else float(v), "k": i % 2} for i, v in enumerate(values)], [])
    text = "MATCH (n:N) RETURN {}percentileCont(n.v, 0.3) AS c, percentileDisc(n.v, 0.3) AS d"
    want = [Engine(g).execute(text.format(x)).orderBy("c").collect() for x in ("", "n.k AS k, ")]
    got = sorted(v for v in values if v is not None)
    at = 0.3 * (len(got) - 1)
    lo = int(at)
    assert want[0][0].c == pytest.approx(got[lo] + (got[lo + 1] - got[lo]) * (at - lo)) and want[0][0].d == got[round(at)]
    monkeypatch.setattr(compiler, "BOUNDED", 0)  # as for groups of many different values
    for x, rows in zip(("", "n.k AS k, "), want):
        df = Engine(g).execute(text.format(x))
        assert df.orderBy("c").collect() == rows
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan or "SinglePartition" not in plan.split("Window")[1][:400]
