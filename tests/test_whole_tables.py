"""Queries that must take in whole tables, over tables larger than the subsets that others keep."""

import duckdb
import pytest

import __spark_entry__
from quiver.engine import Engine
from quiver.graph.property_graph import EdgeTable, NodeTable, PropertyGraph
from quiver.plans import patterns
from quiver.queries import changes

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, key, table", [("varlen_bounded", "c", "customer"), ("all_shortest_paths", "s", "supplier")])
def test_paths_from_every_row(spark, name, key, table):
    con = duckdb.connect()
    for t in ("customer", "orders", "nation", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert len({r[0] for r in rows}) > 0.8 * con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    assert max(r[0] for r in rows) >= {"c": 200, "s": 10}[key]


@pytest.mark.parametrize("name", ["graph_save_load", "update_set", "update_delete", "catalog_constraints"])
def test_changes_run_over_the_whole_graph(spark, data, monkeypatch, name):
    seen = []
    load, engine = PropertyGraph.load, changes.Engine
    monkeypatch.setattr(PropertyGraph, "load", lambda *a: seen.append(load(*a)) or seen[-1])
    monkeypatch.setattr(changes, "Engine", lambda g: seen.append(g) or engine(g))
    changes.QUERIES[name](spark, data).collect()
    assert seen and all(len(g.labels()) == 10 and {e.type for e in g.edges} == {"PLACED", "CONTAINS", "SUPPLIED", "IN_NATION", "IN_REGION", "DID"} for g in seen)


def test_no_header_row_is_left_out(spark, data, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "limit", lambda *a: pytest.fail("a limit"))
    assert __spark_entry__.queries()["p2_rows"](spark, data).filter("typed IS NULL").count() == 0


def test_pairs_of_suppliers_are_not_multiplied_for_their_paths(spark, data, capsys):
    __spark_entry__.queries()["all_shortest_paths"](spark, data).explain()
    plan = capsys.readouterr().out
    assert "supplier.parquet" in plan
    assert not any(x in plan for x in ("NestedLoop", "Cartesian", "customer.parquet", "_nodes"))


@pytest.mark.parametrize("spread", [0, 10**6])
def test_shortest_paths_between_pairs_that_stand_apart(spark, monkeypatch, spread):
    monkeypatch.setattr(patterns, "SPREAD", spread)
    ab, bc = [(i * 7 % 9, i * 5 % 6) for i in range(14)], [(i * 3 % 5, i % 4) for i in range(8)]  # of B only 0 to 4 are there
    tables = [NodeTable(x, spark.createDataFrame([(i, f"{x}{i}", i % 3) for i in range(n)], "k bigint, name string, m int"), "k", (x,)) for x, n in (("A", 9), ("B", 5), ("C", 4))]
    edges = [EdgeTable(a + b, spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "e bigint, x bigint, y bigint"), "e", "x", "y", a, b) for a, b, rows in (("A", "B", ab), ("B", "C", bc))]
    engine = Engine(PropertyGraph(spark, tuple(tables), tuple(edges)))
    ways = {}
    for x, y in [(f"A{x}", f"B{y}") for x, y in ab if y < 5] + [(f"B{x}", f"C{y}") for x, y in bc]:
        ways.setdefault(x, []).append(y)
        ways.setdefault(y, []).append(x)
    expected = {}
    for start in (f"A{i}" for i in range(9)):
        front, seen = {start: 1}, {start}
        for k in range(1, 5):
            step = {}
            for x, n in front.items():
                for y in ways.get(x, ()):
                    if y not in seen:
                        step[y] = step.get(y, 0) + n
            front, seen = step, seen | set(step)
            expected |= {(start, y): (n, k) for y, n in front.items()}
    for label, high, where, ok in (("A", 2, "s.k <> t.k", lambda s, t: s != t), ("A", 4, "s.m = t.m AND s <> t", lambda s, t: s != t and int(s[1]) % 3 == int(t[1]) % 3), ("C", 4, "s.k < 7 AND t.m <> s.m", lambda s, t: s < "A7" and int(s[1]) % 3 != int(t[1]) % 3)):
        for kind in ("shortestPath", "allShortestPaths"):
            out = engine.execute(f"MATCH (s:A), (t:{label}) WHERE {where} MATCH p = {kind}((s)-[*..{high}]-(t)) RETURN s.name AS s, t.name AS t, count(*) AS n, min(length(p)) AS len")
            wanted = [(s, t, n if kind == "allShortestPaths" else 1, k) for (s, t), (n, k) in expected.items() if t[0] == label and k <= high and ok(s, t)]
            assert wanted and sorted(map(tuple, out.collect())) == sorted(wanted)


def test_paths_are_told_apart_where_more_than_their_length_counts(spark):
    engine = Engine(PropertyGraph.of_rows(spark, [{"id": i, "labels": ["N"], "i": i} for i in range(4)], [{"id": i, "type": "R", "src": a, "dst": b} for i, (a, b) in enumerate([(0, 1), (0, 2), (1, 3), (2, 3)])]))
    match = "MATCH (a:N {i: 0}), (b:N {i: 3}) MATCH p = allShortestPaths((a)-[:R*..2]->(b))"
    assert [tuple(r) for r in engine.execute(f"{match} RETURN count(p), count(DISTINCT p), count(DISTINCT length(p))").collect()] == [(2, 2, 1)]
    assert sorted(r[0] for r in engine.execute(f"{match} WHERE length(p) = 2 RETURN [n IN nodes(p) | n.i]").collect()) == [[0, 1, 3], [0, 2, 3]]
