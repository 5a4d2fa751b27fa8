from dataclasses import replace

import pytest

from graphs import social
from quiver.engine import Engine, TransactionConflict
from quiver.graph.mapping import NodeMapping, RelationshipMapping, add_nodes, add_relationships
from quiver.graph.property_graph import DamagedGraph, NodeTable, PropertyGraph
from quiver.graph.results import encode
from quiver.plans.expressions import QueryError
from quiver.plans.mutations import ConstraintViolation


def rows(e, text, **params):
    return [tuple(r) for r in e.execute(text, params).collect()]


@pytest.fixture
def s(spark):
    return social(spark)


def test_create(s):
    before = s.graph
    assert rows(s, "CREATE (d:User {name: 'Dave', tags: ['x', 'y']})-[r:LIKES {w: 1.5}]->(e:Thing) RETURN d.name, r.w, type(r), labels(e), d.age") == [("Dave", 1.5, "LIKES", ["Thing"], None)]
    assert rows(s, "MATCH (a {name: 'Alice'}) CREATE (a)-[:OWNS]->(:Thing {n: a.age + 1})") == []
    assert rows(s, "MATCH (:User)-[:OWNS]->(t:Thing) RETURN t.n") == [(31,)]
    assert before.counts()["nodes"] == 3 and s.graph.counts() == {"nodes": 6, "relationships": 5}
    assert rows(s, "UNWIND [1, 2, 3] AS i CREATE (n:Num {v: i}) RETURN count(n)") == [(3,)]
    assert len({r[0] for r in rows(s, "MATCH (n) RETURN id(n)")}) == 9
    for text in ("CREATE (a)-[:X]-(b)", "CREATE (a)-->(b)", "MATCH (a:User) CREATE (a:More)", "CREATE (:A|B)"):
        with pytest.raises(Exception):
            s.execute(text)


def test_merge(s):
    assert rows(s, "MERGE (n:User {name: 'Bob'}) ON CREATE SET n.new = true ON MATCH SET n.seen = 1 RETURN n.seen, n.age") == [(1, 25)]
    assert rows(s, "UNWIND ['p', 'q', 'p', 'p'] AS k MERGE (t:Tag {k: k}) RETURN count(*), count(DISTINCT t)") == [(4, 2)]
    assert rows(s, "UNWIND ['q', 'r'] AS k MERGE (t:Tag {k: k}) ON CREATE SET t.how = 'made' ON MATCH SET t.how = 'met' RETURN k, t.how ORDER BY k") == [("q", "met"), ("r", "made")]
    for _ in range(2):
        s.execute("MATCH (a:User {name: 'Alice'}), (t:Tag) MERGE (a)-[:HAS]->(t)")
    assert rows(s, "MATCH (:User)-[h:HAS]->() RETURN count(h)") == [(3,)]
    with pytest.raises(QueryError):
        s.execute("MERGE (n:User {name: null})")


def test_set_remove_labels(s):
    s.execute("MATCH (n:User) WHERE n.age < 31 SET n.age = n.age + 100, n:Young")
    assert rows(s, "MATCH (n:Young) RETURN n.name, n.age ORDER BY n.name") == [("Alice", 130), ("Bob", 125)]
    s.execute("MATCH (n {name: 'Bob'}) SET n = {name: 'Bob', city: 'X'}")
    assert rows(s, "MATCH (n {name: 'Bob'}) RETURN n.age, n.city, labels(n)") == [(None, "X", ["User", "Young"])]
    s.execute("MATCH (n:Young) REMOVE n:Young, n.age")
    assert rows(s, "MATCH (n) WHERE n.age IS NULL RETURN count(n)") == [(2,)] and rows(s, "MATCH (n:Young) RETURN n.name") == []
    s.execute("MATCH ()-[r]->() SET r.w = 0.5")
    assert rows(s, "MATCH ()-[r]->() RETURN sum(r.w), count(r.since)") == [(1.5, 2)]
    assert rows(s, "MATCH (n {name: 'Carol'}) SET n += $m RETURN n.age, n.extra", m={"age": 36, "extra": "e"}) == [(36, "e")]
    with pytest.raises(QueryError):
        s.execute("MATCH (n) SET n.name = 5")


def test_delete_and_foreach(s):
    with pytest.raises(QueryError):
        s.execute("MATCH (n {name: 'Alice'}) DELETE n")
    s.execute("MATCH (n {name: 'Alice'})-[r]->() DELETE r, n")
    assert s.graph.counts() == {"nodes": 2, "relationships": 1}
    s.execute("MATCH (n) OPTIONAL MATCH (n)-[r:KNOWS]->() DELETE r")
    s.execute("MATCH p = ()-[:FOLLOWS]->() DETACH DELETE p")
    assert s.graph.counts() == {"nodes": 0, "relationships": 0}
    s.execute("FOREACH (i IN range(1, 3) | CREATE (:N {v: i}) )")
    s.execute("MATCH (n:N) FOREACH (x IN CASE WHEN n.v > 1 THEN [1] ELSE [] END | SET n.big = true)")
    assert rows(s, "MATCH (n:N) RETURN n.v, n.big ORDER BY n.v") == [(1, None), (2, True), (3, True)]


def test_constraints(s):
    s.execute("CREATE CONSTRAINT u FOR (n:User) REQUIRE n.name IS UNIQUE")
    s.execute("CREATE CONSTRAINT e FOR ()-[r:FOLLOWS]-() REQUIRE r.since IS NOT NULL")
    kept = s.graph
    for text in ("CREATE (:User {name: 'Bob'})", "MATCH (a:User {name: 'Bob'}), (b:User {name: 'Alice'}) CREATE (a)-[:FOLLOWS]->(b)", "MATCH (n:User) SET n.name = 'same'"):
        with pytest.raises(ConstraintViolation):
            s.execute(text)
        assert s.graph is kept  # a query that fails changes nothing
    with pytest.raises(QueryError):
        s.execute("CREATE CONSTRAINT k FOR (n:User) REQUIRE (n.name, n.nope) IS NODE KEY")
    with pytest.raises(QueryError):
        s.execute("CREATE CONSTRAINT t FOR (n:User) REQUIRE n.age IS :: STRING")
    s.execute("CREATE CONSTRAINT t FOR (n:User) REQUIRE n.age IS :: STRING | INTEGER")
    assert [r[0] for r in rows(s, "SHOW CONSTRAINTS YIELD name")] == ["u", "e", "t"]
    s.execute("DROP CONSTRAINT u")
    s.execute("CREATE (:User {name: 'Bob'})")
    with pytest.raises(QueryError):
        s.execute("DROP CONSTRAINT u")
    s.execute("DROP CONSTRAINT u IF EXISTS")


def test_indexes_and_procedures(s):
    s.execute("CREATE (:Doc {t: 'Red fox, red hen', e: [1.0, 0.0]}), (:Doc {t: 'red', e: [0.0, 1.0]}), (:Doc {t: null, e: null}), (:Doc {e: [1.0]})")
    s.execute("CREATE FULLTEXT INDEX ft FOR (d:Doc) ON EACH [d.t]")
    assert rows(s, "CALL db.index.fulltext.queryNodes('ft', 'RED') YIELD score") == [(2.0,), (1.0,)]
    assert rows(s, "CALL db.index.fulltext.queryNodes('ft', 'red fox') YIELD score AS x") == [(3.0,)]
    assert rows(s, "CALL db.index.fulltext.queryNodes('ft', 're') YIELD score") == [] and rows(s, "CALL db.index.fulltext.queryNodes('ft', '')") == []
    s.execute("CREATE VECTOR INDEX v FOR (d:Doc) ON (d.e) OPTIONS {indexConfig: {`vector.dimensions`: 2, `vector.similarity_function`: 'euclidean'}}")
    got = s.execute("CALL db.index.vector.queryNodes('v', 5, [1.0, 0.0]) YIELD node, score").collect()
    assert [(r.node.t, round(r.score, 6)) for r in got] == [("Red fox, red hen", 1.0), ("red", 0.333333)]
    with pytest.raises(QueryError):
        s.execute("CALL db.index.vector.queryNodes('v', 5, [1.0])")
    with pytest.raises(QueryError):
        s.execute("CREATE INDEX v FOR (d:Doc) ON (d.e)")
    s.execute("CREATE INDEX v IF NOT EXISTS FOR (d:Doc) ON (d.e)")
    assert rows(s, "SHOW VECTOR INDEXES YIELD name, properties") == [("v", ["e"])]
    assert rows(s, "SHOW INDEXES YIELD name, type WHERE type = 'FULLTEXT' RETURN name AS n") == [("ft",)]


def test_save_load_and_mapping(s, spark, tmp_path):
    s.execute("CREATE INDEX i FOR (n:User) ON (n.age)")
    s.graph.save(f"{tmp_path}/g")
    back = PropertyGraph.load(spark, f"{tmp_path}/g")
    assert back.counts() == s.graph.counts() and back.indexes[0].name == "i"
    assert sorted(rows(Engine(back), "MATCH (a)-[r]->(b) RETURN a.name, type(r), b.name")) == sorted(rows(s, "MATCH (a)-[r]->(b) RETURN a.name, type(r), b.name"))
    people = spark.createDataFrame([(1, "a"), (1, "a"), (None, "x"), (2, "b")], "k int, n string")
    links = spark.createDataFrame([("a", "b", 1), ("a", "zz", 2), (None, "a", 3), ("a", "b", 1)], "f string, t string, w int")
    g = add_relationships(add_nodes(PropertyGraph(spark), people, NodeMapping("P", "k")), links, RelationshipMapping("L", "P", "n", "f", "P", "n", "t", {"w": "w"}))
    assert rows(Engine(g), "MATCH (x:P)-[l:L]->(y) RETURN x.n, l.w, y.n") == [("a", 1, "b")] * 2
    assert g.degree().collect() and rows(Engine(g), "MATCH (p:P) RETURN count(p)") == [(2,)]


def test_transactions(s):
    with s.transaction() as t:
        t.execute("CREATE (:User {name: 'T'})")
        t.savepoint("one")
        t.execute("MATCH (n:User) DETACH DELETE n")
        assert t.execute("MATCH (n) RETURN n").count() == 0
        t.rollback_to("one")
        assert s.graph.counts()["nodes"] == 3
    assert s.graph.counts()["nodes"] == 4
    with pytest.raises(RuntimeError):
        with s.transaction() as t:
            t.execute("CREATE (:User)")
            raise RuntimeError
    assert s.graph.counts()["nodes"] == 4
    t = s.transaction(read_only=True)
    with pytest.raises(QueryError):
        t.execute("CREATE (:X)")
    assert t.execute("MATCH (n) RETURN n").count() == 4
    t.rollback()
    with pytest.raises(QueryError):
        t.execute("RETURN 1")
    a, b = s.transaction(), s.transaction()
    for x in (a, b):
        x.execute("CREATE (:X)")
    a.commit()
    with pytest.raises(TransactionConflict):
        b.commit()


def test_cursor_profile_formats_timeout(s):
    columns, it = s.stream("MATCH (n:User {name: 'Nobody'}) RETURN n.name AS a, n.age AS b")
    assert columns == ["a", "b"] and list(it) == []
    p = s.profile("MATCH (n:User) RETURN n.name")
    assert p["rows"] == 3 and "Scan" in p["plan"]
    assert s.explain("CREATE (:X)") == "Create" and s.graph.counts()["nodes"] == 3
    text = "MATCH p = (a {name: 'Alice'})-[r:FOLLOWS]->(b) RETURN a, r, p, date('2024-01-02') AS d"
    g = encode(s.execute(text))
    assert sorted(n["properties"]["name"] for n in g["nodes"]) == ["Alice", "Bob"] and g["relationships"][0]["properties"] == {"since": 2020}
    assert encode(s.execute(text), "rows")["rows"][0]["d"] == "2024-01-02"
    assert encode(s.execute(text), "row_arrays")["rows"][0][1]["type"] == "FOLLOWS"
    assert set(encode(s.execute(text), "combined")) == {"columns", "rows", "nodes", "relationships"}
    with pytest.raises(ValueError):
        encode(s.execute(text), "xml")
    assert s.collect("RETURN 1 AS a", timeout=60)[0].a == 1
    with pytest.raises(TimeoutError):
        s.collect("UNWIND range(1, 3000) AS a UNWIND range(1, 3000) AS b UNWIND range(1, 3000) AS c RETURN sum(a * b + c)", timeout=1.5)


def test_single_nodes_and_relationships(spark):
    e = Engine(PropertyGraph.empty(spark))
    a, b = e.api.create_node(["P", "Q"], {"name": "a", "age": 3}), e.api.create_node(["P"], {"name": "b"})
    r = e.api.create_relationship("KNOWS", a, b, {"w": 1})
    assert e.api.node(a).name == "a" and sorted(e.api.node(a)._labels) == ["P", "Q"] and e.api.node(99) is None
    e.api.set_node(a, {"age": 4})
    e.api.set_relationship("KNOWS", r, {"w": 5})
    e.api.add_labels(b, "R")
    e.api.remove_labels(a, "Q")
    assert (e.api.node(a).age, e.api.node(a).name, e.api.node(a)._labels) == (4, "a", ["P"]) and e.api.relationship("KNOWS", r).w == 5
    assert e.api.create_relationship("KNOWS", a, 77) is None and e.api.relationship("LIKES", 0) is None
    with pytest.raises(QueryError):
        e.api.delete_node(a)
    e.api.delete_relationship("KNOWS", r)
    e.api.delete_node(a)
    assert e.api.node(a) is None and e.graph.counts() == {"nodes": 1, "relationships": 0}


def test_operators_are_measured(spark):
    e = Engine(PropertyGraph.of_rows(spark, [{"id": i, "labels": ["N"], "v": i % 3} for i in range(30)], []).frozen())
    p = e.profile("MATCH (n:N) RETURN n.v AS v, count(*) AS c")
    names = [(name, rows) for _, name, rows, _ in p["operators"]]
    assert p["rows"] == 3 and any(n.startswith("Scan parquet") and r == 30 for n, r in names) and any("HashAggregate" in n and r == 3 for n, r in names)


def test_vector_dimension_constraint(spark):
    good = PropertyGraph.of_rows(spark, [{"id": 1, "labels": ["D"], "e": [1.0, 2.0]}, {"id": 2, "labels": ["D"], "e": [1.0, 3.0]}], [])
    text = "CREATE CONSTRAINT v FOR (d:D) REQUIRE d.e IS :: VECTOR<FLOAT>({})"
    Engine(good).execute(text.format(2))
    with pytest.raises(QueryError):
        Engine(good).execute(text.format(3))


def test_a_failed_save_leaves_the_one_before(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    g = PropertyGraph.of_rows(spark, [{"id": 1, "labels": ["A"], "x": 1}], [])
    assert g.save(path) == 1
    broken = replace(g, nodes=(*g.nodes, NodeTable("bad", spark.range(1).selectExpr("id", "raise_error('lost') AS x"), "id", ("B",))))
    with pytest.raises(Exception):
        broken.save(path)
    assert PropertyGraph.load(spark, path, verify=True).counts()["nodes"] == 1
    assert g.save(path) == 2
    folder = PropertyGraph.load(spark, path).nodes[0].df.inputFiles()[0].rpartition("/")[0]
    spark.createDataFrame([(7, ["A"], 8)], "_id long, _labels array<string>, x long").write.mode("overwrite").parquet(folder)
    with pytest.raises(DamagedGraph):
        PropertyGraph.load(spark, path, verify=True)
    assert PropertyGraph.load(spark, path, 1, verify=True).counts()["nodes"] == 1
