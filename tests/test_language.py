import pytest

from graphs import build, line, org, packages, social, transport
from quiver.graph.property_graph import PropertyGraph, UnknownName
from quiver.lang.parser import QuerySyntaxError, parse
from quiver.plans.expressions import QueryError


def rows(e, text, **params):
    return [tuple(r) for r in e.execute(text, params).collect()]


@pytest.fixture(scope="module")
def s(spark):
    return social(spark)


@pytest.fixture(scope="module")
def o(spark):
    return org(spark)


def test_scan_filter_order(s):
    assert rows(s, "MATCH (n:User) WHERE n.age >= 30 RETURN n.name ORDER BY n.age DESC") == [("Carol",), ("Alice",)]
    assert rows(s, "MATCH (n {name: $n}) RETURN n.age", n="Bob") == [(25,)]
    assert rows(s, "MATCH (n $m) RETURN n.name", m={"age": 35}) == [("Carol",)]
    assert rows(s, "MATCH (n) RETURN n.name ORDER BY n.name SKIP 1 LIMIT $k", k=1) == [("Bob",)]
    assert rows(s, "MATCH (n) RETURN n.name AS x ORDER BY x LIMIT -3") == []


def test_hops(s):
    assert rows(s, "MATCH (a)-[r:FOLLOWS]->(b) RETURN a.name, b.name, r.since ORDER BY r.since") == [("Alice", "Bob", 2020), ("Bob", "Carol", 2021)]
    assert rows(s, "MATCH (b)<-[:FOLLOWS]-(a {name: 'Alice'}) RETURN b.name") == [("Bob",)]
    assert rows(s, "MATCH (a {name: 'Carol'})--(b) RETURN b.name ORDER BY b.name") == [("Alice",), ("Bob",)]
    assert rows(s, "MATCH (a)-[:FOLLOWS|KNOWS]->(b) RETURN count(*)") == [(3,)]
    assert rows(s, "MATCH (a)-[:FOLLOWS]->(b)-[:FOLLOWS]->(c) RETURN a.name, c.name") == [("Alice", "Carol")]
    assert rows(s, "MATCH (a)-[r]->(b) WHERE type(r) = 'KNOWS' RETURN startNode(r).name, endNode(r).name") == [("Alice", "Carol")]
    assert rows(s, "MATCH (a)-[:FOLLOWS]->(b), (a)-[:KNOWS]->(c) RETURN a.name, b.name, c.name") == [("Alice", "Bob", "Carol")]


def test_self_loop_counts_once(spark):
    e = build(spark, [(["N"], {"v": 1})], [("SELF", 0, 0, {})])
    assert rows(e, "MATCH (a)-[r]-(b) RETURN count(*)") == [(1,)]
    assert rows(e, "MATCH (a)-[r:SELF]->(a) RETURN a.v") == [(1,)]


def test_labels(o):
    assert rows(o, "MATCH (m:Person:Manager) RETURN m.name") == [("Frank",)]
    assert rows(o, "MATCH (x:Company|City) RETURN count(x)") == [(4,)]
    assert rows(o, "MATCH (p:Person)-[]->(x:City) RETURN count(*)") == [(6,)]
    assert rows(o, "MATCH (m:Manager) RETURN labels(m), node.has_label(m, 'Person')") == [(["Person", "Manager"], True)]


def test_optional_and_exists(o):
    got = rows(o, "MATCH (p:Person) OPTIONAL MATCH (p)-[a:ASSIGNED_TO]->(x:Project) WHERE a.role = 'lead' RETURN p.name, x.name ORDER BY p.name")
    assert got == [("Alice", "Alpha"), ("Bob", None), ("Carol", "Beta"), ("Dave", None), ("Eve", None), ("Frank", None)]
    assert rows(o, "MATCH (p:Person) WHERE NOT EXISTS { (p)-[:ASSIGNED_TO]->() } RETURN p.name ORDER BY p.name") == [("Dave",), ("Frank",)]
    assert rows(o, "MATCH (p:Person) WHERE EXISTS { MATCH (p)-[:MANAGES]->(q) WHERE q.age > 30 } RETURN p.name ORDER BY p.name") == [("Carol",), ("Frank",)]
    assert rows(o, "MATCH (p:Person) WHERE p.age > 45 OR EXISTS { (p)<-[:MANAGES]-(m {name: 'Carol'}) } RETURN p.name ORDER BY p.name") == [("Dave",), ("Frank",)]
    assert rows(o, "MATCH (p:Manager) OPTIONAL MATCH (p)-[:MANAGES*1..2]->(q) RETURN count(q)") == [(3,)]
    assert rows(o, "OPTIONAL MATCH (p:Person {name: 'Nobody'}) RETURN p, p.name") == [(None, None)]


def test_variable_length(spark):
    chain, ring = line(spark, 6), line(spark, 4, "Ring", "LOOP", True)
    assert rows(chain, "MATCH (a {idx: 0})-[:NEXT*1..3]->(b) RETURN b.idx ORDER BY b.idx") == [(1,), (2,), (3,)]
    assert rows(chain, "MATCH (a {idx: 0})-[:NEXT*]->(b) RETURN count(b)") == [(5,)]
    assert rows(chain, "MATCH (a {idx: 0})-[:NEXT*2]->(b) RETURN b.idx") == [(2,)]
    assert rows(chain, "MATCH (a {idx: 0})-[:NEXT*0..1]->(b) RETURN b.idx ORDER BY b.idx") == [(0,), (1,)]
    assert rows(chain, "MATCH (a {idx: 2})<-[:NEXT*..5]-(b) RETURN b.idx ORDER BY b.idx") == [(0,), (1,)]
    assert rows(chain, "MATCH p = (a {idx: 1})-[r:NEXT*2..2]->(b) RETURN length(p), size(r), [n IN nodes(p) | n.idx]") == [(2, 2, [1, 2, 3])]
    assert rows(ring, "MATCH (a {idx: 0})-[:LOOP*]->(b) RETURN count(*)") == [(4,)]  # each edge once
    assert rows(ring, "MATCH (a)-[:LOOP*4]->(a) RETURN count(*)") == [(4,)]


def test_paths(spark):
    t, p = transport(spark), packages(spark)
    assert rows(t, "MATCH q = shortestPath((a {name: 'Amsterdam'})-[:ROUTE*]->(b {name: 'Den Haag'})) RETURN [n IN nodes(q) | n.name]") == [(["Amsterdam", "Rotterdam", "Den Haag"],)]
    assert rows(t, "MATCH q = shortestPath((a {name: 'Amsterdam'})-[:ROUTE*]->(b)) RETURN b.name, length(q) ORDER BY b.name") == [("Den Haag", 2), ("Eindhoven", 2), ("Rotterdam", 1), ("Utrecht", 1)]
    assert rows(p, "MATCH q = allShortestPaths((a {name: 'app'})-[:DEPENDS_ON*]->(b {name: 'util'})) RETURN [n IN nodes(q) | n.name]") == [(["app", "web", "util"],)]
    assert rows(p, "MATCH (a {name: 'app'})-[:DEPENDS_ON*]->(b) RETURN DISTINCT b.name ORDER BY b.name") == [("auth",), ("crypto",), ("log",), ("util",), ("web",)]
    assert rows(p, "MATCH (a:Package) WHERE NOT EXISTS { (a)-[:DEPENDS_ON]->() } RETURN a.name ORDER BY a.name") == [("log",), ("util",)]
    total = rows(t, "MATCH q = (a {name: 'Amsterdam'})-[:ROUTE]->()-[:ROUTE]->(b {name: 'Den Haag'}) RETURN reduce(d = 0, r IN relationships(q) | d + r.distance)")
    assert total == [(85,)]


def test_aggregation(o, spark):
    assert rows(o, "MATCH (p:Person) RETURN p.dept, count(*), sum(p.age), avg(p.age), min(p.age), max(p.name) ORDER BY p.dept") == [("Engineering", 4, 139, 34.75, 26, "Frank"), ("Marketing", 2, 73, 36.5, 31, "Dave")]
    assert rows(o, "MATCH (p:Person) WITH p.dept AS d, count(*) AS c WHERE c > 2 RETURN d, c") == [("Engineering", 4)]
    assert rows(o, "MATCH (p:Person)-[:LIVES_IN]->(c) RETURN count(DISTINCT c)") == [(3,)]
    assert rows(o, "MATCH (p:Person) WITH p ORDER BY p.age DESC RETURN collect(p.name)[0..2]") == [(["Frank", "Carol"],)]
    assert rows(o, "MATCH (p:Person {name: 'Zoe'}) RETURN count(*), sum(p.age), collect(p.name), stdev(p.age), max(p.age)") == [(0, None, [], 0.0, None)]
    v = build(spark, [(["V"], {"x": x, "g": g}) for x, g in ((1, "a"), (None, "a"), (3, "a"), (None, "b"), (2, None))], [])
    assert rows(v, "MATCH (n:V) RETURN n.g, count(*), count(n.x), size(collect(n.x)) ORDER BY n.g") == [("a", 3, 2, 3), ("b", 1, 0, 1), (None, 1, 1, 1)]
    assert rows(v, "MATCH (n:V) RETURN percentileDisc(n.x, 0.5), percentileCont(n.x, 0.25), stdev(n.x), stdevp(n.x)") == [(2.0, 1.5, 1.0, pytest.approx(0.816496580927726))]
    assert rows(v, "MATCH (n:V) RETURN n.x ORDER BY n.x") == [(1,), (2,), (3,), (None,), (None,)]
    assert rows(v, "MATCH (n:V) RETURN n.x ORDER BY n.x DESC") == [(None,), (None,), (3,), (2,), (1,)]
    assert rows(v, "MATCH (n:V) RETURN DISTINCT n.g ORDER BY n.g") == [("a",), ("b",), (None,)]
    with pytest.raises(QueryError):
        v.execute("MATCH (n:V) RETURN sum(count(n))")


def test_with_unwind_union(s):
    assert rows(s, "UNWIND [1, null, 2] AS x RETURN x") == [(1,), (None,), (2,)]
    assert rows(s, "UNWIND null AS x RETURN x") == [] and rows(s, "UNWIND [] AS x RETURN x") == [] and rows(s, "UNWIND 5 AS x RETURN x") == [(5,)]
    assert rows(s, "MATCH (n) WITH n.name AS a, n.age AS b WHERE b < 31 WITH a ORDER BY a LIMIT 1 RETURN a") == [("Alice",)]
    assert sorted(rows(s, "MATCH (n {name: 'Bob'}) RETURN n.age AS v UNION ALL UNWIND [25, 1] AS v RETURN v")) == [(1,), (25,), (25,)]
    assert sorted(rows(s, "MATCH (n {name: 'Bob'}) RETURN n.age AS v UNION UNWIND [25, 1] AS v RETURN v")) == [(1,), (25,)]
    with pytest.raises(QueryError):
        s.execute("RETURN 1 AS a UNION RETURN 1 AS b")
    with pytest.raises(QueryError):
        s.execute("RETURN 1 AS a, 2 AS a")
    assert rows(s, "MATCH (n) WITH collect(n) AS ns UNWIND ns AS m WITH m WHERE m.age = 25 RETURN m.name, id(m), labels(m)") == [("Bob", 1, ["User"])]


def test_subquery_and_comprehension(o):
    got = rows(o, "MATCH (m:Person) CALL { MATCH (m)-[:MANAGES]->(q) RETURN count(q) AS n, collect(q.age) AS ages } RETURN m.name, n, size(ages) ORDER BY n DESC, m.name LIMIT 3")
    assert got == [("Frank", 3, 3), ("Carol", 1, 1), ("Alice", 0, 0)]
    assert rows(o, "MATCH (c:City) RETURN c.name, list.sort([(c)<-[:LIVES_IN]-(p) WHERE p.age > 30 | p.name]) ORDER BY c.name") == [("Berlin", ["Dave"]), ("London", ["Alice", "Carol"]), ("Tokyo", ["Frank"])]
    assert rows(o, "MATCH (c:City) CALL { MATCH (c)<-[:LIVES_IN]-(p) RETURN p.name AS old ORDER BY p.age DESC LIMIT 1 } RETURN c.name, old ORDER BY c.name") == [("Berlin", "Dave"), ("London", "Carol"), ("Tokyo", "Frank")]


@pytest.mark.parametrize(
    "text,want",
    [
        ("1 + 2 * 3 ^ 2", 19), ("7 / 2", 3.5), ("-7 % 3", -1), ("5 % 0", None), ("1 / 0", None), ("2.0 % 2", None), ("'a' + 1", None), ("1 + null", None),
        ("[1] + [2, 3]", [1, 2, 3]), ("null = null", None), ("1 = 1.0", True), ("1 = 'a'", False), ("1 <> 'a'", True), ("1 < 'a'", False), ("null IN [1]", None),
        ("2 IN [1, null]", False), ("1 IN []", False), ("'abc' =~ 'b'", False), ("'abc' =~ '('", None), ("true AND null", None), ("false AND null", False), ("true XOR true", False),
        ("NOT null", None), ("CASE null WHEN null THEN 1 ELSE 2 END", 1), ("CASE WHEN null THEN 1 ELSE 2 END", 2), ("[1, 2, 3][-1]", 3), ("[1, 2][5]", None), ("[1, 2, 3][1..]", [2, 3]),
        ("[1, 2, 3][-2..2]", [1, 2]), ("{a: {b: 2}}.a.b", 2), ("{a: 1}['a']", 1), ("{a: 1}.z", None), ("any(x IN [1, null] WHERE x > 5)", False), ("all(x IN [] WHERE x > 5)", True),
        ("single(x IN [1, 2, 2] WHERE x = 2)", False), ("none(x IN null WHERE x)", None), ("reduce(a = 1, x IN [2, 3] | a * x)", 6), ("[x IN [1, 2, 3] WHERE x % 2 = 1 | x * x]", [1, 9]),
        ("0x1F + 010", 39), ("1.5e2", 150.0), ("'it\\'s' + \"\\n\"", "it's\n"), ("toInteger('42')", 42), ("tointegerornull('x')", None), ("'12'::FLOAT", 12.0), ("toString(1.0)", "1"),
        ("TRY_CAST('2024-99-99' AS DATE) IS NULL", True), ("size('héé')", 3), ("coalesce(null, 2)", 2), ("range(3, 1, -1)", [3, 2, 1]), ("range(1, 3, -1)", []), ("head([])", None),
        ("list.sum([])", 0), ("list.stdev([1])", None), ("list.avg([])", None), ("list.product([2, null])", 2), ("list.rest([])", None), ("list.scan([1, 2, 3], 'max')", [1, 2, 3]),
        ("list.windows([1, 2, 3, 4], 2, 2)", [[1, 2], [3, 4]]), ("list.windows([1], 2)", []), ("list.split_by([1, 0, 2], 0)", [[1], [2]]), ("list.combinations([1, 2, 3], 4)", []),
        ("list.insert([1, 2], 9, 3)", [1, 2, 3]), ("list.remove([1, 2, 3], -1)", [1, 2]), ("list.chunks([], 2)", []), ("list.at([1, 2], -3)", None), ("list.flatten([[1], [2]])", [1, 2]),
        ("string.pad('x', 4, '-', 'both')", "-x--"), ("string.find('abc', 'z')", -1), ("string.slice('éclair', 1, 3)", "cla"), ("string.slice('hello', 100, 5)", ""), ("string.trim('\\t a \\n')", "a"),
        ("string.split('', ',')", [""]), ("string.char_at('abc', -1)", "c"), ("string.char_at('abc', 9)", None), ("string.normalize('e\u0301')", "é"), ("string.swap_case('aBc')", "AbC"), ("string.repeat('a', -1)", None),
        ("string.regex_groups('a1b2', '([a-z])([0-9])')", [["a1", "a", "1"], ["b2", "b", "2"]]), ("string.count('banana', 'na')", 2), ("string.upper(5)", None), ("string.upper(null)", None),
        ("text.distance('ca', 'ac', 'damerau')", 1), ("text.distance('ab', 'abc', 'hamming')", None), ("text.phonetic('Ashcraft', 'soundex')", "A226"), ("text.similarity('', '', 'levenshtein')", 1.0),
        ("number.to_base(-10, 2)", "-1010"), ("number.from_base('12', 2)", None), ("number.to_roman(0)", None), ("number.is_even(4.0)", None), ("math.sqrt(-1)", None), ("math.max(3, null)", None),
        ("math.round(-2.5)", -3), ("math.round(2.5, 0, 'half_even')", 2.0), ("math.gcd(0, 5)", 5), ("math.lcm(4, 6)", 12), ("math.log_base(8, 2)", 3.0), ("math.asin(2)", None), ("math.clamp(5, 0, 3)", 3),
        ("date('2024-01-31') + duration('P1M') = date('2024-02-29')", True), ("date('2024-03-01').ordinal_day", 61), ("duration('P1Y2M').months", 14), ("temporal.convert(90, 'minutes', 'hours')", 1),
        ("duration('P1D') < duration('PT25H')", True), ("datetime('2024-01-01T10:00:00Z') > datetime('2024-01-01T11:00:00+02:00')", True), ("point({x: 1, y: 2}).srid", 7203), ("time('10:00')", None),
        ("geo.distance(point({longitude: 0, latitude: 0}), point({longitude: 0, latitude: 1})) > 111000", True), ("vector.similarity([1.0, 0.0], [0.0, 0.0])", None), ("vector.dimension([1, 2, 3])", 3),
        ("type.of(1.5)", "FLOAT"), ("type.of(null)", "NULL"), ("type.of({a: 1})", "MAP"), ("type.is(1, STRING)", False), ("cast.can('x', INTEGER)", False), ("bytes.size('é')", 2), ("bytes.decompress(bytes.from_string('x'))", None),
        ("crypto.blake3('')", "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"), ("uuid.is_valid('x')", False), ("json.decode('{bad')", None), ("map.has_key({a: null}, 'a')", True),
        ("size(map.keys(map.merge({a: 1}, {a: 2}, 'error')))", None), ("map.get({a: 1}, 'b', 7)", 7), ("value.reverse([1, 2])", [2, 1]), ("string.join([1, null, 'x'], '-') IS NOT NULL", True),
    ],
)
def test_expressions(s, text, want):
    got = rows(s, f"RETURN {text} AS v")[0][0]
    assert got == want and (type(got) is type(want) or isinstance(want, float)), got


def test_long_hashes():
    from quiver.functions.others import blake3

    assert len({blake3(bytes(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 3072, 5000)}) == 11
    assert blake3(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


def test_errors(s, spark):
    for text in ("MATCH (n) RETURN", "MATCH n RETURN n", "RETURN 1 +", "MATCH (n) WHERE RETURN n", "FOO", "MATCH (n)", "RETURN 'open", "MATCH (a)-[>(b) RETURN a", ""):
        with pytest.raises(QuerySyntaxError):
            parse(text)
    for text in ("MATCH (n:Nope) RETURN n", "MATCH ()-[:NOPE]->() RETURN 1 AS x", "MATCH (n) RETURN n.nope"):
        with pytest.raises(UnknownName):
            s.execute(text)
    for text in ("RETURN x", "RETURN nofun(1)", "RETURN string.upper()", "CALL no.such.proc()"):
        with pytest.raises(QueryError):
            s.execute(text)
    with pytest.raises(Exception, match="cannot cast"):
        s.execute("RETURN cast.to('nope', INTEGER)").collect()
    from quiver.engine import Engine

    assert rows(Engine(PropertyGraph.empty(spark)), "MATCH (n:Any) RETURN count(n), sum(n.x)") == [(0, None)]


def test_plans_are_pruned_and_pushed_down(spark, data):
    from quiver.engine import Engine
    from quiver.queries.graphs import trade_graph

    e = Engine(trade_graph(spark, data))
    plan = e.explain("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100 RETURN c.c_mktsegment AS s, count(*) AS n")
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan and "GreaterThan(o_totalprice,100.0)" in plan
    scans = lambda text: text.count("Scan parquet") // 2  # in the tree and in the details
    assert scans(plan) == 2  # the foreign key costs no join of its own
    assert scans(e.explain("MATCH ()-[l:CONTAINS]->() RETURN count(*) AS n")) == 1


def test_more_projections(o, spark):
    assert rows(o, "MATCH (p:Person) RETURN p.dept AS d, count(*) AS c ORDER BY count(*) DESC, d") == [("Engineering", 4), ("Marketing", 2)]
    assert rows(o, "MATCH (p:Person) WITH DISTINCT p.dept AS d RETURN d ORDER BY d") == [("Engineering",), ("Marketing",)]
    assert rows(o, "MATCH (p:Person)-[:LIVES_IN]->(c) WITH c, count(p) AS n ORDER BY n DESC, c.name LIMIT 1 RETURN c.name, n") == [("London", 3)]
    assert rows(o, "MATCH (p:Person) RETURN p{.name, old: p.age > 40} AS m ORDER BY m.name LIMIT 1")[0][0].asDict() == {"name": "Alice", "old": False}
    assert rows(o, "MATCH (p:Person) WHERE p.name IN $names RETURN p.name ORDER BY p.name", names=["Bob", "Eve", "Zoe"]) == [("Bob",), ("Eve",)]
    assert rows(o, "MATCH (p:Person) RETURN avg(p.age) > 30 AS a, count(*) % 4 AS b, toString(max(p.age)) + '!' AS c") == [(True, 2, "50!")]
    assert rows(o, "MATCH (a:Person)-[:MANAGES]->(b) WITH a, collect(DISTINCT b.dept) AS ds RETURN a.name, ds ORDER BY a.name") == [("Carol", ["Marketing"]), ("Frank", ["Engineering"])]
    assert rows(o, "MATCH (p:Person {name: 'Alice'})-[:WORKS_AT]->(c) WITH * RETURN p.name, c.name") == [("Alice", "Acme")]
    assert rows(o, "MATCH (n:Manager) RETURN n")[0][0].name == "Frank"
    assert rows(o, "UNWIND [[1, 2], [3]] AS l UNWIND l AS x RETURN sum(x)") == [(6,)]
    assert rows(o, "RETURN [x IN [1, 2] | [y IN [10, 20] WHERE y > x * 10 | x + y]] AS v") == [([[21], []],)]
    assert rows(o, "UNWIND range(1, 4) AS x WITH x ORDER BY x DESC WITH collect(x) AS l RETURN l, size(l)") == [([4, 3, 2, 1], 4)]
    t = build(spark, [(["D"], {"tags": ["a", "b"], "k": 1}), (["D"], {"tags": None, "k": 2})], [])
    assert rows(t, "MATCH (d:D) RETURN d.tags[0], size(d.tags), 'b' IN d.tags, [x IN d.tags | x + '!'] ORDER BY d.k") == [("a", 2, True, ["a!", "b!"]), (None, None, None, None)]
    assert sorted(rows(t, "MATCH (d:D) CALL { MATCH (d) RETURN d.k AS v UNION ALL MATCH (d) RETURN d.k * 10 AS v } RETURN v")) == [(1,), (2,), (10,), (20,)]


def test_patterns_meet(o):
    assert rows(o, "MATCH (a:Person)-[:LIVES_IN]->(c:City)<-[:LIVES_IN]-(b:Person) WHERE a.name < b.name RETURN a.name, b.name, c.name ORDER BY a.name, b.name") == [
        ("Alice", "Carol", "London"), ("Alice", "Eve", "London"), ("Bob", "Dave", "Berlin"), ("Carol", "Eve", "London"),
    ]
    assert rows(o, "MATCH (f:Manager)-[:MANAGES]->(p)-[a:ASSIGNED_TO]->(x) WITH x, collect(a.role) AS roles RETURN x.name, list.sort(roles)") == [("Alpha", ["dev", "dev", "lead"])]
    assert rows(o, "MATCH (p:Person) OPTIONAL MATCH (p)-[:MANAGES]->(q) WITH p, count(q) AS n WHERE n = 0 RETURN count(p)") == [(4,)]
    assert rows(o, "MATCH (p:Person)-[r:WORKS_AT {since: 2012}]->() RETURN p.name, edge.properties(r).since, edge.keys(r)") == [("Frank", 2012, ["since"])]
    assert rows(o, "MATCH (a:Person {name: 'Frank'})-[:MANAGES*1..1]->(b)-[:LIVES_IN]->(c) RETURN b.name, c.name ORDER BY b.name") == [("Alice", "London"), ("Bob", "Berlin"), ("Eve", "London")]
    assert rows(o, "MATCH (a:Person {name: 'Frank'}) MATCH p = (a)-[:MANAGES]->()-[:ASSIGNED_TO*]->(x) RETURN DISTINCT x.name, length(p)") == [("Alpha", 2)]
    assert rows(o, "MATCH (a)-[r:MANAGES]->(b) MATCH (x)-[r]->(y) RETURN count(*)") == [(4,)]
    assert rows(o, "MATCH (x:Project), (c:Company) RETURN count(*)") == [(2,)]
