"""Small graphs that the language tests run on."""

from quiver.engine import Engine
from quiver.graph.property_graph import PropertyGraph


def build(spark, people, links):
    """people: (labels, properties); links: (type, from, to, properties) by position."""
    nodes = [{"id": i, "labels": labels, **props} for i, (labels, props) in enumerate(people)]
    edges = [{"id": i, "type": t, "src": a, "dst": b, **p} for i, (t, a, b, p) in enumerate(links)]
    return Engine(PropertyGraph.of_rows(spark, nodes, edges))


def social(spark):
    people = [(["User"], {"name": n, "age": a}) for n, a in (("Alice", 30), ("Bob", 25), ("Carol", 35))]
    return build(spark, people, [("FOLLOWS", 0, 1, {"since": 2020}), ("FOLLOWS", 1, 2, {"since": 2021}), ("KNOWS", 0, 2, {})])


def org(spark):
    staff = [("Alice", 35, "Engineering"), ("Bob", 28, "Engineering"), ("Carol", 42, "Marketing"), ("Dave", 31, "Marketing"), ("Eve", 26, "Engineering"), ("Frank", 50, "Engineering")]
    nodes = [(["Person"] + (["Manager"] if n == "Frank" else []), {"name": n, "age": a, "dept": d}) for n, a, d in staff]
    nodes += [(["Company"], {"name": "Acme", "founded": 1990}), (["Project"], {"name": "Alpha", "budget": 100000}), (["Project"], {"name": "Beta", "budget": 50000})]
    nodes += [(["City"], {"name": c}) for c in ("London", "Berlin", "Tokyo")]
    links = [("WORKS_AT", i, 6, {"since": y}) for i, y in enumerate((2018, 2020, 2015, 2021, 2022, 2012))]
    links += [("MANAGES", 5, i, {}) for i in (0, 1, 4)] + [("MANAGES", 2, 3, {})]
    links += [("ASSIGNED_TO", i, p, {"role": r}) for i, p, r in ((0, 7, "lead"), (1, 7, "dev"), (2, 8, "lead"), (4, 7, "dev"))]
    links += [("LIVES_IN", i, c, {}) for i, c in enumerate((9, 10, 9, 10, 9, 11))]
    return build(spark, nodes, links)


def line(spark, n, label="Chain", type_="NEXT", closed=False):
    return build(spark, [([label], {"idx": i}) for i in range(n)], [(type_, i, (i + 1) % n, {}) for i in range(n if closed else n - 1)])


def packages(spark):
    names = ["app", "web", "auth", "log", "util", "crypto"]
    at = names.index
    links = [("app", "web"), ("app", "auth"), ("app", "log"), ("web", "log"), ("web", "util"), ("auth", "crypto"), ("auth", "log"), ("crypto", "util")]
    return build(spark, [(["Package"], {"name": n}) for n in names], [("DEPENDS_ON", at(a), at(b), {}) for a, b in links])


def transport(spark):
    names = ["Amsterdam", "Utrecht", "Rotterdam", "Den Haag", "Eindhoven"]
    roads = [(0, 1, 40), (0, 2, 60), (1, 2, 55), (2, 3, 25), (1, 4, 100)]
    return build(spark, [(["Station"], {"name": n, "zone": i % 3}) for i, n in enumerate(names)], [("ROUTE", x, y, {"distance": d}) for a, b, d in roads for x, y in ((a, b), (b, a))])
