"""Indexes, constraints, SHOW commands and procedures."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quiver.functions.others import similarity
from quiver.graph.property_graph import ConstraintDef, IndexDef, PropertyGraph
from quiver.lang import ast as A
from quiver.plans.compiler import Compiler, where
from quiver.plans.expressions import QueryError, Scope, ValB, node_struct
from quiver.plans.patterns import Hop, scan_edges, scan_nodes
from quiver.plans.values import kind, type_name
from quiver.workdir import scratch_path


def constant(e, params: dict):
    """The Python value of a literal expression."""
    if isinstance(e, A.Lit):
        return e.value
    if isinstance(e, A.Param):
        return params.get(e.name)
    if isinstance(e, A.ListLit):
        return [constant(i, params) for i in e.items]
    if isinstance(e, A.MapLit):
        return {k: constant(v, params) for k, v in e.items}
    raise QueryError("a constant is expected")


def run_command(graph: PropertyGraph, q, params: dict) -> tuple[DataFrame, PropertyGraph]:
    if isinstance(q, A.Procedure):
        return procedure(graph, q, params), graph
    what, info = q.what, q.info
    done = graph.spark.createDataFrame([], "name string")
    if what == "create_index":
        name = info["name"] or "_".join(["index", *info["names"], *info["properties"]]).lower()
        if any(i.name == name for i in graph.indexes):
            if info["if_not_exists"]:
                return done, graph
            raise QueryError(f"index {name} exists")
        options = constant(info["options"], params) if info["options"] is not None else {}
        if info["kind"] == "VECTOR":
            _vector_options(options)
        index = IndexDef(name, info["kind"], info["entity"], tuple(info["names"]), tuple(info["properties"]), options)
        graph = replace(graph, indexes=(*graph.indexes, index))
        if info["kind"] == "FULLTEXT":
            build_fulltext(graph, index)
        return done, graph
    if what == "create_constraint":
        c = ConstraintDef(info["name"], info["kind"], info["entity"], tuple(info["names"]), tuple(info["properties"]), tuple(info.get("types", ())))
        if any(x.name == c.name for x in graph.constraints):
            if info["if_not_exists"]:
                return done, graph
            raise QueryError(f"constraint {c.name} exists")
        bad = check_constraint(graph, c)
        if bad is not None and not bad.isEmpty():
            raise QueryError(f"the graph doesn't meet constraint {c.name}")
        return done, replace(graph, constraints=(*graph.constraints, c))
    if what in ("drop_index", "drop_constraint"):
        field = "indexes" if what == "drop_index" else "constraints"
        left = tuple(x for x in getattr(graph, field) if x.name != info["name"])
        if len(left) == len(getattr(graph, field)) and not info["if_exists"]:
            raise QueryError(f"{info['name']} doesn't exist")
        return done, replace(graph, **{field: left})
    return show(graph, what, info, params), graph


def _vector_options(options: dict) -> tuple[int | None, str]:
    config = options.get("indexConfig", options)
    dim = next((v for k, v in config.items() if k.endswith("dimensions") or k == "dimension"), None)
    how = next((v for k, v in config.items() if k.endswith("similarity_function") or k == "similarity"), "cosine")
    if how.lower() not in ("cosine", "euclidean", "dot", "manhattan"):
        raise QueryError(f"unknown similarity function {how}")
    return dim, how.lower()


def show(graph: PropertyGraph, what: str, info: dict, params: dict) -> DataFrame:
    if what == "show_index":
        rows = [(i.name, i.kind, i.entity, list(i.names), list(i.properties), "ONLINE") for i in graph.indexes if info["kind"] in (None, i.kind)]
        df = graph.spark.createDataFrame(rows, "name string, type string, entityType string, labelsOrTypes array<string>, properties array<string>, state string")
    else:
        rows = [(c.name, c.kind, c.entity, list(c.names), list(c.properties), " | ".join(c.types) or None) for c in graph.constraints]
        df = graph.spark.createDataFrame(rows, "name string, type string, entityType string, labelsOrTypes array<string>, properties array<string>, propertyType string")
    scope = Scope(graph.spark, PropertyGraph(graph.spark), params, df, {c: ValB(c) for c in df.columns})
    compiler = Compiler(graph.spark, PropertyGraph(graph.spark), params)
    if info["yields"] and info["yields"] != ("*",):
        scope.vars = {alias: ValB(name) for name, alias in info["yields"]}
    where(scope, info["where"])
    order, skip, limit = info.get("slice", ((), None, None))
    body = A.Projection(tuple(A.Item(A.Var(v), v) for v in scope.vars), False, False, order, skip, limit)
    out = compiler.project(scope, body)
    if info["body"] is not None:
        out = compiler.project(out, info["body"])
    return compiler.result(out, body)


# -- constraints ----------------------------------------------------------
def _tables(graph: PropertyGraph, c) -> list[tuple[DataFrame, str, list[str]]]:
    """(rows, id, properties) of the nodes or relationships that a constraint or index is about."""
    out = []
    if c.entity == "NODE":
        for t in graph.nodes:
            df = t.df
            if t.label_column and not set(c.names) & set(t.labels):
                df = df.filter(reduce(lambda a, b: a | b, [F.array_contains(t.label_column, x) for x in c.names]))
            elif not set(c.names) & set(t.labels):
                continue
            out.append((df, f"`{t.id}`", t.properties))
    else:
        out = [(e.df, e.id, e.properties) for e in graph.edges if e.type in c.names]
    return out


def check_constraint(graph: PropertyGraph, c: ConstraintDef) -> DataFrame | None:
    """Rows that break the constraint."""
    bad = []
    for df, _, own in _tables(graph, c):
        have = [p for p in c.properties if p in own]
        if c.kind in ("NOT_NULL", "KEY") and len(have) < len(c.properties):
            bad.append(df.select(F.lit("missing").alias("problem")))
            continue
        if c.kind in ("NOT_NULL", "KEY"):
            bad.append(df.filter(reduce(lambda a, b: a | b, [F.col(f"`{p}`").isNull() for p in have])).select(F.lit("null").alias("problem")))
        if c.kind in ("UNIQUE", "KEY") and len(have) == len(c.properties):
            full = df.filter(reduce(lambda a, b: a & b, [F.col(f"`{p}`").isNotNull() for p in have]))
            bad.append(full.groupBy(*[F.col(f"`{p}`") for p in have]).count().filter("count > 1").select(F.lit("repeated").alias("problem")))
        if c.kind == "TYPE" and have:
            t = df.schema[have[0]].dataType
            fits = any(_fits(x, t) for x in c.types)
            sizes = [_dimension(x) for x in c.types if _fits(x, t)]
            if not fits and kind(t) != "null":
                bad.append(df.filter(F.col(f"`{have[0]}`").isNotNull()).select(F.lit("type").alias("problem")))
            elif sizes and None not in sizes:  # vectors only: of one of the dimensions, and of numbers throughout
                v = F.col(f"`{have[0]}`")
                bad.append(df.filter(v.isNotNull() & (~F.size(v).isin(sizes) | F.exists(v, lambda x: x.isNull()))).select(F.lit("dimension").alias("problem")))
    return reduce(lambda a, b: a.unionByName(b), bad).limit(1) if bad else None


def _dimension(wanted: str) -> int | None:
    """The number of coordinates that a vector type asks for, None for any other type."""
    found = re.match(r"VECTOR\b.*\((\d+)\)", wanted)
    return int(found[1]) if found else None


def _fits(wanted: str, t) -> bool:
    actual = type_name(t)
    wanted = wanted.replace(" NOT NULL", "").replace("LOCAL DATETIME", "LOCAL_DATETIME").replace("ZONED DATETIME", "DATETIME")
    if wanted == "ANY" or wanted == actual:
        return True
    if wanted.startswith("LIST<") and actual.startswith("LIST<"):
        return wanted[5:-1] == actual[5:-1]
    return wanted.startswith("VECTOR") and actual in ("LIST<FLOAT>", "LIST<INTEGER>")


# -- procedures -----------------------------------------------------------
def procedure(graph: PropertyGraph, q: A.Procedure, params: dict) -> DataFrame:
    name, args = q.name.lower(), [constant(a, params) for a in q.args]
    known = {
        "db.index.vector.querynodes": lambda: vector_query(graph, "NODE", *args), "db.index.vector.queryrelationships": lambda: vector_query(graph, "RELATIONSHIP", *args),
        "db.index.fulltext.querynodes": lambda: fulltext_query(graph, "NODE", *args), "db.index.fulltext.queryrelationships": lambda: fulltext_query(graph, "RELATIONSHIP", *args),
    }
    if name not in known:
        raise QueryError(f"unknown procedure {q.name}")
    out = known[name]()
    if q.yields and q.yields != ("*",):
        unknown = [n for n, _ in q.yields if n not in out.columns]
        if unknown:
            raise QueryError(f"{q.name} doesn't yield {unknown[0]}")
        out = out.select(*[F.col(n).alias(a) for n, a in q.yields])
    return out


def _index(graph: PropertyGraph, name: str, kind_: str, entity: str) -> IndexDef:
    found = next((i for i in graph.indexes if i.name == name), None)
    if found is None or found.kind != kind_ or found.entity != entity:
        raise QueryError(f"no {kind_} index {name} on {entity}")
    return found


def _entities(graph: PropertyGraph, index: IndexDef) -> tuple[DataFrame, dict[str, str], str, str]:
    """(rows, property -> column, id column, struct SQL) of what an index covers."""
    scope = Scope(graph.spark, graph, {})
    if index.entity == "NODE":
        tables = [t for t in graph.nodes if t.label_column or set(index.names) & set(t.labels)]
        df, b = scan_nodes(scope, tables, "node")
        if any(t.label_column for t in tables):
            df = df.filter(" OR ".join(f"array_contains({b.labels}, '{x}')" for x in index.names))
        return df, b.props, b.id, node_struct(b)
    edges = [e for e in graph.edges if e.type in index.names]
    df, r, *_ = scan_edges(scope, Hop([(e, False) for e in edges]), "rel", False)
    scope.df, scope.vars = df, {"r": r}
    return df, r.props, r.id, scope.whole("r").sql


def vector_query(graph: PropertyGraph, entity: str, name: str, k: int, vector: list, options: dict | None = None) -> DataFrame:
    """The k nearest entities of an index: exact scores in one scan, and a top-k that no task holds whole."""
    index = _index(graph, name, "VECTOR", entity)
    dim, how = _vector_options(dict(index.options))
    if dim is not None and len(vector) != dim:
        raise QueryError(f"index {name} has dimension {dim}, not {len(vector)}")
    df, props, key, struct = _entities(graph, index)
    column = f"`{props[index.properties[0]]}`"
    if options and options.get("restrictTo") is not None:
        df = df.filter(F.col(f"`{key}`").isin([int(i) for i in options["restrictTo"]]))
    q = "CAST(array(" + ", ".join(f"{float(v)!r}D" for v in vector) + ") AS ARRAY<DOUBLE>)"
    x = f"CAST({column} AS ARRAY<DOUBLE>)"
    df = df.filter(f"size({column}) = {len(vector)}").selectExpr(f"{struct} AS node", f"`{key}` AS _key", f"{similarity(x, q, how)} AS score").filter("score IS NOT NULL")
    top = df.orderBy(F.desc("score"), "_key").limit(max(0, int(k))).drop("_key")
    return top if entity == "NODE" else top.withColumnRenamed("node", "relationship")


def _covered(graph: PropertyGraph, index: IndexDef) -> list[DataFrame]:
    """The tables that an index is about, as they are."""
    return [t.df for t in graph.nodes if t.label_column or set(index.names) & set(t.labels)] if index.entity == "NODE" else [e.df for e in graph.edges if e.type in index.names]


def _text(index: IndexDef, props: dict[str, str]):
    return F.lower(F.expr("concat_ws(' ', " + ", ".join(f"`{props[p]}`" for p in index.properties if p in props) + ")"))


def build_fulltext(graph: PropertyGraph, index: IndexDef) -> None:
    """Write an inverted index: how often each word occurs in each entity, in the order of the words.

    Equal words lie together, so a query reads the few row groups that hold its
    words; a word that many entities have goes over as many files as it needs.
    """
    tables = _covered(graph, index)
    if not tables:
        return
    df, props, key, _ = _entities(graph, index)
    words = df.select(F.col(f"`{key}`").alias("_key"), F.explode(F.split(_text(index, props), r"[^\p{L}\p{N}]+")).alias("word")).filter("word <> ''")
    counted = words.groupBy("word", "_key").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(graph.spark, f"fulltext-{index.name}")
    counted.repartitionByRange("word", "_key").sortWithinPartitions("word", "_key").write.option("parquet.block.size", 8 << 20).parquet(path)
    graph.built[index.name] = (tables, path)


def fulltext_query(graph: PropertyGraph, entity: str, name: str, query: str) -> DataFrame:
    """Entities whose indexed texts have all the words; score: how often they occur.

    With an inverted index of the present tables only its rows for these words
    are read; without one the words are counted within each text, and nothing
    is shuffled before the sort.
    """
    index = _index(graph, name, "FULLTEXT", entity)
    df, props, key, struct = _entities(graph, index)
    called = "node" if entity == "NODE" else "relationship"
    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    if not terms:
        return df.limit(0).selectExpr(f"{struct} AS {called}", "0.0D AS score")
    tables, path = graph.built.get(name, ((), None))
    now = _covered(graph, index)
    if len(now) == 1 and len(tables) == 1 and tables[0] is now[0]:  # keys of several tables may be equal
        hits = graph.spark.read.parquet(path).filter(F.col("word").isin(terms)).groupBy(F.col("_key").alias("_hit"))
        hits = hits.agg(F.count(F.lit(1)).alias("_words"), F.sum("n").cast("double").alias("score")).filter(F.col("_words") == len(terms))
        scored = df.join(hits, F.col(f"`{key}`") == F.col("_hit")).select(F.expr(struct).alias(called), F.col(f"`{key}`").alias("_key"), "score")
        return scored.orderBy(F.desc("score"), "_key").drop("_key")
    # a cheap test for each word first; only rows that have all of them are searched word by word
    df = df.withColumn("_text", _text(index, props))
    df = df.filter(reduce(lambda a, b: a & b, [F.contains("_text", F.lit(t)) for t in terms]))
    edge = r"[\p{L}\p{N}]"
    counts = [F.regexp_count("_text", F.lit(f"(?<!{edge}){t}(?!{edge})")) for t in terms]
    df = df.filter(reduce(lambda a, b: a & b, [c > 0 for c in counts]))
    scored = df.select(F.expr(struct).alias(called), F.col(f"`{key}`").alias("_key"), reduce(lambda a, b: a + b, counts).cast("double").alias("score"))
    return scored.orderBy(F.desc("score"), "_key").drop("_key")
