"""Queries that change a graph: each gives a new version.

A query's rows are computed once and written down; new ids come from the
greatest id so far, which the graph remembers, and the rows' own numbers, so
nothing needs one task to see all rows.  Only what a change touches is written:
added rows go beside the tables, replaced ones beside an anti-join by id, and
deletes are an anti-join.  After LAYERS changes a table is written whole.  As
long as tables keep their own labels, a query reads only those it needs.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quiver.graph.property_graph import DST, ID, LABELS, SRC, EdgeTable, NodeTable, PropertyGraph
from quiver.lang import ast as A
from quiver.plans.compiler import Compiler, unit
from quiver.plans.expressions import NodeB, QueryError, RelB, Scope, ValB
from quiver.plans.patterns import Matcher, scan_nodes, usage
from quiver.plans.values import ident, kind, quoted
from quiver.workdir import materialise, materialise_seen

LAYERS = 12


class ConstraintViolation(ValueError):
    """A change that a constraint of the graph forbids."""


class Writer(Compiler):
    """Runs a query with updating clauses; ``graph`` is the version that it leads to."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph, params: dict | None = None):
        super().__init__(spark, graph.as_generic(), params)
        self.touched: set[str | None] = set()  # relationship types that have changed, None for nodes

    # -- tables -----------------------------------------------------------
    @property
    def nodes(self) -> DataFrame:
        return self.graph.nodes[0].df

    def _with_nodes(self, df: DataFrame, labels: set[str] = frozenset()) -> None:
        """``df``, a change on top of the present nodes, in their place."""
        layers = self.graph.nodes[0].layers + 1
        if layers > LAYERS:
            df, layers = materialise(df, "graph-nodes"), 0
        self.touched.add(None)
        self.graph = replace(self.graph, nodes=(NodeTable("nodes", df, ID, (), LABELS, layers),), known_labels=self.graph.known_labels | labels, known=dict(self.graph.known))

    def _with_edges(self, kind_: str, df: DataFrame) -> None:
        old = next((e for e in self.graph.edges if e.type == kind_), None)
        layers = (old.layers if old else 0) + 1
        if layers > LAYERS:
            df, layers = materialise(df, "graph-edges"), 0
        # what holds for the ends before a change holds after it; what is found out later isn't told to earlier versions
        known = dict(self.graph.known)
        if old is None:  # its relationships will all be made between nodes that are there
            known |= {(kind_, "nodes", "nodes", end): True for end in ("src", "dst")}
        self.touched.add(kind_)
        table = EdgeTable(kind_, df, ID, SRC, DST, "nodes", "nodes", layers=layers)
        self.graph = replace(self.graph, edges=tuple(e for e in self.graph.edges if e.type != kind_) + (table,), known=known)

    def _edges(self, kind_: str) -> DataFrame:
        found = [e.df for e in self.graph.edges if e.type == kind_]
        return found[0] if found else self.spark.createDataFrame([], f"{ID} long, {SRC} long, {DST} long")

    def _take_ids(self, edges: bool, upto: int) -> int:
        """The first of ids for rows numbered 0 to ``upto``."""
        if self.graph.next_ids is None:
            tops = [self.nodes.agg(F.max(ID).alias("top"))] + [e.df.agg(F.max(ID).alias("top")) for e in self.graph.edges]
            rows = reduce(lambda a, b: a.unionByName(b), [t.withColumn("edges", F.lit(i > 0)) for i, t in enumerate(tops)]).collect()  # one for each table
            self.graph = replace(self.graph, next_ids=tuple(max([-1, *(r.top for r in rows if r.edges == x and r.top is not None)]) + 1 for x in (False, True)))
        first = self.graph.next_ids[edges]
        new = first + upto + 1
        self.graph = replace(self.graph, next_ids=(self.graph.next_ids[0], new) if edges else (new, self.graph.next_ids[1]))
        return first

    # -- queries ----------------------------------------------------------
    def query(self, q: A.Query, outer: Scope | None = None) -> DataFrame:
        if len(q.parts) > 1:
            raise QueryError("UNION of updating queries")
        clauses, used, scope = q.parts[0], usage(q.parts[0]) | {"*"}, self.scope()
        for c in clauses:
            if isinstance(c, (A.Create, A.Merge, A.Set_, A.Remove, A.Delete, A.Foreach)):
                unit(scope)
                self.update(scope, c)
                scope.graph = self.graph
                continue
            scope.graph = self.graph
            scope.numbered = (None, -1)  # a reading clause may multiply rows
            out = self.clause(scope, c, used)
            if isinstance(out, DataFrame):
                self._validate()
                return out
            scope = out
        self._validate()
        return self.spark.createDataFrame([], T.StructType([]))

    def _validate(self) -> None:
        from quiver.plans.commands import check_constraint

        for c in self.graph.constraints:
            if not ({None} if c.entity == "NODE" else set(c.names)) & self.touched:
                continue
            bad = check_constraint(self.graph, c)
            if bad is not None and not bad.isEmpty():
                raise ConstraintViolation(f"constraint {c.name} doesn't hold")

    def update(self, scope: Scope, c) -> None:
        if isinstance(c, A.Create):
            for p in c.pattern:
                self.create(scope, p)
        elif isinstance(c, A.Merge):
            self.merge(scope, c)
        elif isinstance(c, (A.Set_, A.Remove)):
            self.set(scope, c.items, isinstance(c, A.Remove))
        elif isinstance(c, A.Delete):
            self.delete(scope, c)
        else:
            inner = scope.clone()
            v = inner.compile(c.source)
            column = inner.fresh(c.var)
            if v.kind == "list" and kind(v.type.elementType) != "null":
                inner.df = materialise(inner.df.selectExpr("*", f"explode({v.sql}) AS `{column}`"), "foreach")
                inner.vars[c.var] = ValB(column)
                for u in c.body:
                    self.update(inner, u)
                    inner.graph = self.graph
            scope.graph = self.graph
            self._refresh(scope)

    # -- create -----------------------------------------------------------
    def _numbered(self, scope: Scope) -> tuple[str, int]:
        """Write the rows down with a number for each; gives the number's column and its greatest value.

        Rows that have been written down for this query already are taken as they are.
        """
        row, top = getattr(scope, "numbered", (None, 0))
        if row is None or row not in scope.df.columns:
            row = scope.fresh("row")
            scope.df, seen = materialise_seen(scope.df.withColumn(row, F.monotonically_increasing_id()), "update", top=F.max(row))
            top = -1 if seen["top"] is None else seen["top"]
            scope.numbered = (row, top)
        return row, top

    def _props(self, scope: Scope, props) -> dict[str, str]:
        if props is None:
            return {}
        if isinstance(props, A.Param):
            value = self.params.get(props.name) or {}
            props = A.MapLit(tuple((k, A.ListLit(tuple(map(A.Lit, v))) if isinstance(v, list) else A.Lit(v)) for k, v in value.items()))
        out = {}
        for k, e in props.items:
            v = scope.compile(e)
            if v.kind in ("node", "edge", "path"):
                raise QueryError(f"{k} can't hold a {v.kind}")
            if v.kind != "null":
                out[k] = v.sql
        return out

    def _append(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Union by name; a property that comes with another type takes a common one, if there is one."""
        types = dict(old.dtypes)
        for f in new.schema.fields:
            if f.name in types and types[f.name] != f.dataType.simpleString():
                a, b = kind(old.schema[f.name].dataType), kind(f.dataType)
                if b == "null":
                    new = new.withColumn(f.name, F.lit(None).cast(types[f.name]))
                elif a == b == "number":
                    both = "double"
                    old, new = old.withColumn(f.name, F.col(f"`{f.name}`").cast(both)), new.withColumn(f.name, F.col(f"`{f.name}`").cast(both))
                elif a == "null" or old.filter(F.col(f"`{f.name}`").isNotNull()).isEmpty():
                    old = old.withColumn(f.name, F.lit(None).cast(f.dataType))
                else:
                    raise QueryError(f"property {f.name} is {types[f.name]} and can't become {f.dataType.simpleString()}")
        return old.unionByName(new, allowMissingColumns=True)

    def create(self, scope: Scope, p: A.PathP) -> None:
        row, top = self._numbered(scope)
        ends: list[str] = []
        for n in p.nodes:
            b = scope.vars.get(n.var) if n.var else None
            if b is not None:
                if n.labels or n.props is not None:
                    raise QueryError(f"{n.var} is bound already")
                ends.append(b.id if isinstance(b, NodeB) else self._node_id(scope, n.var))
                continue
            if any(len(g) > 1 for g in n.labels):
                raise QueryError("CREATE needs definite labels")
            labels = [x for g in n.labels for x in g]
            key, first = scope.fresh(n.var or "node"), self._take_ids(False, top)
            scope.df = scope.df.withColumn(key, F.lit(first) + F.col(row))
            props = self._props(scope, n.props)
            new = scope.df.selectExpr(f"`{key}` AS {ID}", f"CAST(array({', '.join(map(quoted, labels))}) AS ARRAY<STRING>) AS {LABELS}", *[f"{s} AS {ident(k)}" for k, s in props.items()])
            self._with_nodes(self._append(self.nodes, materialise(new, "graph-nodes")), set(labels))
            scope.graph = self.graph
            ends.append(key)
            if n.var:
                self._bind_node(scope, n.var, key)
        for i, r in enumerate(p.rels):
            if len(r.types) != 1 or r.length is not None:
                raise QueryError("CREATE needs one definite relationship type")
            if r.direction == "both":
                raise QueryError("CREATE needs a direction")
            key, first = scope.fresh(r.var or "rel"), self._take_ids(True, top)
            scope.df = scope.df.withColumn(key, F.lit(first) + F.col(row))
            props = self._props(scope, r.props)
            a, b = (ends[i], ends[i + 1]) if r.direction == "out" else (ends[i + 1], ends[i])
            new = scope.df.selectExpr(f"`{key}` AS {ID}", f"`{a}` AS {SRC}", f"`{b}` AS {DST}", *[f"{s} AS {ident(k)}" for k, s in props.items()])
            self._with_edges(r.types[0], self._append(self._edges(r.types[0]), materialise(new, "graph-edges")))
            scope.graph = self.graph
            if r.var:
                self._bind_rel(scope, r.var, key, (r.types[0],), quoted(r.types[0]))
        if p.var:
            # read the path back by its keys
            nodes = tuple(replace(n, var=n.var or f"\1n{i}", labels=(), props=None) for i, n in enumerate(p.nodes))
            for n, key in zip(nodes, ends):
                if n.var not in scope.vars:
                    self._bind_node(scope, n.var, key)
            Matcher(scope, {"*"}).match((replace(p, nodes=nodes, rels=tuple(replace(r, props=None) for r in p.rels)),))

    def _node_id(self, scope: Scope, var: str) -> str:
        key = scope.fresh(var)
        scope.df = scope.df.withColumn(key, F.expr(f"{scope.whole(var).sql}._id"))
        return key

    def _bind_node(self, scope: Scope, var: str, key: str) -> None:
        """Columns of a node by its id, read from the present version."""
        df, b = scan_nodes(scope, [self.graph.nodes[0]], var)
        scope.df = scope.df.join(df, scope.df[key] == df[b.id], "left")
        scope.vars[var] = b

    def _bind_rel(self, scope: Scope, var: str, key: str, types: tuple[str, ...], type_sql: str) -> None:
        """Columns of a relationship by its id and type, read from the present version."""
        base, parts = scope.fresh(var), []
        for t in types:
            parts.append(self._edges(t).withColumnsRenamed({ID: base, SRC: f"{base}_src", DST: f"{base}_dst"}).withColumn(f"{base}_type", F.lit(t)))
        read = reduce(lambda x, y: self._append(x, y), parts)
        props = {c: f"{base}_{c}" for c in read.columns if not c.startswith(base)}
        read = read.withColumnsRenamed(props)
        scope.df = scope.df.join(read, F.expr(f"`{key}` = `{base}` AND {type_sql} = `{base}_type`"), "left")
        scope.vars[var] = RelB(base, types, f"`{base}_type`", f"{base}_src", f"{base}_dst", props, ("nodes",), ("nodes",))

    def _refresh(self, scope: Scope) -> None:
        """Node and relationship variables as the present version has them."""
        for v, b in list(scope.vars.items()):
            if isinstance(b, NodeB):
                self._bind_node(scope, v, b.id)
            elif isinstance(b, RelB):
                self._bind_rel(scope, v, b.id, b.types, b.type)

    # -- merge ------------------------------------------------------------
    def merge(self, scope: Scope, c: A.Merge) -> None:
        """Match or create, once for each different set of values; later rows see what earlier ones made."""
        p, row = c.path, self._numbered(scope)[0]
        rels = tuple(replace(r, direction="out") if r.direction == "both" else r for r in p.rels)
        for n in p.nodes:
            if n.props is not None and isinstance(n.props, A.MapLit) and any(isinstance(e, A.Lit) and e.value is None for _, e in n.props.items):
                raise QueryError("MERGE with a null property")
        matched = scope.clone()
        known = all(set(g) <= self.graph.labels() for n in p.nodes for g in n.labels) and all(set(r.types) <= self.graph.types() for r in p.rels) and self._has_properties(p)
        if known:
            Matcher(matched, {"*"}).match((p,))
            hit = materialise(matched.df.select(row).distinct(), "merge")
            missing = scope.df.join(hit, row, "left_anti")
        else:
            hit, missing = self.spark.createDataFrame([], f"`{row}` long"), scope.df
        # rows that would create the same thing create it once
        keys = {}
        for x in (*p.nodes, *p.rels):
            b = scope.vars.get(x.var) if x.var else None
            if b is not None:
                keys |= {c_: f"`{c_}`" for c_ in (b.key() if not isinstance(b, ValB) else [b.column])}
            for k, sql in self._props(scope, x.props).items():
                keys[scope.fresh(k)] = sql
        maker = scope.clone(missing.selectExpr("*", *[f"{s} AS `{k}`" for k, s in keys.items() if not s == f"`{k}`"]))
        unique = maker.df.dropDuplicates(list(keys)) if keys else maker.df.limit(1)
        maker.df, seen = materialise_seen(unique.withColumn(mine := scope.fresh("row"), F.monotonically_increasing_id()), "merge", n=F.count(F.lit(1)), top=F.max(mine))
        if seen["n"]:
            maker.numbered = (mine, seen["top"])
            self.create(maker, replace(p, rels=rels, var=None))
        scope.graph = matched.graph = self.graph
        again = scope.clone()
        again.graph = self.graph
        Matcher(again, {"*"}).match((p,))
        fresh = again.fresh("old")
        again.df, seen = materialise_seen(again.df.join(hit.withColumn(fresh, F.lit(True)), row, "left").drop(row), "merge", n=F.count(F.lit(1)), old=F.count(fresh))
        scope.df, scope.vars = again.df, again.vars
        for items, test, many in ((c.on_create, F.col(fresh).isNull(), seen["n"] - seen["old"]), (c.on_match, F.col(fresh).isNotNull(), seen["old"])):
            if items and many:
                part = scope.clone(scope.df.filter(test))
                self.set(part, items, False)
                scope.graph = self.graph
        if c.on_create or c.on_match:
            self._refresh(scope)

    def _has_properties(self, p: A.PathP) -> bool:
        known = self.graph.property_keys()
        return all(not isinstance(x.props, A.MapLit) or all(k in known for k, _ in x.props.items) for x in (*p.nodes, *p.rels))

    # -- set and remove ---------------------------------------------------
    def set(self, scope: Scope, items, removing: bool) -> None:
        for i in items:
            b = scope.vars.get(i.var)
            if isinstance(b, ValB) and scope.whole(i.var).kind == "node":
                key = self._node_id(scope, i.var)
                self._bind_node(scope, i.var, key)
                b = scope.vars[i.var]
            if not isinstance(b, (NodeB, RelB)):
                raise QueryError(f"{i.var} isn't a node or relationship")
            row = self._numbered(scope)[0]
            if i.kind == "labels":
                self._labels(scope, b, i.labels, removing)
            elif isinstance(b, NodeB):
                self._values(scope, b, i, row)
            else:
                for t in b.types:
                    self._values(scope, b, i, row, t)
            scope.graph = self.graph
            self._refresh(scope)

    def _labels(self, scope: Scope, b, labels, removing: bool) -> None:
        if not isinstance(b, NodeB):
            raise QueryError("a relationship has no labels")
        hit = scope.df.selectExpr(f"`{b.id}` AS _hit").filter("_hit IS NOT NULL").distinct()
        list_ = F.array(*map(F.lit, labels))
        new = F.array_except(LABELS, list_) if removing else F.array_union(LABELS, list_)
        changed = materialise(self.nodes.join(hit, F.col(ID) == F.col("_hit"), "left_semi").withColumn(LABELS, new), "graph-nodes")
        self._with_nodes(self._replaced(self.nodes, changed), set() if removing else set(labels))

    def _replaced(self, old: DataFrame, changed: DataFrame) -> DataFrame:
        """``old`` with the rows of ``changed`` in place of those of equal id."""
        ids = changed.select(F.col(ID).alias("_hit"))
        return old.join(ids, F.col(ID) == F.col("_hit"), "left_anti").unionByName(changed, allowMissingColumns=True)

    def _values(self, scope: Scope, b, i: A.SetItem, row: str, of_type: str | None = None) -> None:
        """New values by id; of several rows for one id the last one's hold."""
        old = self.nodes if of_type is None else self._edges(of_type)
        fixed = {ID, LABELS, SRC, DST}
        if i.kind == "prop":
            if len(i.path) != 1:
                raise QueryError("only direct properties can be set")
            values, clear = {i.path[0]: scope.compile(i.value)}, False
        else:
            v = scope.compile(i.value)
            names = [n for n in v.type.names if not n.startswith("_")] if isinstance(v.type, T.StructType) else []
            if v.kind not in ("map", "node", "edge", "null"):
                raise QueryError(f"{i.var} can only be set to a map")
            values, clear = {n: scope.val(f"{v.sql}.{ident(n)}") for n in names}, i.kind == "replace"
        cols = [f"CAST({x.sql} AS STRING) AS {ident('v_' + k)}" if x.kind == "null" else f"{x.sql} AS {ident('v_' + k)}" for k, x in values.items()]
        rows = scope.df.selectExpr(f"`{b.id}` AS _hit", f"`{row}` AS _row", *cols, *([f"{b.type} AS _of"] if of_type else [])).filter("_hit IS NOT NULL")
        if of_type:
            rows = rows.filter(F.col("_of") == of_type)
        last = rows.groupBy("_hit").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), "_row").alias("_u"))
        out, casts = [], {}
        for k, x in values.items():
            new = F.col(f"_u.`v_{k}`")
            if k in old.columns:
                t, u = old.schema[k].dataType, x.type
                if kind(u) == "null":
                    new = F.lit(None).cast(t)
                elif t != u:
                    if kind(t) == kind(u) == "number":
                        t = T.DoubleType() if t != u else t
                        new = new.cast(t)
                    elif old.filter(F.col(f"`{k}`").isNotNull()).isEmpty():
                        t = u
                    else:
                        raise QueryError(f"property {k} is {t.simpleString()} and can't become {u.simpleString()}")
                out.append(new.alias(k))
                if t != old.schema[k].dataType:
                    casts[k] = F.col(f"`{k}`").cast(t)
            elif kind(x.type) != "null":
                out.append(new.alias(k))
        kept = [c for c in old.columns if c not in values]
        rest = [F.lit(None).cast(old.schema[c].dataType).alias(c) if clear and c not in fixed else F.col(f"`{c}`") for c in kept]
        changed = materialise(old.join(last, F.col(ID) == F.col("_hit")).select(*rest, *out), "graph-changed")
        df = self._replaced(old.withColumns(casts) if casts else old, changed)
        if of_type is None:
            self._with_nodes(df)
        else:
            self._with_edges(of_type, df)

    # -- delete -----------------------------------------------------------
    def delete(self, scope: Scope, c: A.Delete) -> None:
        nodes, edges = [], []
        for e in c.exprs:
            b = scope.vars.get(e.name) if isinstance(e, A.Var) else None
            if isinstance(b, NodeB):
                nodes.append(scope.df.selectExpr(f"`{b.id}` AS _gone"))
            elif isinstance(b, RelB):
                edges.append(scope.df.selectExpr(f"`{b.id}` AS _gone", f"{b.type} AS _gone_type"))
            else:
                v = scope.compile(e)
                if v.kind == "list":
                    inner = kind(v.type.elementType)
                    one = scope.df.selectExpr(f"explode({v.sql}) AS x")
                elif v.kind == "path":
                    edges.append(scope.df.selectExpr(f"explode({v.sql}.rels) AS x").selectExpr("x._id AS _gone", "x._type AS _gone_type"))
                    one, inner = scope.df.selectExpr(f"explode({v.sql}.nodes) AS x"), "node"
                else:
                    inner, one = v.kind, scope.df.selectExpr(f"{v.sql} AS x")
                if inner == "node":
                    nodes.append(one.selectExpr("x._id AS _gone"))
                elif inner == "edge":
                    edges.append(one.selectExpr("x._id AS _gone", "x._type AS _gone_type"))
                elif inner != "null":
                    raise QueryError("only nodes, relationships and paths can be deleted")
        union = lambda fs: materialise(reduce(lambda a, b: a.unionByName(b), fs).filter("_gone IS NOT NULL").distinct(), "delete")
        gone_e = union(edges) if edges else None
        gone_n = union(nodes) if nodes else None
        held = []
        for t in self.graph.edges:
            df = t.df
            if gone_e is not None:
                hit = gone_e.filter(F.col("_gone_type") == t.type)
                df = df.join(hit, F.col(ID) == F.col("_gone"), "left_anti")
            if gone_n is not None:
                for end in (SRC, DST):
                    held.append(df.join(gone_n, F.col(end) == F.col("_gone"), "left_semi").select(F.lit(1).alias("held")))
                    if c.detach:
                        df = df.join(gone_n, F.col(end) == F.col("_gone"), "left_anti")
            if df is not t.df:
                self._with_edges(t.type, df)
        if held and not c.detach and not reduce(lambda a, b: a.unionByName(b), held).isEmpty():
            raise QueryError("a node that still has relationships can't be deleted without DETACH")
        if gone_n is not None:
            self._with_nodes(self.nodes.join(gone_n, F.col(ID) == F.col("_gone"), "left_anti"))
        scope.graph = self.graph


