"""Graph patterns to joins.

A hop is an equi-join of the binding table with the edge table and, if more
than the key of the far node is asked for, with its vertex table.  Which tables
a variable can come from is settled before any join, by labels and by the ends
of the relationship types, so most patterns touch one table for each variable.
An end of which no more than the key is asked for isn't read where the graph
knows that all its keys are nodes; elsewhere a semi-join sees to it that a
relationship with a missing end never matches, whatever is returned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from quiver.graph.property_graph import EdgeTable, NodeTable, UnknownName
from quiver.lang import ast as A
from quiver.plans.expressions import NodeB, QueryError, RelB, Scope, ValB, node_struct, walk
from quiver.plans.values import kind, quoted
from quiver.workdir import materialise

CAP = 100  # hops of an open pattern
UNROLLED = 3  # hops up to which a variable-length pattern is one plan
SPREAD = 1_000_000  # results of a join beyond which its small sides are dealt out
SHARE = 500_000  # results of a task then
SENT = 32 << 20  # bytes of a side that may be sent to all tasks


# -- which columns a query asks for --------------------------------------
def usage(clauses) -> set:
    """Variables that are used as a whole, and (variable, property) for those of which a property is.

    Shortest paths of which only the length is asked for don't count;
    (None, variable) stands for one whose values are told apart.
    """
    used: set = set()
    measured: set[str] = set()
    shortest: dict[str, set[str]] = {}

    def visit(e):
        if isinstance(e, (tuple, list)):
            for x in e:
                visit(x)
        elif isinstance(e, A.Call) and e.args and isinstance(e.args[0], A.Var) and e.name.lower() in ("count", "id", "value.id", "node.id", "edge.id"):
            visit(e.args[1:])
            if e.distinct:
                used.add((None, e.args[0].name))
        elif isinstance(e, A.Call) and len(e.args) == 1 and isinstance(e.args[0], A.Var) and e.name.lower() in ("length", "path.length"):
            measured.add(e.args[0].name)
        elif isinstance(e, A.IsNull) and isinstance(e.of, A.Var):
            pass
        elif isinstance(e, A.Binary) and e.op in ("=", "<>") and isinstance(e.left, A.Var) and isinstance(e.right, A.Var):
            used.update({(None, e.left.name), (None, e.right.name)})
        elif isinstance(e, A.Item) and isinstance(e.expr, A.Var) and e.name != e.expr.name:
            used.add(e.expr.name)
        elif isinstance(e, A.Prop) and isinstance(e.of, A.Var):
            used.add((e.of.name, e.key))
        elif isinstance(e, A.Var):
            used.add(e.name)
        elif isinstance(e, A.Projection):
            if e.star:
                used.add("*")
            visit((e.items, e.order, e.skip, e.limit))
        elif isinstance(e, A.PathP):
            if e.var and e.shortest:
                shortest.setdefault(e.var, set()).update(n.var for n in e.nodes if n.var)
            elif e.var:
                used.update(n.var for n in e.nodes if n.var)
            visit([n.props for n in e.nodes if n.props is not None] + [r.props for r in e.rels if r.props is not None])
        elif isinstance(e, A.SetItem):
            used.add(e.var)
            visit(e.value)
        elif hasattr(e, "__dataclass_fields__"):
            for f in e.__dataclass_fields__:
                visit(getattr(e, f))

    visit(clauses)
    used |= measured - set(shortest)
    for v, ends in shortest.items():
        used |= ends if {v, "*", (None, v)} & used else set()
    return used


# -- scans ----------------------------------------------------------------
def _labels(t: NodeTable, df: DataFrame | None = None) -> str:
    own = f"array({', '.join(quoted(x) for x in t.labels)})" if t.labels else None
    if t.label_column:
        return f"array_union({own}, `{t.label_column}`)" if own else f"`{t.label_column}`"
    return own or "CAST(array() AS ARRAY<STRING>)"


def _common(types: list[T.DataType]) -> T.DataType:
    """A type for a property that several tables have."""
    kinds = {t.simpleString() for t in types}
    if len(kinds) == 1:
        return types[0]
    if {kind(t) for t in types} == {"number"}:
        return T.LongType() if kinds <= {"tinyint", "smallint", "int", "bigint"} else T.DoubleType()
    return T.StringType()


def _fields(tables) -> dict[str, T.DataType]:
    found: dict[str, list] = {}
    for t in tables:
        types = t.types()
        for p in t.properties:
            found.setdefault(p, []).append(types[p])
    return {p: _common(ts) for p, ts in found.items()}


def scan_nodes(scope: Scope, tables: list[NodeTable], name: str, edge: EdgeTable | None = None, edge_base: str | None = None) -> tuple[DataFrame, NodeB]:
    """The vertex tables with fresh column names; with ``edge``, whose rows these are, its columns too."""
    base = scope.fresh(name)
    fields = _fields(tables)
    dynamic = len(tables) > 1
    parts = []
    for t in tables:
        own = set(t.properties)
        cols = [f"`{t.id}` AS `{base}`", f"{_labels(t)} AS `{base}_labels`"]
        cols += [(f"`{p}`" if p in own and t.types()[p] == k else f"CAST({f'`{p}`' if p in own else 'NULL'} AS {k.simpleString()})") + f" AS `{base}_{p}`" for p, k in fields.items()]
        if dynamic:
            cols.append(f"{quoted(t.name)} AS `{base}_table`")
        if edge is not None:
            cols += _edge_columns(edge, edge_base, {})
        parts.append(t.df.selectExpr(*cols))
    df = reduce(lambda a, b: a.unionByName(b), parts)
    b = NodeB(base, tuple(t.name for t in tables), f"{base}_table" if dynamic else None, f"`{base}_labels`", {p: f"{base}_{p}" for p in fields})
    b.columns = [base, f"{base}_labels", *b.props.values(), *([b.tab] if b.tab else [])]
    return df, b


def _edge_columns(e: EdgeTable, base: str, fields: dict[str, T.DataType]) -> list[str]:
    own = set(e.properties)
    props = {p: e.types()[p] for p in e.properties} if not fields else fields
    cols = [f"{e.id} AS `{base}`", f"{e.src} AS `{base}_src`", f"{e.dst} AS `{base}_dst`"]
    return cols + [f"CAST({f'`{p}`' if p in own else 'NULL'} AS {k.simpleString()}) AS `{base}_{p}`" if p not in own or e.types()[p] != k else f"`{p}` AS `{base}_{p}`" for p, k in props.items()]


@dataclass
class Hop:
    """Edge tables in an orientation: (table, reversed)."""

    options: list[tuple[EdgeTable, bool]]

    def ends(self) -> set[tuple[str, str]]:
        return {(e.target, e.source) if back else (e.source, e.target) for e, back in self.options}


def scan_edges(scope: Scope, hop: Hop, name: str, loops_once: bool) -> tuple[DataFrame, RelB, str, str, str | None, str | None]:
    """(rows, binding, from column, to column, from table, to table); the last two are SQL where they vary."""
    base = scope.fresh(name)
    tables = list({e.type + e.source + e.target: e for e, _ in hop.options}.values())
    fields = _fields(tables)
    kinds = tuple(dict.fromkeys(e.type for e in tables))
    ends = hop.ends()
    vary = len({a for a, _ in ends}) > 1 or len({b for _, b in ends}) > 1
    parts = []
    for e, back in hop.options:
        cols = _edge_columns(e, base, fields)
        a, b = (e.dst, e.src) if back else (e.src, e.dst)
        cols += [f"{a} AS `{base}_from`", f"{b} AS `{base}_to`"]
        if len(kinds) > 1:
            cols.append(f"{quoted(e.type)} AS `{base}_type`")
        if vary:
            x, y = (e.target, e.source) if back else (e.source, e.target)
            cols += [f"{quoted(x)} AS `{base}_fromt`", f"{quoted(y)} AS `{base}_tot`"]
        df = e.df.selectExpr(*cols).filter(f"`{base}_from` IS NOT NULL AND `{base}_to` IS NOT NULL")
        if back and loops_once and e.source == e.target:
            df = df.filter(f"`{base}_src` <> `{base}_dst`")
        parts.append(df)
    df = reduce(lambda a, b: a.unionByName(b), parts)
    rel = RelB(base, kinds, f"`{base}_type`" if len(kinds) > 1 else quoted(kinds[0]), f"{base}_src", f"{base}_dst", {p: f"{base}_{p}" for p in fields})
    rel.sources, rel.targets = tuple({e.source for e in tables}), tuple({e.target for e in tables})
    rel.columns = [c for c in df.columns]
    return df, rel, f"{base}_from", f"{base}_to", f"`{base}_fromt`" if vary else None, f"`{base}_tot`" if vary else None


# -- matching -------------------------------------------------------------
class Matcher:
    """Adds the variables of a pattern to a scope by joins."""

    def __init__(self, scope: Scope, used: set[str], given: set[str] = frozenset()):
        self.s, self.used, self.given = scope, used, given
        self.tables: dict[object, list[str]] = {}
        self.reached: set[str] = set()  # vertex tables that nodes of the present path come from

    # -- tables of each node ----------------------------------------------
    def _key(self, n: A.NodeP):
        return n.var if n.var else id(n)

    def _allowed(self, n: A.NodeP) -> list[str]:
        b = self.s.vars.get(n.var) if n.var else None
        out = list(b.tables) if isinstance(b, NodeB) else [t.name for t in self.s.graph.nodes]
        known = self.s.graph.labels()
        for group in n.labels:
            for x in group:
                if x not in known and self.s.graph.nodes and known:
                    raise UnknownName(f"unknown label {x}")
        fits = lambda t: all(t.label_column or set(g) & set(t.labels) for g in n.labels)
        return [t for t in out if fits(self.s.graph.node_table(t))]

    def _hop(self, r: A.RelP) -> Hop:
        for t in r.types:
            if t not in self.s.graph.types() and self.s.graph.types():
                raise UnknownName(f"unknown relationship type {t}")
        found = [e for e in self.s.graph.edges if not r.types or e.type in r.types]
        out = [(e, False) for e in found] if r.direction in ("out", "both") else []
        return Hop(out + ([(e, True) for e in found] if r.direction in ("in", "both") else []))

    def settle(self, paths) -> dict[int, Hop]:
        """Narrow the tables of all node variables until nothing changes."""
        hops = {}
        for p in paths:
            for n in p.nodes:
                k, allowed = self._key(n), self._allowed(n)
                self.tables[k] = [t for t in self.tables.get(k, allowed) if t in allowed]
            for r in p.rels:
                hops[id(r)] = self._hop(r)
        changed = True
        while changed:
            changed = False
            for p in paths:
                for a, r, b in zip(p.nodes, p.rels, p.nodes[1:]):
                    if r.length is not None:
                        continue
                    h, ka, kb = hops[id(r)], self._key(a), self._key(b)
                    keep = [(e, back) for e, back in h.options if (e.target if back else e.source) in self.tables[ka] and (e.source if back else e.target) in self.tables[kb]]
                    if len(keep) < len(h.options):
                        h.options, changed = keep, True
                    for k, side in ((ka, 0), (kb, 1)):
                        new = [t for t in self.tables[k] if t in {x[side] for x in h.ends()}]
                        if len(new) < len(self.tables[k]):
                            self.tables[k], changed = new, True
        return hops

    # -- parts ------------------------------------------------------------
    def _node_tables(self, n: A.NodeP) -> list[NodeTable]:
        return [self.s.graph.node_table(t) for t in self.tables[self._key(n)]]

    def _wants(self, n: A.NodeP) -> bool:
        """Whether more than the node's key is needed."""
        if n.var in self.given:
            return n.props is not None or any(self.s.graph.node_table(t).label_column for t in self.tables[self._key(n)]) and bool(n.labels)
        if n.props is not None or n.var and (n.var in self.used or "*" in self.used):
            return True
        key = self._key_property(self.tables[self._key(n)])
        if n.var and any(isinstance(u, tuple) and u[0] == n.var and u[1] != key for u in self.used):
            return True
        return bool(n.labels) and any(t.label_column for t in self._node_tables(n))

    def _key_property(self, tables) -> str | None:
        """The property that is the key of the one vertex table; an edge's end holds it too."""
        if len(tables) != 1:
            return None
        t = self.s.graph.node_table(next(iter(tables)))
        return t.id if t.id in t.properties else None

    def _add(self, df: DataFrame, condition=None) -> None:
        if not self.s.parts:
            self.s.df = df if condition is None else df.filter(condition)
        elif condition is None:
            self.s.parts.append(df)
        else:
            self.s.df = self.s.df.join(df, condition)

    def _same(self, b: NodeB, column: str, tab: str | None, tables: set[str]):
        """SQL: node ``b`` is the one at an edge's end."""
        own = f"`{b.tab}`" if b.tab else quoted(b.tables[0])
        other = tab or quoted(next(iter(tables)))
        also = f" AND {own} = {other}" if (b.tab or tab) else ""
        return F.expr(f"`{b.id}` = `{column}`{also}")

    def _real(self, df: DataFrame, column: str, tab: str | None, h: Hop, far: bool) -> DataFrame:
        """``df`` without rows at whose ``column``, an end of a hop, there is no node; the nodes are only read where that may be."""
        ends = [(e, "src" if far == back else "dst", (e.source if far == back else e.target)) for e, back in h.options]
        if all(self.s.graph.intact(e, end) for e, end, _ in ends):
            return df
        key = self.s.fresh("real")
        tables = dict.fromkeys(t for _, _, t in ends)
        keys = [self.s.graph.node_table(t).df.selectExpr(f"`{self.s.graph.node_table(t).id}` AS `{key}`", f"{quoted(t)} AS `{key}_t`") for t in tables]
        on = f"`{column}` = `{key}`" + (f" AND {tab} = `{key}_t`" if tab else "")
        return df.join(reduce(lambda a, b: a.unionByName(b), keys), F.expr(on), "left_semi")

    def _check(self, n: A.NodeP, b: NodeB) -> None:
        """Labels that the tables leave open, and properties."""
        for group in n.labels:
            if any(self.s.graph.node_table(t).label_column for t in b.tables):
                tests = " OR ".join(f"array_contains({b.labels}, {quoted(x)})" for x in group)
                self.s.df = self.s.df.filter(tests)
        self._props(n.props, b)

    def _props(self, props, b) -> None:
        if props is None:
            return
        if isinstance(props, A.Param):
            props = A.MapLit(tuple((k, A.Lit(v)) for k, v in (self.s.params.get(props.name) or {}).items()))
        name = "\0"
        old = self.s.vars.get(name)
        self.s.vars[name] = b
        for k, v in props.items:
            test = self.s.compile(A.Binary("=", A.Prop(A.Var(name), k), v))
            self.s.df = self.s.df.filter(test.sql)
        self.s.vars.pop(name)
        if old:
            self.s.vars[name] = old

    def _empty(self, path: A.PathP) -> None:
        """No table fits: bind all to nothing."""
        if self.s.df is None:
            self.s.df = self.s.spark.range(0).selectExpr("id AS `_none`")
        self.s.df = self.s.df.limit(0)
        for n in path.nodes:
            if n.var and n.var not in self.s.vars:
                c = self.s.fresh(n.var)
                self.s.df = self.s.df.withColumns({c: F.lit(None).cast("long"), f"{c}_labels": F.lit(None).cast("array<string>")})
                self.s.vars[n.var] = NodeB(c, ("",), None, f"`{c}_labels`", {}, [c, f"{c}_labels"])
        for r in path.rels:
            if r.var and r.var not in self.s.vars:
                c = self.s.fresh(r.var)
                self.s.df = self.s.df.withColumns({x: F.lit(None).cast("long") for x in (c, f"{c}_src", f"{c}_dst")})
                self.s.vars[r.var] = RelB(c, ("",), "CAST(NULL AS STRING)", f"{c}_src", f"{c}_dst", {})
        if path.var:
            c = self.s.fresh(path.var)
            self.s.df = self.s.df.withColumn(c, F.expr("CAST(NULL AS STRUCT<nodes: ARRAY<STRUCT<_id: BIGINT, _labels: ARRAY<STRING>>>, rels: ARRAY<STRUCT<_id: BIGINT, _type: STRING>>>)"))
            self.s.vars[path.var] = ValB(c)

    def match(self, paths) -> None:
        hops = self.settle(paths)
        for p in paths:
            fixed = [r for r in p.rels if r.length is None]
            if any(not self.tables[self._key(n)] for n in p.nodes) or any(not hops[id(r)].options for r in (fixed if len(fixed) < len(p.rels) else p.rels)):
                self._empty(p)
                continue
            self._path(p, hops)

    def _start(self, n: A.NodeP) -> NodeB:
        b = self.s.vars.get(n.var) if n.var else None
        if b is None:
            df, b = scan_nodes(self.s, self._node_tables(n), n.var or "node")
            self._add(df)
            if n.var:
                self.s.vars[n.var] = b
            self._check(n, b)
        elif isinstance(b, ValB):
            b = self._from_value(n, b)
            self._check(n, b)
        elif n.labels or n.props is not None:
            self._check(n, b)
        return b

    def _from_value(self, n: A.NodeP, b: ValB) -> NodeB:
        """A node held as a struct, as columns again."""
        v = self.s.whole(n.var)
        if v.kind != "node":
            raise QueryError(f"{n.var} isn't a node")
        base = self.s.fresh(n.var)
        names = [x for x in v.type.names if not x.startswith("_")]
        self.s.df = self.s.df.selectExpr("*", f"{v.sql}._id AS `{base}`", f"{v.sql}._labels AS `{base}_labels`", *[f"{v.sql}.`{x}` AS `{base}_{x}`" for x in names])
        out = NodeB(base, tuple(self.tables[self._key(n)]), None, f"`{base}_labels`", {x: f"{base}_{x}" for x in names})
        self.s.vars[n.var] = out
        return out

    def _path(self, p: A.PathP, hops: dict[int, Hop]) -> None:
        self.reached = {t for n in p.nodes for t in self.tables[self._key(n)]} if not p.rels or any(r.length is None for r in p.rels) else set()
        self.reached |= {t for r in p.rels for pair in hops[id(r)].ends() for t in pair}
        if p.shortest:
            self._shortest(p, hops)
            return
        first = p.nodes[0]
        bound = first.var in self.s.vars if first.var else False
        # a path may start at either end; the bound one goes first
        nodes, rels, back = list(p.nodes), list(p.rels), False
        if rels and not bound and p.nodes[-1].var in self.s.vars and p.nodes[-1].var:
            nodes, rels, back = nodes[::-1], rels[::-1], True
        pieces_n, pieces_r = [], []
        left = None
        if rels and rels[0].length is None and not (nodes[0].var and nodes[0].var in self.s.vars) and not self._wants(nodes[0]) and not p.var:
            pass  # the first edge scan gives the node's key
        else:
            left = self._start(nodes[0])
            pieces_n.append(left)
        for i, r in enumerate(rels):
            h = hops[id(r)]
            if back:
                h = Hop([(e, not b) for e, b in h.options])
            if r.length is not None:
                left = self._start(nodes[0]) if left is None else left
                left = self._varlen(left, r, h, nodes[i + 1], p, pieces_n, pieces_r, back)
            else:
                left = self._expand(left, nodes[i], r, h, nodes[i + 1], p, pieces_n, pieces_r)
        if p.var:
            self._bind_path(p, pieces_n[::-1] if back else pieces_n, pieces_r[::-1] if back else pieces_r)

    def _expand(self, left: NodeB | None, ln: A.NodeP, r: A.RelP, h: Hop, rn: A.NodeP, p: A.PathP, pn: list, pr: list) -> NodeB:
        s = self.s
        bound_rel = s.vars.get(r.var) if r.var else None
        right = s.vars.get(rn.var) if rn.var else None
        if isinstance(right, ValB):
            right = self._from_value(rn, right)
        wants = self._wants(rn) or p.var is not None
        only = h.options[0] if len(h.options) == 1 else None
        if only and bound_rel is None:
            e, back = only
            far = "src" if back else "dst"
            near = "dst" if back else "src"
            # the near node's own row holds the edge
            if e.owner == near and left is not None and left.tab is None and e.id.strip("`") in {*left.props, s.graph.node_table(left.tables[0]).id} and self._columns_known(e, left):
                rel, to = self._derived(e, left, far, r)
                return self._arrive(rel, to, None, h, r, rn, right, wants, pn, pr)
            # the far node's row is the edge: one scan gives both
            if e.owner == far and right is None and wants:
                base = s.fresh(r.var or "rel")
                table = s.graph.node_table(e.target if far == "dst" else e.source)
                df, b = scan_nodes(s, [table], rn.var or "node", e, base)
                rel = RelB(base, (e.type,), quoted(e.type), f"{base}_src", f"{base}_dst", {x: f"{base}_{x}" for x in e.properties}, (e.source,), (e.target,))
                join = f"{base}_{near}"
                if left is None:
                    left = self._from_edge(ln, join, None, {x for x, _ in h.ends()})
                    self._add(self._near(df.filter(f"`{join}` IS NOT NULL"), ln, join, None, h))
                else:
                    self._add(df, self._same(left, join, None, {x for x, _ in h.ends()}))
                if r.var:
                    s.vars[r.var] = rel
                if rn.var:
                    s.vars[rn.var] = b
                self._props(r.props, rel)
                self._check(rn, b)
                pn.append(b)
                pr.append(rel)
                return b
        ends = h.ends()
        if isinstance(bound_rel, RelB) and r.direction != "both" and len(ends) == 1:
            # the relationship is there already, and with it the keys of its ends
            near, far = (bound_rel.src, bound_rel.dst) if not h.options[0][1] else (bound_rel.dst, bound_rel.src)
            kinds = tuple(dict.fromkeys(e.type for e, _ in h.options))
            if set(kinds) < set(bound_rel.types):
                s.df = s.df.filter(f"{bound_rel.type} IN ({', '.join(map(quoted, kinds))})")
            if left is None:
                left = self._from_edge(ln, near, None, {x for x, _ in ends})
            else:
                s.df = s.df.filter(self._same(left, near, None, {x for x, _ in ends}))
            return self._arrive(bound_rel, far, None, h, r, rn, right, wants, pn, pr)
        df, rel, a, b, ta, tb = scan_edges(s, h, r.var or "rel", r.direction == "both")
        if bound_rel is not None:
            if isinstance(bound_rel, ValB):
                condition = F.expr(f"`{rel.id}` = {s.whole(r.var).sql}._id AND {rel.type} = {s.whole(r.var).sql}._type")
            else:
                condition = F.expr(f"`{rel.id}` = `{bound_rel.id}` AND {rel.type} = {bound_rel.type} AND `{rel.src}` = `{bound_rel.src}` AND `{rel.dst}` = `{bound_rel.dst}`")
            if left is not None:
                condition = condition & self._same(left, a, ta, {x for x, _ in h.ends()})
            self._add(df, condition)
            if left is None:
                left = self._from_edge(ln, a, ta, {x for x, _ in h.ends()})
        elif left is None:
            self._add(self._near(df, ln, a, ta, h))
            left = self._from_edge(ln, a, ta, {x for x, _ in h.ends()})
        else:
            self._add(df, self._same(left, a, ta, {x for x, _ in h.ends()}))
        return self._arrive(rel, b, tb, h, r, rn, right, wants, pn, pr)

    def _near(self, df: DataFrame, n: A.NodeP, column: str, tab: str | None, h: Hop) -> DataFrame:
        """An edge scan that stands for its near node too; one that is joined with the outer query's node anyway needs no look."""
        return df if n.var in self.given else self._real(df, column, tab, h, False)

    def _columns_known(self, e: EdgeTable, left: NodeB) -> bool:
        own = {*left.props, self.s.graph.node_table(left.tables[0]).id}
        return e.src.strip("`") in own and e.dst.strip("`") in own and set(e.properties) <= set(left.props)

    def _derived(self, e: EdgeTable, left: NodeB, far: str, r: A.RelP) -> tuple[RelB, str]:
        """The edge as columns of the node whose row it is."""
        s, base, key = self.s, self.s.fresh(r.var or "rel"), self.s.graph.node_table(left.tables[0]).id
        of = lambda c: f"`{left.id if c.strip('`') == key else left.props[c.strip('`')]}`"
        s.df = s.df.selectExpr("*", f"{of(e.id)} AS `{base}`", f"{of(e.src)} AS `{base}_src`", f"{of(e.dst)} AS `{base}_dst`", *[f"`{left.props[x]}` AS `{base}_{x}`" for x in e.properties])
        s.df = s.df.filter(f"`{base}_{far}` IS NOT NULL")
        return RelB(base, (e.type,), quoted(e.type), f"{base}_src", f"{base}_dst", {x: f"{base}_{x}" for x in e.properties}, (e.source,), (e.target,)), f"{base}_{far}"

    def _from_edge(self, n: A.NodeP, column: str, tab: str | None, tables: set[str]) -> NodeB:
        """A node of which only the key is known, from an edge's end."""
        t = tuple(sorted(tables))
        labels = _labels(self.s.graph.node_table(t[0])) if len(t) == 1 and not self.s.graph.node_table(t[0]).label_column else "CAST(NULL AS ARRAY<STRING>)"
        key = self._key_property(t)
        b = NodeB(column, t, tab.strip("`") if tab else None, labels, {key: column} if key else {}, [column])
        if n.var:
            self.s.vars[n.var] = b
        return b

    def _arrive(self, rel: RelB, to: str, tab: str | None, h: Hop, r: A.RelP, rn: A.NodeP, right, wants: bool, pn: list, pr: list) -> NodeB:
        s, tables = self.s, {x for _, x in h.ends()}
        if r.var:
            s.vars[r.var] = rel
        self._props(r.props, rel)
        if right is None and rn.var:
            right = s.vars.get(rn.var)  # a loop: the start node was bound by this very edge
        if right is not None:
            s.df = s.df.filter(self._same(right, to, tab, tables))
            if rn.labels or rn.props is not None:
                self._check(rn, right)
        elif wants:
            df, right = scan_nodes(s, self._node_tables(rn), rn.var or "node")
            self._add(df, self._same(right, to, tab, tables))
            if rn.var:
                s.vars[rn.var] = right
            self._check(rn, right)
        else:
            right = self._from_edge(rn, to, tab, tables & set(self.tables[self._key(rn)]) or tables)
            if rn.var not in self.given:
                s.df = self._real(s.df, to, tab, h, True)
            if tab and len(tables) > len(self.tables[self._key(rn)]):
                s.df = s.df.filter(f"{tab} IN ({', '.join(quoted(t) for t in self.tables[self._key(rn)])})")
        pn.append(right)
        pr.append(rel)
        return right

    # -- variable length --------------------------------------------------
    def _node_fields(self) -> dict[str, str]:
        return {p: t.simpleString() for p, t in _fields([t for t in self.s.graph.nodes if t.name in self.reached]).items()}

    def _rel_struct(self, rel: RelB, fields: dict[str, str]) -> str:
        props = "".join(f", {quoted(k)}, CAST({f'`{rel.props[k]}`' if k in rel.props else 'NULL'} AS {t})" for k, t in fields.items())
        return f"named_struct('_id', CAST(`{rel.id}` AS BIGINT), '_type', {rel.type}, '_src', CAST(`{rel.src}` AS BIGINT), '_dst', CAST(`{rel.dst}` AS BIGINT){props})"

    def _step(self, h: Hop, r: A.RelP, rich: bool):
        """One hop's rows: (frame, from, to, from table, to table, unique edge key SQL, edge struct SQL, node frame)."""
        df, rel, a, b, ta, tb = scan_edges(self.s, h, r.var or "rel", r.direction == "both")
        df = self._real(df, b, tb, h, True)
        if r.props is not None:
            inner = self.s.clone(df, {})
            m = Matcher(inner, self.used)
            m._props(r.props, rel)
            df = inner.df
        fields = {p: t.simpleString() for p, t in _fields([e for e, _ in h.options]).items()}
        # a relationship's key in 64 bits: its id, and behind it the number of its type
        bits, which = (len(rel.types) - 1).bit_length(), " ".join(f"WHEN {quoted(t)} THEN {i}L" for i, t in enumerate(rel.types))
        unique = f"shiftleft(CAST(`{rel.id}` AS BIGINT), {bits}) | CASE {rel.type} {which} END" if bits else f"CAST(`{rel.id}` AS BIGINT)"
        step, ends = self.s.fresh("step"), h.ends()
        cols = [f"`{a}` AS `{step}_a`", f"`{b}` AS `{step}_b`", f"{unique} AS `{step}_u`"]
        if rich:
            cols.append(f"{self._rel_struct(rel, fields)} AS `{step}_r`")
        one_t = len({x for pair in ends for x in pair}) == 1
        first_from, first_to = next(iter(ends))
        cols += [f"{ta or quoted(first_from)} AS `{step}_ta`", f"{tb or quoted(first_to)} AS `{step}_tb`"]
        return df.selectExpr(*cols), step, one_t

    def _node_list(self, step: str) -> DataFrame:
        """The nodes that a path can reach as structs of one type, by key."""
        parts, fields = [], self._node_fields()
        for t in [t for t in self.s.graph.nodes if t.name in self.reached]:
            df, b = scan_nodes(self.s, [t], "hop")
            parts.append(df.selectExpr(f"CAST(`{b.id}` AS BIGINT) AS `{step}_nk`", f"{quoted(t.name)} AS `{step}_nt`", f"{node_struct(b, fields)} AS `{step}_n`"))
        return reduce(lambda x, y: x.unionByName(y), parts)

    def _varlen(self, left: NodeB, r: A.RelP, h: Hop, rn: A.NodeP, p: A.PathP, pn: list, pr: list, back: bool) -> NodeB:
        s = self.s
        low, high = r.length
        high = CAP if high is None else high
        rich = p.var is not None or r.var is not None and (r.var in self.used or "*" in self.used)
        c = s.fresh("walk")
        base = s.df
        start = [f"CAST(`{left.id}` AS BIGINT) AS `{c}_at`", f"{f'`{left.tab}`' if left.tab else quoted(left.tables[0])} AS `{c}_tab`", f"CAST(array() AS ARRAY<BIGINT>) AS `{c}_seen`"]
        front = base.selectExpr("*", *start)
        levels = []
        step_df, step, one_table = self._step(h, r, rich) if h.options else (None, None, True)
        if step_df is not None:
            if rich:
                rel_type = step_df.schema[f"{step}_r"].dataType.simpleString()
                front = front.selectExpr("*", f"CAST(array() AS ARRAY<{rel_type}>) AS `{c}_rels`")
            if p.var:
                nodes = self._node_list(step)
                node_type = nodes.schema[f"{step}_n"].dataType.simpleString()
                front = front.selectExpr("*", f"CAST(array() AS ARRAY<{node_type}>) AS `{c}_nodes`")
        if low == 0:
            levels.append(front)
        if step_df is None:
            high = 0
        for k in range(1, high + 1):
            on = F.expr(f"`{c}_at` = `{step}_a`" + ("" if one_table else f" AND `{c}_tab` = `{step}_ta`") + (f" AND NOT array_contains(`{c}_seen`, `{step}_u`)" if k > 1 else ""))
            nxt = front.join(step_df, on)
            if p.var:
                nxt = nxt.join(nodes, F.expr(f"`{step}_b` = `{step}_nk` AND `{step}_tb` = `{step}_nt`"))
            moved = {f"{c}_at": f"CAST(`{step}_b` AS BIGINT)", f"{c}_tab": f"`{step}_tb`", f"{c}_seen": f"array_append(`{c}_seen`, `{step}_u`)"}
            if rich:
                moved[f"{c}_rels"] = f"array_append(`{c}_rels`, `{step}_r`)"
            if p.var:
                moved[f"{c}_nodes"] = f"array_append(`{c}_nodes`, `{step}_n`)"
            front = nxt.selectExpr(*[f"`{x}`" for x in front.columns if x not in moved], *[f"{e} AS `{x}`" for x, e in moved.items()])
            if high > UNROLLED:
                front = materialise(front, "walk")
                if front.isEmpty():
                    break
            if k >= low:
                levels.append(front)
        if not levels:
            levels = [front.limit(0)]
        s.df = reduce(lambda x, y: x.unionByName(y), levels)
        if r.var:
            s.df = s.df.withColumn(f"{c}_rel", F.expr(f"{'reverse' if back else ''}(`{c}_rels`)" if rich else f"`{c}_seen`"))
            s.vars[r.var] = ValB(f"{c}_rel")
        pr.append((f"reverse(`{c}_rels`)" if back else f"`{c}_rels`") if rich else None)
        pn.append((f"`{c}_nodes`", back) if p.var else None)
        return self._land(f"{c}_at", f"{c}_tab", rn, p)

    def _land(self, at: str, tab: str, rn: A.NodeP, p: A.PathP) -> NodeB:
        """Bind the node reached by a walk."""
        s = self.s
        right = s.vars.get(rn.var) if rn.var else None
        if isinstance(right, ValB):
            right = self._from_value(rn, right)
        if right is not None:
            s.df = s.df.filter(self._same(right, at, f"`{tab}`", set(right.tables)))
            if rn.labels or rn.props is not None:
                self._check(rn, right)
            return right
        if self._wants(rn) or len(self.tables[self._key(rn)]) < len(s.graph.nodes):
            df, right = scan_nodes(s, self._node_tables(rn), rn.var or "node")
            self._add(df, self._same(right, at, f"`{tab}`", set(right.tables)))
            if rn.var:
                s.vars[rn.var] = right
            self._check(rn, right)
            return right
        return self._from_edge(rn, at, f"`{tab}`", {t.name for t in s.graph.nodes})

    # -- shortest paths ---------------------------------------------------
    def _shortest(self, p: A.PathP, hops: dict[int, Hop]) -> None:
        """Breadth-first from every distinct start; a node is entered once (or by all paths of equal length) for each start.

        Tables that aren't on the way to a target are left out at each level.
        Starts and targets that stand apart aren't multiplied: the walks join
        them.  All paths of the last length are only counted out where they
        are used, from what is known of both sides by then.
        """
        s = self.s
        if len(p.rels) != 1:
            raise QueryError("a shortest path has one relationship pattern")
        r, h, rn = p.rels[0], hops[id(p.rels[0])], p.nodes[1]
        low, high = r.length or (1, 1)
        high = CAP if high is None else high
        left = self._start(p.nodes[0])
        right = s.vars.get(rn.var) if rn.var else None
        if isinstance(right, ValB):
            right = self._from_value(rn, right)
        mine = next(x for x in s.parts if left.id in x.columns)
        other = next((x for x in s.parts if right is not None and x is not mine and right.id in x.columns), None)
        c = s.fresh("bfs")
        whole = p.var is not None and bool({p.var, "*", (None, p.var)} & self.used)
        rich = whole or r.var is not None
        starts, targets, ends = set(left.tables), set(self.tables[self._key(rn)]), h.ends()
        back = [targets]  # tables from which a target can be reached by so many hops
        while len(back) <= high and (len(back) == 1 or back[-1] != back[-2]):
            back.append(back[-1] | {a for a, b in ends if b in back[-1]})
        near = lambda d: back[min(d, len(back) - 1)]
        if not rich:
            on_way, size = set(starts), -1
            while len(on_way) > size:
                size = len(on_way)
                on_way |= {b for a, b in ends if a in on_way and b in near(high - 1)}
            h = Hop([(e, x) for e, x in h.options if {e.source, e.target} <= on_way] or h.options)
        step_df, step, _ = self._step(h, r, rich)
        tab = f"`{left.tab}`" if left.tab else quoted(left.tables[0])
        front = mine.selectExpr(f"CAST(`{left.id}` AS BIGINT) AS `{c}_s`", f"{tab} AS `{c}_st`").filter(f"`{c}_s` IS NOT NULL").distinct()
        carried = {}
        if rich:
            carried[f"{c}_rels"] = f"CAST(array() AS ARRAY<{step_df.schema[f'{step}_r'].dataType.simpleString()}>)"
        if whole:
            nodes = self._node_list(step)
            carried[f"{c}_nodes"] = f"CAST(array() AS ARRAY<{nodes.schema[f'{step}_n'].dataType.simpleString()}>)"
        front = materialise(front.selectExpr("*", f"`{c}_s` AS `{c}_at`", f"`{c}_st` AS `{c}_tab`", *[f"{e} AS `{x}`" for x, e in carried.items()]), "bfs")
        key = [f"{c}_s", f"{c}_st", f"{c}_at", f"{c}_tab"]
        among = lambda column, tables: f"{column} IN ({', '.join(map(quoted, sorted(tables)))})"
        begin = F.expr(f"CAST(`{left.id}` AS BIGINT) = `{c}_s` AND {tab} = `{c}_st`")

        def landed(front: DataFrame, at: set[str], k: int) -> DataFrame:
            """Walks that are at a target, with the rows that asked for them."""
            out = mine.join(front if at <= targets else front.filter(among(f"`{c}_tab`", targets)), begin)
            out = out if other is None else out.join(other, self._same(right, f"{c}_at", f"`{c}_tab`", targets))
            return out.withColumn(f"{c}_len", F.lit(k))

        at, seen, found = starts, [], [landed(front, starts, 0)] if low == 0 and starts & targets else []
        for k in range(1, high + 1):
            to = {b for a, b in ends if a in at and b in near(high - k)}
            if not to:
                break
            hop = step_df.filter(f"{among(f'`{step}_ta`', at)} AND {among(f'`{step}_tb`', to)}")
            last = k == high and p.shortest == "all"  # every walk ends at a target now
            if whole:
                hop = hop.join(nodes, F.expr(f"`{step}_b` = `{step}_nk` AND `{step}_tb` = `{step}_nt`"))
            if last and other is not None:
                hop = hop.join(other, self._same(right, f"{step}_b", f"`{step}_tb`", targets))
            near_key = {f"{c}_at": f"{step}_a"} | ({} if len(at) == 1 else {f"{c}_tab": f"{step}_ta"})
            if last:
                walks = mine.join(front, begin)
                front, hop = (walks, hop) if right is not None and other is None else self._spread(front, walks, hop, near_key, left, None if rich else 0 if other is None else self._width(other))
            nxt = front.join(hop, F.expr(" AND ".join(f"`{a}` = `{b}`" for a, b in near_key.items())))
            if to & starts:
                same = f"`{c}_s` = `{step}_b`" + ("" if len(to) == len(starts) == 1 else f" AND `{c}_st` = `{step}_tb`")
                nxt = nxt.filter(f"NOT ({same})")
            moved = {f"{c}_at": f"CAST(`{step}_b` AS BIGINT)", f"{c}_tab": f"`{step}_tb`"}
            moved |= {x: f"array_append(`{x}`, `{step}_{x[len(c) + 1]}`)" for x in carried}
            nxt = nxt.selectExpr(*[f"`{x}`" for x in front.columns if x not in moved], *[f"{e} AS `{x}`" for x, e in moved.items()], *([f"`{x}`" for x in other.columns] if last and other is not None else []))
            met = [f for tables, f in seen if tables & to]
            if met:
                nxt = nxt.join(reduce(lambda x, y: x.unionByName(y), met), key, "left_anti")
            if last:
                found.append(nxt.withColumn(f"{c}_len", F.lit(k)))
                break
            if p.shortest == "one" and rich:
                least = F.min(F.struct(F.transform(f"{c}_rels", lambda x: x["_id"]).alias("k"), *[F.col(x) for x in carried])).alias("m")
                nxt = nxt.groupBy(*key).agg(least).selectExpr(*[f"`{x}`" for x in key], *[f"m.`{x}` AS `{x}`" for x in carried])
            elif p.shortest == "one":
                nxt = nxt.distinct()
            front = materialise(nxt, "bfs")
            if front.isEmpty():
                break
            if to & targets:
                found.append(landed(front, to, k))
            # where hops go both ways, a node's neighbours are at most one level before it; the start is looked at anyway
            seen = [*(seen[-1:] if r.direction == "both" else seen), (to, front.select(*key).distinct())]
            at = to
        rows = reduce(lambda x, y: x.unionByName(y), found or [landed(front.limit(0), at, 0)])
        across = s.across
        s.parts, s.across = [x for x in s.parts if x is not mine and x is not other] + [rows], []
        for x in across:
            s.keep(x, True)
        if r.var:
            s.vars[r.var] = ValB(f"{c}_rels")
        if other is None:
            self._land(f"{c}_at", f"{c}_tab", rn, p)
        elif rn.labels or rn.props is not None:
            self._check(rn, right)
        if whole:
            fields = self._node_fields()
            head = node_struct(left, fields)
            s.df = s.df.withColumn(f"{c}_path", F.expr(f"named_struct('nodes', concat(array({head.replace('`' + left.id + '`', 'CAST(`' + left.id + '` AS BIGINT)', 1)}), `{c}_nodes`), 'rels', `{c}_rels`)"))
        elif p.var:
            s.df = s.df.withColumn(f"{c}_path", F.expr(f"named_struct('nodes', CAST(array() AS ARRAY<STRUCT<_id: BIGINT, _labels: ARRAY<STRING>>>), 'rels', array_repeat(CAST(NULL AS STRUCT<_id: BIGINT, _type: STRING>), `{c}_len`))"))
        if p.var:
            s.vars[p.var] = ValB(f"{c}_path")

    def _spread(self, front: DataFrame, rows: DataFrame, hop: DataFrame, key: dict[str, str], left: NodeB, width: int | None) -> tuple[DataFrame, DataFrame]:
        """``rows`` and ``hop`` for their join, which may have far more rows than both.

        Small sides would make few tasks, so ``rows`` are dealt out by their
        start as the number of results asks for.  A ``hop`` that is measured
        to be small is sent to all of them, so results need no shuffle, nor
        does a grouping by start.  ``width``: bytes of a hop's further
        columns, None where they can be of any length.
        """
        s = self.s
        there = hop.groupBy(*key.values()).agg(F.count(F.lit(1)).alias("_m"))
        here = front.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        sizes = there.join(here, F.expr(" AND ".join(f"`{a}` = `{b}`" for a, b in key.items())), "left")
        results, size = sizes.agg(F.sum(F.expr("_m * coalesce(_n, 0)")), F.sum("_m")).first()
        if (results or 0) <= SPREAD:
            return rows, hop
        parts = max(int(s.spark.conf.get("spark.sql.shuffle.partitions")), -(-results // SHARE))
        rows = rows.repartition(parts, F.col(f"`{left.id}`"))
        name = self._key_property(left.tables)
        if name and "*" not in self.used and left.props[name] == f"{left.id}_{name}" and rows.schema[left.id].dataType == rows.schema[left.props[name]].dataType:
            rows = rows.withColumn(left.props[name], F.col(f"`{left.id}`"))  # the same value: Spark then knows that rows are dealt out by it
        return rows, F.broadcast(hop) if width is not None and size * (width + 24) <= SENT else hop

    def _width(self, df: DataFrame) -> int | None:
        """Bytes of a row's columns that the query may use; None where values can be of any length."""
        s, wanted = self.s, list(self.s.hidden)
        for v, b in s.vars.items():
            whole = bool({v, "*"} & self.used)
            if isinstance(b, ValB):
                wanted.append(b.column)
                continue
            wanted += [*b.key(), *[x for k, x in b.props.items() if whole or (v, k) in self.used], *([b.labels.strip("`")] if whole and isinstance(b, NodeB) else [])]
        types = [f.dataType for f in df.schema.fields if f.name in wanted]
        return 8 * len(types) if all(isinstance(t, (T.IntegralType, T.FractionalType, T.BooleanType, T.DatetimeType)) and t.simpleString() != "time" for t in types) else None

    def _bind_path(self, p: A.PathP, nodes: list, rels: list) -> None:
        s, fields = self.s, self._node_fields()
        cast_id = lambda b: node_struct(b, fields).replace(f"`{b.id}`", f"CAST(`{b.id}` AS BIGINT)", 1)
        all_rel = {}
        for x in rels:
            if isinstance(x, RelB):
                all_rel |= {k: s.type_of(f"`{c}`").simpleString() for k, c in x.props.items()}
        if any(not isinstance(x, RelB) for x in rels):
            # walks carry structs of their own hop's properties; fixed hops beside them take the same form
            all_rel = {}
            for x in rels:
                if isinstance(x, str):
                    t = s.type_of(x).elementType
                    all_rel |= {f.name: f.dataType.simpleString() for f in t.fields if not f.name.startswith("_")}
        parts_n, parts_r = [], []
        for x in nodes:
            if isinstance(x, NodeB):
                parts_n.append(f"array({cast_id(x)})")
            elif isinstance(x, tuple):
                parts_n.append(x)
        for x in rels:
            parts_r.append(f"array({self._rel_struct(x, all_rel)})" if isinstance(x, RelB) else x)
        # a walk's node list holds the nodes it reached, the last of which is the next node of the pattern
        out_n = []
        for x in parts_n:
            if isinstance(x, tuple):
                out_n.append(f"reverse({x[0]})" if x[1] else x[0])
            else:
                out_n.append(x)
        if not parts_r:
            parts_r = ["CAST(array() AS ARRAY<STRUCT<_id: BIGINT, _type: STRING, _src: BIGINT, _dst: BIGINT>>)"]
        c = s.fresh(p.var)
        s.df = s.df.withColumn(c, F.expr(f"named_struct('nodes', {'concat(' + ', '.join(out_n) + ')' if len(out_n) > 1 else out_n[0]}, 'rels', {'concat(' + ', '.join(parts_r) + ')' if len(parts_r) > 1 else parts_r[0]})"))
        s.vars[p.var] = ValB(c)


# -- optional, exists, comprehension -------------------------------------
def variables(paths) -> list[str]:
    out = []
    for p in paths:
        out += [x.var for x in (*p.nodes, *p.rels) if x.var] + ([p.var] if p.var else [])
    return list(dict.fromkeys(out))


def is_walk(paths) -> bool:
    return any(p.shortest or any(r.length is not None for r in p.rels) for p in paths)


def names_in(e) -> set[str]:
    return {x.name for x in walk(e) if isinstance(x, A.Var)} if e is not None else set()


def _apart(outer: Scope, paths, where, used: set[str]) -> tuple[Scope, list, list[str], bool]:
    """The pattern on its own: (scope, join conditions, shared variables, whether ``where`` is already applied).

    A walk starts from the distinct nodes of the outer rows; other patterns
    are joined on their own, so the outer rows are read once.  Then outer
    variables in ``where`` are left to the join's condition.
    """
    shared = [v for v in variables(paths) if v in outer.vars]
    free = names_in(where) & set(outer.vars)
    values = [v for v in shared if isinstance(outer.vars[v], ValB)] or is_walk(paths) or any(names_in(n.props) | names_in(r.props) for p in paths for n in p.nodes for r in (p.rels or (n,)))
    if values:
        keep = list(dict.fromkeys(c for v in (set(shared) | free | names_in([x.props for p in paths for x in (*p.nodes, *p.rels)])) & set(outer.vars) for c in _columns(outer.vars[v], outer)))
        seeds = outer.df.select(*[F.col(f"`{c}`") for c in keep]).distinct() if keep else outer.spark.range(1).selectExpr("id AS `_one`")
        names = {c: outer.fresh(c) for c in seeds.columns}
        seeds = seeds.withColumnsRenamed(names)
        inner = outer.clone(seeds, {v: _renamed(outer.vars[v], names) for v in outer.vars if all(c in names for c in _columns(outer.vars[v], outer))})
        inner.hidden = []
        Matcher(inner, used | free).match(paths)
        if where is not None:
            inner.df = inner.df.filter(inner.boolean(inner.compile(where)))
        on = [F.expr(f"`{a}` <=> `{b}`") for a, b in names.items() if a in outer.df.columns]
        return inner, on, shared, True
    inner = outer.clone(None, {})
    inner.df, inner.hidden = None, []
    inside = {v for v in variables(paths)}
    early = where is not None and (names_in(where) <= inside - set(shared) or any(isinstance(x, (A.Exists, A.PatternComp)) for x in walk(where)))
    Matcher(inner, used | (usage((where,)) if early else set()), set() if early else set(shared)).match(paths)
    if early:
        inner.df = inner.df.filter(inner.boolean(inner.compile(where)))
    on = []
    for v in shared:
        a, b = outer.vars[v], inner.vars[v]
        if isinstance(a, NodeB):
            x, y = (f"`{z.tab}`" if z.tab else quoted(z.tables[0]) for z in (a, b))
            on.append(F.expr(f"`{a.id}` = `{b.id}`" + (f" AND {x} = {y}" if a.tab or b.tab else "")))
        else:
            on.append(F.expr(f"`{a.id}` = `{b.id}`" + (f" AND {a.type} = {b.type}" if len(a.types) > 1 or len(b.types) > 1 else "")))
    return inner, on, shared, early


def _columns(b, scope: Scope) -> list[str]:
    have = set(scope.df.columns) if scope.df is not None else set()
    if isinstance(b, ValB):
        return [b.column]
    cols = [*b.key(), *b.props.values()]
    if isinstance(b, NodeB):
        cols += [b.labels.strip("`")] if b.labels.strip("`") in have else []
    else:
        cols += [b.src, b.dst, *([b.type.strip("`")] if b.type.strip("`") in have else [])]
    return [c for c in cols if c in have]


def _renamed(b, names: dict[str, str]):
    n = lambda c: names.get(c, c)
    sql = lambda t: f"`{names[t.strip('`')]}`" if t.strip("`") in names else t
    if isinstance(b, ValB):
        return ValB(n(b.column))
    props = {k: n(c) for k, c in b.props.items()}
    if isinstance(b, NodeB):
        return NodeB(n(b.id), b.tables, n(b.tab) if b.tab else None, sql(b.labels), props)
    return RelB(n(b.id), b.types, sql(b.type), n(b.src), n(b.dst), props, b.sources, b.targets)


def _condition(outer: Scope, inner: Scope, on: list, shared, where, done: bool):
    if where is not None and not done:
        both = outer.clone(None, {**inner.vars, **outer.vars})
        both.df = outer.spark.createDataFrame([], T.StructType([*outer.df.schema.fields, *inner.df.schema.fields]))
        on = [*on, F.expr(both.boolean(both.compile(where)))]
    return reduce(lambda a, b: a & b, on) if on else F.lit(True)


def optional_match(outer: Scope, m: A.Match, used: set[str]) -> None:
    inner, on, shared, done = _apart(outer, m.pattern, m.where, used)
    condition = _condition(outer, inner, on, shared, m.where, done)
    new = {v: inner.vars[v] for v in variables(m.pattern) if v not in outer.vars}
    keep = [c for c in inner.df.columns]
    outer.df = outer.df.join(inner.df.select(*[F.col(f"`{c}`") for c in keep]), condition, "left")
    for v, b in new.items():
        if isinstance(b, RelB) and not b.type.startswith("`"):
            b.type = f"if(`{b.id}` IS NULL, NULL, {b.type})"
        outer.vars[v] = b


def semi_join(outer: Scope, e: A.Exists, negated: bool) -> None:
    """EXISTS or NOT EXISTS as a condition on rows."""
    inner, on, shared, done = _apart(outer, e.pattern, e.where, usage(e.where))
    outer.df = outer.df.join(inner.df, _condition(outer, inner, on, shared, e.where, done), "left_anti" if negated else "left_semi")


def _seeds(outer: Scope, paths, extra) -> tuple[DataFrame, dict[str, str], Scope]:
    """Distinct outer values that a pattern depends on, under names of their own."""
    wanted = (set(variables(paths)) | names_in(extra) | names_in([x.props for p in paths for x in (*p.nodes, *p.rels)])) & set(outer.vars)
    keep = list(dict.fromkeys(c for v in sorted(wanted) for c in _columns(outer.vars[v], outer)))
    if not keep:
        seeds, names = outer.spark.range(1).selectExpr("id AS `_one`"), {}
    else:
        names = {c: outer.fresh("seed") for c in keep}
        seeds = outer.df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).distinct()
    inner = outer.clone(seeds, {v: _renamed(outer.vars[v], names) for v in wanted})
    inner.hidden, inner.order = [], []
    return seeds, names, inner


def flag_exists(outer: Scope, e: A.Exists) -> str:
    """A column that says for each row whether the pattern has a match."""
    if outer.locals:
        raise QueryError("EXISTS can't stand within a list expression")
    _, names, inner = _seeds(outer, e.pattern, e.where)
    Matcher(inner, usage((e.where,))).match(e.pattern)
    if e.where is not None:
        inner.df = inner.df.filter(inner.boolean(inner.compile(e.where)))
    flag = outer.fresh("exists")
    if not names:
        hits = inner.df.limit(1).agg((F.count(F.lit(1)) > 0).alias(flag))
        outer.df = outer.df.crossJoin(hits)
        return flag
    hits = inner.df.select(*names.values()).distinct().withColumn(f"{flag}_hit", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.expr(f"`{a}` <=> `{b}`") for a, b in names.items()])
    outer.df = outer.df.join(hits, on, "left").drop(*names.values()).withColumn(flag, F.coalesce(F.col(f"{flag}_hit"), F.lit(False))).drop(f"{flag}_hit")
    return flag


def collect_pattern(outer: Scope, e: A.PatternComp) -> str:
    """A column with the list of the results of all matches of each row."""
    if outer.locals:
        raise QueryError("a pattern comprehension can't stand within a list expression")
    _, names, inner = _seeds(outer, (e.pattern,), (e.where, e.result))
    Matcher(inner, usage((e.where, e.result))).match((e.pattern,))
    if e.where is not None:
        inner.df = inner.df.filter(inner.boolean(inner.compile(e.where)))
    out = outer.fresh("list")
    value = inner.compile(e.result)
    inner.df = inner.df.withColumn(f"{out}_v", F.expr(f"named_struct('v', {value.sql})"))
    collected = F.expr(f"transform(collect_list(`{out}_v`), s -> s.v)").alias(out)
    kind_ = inner.df.schema[f"{out}_v"].dataType.fields[0].dataType.simpleString()
    if not names:
        outer.df = outer.df.crossJoin(inner.df.agg(collected))
        return out
    lists = inner.df.groupBy(*names.values()).agg(collected)
    on = reduce(lambda a, b: a & b, [F.expr(f"`{a}` <=> `{b}`") for a, b in names.items()])
    joined = outer.df.join(lists, on, "left").drop(*names.values())
    outer.df = joined.withColumn(out, F.expr(f"coalesce(`{out}`, CAST(array() AS ARRAY<{kind_}>))"))
    return out
