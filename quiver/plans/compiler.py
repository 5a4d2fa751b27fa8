"""Queries to DataFrames, clause by clause."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quiver.graph.property_graph import PropertyGraph
from quiver.lang import ast as A
from quiver.lang.parser import default_name
from quiver.plans.expressions import NodeB, QueryError, RelB, Scope, ValB, walk
from quiver.plans.patterns import Matcher, _columns, optional_match, semi_join, usage
from quiver.functions.registry import AGGREGATES
from quiver.operators.selection import select_rank
from quiver.workdir import materialise

BOUNDED = 100_000  # different values of a group that a window may rank


def is_aggregate(e) -> bool:
    return isinstance(e, A.Call) and e.name.lower() in AGGREGATES


def has_aggregate(e) -> bool:
    return any(is_aggregate(x) for x in walk(e))


def conjuncts(e: A.Expr) -> list[A.Expr]:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, A.Binary) and e.op == "AND" else [e]


def where(scope: Scope, e: A.Expr | None) -> None:
    """Filter; EXISTS among the AND-ed conditions becomes a semi-join or anti-join."""
    if e is None:
        return
    later = []
    for c in conjuncts(e):
        negated = isinstance(c, A.Unary) and c.op == "NOT" and isinstance(c.of, A.Exists)
        if isinstance(c, A.Exists) or negated:
            later.append((c.of if negated else c, negated))
        else:
            sql = scope.boolean(scope.compile(c))
            if any(isinstance(x, A.Call) and x.name.lower() not in ("id", "value.id", "node.id") for x in walk(c)):
                scope.df = scope.df.filter(sql)  # functions may draw random values
            else:
                scope.keep(sql, wait=isinstance(c, A.Binary) and c.op == "<>")
    for c, negated in later:
        semi_join(scope, c, negated)


def unit(scope: Scope) -> None:
    if scope.df is None:
        scope.df = scope.spark.range(1).selectExpr("id AS `_unit`")


def number(scope: Scope, e: A.Expr | None) -> int | None:
    """A constant of SKIP or LIMIT; below 0 counts as 0."""
    if e is None:
        return None
    v = scope.compile(e)
    n = v.lit if isinstance(v.lit, int) else scope.spark.sql(f"SELECT CAST({v.sql} AS BIGINT)").first()[0]
    if n is None:
        raise QueryError("SKIP and LIMIT need an integer")
    return max(0, n)


class Aggregation:
    """Collects the aggregates of a projection and computes them in one grouping."""

    def __init__(self, scope: Scope):
        self.scope, self.found = scope, {}
        self.ranked: list[tuple[str, str, float, bool, bool]] = []
        self.empty: dict[str, str] = {}

    def need(self, e: A.Expr) -> None:
        for x in walk(e):
            if is_aggregate(x) and x not in self.found:
                self.found[x] = self.scope.fresh("agg")

    def column(self, e: A.Call, name: str):
        s, kind = self.scope, e.name.lower()
        if kind == "count" and (e.star or not e.args):
            self.empty[name] = "0L"
            return F.expr("count(1)").alias(name)
        arg = e.args[0]
        if has_aggregate(arg):
            raise QueryError("aggregates can't be nested")
        b = s.vars.get(arg.name) if isinstance(arg, A.Var) else None
        if kind == "count":
            self.empty[name] = "0L"
            cols = ", ".join(f"`{c}`" for c in b.key()) if isinstance(b, (NodeB, RelB)) else s.sql(arg)
            if e.distinct and isinstance(b, (NodeB, RelB)) and len(b.key()) > 1:
                cols = f"if(`{b.id}` IS NULL, NULL, struct({cols}))"
            elif isinstance(b, (NodeB, RelB)):
                cols = f"`{b.id}`"
            return F.expr(f"count({'DISTINCT ' if e.distinct else ''}{cols})").alias(name)
        v = s.compile(arg)
        if kind == "collect":
            t = v.type.simpleString()
            self.empty[name] = f"CAST(array() AS ARRAY<{t}>)" if t != "void" else "array()"
            if s.order and not e.distinct:
                keys = ", ".join(f"'k{i}', `{c}`" for i, (c, _) in enumerate(s.order))
                rows = f"array_sort(collect_list(named_struct({keys}, 'v', {v.sql})), (l, r) -> {_comparison(s.order)})"
            else:
                rows = f"collect_list(named_struct('v', {v.sql}))"
            out = f"transform({rows}, s -> s.v)"
            return F.expr(f"array_distinct({out})" if e.distinct else out).alias(name)
        distinct = "DISTINCT " if e.distinct else ""
        if kind in ("min", "max"):
            return F.expr(f"{kind}({v.sql})").alias(name)
        if v.kind not in ("number", "null"):
            return F.expr(f"max(CAST(NULL AS {'BIGINT' if kind == 'sum' else 'DOUBLE'}))").alias(name)
        if kind == "sum":
            return F.expr(f"sum({distinct}{v.sql})").alias(name)
        if kind == "avg":
            return F.expr(f"avg({distinct}CAST({v.sql} AS DOUBLE))").alias(name)
        if kind in ("stdev", "stdevp"):
            self.empty[name] = "0.0D"
            return F.expr(f"coalesce({'stddev_samp' if kind == 'stdev' else 'stddev_pop'}({distinct}CAST({v.sql} AS DOUBLE)), 0.0D)").alias(name)
        p = s.compile(e.args[1])
        share = p.lit if isinstance(p.lit, (int, float)) else s.spark.sql(f"SELECT CAST({p.sql} AS DOUBLE)").first()[0]
        share = 0.5 if share is None or share != share or abs(share) == float("inf") else min(1.0, max(0.0, float(share)))
        self.ranked.append((name, v.sql, share, e.distinct, kind == "percentilecont"))
        return None

    def run(self, keys: list[str], carried: list[str]) -> DataFrame:
        """Group by ``keys``; ``carried`` are columns that depend on them."""
        df = self.scope.df
        columns = [c for c in (self.column(e, n) for e, n in self.found.items()) if c is not None]
        first = [F.first(f"`{c}`").alias(c) for c in carried]
        ks = [F.col(f"`{k}`") for k in keys]
        out = df.groupBy(*ks).agg(*columns, *first) if columns or first else df.select(*ks).distinct() if keys else df.groupBy().agg(F.count(F.lit(1)).alias("_rows"))
        for name, sql, share, distinct, between in self.ranked:
            out = self._percentile(df, out, keys, name, sql, share, distinct, between)
        return out

    def _percentile(self, df: DataFrame, out: DataFrame, keys: list[str], name: str, sql: str, share: float, distinct: bool, between: bool) -> DataFrame:
        """The value at place share * (n - 1) of each group: the nearest one, or ``between`` its two neighbours.

        Values are counted first, map-side.  Where no group has more than
        BOUNDED different ones a window ranks them; elsewhere the counts are
        narrowed down by histograms, and no task holds a group.
        """
        v, ks = f"{name}_v", [f"{name}_{i}" for i in range(len(keys))] or [f"{name}_all"]
        named = [F.col(f"`{k}`").alias(x) for k, x in zip(keys, ks)] or [F.lit(0).alias(ks[0])]
        counts = df.select(*named, F.expr(f"CAST({sql} AS DOUBLE)").alias(v)).filter(F.col(v).isNotNull()).groupBy(*ks, v).agg(F.count(F.lit(1)).alias("_c"))
        counts = materialise(counts.withColumn("_c", F.lit(1).cast("bigint")) if distinct else counts, "percentile")
        most = counts.groupBy(*ks).count().agg(F.max("count")).first()[0] or 0
        place = F.lit(share) * (F.col("n") - 1)
        ranks = {"_lo": F.floor(place), "_hi": F.ceil(place)} if between else {"_lo": F.round(place)}
        if most <= BOUNDED:
            w = Window.partitionBy(*ks)
            ranked = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(v))).withColumn("n", F.sum("_c").over(w))
            at = lambda r: F.max(F.when((r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")), F.col(v)))
            hit = ranked.groupBy(*ks).agg(F.first("n").alias("n"), *[at(r).alias(x) for x, r in ranks.items()])
        else:
            size = counts.groupBy(*ks).agg(F.sum("_c").alias("n"))
            hit = size.select(*[F.col(k).alias(f"{k}_n") for k in ks], "n")
            for x, r in ranks.items():
                one = select_rank(counts, ks, [v], r + 1, weight="_c").select(*[F.col(k).alias(f"{k}{x}") for k in ks], F.col(v).alias(x))
                hit = hit.join(one, reduce(lambda a, b: a & b, [F.col(f"{k}_n").eqNullSafe(F.col(f"{k}{x}")) for k in ks]), "left")
            hit = hit.select(*[F.col(f"{k}_n").alias(k) for k in ks], "n", *ranks)
        value = F.col("_lo")
        if between:
            part = place - F.floor(place)
            value = F.when((part == 0) | (F.col("_lo") == F.col("_hi")), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part)
        hit = hit.select(*ks, value.alias(name))
        if not keys:
            return out.join(hit.drop(*ks), F.lit(True), "left")
        on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(x)) for k, x in zip(keys, ks)])
        return out.join(hit, on, "left").drop(*ks)


def _comparison(order: list[tuple[str, bool]]) -> str:
    """Comparator of two structs by k0, k1…: nulls last when ascending, first when descending."""
    out = "0"
    for i, (_, up) in reversed(list(enumerate(order))):
        k, less = f"k{i}", (-1, 1)
        null = 1 if up else -1
        low, high = less if up else less[::-1]
        out = (
            f"CASE WHEN l.{k} IS NULL AND r.{k} IS NULL THEN {out} WHEN l.{k} IS NULL THEN {null} WHEN r.{k} IS NULL THEN {-null} "
            f"WHEN l.{k} < r.{k} THEN {low} WHEN l.{k} > r.{k} THEN {high} ELSE {out} END"
        )
    return out


class Compiler:
    """Runs the reading clauses of one query against a graph."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph, params: dict | None = None):
        self.spark, self.graph, self.params = spark, graph, params or {}

    def scope(self) -> Scope:
        return Scope(self.spark, self.graph, self.params)

    # -- queries ----------------------------------------------------------
    def query(self, q: A.Query, outer: Scope | None = None) -> DataFrame:
        frames = [self.single(part, outer) for part in q.parts]
        if len(frames) == 1:
            return frames[0]
        first = frames[0].columns
        for f in frames[1:]:
            if len(f.columns) != len(first):
                raise QueryError("UNION needs equal numbers of columns")
            if set(f.columns) != set(first):
                raise QueryError("UNION needs equal column names")
        out = reduce(lambda a, b: a.unionByName(b), frames)
        return out if all(q.alls) else out.dropDuplicates()

    def single(self, clauses: tuple, outer: Scope | None = None) -> DataFrame:
        scope = outer.clone() if outer is not None else self.scope()
        if outer is not None:
            scope.hidden = list(outer.hidden)
        used = usage(clauses)
        for c in clauses:
            out = self.clause(scope, c, used)
            if isinstance(out, DataFrame):
                return out
            scope = out
        raise QueryError("RETURN is missing")

    def clause(self, scope: Scope, c, used: set[str]):
        if isinstance(c, A.Match):
            if c.optional:
                unit(scope)
                optional_match(scope, c, used)
            else:
                Matcher(scope, used | usage((c,))).match(c.pattern)
                where(scope, c.where)
            scope.order = []
            return scope
        if isinstance(c, A.Unwind):
            return self.unwind(scope, c)
        if isinstance(c, A.With):
            unit(scope)
            out = self.project(scope, c.body)
            where(out, c.where)
            return out
        if isinstance(c, A.Return):
            unit(scope)
            return self.result(self.project(scope, c.body, final=True), c.body)
        if isinstance(c, A.CallSub):
            return self.call(scope, c)
        raise QueryError(f"{type(c).__name__} can't stand in a reading query")

    def unwind(self, scope: Scope, c: A.Unwind) -> Scope:
        unit(scope)
        v = scope.compile(c.expr)
        column = scope.fresh(c.var)
        if v.kind == "null":
            scope.df = scope.df.limit(0).withColumn(column, F.lit(None).cast("string"))
        elif v.kind == "list":
            scope.df = scope.df.selectExpr("*", f"explode({v.sql}) AS `{column}`")
        else:
            scope.df = scope.df.selectExpr("*", f"{v.sql} AS `{column}`").filter(f"`{column}` IS NOT NULL")
        scope.vars[c.var], scope.order = ValB(column), []
        return scope

    def call(self, scope: Scope, c: A.CallSub) -> Scope:
        """A subquery for every row: it runs on the rows themselves, which carry a number that all its steps keep."""
        unit(scope)
        row = scope.fresh("row")
        scope.df = materialise(scope.df.withColumn(row, F.monotonically_increasing_id()), "call")
        inner = scope.clone()
        inner.hidden = [row]
        inner.root = scope.df.select(row)
        parts = []
        for part in c.query.parts:
            s = inner.clone()
            s.hidden, s.root = [row], inner.root
            used = usage(part)
            for clause in part:
                s = self.clause(s, clause, used)
            parts.append(s)
        if len(parts) > 1:
            s = reduce(lambda a, b: a.unionByName(b), parts)
            s = s if all(c.query.alls) else s.dropDuplicates()
        else:
            s = parts[0]
        names = [n for n in s.columns if n != row]
        fresh = {n: scope.fresh(n) for n in names}
        s = s.withColumnsRenamed({**fresh, row: f"{row}_in"})
        scope.df = scope.df.join(s, F.col(row) == F.col(f"{row}_in")).drop(f"{row}_in", row)
        scope.vars |= {n: ValB(x) for n, x in fresh.items()}
        return scope

    # -- projections ------------------------------------------------------
    def project(self, scope: Scope, body: A.Projection, final: bool = False) -> Scope:
        items = list(body.items)
        if body.star:
            items = [A.Item(A.Var(v), v) for v in scope.vars if v != "\0"] + items
        items = _apart_names(items)
        names = [i.name for i in items]
        if any(has_aggregate(i.expr) for i in items):
            out, source = self._grouped(scope, items, body)
        else:
            out, source = self._plain(scope, items), scope
        out.hidden = list(scope.hidden)
        if hasattr(scope, "root"):
            out.root = scope.root
        if body.distinct:
            keys = [c for b in out.vars.values() for c in b.key()] + out.hidden
            all_columns = [c for b in out.vars.values() for c in _columns(b, out)] + out.hidden
            order_ok = {A.Var(n) for n in names} | {i.expr for i in items}
            if any(e not in order_ok for e, _ in body.order):
                raise QueryError("after DISTINCT, ORDER BY can only use result columns")
            out.df = out.df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(all_columns)]).dropDuplicates(list(dict.fromkeys(keys)))
        self._sorted(out, source, items, body)
        return out

    def _plain(self, scope: Scope, items: list[A.Item]) -> Scope:
        variables, added = {}, {}
        for i in items:
            b = scope.vars.get(i.expr.name) if isinstance(i.expr, A.Var) else None
            if b is not None:
                variables[i.name] = b
                continue
            c, v = scope.fresh(i.name), scope.compile(i.expr)
            added[c] = v.sql
            variables[i.name] = ValB(c)
        out = scope.clone(None, variables)
        if added:
            out.df = scope.df.selectExpr("*", *[f"{s} AS `{c}`" for c, s in added.items()])
        else:
            out.df = scope.df
        return out

    def _grouped(self, scope: Scope, items: list[A.Item], body: A.Projection) -> tuple[Scope, Scope]:
        agg = Aggregation(scope)
        keys, carried, variables, replaced = list(scope.hidden), [], {}, {}
        added: dict[str, str] = {}
        for i in items:
            if has_aggregate(i.expr):
                agg.need(i.expr)
                continue
            b = scope.vars.get(i.expr.name) if isinstance(i.expr, A.Var) else None
            if isinstance(b, (NodeB, RelB)):
                keys += b.key()
                carried += [c for c in _columns(b, scope) if c not in b.key()]
                variables[i.name] = b
            else:
                c = scope.fresh(i.name)
                added[c] = scope.sql(i.expr)
                keys.append(c)
                variables[i.name] = ValB(c)
            replaced[i.expr] = variables[i.name]
        for e, _ in body.order:
            if has_aggregate(e):
                agg.need(e)
        # parts of mixed items without an aggregate are grouped by, too
        for i in items:
            if has_aggregate(i.expr) and not is_aggregate(i.expr):
                for x in _free_parts(i.expr, replaced):
                    c = scope.fresh("part")
                    added[c] = scope.sql(x)
                    keys.append(c)
                    replaced[x] = ValB(c)
        if added:
            scope.df = scope.df.selectExpr("*", *[f"{s} AS `{c}`" for c, s in added.items()])
        grouped = agg.run(list(dict.fromkeys(keys)), [c for c in dict.fromkeys(carried) if c not in keys])
        if scope.hidden and keys == scope.hidden and hasattr(scope, "root"):
            # rows of the outer query without any inner row still get their aggregate
            grouped = scope.root.join(grouped, scope.hidden, "left")
            for n, other in agg.empty.items():
                grouped = grouped.withColumn(n, F.expr(f"coalesce(`{n}`, {other})"))
        out = scope.clone(grouped, {})
        out.order = []
        columns = set(grouped.columns)
        out.vars = {n: b for n, b in scope.vars.items() if isinstance(b, (NodeB, RelB)) and set(b.key()) <= columns}
        out.replaced = {e: n for e, n in agg.found.items()} | {e: b.column for e, b in replaced.items() if isinstance(b, ValB)}
        post = {}
        for i in items:
            if i.name not in variables:
                c = out.fresh(i.name)
                post[c] = out.sql(i.expr)
                variables[i.name] = ValB(c)
        if post:
            out.df = out.df.selectExpr("*", *[f"{s} AS `{c}`" for c, s in post.items()])
        source = out.clone()
        source.replaced = out.replaced
        out.vars = {i.name: variables[i.name] for i in items}
        source.vars = {**source.vars, **out.vars}
        out.replaced = {}
        return out, source

    def _sorted(self, out: Scope, source: Scope, items: list[A.Item], body: A.Projection) -> None:
        """ORDER BY, SKIP and LIMIT; sort keys may use result columns and what was there before."""
        skip, limit = number(out, body.skip), number(out, body.limit)
        keys, cleared = [], []
        if body.order:
            by = Scope(out.spark, out.graph, out.params, out.df, {**source.vars, **out.vars})
            by.replaced = dict(source.replaced)
            for e, up in body.order:
                same = next((i for i in items if i.expr == e), None)
                b = out.vars.get(same.name) if same else out.vars.get(e.name) if isinstance(e, A.Var) else None
                if isinstance(b, ValB):
                    keys.append((b.column, up))
                else:
                    c = by.fresh("sort")
                    if isinstance(b, (NodeB, RelB)):
                        by.df = by.df.selectExpr("*", f"`{b.id}` AS `{c}`")
                    else:
                        sql = by.sql(e)
                        by.df = by.df.selectExpr("*", f"{sql} AS `{c}`")
                    keys.append((c, up))
                    cleared.append(c)
            out.df = by.df
        ordering = [F.col(f"`{c}`").asc_nulls_last() if up else F.col(f"`{c}`").desc_nulls_first() for c, up in keys]
        if out.hidden and (skip is not None or limit is not None):
            # for every row of the outer query
            no = out.fresh("no")
            w = Window.partitionBy(*out.hidden).orderBy(*(ordering or [F.lit(1)]))
            out.df = out.df.withColumn(no, F.row_number().over(w)).filter(f"`{no}` > {skip or 0}" + (f" AND `{no}` <= {(skip or 0) + limit}" if limit is not None else "")).drop(no)
        else:
            if ordering and not out.hidden:
                out.df = out.df.orderBy(*ordering)
            if skip:
                out.df = out.df.offset(skip)
            if limit is not None:
                out.df = out.df.limit(limit)
        out.order = keys

    def result(self, scope: Scope, body: A.Projection) -> DataFrame:
        cols = [f"{scope.whole(n).sql} AS `{n}`" for n in scope.vars if n != "\0"]
        return scope.df.selectExpr(*[f"`{h}`" for h in scope.hidden], *cols)


def _apart_names(items: list[A.Item]) -> list[A.Item]:
    """Columns called by default that share a name get a number; two equal names given by AS are an error."""
    out, taken = [], set()
    for i in items:
        name, k = i.name, 1
        while name in taken:
            if i.name != default_name(i.expr) or isinstance(i.expr, A.Var):
                raise QueryError(f"two result columns are called {i.name}")
            k += 1
            name = f"{i.name}_{k}"
        taken.add(name)
        out.append(A.Item(i.expr, name))
    return out


def _free_parts(e, replaced) -> list[A.Expr]:
    """Largest parts of an expression that use variables but hold no aggregate."""
    if is_aggregate(e) or e in replaced:
        return []
    if not has_aggregate(e):
        return [e] if any(isinstance(x, A.Var) for x in walk(e)) else []
    out = []
    for name in e.__dataclass_fields__:
        v = getattr(e, name)
        for x in v if isinstance(v, tuple) else (v,):
            if isinstance(x, A.Expr):
                out += _free_parts(x, replaced)
            elif isinstance(x, tuple):
                out += [p for y in x if isinstance(y, A.Expr) for p in _free_parts(y, replaced)]
    return out

