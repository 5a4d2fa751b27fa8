"""Expressions to SQL text.

An expression becomes a text of Spark SQL over the columns of the binding
table; Catalyst parses and optimises it.  Static types come from analysing the
text against an empty relation of the same columns, which costs no job.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.functions import pandas_udf

from quiver.functions import ALIASES, FUNCTIONS
from quiver.functions.others import cast
from quiver.functions.registry import AGGREGATES, fits
from quiver.functions.temporal import add, component, duration
from quiver.graph.property_graph import ID, LABELS, SRC, DST, TYPE, PropertyGraph, UnknownName
from quiver.lang import ast as A
from quiver.plans.values import INTEGRAL, ident, kind, literal, quoted

_numbers = itertools.count()


class QueryError(ValueError):
    """A query that is well-formed but can't be run."""


@dataclass
class NodeB:
    """A node variable held as columns: its key, the vertex tables it may come from, labels and properties."""

    id: str
    tables: tuple[str, ...]
    tab: str | None  # column that names the table, if there are several
    labels: str  # SQL
    props: dict[str, str]
    columns: list[str] = field(default_factory=list)

    def key(self) -> list[str]:
        return [self.id, *([self.tab] if self.tab else [])]


@dataclass
class RelB:
    """A relationship variable held as columns."""

    id: str
    types: tuple[str, ...]
    type: str  # SQL
    src: str
    dst: str
    props: dict[str, str]
    sources: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    columns: list[str] = field(default_factory=list)

    def key(self) -> list[str]:
        return [self.id]


@dataclass
class ValB:
    """Any other variable: one column, or a variable of a lambda."""

    column: str

    def key(self) -> list[str]:
        return [self.column]


class Val:
    """An expression: its SQL, and its type when asked for."""

    __slots__ = ("sql", "scope", "_type", "lit")

    def __init__(self, sql: str, scope: Scope, type_: T.DataType | None = None, lit: Any = None):
        self.sql, self.scope, self._type, self.lit = sql, scope, type_, lit

    @property
    def type(self) -> T.DataType:
        if self._type is None:
            self._type = self.scope.type_of(self.sql)
        return self._type

    @property
    def kind(self) -> str:
        return kind(self.type)


class Scope:
    """A binding table and its variables."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph, params: dict, df: DataFrame | None = None, variables: dict | None = None, hidden: list[str] | None = None):
        self.spark, self.graph, self.params = spark, graph, params
        self.parts: list[DataFrame] = []  # tables whose product the rows are
        self.across: list[str] = []  # conditions on columns of several of them
        self.df, self.vars = df, dict(variables or {})
        self.hidden = list(hidden or [])  # columns of an outer query that every step keeps
        self.order: list[tuple[str, bool]] = []  # columns by which the rows were sorted last
        self.locals: dict[str, T.DataType] = {}  # variables of lambdas
        self.replaced: dict[A.Expr, str] = {}  # expressions that have a column
        self.called = ""
        self._frame: tuple[Any, DataFrame] | None = None
        self._types: dict[str, T.DataType] = {}

    # -- rows --------------------------------------------------------------
    @property
    def df(self) -> DataFrame | None:
        """The rows; tables that stood apart are multiplied."""
        if len(self.parts) > 1:
            self.df = reduce(lambda d, c: d.filter(c), self.across, reduce(lambda a, b: a.crossJoin(b), self.parts))
        return self.parts[0] if self.parts else None

    @df.setter
    def df(self, df: DataFrame | None) -> None:
        self.parts, self.across = [] if df is None else [df], []

    def keep(self, sql: str, wait: bool) -> None:
        """Filter a table that stands apart by a condition on it alone; one on several waits for their product, or brings it about."""
        on = [i for i, p in enumerate(self.parts) if any(f"`{c}`" in sql for c in p.columns)]
        if len(on) == 1:
            self.parts[on[0]] = self.parts[on[0]].filter(sql)
        elif len(on) > 1 and wait:
            self.across.append(sql)
        else:
            self.df = self.df.filter(sql)

    # -- columns and types ------------------------------------------------
    def clone(self, df: DataFrame | None = None, variables: dict | None = None) -> Scope:
        s = Scope(self.spark, self.graph, self.params, df, self.vars if variables is None else variables, self.hidden)
        if df is None:
            s.parts, s.across = list(self.parts), list(self.across)
        s.order = list(self.order)
        return s

    def fresh(self, name: str) -> str:
        return f"{re.sub(r'[^A-Za-z0-9_]', '_', name)}__{next(_numbers)}"

    def val(self, sql: str, type_: T.DataType | None = None) -> Val:
        return Val(sql, self, type_)

    def type_of(self, sql: str) -> T.DataType:
        if sql == "NULL":
            return T.NullType()
        key = (tuple(map(id, self.parts)), tuple(self.locals))
        if self._frame is None or self._frame[0] != key:
            own = [f for p in self.parts for f in p.schema.fields]
            schema = T.StructType(own + [T.StructField(n, t) for n, t in self.locals.items()])
            self._frame, self._types = (key, self.spark.createDataFrame([], schema)), {f"`{f.name}`": f.dataType for f in schema.fields}
        if sql not in self._types:
            self._types[sql] = self._frame[1].selectExpr(f"{sql} AS v").schema[0].dataType
        return self._types[sql]

    # -- what the functions ask for --------------------------------------
    def udf(self, name: str, run, returns: str) -> str:
        """A registered pandas UDF; it runs on Arrow batches."""
        full = f"quiver_{name}"
        if not self.spark.catalog.functionExists(full):
            import pandas as pd

            run.__annotations__ = {k: pd.Series for k in run.__code__.co_varnames[: run.__code__.co_argcount]} | {"return": pd.Series}
            self.spark.udf.register(full, pandas_udf(run, returns))
        return full

    def good_pattern(self, pattern: str) -> bool:
        try:
            self.spark._jvm.java.util.regex.Pattern.compile(pattern)
            return True
        except Exception:
            return False

    def has_function(self, name: str) -> bool:
        return self.spark.catalog.functionExists(name)

    # -- variables --------------------------------------------------------
    def whole(self, name: str) -> Val:
        """A variable as one value; nodes and relationships as structs."""
        b = self.vars.get(name)
        if b is None:
            raise QueryError(f"unknown variable {name}")
        if isinstance(b, ValB):
            return self.val(f"`{b.column}`", self.locals.get(b.column))
        if isinstance(b, NodeB):
            return self.val(f"if(`{b.id}` IS NULL, NULL, {node_struct(b)})")
        head = f"'{ID}', `{b.id}`, '{TYPE}', {b.type}, '{SRC}', `{b.src}`, '{DST}', `{b.dst}`"
        return self.val(f"if(`{b.id}` IS NULL, NULL, named_struct({head}" + "".join(f", {quoted(k)}, `{c}`" for k, c in b.props.items()) + "))")

    def endpoint(self, v: Val, which: str) -> str:
        return f"{v.sql}.{which}" if v.kind == "edge" else "NULL"

    def _property(self, of: Val, key: str) -> str:
        k = of.kind
        if k == "null":
            return "NULL"
        if k in ("date", "datetime", "localdatetime", "duration", "time", "localtime"):
            return component(of.sql, k, key.lower()) or "NULL"
        if k == "point":
            known = {"x": "x", "y": "y", "z": "z", "srid": "srid", "longitude": "x", "latitude": "y", "height": "z"}
            if key == "crs":
                return f"CASE {of.sql}.srid WHEN 7203 THEN 'cartesian' WHEN 9157 THEN 'cartesian-3D' WHEN 4326 THEN 'WGS-84' WHEN 4979 THEN 'WGS-84-3D' END"
            return f"{of.sql}.{known[key]}" if key in known else "NULL"
        if isinstance(of.type, T.StructType):
            return f"{of.sql}.{ident(key)}" if key in of.type.names else "NULL"
        if isinstance(of.type, T.MapType):
            return f"{of.sql}[{quoted(key)}]"
        if k == "any":
            return f"try_variant_get({of.sql}, {quoted('$.' + key)}, 'variant')"
        return "NULL"

    # -- expressions ------------------------------------------------------
    def sql(self, e: A.Expr) -> str:
        return self.compile(e).sql

    def compile(self, e: A.Expr) -> Val:
        if self.replaced and e in self.replaced:
            return self.val(f"`{self.replaced[e]}`")
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def boolean(self, v: Val) -> str:
        """Truth of a value: null and boolean as they are, anything else is true."""
        if v.kind == "null":
            return "CAST(NULL AS BOOLEAN)"
        return v.sql if v.kind == "bool" else f"({v.sql} IS NOT NULL)"

    def _lit(self, e: A.Lit) -> Val:
        types = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}
        return Val(literal(e.value), self, types.get(type(e.value)), e.value)

    def _param(self, e: A.Param) -> Val:
        v = self.params.get(e.name)
        return Val(literal(v), self, None, list(v) if isinstance(v, (list, tuple)) else v)

    def _var(self, e: A.Var) -> Val:
        return self.whole(e.name)

    def _prop(self, e: A.Prop) -> Val:
        if isinstance(e.of, A.Var) and (b := self.vars.get(e.of.name)) is not None and not isinstance(b, ValB):
            if e.key in b.props:
                return self.val(f"`{b.props[e.key]}`")
            if e.key not in self.graph.property_keys() and (self.graph.nodes or self.graph.edges) and self.graph.property_keys():
                raise UnknownName(f"unknown property {e.key}")
            return self.val("NULL")
        return self.val(self._property(self.compile(e.of), e.key))

    def _index(self, e: A.Index) -> Val:
        of, at = self.compile(e.of), self.compile(e.at)
        if of.kind == "list":
            n = f"size({of.sql})"
            i = str(at.lit) if isinstance(at.lit, int) and at.lit >= 0 else f"CAST(if({at.sql} < 0, if({at.sql} + {n} < 0, {n}, {at.sql} + {n}), least({at.sql}, {n})) AS INT)"
            return self.val(f"get({of.sql}, {i})")
        if isinstance(at.lit, str):
            return self.val(self._property(of, at.lit))
        if isinstance(of.type, T.MapType):
            return self.val(f"{of.sql}[{at.sql}]")
        if isinstance(of.type, T.StructType):
            return self.val(FUNCTIONS["map.get"].build(self, [of, at]))
        return self.val("NULL")

    def _slice(self, e: A.Slice) -> Val:
        of = self.compile(e.of)
        if of.kind not in ("list", "string"):
            return self.val("NULL")
        n = f"{'size' if of.kind == 'list' else 'length'}({of.sql})"
        edge = lambda x, other: f"CAST(least(greatest({self.sql(x)}, 0), {n}) AS INT)" if x is not None else other
        start, stop = edge(e.start, "0"), edge(e.stop, n)
        return self.val(f"{'slice' if of.kind == 'list' else 'substr'}({of.sql}, {start} + 1, greatest({stop} - {start}, 0))")

    def _cast(self, e: A.Cast) -> Val:
        return self.val(f"({cast(self, self.compile(e.of), e.to, e.strict)})")

    def _mapprojection(self, e: A.MapProjection) -> Val:
        of, out = self.compile(e.of), {}
        for item in e.items:
            if item[0] == "*":
                out |= {n: f"{of.sql}.{ident(n)}" for n in getattr(of.type, "names", []) if not n.startswith("_")}
            elif item[0] == ".":
                out[item[1]] = self.sql(A.Prop(e.of, item[1]))
            else:
                out[item[1]] = self.sql(item[2])
        body = "named_struct(" + ", ".join(f"{quoted(k)}, {v}" for k, v in out.items()) + ")" if out else "map()"
        return self.val(f"if({of.sql} IS NULL, NULL, {body})")

    def _unary(self, e: A.Unary) -> Val:
        v = self.compile(e.of)
        if e.op == "NOT":
            return self.val(f"(NOT {self.boolean(v)})" if v.kind != "null" else "CAST(NULL AS BOOLEAN)", T.BooleanType())
        return self.val(f"(- {v.sql})" if v.kind in ("number", "null") else "NULL")

    def _isnull(self, e: A.IsNull) -> Val:
        b = self.vars.get(e.of.name) if isinstance(e.of, A.Var) else None
        sql = f"`{b.id}`" if isinstance(b, (NodeB, RelB)) else self.sql(e.of)
        return self.val(f"({sql} IS {'NOT ' if e.negated else ''}NULL)", T.BooleanType())

    def _binary(self, e: A.Binary) -> Val:
        op = e.op
        if op in ("AND", "OR", "XOR"):
            x, y = self.boolean(self.compile(e.left)), self.boolean(self.compile(e.right))
            return self.val(f"(CAST({x} AS BOOLEAN) <> CAST({y} AS BOOLEAN))" if op == "XOR" else f"({x} {op} {y})", T.BooleanType())
        if op in ("=", "<>"):
            same = self._identity(e.left, e.right)
            if same is not None:
                return self.val(same if op == "=" else f"(NOT {same})", T.BooleanType())
        x, y = self.compile(e.left), self.compile(e.right)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return self.val(self._compare(op, x, y), T.BooleanType())
        if op == "IN":
            return self.val(self._in(x, y, e.right), T.BooleanType())
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            if op == "CONTAINS" and x.kind == "list":
                return self.val(f"if({x.sql} IS NULL OR {y.sql} IS NULL, NULL, exists({x.sql}, v -> v <=> {y.sql}))", T.BooleanType())
            if x.kind != "string" or y.kind != "string":
                return self.val("CAST(NULL AS BOOLEAN)", T.BooleanType())
            return self.val(f"{ {'STARTS WITH': 'startswith', 'ENDS WITH': 'endswith', 'CONTAINS': 'contains'}[op]}({x.sql}, {y.sql})", T.BooleanType())
        if op == "=~":
            if x.kind != "string" or y.kind != "string" or isinstance(y.lit, str) and not self.good_pattern(y.lit):
                return self.val("CAST(NULL AS BOOLEAN)", T.BooleanType())
            pattern = quoted(f"^(?:{y.lit})$") if isinstance(y.lit, str) else f"concat('^(?:', {y.sql}, ')$')"
            return self.val(f"rlike({x.sql}, {pattern})", T.BooleanType())
        return self.val(self._arithmetic(op, x, y))

    def _identity(self, left: A.Expr, right: A.Expr) -> str | None:
        """Equality of two node or relationship variables by key."""
        if not (isinstance(left, A.Var) and isinstance(right, A.Var)):
            return None
        b = self.vars.get(left.name), self.vars.get(right.name)
        if all(isinstance(x, NodeB) for x in b):
            if not set(b[0].tables) & set(b[1].tables):
                return f"if(`{b[0].id}` IS NULL OR `{b[1].id}` IS NULL, NULL, false)"
            tabs = [f"`{x.tab}`" if x.tab else quoted(x.tables[0]) for x in b]
            also = f" AND {tabs[0]} = {tabs[1]}" if b[0].tab or b[1].tab else ""
            return f"(`{b[0].id}` = `{b[1].id}`{also})"
        if all(isinstance(x, RelB) for x in b):
            return f"(`{b[0].id}` = `{b[1].id}` AND {b[0].type} = {b[1].type})"
        return None

    def _compare(self, op: str, x: Val, y: Val) -> str:
        k = {x.kind, y.kind}
        if "null" in k:
            return "CAST(NULL AS BOOLEAN)"
        if "any" in k and len(k) == 2:
            other = next(v for v in (x, y) if v.kind != "any")
            fixed = [v.sql if v.kind != "any" else f"try_cast({v.sql} AS {other.type.simpleString()})" for v in (x, y)]
            return f"({fixed[0]} {op} {fixed[1]})"
        if k == {"any"}:
            return f"(CAST({x.sql} AS STRING) {op} CAST({y.sql} AS STRING))"
        if k == {"datetime", "localdatetime"} or len(k) > 1:
            return f"if({x.sql} IS NULL OR {y.sql} IS NULL, NULL, {'true' if op == '<>' else 'false'})"
        if op in ("=", "<>"):
            if k in ({"node"}, {"edge"}):
                return f"({x.sql}._id {op} {y.sql}._id)"
            if isinstance(x.type, T.MapType):
                return f"(array_sort(map_entries({x.sql})) {op} array_sort(map_entries({y.sql})))"
            if k == {"map"} and x.type != y.type:
                if sorted(x.type.names) != sorted(y.type.names):
                    return f"if({x.sql} IS NULL OR {y.sql} IS NULL, NULL, {'true' if op == '<>' else 'false'})"
                return f"(to_json({x.sql}) {op} to_json({y.sql}))"
            if k == {"list"}:
                inner = {kind(x.type.elementType), kind(y.type.elementType)}
                if len(inner) > 1 and "null" not in inner:
                    return f"if({x.sql} IS NULL OR {y.sql} IS NULL, NULL, (size({x.sql}) = 0 AND size({y.sql}) = 0) = {'false' if op == '<>' else 'true'})"
            return f"({x.sql} {op} {y.sql})"
        if k == {"duration"}:
            length = lambda d: f"({d}.months * 2629800 + {d}.days * 86400 + {d}.seconds + {d}.nanos / 1e9D)"
            return f"({length(x.sql)} {op} {length(y.sql)})"
        if k <= {"number", "string", "bool", "date", "datetime"}:
            return f"({x.sql} {op} {y.sql})"
        return f"if({x.sql} IS NULL OR {y.sql} IS NULL, NULL, false)"

    def _in(self, x: Val, y: Val, source: A.Expr) -> str:
        items = source.items if isinstance(source, A.ListLit) else None
        if items is None and isinstance(y.lit, list):
            items = tuple(A.Lit(v) for v in y.lit)
        if x.kind == "null" or y.kind == "null":
            return "CAST(NULL AS BOOLEAN)"
        if items is not None and all(isinstance(i, A.Lit) for i in items):
            same = [i for i in items if i.value is not None and kind(self._lit(i).type) == x.kind]
            inside = f"{x.sql} IN ({', '.join(literal(i.value) for i in same)})" if same else "false"
            return f"({inside})" if same else f"if({x.sql} IS NULL, NULL, false)"
        if y.kind != "list":
            return "CAST(NULL AS BOOLEAN)"
        inner = kind(y.type.elementType)
        if inner == "node" and x.kind == "node" or inner == "edge" and x.kind == "edge":
            return f"exists({y.sql}, v -> v._id = {x.sql}._id)"
        if inner != x.kind and inner != "any":
            return f"if({x.sql} IS NULL OR {y.sql} IS NULL, NULL, false)"
        if inner == "any":
            return f"if({x.sql} IS NULL, NULL, coalesce(exists({y.sql}, v -> try_cast(v AS {x.type.simpleString()}) = {x.sql}), false))"
        return f"if({x.sql} IS NULL, NULL, coalesce(array_contains({y.sql}, {x.sql}), if({y.sql} IS NULL, NULL, false)))"

    def _arithmetic(self, op: str, x: Val, y: Val) -> str:
        k = (x.kind, y.kind)
        if "null" in k:
            return "NULL"
        whole = all(isinstance(v.type, INTEGRAL) for v in (x, y))
        if k == ("number", "number"):
            if op in ("+", "-", "*"):
                if whole:
                    return f"(CAST({x.sql} AS BIGINT) {op} CAST({y.sql} AS BIGINT))" if not all(isinstance(v.type, T.LongType) for v in (x, y)) else f"({x.sql} {op} {y.sql})"
                return f"({x.sql} {op} {y.sql})"
            if op == "/":
                return f"try_divide(CAST({x.sql} AS DOUBLE), CAST({y.sql} AS DOUBLE))"
            if op == "%":
                return f"try_mod({x.sql}, {y.sql})" if whole else "CAST(NULL AS BIGINT)"
            power = f"power({x.sql}, {y.sql})"
            finite = f"if(abs({power}) < CAST('Infinity' AS DOUBLE), {power}, NULL)"
            if whole and isinstance(y.lit, int) and y.lit >= 0:
                return f"try_cast({finite} AS BIGINT)"
            return finite
        if op == "+":
            if k == ("string", "string"):
                return f"concat({x.sql}, {y.sql})"
            if "list" in k:
                name = "list.concat" if k == ("list", "list") else "list.append" if k[0] == "list" else "list.prepend"
                return FUNCTIONS[name].build(self, [x, y] if k[0] == "list" else [y, x])
            if k == ("duration", "duration"):
                return FUNCTIONS["temporal.add"].build(self, [x, y])
            if k[1] == "duration" and k[0] in ("date", "datetime", "localdatetime"):
                return add(x.sql, y.sql, k[0])
            if k[0] == "duration" and k[1] in ("date", "datetime", "localdatetime"):
                return add(y.sql, x.sql, k[1])
        if op == "-":
            if k == ("date", "date"):
                return f"if({x.sql} IS NULL OR {y.sql} IS NULL, NULL, {duration('0L', f'datediff({x.sql}, {y.sql})')})"
            if k[0] == k[1] and k[0] in ("datetime", "localdatetime"):
                return FUNCTIONS["temporal.between"].build(self, [y, x])
            if k[1] == "duration" and k[0] in ("date", "datetime", "localdatetime"):
                return add(x.sql, y.sql, k[0], -1)
            if k == ("duration", "duration"):
                return "named_struct(" + ", ".join(f"'{f}', {x.sql}.{f} - {y.sql}.{f}" for f in ("months", "days", "seconds", "nanos")) + ")"
        if op == "*" and set(k) == {"duration", "number"}:
            d, n = (x, y) if k[0] == "duration" else (y, x)
            return "named_struct(" + ", ".join(f"'{f}', CAST({d.sql}.{f} * {n.sql} AS BIGINT)" for f in ("months", "days", "seconds", "nanos")) + ")"
        return "NULL"

    def _case(self, e: A.Case) -> Val:
        out = "CASE"
        for test, result in e.whens:
            if e.subject is not None:
                x, y = self.compile(e.subject), self.compile(test)
                same = f"({x.sql} <=> {y.sql})" if x.kind == y.kind or "null" in (x.kind, y.kind) else "false"
                out += f" WHEN {same} THEN {self.sql(result)}"
            else:
                out += f" WHEN {self.boolean(self.compile(test))} THEN {self.sql(result)}"
        return self.val(out + (f" ELSE {self.sql(e.otherwise)}" if e.otherwise is not None else "") + " END")

    def _listlit(self, e: A.ListLit) -> Val:
        items = [self.compile(i) for i in e.items]
        kinds = {v.kind for v in items} - {"null"}
        lit_ = [v.lit for v in items] if all(isinstance(i, A.Lit) for i in e.items) else None
        if len(kinds) > 1:
            as_variant = lambda v: f"to_variant_object({v.sql})" if v.kind in ("list", "map", "node", "edge") else f"CAST({v.sql} AS VARIANT)"
            return Val(f"array({', '.join(map(as_variant, items))})", self, None, lit_)
        return Val(f"array({', '.join(v.sql for v in items)})", self, None, lit_)

    def _maplit(self, e: A.MapLit) -> Val:
        if not e.items:
            return self.val("map()")
        return self.val("named_struct(" + ", ".join(f"{quoted(k)}, {self.sql(v)}" for k, v in e.items) + ")")

    # -- lambdas ----------------------------------------------------------
    def local(self, names: dict[str, T.DataType], build):
        """``build`` run with variables of a lambda; it gets their SQL names."""
        old_vars, old_locals = dict(self.vars), dict(self.locals)
        fresh = {n: f"_l{next(_numbers)}" for n in names}
        for n, t in names.items():
            self.vars[n], self.locals[fresh[n]] = ValB(fresh[n]), t
        try:
            return build(*fresh.values())
        finally:
            self.vars, self.locals = old_vars, old_locals

    def _source(self, e: A.Expr) -> Val | None:
        v = self.compile(e)
        return v if v.kind == "list" else None

    def _asks_graph(self, *parts) -> bool:
        """Whether parts of a list expression need the graph for each element."""
        return not self.locals and any(isinstance(x, (A.Exists, A.PatternComp)) for x in walk(parts))

    def _spread(self, var: str, v: Val, condition: A.Expr | None, result: A.Expr | None) -> str:
        """A column with the list of ``result`` for the elements of ``v`` that meet ``condition``, in order.

        The elements become rows, patterns are matched from them as from any
        rows, and they come together again by the number of their row.
        """
        from pyspark.sql import functions as F

        from quiver.plans.compiler import where
        from quiver.workdir import materialise

        row, at, item, out = (self.fresh(n) for n in ("row", "at", var, "list"))
        self.df = materialise(self.df.withColumn(row, F.monotonically_increasing_id()), "elements")
        inner = self.clone(self.df.selectExpr("*", f"posexplode({v.sql}) AS (`{at}`, `{item}`)"))
        inner.vars[var] = ValB(item)
        where(inner, condition)
        value = inner.sql(result) if result is not None else f"`{item}`"
        rows = inner.df.selectExpr(f"`{row}` AS `{out}_row`", f"named_struct('at', `{at}`, 'v', {value}) AS `{out}_v`")
        kind_ = rows.schema[f"{out}_v"].dataType.fields[1].dataType.simpleString()
        lists = rows.groupBy(f"{out}_row").agg(F.expr(f"transform(array_sort(collect_list(`{out}_v`), (l, r) -> l.at - r.at), s -> s.v)").alias(out))
        joined = self.df.join(lists, F.col(row) == F.col(f"{out}_row"), "left").drop(f"{out}_row", row)
        self.df = joined.withColumn(out, F.expr(f"if({v.sql} IS NULL, NULL, coalesce(`{out}`, CAST(array() AS ARRAY<{kind_}>)))"))
        return f"`{out}`"

    def _listcomp(self, e: A.ListComp) -> Val:
        v = self._source(e.source)
        if v is None:
            return self.val("NULL")
        if self._asks_graph(e.where, e.result):
            return self.val(self._spread(e.var, v, e.where, e.result))

        def build(x):
            out = v.sql
            if e.where is not None:
                out = f"filter({out}, {x} -> coalesce({self.boolean(self.compile(e.where))}, false))"
            if e.result is not None:
                out = f"transform({out}, {x} -> {self.sql(e.result)})"
            return out

        return self.val(self.local({e.var: v.type.elementType}, build))

    def _quantified(self, e: A.Quantified) -> Val:
        v = self._source(e.source)
        if v is None:
            return self.val("CAST(NULL AS BOOLEAN)", T.BooleanType())
        asked = self._asks_graph(e.where)
        if asked:
            v = self.val(self._spread(e.var, v, None, e.where))

        def build(x):
            test = f"{x} -> coalesce({x if asked else self.boolean(self.compile(e.where))}, false)"
            return {
                "any": f"exists({v.sql}, {test})", "all": f"forall({v.sql}, {test})", "none": f"(NOT exists({v.sql}, {test}))",
                "single": f"(size(filter({v.sql}, {test})) = 1)",
            }[e.kind]

        return self.val(f"if({v.sql} IS NULL, NULL, {self.local({e.var: v.type.elementType}, build)})", T.BooleanType())

    def _reduce(self, e: A.Reduce) -> Val:
        v, start = self._source(e.source), self.compile(e.start)
        if v is None:
            return self.val("NULL")
        t = start.type
        for _ in range(2):  # the accumulator may widen from integer to float
            body = self.local({e.acc: t, e.var: v.type.elementType}, lambda a, x: (self.sql(e.body), self.compile(e.body).type, a, x))
            if body[1] == t or isinstance(body[1], T.NullType):
                break
            t = body[1]
        name = t.simpleString()
        return self.val(f"aggregate({v.sql}, CAST({start.sql} AS {name}), ({body[2]}, {body[3]}) -> CAST({body[0]} AS {name}))")

    # -- calls ------------------------------------------------------------
    def _call(self, e: A.Call) -> Val:
        name = e.name.lower()
        if name in AGGREGATES:
            raise QueryError(f"{e.name} is an aggregate and can't stand here")
        self.called, full = name, ALIASES.get(name, name)
        f = FUNCTIONS.get(full)
        if f is None:
            raise QueryError(f"unknown function {e.name}")
        args = e.args
        if full.partition(".")[0] in ("vector", "cast", "type") and len(args) > 1 and isinstance(args[-1], A.Var) and args[-1].name not in self.vars:
            args = (*args[:-1], A.Lit(args[-1].name))  # a bare word that names a metric or a type
        if full in ("type.of", "type.is") and args and isinstance(args[0], A.Cast) and args[0].to.startswith("VECTOR"):
            name_of = A.Lit(args[0].to.replace("<INT>", "<INTEGER>"))
            return self.compile(name_of if full == "type.of" else A.Binary("IN", args[1], A.ListLit((name_of, A.Lit("VECTOR"), A.Lit("ANY")))))
        if not f.low <= len(args) + (full in ("cast.to", "cast.try") and name not in (full, "type.cast", "type.try_cast")) <= f.high:
            raise QueryError(f"{e.name} takes {f.low} to {f.high} arguments, not {len(args)}")
        fast = self._direct(full, args)
        if fast is not None:
            return self.val(fast)
        values = [self.compile(a) for a in args]
        self.called = name
        if not fits(f, values):
            return self.val("NULL")
        return self.val(f"({f.build(self, values)})")

    def _direct(self, full: str, args: tuple) -> str | None:
        """Functions of a node or relationship variable that need only some of its columns."""
        if len(args) < 1 or not isinstance(args[0], A.Var):
            return None
        b = self.vars.get(args[0].name)
        if isinstance(b, NodeB):
            if full in ("node.id", "value.id"):
                return f"`{b.id}`"
            if full == "node.labels":
                return f"if(`{b.id}` IS NULL, NULL, {b.labels})"
            if full == "node.has_label":
                return f"if(`{b.id}` IS NULL, NULL, array_contains({b.labels}, {self.sql(args[1])}))"
        if isinstance(b, RelB):
            if full in ("edge.id", "value.id"):
                return f"`{b.id}`"
            if full == "edge.type":
                return f"if(`{b.id}` IS NULL, NULL, {b.type})"
            if full in ("edge.start", "edge.end"):
                return self._hydrate(b, full == "edge.start")
        return None

    def _hydrate(self, b: RelB, start: bool) -> str:
        """The node at an end of a relationship, by a join with its vertex table."""
        from quiver.plans.patterns import scan_nodes

        tables = b.sources if start else b.targets
        if len(set(tables)) != 1 or self.locals:
            return f"`{b.src if start else b.dst}`"
        df, nb = scan_nodes(self, [self.graph.node_table(tables[0])], "end")
        column = self.fresh("end")
        nodes = df.selectExpr(f"`{nb.id}` AS `{column}_id`", f"{node_struct(nb)} AS `{column}`")
        self.df = self.df.join(nodes, self.df[b.src if start else b.dst] == nodes[f"{column}_id"], "left").drop(f"{column}_id")
        return f"`{column}`"

    def _exists(self, e: A.Exists) -> Val:
        from quiver.plans.patterns import flag_exists

        return self.val(f"`{flag_exists(self, e)}`", T.BooleanType())

    def _patterncomp(self, e: A.PatternComp) -> Val:
        from quiver.plans.patterns import collect_pattern

        return self.val(f"`{collect_pattern(self, e)}`")


def node_struct(b: NodeB, fields: dict[str, str] | None = None) -> str:
    """A node as a struct; ``fields``: property -> type that the struct must have."""
    props = [(k, f"`{c}`") for k, c in b.props.items()] if fields is None else [(k, f"CAST({f'`{b.props[k]}`' if k in b.props else 'NULL'} AS {t})") for k, t in fields.items()]
    return f"named_struct('{ID}', `{b.id}`, '{LABELS}', {b.labels}" + "".join(f", {quoted(k)}, {s}" for k, s in props) + ")"


def walk(e):
    """All expressions within an expression or clause, itself included."""
    if isinstance(e, (tuple, list)):
        for x in e:
            yield from walk(x)
    elif hasattr(e, "__dataclass_fields__"):
        yield e
        for name in e.__dataclass_fields__:
            yield from walk(getattr(e, name))
