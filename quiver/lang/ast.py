"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    key: str


@dataclass(frozen=True)
class Index(Expr):
    of: Expr
    at: Expr


@dataclass(frozen=True)
class Slice(Expr):
    of: Expr
    start: Expr | None
    stop: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    of: Expr
    to: str
    strict: bool = True


@dataclass(frozen=True)
class MapProjection(Expr):
    of: Expr
    items: tuple  # ("*",) | (".", key) | (":", key, expr)


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    of: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    of: Expr
    negated: bool


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    whens: tuple
    otherwise: Expr | None


@dataclass(frozen=True)
class ListLit(Expr):
    items: tuple


@dataclass(frozen=True)
class MapLit(Expr):
    items: tuple  # (key, expr)


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class ListComp(Expr):
    var: str
    source: Expr
    where: Expr | None
    result: Expr | None


@dataclass(frozen=True)
class Quantified(Expr):
    kind: str  # any, all, none, single
    var: str
    source: Expr
    where: Expr


@dataclass(frozen=True)
class Reduce(Expr):
    acc: str
    start: Expr
    var: str
    source: Expr
    body: Expr


@dataclass(frozen=True)
class Exists(Expr):
    pattern: tuple
    where: Expr | None


@dataclass(frozen=True)
class PatternComp(Expr):
    pattern: Any
    where: Expr | None
    result: Expr


# -- patterns -------------------------------------------------------------
@dataclass(frozen=True)
class NodeP:
    var: str | None
    labels: tuple  # AND of OR groups
    props: Any  # MapLit | Param | None


@dataclass(frozen=True)
class RelP:
    var: str | None
    types: tuple
    direction: str  # out, in, both
    length: tuple | None  # (low, high or None)
    props: Any


@dataclass(frozen=True)
class PathP:
    var: str | None
    nodes: tuple
    rels: tuple
    shortest: str | None = None  # one, all


# -- clauses --------------------------------------------------------------
@dataclass(frozen=True)
class Item:
    expr: Expr
    name: str


@dataclass(frozen=True)
class Projection:
    items: tuple
    star: bool
    distinct: bool
    order: tuple  # (expr, ascending)
    skip: Expr | None
    limit: Expr | None


@dataclass(frozen=True)
class Match:
    pattern: tuple
    where: Expr | None
    optional: bool


@dataclass(frozen=True)
class Unwind:
    expr: Expr
    var: str


@dataclass(frozen=True)
class With:
    body: Projection
    where: Expr | None


@dataclass(frozen=True)
class Return:
    body: Projection


@dataclass(frozen=True)
class CallSub:
    query: Any


@dataclass(frozen=True)
class Create:
    pattern: tuple


@dataclass(frozen=True)
class Merge:
    path: PathP
    on_match: tuple
    on_create: tuple


@dataclass(frozen=True)
class SetItem:
    kind: str  # prop, replace, merge, labels
    var: str
    path: tuple = ()
    value: Any = None
    labels: tuple = ()


@dataclass(frozen=True)
class Set_:
    items: tuple


@dataclass(frozen=True)
class Remove:
    items: tuple  # SetItem of kind prop (value None) or labels


@dataclass(frozen=True)
class Delete:
    exprs: tuple
    detach: bool


@dataclass(frozen=True)
class Foreach:
    var: str
    source: Expr
    body: tuple


@dataclass(frozen=True)
class Query:
    parts: tuple  # of clause tuples
    alls: tuple = field(default=())  # True where UNION ALL


@dataclass(frozen=True)
class Procedure:
    name: str
    args: tuple
    yields: tuple | None  # (name, alias) or ("*",)


@dataclass(frozen=True)
class Schema:
    """Index and constraint commands; ``what`` says which, ``info`` holds the rest."""

    what: str
    info: dict = field(hash=False)
