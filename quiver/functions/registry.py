"""Where the functions of the language are entered: name, arity, argument kinds and SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from quiver.plans.values import INTEGRAL, kind

MANY = 99


@dataclass(frozen=True)
class Function:
    """kinds: one letter for each argument, the last one for all further ones; an argument of another kind gives null.

    a anything, s string, n number, i integer, l list, m map, b boolean,
    y binary, t string or binary, d date or datetime, p point, g duration.
    """

    name: str
    low: int
    high: int
    kinds: str
    build: Callable[[Any, list], str]


FUNCTIONS: dict[str, Function] = {}
_FITS = {
    "s": {"string"}, "n": {"number"}, "i": {"number"}, "l": {"list"}, "m": {"map"}, "b": {"bool"}, "y": {"binary"}, "t": {"string", "binary"},
    "d": {"date", "datetime", "localdatetime"}, "p": {"point"}, "g": {"duration"},
}


def template(name: str, kinds: str, text: str, low: int | None = None) -> None:
    """A function whose SQL is ``text`` with {0}, {1}… for its arguments."""
    FUNCTIONS[name] = Function(name, len(kinds) if low is None else low, len(kinds), kinds, lambda c, a: text.format(*[x.sql for x in a]))


def function(name: str, kinds: str, low: int | None = None, high: int | None = None):
    """Decorator for a function built by Python code from the context and its arguments."""

    def enter(build):
        FUNCTIONS[name] = Function(name, len(kinds) if low is None else low, len(kinds) if high is None else high, kinds, build)
        return build

    return enter


def fits(f: Function, args: list) -> bool:
    for i, a in enumerate(args):
        want = f.kinds[min(i, len(f.kinds) - 1)] if f.kinds else "a"
        if want == "a":
            continue
        if a.kind not in _FITS[want]:
            return False
        if want == "i" and not isinstance(a.type, INTEGRAL):
            return False
    return True


#: fixed values: other names of functions
ALIASES = {
    "list.find_index": "list.index_of", "list.find_indexes": "list.indexes_of", "vector.dim": "vector.dimension",
    "value.first_non_null": "value.coalesce", "type.cast": "cast.to", "type.try_cast": "cast.try", "type.can_cast": "cast.can",
    "now": "temporal.now", "datetime": "temporal.now", "date": "temporal.now", "time": "temporal.now", "localdatetime": "temporal.now",
    "localtime": "temporal.now", "duration": "temporal.now", "point": "geo.point", "timestamp": "temporal.timestamp",
    "timezone": "temporal.timezone", "new": "uuid.new", "random": "math.random", "rand": "math.random", "range": "list.range",
    "head": "list.first", "last": "list.last", "coalesce": "value.coalesce", "tolower": "string.lower", "toupper": "string.upper",
    "left": "string.prefix", "right": "string.suffix", "substring": "string.slice", "reverse": "value.reverse", "size": "value.size",
    "length": "path.length", "keys": "value.keys", "properties": "value.properties", "id": "value.id", "labels": "node.labels",
    "type": "edge.type", "randomuuid": "uuid.new", "tostring": "cast.to", "tointeger": "cast.to", "tofloat": "cast.to",
    "toboolean": "cast.to", "tointegerornull": "cast.try", "tofloatornull": "cast.try", "tobooleanornull": "cast.try", "tostringornull": "cast.try",
}
#: names that are common elsewhere
ALIASES |= {"nodes": "path.nodes", "relationships": "path.edges", "startnode": "edge.start", "endnode": "edge.end"}
#: fixed values: the type that a cast-like name stands for
CAST_NAMES = {"tostring": "STRING", "tointeger": "INTEGER", "tofloat": "FLOAT", "toboolean": "BOOLEAN"}
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc"}
kind_of = kind
