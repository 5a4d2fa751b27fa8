"""Which strings are values of a CSV column type, for whole columns at once."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ANYTHING = {"string", "text", ":label", ":type"}
INTEGER = {"int", "integer", "long", ":id", ":start_id", ":end_id"}
DECIMAL = {"float", "double"}
BOOLEAN = {"bool", "boolean"}
#: fixed values: the words for true and false, compared in lower case
TRUE, FALSE = ("true", "t", "1", "yes"), ("false", "f", "0", "no")
_MONTH = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _matches(v: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(v, rf"\A(?:{pattern})\z").to_numpy(zero_copy_only=False).astype(bool)


def _apply(v: pa.Array, where: np.ndarray, test) -> np.ndarray:
    """``where``, less the values for which ``test`` fails; ``test`` sees only those of ``where``."""
    out = where.copy()
    at = np.flatnonzero(where)
    out[at] = test(v.take(pa.array(at)))
    return out


def _int64(v: pa.Array) -> np.ndarray:
    ok = _matches(v, "[+-]?[0-9]+")
    long_ = ok & (pc.binary_length(v).to_numpy(zero_copy_only=False) > 18)

    def fits(s: str) -> bool:
        digits = s.lstrip("+-").lstrip("0")
        return len(digits) < 20 and -(2**63) <= int(("-" if s[0] == "-" else "") + (digits or "0")) < 2**63

    for i in np.flatnonzero(long_):
        ok[i] = fits(v[int(i)].as_py())
    return ok


def _part(v: pa.Array, start: int, stop: int) -> np.ndarray:
    return pc.utf8_slice_codeunits(v, start, stop).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _real_day(v: pa.Array) -> np.ndarray:
    y, m, d = _part(v, 0, 4), _part(v, 5, 7), _part(v, 8, 10)
    good = (y >= 1) & (m >= 1) & (m <= 12)
    days = _MONTH[np.where(good, m, 0)] + ((m == 2) & (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)))
    return good & (d >= 1) & (d <= days)


def _real_time(v: pa.Array) -> np.ndarray:
    ok = _real_day(v) & (_part(v, 11, 13) < 24) & (_part(v, 14, 16) < 60) & (_part(v, 17, 19) < 60)
    zoned = ~pc.ends_with(v, "Z").to_numpy(zero_copy_only=False).astype(bool)
    return ok & ~(zoned & ~_apply(v, zoned, lambda z: (_part(z, 20, 22) < 24) & (_part(z, 23, 25) < 60)))


#: shapes of the local and clock types: seconds and their fraction may be left out
_DAY, _CLOCK, _ZONE = "[0-9]{4}-[0-9]{2}-[0-9]{2}", r"(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{1,9})?)?", "(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"


def _no_constant(name: str):
    raise ValueError(name)


def _json(s: str):
    return json.loads(s, parse_constant=_no_constant)


def _each(v: pa.Array, test) -> np.ndarray:
    def safe(s):
        try:
            return test(s)
        except (ValueError, RecursionError):
            return False

    return np.fromiter((safe(s) for s in v.to_pylist()), dtype=bool, count=len(v))


def _is_point(s: str) -> bool:
    p = _json(s)
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return isinstance(p, dict) and number(p.get("x")) and number(p.get("y"))


def _is_json(s: str) -> bool:
    _json(s)
    return True


def valid(v: pa.Array, kind: str) -> np.ndarray:
    """True where a string is a value of ``kind`` (in lower case), or empty; a type that isn't known takes anything."""
    empty = pc.equal(v, "").to_numpy(zero_copy_only=False).astype(bool)
    if kind.endswith("[]"):
        inner = kind[:-2]
        if inner in ANYTHING:
            return np.ones(len(v), dtype=bool)
        lists = pc.split_pattern(v, ";")
        flat = lists.flatten()
        flat = flat.cast(pa.large_string())
        good = valid(flat, inner) & ~pc.equal(flat, "").to_numpy(zero_copy_only=False).astype(bool)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        failed = np.zeros(len(v) + 1, dtype=np.int64)
        of = np.repeat(np.arange(len(v)), counts)
        np.add.at(failed, of[~good], 1)
        return empty | (failed[:-1] == 0)
    if kind in INTEGER:
        return empty | _int64(v)
    if kind in DECIMAL:
        return empty | _matches(v, r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
    if kind in BOOLEAN:
        return empty | pc.is_in(pc.utf8_lower(v), pa.array([*TRUE, *FALSE], v.type)).to_numpy(zero_copy_only=False).astype(bool)
    if kind == "date":
        return empty | _apply(v, _matches(v, "[0-9]{4}-[0-9]{2}-[0-9]{2}"), _real_day)
    if kind == "datetime":
        shape = "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:Z|[+-][0-9]{2}:[0-9]{2})"
        return empty | _apply(v, _matches(v, shape), _real_time)
    if kind == "localdatetime":
        return empty | _apply(v, _matches(v, f"{_DAY}T{_CLOCK}"), _real_day)
    if kind == "localtime":
        return empty | _matches(v, _CLOCK)
    if kind == "time":
        return empty | _matches(v, _CLOCK + _ZONE)
    if kind == "duration":
        n = "[0-9]+"
        shape = _matches(v, f"P(?:{n}Y)?(?:{n}M)?(?:{n}D)?(?:T(?:{n}H)?(?:{n}M)?(?:{n}S)?)?")
        return empty | (shape & ~_matches(v, ".*[PT]"))
    if kind == "point":
        return empty | _apply(v, ~empty, lambda x: _each(x, _is_point))
    if kind == "json":
        return empty | _apply(v, ~empty, lambda x: _each(x, _is_json))
    return np.ones(len(v), dtype=bool)
