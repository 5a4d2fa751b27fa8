"""map.* functions over structs (keys known from the query) and maps (keys known from the data)."""

from __future__ import annotations

from pyspark.sql import types as T

from quiver.functions.registry import function
from quiver.plans.values import ident, quoted


class Entries:
    """A map value as an ordered list of (key, SQL) if its keys are static."""

    @staticmethod
    def of(v) -> list[tuple[str, str]] | None:
        if isinstance(v.type, T.StructType):
            return [(n, f"{v.sql}.{ident(n)}") for n in v.type.names if not n.startswith("_")]
        if isinstance(v.type, T.MapType) and isinstance(v.type.keyType, T.NullType):
            return []  # the literal {}
        return None


def struct(entries: list[tuple[str, str]], of=None) -> str:
    """A struct of the entries; null where ``of`` is."""
    if not entries:
        body = "map()"
    else:
        body = "named_struct(" + ", ".join(f"{quoted(k)}, {s}" for k, s in sorted(entries)) + ")"
    return body if of is None else f"if({of.sql} IS NULL, NULL, {body})"


def keys_of(v) -> list[str] | None:
    """Static keys given as a string or a list of strings."""
    if isinstance(v.lit, str):
        return [v.lit]
    return list(v.lit) if isinstance(v.lit, list) and all(isinstance(k, str) for k in v.lit) else None


def _is_map(v) -> bool:
    return isinstance(v.type, T.MapType)


@function("map.from", "aa", low=1)
def _from(c, a):
    if len(a) == 2:
        return f"map_from_arrays({a[0].sql}, {a[1].sql})" if a[0].kind == a[1].kind == "list" else "NULL"
    if a[0].kind == "map":
        return a[0].sql
    if a[0].kind != "list":
        return "NULL"
    inner, x = a[0].type.elementType, a[0].sql
    if isinstance(inner, T.ArrayType):
        return f"map_from_entries(transform({x}, p -> struct(CAST(p[0] AS STRING), p[1])))"
    if isinstance(inner, T.StructType) and len(inner.names) == 2:
        return f"map_from_entries({x})"
    return f"map_from_entries(transform(sequence(0, size({x}) DIV 2 - 1), i -> struct(CAST({x}[2 * i] AS STRING), {x}[2 * i + 1])))"


@function("map.set", "msa")
def _set(c, a):
    e = Entries.of(a[0])
    if e is not None and isinstance(a[1].lit, str):
        return struct([*[x for x in e if x[0] != a[1].lit], (a[1].lit, a[2].sql)], a[0])
    if _is_map(a[0]):
        return f"map_concat(map_filter({a[0].sql}, (k, v) -> k <> {a[1].sql}), map({a[1].sql}, {a[2].sql}))"
    return "NULL"


@function("map.remove", "ma")
def _remove(c, a):
    e, gone = Entries.of(a[0]), keys_of(a[1])
    if e is not None and gone is not None:
        return struct([x for x in e if x[0] not in gone], a[0])
    if _is_map(a[0]):
        return f"map_filter({a[0].sql}, (k, v) -> NOT array_contains({a[1].sql if a[1].kind == 'list' else f'array({a[1].sql})'}, k))"
    return "NULL"


@function("map.pick", "ml")
def _pick(c, a):
    e, kept = Entries.of(a[0]), keys_of(a[1])
    if e is not None and kept is not None:
        return struct([x for x in e if x[0] in kept], a[0])
    return f"map_filter({a[0].sql}, (k, v) -> array_contains({a[1].sql}, k))" if _is_map(a[0]) else "NULL"


def _merge(c, a, deep: bool):
    how = a[2].lit.lower() if len(a) > 2 and isinstance(a[2].lit, str) else "right"
    x, y = Entries.of(a[0]), Entries.of(a[1])
    if x is None and y is None and _is_map(a[0]) and _is_map(a[1]):
        m, n = (a[0].sql, a[1].sql) if how != "left" else (a[1].sql, a[0].sql)
        out = f"map_concat(map_filter({m}, (k, v) -> NOT map_contains_key({n}, k)), {n})"
        return f"if(exists(map_keys({m}), k -> map_contains_key({n}, k)), NULL, {out})" if how == "error" else out
    if x is None or y is None:
        return "NULL"
    both = {k for k, _ in x} & {k for k, _ in y}
    if how == "error" and both:
        return "NULL"
    first, second = (y, x) if how == "left" else (x, y)
    out = dict(first) | dict(second)
    if deep:
        for k in both:
            p, q = c.val(dict(x)[k]), c.val(dict(y)[k])
            if isinstance(p.type, T.StructType) and isinstance(q.type, T.StructType):
                out[k] = _merge(c, [p, q, *a[2:]], True)
    return struct(list(out.items()))


@function("map.merge", "mms", low=2)
def _merge_flat(c, a):
    return _merge(c, a, False)


@function("map.deep_merge", "mms", low=2)
def _merge_deep(c, a):
    return _merge(c, a, True)


@function("map.compact", "m")
def _compact(c, a):
    if _is_map(a[0]):
        return f"map_filter({a[0].sql}, (k, v) -> v IS NOT NULL)"
    e = Entries.of(a[0])
    kept = [(k, s) for k, s in e if c.val(s).kind != "null"]
    return struct(kept, a[0])


def _grouped(c, a, last: bool):
    t = a[0].type.elementType
    if isinstance(t, T.StructType) and isinstance(a[1].lit, str):
        key = lambda m: f"CAST({m}.{ident(a[1].lit)} AS STRING)"
        if a[1].lit not in t.names:
            return "NULL"
    elif isinstance(t, T.MapType):
        key = lambda m: f"CAST({m}[{a[1].sql}] AS STRING)"
    else:
        return "NULL"
    x = a[0].sql
    keys = f"array_distinct(filter(transform({x}, m -> {key('m')}), k -> k IS NOT NULL))"
    rows = f"filter({x}, m -> {key('m')} = k)"
    return f"map_from_arrays({keys}, transform({keys}, k -> {f'try_element_at({rows}, -1)' if last else rows}))"


@function("map.group_by", "ls")
def _group_by(c, a):
    return _grouped(c, a, False)


@function("map.index_by", "ls")
def _index_by(c, a):
    return _grouped(c, a, True)


def _leaves(c, v, sep: str, prefix: str = "") -> list[tuple[str, str]]:
    out = []
    for k, s in Entries.of(v):
        inner = c.val(s)
        if isinstance(inner.type, T.StructType) and inner.kind == "map":
            out += _leaves(c, inner, sep, f"{prefix}{k}{sep}")
        else:
            out.append((prefix + k, s))
    return out


@function("map.flatten", "ms", low=1)
def _flatten(c, a):
    sep = a[1].lit if len(a) > 1 and isinstance(a[1].lit, str) else "."
    return struct(_leaves(c, a[0], sep), a[0]) if Entries.of(a[0]) is not None else a[0].sql


@function("map.unflatten", "ms", low=1)
def _unflatten(c, a):
    e = Entries.of(a[0])
    if e is None:
        return a[0].sql
    sep, tree = a[1].lit if len(a) > 1 and isinstance(a[1].lit, str) else ".", {}
    for k, s in e:
        at, parts = tree, k.split(sep)
        for p in parts[:-1]:
            nested = at.setdefault(p, {})
            at = nested if isinstance(nested, dict) else at.update({p: {}}) or at[p]
        at[parts[-1]] = s
    build = lambda t: struct([(k, build(v) if isinstance(v, dict) else v) for k, v in t.items()])
    return build(tree)


def _path(v) -> list[str] | None:
    if isinstance(v.lit, str):
        return v.lit.split(".")
    return [str(p) for p in v.lit] if isinstance(v.lit, list) else None


@function("map.get_path", "aaa", low=2)
def _get_path(c, a):
    path, v = _path(a[1]), a[0]
    other = a[2].sql if len(a) > 2 else "NULL"
    if path is None:
        return "NULL"
    for p in path:
        if isinstance(v.type, T.StructType):
            if p not in v.type.names:
                return other
            v = c.val(f"{v.sql}.{ident(p)}")
        elif isinstance(v.type, T.ArrayType) and p.lstrip("-").isdigit():
            v = c.val(f"try_element_at({v.sql}, {int(p) + 1 if int(p) >= 0 else int(p)})")
        elif isinstance(v.type, T.MapType):
            v = c.val(f"{v.sql}[{quoted(p)}]")
        elif v.kind == "any":
            v = c.val(f"try_variant_get({v.sql}, {quoted('$.' + p)}, 'variant')")
        else:
            return other
    return v.sql if other == "NULL" else f"coalesce({v.sql}, {other})"


def _changed(c, v, path: list[str], value: str | None) -> str:
    """The struct with ``value`` at the path; without that key if ``value`` is None."""
    entries = dict(Entries.of(v) or [])
    if len(path) == 1:
        if value is None:
            entries.pop(path[0], None)
        else:
            entries[path[0]] = value
    elif path[0] in entries and isinstance(c.val(entries[path[0]]).type, T.StructType):
        entries[path[0]] = _changed(c, c.val(entries[path[0]]), path[1:], value)
    elif value is not None:
        inner = value
        for p in reversed(path[1:]):
            inner = struct([(p, inner)])
        entries[path[0]] = inner
    return struct(list(entries.items()))


@function("map.set_path", "maa")
def _set_path(c, a):
    return _changed(c, a[0], p, a[2].sql) if (p := _path(a[1])) and Entries.of(a[0]) is not None else "NULL"


@function("map.remove_path", "ma")
def _remove_path(c, a):
    return _changed(c, a[0], p, None) if (p := _path(a[1])) and Entries.of(a[0]) is not None else "NULL"


@function("map.entries", "ms", low=1)
def _entries(c, a):
    e = Entries.of(a[0])
    if e is None:
        return f"transform(array_sort(map_entries({a[0].sql})), e -> array(e.key, CAST(e.value AS STRING)))" if c.val(f"map_values({a[0].sql})").type.elementType == T.StringType() else f"array_sort(map_entries({a[0].sql}))"
    return "array(" + ", ".join(f"struct({quoted(k)} AS key, {s} AS value)" for k, s in sorted(e)) + ")"


@function("map.values", "ml", low=1)
def _values(c, a):
    e = Entries.of(a[0])
    if e is None:
        return f"transform({a[1].sql}, k -> {a[0].sql}[k])" if len(a) > 1 else f"transform(array_sort(map_entries({a[0].sql})), e -> e.value)"
    wanted = keys_of(a[1]) if len(a) > 1 else sorted(k for k, _ in e)
    return "array(" + ", ".join(dict(e).get(k, "NULL") for k in wanted or [] if k in dict(e)) + ")"


@function("map.keys", "m")
def _keys(c, a):
    e = Entries.of(a[0])
    if e is None:
        return f"sort_array(map_keys({a[0].sql}))"
    return f"if({a[0].sql} IS NULL, NULL, CAST(array({', '.join(quoted(k) for k, _ in sorted(e))}) AS ARRAY<STRING>))"


@function("map.has_key", "ms")
def _has_key(c, a):
    e = Entries.of(a[0])
    if e is None:
        return f"map_contains_key({a[0].sql}, {a[1].sql})"
    return f"if({a[0].sql} IS NULL, NULL, {a[1].sql} IN ({', '.join([quoted(k) for k, _ in e] or ['NULL'])}))"


@function("map.rename", "mss")
def _rename(c, a):
    e = Entries.of(a[0])
    if e is None:
        return f"transform_keys({a[0].sql}, (k, v) -> if(k = {a[1].sql}, {a[2].sql}, k))"
    if not isinstance(a[1].lit, str) or not isinstance(a[2].lit, str):
        return "NULL"
    if a[1].lit not in dict(e):
        return a[0].sql
    return struct([*[x for x in e if x[0] not in (a[1].lit, a[2].lit)], (a[2].lit, dict(e)[a[1].lit])], a[0])


@function("map.invert", "m")
def _invert(c, a):
    e = Entries.of(a[0])
    pairs = f"map_entries({a[0].sql})" if e is None else "array(" + ", ".join(f"struct({quoted(k)} AS key, CAST({s} AS STRING) AS value)" for k, s in sorted(e)) + ")"
    last = f"filter({pairs}, (p, i) -> p.value IS NOT NULL AND NOT exists(slice({pairs}, i + 2, size({pairs})), q -> q.value = p.value))"
    return f"map_from_entries(transform({last}, p -> struct(CAST(p.value AS STRING), p.key)))"


@function("map.get", "msa", low=2)
def _get(c, a):
    e = Entries.of(a[0])
    other = a[2].sql if len(a) > 2 else "NULL"
    if e is None:
        return f"if(map_contains_key({a[0].sql}, {a[1].sql}), {a[0].sql}[{a[1].sql}], {other})"
    if isinstance(a[1].lit, str):
        return dict(e).get(a[1].lit, other)
    return f"CASE {a[1].sql} " + " ".join(f"WHEN {quoted(k)} THEN {s}" for k, s in e) + f" ELSE {other} END" if e else other


@function("map.size", "m")
def _size(c, a):
    e = Entries.of(a[0])
    return f"CAST(size({a[0].sql}) AS BIGINT)" if e is None else f"if({a[0].sql} IS NULL, NULL, {len(e)}L)"
