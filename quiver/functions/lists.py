"""list.* functions."""

from __future__ import annotations

from pyspark.sql import types as T

from quiver.functions.registry import MANY, function, template
from quiver.plans.values import INTEGRAL, NUMERIC, kind

_REAL = "filter({0}, v -> v IS NOT NULL)"


def _numbers(a) -> bool:
    return isinstance(a.type.elementType, (*NUMERIC, T.NullType))


def _whole(a) -> bool:
    return isinstance(a.type.elementType, (*INTEGRAL, T.NullType))


def variant(sql: str, k: str) -> str:
    return f"to_variant_object({sql})" if k in ("list", "map", "node", "edge", "path") else f"CAST({sql} AS VARIANT)"


def aligned(lists: list, items: list = ()) -> tuple[list[str], list[str]]:
    """Lists and single values with elements of one type: as they are, or as variants where kinds differ."""
    kinds = {kind(x.type.elementType) for x in lists} | {x.kind for x in items}
    if len(kinds - {"null"}) <= 1:
        return [x.sql for x in lists], [x.sql for x in items]
    return [x.sql if kind(x.type.elementType) == "any" else f"transform({x.sql}, v -> {variant('v', kind(x.type.elementType))})" for x in lists], [x.sql if x.kind == "any" else variant(x.sql, x.kind) for x in items]


@function("list.sum", "l")
def _sum(c, a):
    if not _numbers(a[0]):
        return "NULL"
    zero, t = ("0L", "BIGINT") if _whole(a[0]) else ("0.0D", "DOUBLE")
    return f"aggregate({_REAL.format(a[0].sql)}, {zero}, (s, v) -> s + CAST(v AS {t}))"


@function("list.product", "l")
def _product(c, a):
    if not _numbers(a[0]):
        return "NULL"
    one, t = ("1L", "BIGINT") if _whole(a[0]) else ("1.0D", "DOUBLE")
    return f"aggregate({_REAL.format(a[0].sql)}, {one}, (s, v) -> s * CAST(v AS {t}))"


@function("list.avg", "l")
def _avg(c, a):
    if not _numbers(a[0]):
        return "NULL"
    real = _REAL.format(a[0].sql)
    return f"try_divide(aggregate({real}, 0.0D, (s, v) -> s + CAST(v AS DOUBLE)), CAST(size({real}) AS DOUBLE))"


@function("list.stdev", "l")
def _stdev(c, a):
    if not _numbers(a[0]):
        return "NULL"
    return (
        f"transform(array(transform({_REAL.format(a[0].sql)}, v -> CAST(v AS DOUBLE))), x -> if(size(x) < 2, NULL, sqrt("
        "aggregate(x, 0.0D, (s, v) -> s + power(v - aggregate(x, 0.0D, (m, w) -> m + w) / size(x), 2)) / (size(x) - 1))))[0]"
    )


@function("list.median", "l")
def _median(c, a):
    if not _numbers(a[0]):
        return "NULL"
    return (
        f"transform(array(array_sort(transform({_REAL.format(a[0].sql)}, v -> CAST(v AS DOUBLE)))), x -> if(size(x) = 0, NULL, "
        "(get(x, CAST((size(x) - 1) DIV 2 AS INT)) + get(x, CAST(size(x) DIV 2 AS INT))) / 2))[0]"
    )


template("list.min", "l", "array_min({0})")
template("list.max", "l", "array_max({0})")


@function("list.sort", "la", low=1)
def _sort(c, a):
    if len(a) == 1:
        return f"sort_array({a[0].sql})"
    if a[1].kind == "bool":
        return f"sort_array({a[0].sql}, {a[1].sql})" if a[1].lit is not None else f"if({a[1].sql}, sort_array({a[0].sql}, true), sort_array({a[0].sql}, false))"
    word = f"lower({a[1].sql})"
    return f"if({word} IN ('desc', 'descending'), sort_array({a[0].sql}, false), sort_array({a[0].sql}, true))"


template("list.reverse", "l", "reverse({0})")
template("list.unique", "l", "array_distinct({0})")
template("list.first", "l", "get({0}, 0)")
template("list.rest", "l", "if(size({0}) = 0, NULL, slice({0}, 2, greatest(size({0}) - 1, 0)))")
template("list.init", "l", "if(size({0}) = 0, NULL, slice({0}, 1, greatest(size({0}) - 1, 0)))")
template("list.last", "l", "get({0}, size({0}) - 1)")
template("list.at", "li", "get({0}, CAST(if({1} < 0, if({1} + size({0}) < 0, size({0}), {1} + size({0})), least({1}, size({0}))) AS INT))")


@function("list.slice", "lii", low=2)
def _slice(c, a):
    n = f"size({a[0].sql})"
    norm = lambda x: f"CAST(least(greatest(if({x} < 0, {x} + {n}, {x}), 0), {n}) AS INT)"
    start, stop = norm(a[1].sql), norm(a[2].sql) if len(a) > 2 else n
    return f"slice({a[0].sql}, {start} + 1, greatest({stop} - {start}, 0))"


template("list.size", "l", "CAST(array_size({0}) AS BIGINT)")


@function("list.range", "iii", low=2)
def _range(c, a):
    x, y = a[0].sql, a[1].sql
    step = a[2].sql if len(a) > 2 else "1L"
    one = f"if({step} = 0, 1L, {step})"
    return (
        f"CASE WHEN {x} IS NULL OR {y} IS NULL OR {step} IS NULL OR {step} = 0 THEN NULL WHEN ({y} - {x}) DIV {one} > 16777215 THEN NULL "
        f"WHEN ({step} > 0 AND {x} > {y}) OR ({step} < 0 AND {x} < {y}) THEN CAST(array() AS ARRAY<BIGINT>) "
        f"ELSE sequence({x}, if(({step} > 0 AND {x} > {y}) OR ({step} < 0 AND {x} < {y}), {x}, {y}), {one}) END"
    )


def _comparable(a, v) -> bool:
    k = kind(a.type.elementType)
    return k == v.kind or "null" in (k, v.kind)


@function("list.contains", "la")
def _contains(c, a):
    if not _comparable(a[0], a[1]):
        return f"if({a[0].sql} IS NULL, NULL, false)"
    return f"exists({a[0].sql}, v -> v <=> {a[1].sql})"


template("list.contains_all", "ll", "size(array_except({1}, {0})) = 0")
template("list.has_duplicates", "l", "size(array_distinct({0})) < size({0})")
template("list.all_distinct", "l", "size(array_distinct({0})) = size({0})")
template("list.equal_unordered", "ll", "sort_array({0}) <=> sort_array({1})")


@function("list.is_empty", "a")
def _is_empty(c, a):
    k = a[0].kind
    if k == "null":
        return "NULL"
    if k == "list" or isinstance(a[0].type, T.MapType):
        return f"size({a[0].sql}) = 0"
    if k == "string":
        return f"{a[0].sql} = ''"
    if k == "map":
        return f"if({a[0].sql} IS NULL, NULL, {'true' if not a[0].type.names else 'false'})"
    return f"if({a[0].sql} IS NULL, NULL, false)"


@function("list.index_of", "la")
def _index_of(c, a):
    if not _comparable(a[0], a[1]):
        return f"if({a[0].sql} IS NULL, NULL, -1L)"
    hits = f"filter(transform({a[0].sql}, (v, i) -> if(v <=> {a[1].sql}, i, NULL)), i -> i IS NOT NULL)"
    return f"CAST(coalesce(get({hits}, 0), if({a[0].sql} IS NULL, NULL, -1)) AS BIGINT)"


@function("list.indexes_of", "la")
def _indexes_of(c, a):
    if not _comparable(a[0], a[1]):
        return f"if({a[0].sql} IS NULL, NULL, CAST(array() AS ARRAY<BIGINT>))"
    return f"filter(transform({a[0].sql}, (v, i) -> if(v <=> {a[1].sql}, CAST(i AS BIGINT), NULL)), i -> i IS NOT NULL)"


template("list.find_duplicates", "l", "array_distinct(filter({0}, (v, i) -> exists(slice({0}, 1, i), w -> w <=> v)))")
template("list.count_by", "l", "map_from_arrays(transform(sort_array(array_distinct({0})), k -> coalesce(CAST(k AS STRING), 'null')), transform(sort_array(array_distinct({0})), k -> CAST(size(filter({0}, v -> v <=> k)) AS BIGINT)))")
template("list.union", "ll", "array_union({0}, {1})")
template("list.intersect", "ll", "array_intersect({0}, {1})")
template("list.diff", "ll", "filter({0}, v -> NOT exists({1}, w -> w <=> v))")
template("list.symmetric_diff", "ll", "array_union(array_except({0}, {1}), array_except({1}, {0}))")
@function("list.zip", "ll")
def _zip(c, a):
    x, y = aligned(a)[0]
    n = f"least(size({a[0].sql}), size({a[1].sql}))"
    return f"zip_with(slice({x}, 1, {n}), slice({y}, 1, {n}), (p, q) -> array(p, q))"


template(
    "list.chunks", "li",
    "CASE WHEN {1} <= 0 THEN NULL WHEN size({0}) = 0 THEN slice(array({0}), 1, 0) ELSE "
    "transform(sequence(0, CAST(ceil(size({0}) / greatest({1}, 1)) AS INT) - 1), i -> slice({0}, CAST(i * {1} + 1 AS INT), CAST(greatest({1}, 1) AS INT))) END",
)


@function("list.split_by", "la")
def _split_by(c, a):
    x = a[0].sql
    cuts = f"concat(array(-1), filter(transform({x}, (v, i) -> if(v <=> {a[1].sql}, i, NULL)), i -> i IS NOT NULL), array(size({x})))"
    return f"transform(array({cuts}), q -> transform(sequence(1, size(q) - 1), k -> slice({x}, q[k - 1] + 2, q[k] - q[k - 1] - 1)))[0]"


@function("list.windows", "lii", low=2)
def _windows(c, a):
    x, k = a[0].sql, a[1].sql
    step = a[2].sql if len(a) > 2 else "1L"
    return (
        f"CASE WHEN {k} <= 0 OR {step} <= 0 THEN NULL WHEN {k} > size({x}) THEN slice(array({x}), 1, 0) ELSE "
        f"transform(sequence(0L, greatest(size({x}) - {k}, 0L), greatest({step}, 1L)), i -> slice({x}, CAST(i + 1 AS INT), CAST(greatest({k}, 0) AS INT))) END"
    )


@function("list.scan", "ls")
def _scan(c, a):
    if not _numbers(a[0]):
        return "NULL"
    t = "BIGINT" if _whole(a[0]) else "DOUBLE"
    x = f"transform({_REAL.format(a[0].sql)}, v -> CAST(v AS {t}))"
    step = {"sum": "p + v", "product": "p * v", "min": "least(p, v)", "max": "greatest(p, v)"}
    one = lambda op: (
        f"aggregate({x}, CAST(array() AS ARRAY<{t}>), (s, v) -> array_append(s, coalesce(transform(array(try_element_at(s, -1)), p -> {step[op]})[0], v)))"
    )
    op = a[1].lit
    if isinstance(op, str):
        return one(op.lower()) if op.lower() in step else "NULL"
    return "CASE lower(" + a[1].sql + ") " + " ".join(f"WHEN '{k}' THEN {one(k)}" for k in step) + " END"


template("list.repeat", "ai", "array_repeat({0}, CAST(greatest({1}, 0) AS INT))")


@function("list.flatten", "li", low=1)
def _flatten(c, a):
    depth, t, out = (a[1].lit if len(a) > 1 else 1), a[0].type, a[0].sql
    for _ in range(depth if isinstance(depth, int) else 1):
        if not (isinstance(t, T.ArrayType) and isinstance(t.elementType, T.ArrayType)):
            break
        out, t = f"flatten({out})", t.elementType
    return out


template("list.sample", "li", "slice(shuffle({0}), 1, CAST(greatest({1}, 0) AS INT))", low=1)


@function("list.sample", "li", low=1)
def _sample(c, a):
    return f"slice(shuffle({a[0].sql}), 1, CAST(greatest({a[1].sql}, 0) AS INT))" if len(a) > 1 else f"get(shuffle({a[0].sql}), 0)"


template("list.shuffle", "l", "shuffle({0})")
template(
    "list.combinations", "li",
    "CASE WHEN {1} < 0 OR {1} > size({0}) THEN slice(array({0}), 1, 0) ELSE transform(array_sort(filter(aggregate(transform({0}, (v, i) -> i), "
    "array(CAST(array() AS ARRAY<INT>)), (s, i) -> concat(s, transform(filter(s, q -> size(q) < {1}), q -> array_append(q, i)))), q -> size(q) = {1})), "
    "q -> transform(q, i -> {0}[i])) END",
)


@function("list.concat", "l", low=2, high=MANY)
def _concat(c, a):
    return f"concat({', '.join(aligned(a)[0])})"


@function("list.append", "la")
def _append(c, a):
    (x,), (v,) = aligned(a[:1], a[1:])
    return f"array_append({x}, {v})"


@function("list.prepend", "la")
def _prepend(c, a):
    (x,), (v,) = aligned(a[:1], a[1:])
    return f"array_prepend({x}, {v})"


template("list.take", "li", "slice({0}, 1, CAST(greatest({1}, 0) AS INT))")
template("list.drop", "li", "slice({0}, CAST(least(greatest({1}, 0), size({0})) AS INT) + 1, size({0}))")
template("list.take_last", "li", "slice({0}, greatest(size({0}) - CAST(least(greatest({1}, 0), size({0})) AS INT), 0) + 1, size({0}))")
template("list.drop_last", "li", "slice({0}, 1, greatest(size({0}) - CAST(least(greatest({1}, 0), size({0})) AS INT), 0))")
template("list.insert", "lia", "array_insert({0}, CAST(least(greatest({1}, 0), size({0})) AS INT) + 1, {2})")
template("list.remove", "li", "filter({0}, (v, i) -> i <> if({1} < 0, {1} + size({0}), {1}))")
template("list.compact", "l", "array_compact({0})")
