"""bytes, crypto, uuid, json, geo, vector, node, edge, path, value, type and cast functions."""

from __future__ import annotations

import gzip
import struct as binary
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from quiver.functions.maps import Entries
from quiver.functions.registry import CAST_NAMES, FUNCTIONS, MANY, function, template
from quiver.functions.temporal import parse_duration, parse_time, text_of
from quiver.plans.values import INTEGRAL, ident, quoted, type_name

# -- bytes ---------------------------------------------------------------
template("bytes.size", "t", "CAST(octet_length({0}) AS BIGINT)")
template("bytes.from_string", "ss", "encode({0}, 'UTF-8')", low=1)
template("bytes.to_string", "ys", "if(is_valid_utf8({0}), CAST({0} AS STRING), NULL)", low=1)
template("bytes.base64_encode", "t", "replace(replace(base64({0}), '\\r', ''), '\\n', '')")
template("bytes.base64_decode", "s", "try_to_binary({0}, 'base64')")
template("bytes.hex_encode", "t", "lower(hex({0}))")
template("bytes.hex_decode", "s", "if(length({0}) % 2 = 0, try_to_binary({0}, 'hex'), NULL)")
_PACK = {"gzip": lambda b: gzip.compress(b, mtime=0), "deflate": zlib.compress}
_UNPACK = {"gzip": gzip.decompress, "deflate": zlib.decompress}


def _coded(table: dict, name: str):
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else table[name](bytes(v))
            except (OSError, EOFError, zlib.error):
                return None

        return pd.Series([one(v) for v in values])

    return run


def _codec(c, a, table, verb):
    name = a[1].lit.lower() if len(a) > 1 and isinstance(a[1].lit, str) else "gzip"
    if name not in table:
        return "CAST(NULL AS BINARY)"
    return f"{c.udf(f'{verb}_{name}', _coded(table, name), 'binary')}(CAST({a[0].sql} AS BINARY))"


@function("bytes.compress", "ts", low=1)
def _compress(c, a):
    return _codec(c, a, _PACK, "pack")


@function("bytes.decompress", "ys", low=1)
def _decompress(c, a):
    return _codec(c, a, _UNPACK, "unpack")


# -- crypto --------------------------------------------------------------
#: fixed values: the initial state and the message order of the published BLAKE3 function
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_M = 0xFFFFFFFF


def _compress_block(cv, words, counter, length, flags):
    s = [*cv, *_IV[:4], counter & _M, counter >> 32, length, flags]

    def mix(a, b, c, d, x, y):
        for k, (r1, r2) in ((x, (16, 12)), (y, (8, 7))):
            s[a] = (s[a] + s[b] + k) & _M
            t = s[d] ^ s[a]
            s[d] = (t >> r1 | t << (32 - r1)) & _M
            s[c] = (s[c] + s[d]) & _M
            t = s[b] ^ s[c]
            s[b] = (t >> r2 | t << (32 - r2)) & _M

    for round_ in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, words[2 * i], words[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, words[8 + 2 * i], words[9 + 2 * i])
        words = [words[k] for k in _ORDER]
    return [s[i] ^ s[i + 8] for i in range(8)]


def _chunk(data: bytes, counter: int, root: bool):
    cv, blocks = _IV, [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, b in enumerate(blocks):
        flags = (_START if i == 0 else 0) | ((_END | (_ROOT if root else 0)) if i == len(blocks) - 1 else 0)
        cv = _compress_block(cv, binary.unpack("<16I", b.ljust(64, b"\0")), counter, len(b), flags)
    return cv


def blake3(data: bytes) -> str:
    """BLAKE3 of the data in hex, 256 bits."""

    def tree(lo: int, hi: int, root: bool):
        n = -(-(hi - lo) // 1024)
        if n <= 1:
            return _chunk(data[lo:hi], lo // 1024, root)
        left = 1 << ((n - 1).bit_length() - 1)
        middle = lo + left * 1024
        return _compress_block(_IV, [*tree(lo, middle, False), *tree(middle, hi, False)], 0, 64, _PARENT | (_ROOT if root else 0))

    return binary.pack("<8I", *tree(0, len(data), True)).hex()


def _chunks(pieces: list[bytes], counter: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The chaining values (rows of eight words) of many chunks of up to 1024 bytes: all go through their n-th block at once."""
    size = np.array(list(map(len, pieces)), np.int64)
    blocks = np.maximum(1, -(-size // 64))
    data = np.frombuffer(b"".join(p.ljust(1024, b"\0") for p in pieces), "<u4").reshape(len(pieces), 16, 16)
    cv = np.tile(np.array(_IV, np.uint32), (len(pieces), 1))
    for b in range(int(blocks.max(initial=0))):
        at = np.flatnonzero(blocks > b)
        last = blocks[at] == b + 1
        flags = np.where(last, _END, 0) | (_START if b == 0 else 0) | np.where(last & root[at], _ROOT, 0)
        full = lambda v: np.broadcast_to(np.asarray(v).astype(np.uint32), len(at))
        s = [*cv[at].T.copy(), *(full(v).copy() for v in (*_IV[:4], counter[at] & _M, counter[at] >> 32, np.clip(size[at] - 64 * b, 0, 64), flags))]
        words = list(data[at, b].T)

        def mix(i, j, k, m, x, y):
            for w, (r1, r2) in ((x, (16, 12)), (y, (8, 7))):
                s[i] = s[i] + s[j] + w
                t = s[m] ^ s[i]
                s[m] = t >> np.uint32(r1) | t << np.uint32(32 - r1)
                s[k] = s[k] + s[m]
                t = s[j] ^ s[k]
                s[j] = t >> np.uint32(r2) | t << np.uint32(32 - r2)

        for _ in range(7):
            for i in range(4):
                mix(i, 4 + i, 8 + i, 12 + i, words[2 * i], words[2 * i + 1])
            for i in range(4):
                mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, words[8 + 2 * i], words[9 + 2 * i])
            words = [words[k] for k in _ORDER]
        cv[at] = np.stack([s[i] ^ s[i + 8] for i in range(8)], axis=1)
    return cv


def blake3_many(values: list[bytes], block: int = 8192) -> list[str]:
    """BLAKE3 of each of many values in hex; only the joints of values of more than 1024 bytes are computed one by one."""
    pieces = [(i, c, v[1024 * c : 1024 * c + 1024], len(v) <= 1024) for i, v in enumerate(values) for c in range(max(1, -(-len(v) // 1024)))]
    cvs: list[list[tuple[int, ...]]] = [[] for _ in values]
    for lo in range(0, len(pieces), block):
        part = pieces[lo : lo + block]
        done = _chunks([p[2] for p in part], np.array([p[1] for p in part], np.int64), np.array([p[3] for p in part], bool))
        for (i, *_), cv in zip(part, done.tolist()):
            cvs[i].append(tuple(cv))

    def joined(parts: list, root: bool):
        if len(parts) == 1:
            return parts[0]
        left = 1 << ((len(parts) - 1).bit_length() - 1)
        return _compress_block(_IV, [*joined(parts[:left], False), *joined(parts[left:], False)], 0, 64, _PARENT | (_ROOT if root else 0))

    return [binary.pack("<8I", *joined(parts, True)).hex() for parts in cvs]


def _blake3_all(values: pd.Series) -> pd.Series:
    known = values.notna().to_numpy()
    out = np.full(len(values), None, dtype=object)
    out[known] = blake3_many([bytes(v) for v in values[known]])
    return pd.Series(out)


@function("crypto.blake3", "t")
def _blake3(c, a):
    return f"{c.udf('blake3', _blake3_all, 'string')}(CAST({a[0].sql} AS BINARY))"


template("crypto.crc32", "t", "crc32(CAST({0} AS BINARY))")

# -- uuid ----------------------------------------------------------------
_UUID = "^[0-9a-fA-F]{{8}}-?[0-9a-fA-F]{{4}}-?[0-9a-fA-F]{{4}}-?[0-9a-fA-F]{{4}}-?[0-9a-fA-F]{{12}}$"
template("uuid.new", "", "uuid()")
template("uuid.is_valid", "s", "rlike({0}, '" + _UUID + "')")
template("uuid.from_string", "s", "if(rlike({0}, '" + _UUID + "'), regexp_replace(lower(replace({0}, '-', '')), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5'), NULL)")


# -- json ----------------------------------------------------------------
@function("json.encode", "ab", low=1)
def _encode(c, a):
    pretty = ", map('pretty', 'true')" if len(a) > 1 and a[1].lit is True else ""
    if a[0].kind in ("list", "map", "node", "edge", "path", "point"):
        return f"to_json({a[0].sql}{pretty})"
    return f"if({a[0].sql} IS NULL, 'null', regexp_extract(to_json(named_struct('v', {a[0].sql})), '(?s)^\\\\{{\"v\":(.*)\\\\}}$', 1))"


template("json.decode", "s", "try_parse_json({0})")


@function("json.path", "as")
def _json_path(c, a):
    v = a[0].sql if a[0].kind == "any" else f"try_parse_json({a[0].sql})" if a[0].kind == "string" else f"to_variant_object({a[0].sql})"
    if not isinstance(a[1].lit, str):
        return "NULL"
    path = a[1].lit if a[1].lit.startswith("$") else "$." + a[1].lit
    return f"try_variant_get({v}, {quoted(path)}, 'variant')"


# -- geo -----------------------------------------------------------------
def _coordinate(v, *names: str) -> str | None:
    return next((f"try_cast({v.sql}.{ident(n)} AS DOUBLE)" for n in names if n in v.type.names), None)


@function("geo.point", "m")
def _point(c, a):
    v = a[0]
    if not isinstance(v.type, T.StructType):
        return "NULL"
    flat = (_coordinate(v, "x"), _coordinate(v, "y"), _coordinate(v, "z"))
    round_ = (_coordinate(v, "longitude"), _coordinate(v, "latitude"), _coordinate(v, "height", "z"))
    geographic = round_[0] and round_[1]
    x, y, z = round_ if geographic else flat
    if not x or not y:
        return "NULL"
    srid = (4979 if z else 4326) if geographic else (9157 if z else 7203)
    if "srid" in v.type.names:
        srid = f"CAST({v.sql}.srid AS INT)"
    elif "crs" in v.type.names:
        srid = f"CASE lower({v.sql}.crs) WHEN 'cartesian' THEN 7203 WHEN 'cartesian-3d' THEN 9157 WHEN 'wgs-84' THEN 4326 WHEN 'wgs-84-3d' THEN 4979 END"
    return f"if({x} IS NULL OR {y} IS NULL, NULL, named_struct('srid', {srid}, 'x', {x}, 'y', {y}, 'z', {z or 'CAST(NULL AS DOUBLE)'}))"


@function("geo.distance", "pp")
def _geo_distance(c, a):
    p, q = a[0].sql, a[1].sql
    flat = f"sqrt(power({p}.x - {q}.x, 2) + power({p}.y - {q}.y, 2) + power(coalesce({p}.z - {q}.z, 0D), 2))"
    h = f"power(sin(radians({q}.y - {p}.y) / 2), 2) + cos(radians({p}.y)) * cos(radians({q}.y)) * power(sin(radians({q}.x - {p}.x) / 2), 2)"
    ground = f"2 * 6371000D * asin(least(1D, sqrt({h})))"
    return f"CASE WHEN {p} IS NULL OR {q} IS NULL THEN NULL WHEN {p}.srid <> {q}.srid THEN CAST(raise_error('points of different reference systems') AS DOUBLE) WHEN {p}.srid IN (4326, 4979) THEN {ground} ELSE {flat} END"


@function("geo.within_bbox", "ppp")
def _within(c, a):
    p, l, u = (x.sql for x in a)
    between = lambda d: f"({p}.{d} BETWEEN least({l}.{d}, {u}.{d}) AND greatest({l}.{d}, {u}.{d}))"
    return f"if({p} IS NULL OR {l} IS NULL OR {u} IS NULL, NULL, {between('x')} AND {between('y')} AND coalesce({between('z')}, true))"


# -- vector --------------------------------------------------------------
template("vector.dimension", "l", "CAST(size({0}) AS BIGINT)")


def _fold(x: str, y: str, term: str, t: str = "DOUBLE") -> str:
    """Sum of ``term`` over the pairs (p, q) of two vectors."""
    return f"aggregate(zip_with({x}, {y}, (p, q) -> {term}), CAST(0 AS {t}), (s, v) -> CAST(s + v AS {t}))"


def _f32(a) -> str:
    return "FLOAT" if all(isinstance(v.type.elementType, T.FloatType) for v in a[:2]) else "DOUBLE"


def cosine(x: str, y: str, t: str = "DOUBLE") -> str:
    """Cosine of two vectors; null where a norm is zero."""
    norm = f"(sqrt(CAST({_fold(x, x, 'p * q', t)} AS DOUBLE)) * sqrt(CAST({_fold(y, y, 'p * q', t)} AS DOUBLE)))"
    return f"try_divide(CAST({_fold(x, y, 'p * q', t)} AS DOUBLE), {norm})"


def _checked(a, sql: str) -> str:
    return f"CASE WHEN {a[0].sql} IS NULL OR {a[1].sql} IS NULL THEN NULL WHEN size({a[0].sql}) <> size({a[1].sql}) THEN CAST(raise_error('vectors of different dimensions') AS DOUBLE) ELSE {sql} END"


@function("vector.distance", "lls")
def _distance(c, a):
    x, y, t = a[0].sql, a[1].sql, _f32(a)
    fold = lambda term: f"CAST({_fold(x, y, term, t)} AS DOUBLE)"
    forms = {
        "EUCLIDEAN": f"sqrt({fold('(p - q) * (p - q)')})", "EUCLIDEAN_SQUARED": fold("(p - q) * (p - q)"), "MANHATTAN": fold("abs(p - q)"),
        "COSINE": f"1D - {cosine(x, y, t)}", "DOT": f"- {fold('p * q')}", "HAMMING": fold("if(p <> q, 1, 0)"),
    }
    word = a[2].lit.upper() if isinstance(a[2].lit, str) else ""
    return _checked(a, forms[word]) if word in forms else "NULL"


def similarity(x: str, y: str, how: str, t: str = "DOUBLE") -> str | None:
    """Scores of the vector indexes."""
    fold = lambda term: f"CAST({_fold(x, y, term, t)} AS DOUBLE)"
    return {
        "cosine": f"least(greatest((1D + {cosine(x, y, t)}) / 2, 0D), 1D)", "euclidean": f"1D / (1D + {fold('(p - q) * (p - q)')})",
        "dot": fold("p * q"), "manhattan": f"1D / (1D + {fold('abs(p - q)')})",
    }.get(how)


@function("vector.similarity", "lls", low=2)
def _similarity(c, a):
    how = a[2].lit.lower() if len(a) > 2 and isinstance(a[2].lit, str) else "cosine"
    x, y = a[0].sql, a[1].sql
    if how == "cosine":
        score = cosine(x, y, _f32(a))
        return _checked(a, f"if({score} IS NULL, NULL, {similarity(x, y, how, _f32(a))})")
    return _checked(a, similarity(x, y, how, _f32(a))) if how == "euclidean" else "NULL"


@function("vector.norm", "ls", low=1)
def _norm(c, a):
    word = a[1].lit.upper() if len(a) > 1 and isinstance(a[1].lit, str) else "EUCLIDEAN"
    x, t = a[0].sql, _f32([a[0], a[0]])
    forms = {"EUCLIDEAN": f"sqrt(CAST({_fold(x, x, 'p * q', t)} AS DOUBLE))", "MANHATTAN": f"CAST(aggregate({x}, CAST(0 AS {t}), (s, v) -> CAST(s + abs(v) AS {t})) AS DOUBLE)"}
    return forms.get(word, "NULL")


@function("vector.coordinates", "ls")
def _coordinates(c, a):
    word = a[1].lit.upper() if isinstance(a[1].lit, str) else ""
    if word.startswith("INT"):
        return f"transform({a[0].sql}, v -> CAST(v AS BIGINT))"
    return f"transform({a[0].sql}, v -> CAST(v AS DOUBLE))" if word.startswith("FLOAT") else "NULL"


# -- nodes, edges, paths -------------------------------------------------
def _own_keys(v) -> str:
    """Names of the properties that aren't null."""
    parts = ", ".join(f"if({s} IS NULL, NULL, {quoted(k)})" for k, s in sorted(Entries.of(v)))
    return f"if({v.sql} IS NULL, NULL, array_compact(CAST(array({parts}) AS ARRAY<STRING>)))"


def _own_properties(v) -> str:
    e = Entries.of(v)
    return f"if({v.sql} IS NULL, NULL, {'named_struct(' + ', '.join(f'{quoted(k)}, {s}' for k, s in e) + ')' if e else 'map()'})"


def _of(name: str, wanted: str, build):
    @function(name, "a")
    def made(c, a):
        return build(a[0]) if a[0].kind == wanted else "NULL"


_of("node.id", "node", lambda v: f"{v.sql}._id")
_of("node.labels", "node", lambda v: f"{v.sql}._labels")
_of("node.keys", "node", _own_keys)
_of("node.properties", "node", _own_properties)
_of("edge.id", "edge", lambda v: f"{v.sql}._id")
_of("edge.type", "edge", lambda v: f"{v.sql}._type")
_of("edge.keys", "edge", _own_keys)
_of("edge.properties", "edge", _own_properties)
_of("path.nodes", "path", lambda v: f"{v.sql}.nodes")
_of("path.edges", "path", lambda v: f"{v.sql}.rels")
_of("path.first", "path", lambda v: f"get({v.sql}.nodes, 0)")
_of("path.last", "path", lambda v: f"get({v.sql}.nodes, size({v.sql}.nodes) - 1)")


@function("node.has_label", "as")
def _has_label(c, a):
    return f"array_contains({a[0].sql}._labels, {a[1].sql})" if a[0].kind == "node" else "NULL"


@function("edge.start", "a")
def _start(c, a):
    return c.endpoint(a[0], "_src")


@function("edge.end", "a")
def _end(c, a):
    return c.endpoint(a[0], "_dst")


@function("path.length", "a")
def _length(c, a):
    if a[0].kind == "path":
        return f"CAST(size({a[0].sql}.rels) AS BIGINT)"
    return FUNCTIONS["value.size"].build(c, a)


# -- value ---------------------------------------------------------------
@function("value.size", "a")
def _size(c, a):
    v = a[0]
    sql = {"list": f"size({v.sql})", "string": f"length({v.sql})", "path": f"size({v.sql}.rels)", "binary": f"octet_length({v.sql})"}.get(v.kind)
    if v.kind == "map":
        return FUNCTIONS["map.size"].build(c, a)
    return f"if({v.sql} IS NULL, NULL, CAST({sql} AS BIGINT))" if sql else "NULL"


@function("value.keys", "a")
def _keys(c, a):
    return _own_keys(a[0]) if a[0].kind in ("node", "edge") else FUNCTIONS["map.keys"].build(c, a) if a[0].kind == "map" else "NULL"


@function("value.properties", "a")
def _properties(c, a):
    return _own_properties(a[0]) if a[0].kind in ("node", "edge") else a[0].sql if a[0].kind == "map" else "NULL"


@function("value.reverse", "a")
def _reverse(c, a):
    return f"reverse({a[0].sql})" if a[0].kind in ("list", "string") else "NULL"


@function("value.coalesce", "a", low=1, high=MANY)
def _coalesce(c, a):
    return f"coalesce({', '.join(x.sql for x in a)})"


template("value.is_null", "a", "({0} IS NULL)")
template("value.is_not_null", "a", "({0} IS NOT NULL)")


@function("value.id", "a")
def _id(c, a):
    return f"{a[0].sql}._id" if a[0].kind in ("node", "edge") else "NULL"


# -- type and cast -------------------------------------------------------
@function("type.of", "a")
def _type_of(c, a):
    return f"if({a[0].sql} IS NULL, 'NULL', {quoted(type_name(a[0].type))})"


def _same(expected: str, actual: str) -> bool:
    expected = expected.upper().replace("ZONED DATETIME", "DATETIME").replace("LOCAL DATETIME", "LOCAL_DATETIME").replace(" ", "")
    expected = {"INT": "INTEGER", "BOOL": "BOOLEAN", "RELATIONSHIP": "EDGE"}.get(expected, expected)
    if expected == "ANY":
        return True
    if expected == "LIST":
        return actual.startswith("LIST")
    if expected.startswith("LIST<") and actual.startswith("LIST<"):
        return _same(expected[5:-1], actual[5:-1])
    return expected == actual


@function("type.is", "as")
def _type_is(c, a):
    if not isinstance(a[1].lit, str):
        return "NULL"
    inner = "true" if _same(a[1].lit, type_name(a[0].type)) else "false"
    return f"if({a[0].sql} IS NULL, {'true' if _same(a[1].lit, 'NULL') else 'false'}, {inner})"


def cast(c, v, to: str, strict: bool) -> str:
    """SQL of a cast: failing raises if ``strict``, else gives null; a combination without a rule gives null, or an error."""
    to = to.upper().strip()
    how = "CAST" if strict else "try_cast"
    k, s = v.kind, v.sql
    if k == "null":
        return "NULL"
    bad = f"raise_error({quoted(f'cannot cast {type_name(v.type)} to {to}')})" if strict else "NULL"
    none = f"if({s} IS NULL, NULL, {bad})" if strict else "NULL"
    if to in ("STRING", "TEXT"):
        if k in ("date", "datetime", "localdatetime", "duration"):
            return text_of(s, k)
        if k == "number" and not isinstance(v.type, INTEGRAL):
            return f"regexp_replace(CAST({s} AS STRING), '\\\\.0$', '')"
        return f"CAST({s} AS STRING)" if k in ("string", "number", "bool", "any") else f"CAST({none} AS STRING)"
    if to in ("INTEGER", "INT"):
        if k == "string":
            no = f"CAST(if({s} IS NULL, NULL, raise_error(concat('cannot cast ', {s}, ' to INTEGER'))) AS STRING)" if strict else "NULL"
            return f"{how}(if({s} RLIKE '^[+-]?[0-9]+$', {s}, {no}) AS BIGINT)"
        if k == "number":
            return f"{how}({s} AS BIGINT)"
        return f"CAST({s} AS BIGINT)" if k == "bool" else f"{how}({s} AS BIGINT)" if k == "any" else f"CAST({none} AS BIGINT)"
    if to == "FLOAT":
        return f"{how}({s} AS DOUBLE)" if k in ("string", "number", "any") else f"CAST({none} AS DOUBLE)"
    if to in ("BOOLEAN", "BOOL"):
        if k == "string":
            return f"CASE lower({s}) WHEN 'true' THEN true WHEN 'false' THEN false ELSE CAST({none} AS BOOLEAN) END"
        if k == "number" and isinstance(v.type, INTEGRAL):
            return f"({s} <> 0)"
        return s if k == "bool" else f"CAST({none} AS BOOLEAN)"
    sql = {"DATE": "DATE", "DATETIME": "TIMESTAMP", "ZONED DATETIME": "TIMESTAMP", "LOCAL DATETIME": "TIMESTAMP_NTZ", "LOCAL_DATETIME": "TIMESTAMP_NTZ"}.get(to)
    if sql:
        if k == "string" or k in ("date", "datetime", "localdatetime"):
            return f"{how}({s} AS {sql})"
        if k == "map" and isinstance(v.type, T.StructType):
            c.called = {"DATE": "date", "TIMESTAMP": "datetime", "TIMESTAMP_NTZ": "localdatetime"}[sql]
            return FUNCTIONS["temporal.now"].build(c, [v])
        return f"CAST({none} AS {sql})"
    if to in ("TIME", "ZONED TIME", "LOCAL TIME", "LOCAL_TIME"):
        local = to.startswith("LOCAL")
        if k == "string":
            return parse_time(s, local)
        return s if k == ("localtime" if local else "time") else none
    if to == "DURATION":
        return parse_duration(s) if k == "string" else s if k == "duration" else none
    if to == "POINT":
        return FUNCTIONS["geo.point"].build(c, [v]) if k == "map" else s if k == "point" else none
    if to.startswith("VECTOR"):
        if k != "list":
            return none
        element = "FLOAT" if "FLOAT32" in to else "DOUBLE" if "FLOAT" in to or "<" not in to else "BIGINT"
        size = to.partition("(")[2].rstrip(")")
        out = f"transform({s}, v -> CAST(v AS {element}))"
        return f"if(size({s}) = {int(size)}, {out}, NULL)" if size else out
    if to == "MAP":
        return s if k == "map" else none
    if to.startswith("LIST"):
        if k != "list":
            return none
        return s if to == "LIST" else f"transform({s}, v -> {cast(c, c.val('v', v.type.elementType), to[5:-1].replace(' NOT NULL', ''), strict)})"
    return s if to == "ANY" else none


def _cast_call(strict: bool):
    def build(c, a):
        to = a[1].lit if len(a) > 1 else CAST_NAMES.get(c.called.removesuffix("ornull"))
        return cast(c, a[0], to, strict) if isinstance(to, str) else "NULL"

    return build


function("cast.to", "as", low=1)(_cast_call(True))
function("cast.try", "as", low=1)(_cast_call(False))


@function("cast.can", "as")
def _can(c, a):
    if not isinstance(a[1].lit, str):
        return "NULL"
    return f"(({cast(c, a[0], a[1].lit, False)}) IS NOT NULL)"

