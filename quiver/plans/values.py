"""SQL text for values, and the kinds of Spark types that the language tells apart."""

from __future__ import annotations

import datetime as dt
import math
from typing import Any

from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DURATION = "STRUCT<months: BIGINT, days: BIGINT, seconds: BIGINT, nanos: BIGINT>"
POINT = "STRUCT<srid: INT, x: DOUBLE, y: DOUBLE, z: DOUBLE>"
TIME = "STRUCT<time_nanos: BIGINT, offset: INT>"


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(s: str) -> str:
    return "`" + s.replace("`", "``") + "`"


def literal(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        if not -(2**63) <= v < 2**63:
            raise ValueError(f"{v} is beyond 64 bits")
        return f"{v}L" if v > -(2**63) else f"CAST('{v}' AS BIGINT)"
    if isinstance(v, float):
        return f"CAST('{'NaN' if math.isnan(v) else 'Infinity' if v > 0 else '-Infinity'}' AS DOUBLE)" if math.isnan(v) or math.isinf(v) else f"{v!r}D"
    if isinstance(v, str):
        return quoted(v)
    if isinstance(v, (bytes, bytearray)):
        return f"X'{bytes(v).hex()}'"
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP'{v.isoformat(' ')}'" if v.tzinfo else f"TIMESTAMP_NTZ'{v.isoformat(' ')}'"
    if isinstance(v, dt.date):
        return f"DATE'{v.isoformat()}'"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(map(literal, v)) + ")"
    if isinstance(v, dict):
        return "named_struct(" + ", ".join(f"{quoted(k)}, {literal(x)}" for k, x in v.items()) + ")"
    raise TypeError(f"no literal for {type(v).__name__}")


def fields(t: T.DataType) -> list[str]:
    return t.names if isinstance(t, T.StructType) else []


def kind(t: T.DataType) -> str:
    """One word for what the language treats alike."""
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, NUMERIC):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, T.TimestampType):
        return "datetime"
    if isinstance(t, T.TimestampNTZType):
        return "localdatetime"
    if isinstance(t, T.BinaryType):
        return "binary"
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, T.MapType):
        return "map"
    if isinstance(t, T.VariantType):
        return "any"
    if isinstance(t, T.StructType):
        names = t.names
        if "_id" in names and "_labels" in names:
            return "node"
        if "_id" in names and "_type" in names:
            return "edge"
        if names == ["nodes", "rels"]:
            return "path"
        if names == ["months", "days", "seconds", "nanos"]:
            return "duration"
        if names == ["srid", "x", "y", "z"]:
            return "point"
        if names == ["time_nanos", "offset"]:
            return "time"
        if names == ["local_nanos"]:
            return "localtime"
        return "map"
    return "other"


def type_name(t: T.DataType) -> str:
    """What ``type.of`` says."""
    k = kind(t)
    if k == "number":
        return "INTEGER" if isinstance(t, INTEGRAL) else "FLOAT"
    if k == "list":
        return f"LIST<{type_name(t.elementType)}>" if kind(t.elementType) != "null" else "LIST"
    return {"null": "NULL", "bool": "BOOLEAN", "localdatetime": "LOCAL_DATETIME", "localtime": "LOCAL_TIME"}.get(k, k.upper())
