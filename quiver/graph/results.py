"""Forms of a result on the driver: rows, arrays, a graph, or both."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame, Row

FORMATS = ("rows", "row_arrays", "graph", "combined")


def plain(v: Any) -> Any:
    """A value of a result as plain Python: structs become dicts, dates ISO text."""
    if isinstance(v, Row):
        d = v.asDict()
        if "_id" in d and "_labels" in d:
            return {"kind": "node", "id": d["_id"], "labels": list(d["_labels"] or []), "properties": _properties(d)}
        if "_id" in d and "_type" in d:
            return {"kind": "relationship", "id": d["_id"], "type": d["_type"], "start": d.get("_src"), "end": d.get("_dst"), "properties": _properties(d)}
        return {k: plain(x) for k, x in d.items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return bytes(v) if isinstance(v, bytearray) else v.toPython() if type(v).__name__ == "VariantVal" else v


def _properties(d: dict) -> dict:
    return {k: plain(x) for k, x in d.items() if not k.startswith("_") and x is not None}


def _parts(v: Any, nodes: dict, edges: dict) -> None:
    if isinstance(v, dict):
        if v.get("kind") == "node":
            nodes[tuple(v["labels"]), v["id"]] = v
        elif v.get("kind") == "relationship":
            edges[v["type"], v["id"]] = v
        else:
            for x in v.values():
                _parts(x, nodes, edges)
    elif isinstance(v, list):
        for x in v:
            _parts(x, nodes, edges)


def encode(df: DataFrame, form: str = "graph") -> dict:
    """A result, gathered on the driver.  For results that fit there; large ones are written by Spark or streamed."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}")
    rows = [[plain(v) for v in r] for r in df.toLocalIterator()]
    out: dict[str, Any] = {"columns": df.columns}
    if form in ("rows", "combined"):
        out["rows"] = [dict(zip(df.columns, r)) for r in rows]
    if form == "row_arrays":
        out["rows"] = rows
    if form in ("graph", "combined"):
        nodes: dict = {}
        edges: dict = {}
        _parts(rows, nodes, edges)
        out |= {"nodes": list(nodes.values()), "relationships": list(edges.values())}
    return out
