"""The test tables as a property graph."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quiver.graph.property_graph import EdgeTable, IndexDef, LazyFrame, NodeTable, PropertyGraph

_KEYS = {
    "Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"),
    "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey"), "Event": ("events", "event_id"), "Document": ("documents", "doc_id"), "Embedding": ("embeddings", "vec_id"),
}


#: what has been found out about the keys of each folder's tables, by application and folder
_known: dict[tuple[str, str], dict] = {}


def trade_graph(spark: SparkSession, sf: str) -> PropertyGraph:
    """Customers, orders, parts, suppliers, nations and regions; users and events; documents; embeddings.

    Foreign keys are relationships owned by their row; line items are the
    relationships between orders and parts, and between suppliers and orders.
    """
    read = lambda t: LazyFrame(lambda: spark.read.parquet(f"{sf}/{t}.parquet"))
    frames = {label: read(t) for label, (t, _) in _KEYS.items()}
    nodes = [NodeTable(label, df, _KEYS[label][1], (label,)) for label, df in frames.items()]
    nodes.append(NodeTable("User", LazyFrame(lambda: frames["Event"].select("user_id").distinct()), "user_id", ("User",)))
    items = read("lineitem")

    def owned(type_: str, source: str, target: str, of: str, src: str, dst: str, *checked: str) -> EdgeTable:
        df = frames[source if of == "src" else target]
        key = _KEYS[source if of == "src" else target][1]
        return EdgeTable(type_, df, key, src, dst, source, target, of, ("*",), checked)

    line = "(l_orderkey * 10 + l_linenumber)"
    edges = (
        owned("PLACED", "Customer", "Order", "dst", "o_custkey", "o_orderkey"),
        EdgeTable("CONTAINS", items, line, "l_orderkey", "l_partkey", "Order", "Part"),
        EdgeTable("SUPPLIED", items, line, "l_suppkey", "l_orderkey", "Supplier", "Order"),
        owned("IN_NATION", "Customer", "Nation", "src", "c_custkey", "c_nationkey"),
        owned("IN_NATION", "Supplier", "Nation", "src", "s_suppkey", "s_nationkey"),
        owned("IN_REGION", "Nation", "Region", "src", "n_nationkey", "n_regionkey"),
        owned("DID", "User", "Event", "dst", "user_id", "event_id", "src"),  # users are taken from the events
    )
    indexes = (
        IndexDef("doc_text", "FULLTEXT", "NODE", ("Document",), ("text",)),
        IndexDef("emb", "VECTOR", "NODE", ("Embedding",), ("embedding",), {"similarity": "cosine"}),
    )
    return PropertyGraph(spark, tuple(nodes), edges, indexes=indexes, known=_known.setdefault((spark.sparkContext.applicationId, sf), {}))
