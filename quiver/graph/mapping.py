"""Rows to vertices and relationships, declaratively."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from quiver.graph.property_graph import ID, EdgeTable, NodeTable, PropertyGraph


@dataclass(frozen=True)
class NodeMapping:
    """Rows become nodes with ``label``; ``id_column`` is their key, ``properties`` (column -> property, default all) what they hold."""

    label: str
    id_column: str
    properties: dict[str, str] | None = None


@dataclass(frozen=True)
class RelationshipMapping:
    """Rows become relationships between nodes found by a property: start_column holds the value of start_key of a start_label node, and so on."""

    type: str
    start_label: str
    start_key: str
    start_column: str
    end_label: str
    end_key: str
    end_column: str
    properties: dict[str, str] | None = None


def add_nodes(graph: PropertyGraph, rows: DataFrame, m: NodeMapping) -> PropertyGraph:
    """The graph with the rows as nodes; rows without a key are left out, of rows with one key any one stays."""
    props = m.properties or {c: c for c in rows.columns}
    df = rows.filter(F.col(f"`{m.id_column}`").isNotNull()).dropDuplicates([m.id_column])
    df = df.select(F.col(f"`{m.id_column}`").alias("_key"), *[F.col(f"`{c}`").alias(p) for c, p in props.items()])
    table = NodeTable(m.label, df, "_key", (m.label,))
    return replace(graph, nodes=(*[t for t in graph.nodes if t.name != m.label], table))


def add_relationships(graph: PropertyGraph, rows: DataFrame, m: RelationshipMapping) -> PropertyGraph:
    """The graph with a relationship for each row and each pair of nodes that it names; two equi-joins, or none where the keys are the nodes' own."""
    props = m.properties or {}
    df = rows.select(F.xxhash64(*rows.columns).alias("_row"), F.col(f"`{m.start_column}`").alias("_s"), F.col(f"`{m.end_column}`").alias("_e"), *[F.col(f"`{c}`").alias(p) for c, p in props.items()])
    df = df.filter(F.col("_s").isNotNull() & F.col("_e").isNotNull())
    for side, label, key in (("_s", m.start_label, m.start_key), ("_e", m.end_label, m.end_key)):
        t = graph.node_table(label)
        ends = t.df.select(F.col(f"`{t.id}`").alias(f"{side}_id"), F.col(f"`{key}`").alias(f"{side}_key"))
        df = df.join(ends, df[side] == ends[f"{side}_key"]).drop(f"{side}_key", side)
    df = df.withColumn(ID, F.xxhash64("_row", "_s_id", "_e_id", F.monotonically_increasing_id())).drop("_row")
    edge = EdgeTable(m.type, df, ID, "_s_id", "_e_id", m.start_label, m.end_label)
    return replace(graph, edges=(*graph.edges, edge))
