"""Property graphs over DataFrames: vertex tables, edge tables and a catalog.

A graph is an immutable value.  A vertex table holds the nodes that bear its
labels; with a label column its rows may bear further ones.  An edge table holds
the relationships of one type between two vertex tables; where each of its rows
is a row of a vertex table (a foreign key), it says so and costs no join of its
own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import DataType

from quiver.operators.versions import Versions
from quiver.workdir import materialise

ID, LABELS, TYPE, SRC, DST = "_id", "_labels", "_type", "_src", "_dst"


class UnknownName(ValueError):
    """A label, relationship type or property that the graph doesn't have."""


class DamagedGraph(RuntimeError):
    """A saved table that doesn't hold what was written."""


class LazyFrame:
    """A DataFrame that is only opened when it is used: a query doesn't read the footers of tables it doesn't touch."""

    def __init__(self, load: Callable[[], DataFrame]):
        self._load, self._frame = load, None

    def _get(self) -> DataFrame:
        if self._frame is None:
            self._frame = self._load()
        return self._frame

    def __getattr__(self, name: str):
        return getattr(self._get(), name)

    def __getitem__(self, item):
        return self._get()[item]


@dataclass(frozen=True)
class NodeTable:
    """Nodes with ``labels``; ``id`` names their key column, ``label_column`` an array of further labels."""

    name: str
    df: DataFrame
    id: str
    labels: tuple[str, ...] = ()
    label_column: str | None = None
    layers: int = 0  # changes that lie on top of what is written

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c != self.label_column and not c.startswith("_")]

    def types(self) -> dict[str, DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields}


@dataclass(frozen=True)
class EdgeTable:
    """Relationships of one type from ``source`` to ``target``; id, src and dst are SQL over the columns of ``df``.

    owner: "src" or "dst" if each row is the row of that end's vertex table;
    hidden: columns that aren't properties of the relationship, ("*",) for all;
    checked: ends ("src", "dst") that are known to be rows of their vertex table.
    """

    type: str
    df: DataFrame
    id: str
    src: str
    dst: str
    source: str
    target: str
    owner: str | None = None
    hidden: tuple[str, ...] = ()
    checked: tuple[str, ...] = ()
    layers: int = 0

    @property
    def properties(self) -> list[str]:
        return [] if self.hidden == ("*",) else [c for c in self.df.columns if not c.startswith("_") and c not in self.hidden]

    def types(self) -> dict[str, DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields}


@dataclass(frozen=True)
class IndexDef:
    name: str
    kind: str
    entity: str
    names: tuple[str, ...]
    properties: tuple[str, ...]
    options: Mapping = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class ConstraintDef:
    name: str
    kind: str
    entity: str
    names: tuple[str, ...]
    properties: tuple[str, ...]
    types: tuple[str, ...] = ()


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    nodes: tuple[NodeTable, ...] = ()
    edges: tuple[EdgeTable, ...] = ()
    known_labels: frozenset[str] = frozenset()
    indexes: tuple[IndexDef, ...] = ()
    constraints: tuple[ConstraintDef, ...] = ()
    #: what is known of (edge type, source, target, end): whether all its keys are rows of the vertex table; shared by versions
    known: dict = field(default_factory=dict, compare=False, repr=False)
    #: inverted indexes by name: (the tables they were built of, folder); one is used as long as these are the graph's tables
    built: dict = field(default_factory=dict, compare=False, repr=False)
    #: the next node id and relationship id, once they have been looked up
    next_ids: tuple[int, int] | None = None

    # -- building ---------------------------------------------------------
    @staticmethod
    def generic(nodes: DataFrame, edges: Mapping[str, DataFrame], labels: set[str] | frozenset[str]) -> PropertyGraph:
        """A graph of one vertex table (_id, _labels, properties…) and a table (_id, _src, _dst, properties…) for each type."""
        return PropertyGraph(
            nodes.sparkSession,
            (NodeTable("nodes", nodes, ID, (), LABELS),),
            tuple(EdgeTable(t, df, ID, SRC, DST, "nodes", "nodes") for t, df in edges.items()),
            frozenset(labels),
        )

    @staticmethod
    def empty(spark: SparkSession) -> PropertyGraph:
        return PropertyGraph.generic(spark.createDataFrame([], f"{ID} long, {LABELS} array<string>"), {}, set())

    @staticmethod
    def of_rows(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> PropertyGraph:
        """A small graph from Python rows: nodes with id, labels and properties, edges with id, type, src, dst and properties."""
        from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

        def kind(values):
            v = next((x for x in values if x is not None), None)
            if isinstance(v, bool):
                return BooleanType()
            if isinstance(v, list):
                return ArrayType(kind(v))
            if isinstance(v, float) or any(isinstance(x, float) for x in values):
                return DoubleType()
            return LongType() if isinstance(v, int) else StringType()

        def frame(rows, fixed):
            keys = [k for k in dict.fromkeys(k for r in rows for k in r) if k not in ("id", "labels", "type", "src", "dst")]
            types = {k: kind([r.get(k) for r in rows]) for k in keys}
            conv = lambda k, v: float(v) if isinstance(types[k], DoubleType) and v is not None else v
            schema = StructType([*fixed, *(StructField(k, types[k]) for k in keys)])
            head = [f.name[1:] for f in fixed]
            return spark.createDataFrame([[r[h] for h in head] + [conv(k, r.get(k)) for k in keys] for r in rows], schema)

        n = frame(nodes, [StructField(ID, LongType()), StructField(LABELS, ArrayType(StringType()))])
        types = dict.fromkeys(e["type"] for e in edges)
        per = {t: frame([e for e in edges if e["type"] == t], [StructField(x, LongType()) for x in (ID, SRC, DST)]) for t in types}
        return PropertyGraph.generic(n, per, {x for r in nodes for x in r["labels"]})

    # -- catalog ----------------------------------------------------------
    def labels(self) -> set[str]:
        return {x for t in self.nodes for x in t.labels} | set(self.known_labels)

    def types(self) -> set[str]:
        return {e.type for e in self.edges}

    def property_keys(self) -> set[str]:
        return {p for t in (*self.nodes, *self.edges) for p in t.properties}

    def node_table(self, name: str) -> NodeTable:
        return next(t for t in self.nodes if t.name == name)

    def is_generic(self) -> bool:
        return len(self.nodes) == 1 and self.nodes[0].label_column == LABELS and self.nodes[0].id == ID and not self.nodes[0].labels

    def intact(self, e: EdgeTable, end: str) -> bool:
        """Whether every key at an end of an edge table is a row of its vertex table: found out once, by an anti-join.

        Where it isn't, a relationship of which that end is missing doesn't
        exist, and matching has to look; where it is, an end's key is enough.
        """
        if end in e.checked or e.owner == end:
            return True
        name = (e.type, e.source, e.target, end)
        if name not in self.known:
            column, table = (e.src, e.source) if end == "src" else (e.dst, e.target)
            t = self.node_table(table)
            ends = e.df.selectExpr(f"{column} AS _end").filter("_end IS NOT NULL")
            self.known[name] = ends.join(t.df.selectExpr(f"`{t.id}` AS _node"), F.col("_end") == F.col("_node"), "left_anti").isEmpty()
        return self.known[name]

    # -- small graph API --------------------------------------------------
    def degree(self, direction: str = "both") -> DataFrame:
        """(table, id, degree) of the nodes that have a relationship."""
        parts = []
        for e in self.edges:
            for side, end, table in (("out", e.src, e.source), ("in", e.dst, e.target)):
                if direction in (side, "both"):
                    parts.append(e.df.select(F.lit(table).alias("table"), F.expr(end).cast("long").alias("id")))
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.unionByName(p)
        return all_.groupBy("table", "id").agg(F.count(F.lit(1)).alias("degree"))

    def neighbours(self, label: str, direction: str = "both", types: tuple[str, ...] = ()) -> DataFrame:
        """(id, type, table, other) of the nodes next to those of a vertex table."""
        parts = []
        for e in self.edges:
            if types and e.type not in types:
                continue
            for side, own, table, end, far in (("out", e.src, e.source, e.dst, e.target), ("in", e.dst, e.target, e.src, e.source)):
                if table == label and direction in (side, "both"):
                    parts.append(e.df.select(F.expr(own).cast("long").alias("id"), F.lit(e.type).alias("type"), F.lit(far).alias("table"), F.expr(end).cast("long").alias("other")))
        if not parts:
            return self.spark.createDataFrame([], "id long, type string, table string, other long")
        return reduce(lambda a, b: a.unionByName(b), parts).filter("id IS NOT NULL AND other IS NOT NULL")

    def counts(self) -> dict[str, int]:
        return {"nodes": sum(t.df.count() for t in self.nodes), "relationships": sum(e.df.count() for e in self.edges)}

    # -- mutable form -----------------------------------------------------
    def as_generic(self) -> PropertyGraph:
        """This graph as one vertex table with ids unique over all labels; a graph already of that form as it is."""
        if self.is_generic():
            return self
        order = {t.name: i for i, t in enumerate(self.nodes)}
        shift = max(1, len(order))
        mapped = lambda c, table: (F.expr(c).cast("long") * shift + order[table])
        nodes = None
        for t in self.nodes:
            labels = F.array(*map(F.lit, t.labels)) if not t.label_column else F.array_union(F.array(*map(F.lit, t.labels)).cast("array<string>"), F.col(t.label_column))
            part = t.df.select(mapped(f"`{t.id}`", t.name).alias(ID), labels.cast("array<string>").alias(LABELS), *[f"`{p}`" for p in t.properties])
            nodes = part if nodes is None else nodes.unionByName(part, allowMissingColumns=True)
        edges: dict[str, DataFrame] = {}
        for e in self.edges:
            part = e.df.select(F.expr(e.id).cast("long").alias(ID), mapped(e.src, e.source).alias(SRC), mapped(e.dst, e.target).alias(DST), *[f"`{p}`" for p in e.properties])
            part = part.filter(F.col(SRC).isNotNull() & F.col(DST).isNotNull())
            edges[e.type] = part if e.type not in edges else edges[e.type].unionByName(part, allowMissingColumns=True)
        out = PropertyGraph.generic(nodes, edges, self.labels())
        # what is known already of the ends goes over; the rest is found out when it is asked for
        sound = lambda x, end: True if end in x.checked or x.owner == end else self.known.get((x.type, x.source, x.target, end))
        known = {}
        for e in out.edges:
            for end in ("src", "dst"):
                parts = [sound(x, end) for x in self.edges if x.type == e.type]
                if False in parts or None not in parts:
                    known[e.type, "nodes", "nodes", end] = False not in parts
        return replace(out, indexes=self.indexes, constraints=self.constraints, known=known)

    def frozen(self) -> PropertyGraph:
        """The same graph read from written tables."""
        return replace(
            self,
            nodes=tuple(replace(t, df=materialise(t.df, f"graph-{t.name}")) for t in self.nodes),
            edges=tuple(replace(e, df=materialise(e.df, "graph-edges")) for e in self.edges),
        )

    # -- files ------------------------------------------------------------
    def save(self, path: str) -> int:
        """Write the graph as Parquet folders and publish them as the next version under ``path``; gives its number.

        Every save has folders of its own and becomes visible by one rename, so
        one that fails leaves the version before it as it was.  Each table's
        number of rows and checksum are taken as it is written.
        """
        versions = Versions(self.spark, path)
        base = versions.latest()
        spec = {
            "nodes": [{"name": t.name, "id": t.id, "labels": t.labels, "label_column": t.label_column} for t in self.nodes],
            "edges": [{"type": e.type, "id": e.id, "src": e.src, "dst": e.dst, "source": e.source, "target": e.target, "hidden": e.hidden, "checked": e.checked} for e in self.edges],
            "labels": sorted(self.known_labels),
            "indexes": [{**vars(i), "options": dict(i.options)} for i in self.indexes],
            "constraints": [vars(c) for c in self.constraints],
            "folders": [], "sums": [],
        }
        for t in (*self.nodes, *self.edges):
            spec["folders"].append(versions.folder("table"))
            seen = Observation()
            t.df.observe(seen, *_digest(t.df)).write.parquet(f"{path}/{spec['folders'][-1]}")
            spec["sums"].append([seen.get["rows"], seen.get["sum"] or 0])
        return versions.publish(spec, base)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None, verify: bool = False) -> PropertyGraph:
        """A saved version, the last one by default; ``verify`` reads all tables and raises DamagedGraph if one isn't what was written."""
        versions = Versions(spark, path)
        spec = versions.read(versions.latest() if version is None else version)
        tup = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
        frames = [spark.read.parquet(f"{path}/{f}") for f in spec["folders"]]
        if verify:
            for df, folder, want in zip(frames, spec["folders"], spec["sums"]):
                got = df.agg(*_digest(df)).first()
                if [got["rows"], got["sum"] or 0] != want:
                    raise DamagedGraph(f"{path}/{folder} isn't as it was written")
        n = len(spec["nodes"])
        return PropertyGraph(
            spark,
            tuple(NodeTable(df=df, **tup(d)) for df, d in zip(frames, spec["nodes"])),
            tuple(EdgeTable(df=df, **tup(d)) for df, d in zip(frames[n:], spec["edges"])),
            frozenset(spec["labels"]),
            tuple(IndexDef(**tup(d)) for d in spec["indexes"]),
            tuple(ConstraintDef(**tup(d)) for d in spec["constraints"]),
        )


def _digest(df: DataFrame):
    """The number of rows and the sum of their hashes: neither order nor partitioning matters."""
    plain = [F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.count(F.lit(1)).alias("rows"), F.sum(F.pmod(F.xxhash64(*plain), F.lit(1 << 31))).alias("sum")
