"""Single nodes and relationships by id, for programs that don't want to write queries.

Each method is one statement on the engine's graph.  They suit single changes
by hand; many changes belong in one query, and a feed of them in an
equality-delete table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Row

from quiver.plans.values import ident


class GraphApi:
    """Creates, reads, changes and deletes the nodes and relationships of an ``Engine``."""

    def __init__(self, engine):
        self.engine = engine

    def _one(self, text: str, **params):
        rows = self.engine.execute(text, params).take(1)
        return rows[0][0] if rows else None

    @staticmethod
    def _labels(labels: Iterable[str]) -> str:
        return "".join(f":{ident(x)}" for x in labels)

    # -- nodes ------------------------------------------------------------
    def create_node(self, labels: Iterable[str] = (), properties: dict | None = None) -> int:
        return self._one(f"CREATE (n{self._labels(labels)} $p) RETURN id(n)", p=properties or {})

    def node(self, id: int) -> Row | None:
        """The node as a row of _id, _labels and its properties; None if there is none."""
        return self._one("MATCH (n) WHERE id(n) = $id RETURN n", id=id)

    def set_node(self, id: int, properties: dict, replace: bool = False) -> None:
        """Add or change properties, or put them in the place of all there are."""
        self.engine.execute(f"MATCH (n) WHERE id(n) = $id SET n {'=' if replace else '+='} $p", {"id": id, "p": properties})

    def remove_properties(self, id: int, *names: str) -> None:
        self.engine.execute("MATCH (n) WHERE id(n) = $id REMOVE " + ", ".join(f"n.{ident(x)}" for x in names), {"id": id})

    def add_labels(self, id: int, *labels: str) -> None:
        self.engine.execute(f"MATCH (n) WHERE id(n) = $id SET n{self._labels(labels)}", {"id": id})

    def remove_labels(self, id: int, *labels: str) -> None:
        self.engine.execute(f"MATCH (n) WHERE id(n) = $id REMOVE n{self._labels(labels)}", {"id": id})

    def delete_node(self, id: int, detach: bool = False) -> None:
        self.engine.execute(f"MATCH (n) WHERE id(n) = $id {'DETACH ' if detach else ''}DELETE n", {"id": id})

    # -- relationships ----------------------------------------------------
    def create_relationship(self, type: str, source: int, target: int, properties: dict | None = None) -> int | None:
        """The new relationship's id; None if an end doesn't exist."""
        return self._one(f"MATCH (a), (b) WHERE id(a) = $a AND id(b) = $b CREATE (a)-[r:{ident(type)} $p]->(b) RETURN id(r)", a=source, b=target, p=properties or {})

    def relationship(self, type: str, id: int) -> Row | None:
        """The relationship as a row of _id, _type, _src, _dst and its properties; ids are unique within a type."""
        return self._one(f"MATCH ()-[r:{ident(type)}]->() WHERE id(r) = $id RETURN r", id=id) if type in self.engine.graph.types() else None

    def set_relationship(self, type: str, id: int, properties: dict, replace: bool = False) -> None:
        self.engine.execute(f"MATCH ()-[r:{ident(type)}]->() WHERE id(r) = $id SET r {'=' if replace else '+='} $p", {"id": id, "p": properties})

    def delete_relationship(self, type: str, id: int) -> None:
        self.engine.execute(f"MATCH ()-[r:{ident(type)}]->() WHERE id(r) = $id DELETE r", {"id": id})
