"""The entry point: run queries on a graph."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

from quiver.graph.api import GraphApi
from quiver.graph.property_graph import PropertyGraph
from quiver.lang import ast as A
from quiver.lang.parser import parse
from quiver.plans.compiler import Compiler
from quiver.plans.expressions import QueryError

_UPDATES = (A.Create, A.Merge, A.Set_, A.Remove, A.Delete, A.Foreach)


def updates(q) -> bool:
    """Whether a parsed statement changes the graph or its catalog."""
    if isinstance(q, A.Query):
        return any(isinstance(c, _UPDATES) for p in q.parts for c in p)
    return isinstance(q, A.Schema) and not q.what.startswith("show")


class Engine:
    """Holds the current version of a graph.

    ``execute`` runs a text and gives a DataFrame; reading is lazy.  A query
    that changes the graph replaces the version held by a new one, all at once
    and only if it succeeds.
    """

    def __init__(self, graph: PropertyGraph):
        self.graph, self.spark, self._plans = graph, graph.spark, {}

    def parsed(self, text: str):
        if text not in self._plans:
            if len(self._plans) >= 256:
                self._plans.pop(next(iter(self._plans)))
            self._plans[text] = parse(text)
        return self._plans[text]

    def execute(self, text: str, params: dict | None = None) -> DataFrame:
        q = self.parsed(text)
        if isinstance(q, A.Query):
            if updates(q):
                from quiver.plans.mutations import Writer

                writer = Writer(self.spark, self.graph, params)
                out = writer.query(q)
                self.graph = writer.graph
                return out
            return Compiler(self.spark, self.graph, params).query(q)
        from quiver.plans.commands import run_command

        out, self.graph = run_command(self.graph, q, params or {})
        return out

    def stream(self, text: str, params: dict | None = None) -> tuple[list[str], Iterator[Row]]:
        """The columns, known even without rows, and the rows one partition at a time."""
        df = self.execute(text, params)
        return df.columns, df.toLocalIterator(prefetchPartitions=True)

    def collect(self, text: str, params: dict | None = None, timeout: float | None = None) -> list[Row]:
        """The rows; after ``timeout`` seconds the query's jobs are cancelled and TimeoutError is raised."""
        df = self.execute(text, params)
        if timeout is None:
            return df.collect()
        sc = self.spark.sparkContext
        tag, late = f"quiver-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(timeout, stop)
        sc.addJobTag(tag)
        timer.start()
        try:
            return df.collect()
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"the query took more than {timeout} seconds") from e
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    def explain(self, text: str, params: dict | None = None) -> str:
        """The statement's clauses and Spark's formatted plan; a statement that changes the graph isn't run."""
        q = self.parsed(text)
        head = "\n".join(f"{'  ' * i}{type(c).__name__}" for p in q.parts for i, c in enumerate(p)) if isinstance(q, A.Query) else type(q).__name__
        if updates(q):
            return head
        return head + "\n" + _plan(self.execute(text, params))

    def profile(self, text: str, params: dict | None = None) -> dict:
        """Rows, seconds and the plan as it ran, with each operator's rows and milliseconds; the rows themselves are thrown away.

        operators: (depth, name, rows, milliseconds) from the root down, what
        an operator doesn't measure being None; times add up over all tasks.
        """
        began = time.perf_counter()
        run = self.execute(text, params)._jdf.queryExecution()
        rows = run.toRdd().count()
        plan = self.spark._jvm.PythonSQLUtils.explainString(run, "formatted")
        return {"rows": rows, "seconds": time.perf_counter() - began, "plan": plan, "operators": _measured(run.executedPlan())}

    @property
    def api(self) -> GraphApi:
        """Single nodes and relationships by id."""
        return GraphApi(self)

    def transaction(self, read_only: bool = False) -> Transaction:
        return Transaction(self, read_only)


def _measured(node, depth: int = 0) -> list[tuple[int, str, int | None, int | None]]:
    """An operator of Spark's plan and those below it, adaptive plans and finished stages being looked into."""
    name = node.getClass().getSimpleName()
    inner = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "ResultQueryStageExec": "plan", "TableCacheQueryStageExec": "plan"}.get(name)
    if inner:
        return _measured(getattr(node, inner)(), depth)
    metrics, found = node.metrics(), {}
    keys = metrics.keysIterator()
    while keys.hasNext():
        key = keys.next()
        metric = metrics.apply(key)
        found[key] = metric.value() / (1e6 if metric.metricType() == "nsTiming" else 1), metric.metricType()
    rows = found.get("numOutputRows", found.get("number of output rows", (None, "")))[0]
    times = [v for v, kind in found.values() if kind in ("timing", "nsTiming")]
    out = [(depth, node.nodeName().strip(), None if rows is None else int(rows), round(sum(times)) if times else None)]
    children = node.children()
    for i in range(children.size()):
        out += _measured(children.apply(i), depth + 1)
    return out


def _plan(df: DataFrame) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


class TransactionConflict(RuntimeError):
    """The graph has changed since the transaction began."""


class Transaction:
    """Statements on a version of their own, which takes the place of the engine's when committed.

    Used as a context it commits at the end, or rolls back if there was an
    error.  Versions are immutable, so a savepoint is a reference.
    """

    def __init__(self, engine: Engine, read_only: bool):
        self.engine, self.read_only, self.base = engine, read_only, engine.graph
        self.work, self.saved, self.open = Engine(engine.graph), {}, True

    def _check(self) -> None:
        if not self.open:
            raise QueryError("the transaction has ended")

    def execute(self, text: str, params: dict | None = None) -> DataFrame:
        self._check()
        if self.read_only and updates(self.work.parsed(text)):
            raise QueryError("the transaction is read-only")
        return self.work.execute(text, params)

    def savepoint(self, name: str) -> None:
        self._check()
        self.saved[name] = self.work.graph

    def rollback_to(self, name: str) -> None:
        self._check()
        if name not in self.saved:
            raise QueryError(f"no savepoint {name}")
        self.work.graph = self.saved[name]

    def commit(self) -> None:
        self._check()
        self.open = False
        if self.work.graph is self.base:
            return
        if self.engine.graph is not self.base:
            raise TransactionConflict("the graph has changed since the transaction began")
        self.engine.graph = self.work.graph

    def rollback(self) -> None:
        self._check()
        self.open = False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if self.open:
            self.commit() if kind is None else self.rollback()
