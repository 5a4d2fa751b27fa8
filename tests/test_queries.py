"""Every query over the smallest tables against DuckDB, where there is SQL."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quiver.functions import FUNCTIONS
from quiver.queries import changes, cypher, functions, pipeline


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(df, rel):
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in columns]
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize("name", [*cypher.QUERIES, *changes.QUERIES, *pipeline.QUERIES])
def test_query(spark, data, duck, name):
    query, sql = __spark_entry__.queries()[name], __spark_entry__.oracle_sql().get(name)
    df = query(spark, data)
    if sql is None:
        df.collect()
    else:
        same(df, duck.sql(sql))


@pytest.mark.parametrize("table", range(4))
def test_functions_together(spark, data, duck, table):
    """All functions of one table in one query; the driver runs them one by one."""
    entries, text, sql = functions._FORMS[table]
    named = [(f"v{i}", e, s) for i, (e, s) in enumerate(entries.values()) if s is not None]
    for lo in range(0, len(named), 30):
        part = named[lo : lo + 30]
        one = functions._run(text.replace("{} AS v", ", ".join(f"{e} AS {n}" for n, e, _ in part)))
        same(one(spark, data), duck.sql(sql.replace("{} AS v", ", ".join(f"{s} AS {n}" for n, _, s in part))))


def test_no_function_is_missing():
    assert len(FUNCTIONS) == 244
    assert all(f"fn_{n.replace('.', '_')}" in functions.QUERIES for n in FUNCTIONS)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_need_the_optional_package():
    root = Path(__file__).resolve().parent.parent / "quiver"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quiver.llm" not in p.read_text(), p
