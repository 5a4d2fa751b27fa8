"""The text and vector queries on empty tables, tables with nulls and tables with further columns."""

import pytest
from pyspark.sql import functions as F

from quiver.llm.queries import QUERIES

TABLES = ["documents", "benchmark", "vector_entry"]


def write(spark, data, out, change):
    for t in TABLES:
        change(spark.read.parquet(f"{data}/{t}.parquet")).coalesce(1).write.parquet(f"{out}/{t}.parquet")
    return str(out)


@pytest.fixture(scope="module")
def tables(spark, data, tmp_path_factory):
    def holes(df):
        return df.select(*[F.when(F.pmod(F.xxhash64(*df.columns, F.lit(c)), F.lit(7)) != 0, F.col(c)).alias(c) for c in df.columns]).unionByName(df)

    def more(df):
        return df.withColumns({c: F.lit("x") for c in ("share", "words", "score", "ids", "_key", "_text", "cell", "role", "similarity", "other", "copy", "n") if c not in df.columns})

    make = tmp_path_factory.mktemp
    return {k: write(spark, data, make(k), f) for k, f in (("empty", lambda df: df.limit(0)), ("nulls", holes), ("wide", more))} | {"plain": data}


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd(spark, tables, name):
    q = QUERIES[name]
    assert q(spark, tables["empty"]).count() == 0
    q(spark, tables["nulls"]).collect()
    assert sorted(map(str, q(spark, tables["wide"]).collect())) == sorted(map(str, q(spark, tables["plain"]).collect()))
