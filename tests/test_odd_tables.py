"""The queries over whole tables on empty tables, tables full of nulls and tables with further columns."""


import pytest
from pyspark.sql import functions as F

from quiver.queries import pipeline

TABLES = ["snapshot_info", "snapshot_node", "snapshot_rel", "rel_type", "wal_segment", "wal_record", "sync_run", "csv_header", "csv_line"]
CLASHES = ["n", "r", "lsn_", "_key", "_salt", "earliest", "reason", "cells", "base_lsn_x", "value", "copy", "at", "side", "next", "_types", "group_name", "event", "_row_hash", "_seq"]


def write(spark, data, out, change):
    for t in TABLES:
        df = spark.read.parquet(f"{data}/{t}.parquet")
        change(t, df).coalesce(1).write.parquet(f"{out}/{t}.parquet")
    return str(out)


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    return write(spark, data, tmp_path_factory.mktemp("empty"), lambda t, df: df.limit(0))


@pytest.fixture(scope="module")
def nulls(spark, data, tmp_path_factory):
    """Each value is null in one row of seven."""

    def holes(t, df):
        return df.select(*[F.when(F.pmod(F.xxhash64(*df.columns, F.lit(c)), F.lit(7)) != 0, F.col(c)).alias(c) for c in df.columns])

    return write(spark, data, tmp_path_factory.mktemp("nulls"), lambda t, df: holes(t, df).unionByName(df))


@pytest.fixture(scope="module")
def wide(spark, data, tmp_path_factory):
    def more(t, df):
        return df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})

    return write(spark, data, tmp_path_factory.mktemp("wide"), more)


@pytest.mark.parametrize("name", list(pipeline.QUERIES))
def test_empty(spark, empty, name):
    assert pipeline.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", list(pipeline.QUERIES))
def test_nulls(spark, nulls, name):
    rows = pipeline.QUERIES[name](spark, nulls).collect()
    assert len(rows) == len(set(map(tuple, rows)))


@pytest.mark.parametrize("name", list(pipeline.QUERIES))
def test_further_columns(spark, wide, data, name):
    q = pipeline.QUERIES[name]
    assert sorted(map(str, q(spark, wide).collect())) == sorted(map(str, q(spark, data).collect()))


