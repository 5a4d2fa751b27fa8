"""Shared scratch space on the cluster.

Tables that cut lineage, and versioned state, live under the folder that the
session names in ``spark.checkpoint.dir``.  Only where that is unset and Spark
runs in one process (tests) a temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; raises on a cluster without one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _own:
        path = "file://" + tempfile.mkdtemp(prefix="quiver-")
        sc.setCheckpointDir(path)
        _own[sc.applicationId] = path
    return _own[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the program ends, or by ``release``."""
    path = f"{shared_dir(spark)}/quiver/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(lambda: release(spark))
    _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this program; frames that read them can't be used any more."""
    while _made:
        try:
            delete_path(spark, _made.pop())
        except Exception:  # the JVM is gone: the folder's owner cleans up
            _made.clear()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_seen(df: DataFrame, name: str, **seen) -> tuple[DataFrame, dict]:
    """The same, with aggregates over the rows that are taken as they are written."""
    watch = Observation()
    out = materialise(df.observe(watch, *[c.alias(k) for k, c in seen.items()]), name)
    return out, watch.get


def hadoop(spark: SparkSession, path: str):
    """(file context, path) of Hadoop for ``path``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    qualified = p.getFileSystem(conf).makeQualified(p)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf), qualified


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
