"""Applying a stream of inserts, updates and deletes with equality-delete files.

A table is a folder of data files (key, sequence number, …) and delete files
(key, sequence number).  Writers only append; an update is an append of the
newer row.  A reader drops each row for whose key there is a delete of a later
sequence number, and takes the newest that is left.  So the order in which
changes arrive, and how often, makes no difference.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quiver.operators.versions import StateConflict, Versions

SEQ = "_seq"


class EqualityDeleteTable:
    """Append-only table under ``path``; rows carry the key columns and ``_seq``.

    Null keys match each other.  Of rows of one key with equal ``_seq``, the
    greatest by its remaining columns is the current one.  A delete removes
    rows of strictly smaller ``_seq``.  Rows and deletes that are appended
    together become visible together, by one atomic rename.  A table without
    rows reads as empty: with the columns of ``schema`` if that is given, else
    with those of its deletes, else with none.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType | str | None = None):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), list(keys), schema
        self.versions = Versions(spark, self.path)

    def append(self, rows: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """Add rows and deletes in one step; appends of several writers don't stand in each other's way."""
        entry: dict = {}
        for part, df in (("data", rows), ("deletes", deletes if deletes is None else deletes.select(*self.keys, SEQ))):
            if df is not None:
                entry[part] = self.versions.folder(part)
                df.write.parquet(f"{self.path}/{entry[part]}")
        return self._publish(entry)

    def _publish(self, entry: dict) -> int:
        while True:
            try:
                return self.versions.publish(entry, self.versions.latest())
            except StateConflict:  # another append came first; this one goes behind it
                continue

    def append_rows(self, rows: DataFrame) -> int:
        return self.append(rows)

    def append_deletes(self, deletes: DataFrame) -> int:
        return self.append(deletes=deletes)

    def _read(self, part: str) -> DataFrame | None:
        """All published files of a kind, from the last compaction on."""
        folders = []
        for v in range(self.versions.latest(), 0, -1):
            entry = self.versions.read(v)
            folders += [f"{self.path}/{entry[part]}"] if part in entry else []
            if entry.get("compacted"):
                break
        frames = [self.spark.read.parquet(f) for f in folders]
        if len({tuple(f.dtypes) for f in frames}) == 1:
            return self.spark.read.schema(frames[0].schema).parquet(*folders)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

    def rows(self) -> DataFrame:
        found = self._read("data")
        if found is not None:
            return found
        if self.schema is not None:
            return self.spark.createDataFrame([], self.schema)
        deletes = self._read("deletes")
        return deletes.limit(0) if deletes is not None else self.spark.createDataFrame([], ", ".join(f"`{k}` string" for k in self.keys) + f", {SEQ} bigint")

    def deletes(self) -> DataFrame | None:
        """The latest delete of each key, None if there is no delete; partial aggregation before the shuffle."""
        found = self._read("deletes")
        return None if found is None else found.groupBy(*self.keys).agg(F.max(SEQ).alias("_deleted"))

    def undeleted(self, rows: DataFrame | None = None, seq: str = SEQ) -> DataFrame:
        """``rows`` (default: all) without those that have a later delete of their key."""
        rows = self.rows() if rows is None else rows
        d = self.deletes()
        if d is None:
            return rows
        d = d.select(*[F.col(f"`{k}`").alias(f"_d{i}") for i, k in enumerate(self.keys)], "_deleted")
        later = F.col("_deleted") > F.col(seq)
        for i, k in enumerate(self.keys):
            later = later & F.col(f"`{k}`").eqNullSafe(F.col(f"_d{i}"))
        return rows.join(d, later, "left_anti")

    def current(self) -> DataFrame:
        """The newest undeleted row of each key.

        Reduces to one row a key before the anti-join; a key whose newest row
        is deleted has no older one left, since the delete is later than those too.
        """
        rows = self.rows()
        rest = [c for c in rows.columns if c not in (*self.keys, SEQ)]
        newest = rows.groupBy(*self.keys).agg(F.max(F.struct(SEQ, *[f"`{c}`" for c in rest])).alias("_r"))
        flat = newest.select(*self.keys, F.col(f"_r.{SEQ}").alias(SEQ), *[F.col(f"_r.`{c}`").alias(c) for c in rest])
        return self.undeleted(flat)

    def compact(self) -> int:
        """Replace all files by the current rows and each key's latest delete, which late rows must still meet.

        Raises StateConflict if something was appended meanwhile; the files
        then stay as they are.
        """
        base = self.versions.latest()
        entry: dict = {"compacted": True, "data": self.versions.folder("data")}
        self.current().write.parquet(f"{self.path}/{entry['data']}")
        d = self.deletes()
        if d is not None:
            entry["deletes"] = self.versions.folder("deletes")
            d.withColumnRenamed("_deleted", SEQ).write.parquet(f"{self.path}/{entry['deletes']}")
        return self.versions.publish(entry, base)


def committed_mutations(placed: DataFrame) -> DataFrame:
    """The mutations among ``placed`` whose transaction (shard_id, tx_begin_lsn) has a commit."""
    commits = placed.filter(F.col("record_kind") == "tx_commit").select("shard_id", "tx_begin_lsn").distinct()
    return placed.filter(F.col("record_kind") == "mutation").join(commits, ["shard_id", "tx_begin_lsn"], "left_semi")


def last_checkpoints(snapshots: DataFrame) -> DataFrame:
    """(shard_id, snapshot_id, wal_lsn) of each shard's latest snapshot that has a wal_lsn; ties by greater id."""
    last = F.max(F.struct("taken_at", "snapshot_id", "wal_lsn")).alias("s")
    return snapshots.filter(F.col("wal_lsn").isNotNull()).groupBy("shard_id").agg(last).select("shard_id", F.col("s.snapshot_id").alias("snapshot_id"), F.col("s.wal_lsn").alias("wal_lsn"))


def touched_and_present(table: EqualityDeleteTable, born: Column, touch: Column) -> DataFrame:
    """(keys, lsn) of keys that exist and that a change touched, lsn being the last touch.

    ``born`` says which rows make their key exist, ``touch`` which are changes.
    A row that neither made its key nor follows its making doesn't revive a
    deleted key: the anti-join is on the key's latest birth.
    """
    by_key = table.rows().groupBy(*table.keys).agg(
        F.max(F.when(born, F.col(SEQ))).alias("_born"), F.max(F.when(touch, F.col(SEQ))).alias("lsn")
    ).filter(F.col("_born").isNotNull() & F.col("lsn").isNotNull())
    return table.undeleted(by_key, "_born").drop("_born")
