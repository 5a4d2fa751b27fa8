"""Processing only rows that are new or changed since the last successful run.

State is a table (key columns, content hash) in numbered versions.  A run
hashes the current rows, joins them with the state and gets the rows whose key
is new or whose hash isn't among the key's; only when its work has succeeded is
the next version published, by one atomic rename that fails if another run got
there first.  A failure at any point leaves the old version, so nothing is
skipped and nothing is done twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quiver.operators.hashing import content_hash
from quiver.operators.versions import StateConflict, Versions
from quiver.workdir import materialise

__all__ = ["HASH", "ChangeState", "StateConflict", "below_floor", "in_ranges", "taken_in"]

HASH = "_row_hash"


class ChangeState:
    """Versioned state under ``path`` for rows identified by ``keys``.

    Rows with a null in a key are compared null-safely and so count as a key
    of their own.  Repeated rows make one entry of the state and come out of a
    run as often as they went in.  A key may come with several contents: each
    is remembered, so a content that is added comes out alone,
    and a run without changes gives nothing.  What a run brings for a key
    replaces what the state had for it, so a key that goes back to an earlier
    content has changed.  ``content`` gives the columns that make a change
    (default: all that aren't keys).  Other columns are carried along, whatever
    their names; ``_row_hash`` is reserved, and rows that bring it are taken as
    hashed already.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], content: Sequence[str] | None = None):
        self.spark, self.path, self.keys, self.content = spark, path.rstrip("/"), list(keys), content
        self.versions = Versions(spark, self.path)

    # -- versions ---------------------------------------------------------
    def version(self) -> int:
        """Number of the published version; 0 before the first."""
        return self.versions.latest()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The state (keys, _row_hash) of a version, or None before the first."""
        version = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/{self.versions.read(version)['folder']}") if version else None

    def publish(self, state: DataFrame, base: int | None = None) -> int:
        """Write ``state`` and make it version ``base`` + 1 (default: the version after the current one)."""
        base = self.version() if base is None else base
        folder = self.versions.folder(f"data-{base + 1:012d}")
        state.select(*self.keys, HASH).write.parquet(f"{self.path}/{folder}")
        return self.versions.publish({"folder": folder}, base)

    # -- rows -------------------------------------------------------------
    def hashed(self, rows: DataFrame) -> DataFrame:
        if HASH in rows.columns:
            return rows
        content = [c for c in rows.columns if c not in self.keys] if self.content is None else list(self.content)
        return rows.withColumn(HASH, content_hash([F.col(f"`{c}`") for c in content]))

    def keyed(self, hashed: DataFrame, *carry: Column) -> DataFrame:
        """One row per key, for rows of which each key has one content; partial aggregation before the shuffle."""
        return hashed.groupBy(*self.keys).agg(F.max(HASH).alias(HASH), *carry)

    def _without(self, rows: DataFrame, other: DataFrame, *columns: str) -> DataFrame:
        """``rows`` that have no equal in ``columns`` among ``other``, nulls being equal."""
        names = {c: f"_o{i}" for i, c in enumerate(columns)}
        right = other.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        return rows.join(right, reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in names.items()]), "left_anti")

    def changed(self, hashed: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of ``hashed`` whose key is new or whose hash isn't among the key's in the state."""
        state = self.read(version)
        return hashed if state is None else self._without(hashed, state, *self.keys, HASH)

    def run(self, rows: DataFrame, work: Callable[[DataFrame], object]) -> object:
        """Do ``work`` on the new or changed rows, then publish; if ``work`` raises, the state stays as it was.

        What counts as seen is written down before the work begins: a row that
        arrives meanwhile isn't in it and comes out next time.  The published
        state holds the keys seen before too, so a later run may be given only
        part of the table.  If publishing fails the work was done and will be
        done again, so work should replace what an earlier attempt of the same
        ``version()`` wrote.
        """
        base = self.version()
        hashed = self.hashed(rows)
        seen = materialise(hashed.select(*self.keys, HASH).distinct(), "seen")
        todo = seen if not base else self._without(seen, self.read(base), *self.keys, HASH)
        names = {c: f"_t{i}" for i, c in enumerate((*self.keys, HASH))}
        right = todo.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        mine = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in names.items()])
        result = work(hashed.join(right, mine, "left_semi").drop(HASH))
        state = seen if not base else seen.unionByName(self._without(self.read(base), seen, *self.keys))
        self.publish(state, base)
        return result


def _successful(runs: DataFrame, status: Sequence[str] = ("ok",)) -> DataFrame:
    return runs.filter(F.col("status").isin(*status)).select("shard_id", "snapshot_id", "from_lsn", "upto_lsn", "started_at").distinct()


def below_floor(records: DataFrame, runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows of ``records`` (shard_id, lsn, …) that a successful run with a snapshot has taken in.

    Such a run covers its shard up to that snapshot's wal_lsn; the greatest of
    them per shard is a floor.
    """
    floors = (
        _successful(runs).filter(F.col("snapshot_id").isNotNull())
        .join(snapshots.groupBy("snapshot_id").agg(F.max("wal_lsn").alias("wal_lsn")), "snapshot_id")
        .groupBy("shard_id").agg(F.max("wal_lsn").alias("_floor"))
    )
    return records.join(floors, "shard_id").filter(F.col("lsn") <= F.col("_floor")).drop("_floor")


def in_ranges(records: DataFrame, runs: DataFrame, status: Sequence[str] = ("ok",), bucket: int = 1024) -> DataFrame:
    """Rows of ``records`` (shard_id, lsn, earliest, …) that a run without a snapshot has taken in.

    A run covers from_lsn < lsn <= upto_lsn of what had landed when it began.
    Ranges are cut into buckets of LSNs, so the join is an equi-join on (shard,
    width, bucket) with no hot key.  The width goes by the range's own length,
    in steps of eight: a range yields nine rows at most, and one very long run
    doesn't put the short ones into the same few buckets.  A record is looked
    up once for each width that occurs, of which there are 18 at most.
    """
    ranges = _successful(runs, status).filter(F.col("snapshot_id").isNull() & (F.col("from_lsn") < F.col("upto_lsn")) & F.col("started_at").isNotNull())
    length = F.col("upto_lsn") - F.col("from_lsn")
    widths = [bucket * 8**i for i in range(18) if bucket * 8**i < 2**62]
    width = reduce(lambda rest, w: F.when(length <= 8 * w, F.lit(w)).otherwise(rest), reversed(widths[:-1]), F.lit(widths[-1])).cast("bigint")
    sized = ranges.withColumn("_width", width)
    used = [r[0] for r in sized.select("_width").distinct().collect()]  # 18 at most
    at = lambda c, w: F.floor(c / w).cast("bigint")
    cut = sized.select(
        F.col("shard_id").alias("_shard"), F.col("from_lsn").alias("_from"), F.col("upto_lsn").alias("_upto"), "started_at", F.col("_width").alias("_w"),
        F.explode(F.sequence(at(F.col("from_lsn") + 1, F.col("_width")), at(F.col("upto_lsn"), F.col("_width")))).alias("_bucket"),
    )
    found = []
    for w in used:
        inside = (
            (F.col("shard_id") == F.col("_shard")) & (at(F.col("lsn"), F.lit(w)) == F.col("_bucket"))
            & (F.col("lsn") > F.col("_from")) & (F.col("lsn") <= F.col("_upto")) & (F.col("earliest") <= F.col("started_at"))
        )
        found.append(records.join(cut.filter(F.col("_w") == w), inside, "left_semi"))
    if len(found) > 1:  # ranges of different lengths may cover the same record
        return reduce(lambda a, b: a.unionByName(b), found).distinct()
    return found[0] if found else records.limit(0)


def taken_in(records: DataFrame, runs: DataFrame, snapshots: DataFrame, bucket: int = 1024) -> DataFrame:
    """Rows of ``records`` (shard_id, lsn, earliest, …) that a successful run has taken in; each comes out once."""
    return below_floor(records, runs, snapshots).unionByName(in_ranges(records, runs, ("ok",), bucket)).distinct()
