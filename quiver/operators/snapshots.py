"""What changed between full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quiver.operators.hashing import content_hash
from quiver.workdir import materialise


def consecutive(snapshots: DataFrame, group: str, order: str, snapshot: str = "snapshot_id") -> DataFrame:
    """(snapshot, next, has_previous) of each snapshot within its group; repeated rows count once.

    ``snapshots`` is the list of snapshots, one small row for each, not their content.
    Snapshots of equal time follow each other by id.
    """
    one = snapshots.groupBy(group, snapshot).agg(F.min(order).alias(order))
    w = Window.partitionBy(group).orderBy(F.col(order).asc_nulls_first(), snapshot)
    return one.select(snapshot, F.lead(snapshot).over(w).alias("next"), F.lag(snapshot).over(w).isNotNull().alias("has_previous"))


def as_set(column: str) -> Column:
    """An array column compared as a set."""
    return F.array_sort(F.array_distinct(F.col(column)))


def snapshot_changes(rows: DataFrame, pairs: DataFrame, key: str, content: Sequence[Column], snapshot: str = "snapshot_id") -> DataFrame:
    """(snapshot, key, change_kind) for each key added, removed or changed against the preceding snapshot.

    Each row goes once to its own snapshot's new side and once to the next
    snapshot's old side; one aggregation by (snapshot, key) holds the least and
    greatest content hash of each side and classifies.  Repeated rows fall
    together before the shuffle.  A key that a snapshot holds with several
    contents has changed if the set of them has: where least and greatest hash
    agree but aren't the same, the keys are written down and their hashes
    compared one by one.  Rows of snapshots that aren't in ``pairs``, and rows
    without a key, are left out.
    """
    hashed = rows.select(snapshot, F.col(key).alias("_key"), content_hash(content).alias("_hash")).filter(F.col("_key").isNotNull())
    sides = F.array(
        F.when(F.col("has_previous"), F.struct(F.col(snapshot).alias("at"), F.lit(True).alias("new"))),
        F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("at"), F.lit(False).alias("new"))),
    )
    tagged = hashed.join(pairs, snapshot).select("_key", "_hash", F.explode(F.array_compact(sides)).alias("side")).select(F.col("side.at").alias("_at"), "_key", "_hash", F.col("side.new").alias("_new"))
    new, old = F.when(F.col("_new"), F.col("_hash")), F.when(~F.col("_new"), F.col("_hash"))
    grouped = tagged.groupBy("_at", "_key").agg(F.min(new).alias("n0"), F.max(new).alias("n1"), F.min(old).alias("o0"), F.max(old).alias("o1"))
    kind = (
        F.when(F.col("o0").isNull(), "added").when(F.col("n0").isNull(), "removed")
        .when((F.col("n0") != F.col("o0")) | (F.col("n1") != F.col("o1")), "changed")
        .when(F.col("n0") != F.col("n1"), "open")
    )
    found = materialise(grouped.select("_at", "_key", kind.alias("change_kind")).filter(F.col("change_kind").isNotNull()), "snapshot-changes")
    decided, open_ = found.filter("change_kind <> 'open'"), found.filter("change_kind = 'open'").select("_at", "_key")
    if not open_.isEmpty():
        each = tagged.join(open_, ["_at", "_key"], "left_semi").groupBy("_at", "_key", "_hash").agg(F.count_if("_new").alias("n"), F.count_if(~F.col("_new")).alias("o"))
        moved = each.filter((F.col("n") == 0) | (F.col("o") == 0)).select("_at", "_key").distinct()
        decided = decided.unionByName(moved.withColumn("change_kind", F.lit("changed")))
    return decided.select(F.col("_at").alias(snapshot), F.col("_key").alias(key), "change_kind")
