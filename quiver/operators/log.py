"""Placing the records of a segmented log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest_segments(segments: DataFrame) -> DataFrame:
    """One row per (shard_id, segment_id): the note with the latest ``noted_at``.

    Of notes with equal ``noted_at`` the one with the greater ``last_good_offset``
    (null lowest), then ``base_lsn``, holds.
    """
    last = F.max(F.struct("noted_at", "last_good_offset", "base_lsn")).alias("last")
    return segments.groupBy("shard_id", "segment_id").agg(last).select(
        "shard_id", "segment_id", F.col("last.base_lsn").alias("base_lsn"), F.col("last.last_good_offset").alias("last_good_offset")
    )


def placed_records(records: DataFrame, segments: DataFrame, *columns: str) -> DataFrame:
    """Records that aren't garbage, with their place ``lsn`` = base_lsn + rec_no, and ``columns``.

    A record is garbage if its segment's tail is torn at or before its
    ``byte_offset``.  A record whose segment is unknown keeps its own ``lsn``;
    one that has no place by either is left out, as is one without a shard.
    Copies are kept.  The join is by (shard_id, segment_id): segments are cut
    at a size, so none grows with the data, and Spark broadcasts the segment
    list only below its own threshold.
    """
    r = records.select("shard_id", "segment_id", "byte_offset", "rec_no", F.col("lsn").alias("own_lsn"), *[c for c in columns if c not in ("shard_id", "segment_id", "byte_offset", "rec_no")])
    lsn = F.coalesce(F.col("base_lsn") + F.col("rec_no"), F.col("own_lsn")).cast("bigint")
    sound = F.col("last_good_offset").isNull() | (F.col("byte_offset") < F.col("last_good_offset"))
    joined = r.join(latest_segments(segments), ["shard_id", "segment_id"], "left")
    return joined.filter(sound).withColumn("lsn", lsn).filter(F.col("lsn").isNotNull() & F.col("shard_id").isNotNull()).select("shard_id", "lsn", *[c for c in columns if c != "shard_id"])
