"""Row hashes in which a null and its column both count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def content_hash(columns: Sequence[Column]) -> Column:
    """64-bit hash of the columns.

    ``xxhash64`` skips nulls, so rows with equal values in other columns would
    agree; a string of null marks goes in beside the values.  Without columns
    every row hashes alike.
    """
    if not columns:
        return F.lit(0).cast("bigint")
    marks = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in columns])
    return F.xxhash64(marks, *columns)
