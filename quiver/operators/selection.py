"""Exact order statistics per key where a few keys hold most rows.

For every group the row of a given rank is found by refining histograms: each
round counts the group's remaining rows in buckets of the value range, keeps
the one bucket that holds the rank and lowers the rank by what lies before it.
Counts merge map-side, so a round moves at most (groups x buckets) counts per
task and never a hot group's rows: the cursors of hot groups, of which there
can't be many, are broadcast, and a group that isn't hot is small beside a
task.  When a range has shrunk to one value, the next order column takes over.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quiver.workdir import materialise

#: a group with more than this part of all rows is hot: there are fewer than SHARE of them, so they can always be broadcast
SHARE = 1000
#: cursors of so many bytes or fewer are broadcast, hot or not
SMALL = 32 << 20


def _parts(rows: DataFrame, order: Sequence[str]) -> list[tuple[str, Column, bool]]:
    """(name, expression, is it a double) of the numeric parts that order the rows; NaN after infinity, as in ORDER BY."""
    kinds, out = dict(rows.dtypes), []
    for i, c in enumerate(order):
        v = F.col(f"`{c}`")
        if kinds[c] in ("double", "float"):
            v = v.cast("double")
            odd = F.when(F.isnan(v), 2).when(v == float("inf"), 1).when(v == float("-inf"), -1).otherwise(0)
            out += [(f"_o{i}k", odd.cast("bigint"), False), (f"_o{i}v", F.when(odd == 0, v).otherwise(0.0), True)]
        elif kinds[c] in ("bigint", "int", "smallint", "tinyint"):
            out.append((f"_o{i}v", v.cast("bigint"), False))
        else:
            raise TypeError(f"rows can't be ranked by {c}: {kinds[c]}")
    return out


def _bucket(v: Column, lo: Column, hi: Column, double: bool, buckets: int) -> Column:
    """A bucket number that never falls as ``v`` grows, and differs for ``lo`` and ``hi`` where those differ."""
    if double:
        span = hi / 2 - lo / 2
        share = F.when(span > 0, (v / 2 - lo / 2) / span).otherwise(F.when(v > lo, 1.0).otherwise(0.0))
    else:
        wide = hi.cast("double") - lo.cast("double")
        near = F.try_subtract(v, lo).cast("double") / (F.try_subtract(hi, lo).cast("double") + 1)
        share = F.when(wide < 2.0**52, near).otherwise((v.cast("double") - lo.cast("double")) / wide)
    return F.least(F.lit(buckets - 1), F.floor(share * buckets)).cast("int")


def select_rank(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], rank: Column, buckets: int = 4096, finish: int = 2048, weight: str | None = None
) -> DataFrame:
    """The row of each group whose 1-based number in ``order`` is ``rank``.

    ``rank`` is an expression over ``n``, the group's number of rows; a rank
    outside 1..n gives no row.  ``rows`` should be a written table: it is read
    once per round until a tenth is left.  Order columns are integers or
    doubles without nulls (rows with a null there are left out); null group
    values form groups of their own.  Rows equal in all of ``order`` are
    interchangeable, one of them comes out.  ``weight`` names an integer column
    that says for how many rows each one stands.  Groups of at most ``finish``
    remaining rows are ranked by a window, whose size is so bounded.
    """
    group, order = list(group), list(order)
    parts = _parts(rows, order)
    names = [n for n, _, _ in parts]
    gs = [f"_g{i}" for i in range(len(group))]
    whole = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in order])  # dropna would drop NaN too
    many = F.lit(1) if weight is None else F.col(f"`{weight}`").cast("bigint")
    base = rows.filter(whole).select(*[F.col(f"`{g}`").alias(a) for g, a in zip(group, gs)], *[e.alias(n) for n, e, _ in parts], many.alias("_w"))
    counts_of = lambda: (F.sum("_w").alias("n"), F.count(F.lit(1)).alias("m"))  # noqa: E731  n: the rows stood for, m: the rows there are
    ends = lambda: [f(n).alias(f"{p}{n}") for n in names for f, p in ((F.min, "lo"), (F.max, "hi"))]
    cursor = base.groupBy(*gs).agg(*counts_of(), *ends())
    cursor = cursor.withColumn("r", (rank - 1).cast("bigint")).filter((F.col("r") >= 0) & (F.col("r") < F.col("n")))
    cursor = materialise(cursor, "rank-cursor")
    wide = reduce(lambda a, b: a + b, [F.coalesce(F.length(F.col(g).cast("string")), F.lit(0)) for g in gs], F.lit(16 * (len(names) + 2)))
    size, everything = cursor.agg(F.sum(wide.cast("bigint")), F.sum("m")).first()
    small, everything, total = (size or 0) * 4 <= SMALL, everything or 0, None

    def narrowed(cursor: DataFrame) -> DataFrame:
        """The remaining rows, beside their group's cursor."""
        c = cursor.select(*[F.col(g).alias(f"c{g}") for g in gs], F.col("m").alias("cm"), "r", *[f"{p}{n}" for n in names for p in ("lo", "hi")])
        on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"c{g}")) for g in gs], F.lit(True))
        left = reduce(lambda a, b: a & b, [(F.col(n) >= F.col(f"lo{n}")) & (F.col(n) <= F.col(f"hi{n}")) for n in names])
        if small:
            return base.join(F.broadcast(c), on).filter(left)
        hot = F.col("cm") * SHARE > everything
        return base.join(F.broadcast(c.filter(hot)), on).filter(left).unionByName(base.join(c.filter(~hot), on).filter(left))

    settled = reduce(lambda a, b: a & b, [F.col(f"lo{n}") == F.col(f"hi{n}") for n in names])
    while True:
        todo, rows_left, groups = cursor.agg(
            F.sum((~settled & (F.col("m") > finish)).cast("int")), F.sum("m"), F.count(F.lit(1))
        ).first()
        if not groups or not todo:
            break
        if total is None:
            total = rows_left
        elif rows_left * 10 < total:  # only what the cursors still hold is read from here on
            base, total = materialise(narrowed(cursor).select(*gs, *names, "_w"), "rank-rest"), rows_left
        open_ = ~settled & (F.col("m") > finish)
        number = None
        for n, _, double in reversed(parts):
            b = _bucket(F.col(n), F.col(f"lo{n}"), F.col(f"hi{n}"), double, buckets)
            number = b if number is None else F.when(F.col(f"lo{n}") != F.col(f"hi{n}"), b).otherwise(number)
        counts = narrowed(cursor.filter(open_)).withColumn("b", number).groupBy(*gs, "r", "b").agg(*counts_of(), *ends())
        upto = F.sum("n").over(Window.partitionBy(*gs).orderBy("b"))
        chosen = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n")).filter((F.col("r") >= F.col("before")) & (F.col("r") < F.col("upto")))
        refined = chosen.withColumn("r", F.col("r") - F.col("before")).select(*cursor.columns)
        cursor = materialise(refined.unionByName(cursor.filter(~open_)), "rank-cursor")
    upto = F.sum("_w").over(Window.partitionBy(*gs).orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = narrowed(cursor.filter(~settled)).withColumn("_upto", upto).filter((F.col("r") < F.col("_upto")) & (F.col("r") >= F.col("_upto") - F.col("_w")))
    single = cursor.filter(settled).select(*gs, *[F.col(f"lo{n}").alias(n) for n in names])
    found = ranked.select(*gs, *names).unionByName(single)
    back, kinds = [], dict(rows.dtypes)
    for i, c in enumerate(order):
        v = F.col(f"_o{i}v")
        if f"_o{i}k" in names:
            k = F.col(f"_o{i}k")
            v = F.when(k == 2, float("nan")).when(k == 1, float("inf")).when(k == -1, float("-inf")).otherwise(v)
        back.append(v.cast(kinds[c]).alias(c))
    return found.select(*[F.col(a).alias(g) for g, a in zip(group, gs)], *back)
