"""Loading raw CSV records by typed layouts, with the bad ones set apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from quiver.sources.csv_cells import Cells
from quiver.sources.csv_values import FALSE, TRUE, valid

_TYPES, _RAW = "_types", "_raw"
_REASONS = ("quoting", "columns", "value")


def layouts(header: DataFrame) -> DataFrame:
    """(layout_id, _types): the layout's column types in order, in lower case; repeated header rows count once."""
    one = F.sort_array(F.collect_set(F.struct("col_no", F.lower(F.coalesce("ty", F.lit("string"))).alias("ty"))))
    return header.groupBy("layout_id").agg(F.array_join(F.transform(one, lambda c: c["ty"]), "|").alias(_TYPES))


def _parse(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(cells, reason, byte offset of the error, number of the bad cell) of a batch with columns raw and _types."""
    raw, types = batch.column(_RAW), batch.column(_TYPES).fill_null("").dictionary_encode()
    n, cells = len(raw), Cells(raw)
    reason, at, cell = np.zeros(n, dtype=np.int8), np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    layout, kinds = types.indices.to_numpy(), [k.split("|") if k else [] for k in types.dictionary.to_pylist()]
    wanted = np.array([len(k) for k in kinds], dtype=np.int64)[layout] if n else np.zeros(0, np.int64)
    differs = cells.count != wanted
    surplus = cells.count > wanted
    end = cells.length.copy()
    end[surplus] = cells.offset[cells.first[surplus] + wanted[surplus]]
    reason[differs], at[differs] = 2, end[differs]
    unquoted = cells.bad >= 0
    reason[unquoted], at[unquoted] = 1, cells.bad[unquoted]
    for k, names in enumerate(kinds):
        for j, kind in enumerate(names):
            rows = np.flatnonzero((reason == 0) & (layout == k))
            place = cells.first[rows] + j
            wrong = ~valid(cells.values.take(pa.array(place)), kind)
            reason[rows[wrong]], at[rows[wrong]], cell[rows[wrong]] = 3, cells.offset[place[wrong]], j
    good = pa.array(reason == 0)
    values = pc.if_else(pc.equal(cells.values, ""), pa.scalar(None, pa.large_string()), cells.values)
    starts = np.append(cells.first, len(cells.values))
    lists = pa.LargeListArray.from_arrays(pa.array(starts), values)
    lists = pc.if_else(good, lists, pa.scalar(None, lists.type)).cast(pa.list_(pa.string()))
    named = pa.array([None, *_REASONS], pa.string()).take(pa.array(reason))
    seen = pa.array(at < 0), pa.array(cell < 0)
    return lists, named, pc.if_else(seen[0], pa.scalar(None, pa.int64()), pa.array(at)), pc.if_else(seen[1], pa.scalar(None, pa.int64()), pa.array(cell))


def parse_lines(lines: DataFrame, header: DataFrame, carry: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """``carry`` and layout_id of each row of ``lines``, with cells or the reason why there are none.

    cells: the unquoted cells, empty ones null; reason: ``quoting``, ``columns``
    or ``value``, the first that applies, null for good rows; error_at: byte
    offset of the error in the record; error_cell: number from 0 of the cell
    with a wrong value.  A null record counts as an empty line.  A layout that
    the header doesn't have has no columns, so its rows fail by ``columns``.
    Rows aren't merged: repeated rows come out as often as they came in.  A
    carried column with one of these names comes out with ``_in`` behind it.
    """
    own = ("cells", "reason", "error_at", "error_cell")
    carried = [F.col(f"`{c}`").alias(f"{c}_in" if c in own else c) for c in carry if c != "layout_id"]
    joined = lines.select(*carried, "layout_id", F.col("raw").alias(_RAW)).join(layouts(header), "layout_id", "left")
    names = [*(f"{c}_in" if c in own else c for c in carry if c != "layout_id"), "layout_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *_parse(batch)], names=[*names, *own])

    schema = joined.select(*names).schema.add("cells", ArrayType(StringType())).add("reason", "string").add("error_at", "long").add("error_cell", "long")
    return joined.mapInArrow(run, schema)


def _number(value: Column, pattern: str) -> Column:
    """The digits that a pattern's group finds: 0 if there are none, null beyond 64 bits."""
    digits = F.regexp_extract(value, pattern, 1)
    return F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("bigint")).cast("bigint")


def _time(value: Column, local: bool) -> Column:
    """A time of day as the query language holds it: nanoseconds, and the offset in seconds unless it is local."""
    part = F.rpad(F.regexp_extract(value, r"\.([0-9]+)", 1), 9, "0")
    seconds = _number(value, "^([0-9]{2})") * 3600 + _number(value, "^[0-9]{2}:([0-9]{2})") * 60 + _number(value, "^[0-9]{2}:[0-9]{2}:([0-9]{2})")
    nanos = seconds * 1_000_000_000 + part.cast("bigint")
    if local:
        return F.when(value.isNotNull(), F.struct(nanos.alias("local_nanos")))
    zone = _number(value, "[+-]([0-9]{2}):[0-9]{2}$") * 3600 + _number(value, "[+-][0-9]{2}:([0-9]{2})$") * 60
    return F.when(value.isNotNull(), F.struct(nanos.alias("time_nanos"), (F.when(value.rlike("-[0-9]{2}:[0-9]{2}$"), -zone).otherwise(zone)).cast("int").alias("offset")))


def _duration(value: Column) -> Column:
    """A duration as the query language holds it."""
    date, clock = F.substring_index(value, "T", 1), F.when(value.contains("T"), F.substring_index(value, "T", -1)).otherwise("")
    months = _number(date, "([0-9]+)Y") * 12 + _number(date, "([0-9]+)M")
    seconds = _number(clock, "([0-9]+)H") * 3600 + _number(clock, "([0-9]+)M") * 60 + _number(clock, "([0-9]+)S")
    fields = (months.alias("months"), _number(date, "([0-9]+)D").alias("days"), seconds.alias("seconds"), F.lit(0).cast("bigint").alias("nanos"))
    return F.when(value.isNotNull(), F.struct(*fields))


def typed(value: Column, kind: str) -> Column:
    """A cell that is valid for ``kind`` as a value of Spark's type."""
    kind = kind.lower()
    if kind.endswith("[]"):
        return F.transform(F.split(value, ";"), lambda v: typed(v, kind[:-2]))
    if kind in ("int", "integer", "long", ":id", ":start_id", ":end_id"):
        return value.cast("bigint")
    if kind in ("float", "double"):
        return value.cast("double")
    if kind in ("bool", "boolean"):
        return F.when(F.lower(value).isin(*TRUE), True).when(F.lower(value).isin(*FALSE), False)
    if kind == "date":
        return value.cast("date")
    if kind == "datetime":
        return value.cast("timestamp")
    if kind == "localdatetime":
        return value.cast("timestamp_ntz")
    if kind in ("time", "localtime"):
        return _time(value, kind == "localtime")
    if kind == "duration":
        return _duration(value)
    if kind == "point":
        return F.from_json(value, "x double, y double")
    return value


def typed_rows(parsed: DataFrame, columns: list[tuple[str | None, str]], layout_id: int) -> DataFrame:
    """The good rows of one layout as typed columns after those carried along.

    ``columns`` are the layout's (name, ty) in order.  A marker without a name
    is called by its type in lower case; a name that occurs twice, or that a
    carried column bears, gets its position behind it.
    """
    carried = [c for c in parsed.columns if c not in ("cells", "reason", "error_at", "error_cell")]
    good = F.col("reason").isNull() & (F.col("layout_id") == layout_id)
    return parsed.filter(good).select(*carried, *typed_columns(columns, carried))


def typed_columns(columns: list[tuple[str | None, str]], carried: list[str]) -> list[Column]:
    """The cells of a good row of a layout as named and typed columns, for ``typed_rows``."""
    taken, out = {c.lower() for c in carried}, []
    for i, (name, kind) in enumerate(columns):
        called = name or (kind or "string").lower()
        called = f"{called}_{i}" if called.lower() in taken else called
        taken.add(called.lower())
        out.append(typed(F.get(F.col("cells"), F.lit(i)), kind or "string").alias(called))
    return out
