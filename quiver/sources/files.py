"""Reading and writing rows: CSV with typed headers, JSON arrays, JSON lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quiver.functions.temporal import text_of
from quiver.plans.values import kind
from quiver.sources.csv_cells import Cells, open_quotes
from quiver.sources.csv_quarantine import parse_lines, typed_columns
from quiver.workdir import materialise

MARKERS = (":ID", ":LABEL", ":START_ID", ":END_ID", ":TYPE")


class BadRows(ValueError):
    """Rows that don't fit their header, where the caller asked for none."""


def parse_header(line: str) -> list[tuple[str | None, str]]:
    """(name, type) of each column of a header line of cells ``name:type``; a marker has no name, no type means string."""
    out = []
    for cell in Cells(pa.array([line])).values.to_pylist():
        if cell.upper() in MARKERS:
            out.append((None, cell.upper()))
        else:
            name, _, type_ = cell.partition(":")
            out.append((name, type_ or "string"))
    return out


def csv_lines(reader, path: str) -> DataFrame:
    """(value, _file, _block) of the lines of files, by a batch or a stream reader."""
    lines = reader.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Parts of batches that lie within one block of a file, each with whether the block begins with it.

    A task reads its blocks one after another and each in order, so a block
    begins where the file or the block's place changes.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        place, file = batch.column("_block").to_numpy(), batch.column("_file").dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (file[1:] != file[:-1])) + 1).tolist(), len(place)]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            here = part.column("_file")[0].as_py(), int(place[lo])
            yield part, here != last
            last = here


def _whole_lines(lines: DataFrame) -> DataFrame:
    """(raw, _first) of records that are lines: without the carriage return at their end, ``_first`` for the first of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, begins in _blocks(batches):
            first = np.zeros(part.num_rows, bool)
            first[0] = begins and part.column("_block")[0].as_py() == 0
            yield pa.RecordBatch.from_arrays([part.column("value"), pa.array(first)], names=["raw", "_first"])

    return lines.mapInArrow(run, "raw string, _first boolean")


def _joined_lines(lines: DataFrame) -> DataFrame:
    """(raw, _first) of records that may hold line breaks within quotes.

    Whether a line begins a record depends on all quotes before it.  At the
    start of a line there are two states, within quotes and not, so what a line
    does is one of four functions.  They are composed line by line within each
    block of a file, then from block to block over one small row for each; so
    every line's state follows without any file being read in order.  Only
    lines of records that go over several are brought together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, state, began = 0, [False, True], [-1, -1]
        for part, begins in _blocks(batches):
            if begins:
                no, state, began = 0, [False, True], [-1, -1]
            after = open_quotes(part.column("value"))  # for a line that starts outside and one that starts inside
            n, at = part.num_rows, no + np.arange(part.num_rows)
            columns = []
            for h in (0, 1):  # if the block starts outside, inside of quotes
                inside = _states(after, state[h])
                start = np.maximum.accumulate(np.where(~inside[:-1], at, -1))
                start = np.where(start < 0, began[h], start)
                columns += [inside[:-1], inside[1:], start]
                state[h], began[h] = bool(inside[-1]), int(start[-1])
            no += n
            arrays = [part.column(c) for c in ("_file", "_block", "value")] + [pa.array(at)] + [pa.array(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=["_file", "_block", "value", "_no", "in0", "out0", "from0", "in1", "out1", "from1"])

    schema = "_file string, _block long, value string, _no long, in0 boolean, out0 boolean, from0 long, in1 boolean, out1 boolean, from1 long"
    states = materialise(lines.mapInArrow(run, schema), "csv-lines")
    last = F.max_by(F.struct("out0", "from0", "out1", "from1"), "_no").alias("l")
    ends = states.groupBy("_file", "_block").agg(last).select("_file", "_block", "l.*")

    def across(table: pa.Table) -> pa.Table:
        """The state in which each block of a file starts, and the record that is open there."""
        rows = sorted(table.to_pylist(), key=lambda r: r["_block"])
        inside, block, start, out = False, 0, 0, []
        for r in rows:
            out.append({"_file": r["_file"], "_block": r["_block"], "inside": inside, "open_block": block, "open_no": start})
            h = "1" if inside else "0"
            if r["from" + h] >= 0:
                block, start = r["_block"], r["from" + h]
            inside = r["out" + h]
        return pa.Table.from_pylist(out, pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("inside", pa.bool_()), ("open_block", pa.int64()), ("open_no", pa.int64())]))

    starts = ends.groupBy("_file").applyInArrow(across, "_file string, _block long, inside boolean, open_block long, open_no long")
    pick = lambda x: F.when(F.col("inside"), F.col(f"{x}1")).otherwise(F.col(f"{x}0"))
    placed = states.join(starts, ["_file", "_block"]).select("_file", "_block", "_no", "value", pick("in").alias("_in"), pick("out").alias("_out"), pick("from").alias("_from"), "open_block", "open_no")
    alone = placed.filter(~F.col("_in") & ~F.col("_out")).select(F.col("value").alias("raw"), ((F.col("_block") == 0) & (F.col("_no") == 0)).alias("_first"))
    here = F.col("_from") >= 0
    pieces = placed.filter(F.col("_in") | F.col("_out")).select(
        "_file", F.when(here, F.col("_block")).otherwise(F.col("open_block")).alias("_b"), F.when(here, F.col("_from")).otherwise(F.col("open_no")).alias("_n"), F.struct("_block", "_no", "value").alias("_p")
    )
    record = F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["value"]), "\n")
    long_ = pieces.groupBy("_file", "_b", "_n").agg(record.alias("raw")).select("raw", ((F.col("_b") == 0) & (F.col("_n") == 0)).alias("_first"))
    return alone.unionByName(long_)


def _states(after: np.ndarray, start: bool) -> np.ndarray:
    """State at the start of each line and behind the last, from what each line does with either state."""
    fixed = after[0] == after[1]  # lines behind which the state doesn't depend on the one before
    flips = (after[0] & ~after[1]).cumsum()  # lines that turn it round
    n = len(fixed)
    known = np.maximum.accumulate(np.where(fixed, np.arange(n), -1))
    base = np.where(known >= 0, after[0][np.maximum(known, 0)], start)
    turned = flips - np.where(known >= 0, flips[np.maximum(known, 0)], 0)
    return np.concatenate([[start], base ^ (turned % 2 == 1)])


def parse_csv(lines: DataFrame, columns: list[tuple[str | None, str]], breaks: bool | None = None) -> DataFrame:
    """Records of ``csv_lines`` without the first of each file, parsed by ``parse_lines``; raw is the record.

    ``breaks``: whether quoted cells may hold line breaks; None finds out by a
    look for lines with an odd number of quotes.
    """
    if breaks is None:
        odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1
        breaks = not lines.filter(odd).isEmpty()
    records = (_joined_lines if breaks else _whole_lines)(lines).filter(~F.col("_first"))
    header = lines.sparkSession.createDataFrame([(0, i, n, t) for i, (n, t) in enumerate(columns)], "layout_id int, col_no int, name string, ty string")
    body = records.select(F.regexp_replace("raw", "\r$", "").alias("raw"), F.lit(0).alias("layout_id"))
    return parse_lines(body, header, ("raw",))


def header_of(lines: DataFrame, path: str) -> list[tuple[str | None, str]]:
    first = lines.filter("_block = 0").first()
    if first is None:
        raise BadRows(f"{path} has no header")
    return parse_header(first.value.removesuffix("\r").removeprefix("\ufeff"))


def read_csv(spark: SparkSession, path: str, mode: str = "fail", breaks: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows) of CSV files, each of which begins with the same typed header line.

    Rejected rows have raw, reason, error_at and error_cell.  mode: ``fail``
    raises if there are any, which reads the files once more; ``permissive``
    gives both; ``drop`` gives the good rows and an empty frame.  Quoted cells
    may hold line breaks; ``breaks`` says whether they do, and by default the
    files are looked through for it.  Files can be split either way.  The
    header is left out by its place, so a data row that equals it is kept.  A
    file without rows gives none.
    """
    lines = csv_lines(spark.read, path)
    columns = header_of(lines, path)
    parsed = parse_csv(lines, columns, breaks)
    rows = parsed.filter(F.col("reason").isNull()).select(*typed_columns(columns, []))
    bad = parsed.filter(F.col("reason").isNotNull()).select("raw", "reason", "error_at", "error_cell")
    if mode == "fail" and not bad.isEmpty():
        raise BadRows(str(bad.first()))
    return rows, bad.limit(0) if mode == "drop" else bad


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Objects of files that each hold one JSON array."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path, multiLine=True)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Objects of files with one JSON object a line."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


_NAMES = {"number": None, "bool": "bool", "string": "string", "date": "date", "datetime": "datetime", "localdatetime": "localdatetime", "time": "time", "localtime": "localtime", "duration": "duration"}


def header_type(t: T.DataType) -> str:
    """The header's name for a column type."""
    if isinstance(t, T.ArrayType):
        return header_type(t.elementType) + "[]"
    k = kind(t)
    if k == "number":
        return "long" if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) else "double"
    return _NAMES.get(k) or "json"


def _clock(c, local: bool):
    """A time of day as text."""
    two = lambda v: F.lpad(v.cast("bigint").cast("string"), 2, "0")
    nanos = c["local_nanos" if local else "time_nanos"]
    s = F.floor(nanos / 1_000_000_000)
    text = F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit("."), F.lpad((nanos % 1_000_000_000).cast("string"), 9, "0"))
    if local:
        return text
    o = F.abs(c["offset"])
    return F.concat(text, F.when(c["offset"] < 0, "-").otherwise("+"), two(F.floor(o / 3600)), F.lit(":"), two(F.floor(o / 60) % 60))


def write_csv(df: DataFrame, path: str) -> None:
    """Files with typed headers that ``read_csv`` reads back; lists are joined by ``;``, structs written as JSON."""
    cols, names = [], []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), header_type(f.dataType)
        if t.endswith("[]"):
            c = F.array_join(F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit(""))), ";")
        elif t == "json":
            c = F.to_json(c)
        elif t == "datetime":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        elif t == "localdatetime":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif t in ("time", "localtime"):
            c = _clock(c, t == "localtime")
        elif t == "duration":
            c = F.expr(text_of(f"`{f.name}`", "duration"))
        cols.append(c.cast("string").alias(f"{f.name}:{t}"))
        names.append(f.name)
    df.select(*cols).write.csv(path, header=True, escape='"', quoteAll=False, emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array a file: each partition writes its own, so no task holds all rows."""

    def run(parts):
        first = True
        for p in parts:
            out = []
            for v in p["value"]:
                out.append(("[" if first else ",") + v)
                first = False
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).mapInPandas(run, "value string").write.text(path)
