import csv
import random

import pyarrow as pa
import pytest

from quiver.sources import csv_cells
from quiver.sources.csv_cells import Cells
from quiver.sources.csv_quarantine import parse_lines, typed_rows
from quiver.sources.csv_values import valid
from quiver.sources.files import BadRows, _states, parse_header, read_csv, write_csv


def simple(raw):
    """(cells, is the quoting right), one character at a time."""
    cells, cell, i, ok, n = [], "", 0, True, len(raw)
    start = True
    while True:
        if start and i < n and raw[i] == '"':
            i, cell = i + 1, ""
            while True:
                if i >= n:
                    return None, False
                if raw[i] == '"':
                    if raw[i + 1 : i + 2] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    i += 1
                    break
                cell, i = cell + raw[i], i + 1
            if i < n and raw[i] != ",":
                return None, False
        else:
            cell = ""
            while i < n and raw[i] != ",":
                ok = ok and raw[i] != '"'
                cell, i = cell + raw[i], i + 1
            if not ok:
                return None, False
        cells.append(cell)
        if i >= n:
            return cells, True
        i += 1
        start = True


@pytest.mark.parametrize("chunk", [1, 2, 7, 256])
def test_tokenizer_against_a_plain_one(chunk):
    rng = random.Random(chunk)
    raws = ["".join(rng.choice('ab",,"é\n') for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["", '"' * 999, ("x," * 4000) + '"a,""b"""', None]
    c = Cells(pa.array(raws, pa.string()), chunk)
    values = c.values.to_pylist()
    for i, raw in enumerate(raws):
        want, ok = simple(raw or "")
        assert (c.bad[i] < 0) == ok, raw
        if ok:
            assert values[c.first[i] : c.first[i] + c.count[i]] == want, raw
        else:
            assert 0 <= c.bad[i] <= len((raw or "").encode())
    assert len(Cells(pa.array([], pa.string())).values) == 0


def check(kind, good, bad):
    got = valid(pa.array([*good, *bad], pa.large_string()), kind).tolist()
    assert got == [True] * len(good) + [False] * len(bad), [(v, g) for v, g in zip([*good, *bad], got)]


def test_values():
    check("int", ["", "0", "-5", "+7", "0" * 30 + "5", "9223372036854775807", "-9223372036854775808"], ["9223372036854775808", "-9223372036854775809", " 1", "1 ", "1.0", "٤", "-", "1_0", "9" * 400, "1\n"])
    check("double", ["", "1", "-1.5", "1e5", "+2.5E-3", ".5"], ["nan", "inf", "1,5", "e5", "1.2.3", "½", "--1"])
    check("bool", ["true", "T", "1", "YES", "false", "f", "0", "No", ""], ["y", "on", "2", " true"])
    check("date", ["2024-02-29", "0001-01-01", ""], ["2023-02-29", "2024-13-01", "2024-00-01", "2024-01-32", "24-01-01", "1900-02-29"])
    check("datetime", ["2024-02-29T23:59:59Z", "2024-01-01T00:00:00+05:30"], ["2024-01-01T24:00:00Z", "2024-01-01T00:00:00", "2024-01-01T00:60:00Z", "2024-01-01 00:00:00Z", "2024-02-30T00:00:00Z"])
    check("duration", ["P1Y", "PT5S", "P1Y2M3DT4H5M6S", ""], ["P", "PT", "P1DT", "1D", "P-1D", "PT1D"])
    check("point", ['{"x": 1, "y": 2.5}', '{"y": -1, "x": 0, "z": 3}'], ['{"x": 1}', "[1, 2]", '{"x": "1", "y": 2}', '{"x": true, "y": 1}', "POINT(1 2)"])
    check("json", ["1", '"a"', "null", '{"a": [1]}', ""], ["{a: 1}", "[1 2]", "NaN", "tru", "[" * 3000])
    check("int[]", ["1;2", "5", ""], ["1;;2", "1;x", ";"])
    check("string[]", ["", ";;", "a;b"], [])


def test_quarantine(spark):
    header = spark.createDataFrame([(0, 0, None, ":ID"), (0, 1, "n", "INT"), (0, 2, "t", "string[]"), (0, 1, "n", "INT")], "layout_id int, col_no int, name string, ty string")
    lines = [(1, 0, '7,"5","a;b"'), (2, 0, "7,x,a"), (3, 0, "7,5"), (4, 0, '7,5,a"b'), (5, 0, ""), (6, 9, "1"), (7, 0, None), (8, 0, ",,"), (1, 0, '7,"5","a;b"'), (9, None, "x")]
    df = spark.createDataFrame(lines, "line_id int, layout_id int, raw string").selectExpr("*", "'x' AS reason", "1 AS _types")
    out = {(r.line_id, r.reason): r for r in parse_lines(df, header, ("line_id",)).collect()}
    assert {k: v.error_at for k, v in out.items() if k[1]} == {(2, "value"): 2, (3, "columns"): 3, (4, "quoting"): 5, (5, "columns"): 0, (6, "columns"): 0, (7, "columns"): 0, (9, "columns"): 0}
    assert out[2, "value"].error_cell == 1
    parsed = parse_lines(df, header, ("line_id", "reason"))
    assert parsed.columns[:2] == ["line_id", "reason_in"]
    good = typed_rows(parse_lines(df, header), [(None, ":ID"), ("n", "INT"), ("t", "string[]")], 0)
    assert sorted({(r.line_id, r[":id"], r.n, tuple(r.t) if r.t else None) for r in good.collect()}) == [(1, 7, 5, ("a", "b")), (8, None, None, None)]
    assert parse_lines(df.limit(0), header).count() == 0
    assert parse_lines(df, header.limit(0)).filter("reason = 'columns'").count() == 9


def test_files(spark, tmp_path):
    assert parse_header('id:ID,:LABEL,n:int,"a,b:string[]",plain') == [("id", "ID"), (None, ":LABEL"), ("n", "int"), ("a,b", "string[]"), ("plain", "string")]
    df = spark.createDataFrame([(1, 'a"b,c', [1, 2], True, 1.5), (2, None, None, None, None)], "k long, s string, l array<long>, b boolean, d double")
    write_csv(df.coalesce(1), f"{tmp_path}/c")
    back, bad = read_csv(spark, f"{tmp_path}/c", "permissive")
    assert [tuple(r) for r in back.orderBy("k").collect()] == [tuple(r) for r in df.orderBy("k").collect()] and bad.count() == 0
    (tmp_path / "bad.csv").write_text("k:int\n1\nx\n")
    with pytest.raises(BadRows):
        read_csv(spark, f"{tmp_path}/bad.csv")
    rows, bad = read_csv(spark, f"{tmp_path}/bad.csv", "permissive")
    assert [r.k for r in rows.collect()] == [1] and [r.reason for r in bad.collect()] == ["value"]


def run_of(line, state):
    for ch in line:
        state = csv_cells._NEXT[csv_cells.QUOTE if ch == '"' else csv_cells.COMMA if ch == "," else csv_cells.OTHER][state]
    return state == csv_cells.QUOTED


def test_states_of_lines_compose():
    rng = random.Random(3)
    lines = ["".join(rng.choice('ab",x') for _ in range(rng.randint(0, 9))) for _ in range(2000)] + ["", None]
    after = csv_cells.open_quotes(pa.array(lines), 7)
    inside = _states(after, False)
    now = False
    for i, line in enumerate(lines):
        assert (after[0][i], after[1][i]) == (run_of(line or "", csv_cells.START), run_of(line or "", csv_cells.QUOTED))
        assert inside[i] == now
        now = after[1][i] if now else after[0][i]
    assert inside[-1] == now


def test_quoted_line_breaks_across_splits(spark, tmp_path):
    rng, want = random.Random(4), []
    for f in range(2):
        rows = [(i, "".join(rng.choice(["a", "\n", '"', ",", "b\r\n", "long " * rng.randint(1, 30)]) for _ in range(rng.randint(0, 6)))) for i in range(f * 40, f * 40 + 40)]
        want += rows
        with open(f"{tmp_path}/f{f}.csv", "w", newline="") as h:
            h.write("k:int,s:string\n")
            csv.writer(h, lineterminator="\r\n" if f else "\n").writerows(rows)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows, bad = read_csv(spark, str(tmp_path), "permissive")
        assert rows.rdd.getNumPartitions() > 1
        assert sorted((r.k, r.s or "") for r in rows.collect()) == sorted(want) and bad.count() == 0
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_rows_like_the_header_and_times(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n1,2\na,b\na,b\n")
    assert sorted(map(tuple, read_csv(spark, f"{tmp_path}/h.csv")[0].collect())) == [("1", "2"), ("a", "b"), ("a", "b")]
    (tmp_path / "t.csv").write_text("t:time,l:localtime,d:localdatetime,u:duration\n10:20:30.5+01:30,23:59,2024-02-29T10:00:00.25,P1Y2M3DT4H5M6S\n25:00Z,1:00,2024-02-30T10:00,P\n,,,\n")
    rows, bad = read_csv(spark, f"{tmp_path}/t.csv", "permissive")
    first = next(r for r in rows.collect() if r.t)
    assert (first.t.time_nanos, first.t.offset, first.l.local_nanos, first.u.months, first.u.seconds) == (37230500000000, 5400, 86340000000000, 14, 14706)
    assert first.d.isoformat() == "2024-02-29T10:00:00.250000" and [r.error_cell for r in bad.collect()] == [0]
    write_csv(rows, f"{tmp_path}/back")
    assert sorted(map(str, read_csv(spark, f"{tmp_path}/back")[0].collect())) == sorted(map(str, rows.collect()))
    spaces = spark.createDataFrame([(" a ", 1)], "s string, k int")
    write_csv(spaces, f"{tmp_path}/spaces")
    assert read_csv(spark, f"{tmp_path}/spaces")[0].first().s == " a "
