"""temporal.* functions; durations are structs of months, days, seconds and nanoseconds."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from quiver.functions.registry import function, template
from quiver.plans.values import kind

_DURATION = re.compile(r"-?P(?=[0-9.T-])", re.I)
_DATETIME = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?$")
_DATE = re.compile(r"\d{4}-\d\d-\d\d$")


def duration(months: str = "0L", days: str = "0L", seconds: str = "0L", nanos: str = "0L") -> str:
    return f"named_struct('months', CAST({months} AS BIGINT), 'days', CAST({days} AS BIGINT), 'seconds', CAST({seconds} AS BIGINT), 'nanos', CAST({nanos} AS BIGINT))"


def parse_duration(s: str) -> str:
    """SQL of the duration that an ISO text stands for; null if it isn't one."""
    number = lambda part, unit, pre="": f"coalesce(try_cast(nullif(regexp_extract({part}, '{pre}(-?[0-9]+){unit}', 1), '') AS BIGINT), 0L)"
    date, time = f"split({s}, 'T', 2)[0]", f"coalesce(get(split({s}, 'T', 2), 1), '')"
    sign = f"if(startswith({s}, '-'), -1L, 1L)"
    months = f"{sign} * ({number(date, 'Y')} * 12 + {number(date, 'M')})"
    days = f"{sign} * ({number(date, 'W')} * 7 + {number(date, 'D')})"
    seconds = f"{sign} * ({number(time, 'H')} * 3600 + {number(time, 'M')} * 60 + {number(time, '(?:\\\\.[0-9]+)?S')})"
    nanos = f"{sign} * coalesce(try_cast(rpad(nullif(regexp_extract({time}, '\\\\.([0-9]+)S', 1), ''), 9, '0') AS BIGINT), 0L)"
    shape = "^-?P(?=.)(-?[0-9]+Y)?(-?[0-9]+M)?(-?[0-9]+W)?(-?[0-9]+D)?(T(?=.)(-?[0-9]+H)?(-?[0-9]+M)?(-?[0-9]+(\\\\.[0-9]+)?S)?)?$"
    return f"if({s} RLIKE '{shape}', {duration(months, days, seconds, nanos)}, NULL)"


def parse_time(s: str, local: bool) -> str:
    """SQL of a time of day with its offset in seconds, or without one."""
    shape = "^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\\\\.[0-9]{1,9})?)?" + ("$" if local else "(Z|[+-][0-9]{2}:?[0-9]{2})?$")
    part = lambda pattern: f"coalesce(try_cast(nullif(regexp_extract({s}, '{pattern}', 1), '') AS BIGINT), 0L)"
    nanos = f"coalesce(try_cast(rpad(nullif(regexp_extract({s}, '\\\\.([0-9]+)', 1), ''), 9, '0') AS BIGINT), 0L)"
    total = f"({part('^([0-9]{2})')} * 3600 + {part('^[0-9]{2}:([0-9]{2})')} * 60 + {part('^[0-9]{2}:[0-9]{2}:([0-9]{2})')}) * 1000000000 + {nanos}"
    if local:
        return f"if({s} RLIKE '{shape}', named_struct('local_nanos', {total}), NULL)"
    zone = f"if({s} RLIKE '-[0-9]{{2}}:?[0-9]{{2}}$', -1L, 1L) * ({part('[+-]([0-9]{2}):?[0-9]{2}$')} * 3600 + {part('[+-][0-9]{2}:?([0-9]{2})$')} * 60)"
    return f"if({s} RLIKE '{shape}', named_struct('time_nanos', {total}, 'offset', CAST({zone} AS INT)), NULL)"


def add(t: str, d: str, of: str, sign: int = 1) -> str:
    """A date or timestamp moved by a duration; month ends clamp."""
    k = "" if sign > 0 else "-"
    if of == "date":
        return f"date_add(add_months({t}, CAST({k}{d}.months AS INT)), CAST({k}({d}.days + {d}.seconds DIV 86400) AS INT))"
    out = f"timestampadd(DAY, CAST({k}{d}.days AS INT), timestampadd(MONTH, CAST({k}{d}.months AS INT), {t}))"
    return f"timestampadd(MICROSECOND, CAST({k}({d}.seconds * 1000000 + {d}.nanos DIV 1000) AS BIGINT), {out})"


def text_of(sql: str, k: str) -> str:
    """ISO text."""
    if k == "date":
        return f"CAST({sql} AS STRING)"
    if k == "datetime":
        return f"concat(date_format({sql}, \"yyyy-MM-dd'T'HH:mm:ss\"), if(date_format({sql}, 'SSS') = '000', '', date_format({sql}, '.SSS')), 'Z')"
    if k == "localdatetime":
        return f"concat(date_format({sql}, \"yyyy-MM-dd'T'HH:mm:ss\"), if(date_format({sql}, 'SSS') = '000', '', date_format({sql}, '.SSS')))"
    if k == "duration":
        part = lambda v, unit: f"if({v} = 0, '', concat({v}, '{unit}'))"
        day = f"{part(f'{sql}.months DIV 12', 'Y')}, {part(f'{sql}.months % 12', 'M')}, {part(f'{sql}.days', 'D')}"
        s = f"{sql}.seconds"
        time = f"{part(f'{s} DIV 3600', 'H')}, {part(f'{s} DIV 60 % 60', 'M')}, if({s} % 60 = 0 AND {sql}.nanos = 0, '', concat({s} % 60, if({sql}.nanos = 0, '', concat('.', rtrim('0', lpad({sql}.nanos, 9, '0')))), 'S'))"
        return f"if({sql} IS NULL, NULL, transform(array(concat({day}, if({s} = 0 AND {sql}.nanos = 0, '', concat('T', {time})))), p -> if(p = '', 'PT0S', concat('P', p)))[0])"
    return f"CAST({sql} AS STRING)"


def _from_map(c, v, what: str) -> str:
    part = lambda n, default: f"coalesce(CAST({v.sql}.{n} AS INT), {default})" if n in v.type.names else str(default)
    if what == "duration":
        total = lambda *pairs: " + ".join(f"{part(n, 0)} * {k}L" for n, k in pairs)
        return duration(total(("years", 12), ("months", 1)), total(("weeks", 7), ("days", 1)), total(("hours", 3600), ("minutes", 60), ("seconds", 1)), total(("milliseconds", 1000000), ("microseconds", 1000), ("nanoseconds", 1)))
    date = f"{part('year', 0)}, {part('month', 1)}, {part('day', 1)}"
    if what == "date":
        return f"try_make_date({date})" if c.has_function("try_make_date") else f"make_date({date})"
    time = f"{part('hour', 0)}, {part('minute', 0)}, {part('second', 0)} + {part('millisecond', 0)} / CAST(1000 AS DECIMAL(8,6))"
    return f"{'make_timestamp_ntz' if what == 'localdatetime' else 'make_timestamp'}({date}, {time})"


def parsed(c, v, what: str) -> str:
    """A string as the temporal value ``what``; auto: datetime, date or duration, whichever it is."""
    s = v.sql
    forms = {"date": f"try_cast({s} AS DATE)", "datetime": f"try_cast({s} AS TIMESTAMP)", "localdatetime": f"try_cast({s} AS TIMESTAMP_NTZ)", "duration": parse_duration(s)}
    if what == "auto" and isinstance(v.lit, str):
        what = "datetime" if _DATETIME.match(v.lit) else "date" if _DATE.match(v.lit) else "duration" if _DURATION.match(v.lit) else "none"
    if what == "datetime" and isinstance(v.lit, str) and not re.match(r"\d{4}-\d\d-\d\d", v.lit):
        return "CAST(NULL AS TIMESTAMP)"
    return forms.get(what, "NULL")


_NOW = {"date": "current_date()", "local_datetime": "localtimestamp()", "localdatetime": "localtimestamp()", "datetime": "current_timestamp()"}
_TIME_NOW = "named_struct('time_nanos', CAST((unix_micros(current_timestamp()) % 86400000000) * 1000 AS BIGINT), 'offset', 0)"


@function("temporal.now", "a", low=0)
def _now(c, a):
    called = c.called if c.called in ("date", "datetime", "localdatetime", "duration", "time", "localtime") else "auto"
    if not a:
        return _NOW.get(called, _TIME_NOW if called in ("time", "localtime") else "current_timestamp()")
    v = a[0]
    if v.kind == "map" and isinstance(v.type, T.StructType):
        return _from_map(c, v, called if called in ("date", "localdatetime", "duration") else "datetime")
    if v.kind in ("date", "datetime", "localdatetime", "duration"):
        to = {"date": "DATE", "datetime": "TIMESTAMP", "localdatetime": "TIMESTAMP_NTZ"}.get(called)
        return f"CAST({v.sql} AS {to})" if to and v.kind != "duration" else v.sql
    if v.kind != "string":
        return "NULL"
    if isinstance(v.lit, str) and v.lit.lower() in ("date", "time", "local_time", "local_datetime"):
        return _NOW.get(v.lit.lower(), _TIME_NOW)
    if called in ("time", "localtime"):
        return parsed(c, v, "auto")
    return parsed(c, v, "auto" if isinstance(v.lit, str) and called == "auto" else "datetime" if called == "auto" else called)


template("temporal.today", "", "current_date()")
template("temporal.timestamp", "", "unix_millis(current_timestamp())")
template("temporal.timezone", "", "'UTC'")


@function("temporal.parse", "sss", low=1)
def _parse(c, a):
    what = a[2].lit.lower() if len(a) > 2 and isinstance(a[2].lit, str) else "auto"
    return parsed(c, a[0], {"local_datetime": "localdatetime"}.get(what, what if isinstance(a[0].lit, str) or what != "auto" else "datetime"))


@function("temporal.format", "as", low=1)
def _format(c, a):
    return text_of(a[0].sql, a[0].kind) if a[0].kind in ("date", "datetime", "localdatetime", "duration") else "NULL"


@function("temporal.reformat", "sss")
def _reformat(c, a):
    what = parsed(c, a[0], "auto" if isinstance(a[0].lit, str) else "datetime")
    return text_of(what, kind(c.type_of(what)))


_UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}
_LONG = {
    "nanosecond": "ns", "microsecond": "us", "millisecond": "ms", "second": "s", "minute": "m", "hour": "h", "day": "d", "week": "w",
}


@function("temporal.convert", "nss")
def _convert(c, a):
    unit = lambda v: _UNITS.get(_LONG.get(v.lit.lower().rstrip("s"), v.lit.lower())) if isinstance(v.lit, str) else None
    x, y = unit(a[1]), unit(a[2])
    return f"try_cast(CAST({a[0].sql} AS DECIMAL(19,0)) * CAST({x} AS DECIMAL(18,0)) DIV CAST({y} AS DECIMAL(18,0)) AS BIGINT)" if x and y else "NULL"


@function("temporal.add", "ag")
def _add(c, a):
    if a[0].kind == "duration":
        return "named_struct(" + ", ".join(f"'{f}', {a[0].sql}.{f} + {a[1].sql}.{f}" for f in ("months", "days", "seconds", "nanos")) + ")"
    return add(a[0].sql, a[1].sql, a[0].kind) if a[0].kind in ("date", "datetime", "localdatetime") else "NULL"


_PARTS = {
    "year": "year({0})", "quarter": "quarter({0})", "month": "month({0})", "week": "weekofyear({0})", "day": "day({0})", "ordinal_day": "dayofyear({0})",
    "day_of_year": "dayofyear({0})", "day_of_week": "weekday({0}) + 1", "weekday": "weekday({0}) + 1", "dayofweek": "weekday({0}) + 1", "hour": "hour({0})",
    "minute": "minute({0})", "second": "second({0})", "millisecond": "CAST(date_format({0}, 'SSS') AS INT)",
}


def component(sql: str, k: str, name: str) -> str | None:
    """A part of a temporal value, or None if it has no such part."""
    if k in ("time", "localtime"):
        n = f"{sql}.{'time' if k == 'time' else 'local'}_nanos"
        return {"hour": f"{n} DIV 3600000000000", "minute": f"{n} DIV 60000000000 % 60", "second": f"{n} DIV 1000000000 % 60", "millisecond": f"{n} DIV 1000000 % 1000", "nanosecond": f"{n} % 1000000000"}.get(name)
    if k == "duration":
        whole = {"years": f"{sql}.months DIV 12", "hours": f"{sql}.seconds DIV 3600", "minutes": f"{sql}.seconds DIV 60", "milliseconds": f"{sql}.nanos DIV 1000000", "nanoseconds": f"{sql}.nanos"}
        return whole.get(name, f"{sql}.{name}" if name in ("months", "days", "seconds", "nanos") else None)
    if name in ("epochmillis", "epoch_millis"):
        return f"unix_millis(CAST({sql} AS TIMESTAMP))"
    if name in ("epochseconds", "epoch_seconds"):
        return f"unix_seconds(CAST({sql} AS TIMESTAMP))"
    if name not in _PARTS or k == "date" and name in ("hour", "minute", "second", "millisecond"):
        return None
    return f"CAST({_PARTS[name].format(sql)} AS BIGINT)"


@function("temporal.get", "as")
def _get(c, a):
    return (component(a[0].sql, a[0].kind, a[1].lit.lower()) if isinstance(a[1].lit, str) and a[0].kind in ("date", "datetime", "localdatetime", "duration") else None) or "NULL"


@function("temporal.fields", "a")
def _fields(c, a):
    k = a[0].kind
    names = {"date": ["year", "month", "day"], "duration": ["months", "days", "seconds", "nanoseconds"]}.get(k, ["year", "month", "day", "hour", "minute", "second"])
    if k not in ("date", "datetime", "localdatetime", "duration"):
        return "NULL"
    return f"if({a[0].sql} IS NULL, NULL, named_struct(" + ", ".join(f"'{n}', {component(a[0].sql, k, n)}" for n in names) + "))"


@function("temporal.truncate", "aa")
def _truncate(c, a):
    unit, t = (a[0], a[1]) if a[0].kind == "string" else (a[1], a[0])
    word = unit.lit.lower() if isinstance(unit.lit, str) else ""
    if t.kind == "date" and word in ("year", "month", "day"):
        return t.sql if word == "day" else f"trunc({t.sql}, '{word}')"
    if t.kind in ("datetime", "localdatetime") and word in ("year", "month", "day", "hour"):
        out = f"date_trunc('{word}', {t.sql})"
        return f"CAST({out} AS TIMESTAMP_NTZ)" if t.kind == "localdatetime" else out
    return "NULL"


@function("temporal.between", "aa")
def _between(c, a):
    x, y = a[0].sql, a[1].sql
    if a[0].kind == a[1].kind == "date":
        months = f"CAST(months_between({y}, {x}) AS BIGINT)"
        return f"if({x} IS NULL OR {y} IS NULL, NULL, {duration(months, f'datediff({y}, add_months({x}, CAST({months} AS INT)))')})"
    if a[0].kind in ("datetime", "localdatetime") and a[0].kind == a[1].kind:
        micros = f"(unix_micros(CAST({y} AS TIMESTAMP)) - unix_micros(CAST({x} AS TIMESTAMP)))"
        return f"if({x} IS NULL OR {y} IS NULL, NULL, {duration('0L', f'{micros} DIV 86400000000', f'{micros} % 86400000000 DIV 1000000', f'{micros} % 1000000 * 1000')})"
    return "NULL"


@function("temporal.in_days", "dd")
def _in_days(c, a):
    return f"if({a[0].sql} IS NULL OR {a[1].sql} IS NULL, NULL, {duration('0L', f'datediff({a[1].sql}, {a[0].sql})')})"
