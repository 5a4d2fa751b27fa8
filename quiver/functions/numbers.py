"""number.*, bits.* and math.* functions."""

from __future__ import annotations

from quiver.functions.registry import MANY, function, template
from quiver.plans.values import INTEGRAL

# -- bits ----------------------------------------------------------------
for _name, _sql in {"and": "{0} & {1}", "or": "{0} | {1}", "xor": "{0} ^ {1}", "shift_left": "shiftleft({0}, CAST({1} AS INT))", "shift_right": "shiftright({0}, CAST({1} AS INT))"}.items():
    template(f"bits.{_name}", "ii", f"({_sql})")
template("bits.not", "i", "(~ {0})")


@function("number.bitop", "iis")
def _bitop(c, a):
    forms = {"and": "{0} & {1}", "or": "{0} | {1}", "xor": "{0} ^ {1}", "shl": "shiftleft({0}, CAST({1} AS INT))", "shr": "shiftright({0}, CAST({1} AS INT))", "not": "~ {0}"}
    form = forms.get(a[2].lit.lower()) if isinstance(a[2].lit, str) else None
    return f"({form.format(a[0].sql, a[1].sql)})" if form else "NULL"


# -- number --------------------------------------------------------------
@function("number.format", "nis", low=1)
def _format(c, a):
    digits = f"CAST({a[1].sql} AS INT)" if len(a) > 1 else "0" if isinstance(a[0].type, INTEGRAL) else "2"
    out = f"format_number({a[0].sql}, {digits})"
    return f"replace({out}, ',', {a[2].sql})" if len(a) > 2 else out


template("number.to_base", "ii", "if({1} BETWEEN 2 AND 36, concat(if({0} < 0, '-', ''), lower(conv(CAST(abs({0}) AS STRING), 10, CAST({1} AS INT)))), NULL)")


@function("number.from_base", "si")
def _from_base(c, a):
    s, b = f"lower({a[0].sql})", f"CAST({a[1].sql} AS INT)"
    digits = "'0123456789abcdefghijklmnopqrstuvwxyz'"
    body = f"regexp_replace({s}, '^[+-]', '')"
    fine = f"{b} BETWEEN 2 AND 36 AND {body} <> '' AND translate({body}, left({digits}, {b}), '') = ''"
    return f"if({fine}, try_cast(concat(if(startswith({s}, '-'), '-', ''), conv({body}, {b}, 10)) AS BIGINT), NULL)"


_ROMAN = ("array('', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX')", "array('', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC')", "array('', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM')")


def _roman(n: str) -> str:
    digit = lambda k: f"CAST(({n} DIV {10**k}) % 10 AS INT)"
    return f"if({n} BETWEEN 1 AND 3999, concat(repeat('M', CAST({n} DIV 1000 AS INT)), get({_ROMAN[2]}, {digit(2)}), get({_ROMAN[1]}, {digit(1)}), get({_ROMAN[0]}, {digit(0)})), NULL)"


@function("number.to_roman", "i")
def _to_roman(c, a):
    return _roman(a[0].sql)


@function("number.from_roman", "s")
def _from_roman(c, a):
    s = f"upper({a[0].sql})"
    value = "CASE v WHEN 'I' THEN 1L WHEN 'V' THEN 5L WHEN 'X' THEN 10L WHEN 'L' THEN 50L WHEN 'C' THEN 100L WHEN 'D' THEN 500L WHEN 'M' THEN 1000L END"
    total = f"aggregate(transform(split(reverse({s}), ''), v -> {value}), named_struct('t', 0L, 'm', 0L), (s, v) -> named_struct('t', if(v < s.m, s.t - v, s.t + v), 'm', greatest(s.m, v)), s -> s.t)"
    return f"if({_roman(total)} = {s}, {total}, NULL)"


@function("number.is_integer", "n")
def _is_integer(c, a):
    x = a[0].sql
    return f"if({x} IS NULL, NULL, true)" if isinstance(a[0].type, INTEGRAL) else f"NOT isnan({x}) AND abs({x}) < CAST('Infinity' AS DOUBLE) AND {x} = rint({x})"


template("number.is_even", "i", "{0} % 2 = 0")
template("number.is_odd", "i", "{0} % 2 <> 0")
template("number.is_positive", "n", "{0} > 0")
template("number.is_negative", "n", "{0} < 0")
template("number.is_zero", "n", "{0} = 0")
template("number.is_nan", "n", "if({0} IS NULL, NULL, isnan({0}))")
template("number.is_finite", "n", "NOT isnan({0}) AND abs(CAST({0} AS DOUBLE)) < CAST('Infinity' AS DOUBLE)")
template("number.is_infinite", "n", "abs(CAST({0} AS DOUBLE)) = CAST('Infinity' AS DOUBLE)")


# -- math ----------------------------------------------------------------
def _extreme(name: str, sql: str):
    @function(f"math.{name}", "n", low=1, high=MANY)
    def build(c, a):
        args = ", ".join(x.sql for x in a)
        odd = " OR ".join(f"{x.sql} IS NULL" + ("" if isinstance(x.type, INTEGRAL) else f" OR isnan({x.sql}) OR abs({x.sql}) = CAST('Infinity' AS DOUBLE)") for x in a)
        return f"if({odd}, NULL, {f'{sql}({args})' if len(a) > 1 else args})"


_extreme("min", "least")
_extreme("max", "greatest")


@function("math.round", "nis", low=1)
def _round(c, a):
    x = f"CAST({a[0].sql} AS DOUBLE)"
    if len(a) == 1:
        return a[0].sql if isinstance(a[0].type, INTEGRAL) else f"CAST(round({x}) AS BIGINT)"
    digits = a[1].lit if isinstance(a[1].lit, int) else 0
    mode = a[2].lit.lower() if len(a) > 2 and isinstance(a[2].lit, str) else "half_up"
    scale = f"{float(10**digits) if digits >= 0 else 10.0**digits!r}D"
    forms = {
        "half_up": f"round({x}, {digits})", "half_even": f"bround({x}, {digits})", "ceil": f"CAST(ceil({x} * {scale}) AS DOUBLE) / {scale}",
        "floor": f"CAST(floor({x} * {scale}) AS DOUBLE) / {scale}", "trunc": f"CAST(CAST({x} * {scale} AS BIGINT) AS DOUBLE) / {scale}",
    }
    forms["ceiling"], forms["up"], forms["down"] = forms["ceil"], forms["ceil"], forms["trunc"]
    return f"CAST({forms[mode]} AS DOUBLE)" if mode in forms else "NULL"


_WITHIN = "abs({0}) < 9.2233720368547758E18D"
template("math.trunc", "n", "if(" + _WITHIN + ", CAST({0} AS BIGINT), NULL)")
template("math.ceil", "n", "if(" + _WITHIN + ", CAST(ceil({0}) AS BIGINT), NULL)")
template("math.floor", "n", "if(" + _WITHIN + ", CAST(floor({0}) AS BIGINT), NULL)")
template("math.sign", "n", "CAST(signum({0}) AS BIGINT)")
template("math.sigmoid", "n", "(1D / (1D + exp(- {0})))")
for _name in ("tanh", "cosh", "sinh", "exp", "sin", "cos", "tan", "atan", "degrees", "radians"):
    template(f"math.{_name}", "n", f"{_name}({{0}})")
template("math.cot", "n", "try_divide(1D, tan({0}))")
template("math.coth", "n", "try_divide(1D, tanh({0}))")
template("math.atan2", "nn", "atan2({0}, {1})")
template("math.pow", "nn", "power({0}, {1})")
template("math.hypot", "nn", "hypot({0}, {1})")
template("math.log_base", "nn", "if({0} > 0 AND {1} > 0 AND {1} <> 1, ln({0}) / ln({1}), NULL)")


def _gcd(x: str, y: str) -> str:
    """Euclid's steps; 92 are enough for 64 bits."""
    return f"aggregate(sequence(1, 92), named_struct('a', CAST({x} AS BIGINT), 'b', CAST({y} AS BIGINT)), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> abs(s.a))"


@function("math.gcd", "ii")
def _gcd_of(c, a):
    return _gcd(a[0].sql, a[1].sql)


@function("math.lcm", "ii")
def _lcm(c, a):
    x, y = a[0].sql, a[1].sql
    return f"if({x} = 0 OR {y} = 0, if({x} IS NULL OR {y} IS NULL, NULL, 0L), try_multiply(abs({x}) DIV nullif({_gcd(x, y)}, 0), abs({y})))"


template("math.clamp", "nnn", "if({0} IS NULL OR {1} IS NULL OR {2} IS NULL OR {1} > {2}, NULL, least(greatest({0}, {1}), {2}))")
template("math.lerp", "nnn", "CAST({0} + ({1} - {0}) * {2} AS DOUBLE)")
template("math.abs", "n", "if({0} = CAST('-9223372036854775808' AS BIGINT), NULL, abs({0}))")
template("math.sqrt", "n", "if({0} >= 0, sqrt({0}), NULL)")
for _name, _sql in {"log": "ln", "ln": "ln", "log10": "log10"}.items():
    template(f"math.{_name}", "n", f"if({{0}} > 0, {_sql}({{0}}), NULL)")
template("math.asin", "n", "if({0} BETWEEN -1 AND 1, asin({0}), NULL)")
template("math.acos", "n", "if({0} BETWEEN -1 AND 1, acos({0}), NULL)")
template("math.pi", "", "pi()")
template("math.e", "", "e()")
template("math.random", "", "rand()")
