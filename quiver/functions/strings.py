"""string.* and text.* functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd

from quiver.functions.registry import function, template
from quiver.plans.values import quoted

template("string.upper", "s", "upper({0})")
template("string.lower", "s", "lower({0})")


@function("string.capitalize", "sb", low=1)
def _capitalize(c, a):
    s = a[0].sql
    one = lambda x: f"concat(upper(left({x}, 1)), substr({x}, 2))"
    if len(a) == 1:
        return one(s)
    # word by word, keeping the spaces: cut before each non-space that follows a space
    words = f"array_join(transform(split({s}, '(?<=\\\\s)(?=\\\\S)', -1), w -> {one('w')}), '')"
    return f"if({a[1].sql}, {words}, {one(s)})"


@function("string.case", "ss")
def _case(c, a):
    words = f"filter(split(regexp_replace({a[0].sql}, '(?<=[\\\\p{{Ll}}\\\\p{{N}}])(?=\\\\p{{Lu}})', '_'), '[_\\\\-\\\\s]+', -1), w -> w <> '')"
    cap = "concat(upper(left(w, 1)), lower(substr(w, 2)))"
    forms = {
        "camel": f"array_join(transform({words}, (w, i) -> if(i = 0, lower(w), {cap})), '')",
        "pascal": f"array_join(transform({words}, w -> {cap}), '')",
        "snake": f"array_join(transform({words}, w -> lower(w)), '_')",
        "kebab": f"array_join(transform({words}, w -> lower(w)), '-')",
        "screaming_snake": f"array_join(transform({words}, w -> upper(w)), '_')",
        "title": f"array_join(transform({words}, w -> {cap}), ' ')",
    }
    forms["constant"] = forms["screaming_snake"]
    if isinstance(a[1].lit, str):
        return forms.get(a[1].lit.lower(), "NULL")
    return f"CASE lower({a[1].sql}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in forms.items()) + " END"


def _pattern(v) -> str | None:
    """The regular expression of a needle written /re/."""
    return v.lit[1:-1] if isinstance(v.lit, str) and len(v.lit) > 1 and v.lit[0] == "/" == v.lit[-1] else None


@function("string.replace", "sssi", low=3)
def _replace(c, a):
    s, n, r = (x.sql for x in a[:3])
    p = _pattern(a[1])
    if len(a) > 3:
        limit = a[3].sql
        pieces = f"split({s}, {quoted(p) if p else _literal_re(n)}, CAST({limit} + 1 AS INT))"
        return f"CASE WHEN {limit} <= 0 OR {n} = '' THEN {s} ELSE array_join({pieces}, {r}) END"
    if p:
        return f"regexp_replace({s}, {quoted(p)}, {r})"
    between = f"concat({r}, array_join(transform(split({s}, ''), v -> concat(v, {r})), ''))"  # an empty needle is found at every border
    if a[1].lit:
        return f"replace({s}, {n}, {r})"
    return f"CASE WHEN {n} = '' THEN if({s} = '', {r}, {between}) ELSE replace({s}, {n}, {r}) END"


def _literal_re(sql: str) -> str:
    return f"concat('\\\\Q', {sql}, '\\\\E')"


@function("string.find", "ssb", low=2)
def _find(c, a):
    s, n = a[0].sql, a[1].sql
    before = lambda k: f"octet_length(substr({s}, 1, {k}))"
    if len(a) > 2:
        return (
            f"if({a[2].sql}, transform(filter(sequence(1, greatest(length({s}), 1)), i -> substr({s}, i, length({n})) = {n} AND {n} <> ''), i -> CAST({before('i - 1')} AS BIGINT)), "
            f"array(CAST(if(instr({s}, {n}) = 0, -1, {before(f'instr({s}, {n}) - 1')}) AS BIGINT)))"
        )
    return f"CAST(if(instr({s}, {n}) = 0, -1, {before(f'instr({s}, {n}) - 1')}) AS BIGINT)"


@function("string.count", "ss")
def _count(c, a):
    if p := _pattern(a[1]):
        return f"CAST(regexp_count({a[0].sql}, {quoted(p)}) AS BIGINT)"
    return f"if({a[1].sql} = '', NULL, CAST(regexp_count({a[0].sql}, {_literal_re(a[1].sql)}) AS BIGINT))"


template("string.before", "ss", "if(instr({0}, {1}) > 0, substr({0}, 1, instr({0}, {1}) - 1), NULL)")
template("string.after", "ss", "if(instr({0}, {1}) > 0, substr({0}, instr({0}, {1}) + length({1})), NULL)")


@function("string.split", "ss")
def _split(c, a):
    if p := _pattern(a[1]):
        return f"split({a[0].sql}, {quoted(p)}, -1)"
    return f"if({a[1].sql} = '', split({a[0].sql}, ''), split({a[0].sql}, {_literal_re(a[1].sql)}, -1))"


template("string.join", "ls", "array_join(transform({0}, v -> coalesce(CAST(v AS STRING), '')), {1})")


def _padded(side: str, s: str, n: str, p: str) -> str:
    return f"CASE WHEN length({s}) >= {n} OR {p} = '' THEN {s} ELSE {side}pad({s}, CAST({n} AS INT), {p}) END"


@function("string.pad", "siss", low=3)
def _pad(c, a):
    s, n, p = (x.sql for x in a[:3])
    side = a[3].sql if len(a) > 3 else "'left'"
    both = _padded("r", f"lpad({s}, CAST(length({s}) + greatest({n} - length({s}), 0) DIV 2 AS INT), {p})", n, p)
    return f"CASE lower({side}) WHEN 'left' THEN {_padded('l', s, n, p)} WHEN 'right' THEN {_padded('r', s, n, p)} WHEN 'both' THEN CASE WHEN length({s}) >= {n} THEN {s} ELSE {both} END END"


@function("string.pad_left", "sis", low=2)
def _pad_left(c, a):
    return _padded("l", a[0].sql, a[1].sql, a[2].sql if len(a) > 2 else "' '")


@function("string.pad_right", "sis", low=2)
def _pad_right(c, a):
    return _padded("r", a[0].sql, a[1].sql, a[2].sql if len(a) > 2 else "' '")


template("string.repeat", "si", "if({1} < 0, NULL, repeat({0}, CAST({1} AS INT)))")
template("string.slugify", "s", "btrim(lower(regexp_replace({0}, '[^A-Za-z0-9]+', '-')), '-')")


@function("string.escape", "ss")
def _escape(c, a):
    s = a[0].sql
    forms = {
        "cypher": f"replace(replace({s}, '\\\\', '\\\\\\\\'), '\\'', '\\\\\\'')",
        "json": f"regexp_extract(to_json(named_struct('v', {s})), '(?s)^\\\\{{\"v\":(.*)\\\\}}$', 1)",
        "html": f"replace(replace(replace(replace(replace({s}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\\'', '&#39;')",
    }
    if isinstance(a[1].lit, str):
        return forms.get(a[1].lit.lower(), "NULL")
    return f"CASE lower({a[1].sql}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in forms.items()) + " END"


template("string.hex", "i", "lower(hex({0}))")
template("string.char_at", "si", "nullif(if({1} < 0, if({1} + length({0}) < 0, '', substr({0}, CAST({1} + length({0}) + 1 AS INT), 1)), substr({0}, CAST({1} + 1 AS INT), 1)), '')")


@function("string.code_at", "si")
def _code_at(c, a):
    i = f"if({a[1].sql} < 0, {a[1].sql} + length({a[0].sql}), {a[1].sql})"
    return f"if({i} < 0 OR {i} >= length({a[0].sql}), NULL, CAST(conv(hex(encode(substr({a[0].sql}, CAST({i} + 1 AS INT), 1), 'UTF-32')), 16, 10) AS BIGINT))"


def _groups(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    def one(s, p):
        if s is None or p is None:
            return None
        try:
            return [[m.group(0), *m.groups()] for m in re.finditer(p, s)]
        except re.error:
            return None

    return pd.Series([one(s, p) for s, p in zip(texts, patterns)])


def _named_groups(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    def one(s, p):
        if s is None or p is None:
            return None
        try:
            return [m.groupdict() for m in re.finditer(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", p), s)]
        except re.error:
            return None

    return pd.Series([one(s, p) for s, p in zip(texts, patterns)])


@function("string.regex_groups", "ssb", low=2)
def _regex_groups(c, a):
    if len(a) > 2 and a[2].lit is True:
        return f"{c.udf('regex_named', _named_groups, 'array<map<string,string>>')}({a[0].sql}, {a[1].sql})"
    return f"{c.udf('regex_groups', _groups, 'array<array<string>>')}({a[0].sql}, {a[1].sql})"


@function("string.matches", "ss")
def _matches(c, a):
    p = _pattern(a[1]) or a[1].lit
    if isinstance(p, str):
        return f"rlike({a[0].sql}, {quoted(p)})" if c.good_pattern(p) else "CAST(NULL AS BOOLEAN)"
    return f"rlike({a[0].sql}, {a[1].sql})"


template("string.starts_with", "ss", "startswith({0}, {1})")
template("string.ends_with", "ss", "endswith({0}, {1})")
template("string.contains", "ss", "contains({0}, {1})")
template("string.words", "s", "filter(split({0}, '\\\\s+'), w -> w <> '')")
template("string.is_blank", "s", "regexp_replace({0}, '\\\\s+', '') = ''")
template("string.length", "s", "CAST(length({0}) AS BIGINT)")
template("string.url_encode", "s", "replace(replace(replace(url_encode({0}), '+', '%20'), '*', '%2A'), '%7E', '~')")
template("string.url_decode", "s", "try_url_decode({0})")
template("string.swap_case", "s", "array_join(transform(split({0}, ''), v -> if(v = upper(v), lower(v), upper(v))), '')")
_SPACE = "[\\\\s\\\\u0085\\\\p{Z}]+"


@function("string.trim", "ss", low=1)
def _trim(c, a):
    s = a[0].sql
    left, right = f"regexp_replace({s}, '^{_SPACE}', '')", f"regexp_replace({s}, '{_SPACE}$', '')"
    both = f"regexp_replace({s}, '^{_SPACE}|{_SPACE}$', '')"
    if len(a) == 1:
        return both
    return f"CASE lower({a[1].sql}) WHEN 'left' THEN {left} WHEN 'right' THEN {right} WHEN 'both' THEN {both} END"


template("string.trim_left", "s", "regexp_replace({0}, '^" + _SPACE.replace("{", "{{").replace("}", "}}") + "', '')")
template("string.trim_right", "s", "regexp_replace({0}, '" + _SPACE.replace("{", "{{").replace("}", "}}") + "$', '')")


@function("string.slice", "sii", low=2)
def _slice(c, a):
    start = f"CAST(greatest({a[1].sql}, 0) AS INT) + 1"
    return f"substr({a[0].sql}, {start}" + (f", CAST(greatest({a[2].sql}, 0) AS INT))" if len(a) > 2 else ")")


template("string.prefix", "si", "left({0}, CAST(greatest({1}, 0) AS INT))")
template("string.suffix", "si", "right({0}, CAST(greatest({1}, 0) AS INT))")
template("string.reverse", "s", "reverse({0})")


_FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def _normal(texts: pd.Series, forms: pd.Series) -> pd.Series:
    # most texts are ASCII, or in the form already, which is quick to tell
    return pd.Series([s if s is None or s.isascii() and f in _FORMS else None if f not in _FORMS else s if unicodedata.is_normalized(f, s) else unicodedata.normalize(f, s) for s, f in zip(texts, forms)])


@function("string.normalize", "ss", low=1)
def _normalize(c, a):
    return f"{c.udf('normalize', _normal, 'string')}({a[0].sql}, {f'upper({a[1].sql})' if len(a) > 1 else repr('NFC')})"


# -- text ----------------------------------------------------------------
def _damerau(a: str, b: str) -> int:
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
    return rows[-1][-1]


def _distinct(score, x: pd.Series, y: pd.Series) -> list:
    """The score of each pair, computed once for equal pairs of a batch; null if one of the two is."""
    known: dict = {}
    for pair in set(zip(x, y)):
        known[pair] = None if pair[0] is None or pair[1] is None else score(*pair)
    return [known[pair] for pair in zip(x, y)]


def _damerau_all(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(_distinct(_damerau, x, y), dtype="Int64")


@function("text.distance", "sss")
def _distance(c, a):
    x, y = a[0].sql, a[1].sql
    forms = {
        "levenshtein": lambda: f"CAST(levenshtein({x}, {y}) AS BIGINT)",
        "damerau": lambda: f"{c.udf('damerau', _damerau_all, 'bigint')}({x}, {y})",
        "hamming": lambda: f"if(length({x}) = length({y}), CAST(size(filter(arrays_zip(split({x}, ''), split({y}, '')), z -> z.`0` <> z.`1`)) AS BIGINT), NULL)",
    }
    forms["damerau_levenshtein"] = forms["damerau"]
    word = a[2].lit.lower() if isinstance(a[2].lit, str) else None
    return forms[word]() if word in forms else "NULL"


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, (y for y, t in zip(b, taken) if t))) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def _winkler(a: str, b: str) -> float:
    j, prefix = _jaro(a, b), 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return j + prefix * 0.1 * (1 - j)


def _dice(a: str, b: str) -> float:
    p, q = [a[i : i + 2] for i in range(len(a) - 1)], [b[i : i + 2] for i in range(len(b) - 1)]
    if not p and not q:
        return 1.0 if a == b else 0.0
    rest, shared = list(q), 0
    for g in p:
        if g in rest:
            rest.remove(g)
            shared += 1
    return 2 * shared / (len(p) + len(q))


def _scores(score):
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_distinct(score, x, y), dtype="float64")

    return run


@function("text.similarity", "sss")
def _similarity(c, a):
    x, y = a[0].sql, a[1].sql
    word = a[2].lit.lower() if isinstance(a[2].lit, str) else None
    if word == "levenshtein":
        most = f"greatest(length({x}), length({y}))"
        return f"if({most} = 0, 1.0D, 1.0D - levenshtein({x}, {y}) / CAST({most} AS DOUBLE))"
    udfs = {"jaro": _jaro, "jaro_winkler": _winkler, "sorensen_dice": _dice}
    return f"{c.udf('sim_' + word, _scores(udfs[word]), 'double')}({x}, {y})" if word in udfs else "NULL"


def _soundex(s: str) -> str:
    """The code in which H and W set the previous sound back; built by folding over the letters."""
    letters = f"filter(split(upper({s}), ''), v -> v RLIKE '^[A-Z]$')"
    code = "translate(v, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000')"
    fold = (
        f"aggregate({letters}, named_struct('out', '', 'last', ''), (s, v) -> named_struct('out', CASE WHEN s.out = '' THEN v "
        f"WHEN {code} <> '0' AND {code} <> s.last THEN concat(s.out, {code}) ELSE s.out END, 'last', {code}), s -> s.out)"
    )
    return f"nullif(left(rpad({fold}, greatest(length({fold}), 4), '0'), 4), '0000')"


@function("text.phonetic", "ss")
def _phonetic(c, a):
    return _soundex(a[0].sql) if isinstance(a[1].lit, str) and a[1].lit.lower() == "soundex" else "NULL"


@function("text.phonetic_match", "sss")
def _phonetic_match(c, a):
    return f"{_soundex(a[0].sql)} = {_soundex(a[1].sql)}" if isinstance(a[2].lit, str) and a[2].lit.lower() == "soundex" else "NULL"
