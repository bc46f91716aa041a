"""SQL functions that Spark lacks or reads otherwise, as SQL expressions, and the names that differ."""

from __future__ import annotations

import re
from collections.abc import Callable

from tidewater.errors import EngineError
from tidewater.functions import vector

# Names of the accepted dialect and Spark's names for the same arguments.
RENAMED = {
    "character_length": "char_length",
    "ends_with": "endswith",
    "starts_with": "startswith",
    "strpos": "instr",
    "substr_index": "substring_index",
    "to_unixtime": "to_unix_timestamp",
    "make_array": "array",
    "array_concat": "concat",
    "array_cat": "concat",
    "array_has": "array_contains",
    "array_has_any": "arrays_overlap",
    "array_length": "array_size",
    "array_remove_all": "array_remove",
    "array_reverse": "reverse",
    "array_to_string": "array_join",
    "unnest": "explode",
    "approx_distinct": "approx_count_distinct",
    "approx_percentile_cont": "percentile_approx",
}

# The microseconds of an interval.
_MICROS = "CAST(extract(DAY FROM {0}) * 86400000000L + extract(HOUR FROM {0}) * 3600000000L + extract(MINUTE FROM {0}) * 60000000L + extract(SECOND FROM {0}) * 1000000 AS BIGINT)"
_WIDTH = _MICROS.format("CAST({0} AS INTERVAL DAY TO SECOND)")
_FROM, _TO = "if({1} < 0, size({0}) + {1} + 1, greatest({1}, 1))", "if({2} < 0, size({0}) + {2} + 1, least({2}, size({0})))"
_GCD = "abs(aggregate(sequence(1, 93), named_struct('x', bigint({0}), 'y', bigint({1})), (__s, __i) -> named_struct('x', if(__s.y = 0, __s.x, __s.y), 'y', if(__s.y = 0, 0L, __s.x % __s.y))).x)"


def _stamp(unit: str) -> str:
    """A text is read as a timestamp, a number counts units since 1970."""
    return f"CAST(CASE WHEN typeof({{0}}) = 'string' THEN CAST(CAST({{0}} AS STRING) AS TIMESTAMP_NTZ) ELSE CAST(timestamp_micros(bigint({{0}}) {unit}) AS TIMESTAMP_NTZ) END AS TIMESTAMP_NTZ)"


#: Calls written out: name -> {number of arguments: expression over {0}, {1}, ...}.
FORMS: dict[str, dict[int, str]] = {
    # text
    "to_hex": {1: "lower(hex({0}))"},
    "chr": {1: "CASE WHEN {0} < 128 THEN chr({0}) ELSE decode(unhex(lpad(hex({0}), 8, '0')), 'UTF-32') END"},
    "ltrim": {2: "trim(LEADING {1} FROM {0})"},
    "rtrim": {2: "trim(TRAILING {1} FROM {0})"},
    "trim": {2: "trim(BOTH {1} FROM {0})"},
    # numbers
    "log": {1: "log10({0})"},
    "trunc": {
        1: "CASE WHEN {0} < 0 THEN CAST(ceil({0}) AS DOUBLE) ELSE CAST(floor({0}) AS DOUBLE) END",
        2: "CASE WHEN {0} < 0 THEN ceil({0} * power(10, {1})) / power(10, {1}) ELSE floor({0} * power(10, {1})) / power(10, {1}) END",
    },
    "gcd": {2: _GCD},
    "lcm": {2: f"if({{0}} = 0 OR {{1}} = 0, 0L, abs(bigint({{0}}) div {_GCD} * {{1}}))"},
    "iszero": {1: "({0} = 0)"},
    # times
    "from_unixtime": {1: "CAST(timestamp_seconds({0}) AS TIMESTAMP_NTZ)"},
    "to_timestamp": {1: _stamp("* 1000000L")},
    "to_timestamp_seconds": {1: _stamp("* 1000000L")},
    "to_timestamp_millis": {1: _stamp("* 1000L")},
    "to_timestamp_micros": {1: _stamp("")},
    "to_timestamp_nanos": {1: _stamp("div 1000L")},
    "date_bin": {2: f"CAST(timestamp_micros(CAST(floor(unix_micros(CAST({{1}} AS TIMESTAMP)) / {_WIDTH}) AS BIGINT) * {_WIDTH}) AS TIMESTAMP_NTZ)"},
    # arrays
    "array_element": {2: "try_element_at({0}, {1})"},
    "array_extract": {2: "try_element_at({0}, {1})"},
    "array_has_all": {2: "(size(array_except({1}, {0})) = 0)"},
    "array_empty": {1: "(size({0}) = 0)"},
    "array_pop_back": {1: "slice({0}, 1, greatest(size({0}) - 1, 0))"},
    "array_pop_front": {1: "slice({0}, 2, greatest(size({0}) - 1, 0))"},
    "array_position": {2: "nullif(array_position({0}, {1}), 0)"},
    "array_positions": {2: "transform(filter(transform({0}, (__e, __i) -> if(__e <=> {1}, __i + 1, 0)), __i -> __i > 0), __i -> CAST(__i AS BIGINT))"},
    "array_prepend": {2: "array_prepend({1}, {0})"},
    "array_remove": {2: "CASE WHEN array_position({0}, {1}) > 0 THEN filter({0}, (__e, __i) -> __i + 1 <> array_position({0}, {1})) ELSE {0} END"},
    "array_replace": {3: "transform({0}, (__e, __i) -> if(__i + 1 = array_position({0}, {1}), {2}, __e))"},
    "array_replace_all": {3: "transform({0}, __e -> if(__e <=> {1}, {2}, __e))"},
    "array_resize": {
        2: "slice(concat({0}, array_repeat(NULL, greatest({1} - size({0}), 0))), 1, {1})",
        3: "slice(concat({0}, array_repeat({2}, greatest({1} - size({0}), 0))), 1, {1})",
    },
    "array_slice": {3: f"slice({{0}}, {_FROM}, greatest({_TO} - {_FROM} + 1, 0))"},
    "array_sort": {1: "sort_array({0})"},
    "generate_series": {2: "if({0} <= {1}, sequence({0}, {1}), slice(sequence({1}, {1}), 1, 0))"},
    "range": {
        1: "if({0} > 0, sequence(0L, {0} - 1), slice(array(0L), 1, 0))",
        2: "if({0} < {1}, sequence({0}, {1} - 1), slice(sequence({1}, {1}), 1, 0))",
        3: "filter(if(({1} - {0}) * sign({2}) > 0, sequence({0}, {1}, {2}), slice(sequence({1}, {1}), 1, 0)), __e -> __e <> {1})",
    },
    "string_to_array": {2: r"split({0}, concat('\Q', {1}, '\E'))"},
    # maps
    "map_extract": {2: "transform(filter(map_entries({0}), __e -> __e.key = {1}), __e -> __e.value)"},
    # hashes
    **{f"sha{n}": {1: f"sha2({{0}}, {n})"} for n in (224, 256, 384, 512)},
    "digest": {2: "CASE lower({1}) WHEN 'md5' THEN md5({0}) " + " ".join(f"WHEN 'sha{n}' THEN sha2({{0}}, {n})" for n in (224, 256, 384, 512)) + " END"},
    "arrow_typeof": {1: "typeof({0})"},
    # aggregates
    "approx_median": {1: "percentile_approx({0}, 0.5)"},
}

_PLAIN = re.compile(r"\s*(?:[A-Za-z_][\w.]*|-?\d+(?:\.\d+)?L?|'[^']*')\s*")
_HOLE = re.compile(r"\{(\d)\}")


def written_out(form: str, args: list[str]) -> str:
    """A form with its arguments; one that stands in it several times and isn't plain is bound, so that it is read once."""
    uses = _HOLE.findall(form)
    bound = [k for k, a in enumerate(args) if uses.count(str(k)) > 1 and not _PLAIN.fullmatch(a)]
    given = [f"__p.a{k}" if k in bound else a if _PLAIN.fullmatch(a) else f"({a})" for k, a in enumerate(args)]
    body = _HOLE.sub(lambda m: given[int(m[1])], form)
    if not bound:
        return body
    fields = ", ".join(f"'a{k}', {args[k]}" for k in bound)
    return f"element_at(transform(array(named_struct({fields})), __p -> {body}), 1)"


def _constant(name: str, text: str) -> str:
    """The value of a text literal."""
    text = text.strip()
    if len(text) < 2 or text[0] != "'" or text[-1] != "'":
        raise EngineError("unsupported", f"{name}: {text} must be a text constant")
    return text[1:-1].replace("''", "'")


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- calls whose form depends on constants ---


def _concat(args: list[str]) -> str:
    return f"concat_ws('', {', '.join(args)})"  # nulls are skipped


def _flagged(pattern: str, flags: str) -> str:
    """A pattern expression with inline flags in front."""
    inline = "".join(f for f in flags if f in "imsx")
    return f"concat('(?{inline})', {pattern})" if inline else pattern


def _regexp_replace(args: list[str]) -> str:
    """The first match is replaced, or with the flag g all."""
    if len(args) not in (3, 4):
        raise EngineError("plan", "regexp_replace takes 3 or 4 arguments")
    flags = _constant("regexp_replace", args[3]) if len(args) > 3 else ""
    with_ = _constant("regexp_replace", args[2])
    pattern = _flagged(args[1], flags)
    if "g" in flags:
        return f"regexp_replace({args[0]}, {pattern}, {_literal(_groups(with_, 0))})"
    # what stands before the first match and the match are groups, so others move on by two
    return rf"regexp_replace({args[0]}, concat('\A((?s:.*?))(', {pattern}, ')'), {_literal('$1' + _groups(with_, 2))})"


_REFERENCE = re.compile(r"\\(\d)|\$\{(\d+)\}|\$(\d+)")


def _groups(replacement: str, more: int) -> str:
    """A replacement in Java's terms: references \1, $1 and ${1} moved on, all else as it is."""
    out, at = "", 0
    for m in [*_REFERENCE.finditer(replacement), None]:
        text = re.sub(r"([\\$])", r"\\\1", replacement[at : m.start() if m else len(replacement)])
        # a digit after a reference would be read as part of it
        out += "\\" * (at > 0 and text[:1].isdigit()) + text
        if m:
            out += f"${int(m[1] or m[2] or m[3]) + more}"
            at = m.end()
    return out


def _regexp_match(args: list[str]) -> str:
    """The groups of the first match, the whole match where there are none, null for no match."""
    pattern = _constant("regexp_match", args[1])
    n = len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", re.sub(r"\\.|\[\^?\]?[^\]]*\]", "", pattern)))
    p = _flagged(args[1], _constant("regexp_match", args[2]) if len(args) > 2 else "")
    found = ", ".join(f"regexp_extract({args[0]}, {p}, {k})" for k in (range(1, n + 1) if n else [0]))
    return f"CASE WHEN regexp_like({args[0]}, {p}) THEN array({found}) END"


def _regexp_like(args: list[str]) -> str:
    flags = _constant("regexp_like", args[2]) if len(args) > 2 else ""
    return f"regexp_like({args[0]}, {_flagged(args[1], flags)})"


# Fields of a time that Spark lacks or counts otherwise.
_FIELDS = {
    "dow": "(dayofweek({0}) - 1)",
    "isodow": "weekday({0})",
    "second": "CAST(floor(extract(SECOND FROM {0})) AS INT)",
    "millisecond": "CAST(floor(extract(SECOND FROM {0}) * 1000) AS INT)",
    "microsecond": "CAST(extract(SECOND FROM {0}) * 1000000 AS INT)",
    "epoch": "(unix_micros(CAST({0} AS TIMESTAMP)) / 1000000D)",
}


def field(name: str, value: str) -> str:
    """A field of a time; name in any case and number."""
    name = name.lower()
    form = _FIELDS.get(name) or _FIELDS.get(name.removesuffix("s"))
    return written_out(form, [value]) if form else f"date_part('{name}', {value})"


def _date_part(args: list[str]) -> str:
    return field(_constant("date_part", args[0]), args[1])


# The codes of a time format and what they are in Spark's patterns.
_CODES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "3f": "SSS", "6f": "SSSSSS", "j": "DDD", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "e": "d", "%": "%"}


def _pattern(text: str) -> str:
    """A format of percent codes as Spark's pattern; one without codes stays."""
    if "%" not in text:
        return text
    out = []
    for m in re.finditer(r"%-?\.?(3f|6f|.)|([^%]+)", text):
        if m[2]:
            out.append(re.sub(r"[A-Za-z]+", lambda w: f"'{w[0]}'", m[2]))
        elif m[1] in _CODES:
            out.append(_CODES[m[1]])
        else:
            raise EngineError("unsupported", f"the code %{m[1]} of a time format")
    return "".join(out)


def _to_char(args: list[str]) -> str:
    return f"date_format({args[0]}, {_literal(_pattern(_constant('to_char', args[1])))})"


def _to_date(args: list[str]) -> str:
    if len(args) == 1:
        return f"to_date({args[0]})"
    return f"to_date({args[0]}, {_literal(_pattern(_constant('to_date', args[1])))})"


def _to_timestamp(args: list[str]) -> str:
    return f"CAST(to_timestamp({args[0]}, {_literal(_pattern(_constant('to_timestamp', args[1])))}) AS TIMESTAMP_NTZ)"


def _encode(args: list[str]) -> str:
    raw, kind = f"CAST({args[0]} AS BINARY)", _constant("encode", args[1]).lower()
    if kind == "base64":
        return f"trim(TRAILING '=' FROM base64({raw}))"
    return f"lower(hex({raw}))" if kind == "hex" else f"encode({args[0]}, {args[1]})"


def _decode(args: list[str]) -> str:
    kind = _constant("decode", args[1]).lower()
    return {"base64": f"unbase64({args[0]})", "hex": f"unhex({args[0]})"}.get(kind, f"decode({args[0]}, {args[1]})")


#: Calls written out by a function of their arguments.
SPECIAL: dict[str, Callable[[list[str]], str]] = {
    "concat": _concat,
    "regexp_replace": _regexp_replace,
    "regexp_match": _regexp_match,
    "regexp_like": _regexp_like,
    "date_part": _date_part,
    "datepart": _date_part,
    "to_char": _to_char,
    "date_format": _to_char,
    "to_date": _to_date,
    "encode": _encode,
    "decode": _decode,
}

_VECTORS = [("a", "ARRAY<FLOAT>"), ("b", "ARRAY<FLOAT>")]

#: Functions written out with typed arguments: name -> ([(parameter, type)], type, body).
EXPANDED = {name: (_VECTORS, "FLOAT", body) for name, body in vector.SQL_BODIES.items()}
EXPANDED["array_distance"] = EXPANDED["l2_distance"]


def call(name: str, args: list[str]) -> str | None:
    """A call in Spark's terms, or null if it stays as it is."""
    if name.startswith("list_") and name not in ("list_agg",):
        name = "array_" + name[len("list_") :]
        other = f"{RENAMED.get(name, name)}({', '.join(args)})"
    else:
        other = None
    if name in ("to_timestamp", "to_timestamp_seconds") and len(args) == 2:
        return _to_timestamp(args)
    if name in SPECIAL:
        return SPECIAL[name](args)
    if form := FORMS.get(name, {}).get(len(args)):
        return written_out(form, args)
    return other
