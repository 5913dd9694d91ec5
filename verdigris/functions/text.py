"""Strings by code points."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators.lower import literal, to_variant
from ..plans.env import Library
from ..plans.types import Type, bare
from .standard import double_text, duration_text, timestamp_text

STRINGS = Library("strings")
add = STRINGS.add
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that trim() takes off; fixed values.
SPACE = r"\t\n\x0b\f\r \u0085   -     　"


def _size(s):
    return F.length(s).cast("bigint")


def _find(s, p, start=None):
    """Index of p in s from start, or -1."""
    return F.call_function("locate", p, s, (F.lit(1) if start is None else start + 1).cast("int")).cast("bigint") - 1


def _last(s, p):
    at = _find(F.reverse(s), F.reverse(p))
    return F.when(p == "", _size(s)).when(at < 0, F.lit(-1).cast("bigint")).otherwise(_size(s) - _size(p) - at)


add("@string.charAt(int) -> string")(lambda c, s, i: F.when((i >= 0) & (i <= _size(s)), F.substring(s, (i + 1).cast("int"), F.lit(1))))
add("@string.indexOf(string) -> int")(lambda c, s, p: F.when(p == "", F.when(s.isNotNull(), F.lit(0).cast("bigint"))).otherwise(_find(s, p)))
add("@string.indexOf(string, int) -> int")(lambda c, s, p, i: F.when((i >= 0) & (i <= _size(s)), F.when(p == "", i).otherwise(_find(s, p, i))))
add("@string.lastIndexOf(string) -> int")(lambda c, s, p: _last(s, p))
add("@string.lastIndexOf(string, int) -> int")(lambda c, s, p, i: F.when((i >= 0) & (i <= _size(s)), F.when(p == "", i).otherwise(_last(F.substring(s, F.lit(1), (i + _size(p)).cast("int")), p))))
add("@string.lowerAscii() -> string")(lambda c, s: F.translate(s, UPPER, LOWER))
add("@string.upperAscii() -> string")(lambda c, s: F.translate(s, LOWER, UPPER))
add("@string.replace(string, string) -> string")(lambda c, s, a, b: F.when(a == "", F.when(b.isNotNull(), s)).otherwise(F.replace(s, a, b)))


def _quoted(p):
    return F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _split(c, s, p, n):
    # the limit is that of the parts, zero and less: no limit
    text = c.literal(1)
    if isinstance(text, str) and text:  # signs that mean nothing else, which Java looks for without a pattern if there is one
        return F.split(s, "".join("\\" + x if x in ".$|()[{^?*+\\" else x for x in text), n)
    return F.split(s, _quoted(p), n)


@add("@string.replace(string, string, int) -> string")
def _(c, s, a, b, n):
    parts = _split(c, s, a, F.when(n < 0, -1).otherwise(n + 1).cast("int"))
    return F.when((n == 0) | (a == ""), F.when(b.isNotNull(), s)).otherwise(_joined(parts, b))


def _joined(parts, sep):
    return F.call_function("array_join", parts, sep)


def _points(s):
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substring(s, i, F.lit(1))))


add("@string.split(string) -> list(string)")(lambda c, s, p: F.when(p == "", _points(s)).otherwise(_split(c, s, p, F.lit(-1))))


@add("@string.split(string, int) -> list(string)")
def _(c, s, p, n):
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, _size(s))).cast("int")), lambda i: F.when(i < n, F.substring(s, i, F.lit(1))).otherwise(F.substring(s, i, F.length(s))))
    some = F.when(p == "", F.when((n < 0) | (s == ""), _points(s)).otherwise(chars)).otherwise(_split(c, s, p, F.when(n < 0, -1).otherwise(n).cast("int")))
    return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(s)).otherwise(some)


add("@string.substring(int) -> string")(lambda c, s, a: F.when((a >= 0) & (a <= _size(s)), F.substring(s, (a + 1).cast("int"), F.length(s))))
add("@string.substring(int, int) -> string")(lambda c, s, a, b: F.when((a >= 0) & (a <= b) & (b <= _size(s)), F.substring(s, (a + 1).cast("int"), (b - a).cast("int"))))
add("@string.trim() -> string")(lambda c, s: F.regexp_replace(s, f"^[{SPACE}]+|[{SPACE}]+$", ""))
add("@string.reverse() -> string")(lambda c, s: F.reverse(s))

#: Characters that quote() writes with a name; fixed values.
NAMED = (("\\", "\\\\"), ('"', '\\"'), ("\x07", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\v", "\\v"))


@add("strings.quote(string) -> string")
def _(c, s):
    for a, b in NAMED:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), s, F.lit('"'))


def _whole(parts):
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


add("@list(string).join() -> string")(lambda c, x: F.array_join(_whole(x), ""))
add("@list(string).join(string) -> string")(lambda c, x, s: _joined(_whole(x), s))


# ---- format

_VERB = re.compile(r"%(?:\.(\d+))?([sdboxXfe%])")


def value_text(v, t: Type):
    """The text of a value inside %s: maps by sorted keys."""
    t = bare(t)
    match t.kind:
        case "string" | "type":
            return v
        case "bool" | "int" | "uint":
            return v.cast("string")
        case "double":
            return F.when(F.isnan(v), "NaN").when(v == float("inf"), "Infinity").when(v == float("-inf"), "-Infinity").otherwise(double_text(v))
        case "bytes":
            return F.try_validate_utf8(v.cast("string"))
        case "timestamp":
            return timestamp_text(v)
        case "duration":
            return duration_text(v)
        case "null":
            return F.lit("null")
        case "list":
            return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: value_text(x, t.args[0])), ", ", "null"), F.lit("]"))
        case "map":
            pairs = F.transform(F.array_sort(F.map_keys(v)), lambda k: F.concat(value_text(k, t.args[0]), F.lit(": "), F.coalesce(value_text(F.try_element_at(v, k), t.args[1]), F.lit("null"))))
            return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
        case "dyn":
            return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    return F.to_json(to_variant(v, t))


def _based(v, base: int, upper: bool = False):
    size = F.conv(F.abs(v).cast("string"), 10, base)
    size = F.upper(size) if upper else F.lower(size)
    return F.concat(F.when(v < 0, "-").otherwise(""), size)


def _formatted(verb: str, precision: str | None, v, t: Type):
    t, digits = bare(t), int(precision) if precision else 6
    number = t.kind in ("int", "uint")
    if verb == "s":
        return value_text(v, t)
    if verb == "d" and number:
        return v.cast("string")
    if verb == "d" and t.kind == "double":
        return F.when(F.isnan(v), "NaN").when(v == float("inf"), "Infinity").when(v == float("-inf"), "-Infinity")
    if verb == "b" and t.kind == "bool":
        return F.when(v, "1").otherwise("0")
    if verb in "box" and number or verb == "X" and number:
        return _based(v, {"b": 2, "o": 8}.get(verb, 16), verb == "X")
    if verb in "xX" and t.kind in ("string", "bytes"):
        hexed = F.hex(v)
        return hexed if verb == "X" else F.lower(hexed)
    if verb in "fe" and t.kind in ("int", "uint", "double"):
        d = v.cast("double")
        text = F.format_string(f"%.{digits}{verb}", d)
        return F.when(F.isnan(d), "NaN").when(d == float("inf"), "Infinity").when(d == float("-inf"), "-Infinity").otherwise(text)
    return F.lit(None).cast("string")


@add("@string.format(list(dyn)) -> string")
def _(c, s, values):
    template, given = c.literal(0), c.node.args[1]
    none = F.lit(None).cast("string")
    if not isinstance(template, str) or given.op != "list":
        return none
    out, last, n = [], 0, 0
    for m in _VERB.finditer(template):
        between = template[last : m.start()]
        if "%" in between:
            return none
        out.append(F.lit(between))
        last = m.end()
        if m[2] == "%":
            out.append(F.lit("%"))
            continue
        if n >= len(given.args):
            return none
        item = given.args[n]
        out.append(_formatted(m[2], m[1], literal(item.value, item.type) if item.op == "const" else c.lowerer.lower(item).v, item.type))
        n += 1
    if "%" in template[last:]:
        return none
    return F.concat(*out, F.lit(template[last:]))
