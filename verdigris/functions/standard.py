"""The standard library: sizes, tests on strings, conversions, times, optionals."""

from __future__ import annotations

import decimal
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lower import INT_MIN, UINT_MAX, from_variant, in_time, in_uint, let, to_variant, variant_kind
from ..plans.env import Library
from ..plans.types import UINT_TYPE, Type, bare
from . import patterns

STANDARD = Library("standard")
add = STANDARD.add

for _kind in ("string", "bytes", "list(A)", "map(A, B)"):
    for _form in (f"size({_kind}) -> int", f"@{_kind}.size() -> int"):
        add(_form)({"string": lambda c, x: F.length(x).cast("bigint"), "bytes": lambda c, x: F.octet_length(x).cast("bigint")}.get(_kind, lambda c, x: F.when(x.isNotNull(), F.size(x).cast("bigint"))))

add("@string.startsWith(string) -> bool")(lambda c, s, p: F.startswith(s, p))
add("@string.endsWith(string) -> bool")(lambda c, s, p: F.endswith(s, p))
add("@string.contains(string) -> bool")(lambda c, s, p: F.contains(s, p))
add("@string.matches(string) -> bool")(lambda c, s, p: patterns.matches(c, s, p, 1))
add("matches(string, string) -> bool")(lambda c, s, p: patterns.matches(c, s, p, 1))


@add("base64.encode(bytes) -> string")
def _(c, b):
    return F.translate(F.base64(b), "\r\n", "")


def decode_base64(s):
    bare_text = F.regexp_replace(s, "=+$", "")
    whole = F.rpad(bare_text, (F.ceil(F.length(bare_text) / 4) * 4).cast("int"), F.lit("="))
    padding = F.length(s) - F.length(bare_text)
    return F.when(F.rlike(s, F.lit(r"^[A-Za-z0-9+/]*={0,2}$")) & (F.length(bare_text) % 4 != 1) & ((padding == 0) | (F.length(s) % 4 == 0)), F.try_to_binary(whole, F.lit("base64")))


add("base64.decode(string) -> bytes")(lambda c, s: decode_base64(s))


# ---- conversions


def type_name(t: Type) -> str:
    return {"list": "list", "map": "map", "null": "null_type", "wrapper": str(bare(t)), "timestamp": "google.protobuf.Timestamp", "duration": "google.protobuf.Duration", "optional": "optional_type"}.get(t.kind, str(t))


@add("type(A) -> type", observes=True)
def _(c, x):
    t = c.types[0]
    if t.kind != "dyn":
        return F.when(x.isNull(), "null_type").otherwise(type_name(t)) if t.kind in ("wrapper", "null") else F.lit(type_name(t))
    kind = variant_kind(x)
    out = F.when(F.is_variant_null(x) | x.isNull(), "null_type")
    for start, name in (("BIGINT", "int"), ("DOUBLE", "double"), ("DECIMAL", "double"), ("STRING", "string"), ("BOOLEAN", "bool"), ("ARRAY", "list"), ("OBJECT", "map"), ("BINARY", "bytes"), ("TIMESTAMP", "google.protobuf.Timestamp")):
        out = out.when(kind.startswith(start), name)
    return out


add("dyn(A) -> dyn")(lambda c, x: to_variant(x, c.types[0]))


def double_text(d):
    """Shortest decimal text: exponents from 1e21 and below 1e-6, no trailing `.0`."""
    s = d.cast("string")
    plain = F.regexp_replace(s, r"\.0$", "")
    odd = let(s, lambda t: _with_exponent(F.abs(d), t))
    return F.when(F.isnan(d), "NaN").when(d == float("inf"), "+Inf").when(d == float("-inf"), "-Inf").when(F.contains(s, F.lit("E")), odd).otherwise(plain)


def _with_exponent(size, s):
    """Text of a finite double that is written with an exponent, digits and power of ten, as `1.5E-7`."""
    digits = F.regexp_replace(F.regexp_extract(s, r"^-?([0-9.]+)", 1), r"[.]|0+$", "")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    parts = F.struct(digits.alias("digits"), F.regexp_extract(s, r"E(-?[0-9]+)$", 1).cast("int").alias("power"))
    return F.concat(sign, let(parts, lambda p: _scaled(size, p["digits"], p["power"])))


def _scaled(size, plain_digits, power):
    n = F.length(plain_digits)
    large = F.when(power + 1 >= n, F.rpad(plain_digits, (power + 1).cast("int"), F.lit("0"))).otherwise(F.concat(F.substring(plain_digits, F.lit(1), (power + 1).cast("int")), F.lit("."), F.substring(plain_digits, (power + 2).cast("int"), n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), (-power - 1).cast("int")), plain_digits)
    exponent = F.concat(F.substring(plain_digits, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(plain_digits, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when((size >= 1e21) | (size < 1e-6), exponent).when(power >= 0, large).otherwise(small)


def timestamp_text(t):
    fraction = F.regexp_replace(F.date_format(t, "SSSSSS"), "0+$", "")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def micros(d):
    """Microseconds of a duration."""
    return (d.cast(T.DayTimeIntervalType(3, 3)).cast("decimal(24,6)") * 1_000_000).cast("bigint")


def duration_text(d):
    m = micros(d)
    fraction = F.regexp_replace(F.lpad((F.abs(m) % 1_000_000).cast("string"), 6, "0"), "0+$", "")
    return F.concat(F.when(m < 0, "-").otherwise(""), F.call_function("div", F.abs(m), F.lit(1_000_000).cast("bigint")).cast("string"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("s"))


add("string(string) -> string")(lambda c, x: x)
add("string(bool) -> string")(lambda c, x: x.cast("string"))
add("string(int) -> string")(lambda c, x: x.cast("string"))
add("string(uint) -> string")(lambda c, x: x.cast("string"))
add("string(double) -> string")(lambda c, x: double_text(x))
add("string(timestamp) -> string")(lambda c, x: timestamp_text(x))
add("string(duration) -> string")(lambda c, x: duration_text(x))
add("string(bytes) -> string")(lambda c, x: F.try_validate_utf8(x.cast("string")))


@add("string(dyn) -> string")
def _(c, x):
    return F.coalesce(from_variant(x, Type("string")), from_variant(x, Type("int")).cast("string"), double_text(from_variant(x, Type("double"))), from_variant(x, Type("bool")).cast("string"))


add("int(int) -> int")(lambda c, x: x)
add("int(uint) -> int")(lambda c, x: F.when(x <= F.lit((1 << 63) - 1), x.cast("bigint")))
add("int(double) -> int")(lambda c, x: F.when((x > float(INT_MIN)) & (x < float(1 << 63)), x.cast("bigint")))
add("int(string) -> int")(lambda c, x: F.when(F.rlike(x, F.lit("^[-+]?[0-9]+$")), x.try_cast("bigint")))
add("int(timestamp) -> int")(lambda c, x: F.unix_seconds(x))
add("int(duration) -> int")(lambda c, x: F.call_function("div", micros(x), F.lit(1_000_000).cast("bigint")))
add("int(dyn) -> int")(lambda c, x: F.coalesce(from_variant(x, Type("int")), from_variant(x, Type("double")).try_cast("bigint"), F.when(F.rlike(from_variant(x, Type("string")), F.lit("^[-+]?[0-9]+$")), from_variant(x, Type("string")).try_cast("bigint"))))

add("uint(uint) -> uint")(lambda c, x: x)
add("uint(int) -> uint")(lambda c, x: F.when(x >= 0, x.cast(UINT_TYPE)))
add("uint(double) -> uint")(lambda c, x: F.when((x > -1.0) & (x < float(1 << 64)), F.when(x < 0, F.lit(0.0)).otherwise(F.floor(x)).cast("decimal(38,0)").cast(UINT_TYPE)))
add("uint(string) -> uint")(lambda c, x: in_uint(F.when(F.rlike(x, F.lit("^[0-9]{1,30}$")), x.try_cast("decimal(38,0)"))))

add("double(double) -> double")(lambda c, x: x)
add("double(int) -> double")(lambda c, x: x.cast("double"))
add("double(uint) -> double")(lambda c, x: x.cast("double"))


@add("double(string) -> double")
def _(c, x):
    named = F.when(x.isin("NaN", "nan"), float("nan")).when(F.rlike(x, F.lit(r"^\+?([Ii]nf|[Ii]nfinity)$")), float("inf")).when(F.rlike(x, F.lit("^-([Ii]nf|[Ii]nfinity)$")), float("-inf"))
    return F.coalesce(named, F.when(F.rlike(x, F.lit(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$")), x.try_cast("double")))


add("double(dyn) -> double")(lambda c, x: F.coalesce(from_variant(x, Type("double")), from_variant(x, Type("int")).cast("double"), from_variant(x, Type("string")).try_cast("double")))

#: Texts of true and false; fixed values.
TRUE, FALSE = ("1", "t", "T", "true", "TRUE", "True"), ("0", "f", "F", "false", "FALSE", "False")
add("bool(bool) -> bool")(lambda c, x: x)
add("bool(string) -> bool")(lambda c, x: F.when(x.isin(*TRUE), True).when(x.isin(*FALSE), False))
add("bytes(bytes) -> bytes")(lambda c, x: x)
add("bytes(string) -> bytes")(lambda c, x: x.cast("binary"))

#: Units of a duration in nanoseconds; fixed values.
UNITS = {"ns": 1, "us": 1000, "µs": 1000, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_PART = r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|µs|ms|s|m|h)"
MOST_SECONDS = 315_576_000_000


def parse_duration(text: str) -> int | None:
    """Microseconds of a text such as `1h30m1.5s`; None if it is none or out of range."""
    m = re.fullmatch(rf"([-+]?)((?:{_PART})+|0)", text)
    if not m:
        return None
    total = sum(decimal.Decimal(n) * UNITS[u] for n, u in re.findall(_PART, m[2]))
    total = int(total) * (-1 if m[1] == "-" else 1)
    return None if abs(total) > MOST_SECONDS * 10**9 else (abs(total) // 1000) * (-1 if total < 0 else 1)


def interval(m):
    """A duration of microseconds."""
    limit = F.lit(MOST_SECONDS * 1_000_000).cast("bigint")
    ok = F.when(m.between(-limit, limit), m)
    seconds = F.call_function("div", ok, F.lit(1_000_000).cast("bigint"))
    rest = (ok % 1_000_000).cast("decimal(18,6)") / 1_000_000
    days = F.call_function("div", seconds, F.lit(86400).cast("bigint"))
    return F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), ((seconds % 86400).cast("decimal(18,6)") + rest).cast("decimal(18,6)"))


@add("duration(string) -> duration")
def _(c, s):
    text = c.literal(0)
    if isinstance(text, str):
        m = parse_duration(text)
        return interval(F.lit(m).cast("bigint"))
    amounts = F.regexp_extract_all(s, F.lit(_PART), F.lit(1))
    units = F.regexp_extract_all(s, F.lit(_PART), F.lit(2))
    scale = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(decimal.Decimal(v)).cast("decimal(13,0)"))])
    parts = F.zip_with(amounts, units, lambda a, u: F.coalesce(a.try_cast("decimal(24,9)") * F.element_at(scale, u), F.lit(None)).cast("decimal(38,6)"))
    total = F.aggregate(parts, F.lit(decimal.Decimal(0)).cast("decimal(38,6)"), lambda x, y: (x + y).cast("decimal(38,6)"))
    sign = F.when(F.startswith(s, F.lit("-")), -1).otherwise(1)
    ok = F.rlike(s, F.lit(rf"^[-+]?(?:(?:{_PART})+|0)$"))
    return interval(F.when(ok, F.floor(total / 1000).try_cast("bigint") * sign))


add("duration(duration) -> duration")(lambda c, x: x)
add("timestamp(timestamp) -> timestamp")(lambda c, x: x)
add("timestamp(int) -> timestamp")(lambda c, x: F.when(x.between(-62_135_596_800, 253_402_300_799), F.timestamp_seconds(x)))
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?([Zz]|[-+][0-9]{2}:[0-9]{2})$"


def parse_timestamp(s):
    cut = F.regexp_replace(F.upper(s), r"(\.[0-9]{6})[0-9]+", "$1")
    return F.when(F.rlike(s, F.lit(RFC3339)), in_time(F.try_to_timestamp(cut)))


add("timestamp(string) -> timestamp")(lambda c, s: parse_timestamp(s))


# ---- parts of times


def zone(z):
    return F.when(F.rlike(z, F.lit("^[0-9]{2}:[0-9]{2}$")), F.concat(F.lit("+"), z)).otherwise(z)


def _accessor(name: str, of_time, of_duration=None) -> None:
    add(f"@timestamp.{name}() -> int")(lambda c, t: of_time(t).cast("bigint"))
    add(f"@timestamp.{name}(string) -> int")(lambda c, t, z: of_time(F.from_utc_timestamp(t, zone(z))).cast("bigint"))
    if of_duration is not None:
        add(f"@duration.{name}() -> int")(lambda c, d: of_duration(micros(d)).cast("bigint"))


def _div(n):
    return lambda m: F.call_function("div", m, F.lit(n).cast("bigint"))


_accessor("getFullYear", F.year)
_accessor("getMonth", lambda t: F.month(t) - 1)
_accessor("getDate", F.dayofmonth)
_accessor("getDayOfMonth", lambda t: F.dayofmonth(t) - 1)
_accessor("getDayOfWeek", lambda t: F.dayofweek(t) - 1)
_accessor("getDayOfYear", lambda t: F.dayofyear(t) - 1)
_accessor("getHours", F.hour, _div(3_600_000_000))
_accessor("getMinutes", F.minute, _div(60_000_000))
_accessor("getSeconds", F.second, _div(1_000_000))
_accessor("getMilliseconds", lambda t: F.pmod(F.unix_millis(t), F.lit(1000)), lambda m: _div(1000)(m % 1_000_000))


# ---- optionals


def is_zero_value(x, t: Type):
    """Whether a value is the zero of its type, or null."""
    k = bare(t).kind
    if k in ("list", "map"):
        return F.size(x) == 0
    if k == "string":
        return x == ""
    if k == "bytes":
        return F.octet_length(x) == 0
    if k == "bool":
        return ~x
    if k in ("int", "uint", "double"):
        return x == 0
    if k == "timestamp":
        return x == F.timestamp_seconds(F.lit(0))
    if k == "duration":
        return micros(x) == 0
    if k == "dyn":
        return F.is_variant_null(x) | F.coalesce(F.to_json(x).isin("0", "0.0", '""', "[]", "{}", "false"), F.lit(False))
    return F.lit(False)


def wrapped(x):
    return F.struct(x.alias("v"))


add("optional.none() -> optional_type(A)", total=True)(lambda c: F.lit(None).cast(_optional_type(c)))


def _optional_type(c):
    from ..plans.types import spark_type

    return spark_type(c.node.type, c.lowerer.env.all_messages())


add("optional.of(A) -> optional_type(A)", observes=True)(lambda c, x: wrapped(x))
add("optional.ofNonZeroValue(A) -> optional_type(A)", observes=True)(lambda c, x: F.when(x.isNotNull() & ~F.coalesce(is_zero_value(x, c.types[0]), F.lit(False)), wrapped(x)))
add("@optional_type(A).hasValue() -> bool", observes=True)(lambda c, o: o.isNotNull())
add("@optional_type(A).value() -> A")(lambda c, o: o["v"])
add("@optional_type(A).or(optional_type(A)) -> optional_type(A)", observes=True)(lambda c, o, p: F.coalesce(o, p))
add("@optional_type(A).orValue(A) -> A", observes=True)(lambda c, o, d: F.when(o.isNull(), d).otherwise(o["v"]))
