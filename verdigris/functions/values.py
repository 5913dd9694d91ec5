"""JSON, digests, JSON pointers and message extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lower import to_variant
from ..plans.env import Library
from ..plans.types import Type, bare
from .standard import duration_text, timestamp_text

JSON, HASH, JSONPATCH, PROTOS = Library("json"), Library("hash"), Library("jsonpatch"), Library("protos")

JSON.add("json.unmarshal(string) -> dyn")(lambda c, s: F.try_parse_json(s))


def json_text(v, t: Type):
    """JSON text of a value, maps and messages in their own order; NULL where there is none."""
    t = bare(t)
    match t.kind:
        case "string" | "type":
            # the quoted text of one string is its JSON
            return F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")
        case "bool" | "int" | "uint":
            return v.cast("string")
        case "double":
            finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
            return F.when(finite, F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")))
        case "bytes":
            return F.concat(F.lit('"'), F.translate(F.base64(v), "\r\n", ""), F.lit('"'))
        case "timestamp":
            return F.concat(F.lit('"'), timestamp_text(v), F.lit('"'))
        case "duration":
            return F.concat(F.lit('"'), duration_text(v), F.lit('"'))
        case "null":
            return F.lit("null")
        case "list":
            parts = F.transform(v, lambda x: json_text(x, t.args[0]))
            return F.when(~F.exists(parts, lambda p: p.isNull()), F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")))
        case "map":
            if t.args[0].kind not in ("string", "dyn"):
                return F.lit(None).cast("string")
            parts = F.transform(F.map_entries(v), lambda e: F.concat(json_text(e["key"], Type("string")), F.lit(":"), json_text(e["value"], t.args[1])))
            return F.when(~F.exists(parts, lambda p: p.isNull()), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))
        case "dyn":
            return F.to_json(v)
    return F.to_json(to_variant(v, t))


JSON.add("json.marshal(A) -> string", observes=True)(lambda c, x: F.when(x.isNull(), "null").otherwise(json_text(x, c.types[0])) if c.types[0].kind in ("wrapper", "null") else json_text(x, c.types[0]))

#: The public 64-bit FNV parameters; fixed values.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


@HASH.add("hash.fnv64a(string) -> bytes")
def _(c, s):
    """Octet by octet: xor, then times the prime modulo 2**64, in halves that decimals hold."""
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(s)), lambda i: F.conv(F.hex(F.call_function("substring", s.cast("binary"), i, F.lit(1))), 16, 10).cast("bigint"))
    some = F.when(s == "", F.array().cast("array<bigint>")).otherwise(octets)
    start = F.struct(F.lit(FNV_START >> 32).cast("bigint").alias("hi"), F.lit(FNV_START & 0xFFFFFFFF).cast("bigint").alias("lo"))
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    low_prime, high_prime = FNV_PRIME & 0xFFFFFFFF, FNV_PRIME >> 32

    def step(a, x):
        lo = a["lo"].bitwiseXOR(x)
        product = lo * low_prime
        hi = (a["hi"] * low_prime + lo * high_prime + F.shiftrightunsigned(product, 32)).bitwiseAND(mask)
        return F.struct(hi.alias("hi"), product.bitwiseAND(mask).alias("lo"))

    out = F.aggregate(some, start, step)
    return F.unhex(F.concat(F.lpad(F.hex(out["hi"]), 8, "0"), F.lpad(F.hex(out["lo"]), 8, "0")))


HASH.add("hash.sha256(string) -> bytes")(lambda c, s: F.unhex(F.sha2(s.cast("binary"), 256)))
HASH.add("hash.md5(string) -> bytes")(lambda c, s: F.unhex(F.md5(s.cast("binary"))))
JSONPATCH.add("jsonpatch.escapeKey(string) -> string")(lambda c, s: F.replace(F.replace(s, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def _extension(c, m):
    name = c.literal(1)
    message = c.types[0].name
    struct = c.lowerer.env.all_messages().get(message)
    return m.getField(name) if struct is not None and name in struct.fieldNames() else None


def _message_first(types):
    return len(types) == 2 and types[0].kind == "message" and types[1].kind == "string"


def _has_ext(c, types, columns, literals):
    got = _extension(c, columns[0])
    return F.when(columns[0].isNotNull(), F.lit(False) if got is None else got.isNotNull())


def _get_ext(c, types, columns, literals):
    from ..plans.types import type_of

    got = _extension(c, columns[0])
    if got is None:
        return F.lit(None).cast("variant")
    struct = c.lowerer.env.all_messages()[types[0].name]
    return F.when(got.isNotNull(), to_variant(got, type_of(struct[literals[1]].dataType, False, literals[1])))


class _Protos:
    """Matchers for message extensions, whose first argument may be any message."""

    has = (lambda types: Type("bool") if _message_first(types) else None, _has_ext)
    get = (lambda types: Type("dyn") if _message_first(types) else None, _get_ext)


PROTOS.dynamic = {("proto.hasExt", False): [_Protos.has], ("proto.getExt", False): [_Protos.get]}
