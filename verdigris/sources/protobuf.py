"""Protobuf wire bytes to structs, by descriptors written in Python; decoding runs in Arrow batches."""

from __future__ import annotations

import base64
import decimal
import json
import struct
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VARINT = {"int32", "int64", "uint32", "uint64", "sint32", "sint64", "bool", "enum"}
_FIXED = {"fixed32": ("<I", 4), "sfixed32": ("<i", 4), "float": ("<f", 4), "fixed64": ("<Q", 8), "sfixed64": ("<q", 8), "double": ("<d", 8)}
_WRAPPERS = {"BoolValue": "bool", "Int32Value": "int32", "Int64Value": "int64", "UInt32Value": "uint32", "UInt64Value": "uint64", "FloatValue": "float", "DoubleValue": "double", "StringValue": "string", "BytesValue": "bytes"}
WELL_KNOWN = "google.protobuf."
#: Messages that hold any value; columns of theirs are variants, which leave the worker as JSON.
_JSON = ("Struct", "Value", "ListValue", "Any")
_PACKED_PREFIX = "type.googleapis.com/"


@dataclass(frozen=True)
class Field:
    """kind: one of the wire scalars, `enum`, `message` or `map`; message names its descriptor, or key and value kinds of a map."""

    name: str
    number: int
    kind: str
    repeated: bool = False
    message: Descriptor | str | None = None
    key: str = "string"
    value: str = "string"
    presence: bool = False


@dataclass(frozen=True)
class Descriptor:
    name: str
    fields: tuple[Field, ...] = field(default=())

    def spark_type(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, _type(f)) for f in self.fields])


def _scalar_type(kind: str) -> T.DataType:
    if kind in ("uint32", "uint64", "fixed32", "fixed64"):
        return T.DecimalType(20, 0)
    if kind in ("float", "double"):
        return T.DoubleType()
    return {"bool": T.BooleanType(), "string": T.StringType(), "bytes": T.BinaryType()}.get(kind, T.LongType())


def _message_type(m) -> T.DataType:
    if isinstance(m, Descriptor):
        return m.spark_type()
    short = str(m).removeprefix(WELL_KNOWN)
    if short in _WRAPPERS:
        return _scalar_type(_WRAPPERS[short])
    return {"Timestamp": T.TimestampType(), "Duration": T.DayTimeIntervalType(0, 3), **dict.fromkeys(_JSON, T.VariantType())}.get(short, T.BinaryType())


def _type(f: Field) -> T.DataType:
    if f.kind == "map":
        return T.MapType(_scalar_type(f.key), _message_type(f.message) if f.message is not None else _scalar_type(f.value))
    one = _message_type(f.message) if f.kind == "message" else _scalar_type(f.kind)
    return T.ArrayType(one) if f.repeated else one


class Malformed(ValueError):
    """Bytes that are no message of the descriptor."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Malformed("bad varint")
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value & (1 << 64) - 1, at


def _number(kind: str, v: int):
    if kind in ("sint32", "sint64"):
        return (v >> 1) ^ -(v & 1)
    if kind == "bool":
        return bool(v)
    if kind == "uint32":
        return v & 0xFFFFFFFF
    if kind == "uint64":
        return v
    if kind in ("int32", "enum"):
        v &= 0xFFFFFFFF
        return v - (1 << 32) if v >> 31 else v
    return v - (1 << 64) if v >> 63 else v


def _scalar(kind: str, wire: int, data: bytes, at: int):
    """(value, next position) of one value on the wire."""
    if kind in _VARINT:
        if wire != 0:
            raise Malformed("wrong wire type")
        v, at = _varint(data, at)
        return _number(kind, v), at
    if kind in _FIXED:
        form, n = _FIXED[kind]
        if wire != (5 if n == 4 else 1) or at + n > len(data):
            raise Malformed("wrong wire type")
        return struct.unpack_from(form, data, at)[0], at + n
    raise Malformed(kind)


def _default(f: Field):
    if f.repeated:
        return []
    if f.kind == "map":
        return {}
    if f.presence or f.kind == "message":
        return None
    return {"bool": False, "string": "", "bytes": b"", "float": 0.0, "double": 0.0}.get(f.kind, 0)


_TIME = Descriptor("", (Field("s", 1, "int64"), Field("n", 2, "int32")))
_VALUE = Descriptor("", (
    Field("null", 1, "enum", presence=True), Field("number", 2, "double", presence=True), Field("string", 3, "string", presence=True),
    Field("bool", 4, "bool", presence=True), Field("struct", 5, "message", message=WELL_KNOWN + "Struct"), Field("list", 6, "message", message=WELL_KNOWN + "ListValue"),
))
_STRUCT = Descriptor("", (Field("fields", 1, "map", message=WELL_KNOWN + "Value"),))
_LIST = Descriptor("", (Field("values", 1, "message", repeated=True, message=WELL_KNOWN + "Value"),))
_PACKED = Descriptor("", (Field("type_url", 1, "string"), Field("value", 2, "bytes")))


@dataclass(frozen=True)
class Json:
    """A value of a variant column, in Python's terms."""

    value: object


def _known(name: str, data: bytes, packed: dict[str, Descriptor]):
    short = name.removeprefix(WELL_KNOWN)
    if short in _WRAPPERS:
        return decode(Descriptor(name, (Field("value", 1, _WRAPPERS[short]),)), data)["value"]
    if short in ("Timestamp", "Duration"):
        m = decode(_TIME, data)
        micros = m["s"] * 1_000_000 + m["n"] // 1000
        return pd.Timestamp(micros, unit="us") if short == "Timestamp" else pd.Timedelta(micros, unit="us")
    if short == "Struct":
        return Json({k: v.value for k, v in decode(_STRUCT, data)["fields"].items()})
    if short == "ListValue":
        return Json([v.value for v in decode(_LIST, data)["values"]])
    if short == "Value":
        given = [v for v in decode(_VALUE, data).values() if v is not None]
        one = given[-1] if given else None
        return one if isinstance(one, Json) else Json(None if one == 0 and not isinstance(one, (bool, float)) else one)
    if short == "Any":
        m = decode(_PACKED, data)
        d = packed.get(m["type_url"].removeprefix(_PACKED_PREFIX))
        if d is not None and m["type_url"].startswith(_PACKED_PREFIX):
            try:
                return Json(_plain(decode(d, m["value"], packed)))
            except Malformed:
                pass
        return Json({"type_url": m["type_url"], "value": base64.b64encode(m["value"]).decode()})
    return data


def _plain(v):
    """A decoded value in JSON's terms: bytes as base64, times as texts."""
    if isinstance(v, Json):
        return v.value
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, bytes):
        return base64.b64encode(v).decode()
    if isinstance(v, pd.Timestamp):
        return v.isoformat() + "Z"
    if isinstance(v, pd.Timedelta):
        return f"{v.total_seconds():g}s"
    return v


def _message(f: Field, body: bytes, packed: dict[str, Descriptor]):
    return decode(f.message, body, packed) if isinstance(f.message, Descriptor) else _known(f.message, body, packed)


def decode(d: Descriptor, data: bytes, packed: dict[str, Descriptor] | None = None) -> dict:
    """A message as a dict.

    Fields that the descriptor does not know are skipped.  Of several values of one field the last
    stands; messages in one field are merged, as their bytes one after another are.  packed: descriptors
    of messages that may be packed in an Any.
    """
    by_number, packed = {f.number: f for f in d.fields}, packed or {}
    out, at = {f.name: _default(f) for f in d.fields}, 0
    bodies: dict[str, bytes] = {}
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if not number:
            raise Malformed("field number 0")
        f = by_number.get(number)
        if wire == 2:
            n, at = _varint(data, at)
            if at + n > len(data):
                raise Malformed("truncated")
            body, at = data[at : at + n], at + n
            if f is None:
                continue
            if f.kind == "map":
                value = f.message
                entry = decode(Descriptor("", (Field("k", 1, f.key), Field("v", 2, "message" if value is not None else f.value, message=value))), body, packed)
                v = entry["v"]
                out[f.name][entry["k"]] = _message(Field("v", 2, "message", message=value), b"", packed) if v is None and value is not None else v
            elif f.kind == "message" and not f.repeated:
                bodies[f.name] = bodies.get(f.name, b"") + body
            elif f.kind in ("string", "bytes", "message"):
                try:
                    v = body.decode() if f.kind == "string" else body if f.kind == "bytes" else _message(f, body, packed)
                except UnicodeDecodeError:
                    raise Malformed("bad UTF-8") from None
                if f.repeated:
                    out[f.name].append(v)
                else:
                    out[f.name] = v
            elif f.repeated:  # packed
                i, kind_wire = 0, 0 if f.kind in _VARINT else 5 if _FIXED[f.kind][1] == 4 else 1
                while i < len(body):
                    v, i = _scalar(f.kind, kind_wire, body, i)
                    out[f.name].append(v)
            else:
                raise Malformed("wrong wire type")
        elif f is None:
            if wire == 0:
                _, at = _varint(data, at)
            elif wire in (1, 5):
                at += 8 if wire == 1 else 4
            else:
                raise Malformed("unknown wire type")
            if at > len(data):
                raise Malformed("truncated")
        else:
            v, at = _scalar(f.kind, wire, data, at)
            if f.repeated:
                out[f.name].append(v)
            else:
                out[f.name] = v
    for f in d.fields:
        if f.name in bodies:
            out[f.name] = _message(f, bodies[f.name], packed)
    return out


def _sent(t: T.DataType) -> T.DataType:
    """The type by which a column leaves the worker."""
    if isinstance(t, T.VariantType):
        return T.StringType()
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _sent(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_sent(t.elementType))
    return T.MapType(t.keyType, _sent(t.valueType)) if isinstance(t, T.MapType) else t


def _received(v: Column, t: T.DataType) -> Column:
    if _sent(t) == t:
        return v
    if isinstance(t, T.VariantType):
        return F.try_parse_json(v)
    if isinstance(t, T.ArrayType):
        return F.transform(v, lambda x: _received(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(v, lambda k, x: _received(x, t.valueType))
    return F.when(v.isNotNull(), F.struct(*[_received(v.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))


def decode_messages(column: Column, d: Descriptor, packed: tuple[Descriptor, ...] = ()) -> Column:
    """A struct of the bytes of a column; null for null and for bytes that are no such message.

    Messages that hold any value come as variants; an Any of a type in `packed` as that message's fields.
    """
    kind, names = d.spark_type(), {p.name: p for p in packed}
    sent = _sent(kind)

    def shaped(v, t: T.DataType):
        if v is None:
            return None
        if isinstance(v, Json):
            return json.dumps(v.value)
        if isinstance(t, T.DecimalType):
            return decimal.Decimal(v)
        if isinstance(t, T.StructType):
            return {f.name: shaped(v[f.name], f.dataType) for f in t.fields}
        if isinstance(t, T.ArrayType):
            return [shaped(x, t.elementType) for x in v]
        if isinstance(t, T.MapType):
            return {k: shaped(x, t.valueType) for k, x in v.items()}
        return v

    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for data in batch:
            try:
                rows.append(None if data is None else shaped(decode(d, bytes(data), names), sent))
            except Malformed:
                rows.append(None)
        columns = {f.name: pd.Series([None if r is None else r[f.name] for r in rows], dtype=object) for f in sent.fields}
        return pd.DataFrame(columns | {"__ok": [r is not None for r in rows]})

    out = F.pandas_udf(run, T.StructType([*sent.fields, T.StructField("__ok", T.BooleanType())]))(column)
    return F.when(out["__ok"], F.struct(*[_received(out[f.name], f.dataType).alias(f.name) for f in kind.fields]))
