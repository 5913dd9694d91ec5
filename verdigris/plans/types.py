"""Types of expressions, and how they stand for Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Type:
    """A type by kind: null bool int uint double string bytes type timestamp duration dyn error,
    list, map, optional, wrapper (with args), message and opaque (with a name), param (inference only)."""

    kind: str
    args: tuple[Type, ...] = ()
    name: str = ""

    def __str__(self) -> str:
        if self.kind in ("message", "opaque", "param"):
            return self.name
        if self.kind == "wrapper":
            return f"wrapper({self.args[0]})"
        if self.kind == "optional":
            return f"optional_type({self.args[0]})"
        if self.args:
            return f"{self.kind}({', '.join(map(str, self.args))})"
        return {"null": "null_type"}.get(self.kind, self.kind)


NULL, BOOL, INT, UINT, DOUBLE, STRING, BYTES = (Type(k) for k in ("null", "bool", "int", "uint", "double", "string", "bytes"))
TYPE, TIMESTAMP, DURATION, DYN = (Type(k) for k in ("type", "timestamp", "duration", "dyn"))
NUMERIC = (INT, UINT, DOUBLE)
IP, CIDR, SEMVER, URL, FORMAT = (Type("opaque", (), n) for n in ("net.IP", "net.CIDR", "cel.Semver", "cel.URL", "cel.Format"))


def list_of(t: Type) -> Type:
    return Type("list", (t,))


def map_of(k: Type, v: Type) -> Type:
    return Type("map", (k, v))


def optional_of(t: Type) -> Type:
    return Type("optional", (t,))


def wrapper_of(t: Type) -> Type:
    return Type("wrapper", (t,))


def param(name: str) -> Type:
    return Type("param", (), name)


def nullable(t: Type) -> bool:
    """Whether a value of the type can be null."""
    return t.kind in ("wrapper", "message", "null", "dyn", "timestamp", "duration")


def bare(t: Type) -> Type:
    return t.args[0] if t.kind == "wrapper" else t


_ATOMS = {"bool": T.BooleanType(), "int": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "type": T.StringType(), "timestamp": T.TimestampType(), "duration": T.DayTimeIntervalType(0, 3), "null": T.NullType()}
#: Unsigned integers are decimals of twenty digits within range.
UINT_TYPE = T.DecimalType(20, 0)
_OPAQUE = {
    "net.IP": "family int, hi decimal(20,0), lo decimal(20,0)",
    "net.CIDR": "family int, hi decimal(20,0), lo decimal(20,0), prefix int",
    "cel.Semver": "major bigint, minor bigint, patch bigint, pre string, build string",
    "cel.URL": "raw string",
    "cel.Format": "name string",
}


def spark_type(t: Type, messages: dict[str, T.StructType] | None = None) -> T.DataType:
    match t.kind:
        case "uint":
            return UINT_TYPE
        case "list":
            return T.ArrayType(spark_type(t.args[0], messages))
        case "map":
            return T.MapType(spark_type(t.args[0], messages), spark_type(t.args[1], messages))
        case "optional":
            return T.StructType([T.StructField("v", spark_type(t.args[0], messages))])
        case "wrapper":
            return spark_type(t.args[0], messages)
        case "message":
            return (messages or {})[t.name]
        case "opaque":
            return T._parse_datatype_string(_OPAQUE[t.name])
        case "dyn" | "param":
            return T.VariantType()
    return _ATOMS[t.kind]


def type_of(s: T.DataType, null: bool = False, name: str = "", messages: dict | None = None) -> Type:
    """The expression type of a Spark type; a column that may be null gets a wrapper where its type has no null."""
    if isinstance(s, T.BooleanType):
        t = BOOL
    elif isinstance(s, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        t = INT
    elif isinstance(s, (T.FloatType, T.DoubleType)):
        t = DOUBLE
    elif isinstance(s, T.DecimalType):
        t = UINT if s == UINT_TYPE else DOUBLE
    elif isinstance(s, T.BinaryType):
        t = BYTES
    elif isinstance(s, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        t = TIMESTAMP
    elif isinstance(s, T.DayTimeIntervalType):
        t = DURATION
    elif isinstance(s, T.ArrayType):
        return list_of(type_of(s.elementType, False, name + ".item", messages))
    elif isinstance(s, T.MapType):
        return map_of(type_of(s.keyType, False, name, messages), type_of(s.valueType, False, name + ".value", messages))
    elif isinstance(s, T.StructType):
        if messages is not None:
            messages[name] = s
        return Type("message", (), name)
    elif isinstance(s, T.VariantType):
        return DYN
    elif isinstance(s, T.NullType):
        return NULL
    else:
        t = STRING
    return wrapper_of(t) if null and not nullable(t) else t


def parse_type(text: str) -> Type:
    """A type from its text, such as `map(string, list(int))`; single capitals are parameters."""
    text = text.strip()
    if "(" not in text:
        if len(text) == 1 and text.isupper():
            return param(text)
        known = {"null_type": NULL, "net.IP": IP, "net.CIDR": CIDR, "cel.Semver": SEMVER, "cel.URL": URL, "cel.Format": FORMAT}
        if text in known:
            return known[text]
        return Type(text) if text in (*_ATOMS, "uint", "dyn") else Type("message", (), text)
    head, rest = text.split("(", 1)
    depth, parts, start = 0, [], 0
    for i, c in enumerate(rest[:-1]):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(rest[start:i])
            start = i + 1
    parts.append(rest[start:-1])
    return Type({"optional_type": "optional"}.get(head.strip(), head.strip()), tuple(map(parse_type, parts)))


# ---- inference ----------------------------------------------------------------------------------


class Bindings:
    """Types that parameters stand for."""

    def __init__(self):
        self.of: dict[str, Type] = {}
        self.n = 0

    def fresh(self) -> Type:
        self.n += 1
        return param(f"_{self.n}")

    def instance(self, types: list[Type]) -> list[Type]:
        """The types with fresh parameters for theirs."""
        new: dict[str, Type] = {}

        def go(t: Type) -> Type:
            if t.kind == "param":
                return new.setdefault(t.name, self.fresh())
            return Type(t.kind, tuple(map(go, t.args)), t.name)

        return [go(t) for t in types]

    def resolve(self, t: Type, erase: bool = False) -> Type:
        while t.kind == "param" and t.name in self.of:
            t = self.of[t.name]
        if t.kind == "param":
            return DYN if erase else t
        return Type(t.kind, tuple(self.resolve(a, erase) for a in t.args), t.name)

    def _within(self, name: str, t: Type) -> bool:
        t = self.resolve(t)
        return t == param(name) or any(self._within(name, a) for a in t.args)

    def assign(self, to: Type, t: Type) -> bool:
        """Whether t can go where `to` is wanted; binds parameters."""
        to, t = self.resolve(to), self.resolve(t)
        if to == t:
            return True
        if to.kind == "param":
            if self._within(to.name, t):
                return False
            self.of[to.name] = t
            return True
        if t.kind == "param":
            if self._within(t.name, to):
                return False
            self.of[t.name] = to
            return True
        if "dyn" in (to.kind, t.kind):
            return True
        if t.kind == "null":
            return nullable(to) or to.kind == "optional"
        if to.kind == "wrapper" and t.kind != "wrapper":
            return self.assign(to.args[0], t)
        if t.kind == "wrapper" and to.kind != "wrapper":
            return self.assign(to, t.args[0])
        return to.kind == t.kind and to.name == t.name and len(to.args) == len(t.args) and all(self.assign(a, b) for a, b in zip(to.args, t.args, strict=True))

    def trial(self, pairs: list[tuple[Type, Type]]) -> bool:
        saved = dict(self.of)
        if all(self.assign(a, b) for a, b in pairs):
            return True
        self.of = saved
        return False

    def join(self, a: Type, b: Type) -> Type:
        """The common type of two branches or elements; dyn if neither takes the other."""
        a, b = self.resolve(a), self.resolve(b)
        if a.kind == "dyn" or b.kind == "dyn":
            return DYN
        if a.kind == "null" and not nullable(b) and b.kind in ("bool", "int", "uint", "double", "string", "bytes"):
            return DYN
        if self.trial([(a, b)]):
            return b if a.kind == "null" or (b.kind == "wrapper" and a.kind != "wrapper") else self.resolve(a)
        if self.trial([(b, a)]):
            return self.resolve(b)
        return DYN
