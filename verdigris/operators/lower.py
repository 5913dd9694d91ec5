"""Lowering: from a typed tree to Spark columns.

An error is NULL.  Where a type has no null of its own, NULL in its column can only be an error, so
comparison, arithmetic and logic need no more than Spark's three-valued logic, and conjuncts stay
plain enough to be pushed to the scan.  Values of types that have a null carry the condition of their
failure beside them, and it is looked at only where null can be told from an error.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import syntax as S
from ..plans.check import Typed
from ..plans.env import Env
from ..plans.types import DYN, NUMERIC, UINT_TYPE, Type, bare, nullable, spark_type

INT_MIN, UINT_MAX = -(1 << 63), decimal.Decimal((1 << 64) - 1)


@dataclass
class Lowered:
    """A column and when it is an error.  strict: exactly where it is NULL; sure: never; else where `bad` holds."""

    v: Column
    strict: bool = False
    sure: bool = False
    bad: Callable[[], Column] | None = None
    literal: object = None

    def failed(self) -> Column | None:
        if self.sure:
            return None
        return self.v.isNull() if self.strict else self.bad() if self.bad else None


def any_failed(*parts: Lowered) -> Column | None:
    out = None
    for p in parts:
        f = p.failed()
        if f is not None:
            out = f if out is None else out | f
    return out


def let(v: Column, body: Callable[[Column], Column]) -> Column:
    """body of v, which is worked out once and stands once in the plan."""
    return F.get(F.transform(F.array(v), body), 0)


def unless(failed: Column | None, v: Column) -> Column:
    return v if failed is None else F.when(~failed, v)


def is_null_error(t: Type) -> bool:
    """Whether NULL in a column of the type can only be an error."""
    return not nullable(t) and t.kind != "optional"


def literal(value, t: Type) -> Column:
    if value is None:
        return F.lit(None)
    if t.kind == "uint":
        return F.lit(decimal.Decimal(value)).cast(UINT_TYPE)
    if t.kind == "int":
        return F.lit(value).cast("bigint")
    if t.kind == "double":
        return F.lit(float(value))
    if t.kind == "list":
        return F.array(*[literal(x, t.args[0]) for x in value]).cast(spark_type(t))
    if t.kind == "map":
        return F.create_map(*[c for k, v in value.items() for c in (literal(k, t.args[0]), literal(v, t.args[1]))]).cast(spark_type(t))
    return F.lit(bytearray(value) if isinstance(value, bytes) else value)


def is_nan_literal_free(x: Lowered) -> bool:
    return isinstance(x.literal, (int, float)) and x.literal == x.literal


def to_variant(v: Column, t: Type) -> Column:
    if t.kind in ("dyn", "param"):
        return v
    if t.kind == "null":
        return F.parse_json(F.lit("null"))
    if t.kind in ("list", "map", "message"):
        return F.to_variant_object(v)
    if t.kind == "optional":
        return to_variant(v["v"], t.args[0])
    return v.cast(T.VariantType())


#: The largest integer up to which a double holds every one; fixed value.
SAFE_INTEGER = (1 << 53) - 1


def json_can_fail(t: Type) -> bool:
    """Whether a value of the type may have no JSON: maps by other keys than strings, and messages but two."""
    t = bare(t)
    if t.kind == "map":
        return t.args[0].kind not in ("string", "dyn", "param") or json_can_fail(t.args[1])
    return t.kind == "message" and t.name not in ("google.protobuf.Empty", "google.protobuf.FieldMask") or t.kind == "list" and json_can_fail(t.args[0])


def json_value(v: Column, t: Type) -> Column:
    """What a field that holds any JSON value gets of a value, as a variant: numbers are doubles, large integers texts, bytes base64; NULL for what has no JSON."""
    from ..functions.standard import duration_text, timestamp_text

    t = bare(t)
    match t.kind:
        case "int" | "uint":
            return F.when(F.abs(v) <= SAFE_INTEGER, v.cast("double").cast(T.VariantType())).otherwise(v.cast("string").cast(T.VariantType()))
        case "bytes":
            return F.translate(F.base64(v), "\r\n", "").cast(T.VariantType())
        case "timestamp":
            return timestamp_text(v).cast(T.VariantType())
        case "duration":
            return duration_text(v).cast(T.VariantType())
        case "list":
            return F.to_variant_object(F.transform(v, lambda x: json_value(x, t.args[0]))) if not json_can_fail(t) else F.lit(None).cast(T.VariantType())
        case "map" if not json_can_fail(t):
            return F.to_variant_object(F.transform_values(v, lambda k, x: json_value(x, t.args[1])))
        case "message" if t.name == "google.protobuf.FieldMask":
            return F.array_join(F.coalesce(v["paths"], F.array().cast("array<string>")), ",").cast(T.VariantType())
        case "message" if t.name == "google.protobuf.Empty":
            return F.when(v.isNotNull(), F.parse_json(F.lit("{}")))
        case "map" | "message":
            return F.lit(None).cast(T.VariantType())
    return to_variant(v, t)


def convert(v: Column, a: Type, b: Type) -> Column:
    """A column of type a where b is wanted."""
    if bare(a) == bare(b) or b.kind == "param":
        return v
    if b.kind == "dyn":
        return to_variant(v, a)
    if a.kind in ("dyn", "param"):
        return from_variant(v, b)
    if a.kind == "null":
        return v.cast(spark_type(b)) if b.kind != "message" else v
    if a.kind == b.kind == "list" and spark_type(a) != spark_type(b):
        return F.transform(v, lambda x: convert(x, a.args[0], b.args[0]))
    if a.kind == b.kind == "map":
        w = v if spark_type(a.args[1]) == spark_type(b.args[1]) else F.transform_values(v, lambda k, x: convert(x, a.args[1], b.args[1]))
        return w if spark_type(a.args[0]) == spark_type(b.args[0]) else F.transform_keys(w, lambda k, x: convert(k, a.args[0], b.args[0]))
    if a.kind == b.kind == "optional":
        return F.when(v.isNotNull(), F.struct(convert(v["v"], a.args[0], b.args[0]).alias("v")))
    return v


_KINDS = {"int": ("BIGINT",), "double": ("DOUBLE",), "bool": ("BOOLEAN",), "string": ("STRING",), "uint": ("DECIMAL",), "bytes": ("BINARY",), "timestamp": ("TIMESTAMP",)}


def variant_kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def from_variant(v: Column, t: Type) -> Column:
    """The value of a variant if it is of the type, else NULL.  Whole decimals of JSON count as doubles."""
    t = bare(t)
    kind = variant_kind(v)
    if t.kind == "int":
        return F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))
    if t.kind == "double":
        return F.when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))
    if t.kind == "uint":
        return F.when(kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "decimal(20,0)"))
    if t.kind in _KINDS:
        return F.when(kind.startswith(_KINDS[t.kind][0]), F.try_variant_get(v, "$", spark_type(t).simpleString()))
    return F.try_variant_get(v, "$", spark_type(t).simpleString())


def variant_number(v: Column) -> Column:
    kind = variant_kind(v)
    return F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))


def same_bigint_double(i: Column, d: Column) -> Column:
    whole = (d >= float(-(1 << 63))) & (d < float(1 << 63))
    return F.when(whole, (d.cast("bigint") == i) & (d.cast("bigint").cast("double") == d)).when(i.isNotNull() & d.isNotNull(), F.lit(False))


def has_nan(v: Column, t: Type) -> Column | None:
    """Where a value holds NaN; None if its type has no doubles."""
    t = bare(t)
    if t.kind == "double":
        return F.isnan(v)
    if t.kind == "list" and has_nan(v, t.args[0]) is not None:
        return F.exists(v, lambda x: has_nan(x, t.args[0]))
    return None


def equal(a: Lowered, x: Type, b: Lowered, y: Type) -> Column:
    """Equality: NULL where either is an error; numbers compare across types; other types differ."""
    x, y = bare(x), bare(y)
    failed = any_failed(a, b)
    if x.kind in ("dyn", "param") or y.kind in ("dyn", "param"):
        return unless(failed, _equal_dyn(a.v, x, b.v, y))
    if "null" in (x.kind, y.kind):
        other, t = (b, y) if x.kind == "null" else (a, x)
        return unless(failed, other.v.isNull() if not is_null_error(t) and t.kind != "optional" or t.kind == "null" else F.lit(False) if t.kind == "optional" else (other.v.isNull() if not other.strict else F.lit(False)))
    if x != y and x in NUMERIC and y in NUMERIC:
        if "double" in (x.kind, y.kind):
            whole, d = (b.v, a.v) if x.kind == "double" else (a.v, b.v)
            if "uint" in (x.kind, y.kind):
                return unless(failed, F.when((d >= 0.0) & (d < float(1 << 64)), (d.cast("decimal(20,0)") == whole) & (F.floor(d).cast("double") == d)).when(d.isNotNull() & whole.isNotNull(), F.lit(False)))
            return unless(failed, same_bigint_double(whole, d))
        return a.v.cast("decimal(21,0)") == b.v.cast("decimal(21,0)")
    if x.kind != y.kind or x.name != y.name:
        return unless(failed, F.lit(False))
    if x.kind == "list" and x.args[0] != y.args[0]:
        both = lambda p: F.size(F.filter(F.zip_with(a.v, b.v, lambda m, n: equal(Lowered(m, sure=True), x.args[0], Lowered(n, sure=True), y.args[0])), p))
        return unless(failed, (F.size(a.v) == F.size(b.v)) & (both(lambda e: ~F.coalesce(e, F.lit(False))) == 0))
    if x.kind == "map":
        entries = lambda v: F.array_sort(F.map_entries(v))
        return unless(failed, entries(a.v).eqNullSafe(entries(b.v)))
    nan = None if is_nan_literal_free(a) or is_nan_literal_free(b) else has_nan(a.v, x)
    if all(p.strict or p.literal is not None for p in (a, b)) and x.kind != "list":
        out = a.v == b.v
    else:
        out = unless(failed, a.v.eqNullSafe(b.v))
    return out if nan is None else out & ~nan


def _equal_dyn(v: Column, x: Type, w: Column, y: Type) -> Column:
    if y.kind in ("dyn", "param") and x.kind not in ("dyn", "param"):
        v, x, w, y = w, y, v, x
    if y.kind == "null":
        return F.is_variant_null(v) | v.isNull()
    if y in NUMERIC:
        exact = F.try_variant_get(v, "$", "bigint") if y.kind == "int" else None
        loose = variant_number(v) == w.cast("double")
        return F.coalesce(F.when(variant_kind(v) == "BIGINT", exact == w) if exact is not None else loose, loose, F.lit(False))
    if y.kind in _KINDS:
        return F.coalesce(from_variant(v, y) == w, F.lit(False))
    other = w if y.kind in ("dyn", "param") else to_variant(w, y)
    numbers = variant_number(v) == variant_number(other)
    return F.coalesce(numbers, F.to_json(v) == F.to_json(other), F.lit(False))


def ordered(op: str, a: Lowered, x: Type, b: Lowered, y: Type) -> Column:
    """Ordering; NaN is not ordered to anything."""
    x, y = bare(x), bare(y)
    v, w = a.v, b.v
    if x.kind in ("dyn", "param") or y.kind in ("dyn", "param"):
        t = y if x.kind in ("dyn", "param") else x
        if t.kind in ("dyn", "param"):
            numbers = _compare(op, variant_number(v), variant_number(w), True, True)
            texts = _compare(op, from_variant(v, Type("string")), from_variant(w, Type("string")))
            return F.coalesce(numbers, texts)
        if t in NUMERIC:
            v = variant_number(v) if x.kind in ("dyn", "param") else v.cast("double")
            w = variant_number(w) if y.kind in ("dyn", "param") else w.cast("double")
            return _compare(op, v, w, not is_nan_literal_free(a), not is_nan_literal_free(b))
        return _compare(op, from_variant(v, t) if x.kind in ("dyn", "param") else v, from_variant(w, t) if y.kind in ("dyn", "param") else w)
    if x != y:
        kind = "double" if "double" in (x.kind, y.kind) else "decimal(21,0)"
        v, w = v.cast(kind), w.cast(kind)
        x = Type("double") if kind == "double" else x
    doubles = x.kind == "double"
    return _compare(op, v, w, doubles and not is_nan_literal_free(a), doubles and not is_nan_literal_free(b))


def _compare(op: str, v: Column, w: Column, nan_left: bool = False, nan_right: bool = False) -> Column:
    out = {"<": v < w, "<=": v <= w, ">": v > w, ">=": v >= w}[op]
    # Spark puts NaN above everything and equal to itself
    if op in ("<", "<=") and nan_right:
        out = out & ~F.isnan(w)
    if op in (">", ">=") and nan_left:
        out = out & ~F.isnan(v)
    return out


def in_uint(v: Column) -> Column:
    return F.when((v >= 0) & (v <= F.lit(UINT_MAX)), v.cast(UINT_TYPE))


def in_time(v: Column) -> Column:
    return F.when(v.between(F.lit("0001-01-01 00:00:00").cast("timestamp"), F.lit("9999-12-31 23:59:59.999999").cast("timestamp")), v)


def divide_double(a: Column, b: Column) -> Column:
    inf = F.lit(float("inf"))
    sign = F.when(a < 0, -1.0).otherwise(1.0) * F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0)
    return F.when(b != 0.0, a / b).when((a == 0.0) | F.isnan(a), F.lit(float("nan"))).when(a.isNotNull() & b.isNotNull(), sign * inf)


def divide_int(a: Column, b: Column) -> Column:
    return F.when((b != 0) & ~((a == F.lit(INT_MIN)) & (b == -1)), F.call_function("div", a, F.when(b != 0, b)))


def arithmetic(op: str, v: Column, x: Type, w: Column, y: Type, t: Type) -> Column:
    x, y = bare(x), bare(y)
    if "dyn" in (x.kind, y.kind):
        known = y if x.kind == "dyn" else x
        if known.kind == "dyn":
            known = Type("double")
            v, w = variant_number(v), variant_number(w)
            out = arithmetic(op, v, known, w, known, known)
            return to_variant(out, known)
        v = from_variant(v, known) if x.kind == "dyn" else v
        w = from_variant(w, known) if y.kind == "dyn" else w
        return arithmetic(op, v, known, w, known, known)
    if x.kind == y.kind == "int":
        return {"+": lambda: F.try_add(v, w), "-": lambda: F.try_subtract(v, w), "*": lambda: F.try_multiply(v, w), "/": lambda: divide_int(v, w), "%": lambda: F.try_mod(v, w)}[op]()
    if x.kind == y.kind == "uint":
        if op == "/":
            return F.when(w != 0, ((v - F.try_mod(v, w)) / F.when(w != 0, w)).cast(UINT_TYPE))
        return in_uint({"+": lambda: v + w, "-": lambda: v - w, "*": lambda: F.try_multiply(v, w), "%": lambda: F.try_mod(v, w)}[op]())
    if x.kind == y.kind == "double":
        return {"+": lambda: v + w, "-": lambda: v - w, "*": lambda: v * w, "/": lambda: divide_double(v, w)}[op]()
    if x.kind in ("string", "bytes"):
        return F.concat(v, w)
    if x.kind == "list":
        return F.concat(convert(v, x, t), convert(w, y, t))
    if op == "+" and "timestamp" in (x.kind, y.kind):
        return in_time(v + w)
    if op == "-" and x.kind == "timestamp" and y.kind == "duration":
        return in_time(v - w)
    out = v - w if op == "-" else v + w
    limit = F.expr("INTERVAL '3652500' DAY")
    return F.when((out <= limit) & (out >= -limit), out)


class Lowerer:
    """columns: a column for a variable's name; those not given are read by name."""

    def __init__(self, env: Env, columns: dict[str, Column] | None = None):
        self.env, self.columns = env, columns or {}
        self.locals: list[dict[str, Lowered]] = []
        self.trace: list[tuple[Typed, Lowered]] | None = None
        self.hooks: list[Callable] = []

    @property
    def whole(self) -> bool:
        """Whether every node needs a column of its own."""
        return self.trace is not None or bool(self.hooks)

    def lower(self, t: Typed) -> Lowered:
        out = getattr(self, f"lower_{t.op}")(t)
        for hook in self.hooks:
            got = hook(S.unparse(t.source) if t.source is not None else t.op, str(t.type), out.v)
            if got is not None:
                out = Lowered(got, strict=is_null_error(t.type), sure=not is_null_error(t.type))
        if self.trace is not None and not self.locals:
            self.trace.append((t, out))
        return out

    def strict(self, v: Column, t: Type) -> Lowered:
        """A column whose NULL is an error even if its type has a null."""
        return Lowered(v, strict=True)

    def lower_const(self, t: Typed) -> Lowered:
        return Lowered(literal(t.value, t.type), sure=True, literal=t.value)

    def lower_error(self, t: Typed) -> Lowered:
        return Lowered(F.lit(None).cast(T.VariantType()), strict=True)

    def lower_column(self, t: Typed) -> Lowered:
        if t.value in self.columns:
            v = self.columns[t.value]
        else:
            name, kind = self.env.column_of(t.value)
            v = F.col(name if isinstance(name, str) and "`" in name else f"`{name}`")
            if kind is not None:
                v = _widened(v, kind)
        return Lowered(v, sure=not is_null_error(t.type), strict=is_null_error(t.type))

    def lower_local(self, t: Typed) -> Lowered:
        return next(s[t.value] for s in reversed(self.locals) if t.value in s)

    def lower_bind(self, t: Typed) -> Lowered:
        self.locals.append({t.value: self.lower(t.args[0])})
        out = self.lower(t.args[1])
        self.locals.pop()
        return out

    # ---- access

    def lower_field(self, t: Typed) -> Lowered:
        return self._get(t, t.args[0], None, t.value["field"], t.value["optional"])

    def lower_index(self, t: Typed) -> Lowered:
        return self._get(t, t.args[0], t.args[1], None, t.value["optional"])

    def _of_literal(self, t: Typed, operand: Typed, key: Typed | None, name: str | None) -> Lowered | None:
        """The value that a map literal of constant keys has for a constant key that it holds."""
        keys = constant_keys(operand)
        if keys is None or key is not None and (key.op != "const" or key.type != bare(operand.type.args[0])):
            return None
        wanted = name if key is None else key.value
        if wanted not in keys:
            return None
        values = [self.lower(a) for a in operand.args[1::2]]
        at, failed = keys.index(wanted), any_failed(*values)
        got = convert(values[at].v, operand.args[2 * at + 1].type, operand.type.args[1])
        if is_null_error(t.type):
            return Lowered(unless(any_failed(*values[:at], *values[at + 1 :]), got), strict=True)
        return Lowered(got, bad=(lambda: failed) if failed is not None else None, sure=failed is None)

    def _get(self, t: Typed, operand: Typed, key: Typed | None, name: str | None, optional: bool) -> Lowered:
        if not optional and not self.whole and (known := self._of_literal(t, operand, key, name)) is not None:
            return known
        base, kind = self.lower(operand), operand.type
        failed = any_failed(base)
        v, missing = base.v, None
        if kind.kind == "optional":
            missing = v.isNull()
            v, kind = v["v"], kind.args[0]
        k = self.lower(key) if key is not None else None
        found, got = self._lookup(v, kind, k, key.type if key is not None else None, name)
        if missing is not None:
            found = ~missing & F.coalesce(found, F.lit(False))
        failed = any_failed(base, *([k] if k is not None else []))
        if optional:
            return Lowered(unless(failed, F.when(found, F.struct(got.alias("v")))), bad=(lambda: failed) if failed is not None else None, sure=failed is None)
        if is_null_error(t.type):
            return Lowered(got, strict=True)
        bad = ~F.coalesce(found, F.lit(False))
        bad = bad if failed is None else bad | failed
        return Lowered(got, bad=lambda: bad)

    def _lookup(self, v: Column, kind: Type, k: Lowered | None, key_type: Type | None, name: str | None) -> tuple[Column, Column]:
        """(whether it is there, the value or NULL)."""
        if kind.kind == "message":
            field = v.getField(name)
            struct = self.env.all_messages()[kind.name]
            wide = _widened(field, struct[name].dataType)
            if self._implicit(kind.name):
                wide = F.coalesce(wide, zero_of(struct[name].dataType))
            return v.isNotNull(), wide
        if kind.kind == "map":
            key = F.lit(name) if name is not None else self._key(k.v, key_type, kind.args[0])
            return F.when(key.isNotNull(), F.map_contains_key(v, key)), F.try_element_at(v, key)
        if kind.kind == "list":
            i = self._position(k.v, key_type)
            return (i >= 0) & (i < F.size(v)), F.get(v, i.cast("int"))
        # a variant: objects by name, arrays by position
        if name is not None:
            got = F.try_variant_get(v, _path(name), "variant")
        elif bare(key_type).kind in ("int", "uint", "double"):
            parts = F.try_variant_get(v, "$", "array<variant>")
            got = F.get(parts, self._position(k.v, key_type).cast("int"))
        elif isinstance(k.literal, str):
            got = F.try_variant_get(v, _path(k.literal), "variant")
        else:
            got = F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), k.v.cast("string"))
        return got.isNotNull(), got

    def _implicit(self, message: str) -> bool:
        return next((e.defaults[message] for e in self.env.chain() if message in e.defaults), False)

    def _key(self, k: Column, have: Type, want: Type) -> Column:
        have, want = bare(have), bare(want)
        if have == want or have not in (*NUMERIC, DYN):
            return k
        if have.kind == "dyn":
            return from_variant(k, want)
        if want.kind == "int":
            whole = k.cast("bigint") if have.kind == "uint" else F.when((k == F.floor(k)) & (k >= float(INT_MIN)) & (k < float(1 << 63)), k.cast("bigint"))
            return F.when(k <= F.lit((1 << 63) - 1), whole)
        return in_uint(k.cast("decimal(21,0)"))

    def _position(self, k: Column, have: Type) -> Column:
        return self._key(k, have, Type("int")) if bare(have).kind != "int" else k

    def lower_has(self, t: Typed) -> Lowered:
        base, kind, name = self.lower(t.args[0]), t.args[0].type, t.value["field"]
        v, lifted = base.v, kind.kind == "optional"
        if lifted:
            v, kind = v["v"], kind.args[0]
        if kind.kind == "message":
            struct = self.env.all_messages()[kind.name]
            field = v.getField(name)
            there = F.when(v.isNotNull(), field.isNotNull())
            if lifted:
                there = F.coalesce(there, F.lit(False))
            if self._implicit(kind.name):
                there = there & ~F.coalesce(is_zero(field, struct[name].dataType), F.lit(False))
            elif isinstance(struct[name].dataType, (T.ArrayType, T.MapType)):
                there = there & (F.size(field) > 0)
            return Lowered(unless(any_failed(base), there), strict=True)
        k = self.lower(t.args[1]) if len(t.args) > 1 else None
        found, _ = self._lookup(v, kind, k, t.args[1].type if k else None, name)
        failed = any_failed(base, *([k] if k else []))
        return Lowered(unless(failed, F.coalesce(found, F.lit(False))), strict=True)

    # ---- operators

    def lower_unary(self, t: Typed) -> Lowered:
        a, kind = self.lower(t.args[0]), bare(t.args[0].type)
        v = a.v
        if t.value == "!":
            return Lowered(~(from_variant(v, Type("bool")) if kind.kind == "dyn" else v), strict=True)
        if kind.kind == "dyn":
            return Lowered(to_variant(-variant_number(v), Type("double")), strict=True)
        return Lowered(-v if kind.kind == "double" else F.try_subtract(F.lit(0).cast("bigint"), v), strict=True)

    def lower_binary(self, t: Typed) -> Lowered:
        op = t.value
        if op in ("&&", "||") and (chain := _chain(t, op)) is not None:
            return Lowered(self._balanced(chain, op), strict=True)
        if op in _TURNED and not self.whole and (found := self._year_range(op, *t.args)) is not None:
            return Lowered(found, strict=True)
        a, b = self.lower(t.args[0]), self.lower(t.args[1])
        x, y = t.args[0].type, t.args[1].type
        if op in ("&&", "||"):
            v, w = (from_variant(p.v, Type("bool")) if k.kind == "dyn" else p.v for p, k in ((a, x), (b, y)))
            return Lowered(v & w if op == "&&" else v | w, strict=True)
        if op == "==":
            return Lowered(equal(a, x, b, y), strict=True)
        if op == "!=":
            return Lowered(~equal(a, x, b, y), strict=True)
        if op in ("<", "<=", ">", ">="):
            return Lowered(ordered(op, a, x, b, y), strict=True)
        if op == "in":
            return Lowered(self._contains(t, a, b), strict=True)
        return Lowered(arithmetic(op, a.v, x, b.v, y, t.type), strict=True)

    def _year_range(self, op: str, a: Typed, b: Typed) -> Column | None:
        """A comparison of a UTC year with a constant as one of the time itself, which scans can use."""
        if a.op == "const":
            a, b, op = b, a, _TURNED[op]
        if b.op != "const" or b.type.kind != "int" or not 1 <= b.value <= 9998 or a.op != "call" or a.value.name != "getFullYear" or len(a.args) != 1 or a.args[0].type.kind != "timestamp":
            return None
        of, kind = a.args[0], "timestamp"
        v = self.lower(of).v
        if of.op == "column" and of.value not in self.columns:
            name, stored = self.env.column_of(of.value)
            if isinstance(stored, (T.DateType, T.TimestampNTZType)):  # as they are stored, in UTC
                v, kind = F.col(f"`{name}`"), "date" if isinstance(stored, T.DateType) else "timestamp_ntz"
        starts = [F.lit(f"{y:04d}-01-01" + (" 00:00:00" if kind != "date" else "") + ("Z" if kind == "timestamp" else "")).cast(kind) for y in (b.value, b.value + 1)]
        return {
            "==": lambda: (v >= starts[0]) & (v < starts[1]), "!=": lambda: (v < starts[0]) | (v >= starts[1]), "<": lambda: v < starts[0],
            "<=": lambda: v < starts[1], ">": lambda: v >= starts[1], ">=": lambda: v >= starts[0],
        }[op]()

    def _balanced(self, parts: list[Typed], op: str) -> Column:
        """A long chain of logic as a flat tree, so that plans stay shallow."""
        if len(parts) == 1:
            v = self.lower(parts[0]).v
            return from_variant(v, Type("bool")) if parts[0].type.kind == "dyn" else v
        half = len(parts) // 2
        a, b = self._balanced(parts[:half], op), self._balanced(parts[half:], op)
        return a & b if op == "&&" else a | b

    def _contains(self, t: Typed, a: Lowered, b: Lowered) -> Column:
        x, y = t.args[0].type, t.args[1].type
        failed = any_failed(a, b)
        keys = constant_keys(t.args[1]) if y.kind == "map" else None
        if keys is not None and bare(x) == bare(y.args[0]):
            return unless(b.failed(), a.v.isin(keys)) if not nullable(x) else unless(failed, F.coalesce(a.v.isin(keys), F.lit(False)))
        if y.kind == "map":
            key = self._key(a.v, x, y.args[0])
            return unless(failed, F.coalesce(F.map_contains_key(b.v, F.when(key.isNotNull(), key)), F.lit(False)))
        if y.kind == "dyn":
            return unless(failed, F.exists(F.try_variant_get(b.v, "$", "array<variant>"), lambda e: _equal_dyn(e, DYN, a.v, bare(x))))
        items = t.args[1].args if t.args[1].op == "list" and not any(t.args[1].value) else None
        if items is not None and all(i.op == "const" and i.type == bare(x) and i.value is not None for i in items) and bare(x).kind in ("int", "string", "bool"):
            return a.v.isin([i.value for i in items]) if items else unless(failed, F.lit(False))
        element = y.args[0]
        return unless(failed, F.exists(b.v, lambda e: F.coalesce(equal(Lowered(e, sure=True), element, Lowered(a.v, sure=True, literal=a.literal), x), F.lit(False))))

    def lower_cond(self, t: Typed) -> Lowered:
        c, a, b = (self.lower(x) for x in t.args)
        cond = from_variant(c.v, Type("bool")) if t.args[0].type.kind == "dyn" else c.v
        v = F.when(cond, convert(a.v, t.args[1].type, t.type)).when(~cond, convert(b.v, t.args[2].type, t.type))
        if is_null_error(t.type):
            return Lowered(v, strict=True)
        no = F.lit(False)
        return Lowered(v, bad=lambda: F.when(cond, F.coalesce(a.failed(), no) if a.failed() is not None else no).when(~cond, b.failed() if b.failed() is not None else no).otherwise(True))

    # ---- construction

    def lower_list(self, t: Typed) -> Lowered:
        parts = [self.lower(a) for a in t.args]
        element, failed = t.type.args[0], any_failed(*parts)
        if not parts:
            return Lowered(F.array().cast(spark_type(t.type, self.env.all_messages())), sure=True)
        if any(t.value):
            groups = []
            for p, a, o in zip(parts, t.args, t.value, strict=True):
                if o:
                    one = F.array(convert(p.v["v"], a.type.args[0], element))
                    groups.append(F.when(p.v.isNotNull(), one).otherwise(F.slice(one, 1, 0)))
                else:
                    groups.append(F.array(convert(p.v, a.type, element)))
            return Lowered(unless(failed, F.concat(*groups)), strict=True)
        return Lowered(unless(failed, F.array(*[convert(p.v, a.type, element) for p, a in zip(parts, t.args, strict=True)])), strict=failed is not None, sure=failed is None)

    def lower_map(self, t: Typed) -> Lowered:
        parts = [self.lower(a) for a in t.args]
        if not parts:
            return Lowered(F.create_map().cast(spark_type(t.type, self.env.all_messages())), sure=True)
        k, v = t.type.args
        if constant_keys(t) is not None:
            failed = any_failed(*parts)
            items = [convert(p.v, a.type, (k, v)[i % 2]) for i, (p, a) in enumerate(zip(parts, t.args, strict=True))]
            return Lowered(unless(failed, F.create_map(*items)), strict=failed is not None, sure=failed is None)
        if len(parts) == 2 and not any(t.value):  # one key occurs once
            key, value = (convert(p.v, a.type, want) for p, a, want in zip(parts, t.args, (k, v), strict=True))
            return Lowered(unless(any_failed(*parts), F.when(key.isNotNull(), F.create_map(key, value))), strict=True)
        entries = []
        for (p, a), (q, b), o in zip(zip(parts[::2], t.args[::2], strict=True), zip(parts[1::2], t.args[1::2], strict=True), t.value, strict=True):
            key = convert(p.v, a.type, k)
            value = convert(q.v["v"], b.type.args[0], v) if o else convert(q.v, b.type, v)
            one = F.array(F.struct(key.alias("key"), value.alias("value")))
            entries.append(F.when(q.v.isNotNull(), one).otherwise(F.slice(one, 1, 0)) if o else one)
        return Lowered(map_from(unless(any_failed(*parts), F.concat(*entries))), strict=True)

    def lower_message(self, t: Typed) -> Lowered:
        parts = [self.lower(a) for a in t.args]
        name = t.value["name"]
        struct, given = self.env.all_messages()[name], dict(zip(t.value["fields"], zip(parts, t.args, t.value["optional"], strict=True), strict=True))
        fields, failed = [], any_failed(*parts)
        for f in struct.fields:
            if f.name in given:
                p, a, o = given[f.name]
                v = p.v["v"] if o else p.v
                if isinstance(f.dataType, T.VariantType):
                    given_type = a.type.args[0] if o else a.type
                    fields.append(json_value(v, given_type).alias(f.name))
                    if json_can_fail(given_type):
                        wrong = v.isNotNull() & json_value(v, given_type).isNull()
                        failed = wrong if failed is None else failed | wrong
                else:
                    fields.append(v.cast(f.dataType).alias(f.name))
            else:
                fields.append((zero_of(f.dataType) if self._implicit(name) else F.lit(None).cast(f.dataType)).alias(f.name))
        return Lowered(unless(failed, F.struct(*fields)), bad=(lambda: failed) if failed is not None else None, sure=failed is None)

    def lower_enum(self, t: Typed) -> Lowered:
        a, members = self.lower(t.args[0]), t.value
        if t.args[0].type.kind == "string":
            table = F.create_map(*[x for k, v in members.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
            return Lowered(F.try_element_at(table, a.v), strict=True)
        return Lowered(F.when(a.v.between(-(1 << 31), (1 << 31) - 1), a.v), strict=True)

    # ---- calls

    def lower_call(self, t: Typed) -> Lowered:
        o, parts = t.value, [self.lower(a) for a in t.args]
        columns = [p.v if q.kind in ("param", "dyn") and q.kind == "param" else convert(p.v, a.type, q) for p, a, q in zip(parts, t.args, o.params, strict=True)]
        v = o.build(Context(self, t, parts), *columns)
        failed = any_failed(*parts)
        if o.observes:
            v = unless(failed, v)
        if o.total or t.type.kind == "optional":
            return Lowered(v, sure=failed is None, bad=(lambda: failed) if failed is not None else None)
        if isinstance(v, Lowered):
            return v
        return Lowered(v, strict=True)

    def lower_dynamic(self, t: Typed) -> Lowered:
        parts = [self.lower(a) for a in t.args]
        v = t.value(Context(self, t, parts), [a.type for a in t.args], [p.v for p in parts], [p.literal for p in parts])
        return Lowered(unless(any_failed(*parts), v), strict=True)

    def lower_any(self, t: Typed) -> Lowered:
        from ..sources.protobuf import decode_messages

        part = self.lower(t.args[0])
        return Lowered(decode_messages(part.v, t.value), bad=lambda: part.v.isNull())

    # ---- macros

    def lower_macro(self, t: Typed) -> Lowered:
        name, source = t.value["name"], self.lower(t.args[0])
        if name in ("optMap", "optFlatMap"):
            o = source.v
            inner = Lowered(o["v"], sure=True)
            self.locals.append({t.value["vars"][0]: inner})
            body = self.lower(t.args[1])
            self.locals.pop()
            failed, inside = any_failed(source), body.failed()
            v = F.when(o.isNotNull(), F.struct(body.v.alias("v")) if name == "optMap" else body.v)
            some = None if inside is None else o.isNotNull() & inside
            bad = some if failed is None else failed if some is None else failed | some
            return Lowered(unless(bad, v), sure=bad is None, bad=(lambda: bad) if bad is not None else None)
        return Lowered(self._loop(t, source), strict=True)

    def _loop(self, t: Typed, source: Lowered) -> Column:
        name, names, base = t.value["name"], t.value["vars"], t.args[0].type
        v = source.v
        if base.kind == "dyn":
            v = F.try_variant_get(v, "$", "array<variant>")
            base = Type("list", (DYN,))
        two, is_map = len(names) == 2, base.kind == "map"
        if is_map:
            items = F.map_entries(v)
            pick = (lambda e: [e["key"], e["value"]]) if two else (lambda e: [e["key"]])
        elif two or name == "transformMap":
            items = F.transform(v, lambda x, i: F.struct(i.cast("bigint").alias("key"), x.alias("value")))
            pick = lambda e: [e["key"], e["value"]]
        else:
            items, pick = v, lambda e: [e]

        def body(i: int):
            def go(e: Column) -> Lowered:
                kinds = (base.args if two else base.args[:1]) if is_map else ([Type("int"), base.args[0]] if two else [base.args[0]])
                scope = {n: Lowered(c, strict=is_null_error(k), sure=not is_null_error(k)) for n, c, k in zip(names, pick(e), kinds, strict=True)}
                self.locals.append(scope)
                out = self.lower(t.args[i])
                self.locals.pop()
                return out

            return go

        def test(i: int):
            go = body(i)
            dyn = t.args[i].type.kind == "dyn"
            return lambda e: from_variant(go(e).v, Type("bool")) if dyn else go(e).v

        if name == "all":
            return F.forall(items, test(1))
        if name == "exists":
            return F.exists(items, test(1))
        if name in ("exists_one", "filter"):
            p = test(1)
            bad, kept = F.exists(items, lambda e: p(e).isNull()), F.filter(items, p)
            if name == "exists_one":
                return F.when(~bad, F.size(kept) == 1)
            if is_map:
                kept = F.transform(kept, lambda e: e["key"])
            return F.when(~bad, kept)
        if name == "sortBy":
            key = body(1)
            keyed = F.transform(v, lambda x, i: F.struct(key(x).v.alias("k"), i.alias("i"), x.alias("x")))
            bad = F.exists(keyed, lambda e: e["k"].isNull() | (F.isnan(e["k"]) if bare(t.args[1].type).kind == "double" else F.lit(False)))
            return F.when(~bad, F.transform(F.array_sort(keyed), lambda e: e["x"]))
        first = 1
        bad = None
        if t.value.get("filtered"):
            p = test(1)
            bad, items, first = F.exists(items, lambda e: p(e).isNull()), F.filter(items, p), 2
        results = []
        for i in range(first, len(t.args)):
            results.append(body(i))

        if bad is None and len(results) == 1 and (name in ("map", "transformList") or is_map and name == "transformMap"):
            strict: list[bool] = []

            def value(e) -> Column:
                r = results[0](e)
                strict.append(r.strict or r.sure)
                return r.v

            # each body is worked out once where a NULL in the result tells an error
            if name == "transformMap":
                got, parts = F.transform_values(v, lambda k, x: value({"key": k, "value": x})), F.map_values
            else:
                got, parts = F.transform(items, value), lambda m: m
            if strict[-1]:
                return let(got, lambda m: F.when(~F.exists(parts(m), lambda x: x.isNull()), m))

        def failing(e: Column) -> Column:
            out = F.lit(False)
            for go in results:
                f = go(e).failed()
                out = out if f is None else out | f
            return out

        bad_item = F.exists(items, failing)
        bad = bad_item if bad is None else bad | bad_item
        if name in ("map", "transformList"):
            return F.when(~bad, F.transform(items, lambda e: results[0](e).v))
        if name == "transformMap":
            return map_from(F.when(~bad, F.transform(items, lambda e: F.struct(e["key"].alias("key"), results[0](e).v.alias("value")))))
        return map_from(F.when(~bad, F.transform(items, lambda e: F.struct(results[0](e).v.alias("key"), results[1](e).v.alias("value")))))


def _chain(t: Typed, op: str) -> list[Typed] | None:
    """The operands of a chain of one operator, if it is long."""
    out, todo = [], [t]
    while todo:
        x = todo.pop()
        if x.op == "binary" and x.value == op:
            todo += [x.args[1], x.args[0]]
        else:
            out.append(x)
    return out if len(out) > 8 else None


@dataclass
class Context:
    """What a builder may look at besides its columns."""

    lowerer: Lowerer
    node: Typed
    parts: list[Lowered]

    @property
    def types(self) -> list[Type]:
        return [a.type for a in self.node.args]

    def literal(self, i: int):
        return self.parts[i].literal


def map_from(entries: Column) -> Column:
    """A map of entries; NULL if a key occurs twice, as that is an error."""
    def once(es: Column) -> Column:
        keys = F.transform(es, lambda e: e["key"])
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), es))

    return let(entries, once)


def constant_keys(t: Typed) -> list | None:
    """The keys of a map literal if they are constants of one type, all different and none optional."""
    if t.op != "map" or any(t.value) or not t.args:
        return None
    keys = t.args[::2]
    kind = bare(t.type.args[0]).kind
    if kind not in ("string", "int", "bool") or any(k.op != "const" or k.type.kind != kind or k.value is None for k in keys):
        return None
    found = [k.value for k in keys]
    return found if len(set(found)) == len(found) else None


#: The other way round of a comparison.
_TURNED = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _widened(v: Column, s: T.DataType) -> Column:
    """Columns come in the widths that expressions use."""
    if isinstance(s, (T.ByteType, T.ShortType, T.IntegerType)):
        return v.cast("bigint")
    if isinstance(s, T.FloatType) or isinstance(s, T.DecimalType) and s != UINT_TYPE:
        return v.cast("double")
    if isinstance(s, (T.DateType, T.TimestampNTZType)):
        return v.cast("timestamp")
    if isinstance(s, T.ArrayType) and _narrow(s.elementType):
        return F.transform(v, lambda x: _widened(x, s.elementType))
    if isinstance(s, T.MapType) and _narrow(s.valueType):
        return F.transform_values(v, lambda k, x: _widened(x, s.valueType))
    return v


def _narrow(s: T.DataType) -> bool:
    if isinstance(s, T.ArrayType):
        return _narrow(s.elementType)
    return isinstance(s, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DateType, T.TimestampNTZType)) or isinstance(s, T.DecimalType) and s != UINT_TYPE


def zero_of(s: T.DataType) -> Column:
    if isinstance(s, T.ArrayType):
        return F.array().cast(s)
    if isinstance(s, T.MapType):
        return F.create_map().cast(s)
    if isinstance(s, T.StringType):
        return F.lit("")
    if isinstance(s, T.BinaryType):
        return F.lit(b"")
    if isinstance(s, T.BooleanType):
        return F.lit(False)
    if isinstance(s, T.NumericType):
        return F.lit(0).cast(s)
    return F.lit(None).cast(s)


def is_zero(v: Column, s: T.DataType) -> Column:
    if isinstance(s, (T.ArrayType, T.MapType)):
        return F.size(v) == 0
    if isinstance(s, (T.StringType, T.BinaryType, T.BooleanType, T.NumericType)):
        return v == zero_of(s)
    return v.isNull()
