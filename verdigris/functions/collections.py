"""Lists, sets and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lower import Lowered, convert, equal, from_variant, let, literal, to_variant, variant_number
from ..plans.env import Library
from ..plans.types import DYN, Type, bare, spark_type
from .standard import interval, micros, wrapped

LISTS = Library("lists", macros={"sortBy"})
SETS = Library("sets")
MAPS = Library("maps")
COMPREHENSIONS = Library("comprehensions", macros={"transformList", "transformMap", "transformMapEntry"})
add = LISTS.add


def _element(c, i: int = 0) -> Type:
    t = c.types[i]
    return bare(t.args[0]) if t.args else DYN


def _same(c, i: int = 0):
    """Equality of an element of list i with a column."""
    t = _element(c, i)
    return lambda a, b, u=None: F.coalesce(equal(Lowered(a, sure=True), t, Lowered(b, sure=True), u or t), F.lit(False))


def _clean(c, xs):
    """The list if its elements can be ordered: no errors and no NaN."""
    bad = F.exists(xs, lambda x: x.isNull())
    if _element(c).kind == "double":
        bad = bad | F.exists(xs, lambda x: F.isnan(x))
    return F.when(~bad, xs)


def _n(xs):
    return F.size(xs).cast("bigint")


def _variant_keys(xs):
    """What variants are ordered by: numbers, else texts; NULL if there are others or both."""
    keys = F.transform(xs, lambda x, i: F.struct(variant_number(x).alias("n"), from_variant(x, Type("string")).alias("s"), i.alias("i")))
    numbers, texts = F.forall(keys, lambda k: k["n"].isNotNull() & ~F.isnan(k["n"])), F.forall(keys, lambda k: k["s"].isNotNull())
    return F.when(numbers | texts, keys)


def _sorted(c, xs):
    if _element(c).kind == "dyn":
        return F.transform(F.array_sort(_variant_keys(xs)), lambda k: F.get(xs, k["i"]))
    return F.array_sort(_clean(c, xs))


add("@list(A).sort() -> list(A)")(_sorted)


def _flat(xs, t: Type, depth: int):
    if depth <= 0 or t.kind != "list":
        return xs, t
    inner = t.args[0]
    if inner.kind != "list":
        return xs, t
    return _flat(F.flatten(xs), inner, depth - 1)


def _flatten(c, xs, depth: int):
    if depth < 0:
        return F.lit(None).cast("array<variant>")
    out, t = _flat(xs, c.types[0], depth)
    return convert(out, t, c.node.type) if t != c.node.type else out


add("@list(A).flatten() -> list(dyn)")(lambda c, xs: _flatten(c, xs, 1))
add("@list(A).flatten(int) -> list(dyn)")(lambda c, xs, n: _flatten(c, xs, c.literal(1) if isinstance(c.literal(1), int) else 1))
add("@list(A).slice(int, int) -> list(A)")(lambda c, xs, a, b: F.when((a >= 0) & (a <= b) & (b <= _n(xs)), F.slice(xs, (F.when(a >= 0, a) + 1).cast("int"), F.when(b >= a, b - a).cast("int"))))


@add("@list(A).distinct() -> list(A)")
def _(c, xs):
    t = _element(c)
    if t.kind in ("int", "uint", "string", "bool", "bytes", "timestamp"):
        return F.array_distinct(xs)
    same = _same(c)
    return F.aggregate(xs, F.slice(xs, F.lit(1), F.lit(0)), lambda a, x: F.when(F.exists(a, lambda y: same(y, x)), a).otherwise(F.concat(a, F.array(x))))


add("@list(A).reverse() -> list(A)")(lambda c, xs: F.reverse(xs))
add("@list(A).first() -> optional_type(A)", observes=True)(lambda c, xs: F.when(F.size(xs) > 0, wrapped(F.get(xs, 0))))
add("@list(A).last() -> optional_type(A)", observes=True)(lambda c, xs: F.when(F.size(xs) > 0, wrapped(F.element_at(F.when(F.size(xs) > 0, xs), -1))))


@add("@list(A).isSorted() -> bool")
def _(c, xs):
    good = F.transform(_variant_keys(xs), lambda k: F.struct(k["n"], k["s"])) if _element(c).kind == "dyn" else _clean(c, xs)
    pairs = F.zip_with(good, F.slice(good, F.lit(2), F.greatest(F.size(good) - 1, F.lit(0))), lambda a, b: b.isNull() | (a <= b))
    return F.forall(pairs, lambda x: x)


@add("@list(A).sum() -> A")
def _(c, xs):
    t = _element(c)
    if t.kind == "duration":
        return interval(F.aggregate(F.transform(xs, micros), F.lit(0).cast("bigint"), lambda a, x: F.try_add(a, x)))
    zero = {"double": F.lit(0.0), "uint": literal(0, Type("uint"))}.get(t.kind, F.lit(0).cast("bigint"))
    from ..operators.lower import arithmetic

    if t.kind in ("dyn", "param"):
        return to_variant(F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: F.try_add(a, F.try_variant_get(x, "$", "bigint"))), Type("int"))
    return F.aggregate(xs, zero, lambda a, x: arithmetic("+", a, t, x, t, t))


add("@list(A).min() -> A")(lambda c, xs: F.when(F.size(xs) > 0, F.get(_sorted(c, xs), 0) if _element(c).kind == "dyn" else F.array_min(_clean(c, xs))))
add("@list(A).max() -> A")(lambda c, xs: F.when(F.size(xs) > 0, F.get(F.reverse(_sorted(c, xs)), 0) if _element(c).kind == "dyn" else F.array_max(_clean(c, xs))))


def _first_at(flags):
    return (F.array_position(flags, True) - 1).cast("bigint")


@add("@list(A).indexOf(B) -> int", observes=True)
def _(c, xs, x):
    same = _same(c)
    return _first_at(F.transform(xs, lambda y: same(y, x, bare(c.types[1]))))


@add("@list(A).lastIndexOf(B) -> int", observes=True)
def _(c, xs, x):
    same = _same(c)
    at = _first_at(F.reverse(F.transform(xs, lambda y: same(y, x, bare(c.types[1])))))
    return F.when(at < 0, at).otherwise(_n(xs) - 1 - at)


add("lists.setAtIndex(list(A), int, A) -> list(A)", observes=True)(lambda c, xs, i, x: F.when((i >= 0) & (i < _n(xs)), F.transform(xs, lambda e, j: F.when(j == i, x).otherwise(e))))
add("lists.insertAtIndex(list(A), int, A) -> list(A)", observes=True)(lambda c, xs, i, x: F.when((i >= 0) & (i <= _n(xs)), F.concat(F.slice(xs, F.lit(1), F.when(i >= 0, i).cast("int")), F.array(x), F.slice(xs, (F.when(i >= 0, i) + 1).cast("int"), F.size(xs)))))
add("lists.removeAtIndex(list(A), int) -> list(A)")(lambda c, xs, i: F.when((i >= 0) & (i < _n(xs)), F.filter(xs, lambda e, j: j != i)))


@add("@list(A).zip(list(B)) -> list(list(dyn))")
def _(c, a, b):
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.array(to_variant(x, _element(c, 0)), to_variant(y, _element(c, 1))))


for _name in ("lists.range", "list.range"):
    add(f"{_name}(int) -> list(int)")(lambda c, n: F.when(n == 0, F.array().cast("array<bigint>")).when(n > 0, F.sequence(F.lit(0).cast("bigint"), F.when(n > 0, n - 1))))


def _covered(c, a, b, i: int, j: int):
    """Whether every element of b is in a."""
    t, u = _element(c, i), _element(c, j)
    if t == u and t.kind in ("int", "uint", "string", "bool", "bytes", "timestamp"):
        return F.size(F.array_except(b, a)) == 0
    return F.forall(b, lambda y: F.exists(a, lambda x: F.coalesce(equal(Lowered(x, sure=True), t, Lowered(y, sure=True), u), F.lit(False))))


def _set(name: str):
    # the members may have different types
    return SETS.add(f"sets.{name}(list(A), list(B)) -> bool", observes=True)


_set("contains")(lambda c, a, b: _covered(c, a, b, 0, 1))
_set("equivalent")(lambda c, a, b: _covered(c, a, b, 0, 1) & _covered(c, b, a, 1, 0))


@_set("intersects")
def _(c, a, b):
    t, u = _element(c, 0), _element(c, 1)
    if t == u and t.kind in ("int", "uint", "string", "bool", "bytes", "timestamp"):
        return F.size(F.array_intersect(a, b)) > 0
    return F.exists(a, lambda x: F.exists(b, lambda y: F.coalesce(equal(Lowered(x, sure=True), t, Lowered(y, sure=True), u), F.lit(False))))


@MAPS.add("@map(A, B).merge(map(A, B)) -> map(A, B)")
def _(c, a, b):
    kind = spark_type(c.node.type, c.lowerer.env.all_messages())
    a, b = a.cast(kind) if c.types[0].args[0].kind in ("dyn", "param") else a, b
    return let(F.struct(a.alias("a"), b.alias("b")), lambda both: F.when(both["a"].isNotNull() & both["b"].isNotNull(), _merged(both["a"], both["b"])))


def _merged(a, b):
    """The left map's order, the right map's values."""
    kept = F.transform_values(a, lambda k, v: F.when(F.map_contains_key(b, k), F.try_element_at(b, k)).otherwise(v))
    return F.map_concat(kept, F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))
