"""Mathematics."""

from __future__ import annotations

import decimal

from pyspark.sql import functions as F

from ..operators.lower import INT_MIN, variant_number
from ..plans.env import Library
from ..plans.types import UINT_TYPE

MATH = Library("math")
add = MATH.add


def _extreme(name: str, pick_many, pick_list) -> None:
    for kind in ("int", "uint", "double"):
        # NaN sorts as equal to anything in this language: the first operand stands
        def many(c, *xs, kind=kind):
            if kind == "double":
                out = xs[0]
                for x in xs[1:]:
                    out = F.when((x > out) & ~F.isnan(x) if name == "greatest" else (x < out) & ~F.isnan(out), x).when(x.isNotNull(), out)
                return out
            failed = None
            for x in xs:
                failed = x.isNull() if failed is None else failed | x.isNull()
            return xs[0] if len(xs) == 1 else F.when(~failed, pick_many(*xs))

        for n in range(1, 6):
            add(f"math.{name}({', '.join([kind] * n)}) -> {kind}")(many)

        def listed(c, xs, kind=kind):
            if kind == "double":
                keep = (lambda a, x: (x > a) & ~F.isnan(x)) if name == "greatest" else (lambda a, x: (x < a) & ~F.isnan(a))
                return F.when(F.size(xs) > 0, F.aggregate(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), F.get(xs, 0), lambda a, x: F.when(keep(a, x), x).otherwise(a)))
            return F.when(F.size(xs) > 0, pick_list(xs))

        add(f"math.{name}(list({kind})) -> {kind}")(listed)

    def mixed(c, *xs):
        """Operands of several numeric types: they are compared as doubles and the winner keeps its type."""
        nums = [variant_number(x) for x in xs]
        out, best = xs[0], nums[0]
        for x, n in zip(xs[1:], nums[1:], strict=True):
            wins = n > best if name == "greatest" else n < best
            out, best = F.when(wins, x).when(n.isNotNull(), out), F.when(wins, n).when(n.isNotNull(), best)
        return out

    for n in range(2, 6):
        add(f"math.{name}({', '.join(['dyn'] * n)}) -> dyn")(mixed)


_extreme("greatest", F.greatest, F.array_max)
_extreme("least", F.least, F.array_min)


def _rounded(f):
    # beyond 2**52 every double is whole, and bigint would not hold it
    return lambda c, x: F.when(F.isnan(x) | (F.abs(x) >= float(1 << 52)), x).when(x.isNotNull(), f(x).cast("double"))


add("math.ceil(double) -> double")(_rounded(F.ceil))
add("math.floor(double) -> double")(_rounded(F.floor))
add("math.round(double) -> double")(_rounded(lambda x: F.floor(F.abs(x) + 0.5) * F.when(x < 0, -1).otherwise(1)))
add("math.trunc(double) -> double")(_rounded(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))))
for _kind in ("double", "int", "uint"):
    add(f"math.sqrt({_kind}) -> double")(lambda c, x: F.sqrt(x.cast("double")))
add("math.abs(int) -> int")(lambda c, x: F.when(x != F.lit(INT_MIN), F.abs(F.when(x != F.lit(INT_MIN), x))))
add("math.abs(uint) -> uint")(lambda c, x: x)
add("math.abs(double) -> double")(lambda c, x: F.abs(x))
add("math.sign(int) -> int")(lambda c, x: F.signum(x).cast("bigint"))
add("math.sign(uint) -> uint")(lambda c, x: F.signum(x).cast(UINT_TYPE))
add("math.sign(double) -> double")(lambda c, x: F.when(F.isnan(x), 0.0).otherwise(F.signum(x)))
add("math.isNaN(double) -> bool")(lambda c, x: F.when(x.isNotNull(), F.isnan(x)))
_INF = float("inf")
add("math.isInf(double) -> bool")(lambda c, x: (x == _INF) | (x == -_INF))
add("math.isFinite(double) -> bool")(lambda c, x: ~F.isnan(x) & (x != _INF) & (x != -_INF))


# ---- bits; unsigned integers go through the bigint of the same bits


def signed(x):
    return F.when(x > F.lit((1 << 63) - 1), (x - F.lit(decimal.Decimal(1 << 64))).cast("bigint")).otherwise(F.when(x <= F.lit((1 << 63) - 1), x).cast("bigint"))


def unsigned(x):
    return F.when(x < 0, x.cast("decimal(20,0)") + F.lit(decimal.Decimal(1 << 64))).otherwise(x.cast("decimal(20,0)")).cast(UINT_TYPE)


def _bits(name: str, f) -> None:
    add(f"math.{name}(int, int) -> int")(lambda c, a, b: f(a, b))
    add(f"math.{name}(uint, uint) -> uint")(lambda c, a, b: unsigned(f(signed(a), signed(b))))


_bits("bitAnd", lambda a, b: a.bitwiseAND(b))
_bits("bitOr", lambda a, b: a.bitwiseOR(b))
_bits("bitXor", lambda a, b: a.bitwiseXOR(b))
add("math.bitNot(int) -> int")(lambda c, a: F.bitwise_not(a))
add("math.bitNot(uint) -> uint")(lambda c, a: unsigned(F.bitwise_not(signed(a))))


def _shift(name: str, f: str) -> None:
    def go(a, n):
        return F.when(n >= 64, F.when(a.isNotNull(), F.lit(0).cast("bigint"))).when(n >= 0, F.call_function(f, a, n.cast("int")))

    add(f"math.{name}(int, int) -> int")(lambda c, a, n: go(a, n))
    add(f"math.{name}(uint, int) -> uint")(lambda c, a, n: unsigned(go(signed(a), n)))


_shift("bitShiftLeft", "shiftleft")
_shift("bitShiftRight", "shiftrightunsigned")
