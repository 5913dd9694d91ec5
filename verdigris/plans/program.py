"""Compiled programs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import syntax as S
from .check import Checker, Typed
from .env import Env
from .types import Type, spark_type

DEPTH_MOST, NODES_MOST = 4, 10_000
#: Costs of the kinds of nodes, and turns of a loop at most; fixed values.
COST_LIST, COST_MAP, COST_MESSAGE, COST_CALL, COST_MATCHES, LOOP_MOST = 10, 30, 40, 10, 30, 1000


@dataclass(frozen=True)
class Cost:
    least: int
    most: int

    def __add__(self, other: Cost | int) -> Cost:
        o = Cost(other, other) if isinstance(other, int) else other
        return Cost(self.least + o.least, self.most + o.most)


@dataclass(frozen=True)
class Issue:
    """What a validator has found."""

    code: str
    message: str
    at: int


class BudgetExceeded(ValueError):
    """A program whose least cost is over the budget."""


class Program:
    """A program over an environment.  checked=False: what does not check fails only when it runs."""

    def __init__(self, env: Env, text: str, checked: bool = True, optimize: bool = True):
        from .fold import fold

        self.env, self.text = env, text
        self.tree = S.parse(text)
        self.typed: Typed = Checker(env, text, lenient=not checked).check(self.tree)
        if optimize:
            folded = fold(self.tree, env)
            if folded is not self.tree:
                again = Checker(env, text, lenient=not checked).check(folded)
                # folding may make a type narrower; what was declared stays
                if again.type == self.typed.type:
                    self.typed, self.folded = again, folded
                    return
        self.folded = self.tree

    @property
    def type(self) -> Type:
        return self.typed.type

    def output_type(self) -> str:
        return str(self.type)

    def unparse(self) -> str:
        return S.unparse(self.tree)

    # ---- columns

    def column(self, columns: dict[str, Column] | None = None, hooks=()) -> Column:
        """The value; NULL where the program fails.

        hooks: functions of a node's text, its type and its column that return another column for it, or None.
        """
        from ..operators.lower import Lowerer

        lowerer = Lowerer(self.env, columns)
        lowerer.hooks = list(hooks)
        return lowerer.lower(self.typed).v

    def failed(self, columns: dict[str, Column] | None = None) -> Column:
        """Whether the program fails on a row."""
        from ..operators.lower import Lowerer

        f = Lowerer(self.env, columns).lower(self.typed).failed()
        return F.lit(False) if f is None else f

    def filter(self, df: DataFrame, budget: int | None = None) -> DataFrame:
        """Rows where the program is true; those where it fails go."""
        self.within(budget)
        v = self.column()
        if self.type.kind == "dyn":
            from ..operators.lower import from_variant

            v = from_variant(v, Type("bool"))
        return df.filter(v)

    def select(self, df: DataFrame, name: str, budget: int | None = None) -> DataFrame:
        """df with the value as one more column."""
        self.within(budget)
        return df.withColumn(name, self.column())

    def tracked(self, df: DataFrame, value: str = "value", failed: str = "failed", trace: str | None = None) -> DataFrame:
        """df with the value and whether it failed; trace: also a struct with the text of every node's value."""
        from ..operators.lower import Lowerer
        from .types import bare

        lowerer = Lowerer(self.env)
        lowerer.trace = []
        out = lowerer.lower(self.typed)
        f = out.failed()
        got = df.withColumns({value: out.v, failed: F.lit(False) if f is None else f})
        if trace:
            nodes, seen = [], set()
            for t, low in lowerer.trace:
                text = S.unparse(t.source) if t.source is not None else t.op
                if text not in seen and bare(t.type).kind in ("bool", "int", "uint", "double", "string", "timestamp"):
                    seen.add(text)
                    nodes.append(low.v.cast("string").alias(text))
            got = got.withColumn(trace, F.struct(*nodes))
        return got

    def exhaustive(self, df: DataFrame, value: str = "value", failed: str = "failed", nodes: str = "nodes") -> DataFrame:
        """Like tracked, with every node outside loops worked out: branches not taken and operands that logic skips among them."""
        return Program(self.env, self.text, optimize=False).tracked(df, value, failed, nodes)

    def observed(self, df: DataFrame, observation) -> DataFrame:
        """df, whose next action fills a pyspark Observation with rows, failed and, for bool, true."""
        counts = [F.count(F.lit(1)).alias("rows"), F.count_if(self.failed()).alias("failed")]
        if self.type.kind == "bool":
            counts.append(F.count_if(self.column()).alias("true"))
        return df.observe(observation, *counts)

    def strict(self, df: DataFrame, name: str) -> DataFrame:
        """df with the value; the query fails if the program does on any row."""
        return df.withColumn(name, F.when(self.failed(), F.raise_error(F.lit(f"program failed: {self.text}")).cast(spark_type(self.type, self.env.all_messages()))).otherwise(self.column()))

    # ---- estimates and checks

    def within(self, budget: int | None) -> None:
        if budget is not None and self.cost().least > budget:
            raise BudgetExceeded(f"{self.cost().least} is over the budget of {budget}")

    def cost(self) -> Cost:
        return cost_of(self.tree)

    def nodes(self) -> int:
        return sum(1 for _ in S.walk(self.tree))

    def validate(self, depth: int = DEPTH_MOST, nodes: int = NODES_MOST, times: bool = False) -> list[Issue]:
        """Issues: nested loops, size, patterns that do not compile, and (times) bad literals of times."""
        from ..functions.patterns import BadPattern, transpile
        from ..functions.standard import RFC3339, parse_duration

        out: list[Issue] = []

        def deep(n: S.Node, level: int) -> None:
            if _loop(n):
                level += 1
                if level > depth:
                    out.append(Issue("ComprehensionDepth", f"loops are nested {level} deep; the limit is {depth}", n.at))
                    return
            for c in n.children():
                deep(c, level)

        deep(self.tree, 0)
        if (n := self.nodes()) > nodes:
            out.append(Issue("NodeLimit", f"{n} nodes; the limit is {nodes}", 0))
        for n in S.walk(self.tree):
            if not isinstance(n, S.Call):
                continue
            texts = [a.value if isinstance(a, S.Literal) and a.kind == "string" else None for a in n.args]
            pattern = texts[0] if n.function in ("matches", "find", "findAll") and n.target is not None and texts else texts[1] if n.function in ("extract", "extractAll", "replaceN") and len(texts) > 1 else None
            if pattern is not None:
                try:
                    transpile(pattern)
                except BadPattern as e:
                    out.append(Issue("InvalidRegex", str(e), n.at))
            if times and n.target is None and texts and texts[0] is not None:
                import re

                if n.function == "duration" and parse_duration(texts[0]) is None:
                    out.append(Issue("InvalidDuration", texts[0], n.at))
                if n.function == "timestamp" and not re.match(RFC3339, texts[0]):
                    out.append(Issue("InvalidTimestamp", texts[0], n.at))
        return out


def _loop(n: S.Node) -> bool:
    from .fold import bound_names

    return isinstance(n, S.Call) and bool(bound_names(n)) and n.function != "bind"


def cost_of(n: S.Node) -> Cost:
    """Least and most cost of a tree."""
    kids = [cost_of(c) for c in n.children()] if not isinstance(n, S.Call) else []
    total = sum(kids, Cost(0, 0))
    match n:
        case S.Literal():
            return total
        case S.Conditional():
            c, a, b = kids
            return c + Cost(max(a.least, b.least), max(a.most, b.most)) + 1
        case S.ListOf():
            return total + COST_LIST
        case S.MapOf():
            return total + COST_MAP
        case S.Message():
            return total + COST_MESSAGE
        case S.Call():
            space = S.dotted(n.target) if n.target else None
            if n.target is None and n.function == "has" and len(n.args) == 1:
                return Cost(1, 1)
            if space == "cel" and n.function == "bind" and len(n.args) == 3:
                return cost_of(n.args[1]) + cost_of(n.args[2]) + 1
            if space == "cel" and n.function == "block":
                return sum(map(cost_of, n.args), Cost(0, 0)) + 1
            if _loop(n):
                target, body = cost_of(n.target), cost_of(n.args[-1])
                if n.function in ("optMap", "optFlatMap"):
                    return target + body + 1
                return Cost(1 + target.least + body.least, 1 + target.most + LOOP_MOST * body.most)
            out = sum(map(cost_of, n.args), Cost(0, 0))
            if n.target is not None:
                out = out + cost_of(n.target)
            return out + (COST_MATCHES if n.target is not None and n.function == "matches" else COST_CALL)
    return total + 1
