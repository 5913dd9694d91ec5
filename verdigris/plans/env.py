"""Environments: the names, functions and types that a program may use."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

from .types import Type, parse_type, type_of


@dataclass(frozen=True)
class Overload:
    """One form of a function.  build takes a context and the arguments' columns and returns a column, NULL for an error."""

    name: str
    receiver: bool
    params: tuple[Type, ...]
    result: Type
    build: Callable = field(compare=False)
    #: build sees null arguments as values, so failed arguments must be kept from it.
    observes: bool = False
    #: The result is never an error.
    total: bool = False


@dataclass
class Library:
    """Named functions, constants and macros that are installed together; installing twice does nothing more."""

    name: str
    overloads: list[Overload] = field(default_factory=list)
    constants: dict[str, tuple[Type, object]] = field(default_factory=dict)
    macros: set[str] = field(default_factory=set)
    dynamic: dict = field(default_factory=dict)

    def add(self, signature: str, observes: bool = False, total: bool = False):
        """Decorator: register a builder under a signature such as `string.size() -> int` (receiver: `@string.size() -> int`)."""

        def register(build):
            self.overloads.append(overload(signature, build, observes, total))
            return build

        return register


def overload(signature: str, build: Callable, observes: bool = False, total: bool = False) -> Overload:
    m = re.fullmatch(r"(@)?([\w.]+|[^\s\w]+|@?[\w.()\s,]+?\.\w+)\((.*)\)\s*->\s*(.+)", signature.strip())
    if signature.startswith("@"):
        head, result = signature[1:].rsplit("->", 1)
        # the receiver's type may hold parentheses and dots of its own
        opening = _opening(head.strip())
        target, name = head.strip()[:opening].rsplit(".", 1)
        params = _split(head.strip()[opening + 1 : -1])
        return Overload(name, True, (parse_type(target), *map(parse_type, params)), parse_type(result), build, observes, total)
    if m is None:
        raise ValueError(f"bad signature {signature!r}")
    return Overload(m[2], False, tuple(map(parse_type, _split(m[3]))), parse_type(m[4]), build, observes, total)


def _opening(head: str) -> int:
    depth = 0
    for i in range(len(head) - 1, -1, -1):
        depth += (head[i] == ")") - (head[i] == "(")
        if not depth:
            return i
    raise ValueError(head)


def _split(text: str) -> list[str]:
    depth, out, start = 0, [], 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [x for x in [*out, text[start:]] if x.strip()]


class Env:
    """Variables, constants, functions, messages and enums; a child sees all of its parent.

    libraries: names out of verdigris.functions.LIBRARIES, or Library objects; the standard library is
    always there.  container: the namespace that names are looked up in first.
    """

    def __init__(self, variables: dict[str, Type | str] | None = None, libraries=(), container: str = "", parent: Env | None = None, strong_enums: bool = False):
        from ..functions import STANDARD, library

        self.parent, self.container = parent, container
        self.strong_enums = strong_enums or bool(parent and parent.strong_enums)
        self.variables: dict[str, Type] = {}
        self.columns: dict[str, Column] = {}
        self.constants: dict[str, tuple[Type, object]] = {}
        self.functions: dict[tuple[str, bool], list[Overload]] = {}
        self.dynamic: dict[tuple[str, bool], list[tuple[Callable, Callable]]] = {}
        self.messages: dict[str, T.StructType] = {}
        self.defaults: dict[str, bool] = {}
        self.enums: dict[str, dict[str, int]] = {}
        self.descriptors: dict = {}
        self.libraries: set[str] = set()
        self.macros: set[str] = set()
        for name, t in (variables or {}).items():
            self.variable(name, t)
        for lib in (*((STANDARD,) if parent is None else ()), *libraries):
            self.install(library(lib))

    @classmethod
    def from_schema(cls, schema: T.StructType, libraries=(), container: str = "", **more) -> Env:
        """One variable for each column."""
        env = cls({}, libraries, container, **more)
        for f in schema.fields:
            env.variables[f.name] = type_of(f.dataType, f.nullable, f.name, env.messages)
            env.columns[f.name] = (f.name, f.dataType)
        return env

    def variable(self, name: str, t: Type | str) -> Env:
        self.variables[name] = parse_type(t) if isinstance(t, str) else t
        return self

    def constant(self, name: str, t: Type | str, value) -> Env:
        self.constants[name] = (parse_type(t) if isinstance(t, str) else t, value)
        return self

    def function(self, signature: str, build: Callable, observes: bool = False) -> Env:
        """Add an overload; build(context, *columns) returns a column.  Operators are named by their sign, as in `+(Money, Money) -> Money`."""
        o = overload(signature, build, observes)
        if o.name in ("&&", "||"):
            raise ValueError("logic cannot be overloaded")
        self.functions.setdefault((o.name, o.receiver), []).append(o)
        return self

    def dynamic_function(self, name: str, receiver: bool, matcher: Callable, build: Callable, prepare: Callable | None = None) -> Env:
        """matcher(list of types) returns the result type or None; build(context, types, columns, literals) returns a column.

        prepare(literals) is called once for each different set of literal arguments (None for others);
        build gets what it returned in place of the literals.
        """
        if prepare is not None:
            once, plain = functools.cache(lambda literals: prepare(list(literals))), build

            def build(c, types, columns, literals):
                return plain(c, types, columns, once(tuple(literals)))

        self.dynamic.setdefault((name, receiver), []).append((matcher, build))
        return self

    def message(self, name: str, struct: T.StructType | str, explicit_presence: bool = True) -> Env:
        """A message type as a struct.  Without explicit presence a field that holds its default counts as not set."""
        self.messages[name] = T._parse_datatype_string(struct) if isinstance(struct, str) else struct
        self.defaults[name] = not explicit_presence
        return self

    def descriptor(self, d) -> Env:
        """A message type with the descriptor that decodes it (see verdigris.sources.protobuf)."""
        self.descriptors[d.name] = d
        return self.message(d.name, d.spark_type())

    def remove_type(self, name: str) -> Env:
        """Take a message or an enum, with its members, out of this environment."""
        if name not in self.messages and name not in self.enums:
            raise KeyError(name)
        for member in self.enums.pop(name, {}):
            self.constants.pop(f"{name}.{member}", None)
        for held in (self.messages, self.defaults, self.descriptors):
            held.pop(name, None)
        return self

    def find_descriptor(self, name: str):
        return self._find("descriptors", name)

    def enum(self, name: str, members: dict[str, int]) -> Env:
        self.enums[name] = dict(members)
        t = Type("message", (), name) if self.strong_enums else Type("int")
        for member, number in members.items():
            self.constants[f"{name}.{member}"] = (Type("int") if not self.strong_enums else t, number)
        return self

    def install(self, lib: Library) -> Env:
        if not self.has_library(lib.name):
            self.libraries.add(lib.name)
            for o in lib.overloads:
                self.functions.setdefault((o.name, o.receiver), []).append(o)
            self.constants |= lib.constants
            self.macros |= lib.macros
            for k, found in lib.dynamic.items():
                self.dynamic.setdefault(k, []).extend(found)
        return self

    def child(self, variables=None, libraries=(), container: str | None = None) -> Env:
        return Env(variables, libraries, self.container if container is None else container, self)

    # ---- lookup

    def chain(self):
        env: Env | None = self
        while env is not None:
            yield env
            env = env.parent

    def has_library(self, name: str) -> bool:
        return any(name in e.libraries for e in self.chain())

    def has_macro(self, name: str) -> bool:
        return any(name in e.macros for e in self.chain())

    def candidates(self, name: str) -> list[str]:
        """The names that `name` may stand for, innermost namespace first."""
        if name.startswith("."):
            return [name[1:]]
        parts = self.container.split(".") if self.container else []
        return [".".join([*parts[:i], name]) for i in range(len(parts), -1, -1)]

    def _find(self, what: str, name: str):
        for full in self.candidates(name):
            for e in self.chain():
                if full in getattr(e, what):
                    return full, getattr(e, what)[full]
        return None

    def find_variable(self, name: str):
        return self._find("variables", name)

    def find_constant(self, name: str):
        return self._find("constants", name)

    def find_message(self, name: str):
        return self._find("messages", name)

    def find_enum(self, name: str):
        return self._find("enums", name)

    def overloads(self, name: str, receiver: bool) -> list[Overload]:
        names = [name] if receiver else self.candidates(name)
        return [o for n in names for e in self.chain() for o in e.functions.get((n, receiver), [])]

    def dynamics(self, name: str, receiver: bool):
        names = [name] if receiver else self.candidates(name)
        return [d for n in names for e in self.chain() for d in e.dynamic.get((n, receiver), [])]

    def all_messages(self) -> dict[str, T.StructType]:
        out: dict[str, T.StructType] = {}
        for e in reversed(list(self.chain())):
            out |= e.messages
        return out

    def column_of(self, name: str):
        for e in self.chain():
            if name in e.columns:
                return e.columns[name]
        return (name, None)

    # ---- programs

    def compile(self, text: str, checked: bool = True, optimize: bool = True):
        """A Program; raises ProgramError."""
        from .program import Program

        return Program(self, text, checked=checked, optimize=optimize)

    def partial(self, text: str, known: dict[str, object], unknown=()):
        """The rest of a program after putting in known values, but for unknown attributes: (value or None, residual text)."""
        from .partial import partial_evaluate

        return partial_evaluate(self, text, known, unknown)
