"""Regular expressions of a small dialect: literals, `.`, groups, `|`, `* + ?` and counts; a backslash
takes the next character as it is.  A match is the longest at its leftmost start."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.env import Library

REGEX = Library("regex")
add = REGEX.add
_COUNT = re.compile(r"\{(\d+)(,(\d*))?\}")


class BadPattern(ValueError):
    """A pattern outside the dialect."""


@lru_cache(1024)
def transpile(pattern: str) -> str:
    """The pattern for Java and Python: what the dialect does not know is literal."""
    out, depth, i, atom = [], 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise BadPattern("nothing after the backslash")
            i += 1
            out.append(_quoted(pattern[i]))
            atom = True
        elif c == "(":
            depth += 1
            out.append("(?:")
            atom = False
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise BadPattern("unbalanced )")
            out.append(")")
            atom = True
        elif c == "|":
            out.append("|")
            atom = False
        elif c in "*+?":
            if not atom:
                raise BadPattern("nothing to repeat")
            out.append(c)
            atom = False
        elif c == "{" and (m := _COUNT.match(pattern, i)):
            if not atom or (m[3] and int(m[3]) < int(m[1])):
                raise BadPattern("bad count")
            out.append(m.group())
            i = m.end() - 1
            atom = False
        elif c == ".":
            out.append(".")
            atom = True
        else:
            out.append(_quoted(c))
            atom = True
        i += 1
    if depth:
        raise BadPattern("unbalanced (")
    return "".join(out)


def _quoted(c: str) -> str:
    return "\\" + c if not c.isalnum() and c.isascii() and not c.isspace() and c != "_" else c


def plain(pattern: str) -> bool:
    """Whether the first match of a backtracking engine is the longest, as nothing can be taken in two ways."""
    return not re.search(r"(?<!\\)[|?*+{]", pattern)


def compiled(pattern: str):
    import regex

    return regex.compile(transpile(pattern), regex.POSIX | regex.DOTALL)


def matches(c, s, p, i: int):
    pattern = c.literal(i)
    if isinstance(pattern, str):
        try:
            return F.rlike(s, F.lit("(?s)" + transpile(pattern)))
        except BadPattern:
            return F.lit(None).cast("boolean")
    return _udf(lambda t, q: bool(compiled(q).search(t)), T.BooleanType())(s, p)


def _udf(f, kind):
    """An Arrow function of rows; NULL in, or a bad pattern, is NULL out."""

    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            try:
                out.append(None if any(x is None or x != x for x in row if not isinstance(x, (list, tuple))) else f(*row))
            except (ValueError, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    def apply(*columns):
        n = len(columns)
        # pandas functions are typed by their number of arguments
        if n == 2:
            def two(a: pd.Series, b: pd.Series) -> pd.Series:
                return run(a, b)
            return F.pandas_udf(two, kind)(*columns)
        if n == 3:
            def three(a: pd.Series, b: pd.Series, d: pd.Series) -> pd.Series:
                return run(a, b, d)
            return F.pandas_udf(three, kind)(*columns)

        def four(a: pd.Series, b: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
            return run(a, b, d, e)

        return F.pandas_udf(four, kind)(*columns)

    return apply


def _find_all(s, p, c, i):
    pattern = c.literal(i)
    if isinstance(pattern, str) and plain(pattern):
        try:
            return F.regexp_extract_all(s, F.lit("(?s)" + transpile(pattern)), F.lit(0)) if pattern else F.when(s.isNotNull(), F.array_repeat(F.lit(""), F.length(s) + 1))
        except BadPattern:
            return F.lit(None).cast("array<string>")
    return _udf(lambda t, q: [m.group() for m in compiled(q).finditer(t)], T.ArrayType(T.StringType()))(s, p)


def _first(s, p, c, i):
    return F.get(_find_all(s, p, c, i), 0)


add("@string.find(string) -> string")(lambda c, s, p: F.when(_find_all(s, p, c, 1).isNotNull(), F.coalesce(_first(s, p, c, 1), F.lit(""))))
add("@string.findAll(string) -> list(string)")(lambda c, s, p: _find_all(s, p, c, 1))
add("@string.findAll(string, int) -> list(string)")(lambda c, s, p, n: F.when(n < 0, _find_all(s, p, c, 1)).otherwise(F.slice(_find_all(s, p, c, 1), F.lit(1), n.cast("int"))))
add("regex.extract(string, string) -> string")(lambda c, s, p: _first(s, p, c, 1))
add("regex.extractAll(string, string) -> list(string)")(lambda c, s, p: _find_all(s, p, c, 1))


def _replace(t: str, q: str, r: str, n: int) -> str | None:
    if n < 0:
        return None
    return compiled(q).sub(lambda m: r, t, count=n) if n else t


@add("regex.replace(string, string, string) -> string")
def _(c, s, p, r):
    pattern = c.literal(1)
    if isinstance(pattern, str) and pattern and plain(pattern):
        try:
            java = F.lit("(?s)" + transpile(pattern))
        except BadPattern:
            return F.lit(None).cast("string")
        at, found = F.regexp_instr(s, java), F.regexp_substr(s, java)
        return F.when(at == 0, s).when(r.isNotNull(), F.concat(F.substring(s, F.lit(1), at - 1), r, F.substring(s, at + F.length(found), F.length(s))))
    return _udf(lambda t, q, r: _replace(t, q, r, 1), T.StringType())(s, p, r)


add("regex.replaceN(string, string, string, int) -> string")(lambda c, s, p, r, n: _udf(_replace, T.StringType())(s, p, r, n))
