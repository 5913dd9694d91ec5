"""Partial evaluation: put in what is known and give back the rest as text."""

from __future__ import annotations

from . import syntax as S
from .env import Env
from .fold import Known, constant, simplify
from .model import Evaluator


def partial_evaluate(env: Env, text: str, known: dict[str, object], unknown=()) -> tuple[object, str]:
    """(value, residual text) of a program; value is None unless everything is known.

    unknown: patterns of attributes that are not known though their name is, as `m.a`, `m.*` or
    ("m", "a", 0); what they match, and what holds something they match, stays in the text.
    """
    node = S.parse(text)
    from .check import Checker

    Checker(env, text).check(node)
    rest = simplify(node, Known(known, unknown), env)
    return (Evaluator().run(rest) if constant(rest) else None), S.unparse(rest)
