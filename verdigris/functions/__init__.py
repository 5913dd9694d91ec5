"""Function libraries.  Each registers signatures with builders of Spark columns; NULL is an error."""

from __future__ import annotations

from ..plans.env import Library
from . import collections as _collections
from . import formats as _formats
from . import network as _network
from . import numbers as _numbers
from . import patterns as _patterns
from . import standard as _standard
from . import text as _text
from . import values as _values

STANDARD = "standard"
LIBRARIES: dict[str, Library] = {
    STANDARD: _standard.STANDARD,
    "strings": _text.STRINGS,
    "math": _numbers.MATH,
    "lists": _collections.LISTS,
    "sets": _collections.SETS,
    "maps": _collections.MAPS,
    "comprehensions": _collections.COMPREHENSIONS,
    "regex": _patterns.REGEX,
    "json": _values.JSON,
    "hash": _values.HASH,
    "jsonpatch": _values.JSONPATCH,
    "protos": _values.PROTOS,
    "format": _formats.FORMAT_LIBRARY,
    "semver": _formats.SEMVER_LIBRARY,
    "urls": _formats.URLS,
    "network": _network.NETWORK,
}
ALL = tuple(k for k in LIBRARIES if k != STANDARD)


def library(which: str | Library) -> Library:
    if isinstance(which, Library):
        return which
    if which not in LIBRARIES:
        raise ValueError(f"unknown library {which!r}")
    return LIBRARIES[which]
