"""License scans: fuzzy search of short notices.

A notice allowed k edits is cut into k + 1 pieces; a text within k edits of it must hold one of the
pieces unchanged, so an Aho-Corasick pass over all pieces finds every candidate place, and the regex
library's bounded-error matching decides each and reports its span and edits.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame

from .common import bound_batches, take_worker

#: Phrases whose exact places are counted, with their labels; searched with edits like notices too; fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Short notices with their labels, in the words of the normalised text; fixed values.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the apache license", "apache"),
    ("under the terms of the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu general public license", "gpl"),
    ("apache license version 2 0", "apache"),
    ("permission is hereby granted free of charge", "mit"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc"),
    ("free and unencumbered software", "unlicense"),
    ("licensed under cc by 4 0", "cc"),
    ("licensed under cc by nc", "cc"),
    ("licensed under cc by nd", "cc"),
    ("licensed under cc by sa", "cc"),
    ("under cc by", "cc"),
    ("cc by 4 0", "cc"),
    ("cc by 3 0", "cc"),
    ("cc by 2 5", "cc"),
    ("cc by 2 0", "cc"),
    ("cc by 1 0", "cc"),
    ("cc by nc 4 0", "cc"),
    ("cc by nc", "cc"),
    ("cc by nd", "cc"),
    ("cc by sa", "cc"),
)
#: One edit for every so many characters of a notice; shorter ones must stand unchanged.
CHARS_PER_EDIT = 10

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,edits:int>>"


def normalised(text: str | None) -> tuple[str, int]:
    """(words of the text joined by single spaces, their number)."""
    words = _WORD.findall((text or "").encode().lower())
    return b" ".join(words).decode(errors="replace"), len(words)


@functools.lru_cache(4)
def _searcher(notices: tuple[tuple[str, str], ...], chars_per_edit: int):
    import ahocorasick
    import regex

    automaton, tried = ahocorasick.Automaton(), {}
    fuzzy = []
    for which, (notice, _) in enumerate(notices):
        k = len(notice) // chars_per_edit
        bounds = [len(notice) * i // (k + 1) for i in range(k + 2)]
        for at, end in zip(bounds, bounds[1:], strict=False):
            tried.setdefault(notice[at:end], []).append((which, at))
        fuzzy.append((k, regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}(?![^ ])")))
    for piece, where in tried.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton, fuzzy


def fuzzy_places(text: str, notices: tuple[tuple[str, str], ...] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of the places of normalised text within a notice's edits, on whole words."""
    automaton, fuzzy = _searcher(notices, chars_per_edit)
    near: dict[int, set[tuple[int, int]]] = {}
    text = f" {text} "  # the library inserts nothing at the very start of a search, so windows start on a blank
    for last, (length, where) in automaton.iter(text):
        for which, at in where:
            begin, k = last - length + 1 - at, fuzzy[which][0]
            near.setdefault(which, set()).add((max(0, begin - k - 1), begin + len(notices[which][0]) + k))
    found = []
    for which, windows in near.items():
        found += [(which, start - 1, end - 1, edits) for start, end, edits in _apart(text, notices[which][0], *fuzzy[which], windows)]
    return found


def _apart(text: str, notice: str, k: int, pattern, windows: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, edits) of one notice's places in windows of the text, which begins and ends with a blank, best first where they overlap."""
    best: list[tuple[int, int, int, int, int]] = []

    def search(low: int, high: int) -> None:
        if high - low < len(notice) - k:
            return
        at = text.find(f" {notice} ", max(0, low - 1), high + 1)
        if at >= 0:  # nothing is better than no edit
            heapq.heappush(best, (0, at + 1, at + 1 + len(notice), low, high))
            return
        if high < len(text):  # the search takes the end of a window for the end of a word
            high = max(low, text.rfind(" ", low, high + 1))
        m = pattern.search(text, low, min(len(text), high))
        if m:
            heapq.heappush(best, (sum(m.fuzzy_counts), m.start(), m.end(), low, high))

    for low, high in windows:
        search(low, high)
    taken: list[tuple[int, int]] = []
    edits = {}
    while best:
        n, start, end, low, high = heapq.heappop(best)
        at = bisect.bisect_left(taken, (end, 0))
        if at and taken[at - 1][1] > start:  # what the window has beside the better place
            before, after = taken[at - 1]
            if low < before:
                search(low, before - 1)
            if after < high:
                search(after, high)
        else:
            taken.insert(at, (start, end))
            edits[start] = n
            if low < start:
                search(low, start - 1)
            if end < high:
                search(end, high)
    return [(start, end, edits[start]) for start, end in taken]


def scan_text(text: str | None, notices=NOTICES, phrases=PHRASES, chars_per_edit: int = CHARS_PER_EDIT) -> tuple:
    """The columns that scan_licenses adds, for one text."""
    line, n_words = normalised(text)
    padded, starts, base = f" {line} ", [], set()
    for phrase, label in phrases:
        at, counted, word = padded.find(f" {phrase} "), 0, -1
        while at >= 0:
            word += padded.count(" ", counted, at + 1)
            counted = at + 1
            starts.append(word)
            base.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    notices = (*notices, *phrases)
    places = fuzzy_places(line, notices, chars_per_edit) if line else []
    best = max((1 - e / len(notices[w][0]) for w, _, _, e in places), default=0.0)
    spans = [{"label": notices[w][1], "start": a, "end": b, "edits": e} for w, a, b, e in sorted(places, key=lambda p: (p[1], p[0]))]
    labels = base | {notices[w][1] for w, *_ in places}
    return (
        n_words, len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best, spans,
    )


def scan_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    notices: tuple[tuple[str, str], ...] = NOTICES,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    chars_per_edit: int = CHARS_PER_EDIT,
) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Notices and phrases are both searched with edits; n_base, first_word, last_word and base_labels
    are of phrases that stand unchanged.  Offsets of spans are characters of the normalised text.  Null and empty texts have no words, no
    labels (empty strings), null first_word and last_word, and score 0.  Repeated rows are scanned one
    by one; keys may be null.  An empty table gives no rows.  Map-only: no shuffle.
    """
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    from pyspark.sql import types as T

    kind = docs.schema[key].dataType
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string(_COLUMNS).fields])

    bound_batches(docs.sparkSession)

    def scan(batches):
        take_worker("license_scan")
        for pdf in batches:
            found = [scan_text(t, notices, phrases, chars_per_edit) for t in pdf["text"]]
            out = {"key": pdf["key"].to_numpy()}
            for i, name in enumerate(names):
                column = [f[i] for f in found]
                out[name] = pd.array(column, dtype="Int64") if name in ("n_words", "n_base", "first_word", "last_word") else pd.Series(column, dtype="float64" if name == "score" else object)
            yield pd.DataFrame(out)

    return rows.mapInPandas(scan, schema).withColumnRenamed("key", key)
