"""Benchmark decontamination with suffix arrays of the training words.

Each shard (a batch of documents) gets a suffix array of its words: the positions from which a test
suffix could start, in the order of the words that follow.  Every test suffix is binary-searched in
it.  The range found gives all places that agree over a whole window, the neighbours the longest
verbatim match.  Only positions whose first words begin some test suffix are kept in the array, as
no other can be found.
"""

from __future__ import annotations

import dataclasses
import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, columns_of, covered, set_aside, take_worker, unused

#: Words that make a window.
WINDOW = 13
#: A document is contaminated when at least one word in so many is hit.
ONE_IN = 20
#: Bytes of benchmark text searched for in one pass; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


@dataclasses.dataclass
class TestSuffixes:
    """The suffixes of one block of benchmark items, as word numbers; 0 is any word that no item has."""

    numbers: dict[bytes, int]
    items: list[str | None]
    keys: np.ndarray  # suffixes x window, padded with 0; in lexicographic order
    lengths: np.ndarray  # words that have to agree: the window, or all of a shorter item
    item: np.ndarray
    start: np.ndarray
    heads: np.ndarray  # sorted codes of the first words of any suffix
    head_words: int


def _codes(first: list[np.ndarray], base: int) -> np.ndarray:
    code = np.zeros(len(first[0]), np.uint64)
    for column in first:
        code = code * np.uint64(base) + column.astype(np.uint64)
    return code


def test_suffixes(items: list[tuple[str, str | None]], window: int = WINDOW) -> TestSuffixes:
    """Index the (id, text) pairs of one block; items without words have no suffix."""
    numbers: dict[bytes, int] = {}
    flat, sizes = array("i"), []
    for _, text in items:
        words = words_of(text)
        flat.extend(numbers.setdefault(w, len(numbers) + 1) for w in words)
        sizes.append(len(words))
    size, line = np.array(sizes, np.int64), np.append(np.frombuffer(flat, np.int32), np.zeros(window, np.int32))
    owner = np.repeat(np.arange(len(size)), np.where(size > 0, np.maximum(size - window, 0) + 1, 0))
    start = np.arange(len(owner)) - np.searchsorted(owner, owner)
    lengths = np.minimum(window, size)[owner]
    keys = line[((np.cumsum(size) - size)[owner] + start)[:, None] + np.arange(window)]
    keys[np.arange(window) >= lengths[:, None]] = 0
    order = np.lexsort(keys.T[::-1]) if len(keys) else np.zeros(0, np.int64)
    keys, lengths = keys[order], lengths[order]
    # as many first words as the shortest window has, as long as their code fits in 64 bits
    head = min(3, int(lengths.min()) if len(lengths) else 1)
    while head > 1 and (len(numbers) + 1) ** head >= 1 << 63:
        head -= 1
    heads = np.unique(_codes([keys[:, j] for j in range(head)], len(numbers) + 1))
    return TestSuffixes(numbers, [i for i, _ in items], keys, lengths, owner[order], start[order], heads, head)


@dataclasses.dataclass
class SuffixArray:
    """Word positions of one shard in the order of the words that follow, and those words."""

    positions: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, line: np.ndarray, document: np.ndarray, tests: TestSuffixes) -> SuffixArray:
        window, n = tests.keys.shape[1], len(line)
        padded = np.concatenate([line, np.zeros(window, line.dtype)])
        owner = np.concatenate([document, np.full(window, -1, document.dtype)])
        code = _codes([padded[j : j + n] for j in range(tests.head_words)], len(tests.numbers) + 1)
        keep = np.flatnonzero(line > 0)
        found = np.searchsorted(tests.heads, code[keep])
        keep = keep[(found < len(tests.heads)) & (tests.heads[np.minimum(found, len(tests.heads) - 1)] == code[keep])]
        span = keep[:, None] + np.arange(window)
        keys = np.where(owner[span] == owner[keep][:, None], padded[span], 0)  # matches end with the document
        order = np.lexsort(keys.T[::-1])
        return cls(keep[order], keys[order])

    def bounds(self, keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every key the range of positions that agree over its length: all binary searches step together."""
        return self._bisect(keys, lengths, False), self._bisect(keys, lengths, True)

    def _bisect(self, keys: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(self.keys), np.int64)
        inside = np.arange(keys.shape[1]) < lengths[:, None]
        while (open_ := low < high).any():
            middle = (low + high) // 2
            got = self.keys[np.minimum(middle, len(self.keys) - 1)]
            differs = (got != keys) & inside
            at = differs.argmax(1)[:, None]
            order = np.take_along_axis(got, at, 1)[:, 0] - np.take_along_axis(keys, at, 1)[:, 0]
            order[~differs.any(1)] = 0
            right = open_ & ((order < 0) | (after & (order == 0)))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low

    def longest(self, key: np.ndarray) -> tuple[int, int]:
        """(words, position) of the longest verbatim match of key, which stands beside its place in the array."""
        at, best = int(self._bisect(key[None], np.array([len(key)]), False)[0]), (0, -1)
        for i in (at - 1, at):
            if 0 <= i < len(self.keys):
                differs = np.flatnonzero((self.keys[i] != key) | (key == 0))
                best = max(best, (int(differs[0]) if len(differs) else len(key), int(self.positions[i])))
        return best


def shard_of(texts: list[str | None], tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, SuffixArray]:
    """(words of each text, first word of each, text of each word, suffix array) of one shard."""
    number = tests.numbers.get
    lines = [[number(w, 0) for w in words_of(t)] for t in texts]
    sizes = np.array([len(x) for x in lines], np.int64)
    line = np.fromiter((w for x in lines for w in x), np.int64, int(sizes.sum()))
    document = np.repeat(np.arange(len(lines)), sizes)
    return sizes, np.cumsum(sizes) - sizes, document, SuffixArray.of(line, document, tests)


def places(array: SuffixArray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(test suffix, position) of every agreement over a whole window."""
    if not len(array.keys) or not len(tests.keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = array.bounds(tests.keys, tests.lengths)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, array.positions[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


def _whole(document: np.ndarray, at: np.ndarray, which: np.ndarray, tests: TestSuffixes) -> np.ndarray:
    """(text, position, item, the item's word, words) of every longest verbatim match: windows that follow one another in a text and an item are one."""
    rows = np.stack([document[at], tests.item[which], at - tests.start[which], at, tests.start[which], tests.lengths[which]], 1)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    step = np.diff(rows, axis=0)
    begins = np.flatnonzero(np.concatenate([[True], (step[:, :3] != 0).any(1) | (step[:, 3] != 1)]))
    last = np.concatenate([begins[1:], [len(rows)]]) - 1
    out = np.stack([rows[begins, 0], rows[begins, 3], rows[begins, 1], rows[begins, 4], rows[last, 3] + rows[last, 5] - rows[begins, 3]], 1)
    return out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]


def hits(texts: list[str | None], tests: TestSuffixes) -> list[tuple[int, list[tuple[int, int]], list[int], list[tuple[int, int, int, int]]]]:
    """Per text: its number of words, the maximal hit spans in words, the items that occur, and (word, item, the item's word, words) of the longest matches."""
    sizes, first, document, array = shard_of(texts, tests)
    which, at = places(array, tests)
    out: list[tuple[int, list, list, list]] = [(int(n), [], [], []) for n in sizes]
    if len(at):
        change = np.zeros(len(document) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + tests.lengths[which], -1)
        hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        begins = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(document[hit]) != 0)])
        lows, highs = hit[begins], hit[np.concatenate([begins[1:], [True]])] + 1
        for a, b in zip(lows.tolist(), highs.tolist(), strict=True):
            d = int(document[a])
            out[d][1].append((a - int(first[d]), b - int(first[d])))
        for d, i in np.unique(np.stack([document[at], tests.item[which]], 1), axis=0).tolist():
            out[d][2].append(i)
        for d, a, i, b, n in _whole(document, at, which, tests).tolist():
            out[d][3].append((a - int(first[d]), i, b, n))
    return out


def matches(texts: list[str | None], tests: TestSuffixes) -> list[tuple[int, int, int, int, int]]:
    """(text, its word, item, the item's word, words) of every agreement over a whole window."""
    _, first, document, array = shard_of(texts, tests)
    which, at = places(array, tests)
    d = document[at]
    return sorted(zip(d.tolist(), (at - first[d]).tolist(), tests.item[which].tolist(), tests.start[which].tolist(), tests.lengths[which].tolist(), strict=True))


def blocks_of(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """Blocks of (id, text) of bounded size, one at a time; items are dealt to blocks by a hash of their id."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total * 2 // block_bytes) if total > block_bytes else 1
    for b in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == b)
        yield [(r["item"], r["text"]) for r in part.orderBy("item", "text").toLocalIterator()]


def _looker(shared, state: str):
    @F.pandas_udf(state)
    def look(texts: pd.Series) -> pd.DataFrame:
        take_worker("decontaminate")
        found, names = [], shared.value.items
        for at in range(0, len(texts), 1000):
            found += hits(texts.iloc[at : at + 1000].tolist(), shared.value)
        return pd.DataFrame({
            "n_words": [f[0] for f in found],
            "spans": [[{"start": a, "end": b} for a, b in f[1]] for f in found],
            "items": [[names[i] for i in f[2] if names[i] is not None] for f in found],
            "matches": [[{"item": names[i], "item_word": b, "word": a, "words": n} for a, i, b, n in f[3] if names[i] is not None] for f in found],
        })

    return look.asNondeterministic()


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256, contaminated, hit_spans and matches to every row of docs.

    hit_spans are the maximal runs of hit words, as (start, end).  matches are the longest verbatim
    matches, of a window or more, as (item, item_word, word, words): the item, the match's first word
    in item and document, and its length.  Null and empty texts have no words
    and are never contaminated.  Items without words are never found; items of one id count once;
    items with a null id are found but not listed or counted.  All columns of docs stay;
    columns of the seven new names are replaced.  Map-only over docs.
    """
    new = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "matches")
    docs = docs.drop(*new)
    match = "array<struct<item:string,item_word:int,word:int,words:int>>"
    state = f"n_words long, spans array<struct<start:int,end:int>>, items array<string>, matches {match}"
    spark = docs.sparkSession
    bound_batches(spark)
    hit, more = unused("hit", docs), unused("more", docs)
    spans = "array<struct<start:int,end:int>>"
    current = docs.withColumn(hit, F.lit(None).cast(f"struct<n_words:bigint,spans:{spans},items:array<string>,matches:{match}>"))
    of = lambda state, field: F.col(f"{state}.{field}")
    known = lambda field, kind: F.coalesce(of(hit, field), F.array().cast(kind))
    for block in blocks_of(benchmark, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(test_suffixes(block, window))  # of at most block_bytes of text

        # not to be run again for a filter on its result
        current = current.withColumn(more, _looker(shared, state)(F.col(text))).withColumn(hit, F.struct(
            of(more, "n_words").alias("n_words"),
            F.concat(known("spans", spans), of(more, "spans")).alias("spans"),
            F.array_union(known("items", "array<string>"), of(more, "items")).alias("items"),
            F.concat(known("matches", match), of(more, "matches")).alias("matches"),
        )).drop(more)
    items = F.array_sort(F.array_distinct(of(hit, "items")))
    current = current.withColumn("n_hit", covered(of(hit, "spans"), "start", "end"))
    n_hit, n_words = F.col("n_hit"), of(hit, "n_words")
    return current.select(
        *columns_of(docs), n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (ONE_IN * n_hit >= n_words)).alias("contaminated"),
        of(hit, "spans").alias("hit_spans"), of(hit, "matches").alias("matches"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs."""
    packed, back = set_aside(docs, text)
    return back(find_benchmark(packed, benchmark, text, **options).filter(~F.col("contaminated")))
