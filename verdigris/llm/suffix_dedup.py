"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes when a string of `length` bytes around it also starts at another place of the corpus.

1. Every window of `length` bytes picks one of its k-byte grams, the one with the least hash (the
   first of these).  Equal windows pick the same gram at the same offset, so equal windows meet at an
   anchor: a gram that was picked, with the windows that picked it.  Anchors are about 170 bytes apart.
2. Anchors whose gram occurs once have no repeats.  Anchors that agree in their whole context, all
   bytes of their windows, are repeats as they stand.  The rest, at the rims of repeated passages,
   is decided by bytes.
3. Contexts of one gram meet in one task.  A batch of them gets a suffix array (the contexts in order
   of the bytes from the anchor on) and is merge-scanned against the suffix arrays of all levels:
   going from the anchor to the left one byte at a time, the merged order and the lengths of the common
   prefixes of neighbours are kept up by one stable partition a step, and neighbours that agree over
   `length` bytes are a match for both.  Then the batch becomes a level, and levels of one size class
   merge.
4. A gram with more different contexts than one task should hold is split by the offsets of its
   windows: windows of fewer offsets share more bytes, and meet by these.  This ends, as all windows
   of one offset that share all their bytes are equal.

Only anchors, rims and spans are shuffled; the texts are once, where equal texts are combined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import RollingHash, bound_batches, covered, digest, distinct_texts, join_groups, parts_by_bytes, remove, shared_dir, shuffle_partitions, take_worker, text_or_empty, tidy, unused, written

#: Bytes of a repeated string, and of the grams that windows pick.
LENGTH, GRAM = 400, 64
#: Bytes that some fifty words hold at most, and of the grams of such windows.
PASSAGE, PASSAGE_GRAM = 240, 48
#: Contexts of one gram in one task, and contexts of one task on average.
GROUP_MOST, TASK_CONTEXTS = 20_000, 20_000
#: Contexts in a batch of the index.
BATCH = 4096
_CHUNK = 250_000


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return values if span == width else np.minimum(values[: len(values) - (width - span)], values[width - span :])


def find_anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, position, least offset, largest offset, gram hash, context hash) of the anchors of some texts.

    The windows that picked the gram at p start from p - largest offset to p - least offset.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return empty
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # window starts: all but the last length - 1 bytes of each text
    n_windows = np.maximum(sizes - length + 1, 0)
    if not n_windows.any():
        return empty
    grams = RollingHash(data).grams(gram)
    low = np.uint64((1 << 31) - 1)  # a text has fewer bytes; of equal hashes the first is picked, in long texts and short ones
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    picked = (_window_minimum(key, length - gram + 1) & low).astype(np.int64)
    valid = np.zeros(len(picked) + 1, np.int64)
    some = n_windows > 0
    np.add.at(valid, starts[some], 1)
    np.add.at(valid, (starts + n_windows)[some], -1)
    window = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    at = picked[window]
    # windows that pick one gram follow one another
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(window) != 1)]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    position, low_window, high_window = at[first], window[first], window[last]
    text = np.searchsorted(ends, position, side="right")
    view = memoryview(data)
    context = np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in zip(low_window.tolist(), (high_window + length).tolist(), strict=True)), np.uint64, len(position))
    least, largest = position - high_window, position - low_window
    context ^= (least * (1 << 24) + largest).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return text, position - starts[text], least, largest, grams[position], context


_ANCHOR = "gram long, context long, digest binary, least int, largest int, at array<int>"


def _anchor_rows(length: int, gram: int):
    def run(batches):
        take_worker("suffix_dedup")
        for batch in batches:
            texts, digests = batch.column("body").to_pylist(), batch.column("digest")
            for part in parts_by_bytes(np.array([len(t) for t in texts], np.int64), _CHUNK):
                text, at, least, largest, g, c = find_anchors(texts[part], length, gram)
                if not len(text):
                    continue
                # equal anchors of one text, as in a long run of one letter, make one row
                order = np.lexsort((at, c, g, text))
                text, at, least, largest, g, c = (x[order] for x in (text, at, least, largest, g, c))
                new = np.concatenate([[True], (np.diff(text) != 0) | (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
                first = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at, pa.int32()))
                columns = [pa.array(g[first].view(np.int64)), pa.array(c[first].view(np.int64)), digests.take(pa.array(text[first] + part.start)), pa.array(least[first], pa.int32()), pa.array(largest[first], pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "context", "digest", "least", "largest", "at"])

    return run


class SuffixIndex:
    """A logarithmic family of suffix arrays over contexts that were added in batches.

    contexts: bytes of the windows of each anchor; largest and least: the anchor's offsets in them.
    """

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.reach = length, length - gram
        self.levels: list[np.ndarray] = []
        self.bytes = np.zeros((0, self.reach + length), np.uint8)
        self.group = np.zeros(0, np.int64)
        self.least, self.largest = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.repeated = np.zeros((0, self.reach + 1), bool)

    def _sorted(self, rows: np.ndarray) -> np.ndarray:
        right = np.ascontiguousarray(self.bytes[rows, self.reach :]).view(f"S{self.length}").ravel()
        return rows[np.lexsort((right, self.group[rows]))]

    def add(self, group: np.ndarray, contexts: list[bytes], least: np.ndarray, largest: np.ndarray) -> None:
        before = len(self.group)
        block = np.zeros((len(contexts), self.bytes.shape[1]), np.uint8)
        for i, (c, far) in enumerate(zip(contexts, largest.tolist(), strict=True)):
            # no byte of UTF-8 is 255, so 0 is free for what lies outside
            block[i, self.reach - far : self.reach - far + len(c)] = np.frombuffer(c, np.uint8) + 1
        self.bytes = np.concatenate([self.bytes, block])
        self.group = np.concatenate([self.group, group])
        self.least, self.largest = np.concatenate([self.least, least]), np.concatenate([self.largest, largest])
        self.repeated = np.concatenate([self.repeated, np.zeros((len(contexts), self.reach + 1), bool)])
        new = self._sorted(np.arange(before, before + len(contexts)))
        self.scan(new)
        for level in self.levels:
            shared = np.isin(self.group[level], self.group[new])  # other groups can't match
            if shared.any():
                self.scan(self._sorted(np.concatenate([level[shared], new])))
        while self.levels and len(self.levels[-1]).bit_length() <= len(new).bit_length():
            new = self._sorted(np.concatenate([self.levels.pop(), new]))
        self.levels.append(new)

    def scan(self, order: np.ndarray) -> None:
        """Mark the windows of a merged suffix array that equal one of their neighbours."""
        if len(order) < 2:
            return
        right = self.bytes[order, self.reach :]
        same_group = np.concatenate([[False], np.diff(self.group[order]) == 0])
        differs = right[1:] != right[:-1]
        common = np.where(differs.any(1), differs.argmax(1), self.length)
        held = self.length - self.least[order]  # bytes from the anchor on
        common = np.minimum(common, np.minimum(held[1:], held[:-1]))
        lcp = np.where(same_group, np.concatenate([[0], common]), 0)
        for offset in range(self.reach + 1):
            if offset:
                column = self.bytes[order, self.reach - offset].astype(np.int64)
                keep = np.flatnonzero(self.largest[order] >= offset)
                if len(keep) < 2:
                    return
                key = self.group[order[keep]] * 256 + column[keep]
                turn = np.argsort(key, kind="stable")
                old, key = keep[turn], key[turn]
                equal = key[1:] == key[:-1]
                value = lcp[old[1:]] + 1
                far = np.flatnonzero(equal & (old[1:] - old[:-1] > 1))
                if len(far):
                    edges = np.stack([old[far] + 1, old[far + 1] + 1], 1).ravel()
                    value[far] = np.minimum.reduceat(np.append(lcp, 0), edges)[::2] + 1
                lcp = np.concatenate([[0], np.where(equal, value, 0)])
                order = order[old]
            match = np.flatnonzero(lcp >= self.length)
            self.repeated[order[match], offset] = True
            self.repeated[order[match - 1], offset] = True


def repeated_offsets(index: SuffixIndex, row: int) -> list[tuple[int, int]]:
    """Runs (first, last) of the offsets whose windows are repeated."""
    flags = index.repeated[row]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


_MEMBER = "gram long, digest binary, at int, least int, largest int, whole boolean, bytes binary"
_SPANS = "digest binary, low int, high int"


def _index_rows(length: int, gram: int):
    def run(batches):
        take_worker("suffix_dedup")
        index, digests, ats, whole = SuffixIndex(length, gram), [], [], []
        for pdf in batches:
            for low in range(0, len(pdf), BATCH):
                part = pdf.iloc[low : low + BATCH]
                # group numbers keep their order and leave room for a byte
                index.add(part["gram"].to_numpy(np.int64) >> 9, part["bytes"].tolist(), part["least"].to_numpy(np.int64), part["largest"].to_numpy(np.int64))
                digests += part["digest"].tolist()
                ats += part["at"].tolist()
                whole += part["whole"].tolist()
        out = [(digests[i], ats[i] - b, ats[i] - a + length) for i in np.flatnonzero(index.repeated.any(1)).tolist() if not whole[i] for a, b in repeated_offsets(index, i)]
        if out:
            yield pd.DataFrame(out, columns=["digest", "low", "high"])

    return run


def _split_rows(low: int, high: int, length: int):
    """Members of offsets low to high go on in two halves, by a hash of the bytes that all windows of a half share."""

    def run(batches):
        take_worker("suffix_dedup")
        for pdf in batches:
            out = []
            for m in pdf.itertuples(index=False):
                for a, b in ((low, (low + high) // 2), ((low + high) // 2 + 1, high)):
                    least, largest = max(m.least, a), min(m.largest, b)
                    if least > largest:
                        continue
                    begin = m.largest - largest
                    shared = m.bytes[m.largest - a : m.largest - b + length]
                    name = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=f"{a},{b}".encode()).digest(), "little", signed=True)
                    out.append((name, m.digest, m.at, least, largest, m.whole, m.bytes[begin : m.largest - least + length], a, b))
            yield pd.DataFrame(out, columns=["gram", "digest", "at", "least", "largest", "whole", "bytes", "half_low", "half_high"])

    return run


def _combined(members: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(spans of members that equal another in their whole context, one member for each different context)."""
    alike = ["gram", "least", "largest", "bytes"]
    n = members.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "at")).alias("first"), F.max("whole").alias("any_whole"))
    equal = members.join(n.filter("n > 1 or any_whole").select(*alike), alike, "left_semi").filter("not whole")
    spans = equal.select("digest", (F.col("at") - F.col("largest")).alias("low"), (F.col("at") - F.col("least") + length).alias("high"))
    kept = n.select("gram", "first.digest", "first.at", "least", "largest", (F.col("any_whole") | (F.col("n") > 1)).alias("whole"), "bytes")
    return spans, kept


def _by_bytes(members: DataFrame, path: str, length: int, gram: int, group_most: int) -> list[DataFrame]:
    """Spans of the repeated windows of members, one of each different context of a gram."""
    spark = members.sparkSession
    found, waiting, step = [], [(members, 0, length - gram)], 0
    while waiting:
        some, low, high = waiting.pop()
        sizes = some.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        total, most = sizes.agg(F.sum("n"), F.max("n")).first()
        if not total or most < 2:
            continue
        hot = most > group_most and low < high
        cold = some.join(sizes.filter(F.col("n") > group_most), "gram", "left_anti") if hot else some
        tasks = max(shuffle_partitions(spark), -(-total // TASK_CONTEXTS))
        found.append(cold.repartition(tasks, "gram").mapInPandas(_index_rows(length, gram), _SPANS))
        if hot:
            step += 1
            large = some.join(sizes.filter(F.col("n") > group_most), "gram", "left_semi")
            halves = written(large.mapInPandas(_split_rows(low, high, length), _MEMBER + ", half_low int, half_high int"), f"{path}/halves{step}")
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                spans, kept = _combined(halves.filter(F.col("half_low") == a).drop("half_low", "half_high"), length)
                found.append(spans)
                waiting.append((written(kept, f"{path}/members{step}-{a}"), a, b))
    return found


def repeated_spans(texts: DataFrame, path: str, length: int = LENGTH, gram: int = GRAM, group_most: int = GROUP_MOST) -> DataFrame:
    """(digest, low, high): spans that together hold all repeated bytes of the texts (digest, text), as far as other texts or places in them tell.

    texts must be stored, as it is read twice.  Spans may overlap.
    """
    length_ok = F.octet_length("text") >= length
    bodies = texts.filter(length_ok).select("digest", F.col("text").cast("binary").alias("body"))
    anchors = written(bodies.mapInArrow(_anchor_rows(length, gram), _ANCHOR), f"{path}/anchors")
    grams = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("at")).alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
    again = written(grams.filter("n > 1").select("gram", "rows", (F.col("a") == F.col("b")).alias("alike")), f"{path}/grams")
    shared = written(join_groups(anchors, again, ["gram"], "rows", ["alike"]), f"{path}/shared")
    remove(anchors.sparkSession, f"{path}/anchors")
    span = lambda at: ((at - F.col("largest")).alias("low"), (at - F.col("least") + length).alias("high"))
    mixed = shared.filter("not alike")
    contexts = mixed.groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size("at")).alias("n"), F.min(F.struct("digest", F.col("at")[0].alias("at"), "least", "largest")).alias("first")
    )
    contexts = written(contexts, f"{path}/contexts")
    equal = shared.filter("alike").select("digest", "least", "largest", "at").unionByName(
        join_groups(mixed, contexts.filter("n > 1"), ["gram", "context"], "rows", ["n"]).select("digest", "least", "largest", "at")
    )
    equal = equal.withColumn("at", F.explode("at")).select("digest", *span(F.col("at")))
    # grams all of whose contexts occur more than once are settled
    open_grams = written(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least_n")).filter("least_n = 1"), f"{path}/open")
    rims = join_groups(contexts, open_grams, ["gram"], "rows", ["least_n"]).select("gram", "first.digest", "first.at", "first.least", "first.largest", (F.col("n") > 1).alias("whole"))
    body = F.col("text").cast("binary")
    begin, size = F.col("at") - F.col("largest") + 1, F.col("largest") - F.col("least") + length
    members = rims.hint("shuffle_hash").join(texts, "digest").select("gram", "digest", "at", "least", "largest", "whole", F.call_function("substring", body, begin, size).alias("bytes"))
    members = written(members, f"{path}/members")
    out = equal
    for spans in _by_bytes(members, path, length, gram, group_most):
        out = out.unionByName(spans)
    return out


@F.pandas_udf(T.StructType().add("n_removed", "long").add("n_spans", "long").add("kept", "binary"))
def _without(body: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
    take_worker("suffix_dedup")
    out = []
    for b, low, high in zip(body, lows, highs, strict=True):
        if b is None:
            out.append((0, 0, None))
            continue
        change = np.zeros(len(b) + 1, np.int32)
        np.add.at(change, np.asarray(low, np.int64), 1)
        np.add.at(change, np.asarray(high, np.int64), -1)
        gone = np.cumsum(change[:-1]) > 0
        runs = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
        out.append((int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])


def _spans_by_text(texts: DataFrame, path: str, name: str, length: int, gram: int, group_most: int) -> DataFrame:
    """(digest, spans) of the texts with repeated bytes; what led to it goes."""
    spans = repeated_spans(texts, f"{path}/{name}", length, gram, group_most)
    # spans of a text are bounded by its length
    by_text = written(spans.groupBy("digest").agg(F.collect_set(F.struct("low", "high")).alias("spans")), f"{path}/{name}-spans")
    remove(texts.sparkSession, f"{path}/{name}")
    tidy(texts.sparkSession)
    return by_text


def remove_repeated(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", group_most: int = GROUP_MOST, path: str | None = None, passage: int | None = None, passage_gram: int = PASSAGE_GRAM
) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) to every row, without its text.

    Every byte goes that a string of `length` bytes covers which starts anywhere else, in the same text
    or another; strings are judged on the input.  Null texts are empty.  A text that occurs in several
    rows is removed whole from each if it has `length` bytes.  Texts shorter than that stay.  Other
    columns stay, those of the new names are replaced.  An empty table gives no rows.
    passage: adds n_repeated, how many bytes strings of this other length cover that start anywhere else.
    path: a folder for tables that the result reads, which may go once the result is written.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    bound_batches(spark)
    texts = distinct_texts(docs, f"{path}/texts", text)
    by_text = _spans_by_text(texts, path, "cut", length, gram, group_most)
    n_bytes = F.octet_length("text").cast("long")
    all_gone = (F.col("copies") > 1) & (n_bytes >= length)
    body = F.col("text").cast("binary")
    judged = texts
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    if passage:
        repeated = _spans_by_text(texts, path, "passages", passage, passage_gram, group_most)
        repeated = repeated.select("digest", covered(F.col("spans"), "low", "high").alias("in_passages"))
        judged = judged.join(repeated.hint("shuffle_hash"), "digest", "left")
        names.insert(3, "n_repeated")
        n_repeated = F.when((F.col("copies") > 1) & (n_bytes >= passage), n_bytes).otherwise(F.coalesce("in_passages", F.lit(0))).cast("long").alias("n_repeated")
    judged = judged.join(by_text.hint("shuffle_hash"), "digest", "left")
    some = F.col("spans").isNotNull() & ~all_gone
    nothing = F.array().cast("array<int>")
    # not to be run again for a filter on its result
    judged = judged.withColumn("cut", _without.asNondeterministic()(F.when(some, body), F.when(some, F.col("spans.low")).otherwise(nothing), F.when(some, F.col("spans.high")).otherwise(nothing)))
    kept = F.when(all_gone, F.lit(b"")).when(some, F.col("cut.kept")).otherwise(body)
    judged = judged.select(
        "digest", "copies", n_bytes.alias("n_bytes"),
        F.when(all_gone, n_bytes).otherwise(F.col("cut.n_removed")).alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.col("cut.n_spans")).cast("long").alias("n_spans"), kept.alias("kept"), *([n_repeated] if passage else []),
    ).withColumn("kept_sha256", F.sha2("kept", 256))
    own = unused("digest", docs)
    rows = docs.withColumn(own, digest(text_or_empty(text))).drop(text, *names)
    # what a hot text leaves is empty or shorter than `length`
    return join_groups(rows, judged.withColumnRenamed("digest", own), [own], "copies", names).drop(own)
