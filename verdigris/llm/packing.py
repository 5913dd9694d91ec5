"""Packing of token pieces into windows by Karmarkar-Karp multiway differencing.

A partition is as many partial windows as there are windows.  The two partitions that are most out of
balance are merged again and again, the fullest window of one with the emptiest of the other, until
one is left, whose windows are near equal.  If its fullest window exceeds the capacity, there is one
window more and it starts anew.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, give_back, take_worker
from .tokens import TEXTS, encoder

#: Tokens of a window, of a piece at most, and of the pieces packed together at least.
CAPACITY = 2048
PIECE = 512
BLOCK_TOKENS = 1 << 19
#: Pieces of text whose ids a worker remembers, and bytes of text cut at once: less than elsewhere, as blocks are held beside.
REMEMBERED, CHUNK = 250_000, 500_000


def difference(sizes: list[int], k: int) -> np.ndarray:
    """The window, 0 to k - 1, of every piece, by largest differencing over k-way partitions."""
    heap = [(-s, i, np.array([s], np.int64), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        width = min(k, len(a) + len(b))
        total = np.zeros(width, np.int64)
        total[: len(a)] = a
        total[width - len(b) :] += b[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        spread = int(total[0] - (total[-1] if width == k else 0))
        heapq.heappush(heap, (-spread, number, total, (left, right, len(a), len(b), order)))
        number += 1
    window = np.zeros(len(sizes), np.int64)
    todo = [(heap[0][3], np.arange(k))] if heap else []
    while todo:
        node, slots = todo.pop()
        if isinstance(node, int):
            window[node] = slots[0]
            continue
        left, right, na, nb, order = node
        where = np.empty(len(order), np.int64)
        where[order] = slots[: len(order)]
        todo += [(left, where[:na]), (right, where[len(order) - nb :][::-1])]
    return window


def pack(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(window of every piece, number of windows); no window exceeds the capacity."""
    if not sizes:
        return np.zeros(0, np.int64), 0
    if max(sizes) > capacity:
        raise ValueError("a piece is longer than a window")
    total = sum(sizes)
    k = -(-total // capacity)
    while True:
        window = difference(sizes, k)
        most = int(np.bincount(window, weights=sizes, minlength=k).max())
        if most <= capacity:
            return window, k
        k += 1


def cut(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows first, the rest in near equal pieces."""
    whole, rest = divmod(n, capacity)
    out = [(i * capacity, capacity) for i in range(whole)]
    parts = -(-rest // piece)
    bounds = [whole * capacity + rest * i // parts for i in range(parts + 1)] if parts else []
    return out + [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    piece: int = PIECE,
    block_tokens: int = BLOCK_TOKENS,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Every task packs its own rows, block after block, so nothing is shuffled and memory is bounded by
    two blocks and one document.  A null or empty text is its end id alone.  Repeated rows are packed
    one by one; keys may be null.  sequence_id is unique, not gapless.  An empty table gives no rows.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    columns = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string(columns).fields])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def frame(pieces: list[tuple], windows: np.ndarray, first: int) -> pd.DataFrame:
        filled = np.zeros(int(windows.max()) + 1 if len(windows) else 0, np.int64)
        out = {c: [] for c in schema.fieldNames()}
        for (name, start, data, whole), w in zip(pieces, windows.tolist(), strict=True):
            ids = np.frombuffer(data, dtype).astype("<u4")
            for c, v in (("key", name), ("start", start), ("length", len(ids)), ("ids_crc32", zlib.crc32(ids)), ("doc_tokens", whole), ("sequence_id", first + w), ("offset", int(filled[w]))):
                out[c].append(v)
            if with_ids:
                out["ids"].append(ids.astype(np.int32))
            filled[w] += len(ids)
        out["key"] = pd.Series(out["key"], dtype=object)
        return pd.DataFrame(out)

    dtype = np.dtype("<u2")

    bound_batches(docs.sparkSession)

    def run(batches):
        take_worker("packing")
        nonlocal dtype
        enc = encoder(tokenizer, REMEMBERED, CHUNK)
        dtype = enc.dtype
        end, width = np.array([end_id], dtype).tobytes(), dtype.itemsize
        sequence = TaskContext.get().partitionId() << 33
        whole: list[tuple] = []
        rest: list[tuple] = []
        held = 0

        def packed(most: int):
            nonlocal rest, held, sequence
            n, i = 0, 0
            while i < len(rest) and n < most:
                n += len(rest[i][2]) // width
                i += 1
            part, rest, held = rest[:i], rest[i:], held - n
            windows, k = pack([len(p[2]) // width for p in part], capacity)
            sequence += k
            return frame(part, windows, sequence - k)

        for pdf in batches:
            keys, texts = pdf["key"].astype(object).where(pdf["key"].notna(), None).tolist(), pdf["text"].tolist()
            for low in range(0, len(texts), TEXTS):
                for name, data in zip(keys[low : low + TEXTS], enc.encode(texts[low : low + TEXTS]), strict=True):
                    data += end
                    n = len(data) // width
                    for at, length in cut(n, capacity, piece):
                        item = (name, at, data[at * width : (at + length) * width], n)
                        if length == capacity:
                            whole.append(item)
                        else:
                            rest.append(item)
                            held += length
                give_back()
                if whole:
                    yield frame(whole, np.arange(len(whole)), sequence)
                    sequence += len(whole)
                    whole = []
                while held >= 2 * block_tokens:
                    yield packed(block_tokens)
        if rest:
            yield packed(held)

    return rows.mapInPandas(run, schema).withColumnRenamed("key", key)
