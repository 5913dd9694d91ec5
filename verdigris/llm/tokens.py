"""Token ids by the tokenizers library, and their file format.

Ids are kept by frequency: the rank of an id in its block, most frequent first, in as few whole bytes
as it needs, low byte first.  The lengths stand apart from the data, four to a control byte, so a
numpy table turns control bytes into lengths and one cumulative sum finds every value.  A block also
has its table of ids by rank and the ids and lengths of its documents; it can be read by itself.
Blocks are rows of Parquet files, written and committed by Spark on any file system.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RollingHash, bound_batches, lets_go, parts_by_bytes, shared_dir, take_worker, tasks_for

#: Ids of one block, at least; memory of a writing task is bounded by this and one document.
BLOCK_IDS = 1 << 20
#: Pieces of text whose ids a worker remembers from lately; as many more from before that.
REMEMBERED = 500_000
#: Pieces encoded in one call, parted by a special token.
_AT_ONCE = 64

#: Texts that are encoded in one call.
TEXTS = 1000
#: Bytes of text that are cut into pieces at once.
_CHUNK = 1_500_000
#: Pieces longer than this are compared as they are, not by a hash.
_LONG = 256


def _table(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: ASCII white space, as any library sees it, and the bytes that other white space begins with.
_SPACE = _table([*range(9, 14), *range(28, 33)])
_MAY_BEGIN_SPACE = _SPACE | _table([0xC2, 0xE1, 0xE2, 0xE3])
_MAY_END_SPACE = _SPACE | _table(range(0x80, 256))
#: Marks that part from a letter before them; an apostrophe does not, nor does white space that a tokenizer may join.
_MARKS = _table(b".,;:!?*#&%$@|()\"-\n")
_UPPER, _LETTERS = _table(range(65, 91)), _table([*range(65, 91), *range(97, 123)])
#: Second bytes of Latin-1 letters after 0xC3, and of those that have a lower case.
_LATIN, _LATIN_UPPER = _table(set(range(0x80, 0xC0)) - {0x97, 0xB7}), _table(set(range(0x80, 0x9F)) - {0x97})

#: The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others follow 255 in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

#: Parts of a tokenizer whose texts can be cut; fixed values.
_CUT_AT_BLANKS = (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True})
_DROPS_SPACE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
    ]},
)


def _parts(tokenizer) -> tuple:
    """What normalises and cuts a tokenizer's texts; offsets do not matter here."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items() if k != "trim_offsets"}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return tuple(x and plain(json.loads(x.__getstate__())) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))


class PieceEncoder:
    """Exact ids of whole texts, reusing the ids of pieces that occur again.

    Two kinds of byte-level tokenizer are known.  One keeps white space and splits before a single blank
    that no white space follows, and around a single line feed, so cutting before the blank and after
    the line feed changes nothing.  The other drops white space and case, and any white space may be cut
    out.  Both part a letter from a mark.  Texts that hold `<|` are encoded uncut, for the sake of
    special tokens, and so is every text of a tokenizer of another kind.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, chunk: int = _CHUNK):
        self.remembered, self.chunk = remembered, chunk
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        parts = _parts(self.tokenizer)
        self.spaces_kept = parts == _CUT_AT_BLANKS
        self.cuts = (self.spaces_kept or parts == _DROPS_SPACE) and self.tokenizer.truncation is None and self.tokenizer.padding is None
        self.cuts &= all("<|" in t.content and not (t.lstrip or t.rstrip) for t in added.values())
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.parting = next(((t.content, i) for i, t in added.items()), None)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # pieces known from longer ago

    def _cut(self, data: np.ndarray, first: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the pieces of joined texts, of which `first` has the first bytes."""
        n = len(data)
        start = np.zeros(n + 1, bool)
        start[1:n] = letter[:-1] & _MARKS[data[1:]]
        if not self.spaces_kept:
            inside = np.zeros(n + 1, bool)
            inside[:n] = (data != 32) & (data != 10)
            edge = inside.copy()
            edge[1:] &= ~inside[:-1]
            start |= edge
            start[first] = True  # a piece must not reach into the next text
            start &= inside
            starts = np.flatnonzero(start)
            stop = start[1:] & inside[:-1]
            stop |= inside[:-1] & ~inside[1:]
            return starts, np.flatnonzero(stop) + 1
        after = np.append(data[1:], 32)
        start[:n] |= (data == 32) & ~_MAY_BEGIN_SPACE[after]
        line = np.zeros(n, bool)
        line[1:] = (data[:-1] == 10) & ~_MAY_BEGIN_SPACE[data[1:]]
        line[1:2] = False
        line[2:] &= ~_MAY_END_SPACE[data[:-2]]
        start[:n] |= line
        start[first] = True
        starts = np.flatnonzero(start[:n])
        return starts, np.append(starts[1:], n)

    def _packed(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn_words(self, words: list[bytes]) -> None:
        """Ids of pieces that are Latin-1 letters, after a blank at most: the pre-tokenizer leaves these whole, so the model does."""
        known, tokenize, code = self.known, self.tokenizer.model.tokenize, self.code
        ascii_only = [w for w in words if w.isascii()]
        for some in (ascii_only, [w for w in words if not w.isascii()]):
            if not some:
                continue
            shown = b"\n".join(some).decode("latin-1")
            shown = shown.replace(" ", _SHOWN[32]) if some is ascii_only else shown.translate(_SHOWN)
            for raw, word in zip(some, shown.split("\n"), strict=True):
                known[raw] = array(code, [t.id for t in tokenize(word)]).tobytes()

    def _learn_any(self, raws: list[bytes]) -> None:
        texts = [r.decode() for r in raws]
        if self.parting is None:
            for raw, e in zip(raws, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                self.known[raw] = self._packed(e.ids)
            return
        mark, number = self.parting
        groups = [slice(i, i + _AT_ONCE) for i in range(0, len(raws), _AT_ONCE)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([mark.join(texts[g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            data, at = ids.tobytes(), 0
            for raw, end in zip(raws[group], [*(np.flatnonzero(ids == number) * self.dtype.itemsize).tolist(), len(data)], strict=True):
                self.known[raw] = data[at:end]
                at = end + self.dtype.itemsize

    def _lowered(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Latin-1 letters in lower case, but for those that what follows may join; the tokenizer drops the case anyway."""
        after = np.append(data[1:], 32)
        after[ends - 1] = 32
        alone = (after < 0x80) | (after == 0xC3)
        out = data.copy()
        out[_UPPER[data] & alone] += 32
        latin = np.flatnonzero((data[:-1] == 0xC3) & _LATIN_UPPER[data[1:]] & alone[1:]) + 1
        out[latin] += 32
        return out

    def _encode_joined(self, texts: list[bytes]) -> list[bytes]:
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        if not self.spaces_kept:
            data = self._lowered(data, ends)
            joined = data.tobytes()
        letter = _LETTERS[data]
        latin = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]])
        letter[latin] = letter[latin + 1] = True
        starts, stops = self._cut(data, ends - np.array([len(t) for t in texts]), letter)
        if not self.spaces_kept:  # letters that kept their case
            letter[_UPPER[data]] = False
            letter[latin[_LATIN_UPPER[data[latin + 1]]]] = False
        others = np.zeros(len(data) + 1, np.int32)
        np.cumsum(~letter, out=others[1:])
        body = starts + (data[starts] == 32) if self.spaces_kept else starts
        word = (others[stops] == others[body]) & (stops > body)
        names = RollingHash(data).slices(starts, stops)
        for i in np.flatnonzero(stops - starts > _LONG).tolist():
            names[i] = np.uint64(hash(joined[starts[i] : stops[i]]) & 0xFFFFFFFFFFFFFFFF)
        which, _ = pd.factorize(names)
        # numbers are given in order of appearance, so a new one is one more than all before
        where = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
        pieces = [joined[a:b] for a, b in zip(starts[where].tolist(), stops[where].tolist(), strict=True)]
        ids = list(map(self.known.get, pieces))
        if None in ids:
            kinds, words, rest = word[where].tolist(), [], []
            for i, got in enumerate(ids):
                if got is None:
                    old = self.before.pop(pieces[i], None)
                    if old is not None:
                        self.known[pieces[i]] = old
                    else:
                        (words if kinds[i] else rest).append(pieces[i])
            self._learn_words(words)
            self._learn_any(rest)
            ids = list(map(self.known.__getitem__, pieces))
        width = self.dtype.itemsize
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // width
        firsts = np.cumsum(sizes, dtype=np.int32) - sizes
        lengths = sizes[which]
        stop = np.cumsum(lengths)
        total = int(stop[-1]) if len(stop) else 0
        at = np.repeat(firsts[which] - (stop - lengths).astype(np.int32), lengths)
        at += np.arange(total, dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), self.dtype)[at].tobytes()
        of_text = np.append(0, stop)[np.searchsorted(starts, ends, side="left")] * width
        return [flat[a:b] for a, b in zip([0, *of_text[:-1].tolist()], of_text.tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as packed little-endian integers; null counts as empty."""
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if t and (not self.cuts or "<|" in t)]
        for i in whole:
            out[i] = self._packed(self.tokenizer.encode(texts[i], add_special_tokens=False).ids)
        left = set(whole)
        rows = [i for i, t in enumerate(texts) if t and i not in left]
        bodies = [texts[i].encode() for i in rows]
        for part in parts_by_bytes(np.array([len(b) for b in bodies], np.int64), self.chunk):
            if len(self.known) > self.remembered:
                self.known, self.before = {}, self.known
            for i, ids in zip(rows[part], self._encode_joined(bodies[part]), strict=True):
                out[i] = ids
        return out


#: The byte-level alphabet for bytes read as Latin-1, with line feeds between words.
_SHOWN = {b: chr(c) for b, c in _BYTE_LEVEL.items() if b != 10}


@functools.lru_cache(4)
def encoder(path: str, remembered: int = REMEMBERED, chunk: int = _CHUNK) -> PieceEncoder:
    """One encoder per worker process, so what it remembers serves all its tasks."""
    return PieceEncoder(path, remembered, chunk)


lets_go(encoder.cache_clear)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


# ---- the coding ---------------------------------------------------------------------------------

#: The four lengths that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned integers below 2**32."""
    values = values.astype(np.uint32)
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    quads = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    quads[: len(values)] = extra
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    ends = np.cumsum(extra.astype(np.int64) + 1)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - extra - 1
    data[starts] = values
    for more in range(1, int(extra.max()) + 1 if len(extra) else 1):
        at = np.flatnonzero(extra >= more)
        data[starts[at] + more] = values[at] >> np.uint32(8 * more)
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    values = raw[starts].astype(np.uint32)
    for more in range(1, int(lengths.max()) if n else 1):
        at = np.flatnonzero(lengths > more)
        values[at] |= raw[starts[at] + more].astype(np.uint32) << np.uint32(8 * more)
    return values


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ids by rank, control bytes, data bytes): equally frequent ids rank by number."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    ranked = used[np.argsort(-counts[used], kind="stable")]
    rank = np.zeros(len(counts), np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    return (ranked.astype("<u4").tobytes(), *encode_values(rank[ids]))


def decode_block(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ranked, "<u4")[decode_values(control, data, n)]


# ---- files ----------------------------------------------------------------------------------------

_BLOCK = "shard int, block int, before long, n_docs int, n_ids long, doc_ids array<{key}>, lengths binary, ranked binary, control binary, data binary"


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS
) -> None:
    """Encode every text, append end_id and write blocks below path, in ascending order of key.

    Null keys come first; rows of one key follow in the order of their texts.  Null texts are empty and
    have the end id alone.  Repeated rows are all written.  An empty table writes no block.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    # the text's hash lets rows of one key go to several tasks
    ordered = rows.withColumn("mark", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(tasks_for(docs), F.col("key").asc_nulls_first(), "mark").sortWithinPartitions(F.col("key").asc_nulls_first(), "mark", "text").drop("mark")
    schema = T._parse_datatype_string(_BLOCK.format(key=kind.simpleString()))

    bound_batches(spark)

    def blocks(batches):
        take_worker("tokens")
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        held, keys, lengths, n = [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(held), enc.dtype)
            ranked, control, data = encode_block(ids)
            return pd.DataFrame([{
                "shard": shard, "block": block, "before": before, "n_docs": len(keys), "n_ids": n, "doc_ids": list(keys),
                "lengths": np.array(lengths, "<u4").tobytes(), "ranked": ranked, "control": control, "data": data,
            }])

        for pdf in batches:
            ids_of, texts = pdf["key"].astype(object).where(pdf["key"].notna(), None).tolist(), pdf["text"].tolist()
            for low in range(0, len(texts), TEXTS):
                for k, data in zip(ids_of[low : low + TEXTS], enc.encode(texts[low : low + TEXTS]), strict=True):
                    held += (data, end)
                    keys.append(k)
                    lengths.append(len(data) // enc.dtype.itemsize + 1)
                    n += lengths[-1]
                    if n >= block_ids:
                        yield flush()
                        before, block = before + n, block + 1
                        held, keys, lengths, n = [], [], [], 0
        if keys:
            yield flush()

    ordered.mapInPandas(blocks, schema).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per document of the files: key, start (ids of all before it), n_tokens, ids_crc32 and, if asked for, ids."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType
    # one row per shard, of which there are as many as the writing job had tasks
    sizes = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = {}, 0
    for shard in sorted(sizes):
        base[shard], total = total, total + sizes[shard]
    schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string("start long, n_tokens long, ids_crc32 long").fields])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def decode(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                ids = np.ascontiguousarray(decode_block(b.ranked, b.control, b.data, b.n_ids), "<u4")
                lengths = np.frombuffer(b.lengths, "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                starts, view = ends - lengths, memoryview(ids).cast("B") if len(ids) else memoryview(b"")
                out = {
                    "key": pd.Series(list(b.doc_ids), dtype=object), "start": base[b.shard] + b.before + starts, "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)],
                }
                if with_ids:
                    out["ids"] = [ids[a:z].astype(np.int64) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame(out)

    wanted = blocks.select("shard", "before", "n_ids", "doc_ids", "lengths", "ranked", "control", "data")
    return wanted.mapInPandas(decode, schema).withColumnRenamed("key", key)


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files to a shared folder and read them back without the ids."""
    path = f"{shared_dir(docs.sparkSession)}/tokens"
    write_token_files(docs, path, tokenizer, end_id, key, text)
    return read_token_files(docs.sparkSession, path, key, with_ids=False)
