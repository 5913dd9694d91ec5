import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verdigris.llm import packing, queries, tokens

DATA = "/root/testdata/sf0.001"
NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXT = st.lists(st.sampled_from(["a", "Word", "it's", "don't", ",", ".", " ", "  ", "\n", "\n\n", "\t", " \n", "é", "ß", "漢字", "123", "!?", "<|endoftext|>", " ", "\x1c", "é", "ΑΣ", "ÀÉ", "ÿß,", "İ", "µ", "x.y,", "\r\n"]), max_size=14).map("".join)


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_the_ids_of_whole_texts(name):
    path = public_tokenizers.path(name)
    mine, whole = tokens.PieceEncoder(path), Tokenizer.from_file(path)

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(TEXT, max_size=3))
    def check(texts):
        for t, got in zip(texts, mine.encode(texts), strict=True):
            assert np.frombuffer(got, mine.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids

    check()
    assert mine.encode([None, ""]) == [b"", b""]


#: Texts in which cutting, lower case or joining could go wrong.
HARD = [
    "Word,Word,word!!WORD--\nWord", "ÀÉ,àé.ÄÖ\n\nÜ", "J\u030cK J\u030c, A\u0301B.\u0301", "x\u00d7y \u00f7z ×,÷", "\u212a \u017f İ I\u0307", "a" * 700 + "," + "b" * 700,
    "ab" * 400 + " " + "ba" * 400, "ÿ" * 300 + " " + "Ý" * 300, "don't,can't.'s", "tab\t,x\r\n.y", "q\u00a0,w\u2003.", "1,234.5-6\n7", "\u00aa,\u00ba.", "#tag @you $5 100%", "(a)(B)\"c\"", "end.\n", "\nstart", "  two", "a,\n b",
]


def thue_morse(n, a="a", b="b"):
    """A word and its mirror image, which polynomial hashes modulo powers of two confuse from a thousand letters on."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


HARD += [thue_morse(4096), thue_morse(4096, "b", "a"), f"{thue_morse(2048)} {thue_morse(2048, 'b', 'a')}"]


@pytest.mark.parametrize("name", NAMES)
def test_hard_texts_together_and_alone(name):
    path = public_tokenizers.path(name)
    mine, whole = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    assert mine.cuts
    want = [whole.encode(t, add_special_tokens=False).ids for t in HARD]
    for _ in range(2):
        assert [np.frombuffer(x, mine.dtype).tolist() for x in mine.encode(HARD)] == want
    assert [np.frombuffer(mine.encode([t])[0], mine.dtype).tolist() for t in HARD] == want
    for a in ("ÀÉ", "Word", "J"):
        for b in ("İ", "\u00a0", "\u030c", "ÄB", "c"):
            got = tokens.PieceEncoder(path).encode([a, b, a + b, b + a])
            assert [np.frombuffer(x, mine.dtype).tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in (a, b, a + b, b + a)]


def test_tokenizers_of_another_kind_encode_whole_texts(tmp_path):
    from tokenizers import pre_tokenizers

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "t.json"))
    mine = tokens.PieceEncoder(str(tmp_path / "t.json"))
    assert not mine.cuts
    assert [np.frombuffer(x, mine.dtype).tolist() for x in mine.encode(HARD)] == [other.encode(t, add_special_tokens=False).ids for t in HARD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40))
def test_coding_round_trip(values):
    control, data = tokens.encode_values(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert tokens.decode_values(control, data, len(values)).tolist() == values
    small = np.array(values, np.uint32) % 70000
    assert tokens.decode_block(*tokens.encode_block(small), len(small)).tolist() == small.tolist()


def expected(docs, path, end):
    tok, start, out = Tokenizer.from_file(path), 0, []
    for k, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [end], "<u4")
        out.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_equal_direct_encoding(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = sorted(tuple(r) for r in queries.op7_token_files(spark, DATA).collect())
    assert got == expected(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)


def test_files_odd_rows_and_small_blocks(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None, "null key"), (1, None), (2, ""), (3, "again"), (3, "again"), (4, "long word " * 20000), (5, "end")]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, start int, key string").repartition(3)
    tokens.write_token_files(docs, str(tmp_path / "t"), path, block_ids=5)
    got = sorted((tuple(r) for r in tokens.read_token_files(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    assert [r[:4] for r in got] == expected(rows, path, 2)
    assert got[1][4] == [2]
    tokens.write_token_files(docs.limit(0), str(tmp_path / "e"), path)
    assert tokens.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_differencing():
    assert sorted(np.bincount(packing.difference([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4]).tolist()) == [14, 16]
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (5, 7), (300, 20), (2000, 250)):
        sizes = rng.integers(1, 512, n).tolist()
        window = packing.difference(sizes, k)
        load = np.bincount(window, weights=sizes, minlength=k)
        assert len(window) == n and window.max() < k
        if n > 10 * k:
            assert load.max() - load.min() <= 16
    sizes = rng.integers(1, 512, 2000).tolist()
    window, k = packing.pack(sizes)
    assert np.bincount(window, weights=sizes).max() <= 2048 and k <= -(-sum(sizes) // 2048) + 2
    assert packing.pack([1500] * 3)[1] == 3


def check_packed(rows, docs, path):
    tok = Tokenizer.from_file(path)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for k, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    total = padded = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total, padded = total + at, padded + (0 if at & (at - 1) == 0 else 2048 - at)
    return padded / total


def test_packing_is_whole_and_tight(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        share = check_packed(queries.op3_packing(spark, sf).collect(), docs, path)
    assert share < 0.02


def test_packing_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(0, "null"), (1, None), (2, ""), (4, "long word " * 20000)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows] + [(7, "twice", 1), (7, "twice", 1)], "doc_id long, text string, length int")
    got = packing.pack_documents(docs, path).collect()
    check_packed(got, rows, path)
    assert sum(r["doc_id"] == 7 for r in got) == 2
    assert all(len(r["ids"]) == r["length"] for r in got)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_memory_of_packing_is_bounded_within_one_call():
    path = public_tokenizers.path("word_bpe_49k.json")
    # one batch of texts with ten words each that no other text has
    texts = [" ".join(f"q{chr(97 + i % 26)}{i // 26:x}w{j:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for j in range(10)) for i in range(60_000)]
    mine = tokens.PieceEncoder(path, packing.REMEMBERED, packing.CHUNK)
    got = mine.encode(texts)
    per_chunk = packing.CHUNK // 8
    assert len(mine.known) <= packing.REMEMBERED + per_chunk and len(mine.before) <= packing.REMEMBERED + per_chunk
    whole = Tokenizer.from_file(path)
    for i in (0, 31_234, 59_999):
        assert np.frombuffer(got[i], mine.dtype).tolist() == whole.encode(texts[i], add_special_tokens=False).ids
