import hashlib

import brute
import numpy as np
import pytest

from verdigris.llm import common, queries, suffix_dedup


def want(texts, length=400):
    return [(len((t or "").encode()), n, s, hashlib.sha256(k).hexdigest()) for t, (n, s, k) in zip(texts, brute.duplicated(texts, length), strict=True)]


def run(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, digest int")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeated(docs, **options).collect()}
    return [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))]


def random_texts(rng, n, alphabet, passages=6):
    some = ["".join(rng.choice(list(alphabet), rng.integers(20, 200))) for _ in range(passages)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(0, 6)):
            p = some[rng.integers(0, passages)]
            kind = rng.integers(0, 4)
            if kind == 0:
                p = "".join(rng.choice(list(alphabet), rng.integers(0, 60)))
            elif kind == 1:
                a = rng.integers(0, len(p))
                p = p[a : a + rng.integers(0, len(p))]
            elif kind == 2:
                a = rng.integers(0, len(p))
                p = p[:a] + "#" + p[a + 1 :]
            parts.append(p)
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("alphabet,group_most", [("abcdefghij é", 20000), ("ab", 20000), ("ab", 3), ("abcdefghij", 2)])
def test_equals_brute_force(spark, alphabet, group_most):
    rng = np.random.default_rng(len(alphabet) + group_most)
    texts = random_texts(rng, 60, alphabet) + ["a" * 300, "a" * 500, "ab" * 200, "", None, "same text " * 9, "same text " * 9, "short", "short"]
    assert run(spark, texts, length=40, gram=9, group_most=group_most) == want(texts, 40)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    out = {r["doc_id"]: r for r in queries.op4_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    got = {k: tuple(r)[1:5] for k, r in out.items()}
    assert got == dict(zip([r["doc_id"] for r in docs], want([r["text"] for r in docs]), strict=True))
    assert any(v[1] for v in got.values())
    passages = want([r["text"] for r in docs], suffix_dedup.PASSAGE)
    assert {k: r["n_repeated"] for k, r in out.items()} == {r["doc_id"]: p[1] for r, p in zip(docs, passages, strict=True)}


@pytest.mark.parametrize("hot,hot_rows", [(1000, 1_000_000), (1, 1_000_000), (20, 5)])
def test_hot_groups_and_clashing_names(spark, monkeypatch, hot, hot_rows):
    """Rows over HOT, groups that are hot by share or by number, and columns named like those used inside."""
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, copy = word(90), word(70)
    texts = [copy] * 400 + [word(20) + passage + word(20) for _ in range(300)] + [word(30) for _ in range(400)] + random_texts(rng, 60, "abcd")
    names = ["copies", "digest", "found", "warm", "size", "dealt", "group_0", "n_repeated"]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in enumerate(texts)], ["doc_id", "text", *names])
    rows = {r["doc_id"]: r for r in suffix_dedup.remove_repeated(docs, 40, 9).collect()}
    assert [tuple(rows[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))] == want(texts, 40)
    assert all([r[c] for c in names] == list(range(len(names))) for r in rows.values())


def test_long_texts_and_empty_table(spark):
    rng = np.random.default_rng(9)
    body = "".join(rng.choice(list("abcdefgh "), 200_000))
    texts = ["x" * 100_000, body, body[50_000:50_450] + "!", body[:399] + "?", "<" + body[1000:1400] + ">"]
    got = run(spark, texts)
    assert got == [
        (100_000, 100_000, 1, hashlib.sha256(b"").hexdigest()),
        (200_000, 450 + 400, 2, hashlib.sha256((body[:1000] + body[1400:50_000] + body[50_450:]).encode()).hexdigest()),
        (451, 450, 1, hashlib.sha256(b"!").hexdigest()), (400, 0, 0, hashlib.sha256(texts[3].encode()).hexdigest()),
        (402, 400, 1, hashlib.sha256(b"<>").hexdigest()),
    ]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeated(empty).count() == 0


def test_many_copies_of_a_passage_split_into_groups(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = word(90)
    texts = [word(50) + passage + word(50) for _ in range(300)]
    assert run(spark, texts, length=40, gram=9, group_most=20) == want(texts, 40)


def test_batches_and_levels_find_what_one_batch_finds():
    rng = np.random.default_rng(2)
    texts = [t.encode() for t in random_texts(rng, 80, "abc") if len(t) >= 40]
    text, at, least, largest, gram, _ = suffix_dedup.find_anchors(texts, 40, 9)
    contexts = [texts[t][a - big : a - small + 40] for t, a, small, big in zip(text, at, least, largest, strict=True)]
    group = gram.view(np.int64) >> 9
    whole = suffix_dedup.SuffixIndex(40, 9)
    whole.add(group, contexts, least, largest)
    parts = suffix_dedup.SuffixIndex(40, 9)
    for low in range(0, len(contexts), 7):
        s = slice(low, low + 7)
        parts.add(group[s], contexts[s], least[s], largest[s])
    assert (whole.repeated == parts.repeated).all() and whole.repeated.any()
    assert len(parts.levels) <= len(contexts).bit_length()
