import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import components, jaccard_join, queries


def near_copies(rng, n_base=12, copies=6, size=60):
    docs, vocabulary = [], [f"w{i}" for i in range(400)]
    for _ in range(n_base):
        base = rng.choice(vocabulary, rng.integers(1, size)).tolist()
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.integers(0, 1 + len(base) // 12)):
                words[rng.integers(0, len(words))] = str(rng.choice(vocabulary))
            docs.append(" ".join(words))
    return docs


ODD = [None, "", "  \n", "one", "One", "ONE two", "one\ttwo", "a b c d", "A  b\nc d", "x " * 3000, "x " * 3001, "same text here now ok", "same text here now ok"]


@pytest.mark.parametrize("words,percent,group_most", [(3, 90, 4096), (5, 80, 4096), (2, 60, 3), (1, 70, 5)])
def test_equals_brute_force(spark, words, percent, group_most):
    rng = np.random.default_rng(words * 100 + percent)
    docs = list(enumerate(near_copies(rng) + ODD))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, digest string, n int").repartition(4)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.join_similar(df, words, percent, group_most=group_most).collect()}
    want = brute.components(docs, words, percent, 100)
    assert got == want
    assert len({c for _, c in want.values()}) < len(docs) - 10
    kept = jaccard_join.keep_one(df, words, percent, group_most=group_most)
    assert kept.columns == df.columns
    assert sorted(r[0] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_failed_pairs_are_followed_up(spark, monkeypatch):
    # a histogram of one bin lets nearly every pair pass, so trees hold many pairs that fail
    monkeypatch.setattr(jaccard_join, "bins_for", lambda n, percent: 1 + n % 2)
    rng = np.random.default_rng(8)
    docs = list(enumerate(near_copies(rng, 4, 30, 80)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.join_similar(df, 3, 80).collect()}
    assert got == brute.components(docs, 3, 80, 100)


@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r[0]: (r[1], r[2]) for r in queries.op6_jaccard_join(spark, data).collect()}
    assert got == brute.components(docs, 3, 90, 100)


def test_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (7, "a b c d e f g"), (3, "other words in here today ok"), (3, "other words in here today ok"), (None, "lonely null key words here now")], "doc_id long, text string")
    got = sorted((r[0] or -1, r[2] or -1) for r in jaccard_join.join_similar(df).collect())
    assert got == [(-1, -1), (-1, 7), (3, 3), (3, 3), (7, 7)]
    assert jaccard_join.keep_one(df).count() == 3
    assert jaccard_join.join_similar(df.limit(0)).count() == 0
    assert jaccard_join.keep_one(df.limit(0)).count() == 0


def test_connected_components(spark, tmp_path):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (200, 150), (200, 160), (160, 170)]
    links = spark.createDataFrame([(b, a) if a % 3 else (a, b) for a, b in chain], "a long, b long")
    got = {r[0]: r[1] for r in components.connected_components(links, str(tmp_path / "c")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 150 for i in (150, 160, 170, 200)}
    assert components.connected_components(links.filter(F.lit(False)), str(tmp_path / "d")).count() == 0


def test_words_that_polynomials_confuse_are_told_apart(spark):
    """Thue-Morse words and their mirror images agree under any polynomial modulo 2**64."""
    word = lambda a, b, n=4096: "".join((a, b)[bin(i).count("1") % 2] for i in range(n))
    docs = [(1, f"one two {word('a', 'b')}"), (2, f"one two {word('b', 'a')}"), (3, word("a", "b")), (4, word("b", "a")), (5, word("a", "b"))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.join_similar(df, words=3, percent=90).collect()}
    assert got == brute.components(docs, 3, 90, 100) == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 3)}
