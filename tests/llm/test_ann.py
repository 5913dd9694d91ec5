import numpy as np
import pandas as pd
import pytest

from verdigris.llm import additive_ann, queries


def brute(ids, x, k=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(1)
        s[i] = -np.inf
        best = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in best]
    return out


def recall_of(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for near in got.values():
        assert [g[0] for g in near] == list(range(1, 21))
        assert [(-g[2], g[1]) for g in near] == sorted((-g[2], g[1]) for g in near)
    return got, sum(len({v for v, _ in near} & {g[1] for g in got[q]}) for q, near in want.items()) / (20 * len(want))


def test_recall_against_brute_force(spark):
    data = "/root/testdata/sf0.01"
    pdf = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"].to_list()).astype(float)
    got, recall = recall_of(queries.op10_additive_ann(spark, data).orderBy("query_id", "rank").collect(), brute(ids, x))
    assert recall >= 0.95
    at = dict(zip(ids.tolist(), x, strict=True))
    assert all(abs(s - at[q] @ at[v]) < 1e-9 for q, g in got.items() for _, v, s in g)


@pytest.mark.parametrize("n", [20_000, 40_000])
def test_recall_of_unstructured_vectors_whatever_the_batches(spark, tmp_path, n):
    """Independent Gaussian components are the hardest case; two sizes, and the same rows for two sizes of batches."""
    x = np.random.default_rng(n).normal(size=(n, 32))
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}).to_parquet(tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    key, before, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    for batch in ("10000", "500"):
        spark.conf.set(key, batch)
        try:
            rows.append([tuple(r) for r in additive_ann.nearest(df, df.filter("vec_id % 400 = 0")).orderBy("query_id", "rank").collect()])
        finally:
            spark.conf.set(key, before)
    assert rows[0] == rows[1]
    got = [dict(zip(("query_id", "rank", "vec_id", "score"), r, strict=True)) for r in rows[0]]
    assert recall_of(got, brute(np.arange(n), x, every=400))[1] >= 0.95


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (40, [1.0]), (8, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    every = df.filter("vec_id % 20 = 0")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in additive_ann.nearest(df, every).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (0, 4, 8, -1.0), (20, 1, 2, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0), (20, 4, 8, -1.0)]
    assert additive_ann.nearest(df.limit(0), every).count() == 0
    assert additive_ann.nearest(df, every.limit(0)).count() == 0


def test_many_equal_vectors_and_query_blocks(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(5000 + i, [float(i), 0.0, 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = {}
    for r in additive_ann.nearest(df, df.filter("vec_id in (0, 1500, 2999, 5049)"), k=5, query_block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0][:5] == [5049, 5048, 5047, 5046, 5045]
    assert set(got) == {0, 1500, 2999, 5049}
    same = spark.createDataFrame(rows[:3000], "vec_id long, embedding array<double>").repartition(6)
    got = [r["vec_id"] for r in additive_ann.nearest(same, same.filter("vec_id = 1"), k=5).orderBy("rank").collect()]
    assert got == [0, 2, 3, 4, 5]


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(5).normal(size=(500, 16))
    books = additive_ann.fit(x, books=4, words=16)
    error = [((books.decode(books.encode(x, beam)) - x) ** 2).sum() for beam in (1, 8)]
    assert error[1] <= error[0]
    tables = additive_ann.lookup_tables(x[:7], books)
    codes = books.encode(x)
    assert np.allclose(additive_ann.scores(tables, codes), books.decode(codes) @ x[:7].T.astype(np.float32), atol=1e-3)
