"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of several full-dimensional codebooks, fitted one after
another to what the codebooks before leave over.  Codes are found by beam search.  A query's lookup
table holds its inner products with all codewords, so a code's score is a sum of table entries; the
stored norm of the approximation turns it into a distance where that is asked for.  The best by this
score are ranked again by the original vectors in double precision.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, take_worker, written

#: Codebooks, codewords of each, and codes kept while encoding.
BOOKS, WORDS, BEAM = 8, 256, 4
#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 20_000
#: Queries searched for at once, vectors scored at once, and how many of these are ranked again exactly for each query.
QUERY_BLOCK, VECTOR_BLOCK, RERANK = 4096, 2048, 200


@dataclasses.dataclass
class Codebooks:
    words: np.ndarray  # books x words x dimensions

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes with the least squared error that a beam search finds."""
        n, books = len(x), len(self.words)
        left = x[:, None, :].astype(np.float32)  # what each kept code leaves over
        codes = np.zeros((n, 1, 0), np.uint8)
        for m in range(books):
            words = self.words[m]
            cost = (left * left).sum(2)[:, :, None] - 2 * (left @ words.T) + (words * words).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = best // len(words), best % len(words)
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
            left = left[rows, parent] - words[word]
        return codes[np.arange(n), (left * left).sum(2).argmin(1)]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([((centres * centres).sum(1) - 2 * part @ centres.T).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 11) -> Codebooks:
    """Codebooks of the residuals, in turn."""
    rng, left, out = np.random.default_rng(seed), sample.astype(np.float32), []
    for _ in range(books):
        out.append(_kmeans(left, words, rng))
        near = np.concatenate([((out[-1] ** 2).sum(1) - 2 * part @ out[-1].T).argmin(1) for part in np.array_split(left, max(1, len(left) // 4096))])
        left = left - out[-1][near]
    return Codebooks(np.stack(out))


def lookup_tables(queries: np.ndarray, books: Codebooks) -> np.ndarray:
    """books x words x queries: inner products of the queries with all codewords."""
    return np.einsum("mwd,qd->mwq", books.words, queries.astype(np.float32), optimize=True)


def scores(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """vectors x queries: the approximate inner products, by lookup."""
    total = tables[0][codes[:, 0]]
    for m in range(1, len(tables)):
        total += tables[m][codes[:, m]]
    return total


def valid_vectors(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part: not null, not zero, all components finite."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(key).alias("vec_id"), v.alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0)
    )


def build_index(vectors: DataFrame, path: str, key: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, beam: int = BEAM) -> tuple[DataFrame, Codebooks | None]:
    """Fit codebooks on a bounded sample and write (vec_id, vector, codes, norm) of every vector below path.

    The sample is drawn by a hash of the id.  Vectors must agree in length; those whose length is not
    the most frequent one of the sample are left out, as no inner product with the others exists.
    """
    rows = valid_vectors(vectors, key, embedding)
    n = rows.count()
    if n == 0:
        return written(rows.withColumns({"codes": F.lit(None).cast("binary"), "norm": F.lit(0.0)}), path), None
    share = int(min(1.0, 1.2 * sample / n) * (1 << 30))
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= share).select("vector").limit(2 * sample).toPandas()["vector"]
    if not len(drawn):  # a few rows, all with large hashes
        drawn = rows.select("vector").limit(sample).toPandas()["vector"]
    sizes = drawn.map(len)
    width = int(sizes.mode().iloc[0])
    books = fit(np.stack(drawn[sizes == width].to_list())[:sample])
    shared = rows.sparkSession.sparkContext.broadcast(books)  # books x words x dimensions floats, a constant size

    def encode(batches):
        take_worker("additive_ann")
        for pdf in batches:
            x = np.stack(pdf["vector"].to_list()) if len(pdf) else np.zeros((0, width))
            codes = np.concatenate([shared.value.encode(part, beam) for part in np.array_split(x, max(1, len(x) // 1024))])
            norm = (shared.value.decode(codes).astype(np.float64) ** 2).sum(1)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vector": pdf["vector"], "codes": [c.tobytes() for c in codes], "norm": norm})

    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("codes binary, norm double").fields])
    return written(rows.filter(F.size("vector") == width).mapInPandas(encode, schema), path), books


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the k best: highest score, then smallest id."""
    return np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]


def _blocks(batches, size: int):
    """The rows of some Arrow batches in frames of `size` rows, however they were cut; the last may be shorter."""
    held, n = [], 0
    for pdf in batches:
        at = 0
        while at < len(pdf):
            part = pdf.iloc[at : at + size - n]
            held.append(part)
            at, n = at + len(part), n + len(part)
            if n == size:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _search_block(index: DataFrame, shared, k: int, rerank: int) -> DataFrame:
    """Per query of one block, a broadcast (codebooks, ids, vectors), the k best of every part of the index."""

    def search(batches):
        take_worker("additive_ann")
        books, q_ids, q = shared.value
        tables = lookup_tables(q, books)
        top_score, top_id = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0, np.int64)
        least = max(k + 1, rerank)
        for part in _blocks(batches, VECTOR_BLOCK):
            part = part.sort_values("vec_id")
            x = np.stack(part["vector"].to_list())
            # of equal vectors only the k + 1 smallest ids can be among any query's k best
            _, group = np.unique(x, axis=0, return_inverse=True)
            group = group.ravel()
            order = np.argsort(group, kind="stable")
            nth = np.arange(len(order)) - np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1])[group[order]]
            keep = np.sort(order[nth <= k])
            x, ids = x[keep], part["vec_id"].to_numpy(np.int64)[keep]
            codes = np.frombuffer(b"".join(part["codes"].iloc[keep]), np.uint8).reshape(len(keep), -1)
            n, components = min(least, len(ids)), np.ascontiguousarray(x.T)
            score, found = np.empty((len(q), n)), np.empty((len(q), n), np.int64)
            for at in range(0, len(q), 256):
                block = slice(at, at + 256)
                rough = scores(tables[:, :, block], codes)
                near = np.argpartition(-rough, n - 1, axis=0)[:n].T
                exact = np.zeros(near.shape)
                for d in range(x.shape[1]):  # in the order of the components, as any plain sum
                    exact += components[d][near] * q[block, d, None]
                exact[ids[near] == q_ids[block, None]] = -np.inf
                score[block], found[block] = exact, ids[near]
            score, found = np.concatenate([top_score, score], 1), np.concatenate([top_id, found], 1)
            best = _best(score, found, k)
            top_score, top_id = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)
        if top_score.shape[1]:
            out = pd.DataFrame({"query_id": np.repeat(q_ids, top_score.shape[1]), "vec_id": top_id.ravel(), "score": top_score.ravel()})
            yield out[out["score"] > -np.inf]

    return index.select("vec_id", "vector", "codes").mapInPandas(search, _FOUND)


_FOUND = "query_id long, vec_id long, score double"


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 20,
    key: str = "vec_id",
    embedding: str = "embedding",
    rerank: int = RERANK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows found with the largest inner product, without the query's own id.

    Vectors that are null, zero or hold null or non-finite components take no part, as queries or as
    candidates; nor do rows with a null id.  Ties go to the smaller id.  Repeated rows with one id are
    candidates each.  queries default to all of vectors.  Queries are searched in blocks of bounded size,
    every block against all rows; each part of the index keeps k candidates of a query, which are written
    and meet by query.  Which rows are ranked again depends on the parts of the index, not on Arrow
    batches.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    where = shared_dir(spark)
    index, books = build_index(vectors, f"{where}/index", key, embedding)
    asked = valid_vectors(vectors if queries is None else queries, key, embedding)
    done = []
    if books is not None:
        width = books.words.shape[2]
        asked = asked.filter(F.size("vector") == width)
        blocks = max(1, -(-asked.count() * 5 // (4 * query_block)))
        for b in range(blocks):
            part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id", F.lit(b"block")), F.lit(blocks)) == b)
            pdf = part.dropDuplicates().toPandas()
            if not len(pdf):
                continue
            shared = spark.sparkContext.broadcast((books, pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["vector"].to_list())))  # about query_block vectors
            done.append(f"{where}/found{b}")
            _search_block(index, shared, k, rerank).write.parquet(done[-1])
            shared.destroy()
    found = spark.read.schema(_FOUND).parquet(*done) if done else spark.createDataFrame([], _FOUND)
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
