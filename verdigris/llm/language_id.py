"""Language identification with error-correcting output codes.

Every language has a binary codeword.  One linear classifier of hashed character n-grams per bit
predicts that bit; loss-weighted decoding picks the language whose codeword costs least over the
classifiers' margins, and a small gap to the runner-up flags the text as ambiguous.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, columns_of, parts_by_bytes, take_worker, unused

#: Bounds of the training sample: rows of each language, rows of all, and bytes of one text.
ROWS_PER_LANGUAGE = 300
MOST_ROWS = 3000
MOST_BYTES = 1 << 16
#: Hashed n-gram features, and the lengths of the n-grams in bytes.
FEATURES = 1 << 13
ORDERS = (2, 3, 4)
#: Least gap between the probabilities of the best and the second language; below it the text is ambiguous.
LEAST_MARGIN = 0.1
UNDETERMINED = "und"
_CHUNK = 1 << 19
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclasses.dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # features x bits
    bias: np.ndarray  # bits


def codewords(n: int, bits: int | None = None, seed: int = 7) -> np.ndarray:
    """n rows of -1 and 1.  Few languages get the exhaustive code, more the best of random dense codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        columns = [[1 - 2 * (c >> i & 1) for i in range(n)] for c in range(1 << n)]
        return np.array([c for c in columns if c[0] == 1 and -1 in c], float).T
    bits = bits or int(np.ceil(10 * np.log2(n)))
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        gap = (bits - np.abs(code @ code.T) + 2 * bits * np.eye(n)).min() if (np.abs(code.sum(0)) < n).all() else -1
        if gap > apart:
            best, apart = code, gap
    return best


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(joined bytes, first and last byte + 1 of every text) of lower-cased letters and single spaces; zeros part the texts."""
    apart = b"\0" * (max(ORDERS) - 1)
    data = [(" " + _NOT_LETTERS.sub(" ", t.lower()).strip() + " ").encode() for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    ends = np.cumsum(sizes + len(apart)) - len(apart)
    return np.frombuffer(apart.join([*data, b""]), np.uint8), ends - sizes, ends


def _grams(raw: np.ndarray, low: int, high: int) -> np.ndarray:
    """The bytes that start at each place from low to high, as many as the longest n-gram has, as one number."""
    packed = np.zeros(high - low + max(ORDERS), np.uint32)
    some = raw[low : high + max(ORDERS) - 1]
    packed[: len(some)] = some
    grams = packed[: high - low].copy()
    for k in range(1, max(ORDERS)):
        grams |= packed[k : high - low + k] << np.uint32(8 * k)
    return grams


def _hashed(grams: np.ndarray, order: int) -> np.ndarray:
    part = grams & np.uint32((1 << 8 * order) - 1)
    return ((part ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - FEATURES.bit_length() + 1)


def count_matrix(texts: list[str]) -> np.ndarray:
    """texts x FEATURES: n-gram counts, each row divided by its length."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, t in enumerate(texts):
        raw, _, ends = _letters([t])
        grams = _grams(raw, 0, int(ends[0]))
        for order in ORDERS:
            out[i] += np.bincount(_hashed(grams, order), minlength=FEATURES)
        out[i] /= max(1, len(grams))
    return out


def fit(texts: list[str], languages: list[str], steps: int = 120, rate: float = 0.5, ridge: float = 1e-4) -> Model:
    """Logistic classifiers, one per bit, by full-batch Adam on scaled n-gram rates."""
    names = sorted(set(languages))
    codes = codewords(len(names))
    if not names:
        return Model([], np.zeros((0, 1)), np.zeros((FEATURES, 1), np.float32), np.zeros(1))
    x = count_matrix(texts)
    scale = 1 / (np.sqrt((x * x).mean(0)) + 1e-4)
    x *= scale
    x /= np.sqrt(FEATURES)
    at = {name: i for i, name in enumerate(names)}
    rows = np.array([at[name] for name in languages])
    y = codes[rows]
    share = 1 / np.bincount(rows, minlength=len(names))[rows]
    share = (share / share.sum())[:, None]
    w, b = np.zeros((FEATURES, codes.shape[1]), np.float32), np.zeros(codes.shape[1])
    moment, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        margin = x @ w + b
        slope = -(y * share / (1 + np.exp(np.clip(y * margin, -40, 40)))).astype(np.float32)
        grad = x.T @ slope + ridge * w
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        w -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        b -= rate * slope.sum(0)
    return Model(names, codes, (w * scale[:, None] / np.sqrt(FEATURES)).astype(np.float32), b)


def margins(model: Model, texts: list[str]) -> np.ndarray:
    """texts x bits: the classifiers' margins over all n-grams of each whole text."""
    out = np.zeros((len(texts), len(model.bias)))
    columns = np.ascontiguousarray(model.weights.T)
    for part in parts_by_bytes(np.array([len(t) for t in texts], np.int64), _CHUNK):
        raw, starts, ends = _letters(texts[part])
        some = out[part]
        for low in range(0, len(raw), 2 * _CHUNK):  # a very long text goes in several
            high = min(low + 2 * _CHUNK, len(raw))
            a, b = int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(starts, high))
            if a == b:
                continue
            grams = _grams(raw, low, high)
            spans = np.stack([np.maximum(starts[a:b], low) - low, np.minimum(ends[a:b], high) - low], 1).ravel()
            for order in ORDERS:
                hashed = _hashed(grams, order)
                for bit in range(out.shape[1]):
                    some[a:b, bit] += np.add.reduceat(np.append(columns[bit][hashed], 0), spans, dtype=np.float64)[::2]
        some /= np.maximum(1, ends - starts)[:, None]
    return out + model.bias


def decode(model: Model, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, its probability, gap to the second) by least logistic loss over the codeword's bits."""
    loss = np.logaddexp(0, -margin[:, None, :] * model.codes[None]).sum(2)
    chance = np.exp(loss.min(1, keepdims=True) - loss)
    chance /= chance.sum(1, keepdims=True)
    best = loss.argmin(1)
    ordered = np.sort(chance, axis=1)
    second = ordered[:, -2] if chance.shape[1] > 1 else np.zeros(len(best))
    return best, ordered[:, -1], ordered[:, -1] - second


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Model:
    """Fit on a bounded sample: at most rows_per_language different texts of each language, most_rows in all, none of over most_bytes.

    Texts are picked by their hash, so any order of the input gives the same model, and copies count
    once.  Rows without a language, or whose text has no letter, teach nothing.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & (F.octet_length(F.col(text)) <= most_bytes) & F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    # different texts, nearly; the languages of most texts come first if there are too many
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("count")).orderBy(F.desc("count"), "lang").limit(max(1, most_rows // 10)).collect()
    each = min(rows_per_language, most_rows // max(1, len(counts)))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], min(1.0, 3 * each / max(1, r["count"]))).otherwise(share)
    picked = rows.withColumn("draw", F.xxhash64("text")).filter((F.pmod("draw", F.lit(1 << 30)) / (1 << 30)) < share).dropDuplicates(["lang", "draw", "text"])
    first = Window.partitionBy("lang").orderBy("draw", "text")
    sample = picked.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= each).select("text", "lang").toPandas()
    sample = sample.sort_values(["lang", "text"])
    return fit(sample["text"].tolist(), sample["lang"].tolist())


def identify(docs: DataFrame, model: Model, text: str = "text", least_margin: float = LEAST_MARGIN) -> DataFrame:
    """Add lang_pred, lang_score, lang_ambiguous to every row.

    Null texts and texts without a letter get `und` with score 0, not ambiguous; so does everything
    if the model has learnt no language.  All columns stay; columns of those three names are replaced.
    Map-only, whole texts.
    """
    new = ("lang_pred", "lang_score", "lang_ambiguous")
    docs = docs.drop(*new)
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x bits floats, a constant size

    @F.pandas_udf("lang_pred string, lang_score double, lang_ambiguous boolean")
    def predict(lettered: pd.Series, texts: pd.Series) -> pd.DataFrame:
        take_worker("language_id")
        m, n = shared.value, len(texts)
        names, score, doubt = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n, bool)
        if m.languages:
            at = np.flatnonzero(lettered.to_numpy(bool))
            if len(at):
                best, chance, gap = decode(m, margins(m, texts.iloc[at].tolist()))
                names[at], score[at], doubt[at] = np.array(m.languages, object)[best], chance, gap < least_margin
        return pd.DataFrame({"lang_pred": names, "lang_score": score, "lang_ambiguous": doubt})

    # not to be run again for a filter on its result
    got = predict.asNondeterministic()(F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}"), F.col(text))
    told = unused("told", docs)
    return docs.withColumn(told, got).select(*columns_of(docs), *[F.col(f"{told}.{c}") for c in new])
