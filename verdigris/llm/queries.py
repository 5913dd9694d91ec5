"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_ann, decontaminate, jaccard_join, language_id, license_scan, oracles, packing, sharding, suffix_dedup, tokens, url_reputation
from .common import table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
FOLDS = 5


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0
    model = language_id.train(docs.filter(~held_out))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; outcomes are the labels of the documents with the pages' ids."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    out = url_reputation.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that occur again, removed from every document, and the bytes of passages of some fifty words that do."""
    out = suffix_dedup.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=suffix_dedup.PASSAGE)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


def op5_bounded_load_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes."""
    out = sharding.bounded_load_shards(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles agree to nine tenths."""
    return jaccard_join.join_similar(table(spark, sf_dir, "documents"), words=3, percent=90)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written and read back."""
    import public_tokenizers

    return tokens.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document, and the words of the longest verbatim match."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", longest.alias("longest_match"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op10_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every twentieth."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return additive_ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_url_filter, op3_packing, op4_suffix_dedup, op5_bounded_load_ring, op6_jaccard_join, op7_token_files, op8_decontaminate, op9_license_scan, op10_additive_ann)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": oracles.URL_FILTER, "op4_suffix_dedup": oracles.SUFFIX_DEDUP, "op6_jaccard_join": oracles.JACCARD_JOIN, "op8_decontaminate": oracles.DECONTAMINATE, "op10_additive_ann": oracles.NEAREST}
