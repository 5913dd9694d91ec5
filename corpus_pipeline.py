"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`.  Between stages the rows are written as Parquet and read again; a stage may delete what
earlier ones of the same thread left in the shared folder.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import decontaminate, jaccard_join, language_id, packing, suffix_dedup
from verdigris.llm.common import remove, set_aside, shared_dir, table, written

#: Folders of the stages that this thread has called, so runs in several threads leave each other's alone.
_OWN = threading.local()


def _folder(spark: SparkSession) -> str:
    """A folder for a stage's tables.  Those of earlier stages go, as what they led to is written by now."""
    _clear(spark)
    _OWN.left = [shared_dir(spark)]
    return _OWN.left[-1]


def _clear(spark: SparkSession) -> None:
    for path in getattr(_OWN, "left", []):
        remove(spark, path)
    _OWN.left = []


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: `und` and ambiguous ones go.  Learnt from the labelled rows of docs.

    Without any labelled row no language can be learnt; then all documents that have a letter stay.
    """
    model = language_id.train(docs)
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    packed, back = set_aside(docs, "text")
    told = language_id.identify(packed, model)
    return back(told.filter((F.col("lang_pred") != language_id.UNDETERMINED) & ~F.col("lang_ambiguous")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of those whose five-word shingles agree to four fifths."""
    return jaccard_join.keep_one(docs, path=_folder(spark))


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur again, strings of 240 bytes; documents of which nothing is left go.

    That many bytes hold some fifty words at most, so passages of more words go whole.  A character that
    is cut in two goes whole; n_chars counts what is left.
    """
    packed, back = set_aside(docs, "text")
    kept = suffix_dedup.remove_repeated(packed, suffix_dedup.PASSAGE, suffix_dedup.PASSAGE_GRAM, path=_folder(spark))
    kept = kept.filter((F.col("n_removed") == 0) | (F.octet_length("kept") > 0))
    text = F.when(F.col("n_removed") > 0, _readable(F.col("kept"))).otherwise(F.col("kept").cast("string"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col(f"{packed.columns[0]}.n_chars"))
    return back(kept, **new)


def _readable(body):
    """UTF-8 bytes as text, without the bytes of characters that were cut; U+FFFD of the text itself stays."""
    lead, broken = F.lit("\x01"), F.lit("\ufffd")
    marked = F.replace(F.replace(body.cast("string"), lead, F.lit("\x01A")), broken, F.lit("\x01B"))
    whole = F.replace(F.call_function("make_valid_utf8", marked), broken, F.lit(""))
    return F.replace(F.replace(whole, F.lit("\x01B"), broken), F.lit("\x01A"), lead)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with passages of the benchmark."""
    _clear(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 2048 tokens that hold all documents."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_strings),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages learn a model, follow links and cut strings, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`.  The last stage's input stays in the shared folder, as the result reads it."""
    path, docs, before = shared_dir(spark), table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"{path}/{name}")
            if before:
                remove(spark, before)
            before = f"{path}/{name}"
    return docs
