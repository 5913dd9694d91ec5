"""Sources of values: files of programs, tables, protobuf bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .programs import load_programs, save_programs
from .protobuf import Descriptor, Field, decode_messages

#: Settings that the meaning of programs depends on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "EXCEPTION",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Give the session the settings that programs need."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def check_session(spark: SparkSession) -> None:
    """Raise where a setting would change what programs mean."""
    for key, value in SETTINGS.items():
        got = spark.conf.get(key, "")
        if got.lower() != value.lower() and not (key == "spark.sql.session.timeZone" and got in ("UTC", "Etc/UTC", "GMT", "Z")):
            raise ValueError(f"{key} is {got!r}; programs need {value!r} (verdigris.sources.prepare sets it)")


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """A table of any format that Spark reads."""
    return spark.read.format(kind).options(**options).load(path)


__all__ = ["SETTINGS", "Descriptor", "Field", "check_session", "decode_messages", "load_programs", "prepare", "read", "save_programs"]
