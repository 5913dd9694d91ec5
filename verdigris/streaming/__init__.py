"""Programs over streams: compiled columns hold no state, so the same program runs on batches and streams."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.program import Program


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "parquet", **options) -> DataFrame:
    """A stream of the files that come into a folder."""
    return spark.readStream.format(kind).schema(schema).options(**options).load(folder)


def filter_stream(stream: DataFrame, program: Program) -> DataFrame:
    return program.filter(stream)


def windowed_counts(stream: DataFrame, program: Program, time: str, window: str, late: str) -> DataFrame:
    """Rows where the program is true, counted by windows of time; rows later than `late` are dropped.  An addition to the language."""
    return program.filter(stream).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is there as Parquet and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class DeadlineExceeded(TimeoutError):
    """An action took longer than its deadline."""


def with_deadline(spark: SparkSession, seconds: float, action: Callable[[], object]):
    """Run an action and cancel its Spark jobs after so many seconds."""
    sc, tag, over = spark.sparkContext, f"verdigris-{id(action)}", threading.Event()

    def stop():
        over.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        out = action()
    except Exception as e:
        if over.is_set():
            raise DeadlineExceeded(f"more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    if over.is_set():
        raise DeadlineExceeded(f"more than {seconds} s")
    return out
