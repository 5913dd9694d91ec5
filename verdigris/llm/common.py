"""Helpers shared by the operators: shared folders, inputs, and byte-level numpy kernels."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a folder of our own only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = _OWN_DIRS.setdefault("base", tempfile.mkdtemp(prefix="verdigris-"))
    return f"{base.rstrip('/')}/verdigris-{uuid.uuid4().hex}"


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like the one given that no column of the frames has, in any case of letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list:
    """All columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def set_aside(docs: DataFrame, text: str):
    """(docs with all columns but the text in one, a function that gives the columns back from what an operator made of it).

    So an operator's new columns replace none of docs.  The function takes columns to put in others' places.
    """
    own = unused("row", docs)
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in others] or [F.lit(0).alias("none")]).alias(own), text)

    def back(out: DataFrame, **new) -> DataFrame:
        return out.select(*[(new[c] if c in new else F.col(text) if c == text else F.col(own).getField(c)).alias(c) for c in docs.columns])

    return packed, back


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back: cuts lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch; rows are whole texts, so Spark's own default of ten thousand takes much memory.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let workers hold smaller batches of texts, unless the session has limits of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_HOLDER: list[str] = [""]
_LETTING_GO: list = []


def lets_go(clear) -> None:
    """Register what empties a memory that a worker keeps from task to task."""
    _LETTING_GO.append(clear)


def take_worker(name: str) -> None:
    """A worker that goes on to another operator lets go of what the last one kept."""
    if _HOLDER[0] == name:
        return
    if _HOLDER[0]:
        for clear in _LETTING_GO:
            clear()
        gc.collect()
        give_back()
    _HOLDER[0] = name


def give_back() -> None:
    """Return to the system what this process has freed; its allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps or returns memory as it likes
        pass


def _tables_below(path: str) -> str:
    """The first letters of the names of the tables that bucketed() keeps below a folder of shared_dir()."""
    return "verdigris_" + (re.findall(r"verdigris-([0-9a-f]{32})", path) or [re.sub(r"\W", "_", path)])[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark writes to, and the catalog's entries for tables in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    for r in spark.sql(f"SHOW TABLES LIKE '{_tables_below(path)}*'").collect():
        found = spark.sql(f"DESCRIBE TABLE EXTENDED `{r['namespace']}`.`{r['tableName']}`").filter("col_name = 'Location'").first()
        if found and f"{spark._jvm.org.apache.hadoop.fs.Path(found['data_type']).toUri().getPath()}/".startswith(f"{place.toUri().getPath()}/"):
            spark.sql(f"DROP TABLE IF EXISTS `{r['namespace']}`.`{r['tableName']}`")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver notice which shuffles are over, so that their files go; they stay until it collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Stored bytes of input that one task should get at most.
TASK_BYTES = 128 << 20
#: Buckets that Spark lets a table have, by its own default.
MOST_BUCKETS = 100_000


def tasks_for(df: DataFrame) -> int:
    """As many tasks as the session shuffles by, or more where what df is read from is large."""
    size, least = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), shuffle_partitions(df.sparkSession)
    return max(least, -(-size // TASK_BYTES)) if size < 1 << 50 else least  # Spark takes unknown sizes for larger ones


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def digest(column):
    """128-bit content digest of a string column, as 16 bytes."""
    return F.unhex(F.md5(column.cast("binary")))


def bucketed(df: DataFrame, key: str, path: str, buckets: int) -> DataFrame:
    """Write df bucketed by key below path, so later joins on that key move only their other side.

    The catalog's entry goes when remove() deletes the folder.
    """
    name = f"{_tables_below(path)}_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def distinct_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One row per different text: digest, text, copies, tid (a number of its own).

    Copies are combined before the shuffle.  Bucketed by digest; null texts count as empty.
    """
    base = docs.select(text_or_empty(text).alias("text")).select(digest(F.col("text")).alias("digest"), "text")
    one = base.groupBy("digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    one = one.withColumn("tid", F.monotonically_increasing_id())
    return bucketed(one, "digest", path, min(MOST_BUCKETS, tasks_for(docs)))


#: A group counts as hot with more than 1/HOT of all rows, of which there are fewer than HOT, or with more than HOT_ROWS.
HOT, HOT_ROWS = 1000, 1_000_000


def is_hot(size, total: int):
    """Whether groups of that size are hot among so many rows; at most max(HOT, total / HOT_ROWS) are."""
    return size > min(total / HOT, HOT_ROWS)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, names: list[str], total: int | None = None) -> DataFrame:
    """rows and the columns `names` of the one row of groups with their keys; rows without one go.

    groups has the number of rows of each key in column `size`.  Rows of hot keys join a broadcast of
    few groups (see is_hot) and are dealt evenly, not by key.  groups must be cheap to compute twice or
    stored.  Columns of rows may have any names but the keys' and those in `names`.
    """
    total = rows.count() if total is None else total
    found, warm = unused("found", rows), unused("warm", rows)
    own = [unused(f"group_{i}", rows) for i in range(len(keys))]
    packed = groups.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(size).alias(unused("size", rows)), F.struct(*names).alias(found))
    out = [F.col(f"{found}.{n}").alias(n) for n in names]
    same = [F.col(k) == F.col(o) for k, o in zip(keys, own, strict=True)]
    if total < HOT:
        return rows.join(packed, same).select(*columns_of(rows), *out)
    size = F.col(unused("size", rows))
    hot = packed.filter(is_hot(size, total)).select(*own, F.col(found).alias(warm))
    cold = packed.filter(~is_hot(size, total)).select(*own, found)
    marked = rows.join(F.broadcast(hot), same, "left").drop(*own)
    # rows of hot keys get keys of their own; one that meets a group by chance does no harm, as its own group is known
    dealt = unused("dealt", rows)
    number = F.monotonically_increasing_id()
    kind = dict(rows.dtypes)[keys[0]]
    alone = F.xxhash64(number) if kind == "bigint" else F.concat(F.lit("\u0000hot "), number.cast("string")).cast(kind)
    marked = marked.withColumn(dealt, F.when(F.col(warm).isNotNull(), alone).otherwise(F.col(keys[0])))
    joined = marked.join(cold, [F.col(dealt) == F.col(own[0]), *same[1:]], "left")
    got = F.coalesce(F.col(warm), F.col(found))
    return joined.withColumn(found, got).filter(F.col(found).isNotNull()).select(*columns_of(rows), *out)


def covered(spans, low: str, high: str):
    """How many places an array of spans covers; they may overlap."""
    return F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s[high] - F.greatest(a["to"], s[low]))).cast("long").alias("n"),
            F.greatest(a["to"], s[high]).alias("to")),
    )["n"]


# ---- numpy kernels over concatenated bytes ---------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(1 << max(12, n - 1).bit_length(), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class RollingHash:
    """Prefix hashes of a byte array: the 64-bit hash of any slice in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * up[: len(data)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[k:] - self.sums[:n]) * self.down[:n])


def parts_by_bytes(sizes: np.ndarray, most: int):
    """Slices of consecutive rows holding at most `most` bytes each (or one row)."""
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and held + n > most:
            yield slice(at, i)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield slice(at, len(sizes))
