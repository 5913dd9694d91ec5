"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in native expressions.

The ring is cut into a fixed number of cells.  A key belongs to the cell of its hash, a cell to the
first virtual node clockwise, and no shard may take more than (1 + slack) times the mean number of
bytes: a cell that does not fit continues clockwise to the next shard that has room.  So no shard holds
less than the mean but for the slack of all others.  Only the bytes
and rows of each cell, a table of fixed size, reach the driver; rows never do.
"""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

CELLS = 16384
VIRTUAL_NODES = 128
SLACK = 1 / 4096
#: A cell of over CROWD rows is crowded with more than 1/CROWDED of a shard's bytes or 1/CROWDED_ROWS of all rows.
CROWD, CROWDED, CROWDED_ROWS = 64, 16, 256


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, in clockwise order."""
    return sorted(
        (zlib.crc32(f"shard {s} node {v}".encode()) * cells >> 32, s)
        for s in range(n_shards)
        for v in range(virtual_nodes)
    )


def place_cells(
    loads: dict[int, int],
    n_shards: int,
    virtual_nodes: int = VIRTUAL_NODES,
    slack: float = SLACK,
    cells: int = CELLS,
) -> list[int]:
    """The shard of every cell.  The largest cells go first; where none has room, the least loaded shard takes it."""
    nodes = ring(n_shards, virtual_nodes, cells)
    points = [p for p, _ in nodes]
    most = (1 + slack) * sum(loads.values()) / n_shards
    held = [0] * n_shards
    place = [0] * cells
    for cell in sorted(range(cells), key=lambda c: (-loads.get(c, 0), c)):
        first = bisect.bisect_left(points, cell)
        size, seen = loads.get(cell, 0), set()
        for i in range(len(nodes)):
            shard = nodes[(first + i) % len(nodes)][1]
            if shard in seen:
                continue
            seen.add(shard)
            if held[shard] + size <= most:
                break
            if len(seen) == n_shards:
                shard = min(range(n_shards), key=lambda s: (held[s], s))
                break
        place[cell] = shard
        held[shard] += size
    return place


def _usage(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """(bytes, rows) of each cell: at most `cells` entries, whatever the input."""
    return {r["cell"]: (r["size"], r["n"]) for r in rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}


def bounded_load_shards(
    docs: DataFrame,
    n_shards: int = 16,
    key: str = "doc_id",
    text: str = "text",
    virtual_nodes: int = VIRTUAL_NODES,
    slack: float = SLACK,
    cells: int = CELLS,
) -> DataFrame:
    """Return key, size, text_crc32, shard and slot of every row.

    size is the text's UTF-8 bytes plus 1 (null text: 1).  A null key is hashed by its text.  Rows of
    one key share a cell and so a shard; slots order them one after another.  Only the rows of a crowded
    cell, where a key is very frequent, are dealt to cells one by one, so that no shard and no task gets
    them all.  A cell larger than a shard's room goes to the least loaded shard.  An empty table gives
    no rows.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    ).withColumn("cell", F.pmod(F.xxhash64(F.col(key), F.when(F.col(key).isNull(), F.col("text_crc32"))), F.lit(cells)).cast("int"))
    usage = _usage(rows)
    total, n_rows = sum(s for s, _ in usage.values()), sum(n for _, n in usage.values())
    crowded = [c for c, (s, n) in usage.items() if n > CROWD and (s * CROWDED * n_shards > total or n * CROWDED_ROWS > n_rows)]
    if crowded:
        one_by_one = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)).cast("int")
        # stored, so that both uses below see the same cells
        rows = written(rows.withColumn("cell", F.when(F.col("cell").isin(crowded), one_by_one).otherwise(F.col("cell"))), f"{shared_dir(docs.sparkSession)}/rows")
        usage = _usage(rows)
    place = place_cells({c: s for c, (s, _) in usage.items()}, n_shards, virtual_nodes, slack, cells)
    base, filled = [], [0] * n_shards
    for c in range(cells):
        base.append(filled[place[c]])
        filled[place[c]] += usage.get(c, (0, 0))[1]
    entries = F.split(F.lit(",".join(f"{s}:{b}" for s, b in zip(place, base, strict=True))), ",")
    placed = (
        docs.sparkSession.range(1)
        .select(F.posexplode(entries).alias("cell", "entry"))
        .select("cell", F.split_part("entry", F.lit(":"), F.lit(1)).cast("int").alias("shard"), F.split_part("entry", F.lit(":"), F.lit(2)).cast("long").alias("base"))
    )
    within = Window.partitionBy("cell").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(placed), "cell")  # `cells` rows, a constant
        .select(key, "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).alias("slot"))
    )
