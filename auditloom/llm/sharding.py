"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns several virtual nodes on a ring of ``cells`` hash cells. A row
goes to the shard that owns its cell; where that shard is full, it continues
clockwise to the next shard with room. Capacities differ by at most one row and
sum to the number of rows, so balance is exact, and a new shard moves only its
own share plus what overflows.

Only counts per cell (``cells`` rows, a fixed bound) reach the driver. The walk
around the ring turns them into ranges of ranks. Rows that are alike (doc_id, size,
checksum) are one group with a count, so a repeated row is no hot key; each group
finds its shards and slots by its ranks within its cell, in one window over
hash-dealt cells. The hash is of doc_id and checksum, so the texts of one doc_id
do not share a cell.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import materialize, read

SHARDS = 24
VIRTUAL_NODES = 64
CELLS = 1 << 14
#: Rows alike that are unfolded at once.
SPREAD = 10_000


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node in ring order; a tie goes to the smaller shard first."""
    return sorted((zlib.crc32(f"shard {s} node {v}".encode()) % cells, s) for s in range(shards) for v in range(virtual_nodes))


def walk(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank, shard, first slot) of each range of rows.

    Cells are served in ring order. A cell's rows go to the first virtual node
    at or after it whose shard has room, then on clockwise.
    """
    nodes = ring(shards, virtual_nodes, cells)
    at = [c for c, _ in nodes]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    # following[i]: the next node from i whose shard may have room, with path compression
    following = list(range(len(nodes)))

    def open_node(i: int) -> int:
        seen = []
        i %= len(nodes)
        while filled[nodes[i][1]] >= room[nodes[i][1]]:
            seen.append(i)
            i = (following[i] if following[i] != i else i + 1) % len(nodes)
        for j in seen:
            following[j] = i
        return i

    out = []
    for cell in sorted(counts):
        left, rank = counts[cell], 1
        node = bisect_right(at, cell - 1)
        while left:
            node = open_node(node)
            shard = nodes[node][1]
            take = min(left, room[shard] - filled[shard])
            out.append((cell, rank, rank + take - 1, shard, filled[shard]))
            filled[shard] += take
            rank += take
            left -= take
    return out


def assign_shards(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    Law ``rows``: counts of any two shards differ by one at most, whatever the
    sizes. Null texts count as empty, rows without doc_id are placed by their
    text, repeated rows get slots of their own, an empty table gives no rows. Equal
    places on the ring go to the smaller shard first.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(8)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    key = F.xxhash64("doc_id", "text_crc32")
    alike = ["doc_id", "size", "text_crc32"]
    groups = rows.groupBy(*alike).agg(F.count("*").alias("n")).withColumn("key", key).withColumn("cell", F.pmod("key", F.lit(cells)).cast("int"))
    groups = materialize(groups)
    counts = {r["cell"]: r["n"] for r in groups.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # at most `cells` rows
    ranges = spark.createDataFrame(walk(counts, shards, virtual_nodes, cells), "cell int, lo long, hi long, shard int, slot0 long")
    last = F.sum("n").over(Window.partitionBy("cell").orderBy("key", *alike).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = groups.withColumn("last", last).withColumn("first", F.col("last") - F.col("n") + 1)
    # ranges: one row per cell and one per filled shard at most, so its size is fixed by the parameters
    r, d = F.broadcast(ranges).alias("r"), ranked.alias("d")
    placed = d.join(r, (F.col("d.cell") == F.col("r.cell")) & (F.col("d.first") <= F.col("r.hi")) & (F.col("d.last") >= F.col("r.lo")))
    own = F.sequence(F.greatest("d.first", "r.lo"), F.least("d.last", "r.hi"), F.lit(SPREAD).cast("long"))
    stretches = placed.select(*[f"d.{c}" for c in alike], "r.shard", (F.col("r.slot0") - F.col("r.lo")).alias("shift"), F.least("d.last", "r.hi").alias("hi"), F.explode(own).alias("lo"))
    each = F.explode(F.sequence("lo", F.least(F.col("lo") + F.lit(SPREAD - 1), F.col("hi"))))
    return stretches.select(*alike, "shard", "shift", each.alias("rank")).select(*alike, F.lit("rows").alias("law"), "shard", (F.col("shift") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(read(spark, sf_dir, "documents"))
