"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into cells of equal length. Shards sit on it at many virtual
nodes; a document belongs to the first node clockwise of the cell its id hashes
to, and goes on clockwise while the shard there is full. Which ranks of a cell go
where follows from the counts of the cells alone, so the driver sees one number
per cell (a constant number of cells), never a document.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.scale import cut
from corpusloom.llm.common import documents

CELL_BITS = 13
BINS = 4
NODES = 64


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise."""
    def place(shard: int, node: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big")

    points = sorted((place(s, v), s) for s in range(shards) for v in range(nodes))
    return [(p >> (64 - CELL_BITS), s) for p, s in points]


def plan(counts: list[tuple[int, int, int]], shards: int, slack: float = 0.0, nodes: int = NODES) -> list[tuple]:
    """(cell, bin, first rank, end rank, shard, first slot) from (cell, bin, rows).

    Without slack the capacities add up to the number of rows, so that all shards
    end within one row of each other; with it each holds (1 + slack) of the mean.
    """
    total = sum(n for _, _, n in counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    if slack > 0:
        room = [int(-(-total * (1 + slack) // shards))] * shards
    filled = [0] * shards
    points = ring(shards, nodes)
    following = list(range(1, len(points))) + [0]
    home: list[int] = []
    at = 0
    for cell in range(1 << CELL_BITS):
        while at < len(points) and points[at][0] < cell:
            at += 1
        home.append(at % len(points))

    def open_node(node: int) -> int:
        passed = []
        while filled[points[node][1]] >= room[points[node][1]]:
            passed.append(node)
            node = following[node]
        for p in passed:  # nobody stops at a full node again
            following[p] = node
        return node

    out = []
    for cell, part, rows in sorted(counts):
        rank, node = 0, home[cell]
        while rank < rows:
            node = open_node(node)
            shard = points[node][1]
            taken = min(rows - rank, room[shard] - filled[shard])
            out.append((cell, part, rank, rank + taken, shard, filled[shard]))
            filled[shard] += taken
            rank += taken
    return out


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slack: float = 0.0) -> DataFrame:
    """doc key, size, text_crc32, shard and slot of every row.

    Null texts have size 16 and checksum 0; a null key is a key like any other.
    Rows with the same key share a cell and may be parted where a shard is full.
    Repeated rows each take a slot. An empty table gives an empty result. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    spot = F.xxhash64(F.col(key))
    rows = cut(docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(spot, 64 - CELL_BITS).cast("int").alias("cell"), spot.alias("spot"),
    ).withColumn("bin", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(BINS)).cast("int")))
    counts = [tuple(r) for r in rows.groupBy("cell", "bin").count().collect()]  # at most cells x bins numbers
    kind = "cell int, bin int, lo long, hi long, shard int, slot0 long"
    segments = spark.createDataFrame(plan(counts, shards, slack), kind)
    order = Window.partitionBy("cell", "bin").orderBy("spot", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    return ranked.join(
        F.broadcast(segments),
        (ranked.cell == segments.cell) & (ranked.bin == segments.bin) & (ranked["rank"] >= segments.lo) & (ranked["rank"] < segments.hi),
    ).select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return shard(documents(spark, folder), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
