"""Helpers that keep a plan safe when one side or one key grows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when it is seen to hold at most ``max_rows`` rows and ``max_bytes`` bytes.

    The rows looked at are stored, so a small side is computed once. A larger side
    is returned unhinted: the join shuffles on its key and adaptive execution
    splits skewed partitions.
    """
    head = cut(df.limit(max_rows + 1))
    size = F.sum(F.length(F.to_json(F.struct("*"))) + 16 * len(df.columns))
    rows, size = head.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(head) if rows <= max_rows and size <= max_bytes else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names. Only a local master may do without one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corpusloom-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage of an iterative job with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, by: str) -> DataFrame:
    """``df`` written once as Parquet by the values of ``by``, below the shared checkpoint folder; a reader of one value reads no other."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_number(
    df: DataFrame, keys: list[str], order: list[Column], name: str
) -> DataFrame:
    """1-based position of every row inside its key, for keys of any size.

    A window would send a whole key to one task. Here rows are range-sorted by
    (key, order), numbered inside each range partition, and shifted by the
    number of earlier rows; only one counter per range partition and one minimum
    per key are aggregated.
    """
    ranged = cut(df.orderBy(*[F.col(k) for k in keys], *order))
    ids = F.monotonically_increasing_id()
    placed = ranged.select(
        "*",
        F.shiftright(ids, 33).cast("int").alias("_part"),
        F.bitwise_not(F.lit(-8589934592)).bitwiseAND(ids).alias("_pos"),
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn("_g", F.col("_pos") + F.col("_off"))
    if not keys:
        return numbered.withColumn(name, F.col("_g") + 1).drop("_part", "_pos", "_off", "_g")
    first = numbered.groupBy(*keys).agg(F.min("_g").alias("_first"))
    return (
        numbered.join(first, keys)
        .withColumn(name, F.col("_g") - F.col("_first") + 1)
        .drop("_part", "_pos", "_off", "_g", "_first")
    )


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of every key with ranks 1..k.

    The filter on ``row_number`` makes Spark keep k rows per key in every input
    partition before the exchange, so no key is ever moved whole.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
