"""Embedding tables: cache, hits and misses, vectorising."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.scale import top_per_key

DIMENSIONS = 64
Vectorise = Callable[[pd.Series], list]


def cache_key(text: Column, model: str) -> Column:
    return F.concat(F.sha2(text, 256), F.lit("::" + model))


def live_entries(cache: DataFrame, at: str) -> DataFrame:
    """Newest entry per key that has not expired at ``at``."""
    moment = F.lit(at).cast("timestamp")
    newest = top_per_key(cache, ["key"], [F.col("written").desc()], 1, "_n").drop("_n")
    return newest.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= moment))


def clear_namespace(cache: DataFrame, prefix: str) -> DataFrame:
    return cache.filter(~F.startswith("key", F.lit(prefix)))


def cache_lookup(texts: DataFrame, cache: DataFrame, model: str, at: str, dimensions: int) -> DataFrame:
    """Distinct keys of the texts with hit, miss or corrupt; each key appears once."""
    keys = texts.select(cache_key(F.col("text"), model).alias("key")).distinct()
    live = live_entries(cache, at).select("key", "dimensions", "vector")
    sound = (F.col("dimensions") == dimensions) & (F.size("vector") == F.col("dimensions"))
    return keys.join(live, "key", "left").withColumn(
        "status", F.when(F.col("vector").isNull(), "miss").when(sound, "hit").otherwise("corrupt"))


def hashed_buckets(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Sparse hashed term counts (text_id, bucket, n): the default vectoriser, native."""
    rows = texts.select("text_id", "text").repartition("text_id")
    terms = X.unfold(rows, ["text_id"], X.search_terms(F.col("text")), "term")
    bucket = F.conv(F.substring(F.md5(F.encode("term", "UTF-8")), 1, 6), 16, 10).cast("int") % dimensions
    return terms.groupBy("text_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def hashed_vectors(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(text_id, vector): unit vectors of the hashed term counts; a text without terms has zeros."""
    dense = hashed_buckets(texts, dimensions).groupBy("text_id").agg(
        F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("counts"))
    cell = lambda i: F.coalesce(F.element_at("counts", i) / F.col("norm"), F.lit(0.0)).cast("float")
    return texts.select("text_id").join(dense, "text_id", "left").select(
        "text_id", F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), cell).alias("vector"))


def embed_missing(texts: DataFrame, lookup: DataFrame, model: str, vectorise: Vectorise | None = None) -> DataFrame:
    """New cache entries for the missed keys: native hashed vectors, or one call of ``vectorise`` per Arrow batch.

    Every key is computed once; results are joined by key, not by position.
    """
    missing = lookup.filter("status <> 'hit'").select("key")
    first = texts.select(cache_key(F.col("text"), model).alias("key"), "text").join(missing, "key", "left_semi").dropDuplicates(["key"])

    if vectorise is None:
        return hashed_vectors(first.withColumnRenamed("key", "text_id")).select(
            F.col("text_id").alias("key"), F.size("vector").alias("dimensions"), "vector")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = vectorise(batch["text"])
            yield pd.DataFrame({"key": batch["key"], "dimensions": [len(v) for v in vectors], "vector": vectors})

    return first.mapInPandas(run, "key string, dimensions int, vector array<float>")


def dense_query(subqueries: DataFrame) -> DataFrame:
    """Text to embed per plan: the first dense or hybrid sub-query."""
    wanted = F.col("mode").isin("dense", "hybrid")
    return subqueries.groupBy("plan_id").agg(F.min_by("text", F.when(wanted, F.col("idx"))).alias("text"))
