"""Stream contracts, parent promotion, fusion and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.scale import broadcast_checked, top_per_key

# Fusion constant, relevance and diversity thresholds.
RRF_K = 60
RELEVANCE_THRESHOLD = 0.4
DIVERSITY_THRESHOLD = 0.5


def expand_modes(queries: DataFrame) -> DataFrame:
    """(qid, stream): hybrid asks both streams; graph and parent are refused."""
    mode = F.col("mode")
    streams = F.when(mode == "hybrid", F.array(F.lit("dense"), F.lit("sparse"))).when(
        mode.isin("dense", "sparse"), F.array(mode))
    return queries.select("qid", "mode", F.explode_outer(streams).alias("stream")).withColumn(
        "error", F.when(F.col("stream").isNull(), F.lit("unsupported mode")))


def stream_violations(streams: DataFrame, k: int) -> DataFrame:
    """Rows that break a stream: repeated ids, wrong order or rank, more than k."""
    keys = ["qid", "stream"]
    numbered = streams.withColumn(
        "expected", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), "chunk_id")))
    repeated = streams.groupBy(*keys, "chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select(
        *keys, "chunk_id", F.lit("repeated id").alias("problem"))
    wrong = numbered.filter("rank <> expected").select(*keys, "chunk_id", F.lit("wrong rank").alias("problem"))
    excess = numbered.filter(F.col("expected") > k).select(*keys, "chunk_id", F.lit("beyond k").alias("problem"))
    return repeated.unionByName(wrong).unionByName(excess)


def promote_parents(streams: DataFrame, chunks: DataFrame) -> DataFrame:
    """Replace a family by its parent where at least half of it is in the stream.

    The parent takes the place and score of the family's first member; repeated
    ids keep their earliest place; ranks are renumbered.
    """
    families = chunks.filter("parent_id is not null").select("chunk_id", "parent_id")
    # The streams are the small side: find their families first, so that the chunk
    # table is only scanned.
    own = families.join(broadcast_checked(streams.select("chunk_id").distinct()), "chunk_id", "left_semi")
    placed = streams.join(own, "chunk_id", "left")
    touched = placed.select("parent_id").filter("parent_id is not null").distinct()
    sizes = families.join(broadcast_checked(touched), "parent_id", "left_semi").groupBy("parent_id").agg(
        F.count("*").alias("size"))
    present = placed.filter("parent_id is not null").groupBy("qid", "stream", "parent_id").agg(
        F.count("*").alias("present"))
    qualified = present.join(sizes, "parent_id").filter("present * 2 >= size").select(
        "qid", "stream", "parent_id", F.lit(True).alias("promoted"))
    decided = placed.join(qualified, ["qid", "stream", "parent_id"], "left")
    named = decided.withColumn("out_id", F.when(F.col("promoted"), F.col("parent_id")).otherwise(F.col("chunk_id")))
    first = named.groupBy("qid", "stream", "out_id").agg(
        F.min("rank").alias("first_rank"), F.min_by("score", "rank").alias("score"),
        F.max(F.coalesce("promoted", F.lit(False))).alias("promoted"))
    window = W.partitionBy("qid", "stream").orderBy("first_rank")
    return first.select(
        "qid", "stream", F.col("out_id").alias("chunk_id"), "score",
        F.row_number().over(window).alias("rank"), "promoted")


def family_violations(chunks: DataFrame) -> DataFrame:
    """Children whose parent is missing, nested in another document, or themselves."""
    child = chunks.filter("parent_id is not null").select("chunk_id", "document_id", "version_id", "parent_id")
    parent = chunks.select(
        F.col("chunk_id").alias("parent_id"), F.col("document_id").alias("p_doc"), F.col("version_id").alias("p_ver"))
    joined = child.join(parent, "parent_id", "left")
    problem = (
        F.when(F.col("parent_id") == F.col("chunk_id"), "own parent")
        .when(F.col("p_doc").isNull(), "missing parent")
        .when(F.col("p_doc") != F.col("document_id"), "other document")
        .when(F.col("p_ver") != F.col("version_id"), "other version"))
    return joined.select("chunk_id", "parent_id", problem.alias("problem")).filter("problem is not null")


def sibling_violations(chunks: DataFrame, siblings: DataFrame) -> DataFrame:
    """Stated sibling pairs (chunk_id, sibling_id) that are not symmetric or cross families, and pairs not stated.

    A pair is looked for from each chunk to the next of its family, around its
    end, so a family is never expanded into all its pairs. A chunk that states that
    pair but fewer siblings than its family has is reported as incomplete, without
    a sibling.
    """
    back = siblings.select(F.col("sibling_id").alias("chunk_id"), F.col("chunk_id").alias("sibling_id"))
    one_way = siblings.join(back, ["chunk_id", "sibling_id"], "left_anti").withColumn("problem", F.lit("not symmetric"))
    family = chunks.select("chunk_id", "parent_id")
    crossing = (
        siblings.join(family, "chunk_id")
        .join(family.select(F.col("chunk_id").alias("sibling_id"), F.col("parent_id").alias("other")), "sibling_id", "left")
        .filter(~F.col("parent_id").eqNullSafe(F.col("other")) | F.col("parent_id").isNull())
        .select("chunk_id", "sibling_id", F.lit("other family").alias("problem")))
    ring = W.partitionBy("parent_id").orderBy("chunk_id")
    following = chunks.filter("parent_id is not null").select(
        "chunk_id", F.coalesce(F.lead("chunk_id").over(ring), F.min("chunk_id").over(W.partitionBy("parent_id"))).alias("sibling_id"))
    missing = following.filter("chunk_id <> sibling_id").join(siblings, ["chunk_id", "sibling_id"], "left_anti").withColumn("problem", F.lit("missing"))
    member = family.filter("parent_id is not null").distinct()
    stated = (
        siblings.filter("chunk_id <> sibling_id").distinct().join(member, "chunk_id")
        .join(member.select(F.col("chunk_id").alias("sibling_id"), "parent_id"), ["sibling_id", "parent_id"])
        .groupBy("chunk_id", "parent_id").agg(F.count("*").alias("stated")))
    sizes = member.groupBy("parent_id").agg(F.count("*").alias("size"))
    incomplete = (
        member.join(sizes, "parent_id").join(stated, ["chunk_id", "parent_id"], "left")
        .filter(F.coalesce("stated", F.lit(0)) < F.col("size") - 1).join(missing, "chunk_id", "left_anti")
        .select("chunk_id", F.lit(None).cast("string").alias("sibling_id"), F.lit("incomplete").alias("problem")))
    return one_way.unionByName(crossing).unionByName(missing).unionByName(incomplete)


def fuse(streams: DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion over all streams of a query, cut after fusion.

    Evidence holds one entry per stream and is bounded by the number of streams.
    """
    summed = streams.groupBy("qid", "chunk_id").agg(
        X.rounded(F.sum(F.lit(1.0) / (F.col("rank") + RRF_K)), 12).alias("rrf"),
        F.array_sort(F.collect_list(F.struct("stream", "rank", "score"))).alias("evidence"))
    return top_per_key(summed, ["qid"], [F.col("rrf").desc(), F.col("chunk_id")], limit)


def snapshot_conflicts(results: DataFrame, digest: list[str]) -> DataFrame:
    """Ids that arrive with different content from different streams."""
    content = F.sha2(F.concat_ws("\u0001", *digest), 256)
    return results.groupBy("qid", "chunk_id").agg(
        F.count_distinct(content).alias("snapshots"),
        F.max("title").alias("title"),
        F.bool_or(F.coalesce("title_match", F.lit(False))).alias("title_match"))


def document_text(title: Column, text: Column) -> Column:
    return F.when(F.trim(title) != "", F.concat(F.lit("Document title: "), title, F.lit("\n\n"), text)).otherwise(text)


def overlap_logit(query: Column, text: Column) -> Column:
    """Default pair score: share of the query's distinct terms found in the text."""
    asked = F.array_distinct(X.search_terms(query))
    found = F.array_intersect(asked, X.search_terms(text))
    return X.rounded(F.lit(8.0) * F.size(found) / F.greatest(F.size(asked), F.lit(1)) - 4.0)


def rerank(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Order by title tier, relevance, fused rank and id; all candidates stay unless ``limit`` is given.

    ``candidates``: qid, chunk_id, rank, title_match, logit. A candidate without a
    logit keeps its fused place, and its policy says so.
    """
    scored = candidates.withColumn("relevance", X.rounded(X.sigmoid(F.col("logit"))))
    order = tier_order(F.coalesce(F.col("relevance"), F.lit(-1.0)))
    if limit is None:
        ranked = scored.withColumn("reranked", F.row_number().over(W.partitionBy("qid").orderBy(*order)))
    else:
        ranked = top_per_key(scored, ["qid"], order, limit, "reranked")
    return ranked.withColumn("below_threshold", F.col("relevance") < RELEVANCE_THRESHOLD)


def tier_order(relevance: Column) -> list[Column]:
    """Title matches first, then relevance, fused rank and id."""
    return [F.coalesce(F.col("title_match"), F.lit(False)).cast("int").desc(), relevance.desc(), F.col("rank"), F.col("chunk_id")]


def rerank_or_keep(fused: DataFrame, scores: DataFrame) -> DataFrame:
    """Rerank queries whose candidates are all scored; keep the fused order of the rest.

    ``fused``: qid, chunk_id, rank, title_match.
    """
    joined = fused.join(scores, ["qid", "chunk_id"], "left")
    unscored = joined.groupBy("qid").agg(F.bool_or(F.col("logit").isNull()).alias("unscored"))
    marked = joined.join(unscored, "qid").withColumn(
        "relevance", F.when(~F.col("unscored"), X.rounded(X.sigmoid(F.col("logit")))))
    tier = F.when(~F.col("unscored") & F.coalesce(F.col("title_match"), F.lit(False)), 1).otherwise(0)
    order = [tier.desc(), F.coalesce(F.col("relevance"), F.lit(0.0)).desc(), F.col("rank"), F.col("chunk_id")]
    return marked.withColumn("reranked", F.row_number().over(W.partitionBy("qid").orderBy(*order))).withColumn(
        "policy", F.when(F.col("unscored"), "rrf_fallback").otherwise("scored"))


def diverse_order(candidates: DataFrame) -> DataFrame:
    """Give every relevant source its best chunk first, then the pure order.

    ``candidates``: qid, chunk_id, source_name, relevance, title_match, rank. The
    windows are by query, over the candidates that fusion lets through.
    """
    query = W.partitionBy("qid")
    source = W.partitionBy("qid", "source_name")
    pure = [F.col("title_match").cast("int").desc(), F.col("relevance").desc(), F.col("rank"), F.col("chunk_id")]
    placed = (
        candidates.withColumn("pure", F.row_number().over(query.orderBy(*pure)))
        .withColumn("relevant", F.max(F.col("relevance") >= DIVERSITY_THRESHOLD).over(source))
        .withColumn("round", F.row_number().over(source.orderBy("pure")))
        .withColumn("best", F.first("relevance").over(source.orderBy("pure")))
        .withColumn("titled", F.max(F.col("title_match").cast("int")).over(source)))
    leaders = F.when(F.col("relevant") & (F.col("round") == 1), 1)
    counted = placed.withColumn("sources", F.count(leaders).over(query))
    rounds = F.when(F.col("sources") <= 1, 0).when(F.col("sources") <= 2, 2).otherwise(1)
    early = F.col("relevant") & (F.col("round") <= rounds)
    order = [
        F.when(early, F.col("round")).otherwise(F.lit(1000)),
        F.when(early, -F.col("titled")), F.when(early, -F.col("best")), F.when(early, F.col("source_name")),
        F.col("pure")]
    return counted.withColumn("diverse_rank", F.row_number().over(query.orderBy(*order)))
