"""Entity graph: upserts, lookups, hops and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import broadcast_checked, cut
from corpusloom.operators.library import upsert

CUT_EVERY = 3


def edge_id() -> Column:
    return F.concat_ws("_", "source_id", "relation", "target_id")


def upsert_edges(old: DataFrame, new: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Insert or replace edges by source, relation and target; weights stay in 0..1."""
    valid = (F.col("weight") >= 0) & (F.col("weight") <= 1)
    rejected = new.filter(~valid)
    keyed = new.filter(valid).withColumn("edge_id", edge_id())
    return upsert(old.withColumn("edge_id", edge_id()), keyed, ["edge_id"], order), rejected


def find_entities(entities: DataFrame, names: DataFrame, kind: str | None, documents: list[str] | None, limit: int) -> DataFrame:
    found = entities.join(broadcast_checked(names.select("name").distinct()), "name", "left_semi")
    if kind:
        found = found.filter(F.col("entity_type") == kind)
    if documents:
        found = found.filter(F.col("document_id").isin(documents))
    return found.orderBy("entity_id").limit(limit)


def k_hop(starts: DataFrame, edges: DataFrame, hops: int, relations: list[str] | None = None) -> DataFrame:
    """(start, node) pairs at the end of exactly ``hops`` outgoing edges."""
    frontier = starts.select(F.col("entity_id").alias("start"), F.col("entity_id").alias("node"))
    if hops < 1:
        return frontier.limit(0)
    steps = edges if relations is None else edges.filter(F.col("relation").isin(relations))
    steps = steps.select(F.col("source_id").alias("node"), "target_id").distinct()
    for hop in range(1, hops + 1):
        frontier = frontier.join(steps, "node").select("start", F.col("target_id").alias("node")).distinct()
        if hop % CUT_EVERY == 0 and hop < hops:
            frontier = cut(frontier)
    return frontier


def delete_document(entities: DataFrame, edges: DataFrame, documents: DataFrame, drop_dangling: bool = True) -> tuple[DataFrame, DataFrame]:
    """Entities without the documents' ones, and the edges that still have both ends."""
    gone = broadcast_checked(documents.select("document_id").distinct())
    kept = entities.join(gone, "document_id", "left_anti")
    if not drop_dangling:
        return kept, edges
    lost = entities.join(gone, "document_id", "left_semi").select("entity_id")
    left = edges.join(lost.withColumnRenamed("entity_id", "source_id"), "source_id", "left_anti").join(
        lost.withColumnRenamed("entity_id", "target_id"), "target_id", "left_anti")
    return kept, left.select(edges.columns)


def notebook_graph(sources: DataFrame, entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per notebook: entities of its documents, and edges with both ends inside."""
    members = sources.select("notebook_id", "document_id").distinct()
    nodes = entities.join(members, "document_id").select("notebook_id", "entity_id", "name", "entity_type")
    ends = nodes.select("notebook_id", "entity_id")
    inside = edges.join(ends.withColumnRenamed("entity_id", "source_id"), "source_id").join(
        ends.withColumnRenamed("entity_id", "target_id"), ["notebook_id", "target_id"])
    return nodes, inside.select("notebook_id", "source_id", "relation", "target_id")
