"""Filters, plans and the projections that filters read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.scale import broadcast_checked

MAX_SUBQUERIES = 16
MAX_RESULTS = 100

# Signals that choose the answer template.
CROSS_SIGNALS = ["compare", "contrast", "across", "between", "connect with", "connects with"]
EXACT_PATTERN = (
    r"\b(?:exact|verbatim|precise)\b.*\b(?:text|verse|formula|equation|value|"
    r"measurement|estimate|tolerance|specification)\w*\b")
PASSAGE_PATTERN = r"\b(?:verse|chapter|section)\s+\d+(?:[.:]\d+)+\b"
DATA_SIGNALS = [
    "endpoint", "route", "function", "method", "class", "source code", "parameter", "http header",
    "csv", "table", "dataset", "row", "column", "record"]


def merge_filters(plans: DataFrame) -> DataFrame:
    """Intersect planned (p_*) and hard (h_*) filters; impossible ones carry an error."""
    after = F.greatest("p_after", "h_after")
    before = F.least("p_before", "h_before")

    def both(left: str, right: str) -> Column:
        return (F.when(F.size(left) == 0, F.col(right)).when(F.size(right) == 0, F.col(left))
                .otherwise(F.array_intersect(left, right)))

    def empty(left: str, right: str) -> Column:
        return (F.size(left) > 0) & (F.size(right) > 0) & (F.size(F.array_intersect(left, right)) == 0)

    error = (
        F.when(F.col("p_notebook") != F.col("h_notebook"), "notebook conflict")
        .when(after > before, "inverted dates")
        .when(empty("p_types", "h_types"), "empty doc_types")
        .when(empty("p_sources", "h_sources"), "empty source_ids"))
    return plans.select(
        "qid", F.coalesce("h_notebook", "p_notebook").alias("notebook_id"),
        after.alias("date_after"), before.alias("date_before"),
        both("p_types", "h_types").alias("doc_types"), both("p_sources", "h_sources").alias("source_ids"),
        error.alias("error"))


def validate_plans(subqueries: DataFrame) -> DataFrame:
    """Sub-queries (plan_id, idx, text, mode, filters, k) with normal text and error.

    Identity is the folded text with mode and filters; the counts per identity and
    per plan are aggregated, not windowed, so a large plan costs nothing extra.
    """
    normal = subqueries.withColumn("text", X.squeeze(F.col("text")))
    keyed = normal.withColumn("folded", F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")))
    identity = ["plan_id", "folded", "mode", "filters"]
    copies = keyed.groupBy(*identity).agg(F.count("*").alias("copies"))
    sizes = keyed.groupBy("plan_id").agg(F.count("*").alias("size"))
    joined = keyed.join(copies, identity).join(sizes, "plan_id")
    error = (
        F.when(F.col("text") == "", "empty query")
        .when(F.col("size") > MAX_SUBQUERIES, "too many sub-queries")
        .when((F.col("k") < 1) | (F.col("k") > MAX_RESULTS), "k out of range")
        .when(F.col("copies") > 1, "duplicate sub-query"))
    return joined.select("plan_id", "idx", "text", "mode", "k", error.alias("error"))


def retrieval_projection(versions: DataFrame, sources: DataFrame, digests: DataFrame) -> DataFrame:
    """Filter columns of every version, one row per membership.

    ``digests``: (version_id, ir_hash) of the stored block table; a version whose
    hash differs is reported instead of projected.
    """
    checked = versions.join(digests, "version_id", "left").withColumn(
        "error", F.when(F.col("ir_hash").isNull(), "no blocks").when(F.col("ir_hash") != F.col("content_hash"), "hash differs"))
    members = sources.select("document_id", "source_id", "notebook_id").distinct()
    return checked.join(members, "document_id", "left").select(
        "document_id", "version_id", "doc_type", "publication_date", "title", "source_id", "notebook_id", "error")


def refresh_memberships(
    projection: DataFrame, sources: DataFrame, changed: DataFrame, without_notebook: str | None = None
) -> DataFrame:
    """Rebuild memberships of the changed documents only; other rows pass through."""
    few = broadcast_checked(changed.select("document_id").distinct())
    kept = projection.join(few, "document_id", "left_anti")
    left = sources if without_notebook is None else sources.filter(F.col("notebook_id") != without_notebook)
    members = left.select("document_id", "source_id", "notebook_id").distinct()
    versions = projection.join(few, "document_id", "left_semi").drop("source_id", "notebook_id").distinct()
    return kept.unionByName(versions.join(members, "document_id", "left").select(projection.columns))


def title_projection(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """One title row per chunk of a version whose title is not blank."""
    titled = versions.filter(F.trim("title") != "").select("version_id", "title")
    return chunks.select("chunk_id", "document_id", "version_id").join(titled, "version_id")


def answer_template(query: Column) -> Column:
    """Route by the wording of the query; the first rule that fits wins."""
    q = F.lower(query)

    def any_of(words: list[str]) -> Column:
        found = F.contains(q, F.lit(words[0]))
        for word in words[1:]:
            found = found | F.contains(q, F.lit(word))
        return found

    return (
        F.when(any_of(CROSS_SIGNALS), "cross_document")
        .when(F.rlike(q, F.lit(EXACT_PATTERN)) | F.rlike(q, F.lit(PASSAGE_PATTERN)), "exact_passage")
        .when(any_of(DATA_SIGNALS), "code_table").otherwise("grounded"))
