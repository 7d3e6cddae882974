"""Token-budget context packing, citation markers and compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.expr import TokenCounter

# Leading items that are all or nothing, candidates per query.
MANDATORY = 3
MARKER = r"\[source:([1-9][0-9]*)\]"


def header(number: Column, row: dict[str, Column]) -> Column:
    """Header line of one context item; absent fields are left out."""
    heading = F.when(F.size(row["heading_path"]) > 0, F.concat(
        F.lit("heading="), X.json_text(F.array_join(row["heading_path"], " > "))))
    title = F.when(row["title"].isNotNull(), F.concat(F.lit("title="), X.json_text(row["title"])))
    page = F.when(row["page"].isNotNull(), F.concat(F.lit("page="), row["page"].cast("string")))
    return F.concat(F.concat_ws(
        " | ", F.concat(F.lit("=== Source ["), number.cast("string"), F.lit("]")),
        F.concat(F.lit("document_id="), row["document_id"]), F.concat(F.lit("version_id="), row["version_id"]),
        title, heading, page), F.lit(" ===\n"))


def overhead(system_prompt: Column, query: Column, history: Column, counter: TokenCounter = X.token_count) -> Column:
    return counter(F.concat(
        F.lit("SYSTEM\n"), system_prompt, F.lit("\nQUESTION\n"), query, F.lit("\nHISTORY\n"), history))


def build_context(
    queries: DataFrame, candidates: DataFrame, system_prompt: str, counter: TokenCounter = X.token_count
) -> DataFrame:
    """One row per query with its packed items.

    ``queries``: qid, query, budget. ``candidates``: qid, rank, chunk_id,
    document_id, version_id, title, heading_path, page, text; the ranked
    candidates of a query stand in one array. The first three items go in together or not at all; later ones are skipped if they
    do not fit. A source number takes one token whatever its digits, so costs do
    not depend on the selection.
    """
    fields = {c: F.col(c) for c in ("document_id", "version_id", "title", "heading_path", "page")}
    rendered = F.concat(header(F.lit(1), fields), F.col("text"))
    costed = candidates.withColumn("rendered", rendered).withColumn("c", counter(F.col("rendered"))).withColumn(
        "jc", counter(F.concat(F.lit("\n\n"), "rendered")))
    per_query = costed.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(
        "rank", "chunk_id", "document_id", "version_id", "title", "heading_path", "page", "text", "c", "jc"))).alias("items"))
    joined = queries.join(per_query, "qid", "left").withColumn(
        "overhead", overhead(F.lit(system_prompt), F.col("query"), F.lit(""), counter)).withColumn(
        "available", F.greatest(F.lit(0), F.col("budget") - F.col("overhead")))
    fold = f"""aggregate(items, cast(named_struct('i', 0, 'n', 0, 'taken', array()) as struct<i:int,n:int,taken:array<int>>),
        (s, x) -> if(s.i < {MANDATORY} or s.n + if(s.n = 0, x.c, x.jc) <= available,
            named_struct('i', s.i + 1, 'n', s.n + if(s.n = 0, x.c, x.jc), 'taken', array_append(s.taken, s.i)),
            named_struct('i', s.i + 1, 'n', s.n, 'taken', s.taken)))"""
    lead = f"aggregate(slice(items, 1, {MANDATORY}), 0, (n, x) -> n + if(n = 0, x.c, x.jc))"
    folded = joined.withColumn("f", F.expr(fold)).withColumn("lead", F.expr(lead))
    reason = (
        F.when(F.coalesce(F.size("items"), F.lit(0)) <= 0, "no_candidates")
        .when(F.col("overhead") >= F.col("budget"), "fixed_overhead_exhausted")
        .when(F.col("lead") > F.col("available"), "verbatim_prefix_does_not_fit"))
    judged = folded.withColumn("empty_reason", reason)
    return judged.withColumn(
        "taken", F.when(F.col("empty_reason").isNull(), F.col("f.taken")).otherwise(F.array().cast("array<int>"))).withColumn(
        "context_tokens", F.when(F.col("empty_reason").isNull(), F.col("f.n")).otherwise(0)).drop("f", "lead")


def context_items(context: DataFrame) -> DataFrame:
    """Selected items with source numbers 1..n and their rendered text."""
    picked = F.expr("transform(taken, i -> get(items, i))")
    rows = X.unfold(context, ["qid"], picked, "x", "pos")
    fields = {c: F.col(f"x.{c}") for c in ("document_id", "version_id", "title", "heading_path", "page")}
    number = (F.col("pos") + 1).alias("source_number")
    return rows.select(
        "qid", number, F.col("x.chunk_id").alias("chunk_id"), F.col("x.document_id").alias("document_id"),
        F.col("x.version_id").alias("version_id"), F.col("x.title").alias("title"), F.col("x.page").alias("page"),
        F.col("x.heading_path").alias("heading_path"), F.col("x.text").alias("content"), F.lit("verbatim").alias("kind"),
        F.concat(header(F.col("pos") + 1, fields), F.col("x.text")).alias("rendered"))


def markers(answers: DataFrame) -> DataFrame:
    """(answer_id, source_number, position): each source once, at its first marker."""
    found = F.regexp_extract_all("answer", F.lit(MARKER), F.lit(1))
    rows = X.unfold(answers, ["answer_id"], found, "number", "pos")
    first = rows.groupBy("answer_id", F.expr("try_cast(number as bigint)").alias("source_number")).agg(F.min("pos").alias("position"))
    return first


def marker_verdicts(answers: DataFrame) -> DataFrame:
    """Whether every exact-case source marker of an answer is well formed."""
    opened = F.regexp_count("answer", F.lit(r"\[source:"))
    formed = F.regexp_count("answer", F.lit(MARKER))
    return answers.select(
        "answer_id", opened.alias("opened"), formed.alias("formed"), (opened != formed).alias("malformed"))


def compliance(answers: DataFrame) -> DataFrame:
    """Publication verdict; ``answers``: answer_id, answer, n_items (sources 1..n)."""
    found = answers.withColumn("ms", F.regexp_extract_all("answer", F.lit(r"(?i)\[source:[0-9]*\]?"), F.lit(0)))
    judged = found.withColumn("codes", F.expr(r"""transform(ms, m -> CASE
        WHEN NOT m RLIKE r'^\[source:[1-9][0-9]*\]$' THEN 'noncanonical marker'
        WHEN try_cast(substring(m, 9, length(m) - 9) as bigint) is null
          OR cast(substring(m, 9, length(m) - 9) as bigint) > n_items THEN 'unavailable source' ELSE '' END)"""))
    first = F.get(F.filter("codes", lambda c: c != ""), F.lit(0))
    return judged.select(
        "answer_id", F.when(F.size("ms") == 0, "no marker").otherwise(F.coalesce(first, F.lit("ok"))).alias("verdict"))


def resolve(answers: DataFrame, items: DataFrame, prefix: str = "citation:v1:") -> tuple[DataFrame, DataFrame]:
    """Citation rows of answers (answer_id, qid, answer), and unknown markers.

    An answer with a malformed or unknown marker yields no citation at all.
    """
    found = markers(answers).join(answers.select("answer_id", "qid"), "answer_id")
    joined = found.join(items, ["qid", "source_number"], "left")
    unknown = joined.filter("chunk_id is null").select("answer_id", "source_number")
    bad = unknown.select("answer_id").unionByName(
        marker_verdicts(answers).filter("malformed").select("answer_id")).distinct()
    name = F.concat(F.lit(prefix), F.lower("answer_id"), F.lit(":"), F.col("source_number").cast("string"), F.lit(":"), "chunk_id")
    good = joined.filter("chunk_id is not null").join(bad, "answer_id", "left_anti")
    return good.select(
        X.uuid5(name).alias("citation_id"), "answer_id", "source_number", "position", "chunk_id", "document_id",
        "title", "page", F.col("content").alias("quote")), unknown
