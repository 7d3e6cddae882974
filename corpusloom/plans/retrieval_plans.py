"""Registered retrieval, fusion and ranking queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.scale import ensure_checkpoint_dir
from corpusloom.operators import quantise
from corpusloom.operators import rank as R
from corpusloom.operators import retrieve as Q
from corpusloom.operators.index import Index
from corpusloom.plans.search import LIMIT, STREAM_K, Search
from corpusloom.plans.sqlbase import oracle
from corpusloom.plans.tables import Library

K = 10
TERM = X.TERM_PATTERN


def bm25_sql(corpus: str, weight: float = 1.0) -> dict[str, str]:
    """CTEs that score every (query, chunk) of ``corpus``."""
    p = corpus
    return {
        f"{p}_terms": f"SELECT chunk_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM {p}",
        f"{p}_tf": f"SELECT chunk_id, term, count(*) AS tf FROM {p}_terms GROUP BY 1, 2",
        f"{p}_dl": f"SELECT chunk_id, len(regexp_extract_all(lower(text), '{TERM}')) AS dl FROM {p}",
        f"{p}_n": f"SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM {p}_dl",
        f"{p}_df": f"SELECT term, count(*) AS df FROM {p}_tf GROUP BY 1",
        "qterms": f"""SELECT qid, term, count(*) AS qtf FROM (
            SELECT qid, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM queries) GROUP BY 1, 2""",
        f"{p}_scored": f"""SELECT qid, chunk_id, round(sum(
            greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * qtf * tf * {weight} * 2.2
            / (tf * {weight} + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
          FROM qterms JOIN {p}_tf USING (term) JOIN {p}_df USING (term) JOIN {p}_dl USING (chunk_id), {p}_n
          GROUP BY qid, chunk_id""",
    }


INDEXED = "SELECT chunk_id, document_id, text || ' ' || source_name AS text FROM passages"
ALLOWED = """SELECT qid, document_id FROM queries q, versions v
  WHERE (date_after IS NULL OR (publication_date IS NOT NULL AND publication_date >= date_after))
    AND (date_before IS NULL OR (publication_date IS NOT NULL AND publication_date <= date_before))
    AND (doc_types IS NULL OR list_contains(doc_types, v.doc_type))
    AND (notebook_id IS NULL AND source_ids IS NULL OR EXISTS (SELECT 1 FROM sources s WHERE s.document_id = v.document_id
      AND (q.notebook_id IS NULL OR s.notebook_id = q.notebook_id) AND (q.source_ids IS NULL OR list_contains(q.source_ids, s.source_id))))"""
BM = {"indexed": INDEXED, **bm25_sql("indexed")}
TITLED = {
    **BM, **bm25_sql("titles", Q.TITLE_WEIGHT),
    "both_scored": """SELECT qid, chunk_id, max(score) AS score, CAST(max(title_match) AS INTEGER) AS title_match FROM (
        SELECT qid, chunk_id, score, 0 AS title_match FROM indexed_scored
        UNION ALL SELECT qid, chunk_id, score, 1 FROM titles_scored) GROUP BY 1, 2""",
}
DENSE = {
    "dense_scored": """SELECT qid, chunk_id, document_id, round(list_cosine_similarity(v.vec, q.vec), 6) + 0.0 AS score
        FROM vectors v, query_vectors q""",
}


def ranked(scored: str, k: int, order: str = "score DESC, chunk_id", by: str = "qid", name: str = "rank") -> str:
    return (f"SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS INTEGER) AS {name} "
            f"FROM {scored} QUALIFY {name} <= {k}")


STREAMS = {
    **TITLED, **DENSE,
    "allowed": ALLOWED,
    "sparse_allowed": """SELECT b.* FROM both_scored b JOIN passages USING (chunk_id)
        JOIN allowed a ON a.qid = b.qid AND a.document_id = passages.document_id""",
    "dense_allowed": "SELECT s.* FROM dense_scored s JOIN allowed USING (qid, document_id)",
    "tier": ranked("sparse_allowed", STREAM_K, "title_match DESC, score DESC, chunk_id", name="tier_no"),
    "sparse_stream": ranked("tier", STREAM_K),
    "dense_stream": ranked("dense_allowed", STREAM_K),
    "streams": """SELECT qid, 'sparse' AS stream, chunk_id, score, rank FROM sparse_stream JOIN queries USING (qid) WHERE mode IN ('sparse', 'hybrid')
        UNION ALL SELECT qid, 'dense', chunk_id, score, rank FROM dense_stream JOIN queries USING (qid) WHERE mode IN ('dense', 'hybrid')""",
    "placed": "SELECT s.*, parent_id FROM streams s LEFT JOIN (SELECT chunk_id, parent_id FROM chunk_rows WHERE parent_id IS NOT NULL) USING (chunk_id)",
    "sizes": "SELECT parent_id, count(*) AS size FROM chunk_rows WHERE parent_id IS NOT NULL GROUP BY 1",
    "present": "SELECT qid, stream, parent_id, count(*) AS present FROM placed WHERE parent_id IS NOT NULL GROUP BY ALL",
    "decided": """SELECT p.qid, p.stream, p.score, p.rank, coalesce(present * 2 >= size, false) AS promoted,
          CASE WHEN present * 2 >= size THEN p.parent_id ELSE p.chunk_id END AS chunk_id
        FROM placed p LEFT JOIN present USING (qid, stream, parent_id) LEFT JOIN sizes USING (parent_id)""",
    "promoted": """SELECT qid, stream, chunk_id, score, promoted,
          CAST(row_number() OVER (PARTITION BY qid, stream ORDER BY first_rank) AS INTEGER) AS rank FROM (
            SELECT qid, stream, chunk_id, min(rank) AS first_rank, arg_min(score, rank) AS score, bool_or(promoted) AS promoted
            FROM decided GROUP BY 1, 2, 3)""",
    "summed": """SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf,
          string_agg(stream || ':' || rank, ',' ORDER BY stream, rank) AS evidence, min(stream) AS first_mode
        FROM promoted GROUP BY 1, 2""",
    "fused": ranked("summed", LIMIT, "rrf DESC, chunk_id"),
    "matches": """SELECT qid, chunk_id, bool_or(title_match) AS title_match FROM (
          SELECT t.qid, t.chunk_id, t.title_match = 1 AS title_match FROM tier t
          UNION ALL SELECT t.qid, p.parent_id, t.title_match = 1 FROM tier t JOIN passages p USING (chunk_id)) GROUP BY 1, 2""",
    "candidates": f"""SELECT f.qid, f.chunk_id, f.rrf, f.rank, f.evidence, f.first_mode, c.page, c.text, c.document_id, c.version_id, c.source_name, v.title,
          coalesce(m.title_match, false) AND q.mode <> 'dense' AS title_match,
          list_distinct(regexp_extract_all(lower(q.text), '{TERM}')) AS asked,
          regexp_extract_all(lower(CASE WHEN trim(v.title) <> '' THEN 'Document title: ' || v.title || chr(10) || chr(10) || c.text ELSE c.text END), '{TERM}') AS found
        FROM fused f JOIN queries q USING (qid) JOIN chunk_rows c USING (chunk_id) JOIN versions v USING (document_id)
          LEFT JOIN matches m ON m.qid = f.qid AND m.chunk_id = f.chunk_id""",
    "logits": """SELECT * EXCLUDE (asked, found), round(8.0::DOUBLE * len(list_intersect(asked, found)) / greatest(len(asked), 1) - 4.0, 6) AS logit
        FROM candidates""",
    "relevances": "SELECT *, round(1.0 / (1.0 + exp(-logit)), 6) AS relevance FROM logits",
    "reranked": """SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY CAST(title_match AS INTEGER) DESC, relevance DESC, rank, chunk_id) AS INTEGER)
        AS reranked_no FROM relevances""",
}


def _query_terms(spark: SparkSession, d: str) -> DataFrame:
    return Q.query_terms(Library(spark, d).queries())


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    s = Search(Library(spark, d))
    return s.index().topk(s.queries.select("qid", "text"), K).select("qid", "chunk_id", "score", "rank")


def _filtered_bm25(spark: SparkSession, d: str) -> DataFrame:
    s = Search(Library(spark, d))
    return s.index().topk(s.queries, K, s.lib.sources()).select("qid", "chunk_id", "score", "rank")


def _filtered_dense(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return Q.filtered_dense(
        lib.vectors(), lib.queries(), lib.query_vectors(), lib.versions(), lib.sources(), K)


def _title_bm25(spark: SparkSession, d: str) -> DataFrame:
    s = Search(Library(spark, d))
    return Q.top_per_key(s.index().titled(s.queries.select("qid", "text"), K, tier=False), ["qid"], Q.by_score(), K)


def _title_tier(spark: SparkSession, d: str) -> DataFrame:
    s = Search(Library(spark, d))
    return Q.title_tier_topk(s.index().titled(s.queries.select("qid", "text"), K), K)


def _index_statistics(spark: SparkSession, d: str) -> DataFrame:
    """What the stored index knows of the query terms."""
    s = Search(Library(spark, d))
    return s.index().statistics(Q.query_terms(s.queries)).select("field", "term", F.col("df").cast("long"), F.col("n").cast("long"), X.rounded(F.col("mean")).alias("mean"))


def _refreshed(spark: SparkSession, d: str) -> DataFrame:
    """Search after changes of a stored index: some chunks came late, some were replaced, some deleted, and all merged.

    Texts alone are searched, so titles, days and types are not stored with them.
    """
    s = Search(Library(spark, d))
    doc = F.col("document_id").cast("long")
    early = s.indexed().filter(doc % 5 != 0).withColumn("text", F.when(doc % 5 == 1, F.concat(F.lit("draft "), F.reverse("text"))).otherwise(F.col("text")))
    ensure_checkpoint_dir(spark)
    index = Index.build(early, f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}")
    index = index.upsert(s.indexed().filter(doc % 5 <= 1)).delete(s.indexed().filter(doc % 5 == 2))
    changed = index.topk(s.queries.select("qid", "text"), K).withColumn("merged", F.lit(False))
    merged = index.merge().topk(s.queries.select("qid", "text"), K).withColumn("merged", F.lit(True))
    return changed.unionByName(merged).select("merged", "qid", "chunk_id", "score", "rank")


def _cosine(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return Q.dense_topk(lib.vectors(), lib.query_vectors(), K)


def _ann(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return quantise.topk(quantise.encode(lib.vectors()), lib.query_vectors(), K)


def _ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the approximate search finds nine tenths of the true neighbours with at most 30 % of the exact distances."""
    lib = Library(spark, d)
    coded = quantise.encode(lib.vectors())
    true = Q.dense_topk(lib.vectors(), lib.query_vectors(), K).select("qid", "chunk_id")
    found = quantise.topk(coded, lib.query_vectors(), K).select("qid", "chunk_id", F.lit(1).alias("hit"))
    recall = true.join(found, ["qid", "chunk_id"], "left").agg((F.count("hit") / F.count("*")).alias("recall"))
    measured = quantise.candidates(coded, lib.query_vectors(), K).agg(F.count("*").alias("measured"))
    pairs = coded.agg(F.count("*").alias("n")).join(lib.query_vectors().agg(F.count("*").alias("q")), F.lit(True))
    both = recall.join(measured, F.lit(True)).join(pairs, F.lit(True))
    return both.select((F.col("recall") >= 0.9).alias("recall_at_least_90"), (F.col("measured") <= 0.3 * F.col("n") * F.col("q")).alias("distances_at_most_30"))


def _violations(spark: SparkSession, d: str) -> DataFrame:
    """The combined streams with some ranks and ids spoiled on purpose."""
    streams = Search(Library(spark, d)).streams()
    spoiled = streams.withColumn("rank", F.when(F.col("qid") % 5 == 0, F.col("rank") + 1).otherwise(F.col("rank")))
    again = streams.filter("rank = 1 and qid % 5 = 1")
    return R.stream_violations(spoiled.unionByName(again), STREAM_K)


def _expand(spark: SparkSession, d: str) -> DataFrame:
    q = Library(spark, d).queries()
    q = q.withColumn("mode", F.when(F.col("qid") % 7 == 6, F.lit("graph")).otherwise(F.col("mode")))
    return R.expand_modes(q)


def _promote(spark: SparkSession, d: str) -> DataFrame:
    return Search(Library(spark, d)).promoted()


def _families(spark: SparkSession, d: str) -> DataFrame:
    """Children with parents moved, lost or turned on themselves by position."""
    chunks = Library(spark, d).chunk_rows()
    pos = F.col("ordinal") % 40
    spoiled = chunks.withColumn(
        "parent_id",
        F.when(F.col("parent_id").isNull(), None).when(pos == 37, F.col("chunk_id"))
        .when(pos == 38, F.concat(F.lit("gone-"), "parent_id"))
        .when(pos == 39, F.lit("0-p00000")).otherwise(F.col("parent_id")))
    return R.family_violations(spoiled)


def _evidence(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "evidence", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["stream"], e["rank"].cast("string"))), ","))


def _fuse(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(Search(Library(spark, d)).fused()).select("qid", "chunk_id", "rrf", "rank", "evidence")


def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Stream rows with their text; one stream of some queries carries other text."""
    s = Search(Library(spark, d))
    rows = s.streams().join(s.lib.passages().select("chunk_id", "text", "document_id"), "chunk_id").join(
        s.lib.versions().select("document_id", "title"), "document_id")
    changed = rows.withColumn(
        "text", F.when((F.col("stream") == "dense") & (F.col("qid") % 2 == 0), F.upper("text")).otherwise(F.col("text")))
    return R.snapshot_conflicts(changed.withColumn("title_match", F.col("stream") == "sparse"), ["chunk_id", "text"])


def _rerank(spark: SparkSession, d: str) -> DataFrame:
    return Search(Library(spark, d)).reranked().select(
        "qid", "chunk_id", "logit", "relevance", "below_threshold", "title_match",
        F.col("reranked").alias("rank"))


def _fallback(spark: SparkSession, d: str) -> DataFrame:
    """Scores are missing for one candidate of every third query."""
    s = Search(Library(spark, d))
    scores = s.candidates().select("qid", "chunk_id", "logit", "rank").filter(
        "not (qid % 3 = 0 and rank = 2)").drop("rank")
    ranked = s.candidates().select("qid", "chunk_id", "rank", "title_match")
    return R.rerank_or_keep(ranked, scores).select(
        "qid", "chunk_id", "relevance", "policy", F.col("reranked").alias("rank"))


def _rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    s = Search(Library(spark, d))
    plain = s.candidates().withColumn("title_match", F.lit(False))
    return R.rerank(plain, 5).select("qid", "chunk_id", "relevance", F.col("reranked").alias("rank"))


def _diverse(spark: SparkSession, d: str) -> DataFrame:
    return R.diverse_order(Search(Library(spark, d)).reranked()).select(
        "qid", "chunk_id", "source_name", "relevance", "diverse_rank")


def _search(spark: SparkSession, d: str) -> DataFrame:
    return Search(Library(spark, d)).results()


QUERIES = {
    "query_terms": _query_terms,
    "bm25_topk": _bm25,
    "filtered_bm25": _filtered_bm25,
    "title_bm25": _title_bm25,
    "title_tier_topk": _title_tier,
    "cosine_topk": _cosine,
    "filtered_dense": _filtered_dense,
    "ann_topk": _ann,
    "ann_recall": _ann_recall,
    "index_statistics": _index_statistics,
    "postings_refresh": _refreshed,
    "plan_expand": _expand,
    "stream_violations": _violations,
    "parent_promote": _promote,
    "family_violations": _families,
    "rrf_fuse": _fuse,
    "fusion_conflicts": _conflicts,
    "rerank": _rerank,
    "rerank_fallback": _fallback,
    "rerank_topk": _rerank_topk,
    "diverse_rank": _diverse,
    "hybrid_search": _search,
}

ORACLES = {
    "query_terms": oracle("SELECT qid, term, CAST(qtf AS INTEGER) AS qtf FROM qterms", qterms=BM["qterms"]),
    "bm25_topk": oracle(ranked("indexed_scored", K), **BM),
    "index_statistics": oracle("""
        SELECT 'text' AS field, term, df, n, round(avgdl, 6) AS mean FROM indexed_df, indexed_n WHERE term IN (SELECT term FROM qterms)
        UNION ALL SELECT 'title', term, df, n, round(avgdl, 6) FROM titles_df, titles_n WHERE term IN (SELECT term FROM qterms)""", **TITLED),
    "postings_refresh": oracle("SELECT merged, qid, chunk_id, score, rank FROM (" + ranked("indexed_scored", K) + "), (SELECT unnest([false, true]) AS merged)",
        indexed=INDEXED + " WHERE CAST(document_id AS BIGINT) % 5 <> 2", **bm25_sql("indexed")),
    "filtered_bm25": oracle(
        "SELECT qid, chunk_id, score, rank FROM picked",
        **BM, allowed=ALLOWED,
        inside="SELECT s.* FROM indexed_scored s JOIN passages USING (chunk_id) JOIN allowed a ON a.qid = s.qid AND a.document_id = passages.document_id",
        picked=ranked("inside", K)),
    "title_bm25": oracle(ranked("both_scored", K), **TITLED),
    "title_tier_topk": oracle(
        "SELECT * EXCLUDE (t) FROM (" + ranked("bounded", K) + ")", **TITLED,
        bounded=ranked("both_scored", K, "title_match DESC, score DESC, chunk_id", name="t")),
    "cosine_topk": oracle("SELECT * EXCLUDE (document_id) FROM (" + ranked("dense_scored", K) + ")", **DENSE),
    "ann_recall": "SELECT true AS recall_at_least_90, true AS distances_at_most_30",
    "filtered_dense": oracle(
        "SELECT qid, chunk_id, score, rank FROM picked", **DENSE, allowed=ALLOWED,
        inside="SELECT s.* FROM dense_scored s JOIN allowed USING (qid, document_id)", picked=ranked("inside", K)),
    "plan_expand": oracle("""
        SELECT qid, mode, unnest(CASE mode WHEN 'hybrid' THEN ['dense', 'sparse'] WHEN 'graph' THEN [NULL] ELSE [mode] END) AS stream,
          CASE WHEN mode = 'graph' THEN 'unsupported mode' END AS error
        FROM (SELECT qid, CASE WHEN qid % 7 = 6 THEN 'graph' ELSE mode END AS mode FROM queries)"""),
    "stream_violations": oracle(f"""
        SELECT qid, stream, chunk_id, 'repeated id' AS problem FROM spoiled GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT qid, stream, chunk_id, 'wrong rank' FROM numbered WHERE rank <> expected
        UNION ALL SELECT qid, stream, chunk_id, 'beyond k' FROM numbered WHERE expected > {STREAM_K}""",
        **STREAMS,
        spoiled="""SELECT qid, stream, chunk_id, score, CASE WHEN qid % 5 = 0 THEN rank + 1 ELSE rank END AS rank FROM streams
            UNION ALL SELECT qid, stream, chunk_id, score, rank FROM streams WHERE rank = 1 AND qid % 5 = 1""",
        numbered="SELECT *, row_number() OVER (PARTITION BY qid, stream ORDER BY score DESC, chunk_id) AS expected FROM spoiled"),
    "parent_promote": oracle("SELECT * FROM promoted", **STREAMS),
    "family_violations": oracle("""
        SELECT c.chunk_id, c.parent_id, CASE WHEN c.parent_id = c.chunk_id THEN 'own parent' WHEN p.document_id IS NULL THEN 'missing parent'
            WHEN p.document_id <> c.document_id THEN 'other document' WHEN p.version_id <> c.version_id THEN 'other version' END AS problem
        FROM bent c LEFT JOIN bent p ON p.chunk_id = c.parent_id WHERE c.parent_id IS NOT NULL AND problem IS NOT NULL""",
        bent="""SELECT * EXCLUDE (parent_id), CASE WHEN parent_id IS NULL THEN NULL WHEN ordinal % 40 = 37 THEN chunk_id
            WHEN ordinal % 40 = 38 THEN 'gone-' || parent_id WHEN ordinal % 40 = 39 THEN '0-p00000' ELSE parent_id END AS parent_id FROM chunk_rows"""),
    "rrf_fuse": oracle("SELECT qid, chunk_id, rrf, rank, evidence FROM fused", **STREAMS),
    "fusion_conflicts": oracle("""
        SELECT qid, chunk_id, count(DISTINCT sha256(concat_ws(chr(1), chunk_id, text))) AS snapshots, max(title) AS title,
          bool_or(stream = 'sparse') AS title_match FROM changed GROUP BY 1, 2""", **STREAMS,
        changed="""SELECT qid, chunk_id, stream, title, CASE WHEN stream = 'dense' AND qid % 2 = 0 THEN upper(text) ELSE text END AS text
            FROM streams JOIN passages USING (chunk_id) JOIN versions USING (document_id)"""),
    "rerank": oracle("""SELECT qid, chunk_id, logit, relevance, relevance < 0.4 AS below_threshold, title_match, reranked_no AS rank FROM reranked""", **STREAMS),
    "rerank_fallback": oracle("""
        SELECT qid, chunk_id, relevance, policy, CAST(row_number() OVER (PARTITION BY qid ORDER BY CAST(title_match AND policy = 'scored' AS INTEGER) DESC,
          coalesce(relevance, 0.0) DESC, fused_rank, chunk_id) AS INTEGER) AS rank
        FROM kept""", **STREAMS,
        holes="SELECT qid, chunk_id, title_match, rank AS fused_rank, CASE WHEN qid % 3 = 0 AND rank = 2 THEN NULL ELSE relevance END AS got FROM relevances",
        kept="""SELECT qid, chunk_id, title_match, fused_rank, CASE WHEN NOT bool_or(got IS NULL) OVER w THEN got END AS relevance,
            CASE WHEN bool_or(got IS NULL) OVER w THEN 'rrf_fallback' ELSE 'scored' END AS policy FROM holes WINDOW w AS (PARTITION BY qid)"""),
    "rerank_topk": oracle("""SELECT qid, chunk_id, relevance, CAST(row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, rank, chunk_id) AS INTEGER) AS place
        FROM relevances QUALIFY place <= 5""".replace("AS place", "AS rank_no").replace("place <= 5", "rank_no <= 5"), **STREAMS).replace("rank_no", "rank_out"),
    "diverse_rank": oracle("""
        SELECT qid, chunk_id, source_name, relevance, CAST(row_number() OVER (PARTITION BY qid ORDER BY
          CASE WHEN early THEN round_no ELSE 1000 END, CASE WHEN early THEN -titled END NULLS FIRST, CASE WHEN early THEN -best END NULLS FIRST,
          CASE WHEN early THEN source_name END NULLS FIRST, pure) AS INTEGER) AS diverse_rank FROM flagged""", **STREAMS,
        per_source="""SELECT *, row_number() OVER (PARTITION BY qid, source_name ORDER BY reranked_no) AS round_no, reranked_no AS pure,
            max(relevance >= 0.5) OVER (PARTITION BY qid, source_name) AS relevant,
            first_value(relevance) OVER (PARTITION BY qid, source_name ORDER BY reranked_no) AS best,
            max(CAST(title_match AS INTEGER)) OVER (PARTITION BY qid, source_name) AS titled FROM reranked""",
        counted="SELECT *, count(CASE WHEN relevant AND round_no = 1 THEN 1 END) OVER (PARTITION BY qid) AS n_sources FROM per_source",
        flagged="SELECT *, relevant AND round_no <= CASE WHEN n_sources <= 1 THEN 0 WHEN n_sources <= 2 THEN 2 ELSE 1 END AS early FROM counted"),
    "hybrid_search": oracle("""SELECT qid, reranked_no AS rank, chunk_id, document_id, source_name, page, first_mode AS mode, rrf, relevance AS score, title_match
        FROM reranked""", **STREAMS),
}
ORACLES["rerank_topk"] = oracle(
    "SELECT qid, chunk_id, relevance, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, rank, chunk_id) AS n FROM relevances) WHERE n <= 5",
    **STREAMS)
