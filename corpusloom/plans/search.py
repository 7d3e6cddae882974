"""One batch search from filters to ranked rows, step by step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import broadcast_checked, cut, ensure_checkpoint_dir
from corpusloom.operators import rank as R
from corpusloom.operators import retrieve as Q
from corpusloom.operators.index import Index
from corpusloom.plans.tables import Library

#: Indexes that this session has built, by the files they were built from.
_STORED: dict[tuple, Index] = {}
STREAM_K = 20
LIMIT = 10


class Search:
    """Search of all queries of a library; ids travel through ranking, text joins last."""

    def __init__(self, lib: Library, stream_k: int = STREAM_K, limit: int = LIMIT) -> None:
        self.lib = lib
        self.queries = lib.queries()
        self.stream_k = stream_k
        self.limit = limit

    def indexed(self) -> DataFrame:
        """Text and heading path of every passage are searched together."""
        return self.lib.passages().select(
            "chunk_id", "document_id", F.concat_ws(" ", "text", "source_name").alias("text"))

    def chunks(self) -> DataFrame:
        """Searched passages with title, day and type of their document; all come from one row, so nothing is joined."""
        return self.lib.titled_passages().select(
            "chunk_id", "document_id", F.concat_ws(" ", "text", "source_name").alias("text"), F.when(F.trim("title") != "", F.col("title")).alias("title"),
            F.date_diff("publication_date", F.lit("1970-01-01").cast("date")).alias("day"), "doc_type")

    def index(self) -> Index:
        """The stored index of the library; built where the documents' files are new to this session."""
        spark = self.lib.spark
        files = self.lib.read("documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        key = (id(spark), files.agg(F.bit_xor(F.xxhash64("*")), F.count("*")).first())
        if key not in _STORED:
            ensure_checkpoint_dir(spark)
            _STORED[key] = Index.build(self.chunks(), f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}")
        return _STORED[key]

    def sparse(self) -> DataFrame:
        """Lexical stream: the filters of a query hold before its top-k; statistics stay corpus-wide."""
        wanted = self.queries.filter("mode in ('sparse', 'hybrid')")
        return Q.title_tier_topk(self.index().titled(wanted, self.stream_k, self.lib.sources()), self.stream_k)

    def dense(self) -> DataFrame:
        """Vector stream under the same filters."""
        wanted = self.queries.filter("mode in ('dense', 'hybrid')")
        return Q.filtered_dense(
            self.lib.vectors(), wanted, self.lib.query_vectors(), self.lib.versions(), self.lib.sources(), self.stream_k)

    def streams(self) -> DataFrame:
        return self._flagged().drop("title_match")

    def _flagged(self) -> DataFrame:
        if not hasattr(self, "_streams"):
            sparse = self.sparse().select(
                "qid", F.lit("sparse").alias("stream"), "chunk_id", "score", "rank", (F.col("title_match") == 1).alias("title_match"))
            dense = self.dense().select(
                "qid", F.lit("dense").alias("stream"), "chunk_id", "score", "rank", F.lit(False).alias("title_match"))
            # k rows per query and stream: written once, read by promotion, fusion and ranking.
            self._streams = cut(sparse.unionByName(dense))
        return self._streams

    def promoted(self) -> DataFrame:
        return R.promote_parents(self.streams(), self.lib.chunk_rows())

    def fused(self) -> DataFrame:
        return R.fuse(self.promoted(), self.limit)

    def matches(self) -> DataFrame:
        """Title evidence of a candidate, or of the members it replaced."""
        hits = self._flagged().filter("title_match").select("qid", "chunk_id")
        parents = self.lib.passages().select("chunk_id", "parent_id").join(broadcast_checked(hits), "chunk_id").select(
            "qid", F.col("parent_id").alias("chunk_id"))
        return hits.unionByName(parents).distinct().withColumn("title_match", F.lit(True))

    def candidates(self) -> DataFrame:
        """Fused rows with text, title evidence and the default pair score."""
        fused = cut(self.fused())
        few = broadcast_checked(fused)
        rows = (
            self.lib.chunk_rows().join(few, "chunk_id")
            .join(self.lib.versions().select("document_id", "title"), "document_id")
            .join(broadcast_checked(self.queries.select("qid", F.col("text").alias("query"))), "qid")
            .join(self.matches(), ["qid", "chunk_id"], "left")
            .withColumn("title_match", F.coalesce("title_match", F.lit(False))))
        return rows.withColumn(
            "logit", R.overlap_logit(F.col("query"), R.document_text(F.col("title"), F.col("text"))))

    def reranked(self) -> DataFrame:
        return R.rerank(self.candidates())

    def results(self) -> DataFrame:
        return self.reranked().select(
            "qid", F.col("reranked").alias("rank"), "chunk_id", "document_id", "source_name", "page",
            F.get("evidence", F.lit(0))["stream"].alias("mode"), "rrf",
            F.round(F.coalesce("relevance", "rrf"), 6).alias("score"), "title_match")
