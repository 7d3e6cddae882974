"""Registered ingest and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.chunk_plans import MAX, T
from corpusloom.plans.ingest import ingest, status
from corpusloom.plans.source_plans import _paths
from corpusloom.plans.sqlbase import oracle
from corpusloom.plans.tables import Library
from corpusloom.streaming import jobs


def ingest_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents as files of nine formats; Spanish ones are known already."""
    docs = Library(spark, d).documents()
    arriving = docs.select(_paths().alias("path"), F.encode("text", "UTF-8").alias("content"))
    known = docs.filter("lang = 'es'").select(F.col("doc_id").cast("string").alias("document_id"), F.sha2("text", 256).alias("content_hash"))
    return status(ingest(arriving, known, T, MAX))


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    stream = jobs.source(spark, d, "documents.parquet", batch_bytes=jobs.INGEST_BYTES).select(
        "doc_id", "text", "source", F.unix_micros("_metadata.file_modification_time").alias("filed"))
    return jobs.ingest_stream(stream, jobs.work_folder(spark, "ingest"), T, MAX)


def stream_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Documents in four files, one after another; what is known comes from keyed state alone."""
    folder = jobs.work_folder(spark, "decisions")
    docs = Library(spark, d).read("documents").select("doc_id", "text", "source")
    jobs.in_files(docs, f"{folder}/in", "doc_id", 4)
    stream = spark.readStream.schema("doc_id long, text string, source string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    jobs.run(jobs.decide_stream(stream), folder, lambda rows, i: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={i}"))
    return spark.read.schema(jobs.DECIDED).parquet(f"{folder}/out").select("content_hash", "arrival", "notebook_id", "decision")


def stream_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns in three files in order of arrival."""
    folder = jobs.work_folder(spark, "turns")
    turns = Library(spark, d).read("conversations").select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), (F.col("conv_id") * 100000 + F.col("turn")).alias("arrival"),
        "role", F.col("text").alias("content"), "turn")
    jobs.in_files(turns, f"{folder}/in", "turn", 3)
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    return jobs.turn_stream(stream, folder).select("session_id", "arrival", "role", "sequence")


def stream_timeline(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit("2024-02-01 00:00:00").cast("timestamp")
    docs = jobs.source(spark, d, "documents.parquet").select(
        F.col("source").alias("notebook_id"), (start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("happened_at"),
        F.lit("source_added").alias("kind"), F.col("doc_id").cast("string").alias("item_id"))
    talks = jobs.source(spark, d, "conversations.parquet").filter("turn = 0").select(
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("notebook_id"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("conv_id") * 3).cast("int"))).alias("happened_at"),
        F.lit("session_started").alias("kind"), F.col("conv_id").cast("string").alias("item_id"))
    return jobs.timeline_stream([docs, talks], jobs.work_folder(spark, "timeline"), 20).withColumn(
        "happened_at", F.date_format("happened_at", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {f.__name__: f for f in (ingest_documents, stream_ingest, stream_decisions, stream_turns, stream_timeline)}

ORACLES = {
    "stream_decisions": """SELECT sha256(coalesce(text, '')) AS content_hash, doc_id AS arrival, coalesce(source, '') AS notebook_id,
        CASE WHEN row_number() OVER (PARTITION BY sha256(coalesce(text, '')), source ORDER BY doc_id) > 1 THEN 'conflict'
             WHEN row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) > 1 THEN 'new_source' ELSE 'new_document' END AS decision
        FROM documents""",
    "stream_turns": """SELECT 's' || conv_id AS session_id, conv_id * 100000 + turn AS arrival, role,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sequence FROM conversations""",
    "stream_timeline": oracle("""
        SELECT notebook_id, strftime(happened_at, '%Y-%m-%d %H:%M:%S') AS happened_at, kind, item_id, CAST(n AS INTEGER) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY notebook_id ORDER BY happened_at DESC, kind, item_id) AS n FROM acts) WHERE n <= 20""",
        acts="""SELECT source AS notebook_id, TIMESTAMP '2024-02-01' + to_minutes(CAST(doc_id AS INTEGER)) AS happened_at, 'source_added' AS kind, CAST(doc_id AS VARCHAR) AS item_id FROM documents
            UNION ALL SELECT 'src' || conv_id % 20, TIMESTAMP '2024-02-01' + to_minutes(CAST(conv_id * 3 AS INTEGER)), 'session_started', CAST(conv_id AS VARCHAR) FROM conversations WHERE turn = 0"""),
}
