"""Incremental ingest, turns and timeline as Structured Streaming jobs.

What a batch must know of earlier ones is keyed state in a RocksDB store: the notebooks
that hold a content hash, the last number of a session. So the work of a batch does not
grow with history, and a replay or restart goes on from the state of the last batch that
was committed. Results of a batch are written below a folder of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.functions import expr as X
from corpusloom.functions.scale import cut, ensure_checkpoint_dir
from corpusloom.operators import chunk as H
from corpusloom.operators import library as B


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one job below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Bytes of files that an ingest batch takes, and one file at least: start and commit of a batch cost the same whatever it holds.
INGEST_BYTES = 128 << 20


def source(spark: SparkSession, folder: str, table: str, per_batch: int = 1, batch_bytes: int | None = None) -> DataFrame:
    """A Parquet table of ``folder``, a file or a folder of files, as a stream, a few files or so many bytes of files per batch."""
    schema = spark.read.parquet(f"{folder}/{table}").schema
    name, limit = ("maxFilesPerTrigger", per_batch) if batch_bytes is None else ("maxBytesPerTrigger", batch_bytes)
    # A pattern that fits the name alone: a plain path of a file would be taken for the root of partitions.
    return spark.readStream.schema(schema).option(name, limit).parquet(f"{folder}/{table[:-1]}[{table[-1]}]")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(stream: DataFrame, folder: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Process everything available, batch by batch, and stop. State goes to RocksDB."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, ROCKS)
    try:
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(
            availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(STORE, before)


class Deciding(StatefulProcessor):
    """What happens to arriving files of one content hash; state: the notebooks that hold it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One value, so that a key costs one read and one write; notebooks of a hash are few beside its files.
        self.books = handle.getValueState("books", "names array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # The text is the same in all rows of a hash: one is kept, of the others only number and notebook.
        text, files = None, []
        for row in rows:
            text = row.text if text is None else text
            files.append((row.filed, row.arrival is not None, row.arrival or 0, row.arrival, row.notebook_id))
        stored = self.books.get()
        held = set(stored[0]) if stored else set()
        before = len(held)
        for *_, arrival, book in sorted(files, key=lambda f: f[:3]):
            decision = "conflict" if book in held else "new_source" if held else "new_document"
            held.add(book)
            yield Row(content_hash=key[0], arrival=arrival, notebook_id=book, decision=decision, text=text if decision == "new_document" else None)
        if len(held) > before:
            self.books.update((sorted(held),))

    def close(self) -> None:
        pass


DECIDED = "content_hash string, arrival long, notebook_id string, decision string, text string"


def decide_stream(docs: DataFrame) -> DataFrame:
    """Stream of documents (doc_id, text, source) with the ingest decision; the text stays with new documents.

    A null text has the hash of an empty one, a null source is the notebook without a name. Of the files of
    one batch, those with a lower ``filed`` (a number, where the stream has it) came first.
    """
    filed = F.col("filed") if "filed" in docs.columns else F.lit(0)
    text = F.coalesce(F.col("text"), F.lit(""))
    files = docs.select(
        F.sha2(text, 256).alias("content_hash"), F.col("doc_id").cast("long").alias("arrival"), F.coalesce("source", F.lit("")).alias("notebook_id"), text.alias("text"),
        filed.cast("long").alias("filed"))
    return files.groupBy("content_hash").transformWithState(Deciding(), DECIDED, "Append", "None")


STATUS = "document_id string, content_hash string, notebook_id string, decision string, status string, chunks long"


def ingest_stream(docs: DataFrame, folder: str, target: int, maximum: int) -> DataFrame:
    """Stream of documents (doc_id, text, source) into status and chunk tables.

    A document whose hash was seen by an earlier batch, or earlier in this one,
    is not chunked again. No batch reads what earlier ones have written.
    """
    spark = docs.sparkSession

    def batch(rows: DataFrame, batch_id: int) -> None:
        decided = cut(rows.withColumn("document_id", X.uuid5(F.concat(F.lit("document:"), "content_hash"))))
        if decided.isEmpty():
            return
        # Hash by document once: it spreads a small batch and serves the packing too.
        fresh = decided.filter("decision = 'new_document'").select("document_id", "text").repartition("document_id")
        blocks = X.unfold(fresh, ["document_id"], X.lines(F.col("text")), "text", "ordinal").select(
            "document_id", "ordinal", F.when(F.length("text") < 60, "heading").otherwise("text").alias("kind"), "text",
            F.when(F.length("text") < 60, F.length("text") % 3 + 1).cast("int").alias("level"), F.lit(None).cast("int").alias("page"))
        limit = H.hard_max(target, maximum)
        good, refused = H.split_rejects(cut(H.generic_units(blocks, target, limit)), limit)
        H.pack(good, target, limit).write.mode("overwrite").parquet(f"{folder}/chunks/batch={batch_id}")
        counted = spark.read.parquet(f"{folder}/chunks/batch={batch_id}").groupBy("document_id").agg(F.count("*").alias("chunks"))
        fresh_only = F.col("decision") == "new_document"
        failed = refused.select("document_id").withColumn("failed", F.lit(True))
        decided.join(counted, "document_id", "left").join(failed, "document_id", "left").select(
            "document_id", "content_hash", "notebook_id", "decision",
            F.when(F.col("decision") == "conflict", "conflict").when(F.col("failed"), "failed").otherwise("indexed").alias("status"),
            F.when(fresh_only, F.coalesce("chunks", F.lit(0))).otherwise(0).cast("long").alias("chunks")).write.mode("overwrite").parquet(f"{folder}/status/batch={batch_id}")

    run(decide_stream(docs), folder, batch)
    return spark.read.schema(STATUS).parquet(f"{folder}/status").drop("batch")


class Numbering(StatefulProcessor):
    """Turns of one session numbered on; state: the last number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        turns = sorted(((r.arrival, r.role, r.content) for r in rows), key=lambda t: (t[0] is not None, t[0] or 0))
        start = self.last.get()[0] + 1 if self.last.exists() else 0
        for number, (arrival, role, content) in enumerate(turns, start):
            yield Row(session_id=key[0], arrival=arrival, role=role, content=content, sequence=number)
        self.last.update((start + len(turns) - 1,))

    def close(self) -> None:
        pass


TURNS = "session_id string, arrival long, role string, content string, sequence long"


def turn_stream(turns: DataFrame, folder: str) -> DataFrame:
    """Stream of turns (session_id, arrival, role, content) with sequence numbers, by session in order of arrival."""
    spark = turns.sparkSession

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/turns/batch={batch_id}")

    ready = turns.select("session_id", F.col("arrival").cast("long").alias("arrival"), "role", "content")
    run(ready.groupBy("session_id").transformWithState(Numbering(), TURNS, "Append", "None"), folder, batch)
    return spark.read.schema(TURNS).parquet(f"{folder}/turns").drop("batch")


def in_files(rows: DataFrame, folder: str, order: str, parts: int) -> str:
    """``rows`` as ``parts`` files or so in the order of a column, written one after another, for a stream to read."""
    marks = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx(order, marks, 1000).alias("q")).first()["q"] or []
    bounds = [None, *sorted(set(cuts)), None]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = rows if low is None else rows.filter(F.col(order) > low)
        part = part if high is None else part.filter(F.col(order) <= high)
        part.coalesce(1).write.mode("overwrite").parquet(f"{folder}/part={i}")
    return folder


def timeline_stream(activities: list[DataFrame], folder: str, limit: int) -> DataFrame:
    """Streams of activities (notebook_id, happened_at, kind, item_id) into one table.

    The newest rows are chosen when the table is read, so late rows need no
    watermark.
    """
    spark = activities[0].sparkSession
    stream = activities[0]
    for other in activities[1:]:
        stream = stream.unionByName(other)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/activities").option(
        "checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/activities")
    return B.top_per_key(rows, ["notebook_id"], [F.col("happened_at").desc(), F.col("kind"), F.col("item_id")], limit, "n")
