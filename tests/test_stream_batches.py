"""Ingest batches take several small files, and decide as if the files had come one by one."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.streaming import jobs


def test_small_files_share_a_batch_and_older_files_come_first(spark, tmp_path, monkeypatch):
    table = tmp_path / "documents.parquet"
    table.mkdir()
    rows = {0: [(1, "same text " * 30, "late"), (2, "only here", "late")], 1: [(7, "same text " * 30, "early"), (8, "only here", "late")], 2: [(3, "same text " * 30, "early"), (4, None, None)]}
    for i, part in rows.items():
        frame = spark.createDataFrame(part, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
        frame.coalesce(1).write.parquet(f"{tmp_path}/part{i}")
        file = next((tmp_path / f"part{i}").glob("*.parquet"))
        os.rename(file, table / f"part-{i}.parquet")
        os.utime(table / f"part-{i}.parquet", (1_700_000_000 + (i == 0) * 100 + i, ) * 2)  # the first file came last

    folders = []
    monkeypatch.setattr(jobs, "work_folder", lambda spark, name: folders.append(f"{tmp_path}/{name}-{len(folders)}") or folders[-1])
    query = entry.queries()["stream_ingest"]
    got = sorted(tuple(r) for r in query(spark, str(tmp_path)).select("content_hash", "notebook_id", "decision", "status", "chunks").collect())
    assert len(os.listdir(f"{folders[0]}/checkpoint/commits")) and {x for x in os.listdir(f"{folders[0]}/status") if "=" in x} == {"batch=0"}
    assert {(r[1], r[2]) for r in got if r[4]} >= {("early", "new_document")} and ("late", "new_source") in {(r[1], r[2]) for r in got}
    # One file per batch, as bytes that no two files fit in, gives the same rows.
    monkeypatch.setattr(jobs, "INGEST_BYTES", 1)
    alone = query(spark, str(tmp_path)).select("content_hash", "notebook_id", "decision", "status", "chunks")
    assert sorted(map(tuple, alone.collect())) == got
    assert {x for x in os.listdir(f"{folders[1]}/status") if "=" in x} == {"batch=0", "batch=1", "batch=2"}
