"""Registered queries against their SQL; all of them with CHECK_ALL=1."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
SOME = [
    "query_terms", "bm25_topk", "cosine_topk", "hybrid_search", "page_documents", "timeline", "patch", "ingest_decision",
    "state_transitions", "merge_filters", "text_blocks", "csv_batches", "markdown_blocks", "clean_text", "strip_repeated_blocks",
    "classify_doc", "annotate_slides", "sentence_units", "chunk_generic", "chunk_ids", "line_windows", "pack_context",
    "citation_compliance", "cache_ttl", "k_hop", "reply_parent", "mail_regions", "toc_detect", "chunk_slides", "stream_turns",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CHECK_ALL") else SOME


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(str(row[c]) for c in columns) for row in df.collect())
    relation = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(str(row[i]) for i in order) for row in relation.fetchall())
    assert got == want


def test_streams_read_tables_that_are_folders(spark, con, folder, tmp_path):
    for name in ("documents", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got = entry.queries()["stream_timeline"](spark, str(tmp_path)).select("notebook_id", "happened_at", "kind", "item_id", "n").collect()
    want = con.execute("SELECT notebook_id, happened_at, kind, item_id, n FROM (" + entry.oracle_sql()["stream_timeline"] + ")").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    whole, parts = (
        entry.queries()["stream_ingest"](spark, str(f)).select("content_hash", "status", "chunks").filter("status <> 'conflict'") for f in (folder, tmp_path))
    fresh = [sorted(map(tuple, rows.filter("chunks > 0").collect())) for rows in (whole, parts)]
    assert fresh[0] == fresh[1] and fresh[0]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_local_checkpoint_or_cross_join():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for base, _, files in os.walk(os.path.join(root, "corpusloom")):
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(base, name), encoding="utf-8") as handle:
                    text = handle.read()
                assert "localCheckpoint" not in text and "crossJoin" not in text, name
