"""Delimited files against the standard reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scale
from corpusloom.sources import delimited


def plain(text, name):
    if not text.strip():
        return []
    dialect = delimited.sniff(text[:2048], name.endswith(".tsv"))
    rows = list(csv.reader(io.StringIO(text), delimiter=dialect[0], quotechar=dialect[1], doublequote=dialect[2], skipinitialspace=dialect[3]))
    width = max(map(len, rows))
    return [r + [""] * (width - len(r)) for r in rows]


def scanned(spark, files):
    lines = delimited.lines_of(spark.createDataFrame(list(files.items()), "file_id string, text string"))
    rows, rejects = delimited.scan(lines)
    got = {f: [] for f in files}
    for r in rows.orderBy("file_id", "row_no").collect():
        got[r.file_id].append(r.cells)
    return got, {r.file_id: r.reason for r in rejects.collect()}


@pytest.mark.parametrize("block", [3, 4096])
def test_scan_equals_the_standard_reader(spark, monkeypatch, block):
    """Quoted line breaks cross block boundaries anywhere."""
    monkeypatch.setattr(delimited, "BLOCK", block)
    rng = random.Random(block)
    files = {"empty.csv": "", "white.csv": "   \n\t  ", "short.csv": "name,age\nAlice,30\nBob,25\nCharlie", "tabs.tsv": "name\tage\nAlice\t30\nBob\t25", "one.csv": "just"}
    for i in range(12):
        out = io.StringIO()
        writer = csv.writer(out, delimiter=rng.choice(",;|"), lineterminator="\n")
        for _ in range(rng.randint(2, 40)):
            writer.writerow([rng.choice(["plain", "two words", 'quo"te', "line\nbreak", 'a\n"b"\n,c', "", " x", "1.5", "semi;colon"]) for _ in range(rng.randint(1, 4))])
        files[f"f{i}.csv"] = out.getvalue() + rng.choice(["", "tail", 'half"open', "\n\nafter blank"])
    got, rejects = scanned(spark, files)
    assert got == {name: plain(text, name) for name, text in files.items()} and not rejects


def test_quotes_that_never_close_reject_a_long_file(spark):
    files = {"bad.csv": 'a,b\n1,"open\n' + "x,y\n" * 40_000, "good.csv": "a,b\n1,2"}
    got, rejects = scanned(spark, files)
    assert got == {"bad.csv": [], "good.csv": [["a", "b"], ["1", "2"]]} and list(rejects) == ["bad.csv"]


def test_delimited_files_and_mail_reach_chunks(spark):
    """The ingest chain reads tables and mailboxes; what it cannot read is a reject with a reason."""
    from corpusloom.plans import ingest

    box = ("From a@x.org Mon\nFrom: A <a@x.org>\nSubject: First letter of all\n\nBody of the first letter, long enough to be a chunk of its own.\n\n"
           "From b@x.org Tue\nFrom: B <b@x.org>\nSubject: Second\n\nAnother body with words of its own, that nobody else has said here.\n")
    files = {"a.csv": 'name,note\nAda,"one\ntwo"\nBob', "b.mbox": box, "c.mbox": "no separator", "d.csv": b"\xff\xfe", "e.bin": "x", "f.csv": "a,b\n1,2\r3,4"}
    rows = [(n, c if isinstance(c, bytes) else c.encode()) for n, c in files.items()]
    contents = spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "path string, content binary")
    none = spark.createDataFrame([], "document_id string, content_hash string")
    made = ingest.ingest(contents, none, 100, 200)
    status = {r.path: (r.status, r.reason) for r in ingest.status(made).collect()}
    assert status["a.csv"] == status["b.mbox"] == ("indexed", None)
    assert status["c.mbox"] == ("failed", "no message in this mailbox") and status["d.csv"] == ("failed", "not valid UTF-8")
    assert status["e.bin"] == ("failed", "unsupported format") and status["f.csv"] == ("failed", "File is not valid CSV.")
    texts = {r.document_id: r.text for r in made["chunks"].collect()}
    assert texts["a.csv"] == "name note Ada one two Bob"  # cells are joined as text
    assert any("first letter" in r.text for r in made["chunks"].filter("document_id = 'b.mbox'").collect())
    done = ingest.finish(made)["chunks"].filter("document_id = 'b.mbox'").orderBy("ordinal").collect()
    assert [r.ordinal for r in done] == list(range(len(done))) and len({r.chunk_id for r in done}) == len(done) > 0
    assert all(r.tokens >= 15 and r.sibling_ids == [] for r in done)


def operators(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_files_cost_no_python_call_each(spark):
    """States of lines are windows; batches of files with one block come from one Arrow pass over rows of blocks."""
    from corpusloom.sources import tabular

    lines = delimited.lines_of(spark.createDataFrame([(f"f{i}.csv", 'a,b\n1,"x\ny"\n3,4') for i in range(40)], "file_id string, text string"))
    told = lines.select("*", *[F.lit(v).alias(n) for n, v in (("delimiter", ","), ("quote", '"'), ("double", True), ("skip", False))])
    placed = delimited.states(told)
    assert "FlatMapGroupsInPandas" not in operators(placed)
    assert {(r.line_no, r.record, r.alone) for r in placed.collect()} == {(0, 0, True), (1, 1, False), (2, 1, False), (3, 2, True)}
    rows = spark.range(0, 300).selectExpr("concat('f', id % 100) AS file_id", "id div 100 AS row_no", "CAST(300 AS INT) AS cost", "CAST(1 AS INT) AS header_cost")
    batches = tabular.greedy_batches(rows, 400, 50)
    assert operators(batches).count("MapInArrow") == 1
    assert {(r.row_no, r.batch, r.n) for r in batches.groupBy("row_no", "batch").agg(F.count("*").alias("n")).collect()} == {(i, i, 100) for i in range(3)}


def test_stored_tables_are_read_by_value(spark):
    kept = scale.stored(spark.createDataFrame([(1, "x", "a"), (2, None, "b")], "n int, text string, kind string"), "kind")
    assert [tuple(r) for r in kept.filter("kind = 'b'").collect()] == [(2, None, "b")] and kept.columns == ["n", "text", "kind"]
    assert "PartitionFilters: [isnotnull(kind" in kept.filter("kind = 'b'")._jdf.queryExecution().executedPlan().toString()
