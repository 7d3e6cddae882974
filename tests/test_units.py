"""Units are trimmed and counted without repeated scans, and packed without a Python frame per document."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.operators import chunk as H
from corpusloom.operators import counted as K

TEXTS = ["a", " a ", "\x0b\x85\xa0a b\t", "a  ", "a   ", "  ", "a \n ", "", " ", None, "a\r\n", " a", "漢 \x85"]


def test_trimmed_equals_the_expression_that_it_replaces(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "x string").select(F.expr(H._trimmed("x")).alias("new"), F.expr(H._strip("x")).alias("old"))
    for row in rows.collect():
        assert row.new == row.old


@pytest.mark.parametrize("target, maximum", [(2, 4), (5, 10), (96, 192)])
def test_counts_of_units_are_those_of_their_texts(spark, target, maximum):
    texts = [*TEXTS, "(one) two. Three\n\n 12345 (x) ...", "'t is. -a. 1 2! 。x", "\t12 ab", "  (a", " .", "word " * 300, "Ends. " * 80, "漢字" * 50]
    blocks = spark.createDataFrame([(i, t, a, "passage") for i, t in enumerate(texts) for a in (True, False)], "i int, text string, atomic boolean, ctype string")
    units = X.unfold(H.with_units(blocks, target, maximum), ["i"], F.col("units"), "u")
    wrong = units.filter((F.col("u.c") != X.token_count(F.col("u.t"))) | (F.col("u.jc") != X.token_count(F.concat("u.sep", "u.t"))))
    assert wrong.collect() == [] and units.count() > len(texts)


def test_documents_are_folded_over_arrow_batches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(K, "cut", lambda df: seen.append(df) or df)
    rows = [(str(i), 0, "text", None, f"words of document {i}", None) for i in range(300)] + [("none", 0, "text", None, None, 1)]
    chunks, refused = K.chunk_generic(spark.createDataFrame(rows, "document_id string, ordinal int, kind string, level int, text string, page int"), K.bytes_counter(8), 20, 64)
    assert {r.document_id: r.text for r in chunks.collect()} == {str(i): f"words of document {i}" for i in range(300)} and refused.count() == 0
    # A frame per document cost four fifths of the job.
    plan = seen[0]._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
