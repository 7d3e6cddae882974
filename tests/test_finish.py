"""Finishing of drafts, and line parts of code documents."""

from pyspark.sql import functions as F

from corpusloom.operators import chunk as H
from corpusloom.operators import strategies as S

DRAFT = "document_id string, chunk_no int, start_ordinal int, end_ordinal int, tokens int, text string"
BLOCK = "document_id string, ordinal int, kind string, level int, text string, page int"


def finished(spark, drafts, parents=(), keep=None):
    versions = spark.createDataFrame([(d, f"V{d}") for d in "abcd"], "document_id string, version_id string")
    made = spark.createDataFrame([(d, n, n, n, t, f"text {n}" if x is None else x) for d, n, t, x in drafts], DRAFT)
    up = spark.createDataFrame(list(parents), "document_id string, chunk_no int, parent_no int") if parents else None
    done, rejects = H.finish(made, versions, up, keep)
    return done.orderBy("document_id", "ordinal").collect(), {r.document_id: r.reason for r in rejects.collect()}


def test_short_leaves_go_and_parents_follow(spark):
    rows, bad = finished(
        spark, [("a", 0, 20, None), ("a", 1, 3, None), ("a", 2, 15, None), ("a", 3, 40, None), ("a", 4, 40, None)],
        [("a", 1, 0), ("a", 2, 0), ("a", 3, 2), ("a", 4, 2)])
    assert bad == {} and [(r.text, r.ordinal) for r in rows] == [("text 0", 0), ("text 2", 1), ("text 3", 2), ("text 4", 3)]
    ids = [r.chunk_id for r in rows]
    assert [r.parent_id for r in rows] == [None, ids[0], ids[1], ids[1]]
    assert [r.sibling_ids for r in rows] == [[], [], [ids[3]], [ids[2]]] and len(set(ids)) == 4


def test_short_parents_and_repeated_identities_refuse_their_document(spark):
    rows, bad = finished(spark, [("a", 0, 3, None), ("a", 1, 40, None), ("c", 0, 40, None)], [("a", 1, 0)])
    assert bad == {"a": "short parent"} and [r.document_id for r in rows] == ["c"]
    same = spark.createDataFrame([("b", 0, 1, 1, 30, "t"), ("b", 1, 1, 1, 30, "t"), ("c", 0, 1, 1, 30, "t")], DRAFT)
    versions = spark.createDataFrame([("b", "v"), ("c", "v")], "document_id string, version_id string")
    done, rejects = H.finish(same, versions)
    assert [r.document_id for r in done.collect()] == ["c"] and rejects.first().reason == "repeated chunk"


def test_kept_drafts_and_empty_tables(spark):
    rows, _ = finished(spark, [("a", 0, 3, "keep me"), ("a", 1, 3, None), ("b", 0, 14, None)], keep=F.col("text") == "keep me")
    assert [r.text for r in rows] == ["keep me"]
    assert finished(spark, []) == ([], {})


def test_code_is_cut_at_line_ends_and_nothing_is_lost(spark):
    code = "".join(f"value_{i} = call({i}, {i + 1})\n" for i in range(120))
    rows = [("d", 0, "heading", 1, "Top", 1), ("d", 1, "code", None, code, 1), ("d", 2, "code", None, "x = 1", 1), ("d", 3, "text", None, "Some words. " * 12, 1),
            ("e", 0, "code", None, None, 1), ("f", 0, "code", None, "", 1)]
    good, bad = H.split_rejects(S.code_units(spark.createDataFrame(rows, BLOCK), 100, 200), 200)
    got = H.pack(good, 100, 200).orderBy("document_id", "chunk_no").collect()
    parts = [r.text for r in got if r.start_ordinal == 1]
    assert bad.count() == 0 and len(parts) > 5 and "".join(parts) == code
    assert all(p.endswith("\n") for p in parts) and all(r.tokens <= 200 and list(r.heading_path) == ["Top"] for r in got)
    assert [r.text for r in got if r.start_ordinal == 2] == ["x = 1"] and {r.document_id for r in got} == {"d"}


def test_drafts_are_computed_once_and_book_units_are_stored(spark, folder):
    import __spark_entry__ as entry

    seen = spark.sparkContext.accumulator(0)
    schema = "document_id string, chunk_no int, start_ordinal int, end_ordinal int, tokens int, text string"

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    drafts = spark.createDataFrame([(f"d{i % 5}", i // 5, i, i, 20, f"text {i}") for i in range(50)], schema).mapInPandas(counted, schema)
    versions = spark.createDataFrame([(f"d{i}", f"v{i}") for i in range(5)], "document_id string, version_id string")
    done, rejects = H.finish(drafts, versions)
    assert len(done.collect()) == 50 and rejects.isEmpty()
    assert seen.value == 50
    assert "LogicalRDD" in entry.queries()["chunk_book"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
