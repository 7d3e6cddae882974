"""Type-specific chunking rules on small hand-made documents."""

from pyspark.sql import functions as F

from corpusloom.operators import chunk as H
from corpusloom.operators import classify as C
from corpusloom.operators import strategies as S
from corpusloom.sources import markup

SCHEMA = "document_id string, ordinal int, kind string, level int, text string, page int"
LONG = "These are enough words to stay above the bound for short chunks, so nothing here is merged away or dropped."


def docs(spark, rows):
    return spark.createDataFrame([("d", i, *row) for i, row in enumerate(rows)], SCHEMA)


def packed(units, tail=True):
    good, _ = H.split_rejects(units, 200)
    return H.pack(good, 100, 200, tail).orderBy("chunk_no").collect()


def test_paper_drops_references_and_keeps_the_abstract_whole(spark):
    blocks = docs(spark, [
        ("heading", 1, "Abstract", 1), ("text", None, LONG, 1), ("text", None, LONG, 1),
        ("heading", 1, "1 Introduction", 1), ("text", None, LONG, 1), ("heading", 2, "Motivation", 1), ("text", None, LONG, 1),
        ("heading", 1, "References", 2), ("text", None, LONG, 2), ("heading", 2, "More references", 2), ("text", None, LONG, 2),
        ("heading", 1, "Appendix", 3), ("text", None, LONG, 3)])
    rows = packed(S.paper_units(blocks, 100, 200))
    assert [tuple(r.heading_path) for r in rows] == [("Abstract",), ("1 Introduction",), ("1 Introduction", "Motivation"), ("Appendix",)]
    assert rows[0].text == LONG + "\n\n" + LONG and (rows[0].start_ordinal, rows[0].end_ordinal) == (1, 2)


def test_book_contents_are_removed_and_chapter_titles_joined(spark):
    blocks = docs(spark, [
        ("text", None, "Contents\nPart I\nChapter 1 .... 3\nChapter 2 .... 9\nNotes .... 20", 1),
        ("heading", 1, "Part I", 2), ("heading", 1, "Chapter One", 3), ("heading", 1, "The long", 3), ("heading", 1, "way home", 3),
        ("text", None, LONG, 3), ("heading", 1, "Summary", 4), ("text", None, LONG, 4)]).withColumn("role", F.lit(None).cast("string"))
    titles = spark.createDataFrame([("d", "My Book")], "document_id string, title string")
    rows = packed(S.book_units(blocks, titles, 100, 200))
    assert all("Contents" not in r.text for r in rows)
    assert list(rows[0].heading_path) == ["My Book", "Part I", "Chapter One", "The long way home"]
    assert rows[1].chunk_type == "summary" and rows[1].heading_path[-1] == "Summary"


def test_markdown_lists_and_quotes_keep_their_source(spark):
    text = f"# Top\n\n{LONG}\n\n- one item of the list\n- another item\n\n> quoted words\n\n---\n\nSee [here](#top). {LONG}"
    blocks = markup.markdown_blocks(spark.createDataFrame([("d", text)], "document_id string, text string"))
    rows = packed(S.markdown_units(blocks, 100, 200))
    assert [r.chunk_type for r in rows] == ["passage", "passage", "verbatim", "passage"]
    assert rows[1].text == "- one item of the list\n- another item" and rows[2].text == "> quoted words"
    assert [r.section_index for r in rows] == [1, 1, 1, 2] and all(list(r.heading_path) == ["Top"] for r in rows)


def test_documentation_roles(spark):
    rows = [
        ("heading", 1, "API Reference", 1), ("text", None, "body", 1), ("heading", 2, "Details", 1), ("text", None, "more", 1),
        ("heading", 1, "Other", 1), ("text", None, "NOTE\nshout", 1), ("text", None, "Tip: careful", 1), ("text", None, "Tip of the day", 1),
        ("heading", 1, "Contents", 1), ("list", None, "a\nb", 1)]
    blocks = docs(spark, rows).withColumn("source", F.lit(None).cast("string")).withColumn("ordered", F.lit(False))
    got = {r.ordinal: (r.role, r.callout_type) for r in C.annotate_documentation(blocks).collect()}
    assert got == {
        0: ("api_reference", None), 1: ("api_reference", None), 2: ("api_reference", None), 3: ("api_reference", None),
        4: (None, None), 5: ("callout", "note"), 6: ("callout", "tip"), 7: (None, None), 8: ("toc", None), 9: ("toc", None)}
    chunks = packed(S.documentation_units(blocks, 100, 200), tail=False)
    assert chunks[0].text == "API Reference\n\nbody"


def test_email_merges_only_within_region(spark):
    rows = [("d", 0, 0, "body", "plain", LONG), ("d", 1, 0, "body", "plain", "more"), ("d", 2, 0, "quoted", "plain", LONG), ("d", 3, 1, "quoted", "plain", LONG)]
    regions = spark.createDataFrame(rows, "document_id string, ordinal int, message_no long, region string, body_format string, text string")
    got = packed(S.email_units(regions, 100, 200))
    assert [(r.start_ordinal, r.end_ordinal) for r in got] == [(0, 1), (2, 2), (3, 3)]


def test_html_blocks(spark):
    html = (
        "<html><body><nav><p>skip</p></nav><h2>Head</h2><p>One<br>two</p><ul><li>a</li><li>b</li></ul>"
        "<table><tr><th>k</th><th>v</th></tr><tr><td>1</td></tr></table><pre><code class='language-py'>x = 1</code></pre>"
        "<div class='ad'>skip</div><footer>skip</footer></body></html>")
    got = markup.html_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("ordinal").collect()
    assert [r.kind for r in got] == ["heading", "text", "list", "table", "code"]
    assert got[1].text == "One\ntwo" and got[3].rows == [["k", "v"], ["1", ""]] and got[3].header_rows == 1
    assert got[4].code_language == "py" and got[0].level == 2
