"""Registered strategy, ingest and streaming queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.scale import cut
from corpusloom.operators import chunk as H
from corpusloom.operators import classify as C
from corpusloom.operators import strategies as S
from corpusloom.operators import threads as M
from corpusloom.plans.chunk_plans import LIMIT, MAX, T
from corpusloom.plans.network_plans import _bodies
from corpusloom.plans.source_plans import _documentation, _markdown
from corpusloom.plans.sqlbase import ntok, oracle
from corpusloom.plans.tables import Library
from corpusloom.sources import markup


def _shown(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "document_id", "chunk_no", "section_index", "chunk_index", "start_ordinal", "end_ordinal", "chunk_type",
        F.array_join("heading_path", " > ").alias("heading_path"), "tokens", "text")


def _book(lib: Library) -> DataFrame:
    """Line blocks behind a contents page; every third one is too thin to count."""
    word = F.regexp_extract("text", r"^\S+", 0)
    lines = F.array(
        F.lit("Contents"), F.lit("Part I"), F.concat(F.lit("Chapter 1 "), word, F.lit(" ..... 3")), F.concat(F.lit("2.1 "), word, F.lit("  7")),
        F.concat(word, F.lit(" and others !  12")), F.lit("This is a sentence."))
    thin = F.array(F.lit("Contents:"), F.lit("Part I"), F.lit("A sentence stands here. It ends."), F.lit("Another one."))
    front = X.unfold(
        lib.documents(), [F.col("doc_id").cast("string").alias("document_id")], F.when(F.col("doc_id") % 3 < 2, lines).otherwise(thin), "text", "ordinal")
    shifted = lib.blocks().withColumn("ordinal", F.col("ordinal") + 6)
    return front.select(
        "document_id", F.lit("book").alias("doc_type"), "ordinal", F.lit("text").alias("kind"), "text", F.lit(None).cast("int").alias("level"),
        F.lit(0).alias("page")).unionByName(shifted).withColumn(
        "role", F.when((F.col("kind") == "text") & (F.col("ordinal") % 11 == 0), F.lit("quote")))


def toc_detect(spark: SparkSession, d: str) -> DataFrame:
    members, levels = S.detect_toc(_book(Library(spark, d)))
    return members.select("document_id", F.lit("member").alias("kind"), F.col("ordinal").cast("string").alias("item"), F.lit(0).alias("level")).unionByName(
        levels.select("document_id", F.lit("level").alias("kind"), F.col("title").alias("item"), F.col("toc_level").alias("level")))


def chunk_book(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    # Stored, as a filter on the units below the packing would fold the headings twice.
    good, _ = H.split_rejects(cut(S.book_units(_book(lib), lib.versions().select("document_id", "title"), T, LIMIT)), LIMIT)
    return _shown(H.pack(good, T, LIMIT))


def paper_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = Library(spark, d).blocks().filter("kind = 'heading'")
    return rows.select("document_id", "ordinal", "text", S.paper_section(F.col("text")).alias("section"))


def chunk_paper(spark: SparkSession, d: str) -> DataFrame:
    good, _ = H.split_rejects(S.paper_units(Library(spark, d).blocks(), T, LIMIT), LIMIT)
    return _shown(H.pack(good, T, LIMIT))


def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    blocks = markup.markdown_blocks(_markdown(Library(spark, d)))
    good, _ = H.split_rejects(S.markdown_units(blocks, T, LIMIT), LIMIT)
    return _shown(H.pack(good, T, LIMIT))


def _mail_chunks(lib: Library) -> DataFrame:
    """Regions of the bodies, two messages per document by parity of the run."""
    regions = M.split_regions(_bodies(lib)).select(
        F.col("message_id").alias("document_id"), F.col("run").cast("int").alias("ordinal"), F.floor(F.col("run") / 3).alias("message_no"),
        "region", F.lit("plain").alias("body_format"), "text")
    good, _ = H.split_rejects(S.email_units(regions, T, LIMIT), LIMIT)
    return H.pack(good, T, LIMIT)


def chunk_email(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_mail_chunks(Library(spark, d)))


def reply_parents(spark: SparkSession, d: str) -> DataFrame:
    """Turns as messages of line chunks; each answers the turn before it."""
    conv = Library(spark, d).read("conversations")
    mid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    lines = X.unfold(conv, [mid.alias("message_id"), "turn"], X.lines(F.col("text")), "line", "chunk_no")
    chunks = lines.select("message_id", "chunk_no", F.when((F.col("chunk_no") == 0) & (F.col("turn") % 3 == 0), "quoted").otherwise("body").alias("region"))
    messages = conv.select(
        mid.alias("message_id"),
        F.when(F.col("turn") > 0, F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))).alias("parent_id"))
    return S.reply_parent_chunks(chunks, messages)


def chunk_resume(spark: SparkSession, d: str) -> DataFrame:
    good, _ = H.split_rejects(S.resume_units(Library(spark, d).blocks(), T, LIMIT), LIMIT)
    return _shown(H.pack(good, T, LIMIT))


def _slides(lib: Library) -> DataFrame:
    annotated = C.annotate_slides(lib.blocks())
    pos = F.col("ordinal") % 10
    return annotated.withColumn("role", F.when(pos == 7, "notes").when((pos == 1) & (F.col("slide") % 3 == 0), "section_divider").otherwise(F.col("role")))


def chunk_slides(spark: SparkSession, d: str) -> DataFrame:
    good, bad = S.chunk_slides(_slides(Library(spark, d)), 2000)
    return good.select("document_id", "slide", "section_index", "chunk_index", "start_ordinal", "end_ordinal", "page", "chunk_type", "title", "tokens", "text", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("document_id", "slide", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("section_index", "int"), ("chunk_index", "int"), ("start_ordinal", "int"), ("end_ordinal", "int"), ("page", "int"), ("chunk_type", "string"),
            ("title", "string"), ("tokens", "int"), ("text", "string"))], "reason"))


def chunk_docs(spark: SparkSession, d: str) -> DataFrame:
    good, _ = H.split_rejects(S.documentation_units(_documentation(Library(spark, d)), T, LIMIT), LIMIT)
    return _shown(H.pack(good, T, LIMIT, tail=False))


def chunk_all(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    blocks = _documentation(lib).withColumn("role", F.lit(None).cast("string"))
    return _shown(S.chunk_all(blocks, lib.versions().select("document_id", "title"), T, MAX)[0])


QUERIES = {f.__name__: f for f in (
    toc_detect, chunk_book, paper_sections, chunk_paper, chunk_markdown, chunk_email, reply_parents, chunk_resume, chunk_slides, chunk_docs, chunk_all)}

LVL = r"""CASE WHEN t = '' OR len(string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ')) > 16 OR regexp_matches(t, '[.!?]$') THEN NULL
  WHEN regexp_matches(t, '(?i)^part\s+(?:[ivxlcdm]+|\d+|@)\b') THEN 1 WHEN regexp_matches(t, '(?i)^(?:chapter|book)\s+(?:[ivxlcdm]+|\d+|@)\b') THEN 2
  WHEN regexp_matches(t, '(?i)^subsection\b') THEN 4 WHEN regexp_matches(t, '(?i)^section\b') THEN 3
  WHEN regexp_extract(t, '^(\d+(?:\.\d+)*)(?:[.)\s:-]|$)', 1) <> '' THEN least(4, length(regexp_extract(t, '^(\d+(?:\.\d+)*)(?:[.)\s:-]|$)', 1)) - length(replace(regexp_extract(t, '^(\d+(?:\.\d+)*)(?:[.)\s:-]|$)', 1), '.', '')) + 2)
  ELSE 2 END""".replace("@", S.CARDINAL)
STRONG = r"""regexp_matches(s, '(?i)(?:\.{2,}|\s{2,}|!)\s*(?:\d+|[ivxlcdm]+)\s*$') OR regexp_matches(s, '(?i)^part\s+(?:[ivxlcdm]+|\d+|@)\b') OR regexp_matches(s, '(?i)^(?:chapter|book)\s+(?:[ivxlcdm]+|\d+|@)\b')
  OR regexp_matches(s, '(?i)^section\b') OR regexp_matches(s, '(?i)^subsection\b') OR regexp_matches(s, '^(\d+(?:\.\d+)*)(?:[.)\s:-]|$)')""".replace("@", S.CARDINAL)

ORACLES = {
    "paper_sections": oracle(r"""
        SELECT document_id, ordinal, text, coalesce(m[trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(text), '(?i)^(?:(?:\d+(?:\.\d+)*)|(?:[ivxlcdm]+))[.)]?\s+', '')), '^[ .:]+|[ .:]+$', '', 'g'), '\s+', ' ', 'g'))], 'other') AS section
        FROM blocks, (SELECT MAP {""" + ", ".join(f"'{k}': '{v}'" for k, v in S.PAPER_SECTIONS.items()) + """} AS m) WHERE kind = 'heading'"""),
    "reply_parents": oracle("""
        SELECT c.message_id, c.chunk_no, c.region, CASE WHEN turn > 0 AND p.message_id IS NOT NULL THEN p.message_id END AS parent_id, parent_chunk
        FROM chunks_in c LEFT JOIN (SELECT message_id, coalesce(min(chunk_no) FILTER (region = 'body'), min(chunk_no)) AS parent_chunk FROM chunks_in GROUP BY 1) p ON p.message_id = c.conv_id || '-' || (c.turn - 1)""",
        turn_lines="""SELECT conv_id, turn, CAST(pos - 1 AS INTEGER) AS chunk_no FROM (SELECT conv_id, turn, generate_subscripts(
            list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1) AS pos FROM conversations)""",
        chunks_in="SELECT conv_id, turn, conv_id || '-' || turn AS message_id, chunk_no, CASE WHEN chunk_no = 0 AND turn % 3 = 0 THEN 'quoted' ELSE 'body' END AS region FROM turn_lines"),
    "chunk_slides": oracle(f"""
        SELECT document_id, slide, section_index, CAST(row_number() OVER (PARTITION BY document_id, section_index ORDER BY slide) - 1 AS INTEGER) AS chunk_index, start_ordinal, end_ordinal, page,
          CASE WHEN slide = 1 THEN 'summary' ELSE 'passage' END AS chunk_type, title, tokens, text, NULL AS reason FROM placed WHERE document_id NOT IN (SELECT document_id FROM bad)
        UNION ALL SELECT document_id, slide, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unit exceeds the token maximum' FROM bad""",
        roles="""SELECT *, page AS slide, CASE WHEN ordinal % 10 = 7 THEN 'notes' WHEN ordinal % 10 = 1 AND page % 3 = 0 THEN 'section_divider'
            WHEN kind = 'heading' AND count(*) FILTER (kind = 'heading') OVER (PARTITION BY document_id, page ORDER BY ordinal) = 1 THEN 'title' ELSE 'body' END AS role FROM blocks""",
        slide_rows="""SELECT document_id, slide, coalesce(string_agg(text, ' ' ORDER BY ordinal) FILTER (role IN ('title', 'section_divider')), '') AS title,
            string_agg(text, ' ' ORDER BY ordinal) FILTER (role = 'body') AS body, string_agg(text, ' ' ORDER BY ordinal) FILTER (role = 'notes') AS notes,
            bool_or(role = 'section_divider') AS divides, min(page) AS page, min(ordinal) AS start_ordinal, max(ordinal) AS end_ordinal FROM roles GROUP BY 1, 2""",
        texts="SELECT *, concat_ws(chr(10) || chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END, body, 'Speaker Notes: ' || notes) AS text FROM slide_rows",
        placed=f"SELECT *, CAST({ntok('text')} AS INTEGER) AS tokens, CAST(count(*) FILTER (divides AND slide > 1) OVER (PARTITION BY document_id ORDER BY slide) AS INTEGER) AS section_index FROM texts",
        bad="SELECT document_id, slide FROM placed WHERE tokens > 2000"),
    "toc_detect": oracle(r"""
        SELECT DISTINCT document_id, 'member' AS kind, CAST(ordinal AS VARCHAR) AS item, 0 AS level FROM (SELECT document_id, mark, ordinal FROM inside UNION ALL SELECT document_id, mark, mark FROM marks) JOIN firsts USING (document_id, mark)
        UNION ALL SELECT document_id, 'level', item, arg_max(lvl, ordinal) FROM (
          SELECT document_id, ordinal, lvl, trim(regexp_replace(regexp_replace(lower(regexp_replace(s, '(?i)(?:\.{2,}|\s{2,}|!)\s*(?:\d+|[ivxlcdm]+)\s*$', '')), '^[ .:\t]+|[ .:\t]+$', '', 'g'), '\s+', ' ', 'g')) AS item
          FROM inside JOIN firsts USING (document_id, mark) WHERE lvl IS NOT NULL) GROUP BY 1, 2, 3""",
        front=r"""SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS ordinal, 'text' AS kind FROM (
            SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN ['Contents', 'Part I', 'Chapter 1 ' || w || ' ..... 3', '2.1 ' || w || '  7', w || ' and others !  12', 'This is a sentence.']
              ELSE ['Contents:', 'Part I', 'A sentence stands here. It ends.', 'Another one.'] END AS ls FROM (SELECT doc_id, regexp_extract(text, '^\S+') AS w FROM documents))""",
        book="SELECT document_id, ordinal, kind, text FROM front UNION ALL SELECT document_id, ordinal + 6, kind, text FROM blocks",
        book_lines=r"""SELECT *, CASE WHEN kind IN ('heading', 'text', 'caption', 'table') AND trim(text) <> '' THEN 1 ELSE 0 END AS n, trim(text) AS s,
            regexp_replace(regexp_replace(trim(text), '(?i)(?:\.{2,}|\s{2,}|!)\s*(?:\d+|[ivxlcdm]+)\s*$', ''), '^[ .\t]+|[ .\t]+$', '', 'g') AS t FROM book""",
        rated=f"SELECT *, CASE WHEN n = 1 THEN {LVL} END AS lvl, {STRONG} AS strong FROM book_lines",
        marks=r"SELECT document_id, ordinal AS mark FROM rated WHERE n = 1 AND regexp_matches(s, '(?i)^(?:table\s+of\s+)?contents(?:\s+with\s+clickable\s+chapter\s+links?)?:?$')",
        near="SELECT m.mark, r.* FROM marks m JOIN rated r ON r.document_id = m.document_id AND r.ordinal > m.mark AND r.ordinal <= m.mark + 20",
        stops="SELECT document_id, mark, min(ordinal) FILTER (kind = 'heading' OR (n = 1 AND lvl IS NULL)) AS stop FROM near GROUP BY 1, 2",
        inside="SELECT near.* FROM near JOIN stops USING (document_id, mark) WHERE (stop IS NULL OR ordinal < stop) AND n = 1",
        firsts="""SELECT document_id, min(mark) AS mark FROM (SELECT document_id, mark FROM inside GROUP BY 1, 2
            HAVING count(lvl) >= 3 AND count(lvl) / count(*) >= 0.7 AND (count(*) FILTER (strong) >= 2 OR count(lvl) >= 4)) GROUP BY 1"""),
}
