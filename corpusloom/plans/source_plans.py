"""Registered source, cleaning and classification queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.operators import classify as C
from corpusloom.operators import clean as N
from corpusloom.plans.sqlbase import oracle, quoted
from corpusloom.plans.tables import Library, _pick
from corpusloom.sources import delimited, files, mail, markup, tabular

EXTS = [".txt", ".md", ".py", ".html", ".csv", ".json", ".log", ".bin", ".mbox"]


def _paths() -> F.Column:
    ext = _pick(EXTS, (F.col("doc_id") % len(EXTS) + 1).cast("int"))
    return F.concat(F.lit("in/"), "source", F.lit("/Doc."), F.col("doc_id").cast("string"), ext)


def ingest_route(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files; the English ones are known already."""
    docs = Library(spark, d).documents()
    arriving = docs.select(_paths().alias("path"), F.encode("text", "UTF-8").alias("content"))
    known = docs.filter("lang = 'en'").select(
        F.col("doc_id").cast("string").alias("document_id"), F.sha2("text", 256).alias("content_hash"))
    return files.route_files(arriving, known)


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Sentence ends become blank lines; every ninth extension is a code file."""
    docs = Library(spark, d).documents().select(
        F.col("doc_id").cast("string").alias("document_id"),
        _pick(EXTS, (F.col("doc_id") % len(EXTS) + 1).cast("int")).alias("ext"),
        F.replace("text", F.lit(". "), F.lit(". \n\n \t")).alias("text"))
    return files.text_blocks(docs)


def csv_batches(spark: SparkSession, d: str) -> DataFrame:
    """The order table as one delimited file per priority."""
    rows = Library(spark, d).read("orders")
    cells = rows.select(
        F.col("o_orderpriority").alias("file_id"), "o_orderkey",
        F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus",
                F.date_format("o_orderdate", "yyyy-MM-dd"), F.repeat(F.lit("x"), (F.col("o_custkey") % 90).cast("int"))).alias("cells"))
    numbered = tabular.running_number(cells, ["file_id"], [F.col("o_orderkey")], "rn").withColumn(
        "row_no", (F.col("rn") - 1).cast("long"))
    header = rows.select(F.col("o_orderpriority").alias("file_id")).distinct().withColumn(
        "header", F.array(*[F.lit(c) for c in ("key", "customer", "status", "date", "note")]))
    out = tabular.csv_blocks(numbered.select("file_id", "row_no", "cells"), header)
    return out.select(
        "file_id", "ordinal", "n_rows", "tokens",
        F.get(F.get("rows", F.lit(0)), F.lit(0)).alias("header_cell"), F.get(F.get("rows", F.lit(1)), F.lit(0)).alias("first_key"))


def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents as rows of one quoted file per source, cut at every line break; scanned back into cells."""
    docs = Library(spark, d).read("documents")
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    file = F.concat(F.coalesce("source", F.lit("none")), F.lit(".csv"))
    records = docs.select(file.alias("file_id"), "doc_id", F.concat_ws(",", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), quoted).alias("record"))
    lines = records.select("file_id", "doc_id", F.posexplode(F.split("record", "\n")).alias("pos", "line"))
    lines = tabular.running_number(lines, ["file_id"], [F.col("doc_id"), F.col("pos")], "n").select("file_id", (F.col("n") - 1).alias("line_no"), "line")
    given = lines.select("file_id").distinct().select("file_id", F.lit(",").alias("delimiter"), F.lit('"').alias("quote"), F.lit(True).alias("double"), F.lit(False).alias("skip"))
    rows, _ = delimited.scan(lines, given)
    return rows.select(
        "file_id", "row_no", F.get("cells", F.lit(0)).alias("doc_id"), F.get("cells", F.lit(1)).alias("lang"), F.sha2(F.get("cells", F.lit(2)), 256).alias("text_sha256"),
        F.size("cells").alias("width"))


def table_partition(spark: SparkSession, d: str) -> DataFrame:
    """Parts, one sheet per brand, and nations as sheets."""
    lib = Library(spark, d)
    part = lib.read("part").select(
        F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("key"),
        F.array(F.col("p_partkey").cast("string"), "p_name", "p_type", tabular.cell_text(F.col("p_size") > 25, "boolean")).alias("cells"))
    nation = lib.read("nation").select(
        F.lit("nation").alias("sheet"), F.col("n_nationkey").cast("bigint").alias("key"),
        F.when(F.col("n_nationkey") == 3, F.array(F.lit(""), F.lit(""))).otherwise(F.array(F.col("n_nationkey").cast("string"), "n_name")).alias("cells"))
    return tabular.sheet_blocks(part.unionByName(nation), [F.col("key")]).withColumn("cells", F.array_join("cells", "|"))


def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Event properties inside a nested object with keys out of order."""
    text = F.concat(
        F.lit('{"z":'), "props", F.lit(',"a":[1,{"r":null,"b":true},"{\\"x\\":1}",[]],"m":{"type":"'), "event_type",
        F.lit('","deep":[['), F.col("user_id").cast("string"), F.lit(']]},"user":'), F.col("user_id").cast("string"), F.lit("}"))
    docs = Library(spark, d).read("events").select(F.col("event_id").cast("string").alias("document_id"), text.alias("text"))
    return files.json_lines(docs).select("document_id", F.array_join(F.transform("place", lambda i: F.lpad(i.cast("string"), 3, "0")), ".").alias("place"), "line")


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return markup.html_blocks(Library(spark, d).read("pages")).withColumn("rows", F.to_json("rows")).withColumn(
        "items", F.array_join("items", "|"))


def html_title(spark: SparkSession, d: str) -> DataFrame:
    return Library(spark, d).read("pages").select("page_id", markup.html_title(F.col("html")).alias("title"))


MARKS = ["", "# ", "## ", "> ", "- ", "2. ", "", "- "]


def _markdown(lib: Library) -> DataFrame:
    """Document lines with Markdown marks by position, fences, rules, tables and links."""
    def mark(line, i):
        plain = F.concat(F.element_at(F.array(*[F.lit(m) for m in MARKS]), (i % 8 + 1).cast("int")), line)
        return (
            F.when(i % 16 == 6, F.concat(F.lit("```python\n"), line, F.lit("\n# not a heading\n```")))
            .when(i % 16 == 8, F.concat(F.lit("---\n\n"), line, F.lit(" [a](#top) and [b](https://example.org/x)")))
            .when(i % 16 == 14, F.concat(F.lit("| h | k |\n| --- | --- |\n| "), F.replace(line, F.lit("|"), F.lit("/")), F.lit(" | v |")))
            .when(i % 4 == 3, F.concat(plain, F.lit("\n"))).otherwise(plain))
    return lib.documents().select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.array_join(F.transform(X.lines(F.col("text")), mark), "\n").alias("text"))


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return markup.markdown_blocks(_markdown(Library(spark, d))).withColumn("links", F.array_join("links", " "))


def message_id_canonical(spark: SparkSession, d: str) -> DataFrame:
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    forms = F.array(
        F.concat(F.lit("<C"), c, F.lit("."), t, F.lit("@Example.ORG>")), F.concat(F.lit(" c"), c, F.lit(" (sent by x) @\tHOST."), t, F.lit(".Net ")),
        F.concat(F.lit("no-at-sign"), c), F.concat(F.lit("<a@b@C"), t, F.lit(">")), F.col("text"))
    rows = Library(spark, d).read("conversations").select("conv_id", "turn", F.posexplode(forms).alias("form", "value"))
    return rows.select("conv_id", "turn", "form", mail.canonical_id(F.col("value")).alias("message_id"))


def _mailbox(lib: Library) -> DataFrame:
    """Document lines as a mailbox: every third line follows a separator."""
    def shape(line, i):
        return F.when(i % 3 == 0, F.concat(F.lit("From a@b.c Mon\n"), line)).when(
            i % 3 == 1, F.concat(F.lit(">From "), line)).otherwise(line)
    return lib.documents().select(
        F.col("doc_id").cast("string").alias("box_id"), F.array_join(F.transform(X.lines(F.col("text")), shape), "\n").alias("text"))


def mbox_split(spark: SparkSession, d: str) -> DataFrame:
    return mail.split_mbox(_mailbox(Library(spark, d))).withColumn("message", X.strip(F.col("message")))


def mime_decode(spark: SparkSession, d: str) -> DataFrame:
    """Turns as raw messages, every second one with an HTML alternative."""
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    head = F.concat(
        F.lit("From: User <u"), c, F.lit("@Example.org>\nMessage-ID: <c"), c, F.lit("."), t, F.lit("@Example.org>\nSubject: turn "), t,
        F.lit("\nDate: Mon, 01 Jan 2024 10:00:00 +0000\nMIME-Version: 1.0\n"))
    plain = F.concat(head, F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text", F.lit("\n"))
    both = F.concat(
        head, F.lit('Content-Type: multipart/alternative; boundary="b"\n\n--b\nContent-Type: text/html; charset=utf-8\n\n<p>x</p>\n--b\n'
                    "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text", F.lit("\n--b--\n"))
    raw = Library(spark, d).read("conversations").select(
        F.concat_ws("-", c, t).alias("mail_id"), F.when(F.col("turn") % 2 == 0, plain).otherwise(both).alias("raw"))
    return mail.decode_messages(raw)


# -- cleaning -----------------------------------------------------------------
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents with decomposed letters, hyphenated breaks and tabs planted."""
    bent = F.replace(F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("en"), F.lit("e-\n n")), F.lit(" "), F.lit(" \t"))
    return Library(spark, d).documents().select("doc_id", N.clean_prose(bent).alias("text"))


def _noisy(lib: Library) -> DataFrame:
    """Line blocks with a running header on every page and a note on half of them."""
    lines = lib.blocks().select("document_id", "ordinal", "page", "kind", "text")
    first = lines.filter("ordinal % 10 = 0")
    header = first.select("document_id", (F.col("ordinal") * 2 + 1).alias("ordinal"), "page", F.lit("heading").alias("kind"), F.lit("Running header").alias("text"))
    half = first.filter("page % 2 = 0").select(
        "document_id", (F.col("ordinal") * 2 + 3).alias("ordinal"), "page", F.lit("text").alias("kind"), F.lit("Half note").alias("text"))
    return lines.withColumn("ordinal", F.col("ordinal") * 2).unionByName(header).unionByName(half)


def strip_repeated_blocks(spark: SparkSession, d: str) -> DataFrame:
    return N.drop_repeated(_noisy(Library(spark, d)))


def strip_source_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line blocks of sources; two thirds of the documents carry a notice of their source, half of them a note."""
    lib = Library(spark, d)
    docs = lib.documents().select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", "source")
    lines = lib.blocks().join(docs, "document_id").select("source", "document_id", "ordinal", "kind", "text")
    notice = docs.filter("doc_id % 3 < 2").select(
        "source", "document_id", F.lit(-2).alias("ordinal"), F.lit("heading").alias("kind"), F.concat(F.lit("All rights with "), "source").alias("text"))
    note = docs.filter("doc_id % 2 = 0").select(
        "source", "document_id", F.lit(-1).alias("ordinal"), F.lit("text").alias("kind"), F.lit("Printed on request").alias("text"))
    blocks = lines.unionByName(notice).unionByName(note)
    return N.drop_source_noise(blocks, N.source_noise(blocks))


def reordinal(spark: SparkSession, d: str) -> DataFrame:
    return N.reordinal(N.drop_repeated(_noisy(Library(spark, d)))).select("document_id", "ordinal", "page", "kind", "text")


def detect_language(spark: SparkSession, d: str) -> DataFrame:
    """Profiles from four fifths of the labelled documents, by a hash of the id; every document is judged."""
    docs = Library(spark, d).documents()
    profiles = N.language_profiles(docs.filter(~N.held_out(F.col("doc_id"))).select("lang", "text"))
    return N.detect_language(docs.select(F.col("doc_id").alias("text_id"), "text"), profiles)


def canonicalize_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Typed line blocks; some documents miss an asset or bring an unknown one."""
    lib = Library(spark, d)
    doc = F.col("document_id").cast("bigint")
    blocks = lib.blocks().select(
        "document_id", "ordinal", F.when(F.col("kind") == "equation", "math").otherwise(F.col("kind")).alias("kind"), "text",
        F.when(F.col("kind") == "image", F.concat(F.lit("image-"), F.col("ordinal").cast("string"))).alias("local_id"))
    images = blocks.filter("kind = 'image'")
    assets = images.filter(~((doc % 11 == 3) & (F.col("ordinal") % 2 == 0))).select("document_id", "local_id").unionByName(
        images.filter(doc % 13 == 5).select("document_id", F.lit("image-unknown").alias("local_id")).distinct())
    assets = assets.withColumn("asset_id", X.uuid5(F.concat_ws(":", "document_id", "local_id")))
    good, rejects = N.canonicalize(blocks, assets)
    return good.select("document_id", "ordinal", "kind", "text", "asset_id", F.lit(None).cast("string").alias("reason")).unionByName(
        rejects.select("document_id", F.lit(-1).alias("ordinal"), F.lit("reject").alias("kind"), F.coalesce("local_id", F.lit("")).alias("text"),
                       F.lit(None).cast("string").alias("asset_id"), "reason"))


# -- classification -----------------------------------------------------------
def _named(lib: Library) -> DataFrame:
    exts = ["", ".pptx", "", ".md", "", ".eml", "", ".py", "", "", ".pdf"]
    return lib.documents().select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), _pick(exts, (F.col("doc_id") % len(exts) + 1).cast("int"))).alias("path"))


def classify_doc(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return C.classify(lib.blocks(), _named(lib))


def annotate_resume(spark: SparkSession, d: str) -> DataFrame:
    return C.annotate_resume(Library(spark, d).blocks()).select("document_id", "ordinal", "kind", "level", "section", "role")


def annotate_slides(spark: SparkSession, d: str) -> DataFrame:
    """Line blocks; some lose their page, some documents all of them."""
    doc = F.col("document_id").cast("bigint")
    blocks = Library(spark, d).blocks().withColumn(
        "page", F.when((doc % 5 == 0) | ((doc % 5 == 1) & (F.col("ordinal") % 7 == 3)), None).otherwise(F.col("page")))
    return C.annotate_slides(blocks).select("document_id", "ordinal", "slide", "role", "is_title_slide")


def _documentation(lib: Library) -> DataFrame:
    """Line blocks with callout shapes planted by position."""
    pos = (F.col("document_id").cast("bigint") + F.col("ordinal")) % 9
    shaped = lib.blocks().withColumn(
        "text", F.when((F.col("kind") == "text") & (pos == 1), F.concat(F.lit("Note: "), "text"))
        .when((F.col("kind") == "text") & (pos == 2), F.concat(F.lit("WARNING\n"), "text"))
        .when((F.col("kind") == "text") & (pos == 3), F.concat(F.lit("Tip of "), "text")).otherwise(F.col("text")))
    return shaped.withColumn(
        "source", F.when((F.col("kind") == "text") & (pos == 4), F.concat(F.lit("intro\n:::caution\n"), "text"))
        .when((F.col("kind") == "text") & (pos == 5), F.concat(F.lit("> **Important**: "), "text"))).withColumn(
        "ordered", (F.col("kind") == "list") & (pos % 2 == 0))


def annotate_docs(spark: SparkSession, d: str) -> DataFrame:
    return C.annotate_documentation(_documentation(Library(spark, d))).select("document_id", "ordinal", "kind", "role", "callout_type")


def callouts(spark: SparkSession, d: str) -> DataFrame:
    rows = _documentation(Library(spark, d)).filter("kind <> 'heading'")
    return rows.select("document_id", "ordinal", C.callout(F.coalesce("source", F.lit("")), F.col("text"), F.col("kind")).alias("callout_type"))


QUERIES = {f.__name__: f for f in (
    ingest_route, text_blocks, csv_batches, csv_scan, table_partition, json_flatten, html_blocks, html_title, markdown_blocks,
    message_id_canonical, mbox_split, mime_decode, clean_text, strip_repeated_blocks, strip_source_lines, reordinal, detect_language,
    canonicalize_blocks, classify_doc, annotate_resume, annotate_slides, annotate_docs, callouts)}

WSQ = r"[ \t\n\r\f\v\x{85}\x{A0}]"
MD = {
    "md_text": f"""SELECT document_id, array_to_string(list(CASE
        WHEN i % 16 = 6 THEN '```python' || chr(10) || line || chr(10) || '# not a heading' || chr(10) || '```'
        WHEN i % 16 = 8 THEN '---' || chr(10) || chr(10) || line || ' [a](#top) and [b](https://example.org/x)'
        WHEN i % 16 = 14 THEN '| h | k |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || replace(line, '|', '/') || ' | v |'
        WHEN i % 4 = 3 THEN {quoted(MARKS)}[i % 8 + 1] || line || chr(10)
        ELSE {quoted(MARKS)}[i % 8 + 1] || line END ORDER BY i), chr(10)) AS text
      FROM (SELECT CAST(doc_id AS VARCHAR) AS document_id, ordinal AS i, line FROM doc_lines) GROUP BY 1""",
    "md_lines": """SELECT document_id, CAST(n - 1 AS INTEGER) AS n, line, regexp_matches(line, '^```') AS fence FROM (
        SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM md_text)""",
    "md_fenced": "SELECT *, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY document_id ORDER BY n) AS fences FROM md_lines",
    "md_kinds": r"""SELECT *, CASE WHEN fence OR fences % 2 = 1 THEN 'code' WHEN trim(line) = '' THEN 'blank'
        WHEN regexp_matches(line, '^#{1,6}[ \t]+') THEN 'heading' WHEN regexp_matches(line, '^(?:\*{3,}|-{3,}|_{3,})[ \t]*$') THEN 'thematic_break'
        WHEN regexp_matches(line, '^>') THEN 'blockquote' WHEN regexp_matches(line, '^\|.*\|[ \t]*$') THEN 'table'
        WHEN regexp_matches(line, '^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+') THEN 'list' ELSE 'paragraph' END AS kind FROM md_fenced""",
    "md_starts": """SELECT *, CAST(lag(kind) OVER w IS NULL OR kind <> lag(kind) OVER w OR kind IN ('heading', 'thematic_break') OR (fence AND fences % 2 = 1) AS INTEGER) AS begins
        FROM md_kinds WINDOW w AS (PARTITION BY document_id ORDER BY n)""",
    "md_islands": "SELECT *, sum(begins) OVER (PARTITION BY document_id ORDER BY n) AS block FROM md_starts",
    "md_blocks": r"""SELECT document_id, kind, min(n) AS start_line, CAST(count(*) AS INTEGER) AS n_lines, string_agg(line, chr(10) ORDER BY n) AS source,
        trim(coalesce(string_agg(CASE kind WHEN 'heading' THEN regexp_replace(line, '^#{1,6}[ \t]+', '') WHEN 'blockquote' THEN regexp_replace(line, '^>[ \t]?', '')
          WHEN 'list' THEN regexp_replace(line, '^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+', '') ELSE line END, chr(10) ORDER BY n) FILTER (NOT (kind = 'code' AND fence)), '')) AS text,
        arg_min(line, n) AS first_line FROM md_islands WHERE kind <> 'blank' GROUP BY document_id, block, kind""",
}
_FILES = f"""SELECT 'in/' || source || '/Doc.' || doc_id || {quoted(EXTS)}[doc_id % 9 + 1] AS path, {quoted(EXTS)}[doc_id % 9 + 1] AS ext,
  sha256(text) AS content_hash, CAST(strlen(text) AS INTEGER) AS size FROM documents"""
NOISY = """SELECT document_id, ordinal * 2 AS ordinal, page, kind, text FROM blocks
  UNION ALL SELECT document_id, ordinal * 2 + 1, page, 'heading', 'Running header' FROM blocks WHERE ordinal % 10 = 0
  UNION ALL SELECT document_id, ordinal * 2 + 3, page, 'text', 'Half note' FROM blocks WHERE ordinal % 10 = 0 AND page % 2 = 0"""
STRIP = """SELECT * FROM noisy n WHERE NOT (kind IN ('text', 'heading') AND EXISTS (
  SELECT 1 FROM (SELECT document_id, text, count(DISTINCT page) AS on_pages FROM noisy WHERE kind IN ('text', 'heading') AND text <> '' GROUP BY 1, 2) s
    JOIN (SELECT document_id, count(DISTINCT page) AS pages FROM noisy GROUP BY 1) t USING (document_id)
  WHERE s.document_id = n.document_id AND s.text = n.text AND pages >= 2 AND on_pages * 2 > pages))"""
LEARNED = "WHERE CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4)) AS INTEGER) % 5 <> 0"
GRAMS = r"""SELECT {0}, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3))) AS gram FROM (
  SELECT {0}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS word FROM documents {1})"""
DOCUMENTATION = """SELECT document_id, ordinal, kind,
    CASE WHEN kind = 'text' AND pos = 1 THEN 'Note: ' || text WHEN kind = 'text' AND pos = 2 THEN 'WARNING' || chr(10) || text
         WHEN kind = 'text' AND pos = 3 THEN 'Tip of ' || text ELSE text END AS text,
    CASE WHEN kind = 'text' AND pos = 4 THEN 'intro' || chr(10) || ':::caution' || chr(10) || text
         WHEN kind = 'text' AND pos = 5 THEN '> **Important**: ' || text ELSE '' END AS source
  FROM (SELECT *, (CAST(document_id AS BIGINT) + ordinal) % 9 AS pos FROM blocks)"""
CARD = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"

ORACLES = {
    "ingest_route": oracle("""
        SELECT f.path, f.content_hash, size, ext, mime, CASE WHEN k.duplicate_of IS NULL THEN parser END AS parser, k.duplicate_of,
          CASE WHEN k.duplicate_of IS NOT NULL THEN 'duplicate' WHEN parser IS NULL THEN 'unsupported' ELSE 'parse' END AS outcome
        FROM (SELECT *, CASE ext WHEN '.txt' THEN 'text/plain' WHEN '.log' THEN 'text/plain' WHEN '.md' THEN 'text/markdown' WHEN '.py' THEN 'text/x-python'
            WHEN '.html' THEN 'text/html' WHEN '.csv' THEN 'text/csv' WHEN '.json' THEN 'application/json' WHEN '.mbox' THEN 'application/mbox' ELSE 'application/octet-stream' END AS mime,
          CASE ext WHEN '.txt' THEN 'text' WHEN '.log' THEN 'text' WHEN '.md' THEN 'markdown' WHEN '.py' THEN 'text' WHEN '.html' THEN 'html'
            WHEN '.csv' THEN 'csv' WHEN '.json' THEN 'json' WHEN '.mbox' THEN 'email' END AS parser FROM arriving) f
        LEFT JOIN (SELECT sha256(text) AS content_hash, min(CAST(doc_id AS VARCHAR)) AS duplicate_of FROM documents WHERE lang = 'en' GROUP BY 1) k USING (content_hash)""",
        arriving=_FILES),
    "text_blocks": f"""
        SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(pos - 1 AS INTEGER) AS ordinal, kind, text, code_language FROM (
          SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS pos, kind, code_language FROM (
            SELECT doc_id, CASE WHEN code THEN [t] ELSE list_filter(list_transform(string_split(t, chr(10) || chr(10)),
                lambda x: regexp_replace(x, '^{WSQ}+|{WSQ}+$', '', 'g')), lambda x: x <> '') END AS parts,
              CASE WHEN code THEN 'code' ELSE 'text' END AS kind, CASE WHEN code THEN 'python' END AS code_language
            FROM (SELECT doc_id, replace(text, '. ', '. ' || chr(10) || chr(10) || ' ' || chr(9)) AS t, {quoted(EXTS)}[doc_id % 9 + 1] = '.py' AS code FROM documents)))""",
    "csv_scan": """SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY CAST(doc_id AS BIGINT)) - 1 AS row_no, doc_id, lang, text_sha256, 3 AS width FROM (
          SELECT coalesce(source, 'none') || '.csv' AS file_id, CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, sha256(coalesce(text, '')) AS text_sha256,
            max(length(replace(coalesce(text, ''), '"', '""')) + 40) OVER (PARTITION BY source) AS longest FROM documents)
        WHERE longest <= 131072""",
    "csv_batches": """
        WITH RECURSIVE r AS (SELECT o_orderpriority AS file_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS row_no, CAST(o_orderkey AS VARCHAR) AS key,
            greatest(1, (length(CAST(o_orderkey AS VARCHAR)) + length(CAST(o_custkey AS VARCHAR)) + length(o_orderstatus) + 10 + o_custkey % 90 + 5 + 3) // 4) AS cost FROM orders),
        fold AS (SELECT file_id, row_no, key, cost, 8 + cost AS used, 1 AS held, 0 AS batch FROM r WHERE row_no = 0
          UNION ALL SELECT r.file_id, r.row_no, r.key, r.cost, CASE WHEN used + r.cost > 400 OR held >= 50 THEN 8 + r.cost ELSE used + r.cost END,
            CASE WHEN used + r.cost > 400 OR held >= 50 THEN 1 ELSE held + 1 END, CASE WHEN used + r.cost > 400 OR held >= 50 THEN batch + 1 ELSE batch END
          FROM fold JOIN r ON r.file_id = fold.file_id AND r.row_no = fold.row_no + 1)
        SELECT file_id, CAST(batch AS BIGINT) AS ordinal, count(*) AS n_rows, CAST(sum(cost) AS INTEGER) AS tokens, 'key' AS header_cell, arg_min(key, row_no) AS first_key FROM fold GROUP BY 1, 2""",
    "table_partition": """
        WITH s AS (SELECT p_brand AS sheet, p_partkey AS key, array_to_string([CAST(p_partkey AS VARCHAR), p_name, p_type, CASE WHEN p_size > 25 THEN 'TRUE' ELSE 'FALSE' END], '|') AS cells FROM part
            UNION ALL SELECT 'nation', n_nationkey, n_nationkey || '|' || n_name FROM nation WHERE n_nationkey <> 3),
        n AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY key) AS rn, count(*) OVER (PARTITION BY sheet) AS total FROM s)
        SELECT sheet, rn, CASE WHEN total <= 50 OR rn = 1 THEN 0 ELSE (rn - 2) // 49 END AS block, rn = 1 AS is_header, cells FROM n""",
    "html_title": f"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{WSQ}+', ' ', 'g')) AS title FROM pages",
    "markdown_blocks": oracle(r"""
        SELECT document_id, kind, start_line, n_lines, source, text, CASE WHEN kind = 'heading' THEN CAST(length(regexp_extract(first_line, '^(#+)', 1)) AS INTEGER) END AS level,
          CASE WHEN kind = 'code' THEN nullif(trim(regexp_extract(first_line, '^```(.*)$', 1)), '') END AS code_language,
          CASE WHEN kind = 'list' THEN regexp_matches(first_line, '^[ \t]*[0-9]+[.)][ \t]+') END AS ordered,
          CASE WHEN kind <> 'code' THEN coalesce(array_to_string(list_filter(regexp_extract_all(source, '\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1), lambda t: NOT regexp_matches(t, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)')), ' '), '') ELSE '' END AS links
        FROM md_blocks WHERE text <> ''""", **MD),
    "message_id_canonical": r"""
        SELECT conv_id, turn, CAST(form AS INTEGER) AS form, CASE WHEN regexp_full_match(v, '[^\s<>@]+@[^\s<>@]+') THEN split_part(v, '@', 1) || '@' || lower(split_part(v, '@', 2)) END AS message_id
        FROM (SELECT conv_id, turn, form, regexp_replace(regexp_replace(regexp_replace(value, '\([^()]*\)', '', 'g'), '[ \t\r\n]+', '', 'g'), '^[<>]+|[<>]+$', '', 'g') AS v
          FROM (SELECT conv_id, turn, unnest(range(0, 5)) AS form, unnest(['<C' || conv_id || '.' || turn || '@Example.ORG>', ' c' || conv_id || ' (sent by x) @' || chr(9) || 'HOST.' || turn || '.Net ',
            'no-at-sign' || conv_id, '<a@b@C' || turn || '>', text]) AS value FROM conversations))""",
    "mbox_split": oracle(f"""
        SELECT box_id, CAST(part AS INTEGER) AS part, regexp_replace(string_agg(CASE WHEN starts_with(line, '>From ') THEN substr(line, 2) ELSE line END, chr(10) ORDER BY n), '^{WSQ}+|{WSQ}+$', '', 'g') AS message
        FROM parted WHERE NOT sep GROUP BY 1, 2 HAVING message <> ''""",
        boxes="""SELECT CAST(doc_id AS VARCHAR) AS box_id, string_agg(CASE ordinal % 3 WHEN 0 THEN 'From a@b.c Mon' || chr(10) || line WHEN 1 THEN '>From ' || line ELSE line END, chr(10) ORDER BY ordinal) AS text
            FROM doc_lines GROUP BY 1""",
        box_lines="SELECT box_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM boxes",
        parted="SELECT *, starts_with(line, 'From ') AS sep, sum(CAST(starts_with(line, 'From ') AS INTEGER)) OVER (PARTITION BY box_id ORDER BY n) AS part FROM box_lines"),
    "clean_text": f"""SELECT doc_id, nfc_normalize(trim(regexp_replace(regexp_replace(
        replace(replace(replace(text, 'é', 'e' || chr(769)), 'en', 'e-' || chr(10) || ' n'), ' ', ' ' || chr(9)), '-{WSQ}*\\n{WSQ}*', '', 'g'), '{WSQ}+', ' ', 'g'))) AS text FROM documents""",
    "strip_repeated_blocks": oracle("SELECT document_id, ordinal, page, kind, text FROM stripped", noisy=NOISY, stripped=STRIP),
    "strip_source_lines": oracle("""
        SELECT source, document_id, ordinal, kind, text FROM sourced s WHERE NOT (kind IN ('text', 'heading') AND EXISTS (
          SELECT 1 FROM (SELECT source, text, count(DISTINCT document_id) AS n FROM sourced WHERE kind IN ('text', 'heading') AND text <> '' GROUP BY 1, 2) l
            JOIN (SELECT source, count(DISTINCT document_id) AS total FROM sourced GROUP BY 1) t USING (source)
          WHERE l.source = s.source AND l.text = s.text AND total >= 5 AND n > total * 0.5))""",
        sourced="""SELECT d.source, b.document_id, b.ordinal, b.kind, b.text FROM blocks b JOIN documents d ON CAST(d.doc_id AS VARCHAR) = b.document_id
          UNION ALL SELECT source, CAST(doc_id AS VARCHAR), -2, 'heading', 'All rights with ' || source FROM documents WHERE doc_id % 3 < 2
          UNION ALL SELECT source, CAST(doc_id AS VARCHAR), -1, 'text', 'Printed on request' FROM documents WHERE doc_id % 2 = 0"""),
    "reordinal": oracle("SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY ordinal) - 1 AS INTEGER) AS ordinal, page, kind, text FROM stripped", noisy=NOISY, stripped=STRIP),
    "detect_language": oracle("""
        SELECT d.doc_id AS text_id, b.lang FROM documents d LEFT JOIN (
          SELECT doc_id, arg_max(lang, {'s': score, 'l': lang}) AS lang FROM (
            SELECT doc_id, lang, round(sum(times * ln(n + 1)) - any_value(len) * any_value(base), 6) AS score
            FROM doc_grams JOIN profile USING (gram) JOIN (SELECT doc_id, sum(times) AS len FROM doc_grams GROUP BY 1) USING (doc_id)
              JOIN (SELECT lang, ln(sum(n) + count(*)) AS base FROM profile GROUP BY 1) USING (lang) GROUP BY 1, 2) GROUP BY 1) b ON b.doc_id = d.doc_id""",
        profile=f"SELECT lang, gram, count(*) AS n FROM ({GRAMS.format('lang', LEARNED)}) GROUP BY 1, 2",
        doc_grams=f"SELECT doc_id, gram, count(*) AS times FROM ({GRAMS.format('doc_id', 'WHERE length(trim(text)) >= 5')}) GROUP BY 1, 2"),
    "classify_doc": oracle(rf"""
        SELECT document_id, coalesce(CASE CAST(document_id AS BIGINT) % 11 WHEN 1 THEN 'slides' WHEN 3 THEN 'markdown' WHEN 5 THEN 'email' WHEN 7 THEN 'code' END, by_heading,
          CASE WHEN structural > 0 AND code / structural > 0.8 THEN 'code' END, 'generic') AS doc_type
        FROM (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents) LEFT JOIN (
          SELECT document_id, arg_min(told, ordinal) FILTER (told IS NOT NULL) AS by_heading, count(*) FILTER (kind = 'code') AS code, count(*) FILTER (kind IN ('code', 'text', 'table')) AS structural
          FROM (SELECT *, CASE WHEN kind = 'heading' THEN CASE WHEN regexp_matches(t, '^(abstract|references|methodology|conclusion)$') THEN 'paper'
              WHEN regexp_matches(t, '^(?:chapter\s+(?:\d+|[ivxlcdm]+|{CARD})|prologue|epilogue|table of contents)$') THEN 'book'
              WHEN regexp_matches(t, '^(experience|education|skills|employment history|resume|cv)$') THEN 'resume'
              WHEN regexp_matches(t, '^(api reference|getting started|installation|quickstart)$') THEN 'documentation'
              WHEN regexp_matches(t, '^(slide 1|presentation)$') THEN 'slides' END END AS told FROM (SELECT *, lower(trim(text)) AS t FROM blocks)) GROUP BY 1) USING (document_id)"""),
    "annotate_slides": oracle("""
        SELECT document_id, ordinal, CAST(slide AS INTEGER) AS slide, CASE WHEN kind = 'heading' AND sum(CAST(kind = 'heading' AS INTEGER)) OVER (PARTITION BY document_id, slide ORDER BY ordinal) = 1 THEN 'title' ELSE 'body' END AS role,
          slide = 1 AS is_title_slide
        FROM (SELECT *, dense_rank() OVER (PARTITION BY document_id ORDER BY first_ordinal) AS slide FROM (
          SELECT *, min(ordinal) OVER (PARTITION BY document_id, k) AS first_ordinal FROM (
            SELECT *, CASE WHEN count(p) OVER (PARTITION BY document_id) = 0 THEN 0 WHEN p IS NULL THEN -1 - ordinal ELSE p END AS k FROM (
              SELECT *, CASE WHEN doc % 5 = 0 OR (doc % 5 = 1 AND ordinal % 7 = 3) THEN NULL ELSE page END AS p FROM (SELECT *, CAST(document_id AS BIGINT) AS doc FROM blocks)))))"""),
    "callouts": oracle(r"""
        SELECT document_id, ordinal, coalesce(nullif(lower(regexp_extract(source, '(?im)^:::(note|warning|tip|caution|important)\b', 1)), ''),
          nullif(lower(regexp_extract(source, '(?im)^>\s*(?:\*\*)?(note|warning|tip|caution|important)(?:\*\*)?:?', 1)), ''),
          CASE WHEN kind = 'text' AND word <> '' AND (substr(start, length(word) + 1, 1) = ':' OR (upper(start) = start AND lower(start) <> start)) THEN lower(word) END) AS callout_type
        FROM (SELECT *, regexp_extract(start, '(?i)^(note|warning|tip|caution|important)\b', 1) AS word FROM (SELECT *, regexp_extract(trim(text), '^[^\n]*') AS start FROM shaped WHERE kind <> 'heading'))""",
        shaped=DOCUMENTATION),
    "canonicalize_blocks": oracle(f"""
        SELECT document_id, ordinal, CASE kind WHEN 'list' THEN 'text' ELSE kind END AS kind, text, asset_id, NULL AS reason
        FROM raw LEFT JOIN assets_in USING (document_id, local_id) WHERE document_id NOT IN (SELECT document_id FROM refused)
        UNION ALL SELECT document_id, -1, 'reject', local_id, NULL, reason FROM refused""",
        raw="SELECT document_id, ordinal, kind, text, CASE WHEN kind = 'image' THEN 'image-' || ordinal END AS local_id, CAST(document_id AS BIGINT) AS doc FROM blocks",
        asset_ids="""SELECT document_id, local_id FROM raw WHERE kind = 'image' AND NOT (doc % 11 = 3 AND ordinal % 2 = 0)
            UNION ALL SELECT DISTINCT document_id, 'image-unknown' FROM raw WHERE kind = 'image' AND doc % 13 = 5""",
        assets_in="""SELECT document_id, local_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
              || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS asset_id
            FROM (SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(document_id || ':' || local_id)) AS h FROM asset_ids)""",
        refused="""SELECT document_id, local_id, CASE WHEN used IS NULL THEN 'unexpected asset' ELSE 'missing asset' END AS reason FROM
            (SELECT document_id, local_id, true AS used FROM raw WHERE kind = 'image') FULL JOIN assets_in USING (document_id, local_id) WHERE used IS NULL OR asset_id IS NULL"""),
    "json_flatten": r"""
        WITH j AS (SELECT event_id, CAST('{"z":' || props || ',"a":[1,{"r":null,"b":true},"{\"x\":1}",[]],"m":{"type":"' || event_type || '","deep":[[' || user_id || ']]},"user":' || user_id || '}' AS JSON) AS doc FROM events),
        t AS (SELECT event_id, unnest([
            {'p': '000.000', 'l': 'z.k: ' || CAST(doc->>'$.z.k' AS VARCHAR)}, {'p': '001.000', 'l': 'a.[0]: ' || (doc->>'$.a[0]')}, {'p': '001.001.000', 'l': 'a.[1].r: None'},
            {'p': '001.001.001', 'l': 'a.[1].b: True'}, {'p': '001.002', 'l': 'a.[2]: ' || (doc->>'$.a[2]')}, {'p': '002.000', 'l': 'm.type: ' || (doc->>'$.m.type')},
            {'p': '002.001.000.000', 'l': 'm.deep.[0].[0]: ' || (doc->>'$.m.deep[0][0]')}, {'p': '003', 'l': 'user: ' || (doc->>'$.user')}]) AS e FROM j)
        SELECT CAST(event_id AS VARCHAR) AS document_id, e.p AS place, e.l AS line FROM t""",
}
