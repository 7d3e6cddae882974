"""From files to chunks: one chain of DataFrames with a rejects table beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.scale import cut, stored
from corpusloom.operators import chunk as H
from corpusloom.operators import classify as C
from corpusloom.operators import clean as N
from corpusloom.operators import strategies as S
from corpusloom.sources import delimited, mail, markup, tabular
from corpusloom.sources import files as S1

BLOCK_COLUMNS = ["document_id", "ordinal", "kind", "text", "level", "page", "role", "source", "ordered"]


def _shape(rows: DataFrame, **given: F.Column) -> DataFrame:
    kinds = {"level": "int", "page": "int", "role": "string", "source": "string", "ordered": "boolean"}
    columns = []
    for name in BLOCK_COLUMNS:
        if name in given:
            columns.append(given[name].alias(name))
        elif name in rows.columns:
            columns.append(F.col(name))
        else:
            columns.append(F.lit(None).cast(kinds[name]).alias(name))
    return rows.select(columns)


def parse(routed: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of the files that can be parsed, and a reason for each that cannot."""
    texts, broken = S1.decode_text(contents)
    # Texts are exchanged and stored once, by parser; every parser reads its own.
    docs = stored(routed.filter("outcome = 'parse'").join(texts, "path").select(
        F.col("path").alias("document_id"), "ext", "text", "parser"), "parser")
    plain = _shape(S1.text_blocks(docs.filter("parser = 'text'")))
    md = markup.markdown_blocks(docs.filter("parser = 'markdown'"))
    kind = F.when(F.col("kind").isin("paragraph", "blockquote", "thematic_break"), "text").otherwise(F.col("kind"))
    numbered = md.withColumn("ordinal", F.row_number().over(W.partitionBy("document_id").orderBy("start_line")) - 1)
    marked = _shape(numbered, kind=kind, role=F.when(F.col("kind") == "blockquote", "blockquote"))
    pages = docs.filter("parser = 'html'").select(F.col("document_id").alias("page_id"), F.col("text").alias("html"))
    html = markup.html_blocks(pages).withColumnRenamed("page_id", "document_id")
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, "\t")), "\n")
    hyper = _shape(html, text=F.coalesce("text", cells))
    parsed = docs.filter("parser = 'json'").withColumn("ok", F.try_parse_json("text").isNotNull())
    lines = S1.json_lines(parsed.filter("ok"))
    members = lines.withColumn("ordinal", F.row_number().over(W.partitionBy("document_id").orderBy("place")) - 1)
    flat = _shape(members, kind=F.lit("text"), text=F.col("line"))
    rows, not_csv = delimited.scan(delimited.lines_of(docs.filter("parser = 'csv'").select(F.col("document_id").alias("file_id"), "text")))
    tables = _shape(table_blocks(rows).withColumnRenamed("file_id", "document_id"), kind=F.lit("table"))
    letters, no_mail = mail_blocks(docs.filter("parser = 'email'"))
    blocks = plain.unionByName(marked).unionByName(hyper).unionByName(flat).unionByName(tables).unionByName(_shape(letters))
    rejects = (
        routed.filter("outcome = 'unsupported'").select("path", F.lit("unsupported format").alias("reason"))
        .unionByName(broken.select("path", F.lit("not valid UTF-8").alias("reason")))
        .unionByName(parsed.filter("not ok").select(F.col("document_id").alias("path"), F.lit("not valid JSON").alias("reason")))
        .unionByName(not_csv.select(F.col("file_id").alias("path"), "reason"))
        .unionByName(no_mail.select(F.col("document_id").alias("path"), F.lit("no message in this mailbox").alias("reason")))
        .unionByName(docs.filter("parser not in ('text', 'markdown', 'html', 'json', 'csv', 'email')").select(
            F.col("document_id").alias("path"), F.lit("no parser for this format").alias("reason"))))
    return blocks, rejects


def table_blocks(rows: DataFrame) -> DataFrame:
    """(file_id, ordinal, text) from scanned rows: header and some rows each, cells between tabs; a header alone is one block."""
    header = cut(rows.filter("row_no = 0").select("file_id", F.col("cells").alias("header")))
    data = rows.filter("row_no > 0").withColumn("row_no", F.col("row_no") - 1)
    full = tabular.csv_blocks(data, header).select("file_id", F.col("ordinal").cast("int").alias("ordinal"), "rows")
    alone = header.join(data.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.lit(0).alias("ordinal"), F.array("header").alias("rows"))
    lines = F.transform("rows", lambda r: F.array_join(r, "\t"))
    return full.unionByName(alone).select("file_id", "ordinal", F.array_join(lines, "\n").alias("text"))


def mail_blocks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subject as heading and body as text of every message, and the documents without a message.

    A file ``.eml`` is one message, others are mailboxes.
    """
    boxes = mail.split_mbox(docs.filter("ext <> '.eml'").select(F.col("document_id").alias("box_id"), "text"))
    single = docs.filter("ext = '.eml'").select(F.col("document_id").alias("box_id"), F.lit(1).alias("part"), F.col("text").alias("message"))
    named = boxes.select("box_id", F.col("part").cast("int").alias("part"), "message").unionByName(single)
    sent = named.select(F.to_json(F.struct("box_id", "part")).alias("mail_id"), F.col("message").alias("raw"))
    read = cut(mail.decode_messages(sent).filter("error is null"))
    at = F.from_json("mail_id", "box_id string, part int")
    items = F.array(
        F.struct(F.lit(0).alias("place"), F.lit("heading").alias("kind"), F.col("subject").alias("text"), F.lit(1).alias("level")),
        F.struct(F.lit(1).alias("place"), F.lit("text").alias("kind"), F.col("body").alias("text"), F.lit(None).cast("int").alias("level")))
    rows = read.select(at.alias("at"), F.explode(items).alias("i")).filter("trim(i.text) <> ''").select(
        F.col("at.box_id").alias("document_id"), (F.col("at.part") * 2 + F.col("i.place")).alias("ordinal"), "i.kind", "i.text", "i.level")
    return rows, docs.select("document_id").join(rows.select("document_id").distinct(), "document_id", "left_anti")


def ingest(contents: DataFrame, known: DataFrame, target: int, maximum: int) -> dict[str, DataFrame]:
    """Route, parse, clean, classify and chunk files (path, content).

    Known hashes leave before parsing. Failures are rows of ``rejects``: one bad
    file never fails the job. ``finish`` gives the chunks their ids.
    """
    routed = cut(S1.route_files(contents, known))
    blocks, unparsed = parse(routed, contents)
    # The block table is stored once; every later step reads it instead of parsing again.
    clean = cut(N.reordinal(N.drop_repeated(cut(N.clean_blocks(blocks)))))
    types = cut(C.classify(clean, routed.filter("outcome = 'parse'").select(F.col("path").alias("document_id"), "path")))
    typed = stored(clean.join(types, "document_id"), "doc_type")
    titles = typed.filter("kind = 'heading'").groupBy("document_id").agg(F.min_by("text", "ordinal").alias("title"))
    chunks, refused = S.chunk_all(typed, titles, target, maximum)
    rejects = unparsed.unionByName(refused.select(F.col("document_id").alias("path"), "reason"))
    return {"routed": routed, "types": types, "chunks": chunks, "rejects": rejects}


def finish(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of ``ingest`` with finished chunks: short leaves dropped, ids by the content's version, slides kept however short."""
    versions = tables["routed"].select(F.col("path").alias("document_id"), F.col("content_hash").alias("version_id"))
    slides = tables["types"].select("document_id", (F.col("doc_type") == "slides").alias("kept"))
    done, refused = H.finish(tables["chunks"].join(slides, "document_id", "left"), versions, None, F.col("kept"))
    rejects = tables["rejects"].unionByName(refused.select(F.col("document_id").alias("path"), "reason"))
    return {**tables, "chunks": done.drop("kept"), "rejects": rejects}


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per file: duplicate, indexed with its chunk count, or failed."""
    counted = tables["chunks"].groupBy(F.col("document_id").alias("path")).agg(F.count("*").alias("chunks"))
    failed = tables["rejects"].groupBy("path").agg(F.min("reason").alias("reason"))
    types = tables["types"].select(F.col("document_id").alias("path"), "doc_type")
    return (
        tables["routed"].select("path", "content_hash", "outcome", "duplicate_of")
        .join(types, "path", "left").join(counted, "path", "left").join(failed, "path", "left")
        .select("path", "content_hash", "doc_type", F.coalesce("chunks", F.lit(0)).alias("chunks"), "reason",
                F.when(F.col("outcome") == "duplicate", "duplicate").when(F.col("reason").isNotNull(), "failed").otherwise("indexed").alias("status")))
