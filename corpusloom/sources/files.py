"""File scans, format routing, plain text and JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import expr as X

# Code extensions and their language.
CODE_EXTENSIONS = {
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".go": "go", ".h": "c", ".hpp": "cpp",
    ".java": "java", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".rs": "rust",
    ".ts": "typescript", ".tsx": "tsx",
}
# Parser slot by extension and by MIME type.
EXTENSION_PARSERS = {
    ".txt": "text", ".log": "text", ".csv": "csv", ".tsv": "csv", ".json": "json", ".html": "html", ".htm": "html",
    ".md": "markdown", ".markdown": "markdown", ".eml": "email", ".mbox": "email", ".pdf": "pdf", ".docx": "docx",
    ".pptx": "pptx", ".xlsx": "xlsx", **{e: "text" for e in CODE_EXTENSIONS},
}
MIME_PARSERS = {
    "text/plain": "text", "text/csv": "csv", "application/json": "json", "text/html": "html", "text/markdown": "markdown",
    "message/rfc822": "email", "application/mbox": "email", "application/pdf": "pdf",
}
EXTENSION_MIME = {
    ".txt": "text/plain", ".log": "text/plain", ".csv": "text/csv", ".json": "application/json", ".html": "text/html",
    ".htm": "text/html", ".md": "text/markdown", ".eml": "message/rfc822", ".mbox": "application/mbox",
    ".pdf": "application/pdf", ".py": "text/x-python",
}
# Leading bytes in hexadecimal.
MAGIC = {"25504446": "application/pdf", "504B0304": "application/zip", "89504E47": "image/png", "FFD8FF": "image/jpeg"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.element_at(F.create_map(*pairs), key)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def route_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Identity, MIME type and parser slot of each file (path, content).

    A known content hash leaves as a duplicate before anything is parsed. The
    extension decides, except for plain text and logs, where the MIME type does.
    """
    head = F.hex(F.substring("content", 1, 8))
    sniffed = F.lit(None).cast("string")
    for magic, mime in MAGIC.items():
        sniffed = F.when(F.startswith(head, F.lit(magic)), mime).otherwise(sniffed)
    ext = extension(F.col("path"))
    based = files.select("path", F.sha2("content", 256).alias("content_hash"), F.length("content").alias("size"),
                         ext.alias("ext"), sniffed.alias("sniffed"))
    mime = F.coalesce("sniffed", _lookup(EXTENSION_MIME, F.col("ext")), F.lit("application/octet-stream"))
    typed = based.withColumn("mime", mime)
    by_extension = _lookup(EXTENSION_PARSERS, F.col("ext"))
    by_mime = _lookup(MIME_PARSERS, F.col("mime"))
    first = F.when(~F.col("ext").isin(".txt", ".log"), by_extension)
    routed = typed.withColumn("parser", F.coalesce(first, by_mime, by_extension))
    owners = known.groupBy("content_hash").agg(F.min("document_id").alias("duplicate_of"))
    return routed.join(owners, "content_hash", "left").select(
        "path", "content_hash", "size", "ext", "mime",
        F.when(F.col("duplicate_of").isNull(), F.col("parser")).alias("parser"), "duplicate_of",
        F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("parser").isNull(), "unsupported")
        .otherwise("parse").alias("outcome"))


def decode_text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, text) of valid UTF-8 files, and the paths of the rest."""
    raw = F.col("content").cast("string")
    valid = F.coalesce(F.is_valid_utf8(raw), F.lit(False))
    marked = files.select("path", F.when(valid, raw).alias("text"), valid.alias("ok"))
    return marked.filter("ok").drop("ok"), marked.filter("not ok").select("path")


def text_blocks(docs: DataFrame) -> DataFrame:
    """Paragraphs as text blocks; a code file is one code block.

    ``docs``: document_id, ext, text.
    """
    language = _lookup(CODE_EXTENSIONS, F.col("ext"))
    paragraphs = F.filter(
        F.transform(F.split("text", "\n\n"), lambda x: X.strip(x)), lambda x: x != "")
    whole = F.when(X.strip(F.col("text")) != "", F.array("text")).otherwise(F.array().cast("array<string>"))
    marked = docs.withColumn("code_language", language)
    items = F.when(F.col("code_language").isNull(), paragraphs).otherwise(whole)
    spread = X.unfold(marked, ["document_id", "code_language"], items, "text", "ordinal")
    return spread.select(
        "document_id", "ordinal", F.when(F.col("code_language").isNull(), "text").otherwise("code").alias("kind"),
        "text", "code_language")


class Members(list):
    """The (name, value) pairs of a JSON object, in document order."""


def _flat(text: str) -> list[tuple[list[int], str]] | None:
    """(place, line) of all scalars of a JSON text; None if it is no JSON. Walks with a stack of its own."""
    try:
        top = json.loads(text, object_pairs_hook=Members, parse_int=str, parse_float=str, parse_constant=_refuse)
    except ValueError:
        return None
    out, open_ = [], [([], "", top)]
    while open_:
        place, path, value = open_.pop()
        if isinstance(value, list):
            pairs = value if isinstance(value, Members) else [(f"[{i}]", v) for i, v in enumerate(value)]
            open_ += [([*place, i], f"{path}.{name}" if path else name, v) for i, (name, v) in reversed(list(enumerate(pairs)))]
        else:
            said = value if isinstance(value, str) else str(value)
            out.append((place, f"{path}: {said}" if place else said))
    return out


def _refuse(name: str) -> None:
    raise ValueError(name)


def json_lines(docs: DataFrame) -> DataFrame:
    """Depth-first ``path: value`` lines of JSON text, in document order.

    ``docs``: document_id, text. One pass over Arrow batches. ``place`` has one
    number per level and orders the lines of a document. Text that is no JSON has
    no lines; one nested too deeply for the decoder has a single null line.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(doc, place, line) for place, line in (_flat(text) or [])] if text is not None else []
                except RecursionError:
                    rows.append((doc, [], None))
            kinds = (batch.schema[0].type, pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["document_id", "place", "line"])

    id_type = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", "text").mapInArrow(run, f"document_id {id_type}, place array<int>, line string")
