"""HTML and Markdown into blocks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import expr as X

BLOCK_SCHEMA = (
    "page_id long, ordinal int, kind string, text string, level int, code_language string, "
    "rows array<array<string>>, header_rows int, items array<string>")
_SKIPPED = {"nav", "aside", "header", "footer", "script", "style", "noscript", "title", "meta", "link", "base"}
_TEXT = {"p", "div", "section", "article", "main", "body", "blockquote", "figure", "li", "td"}
_VOID = {"br", "img", "meta", "link", "base", "hr", "input"}


#: Block rows that a task holds before it hands them on; those of one page stay together.
AT_ONCE = 2000


class _Blocks(HTMLParser):
    """Collects block rows from one page; boilerplate elements are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.buffer: list[str] = []
        self.skip: list[str] = []
        self.mode: str | None = None
        self.language: str | None = None
        self.table: list[list[str]] = []
        self.header_rows = 0
        self.has_header = False
        self.items: list[str] = []

    def emit(self, kind: str, **fields) -> None:
        self.rows.append({"ordinal": len(self.rows), "kind": kind, **fields})

    def take(self) -> str:
        text = "".join(self.buffer).strip()
        self.buffer = []
        return text

    def flush(self) -> None:
        text = self.take()
        if text:
            self.emit("text", text=text)

    def handle_starttag(self, tag: str, attrs) -> None:
        attributes = dict(attrs)
        classes = (attributes.get("class") or "").split()
        if self.skip or tag in _SKIPPED or "ad" in classes:
            if tag not in _VOID:
                self.skip.append(tag)
            return
        if tag == "br":
            self.buffer.append("\n")
        elif tag == "img":
            if self.mode is None and (attributes.get("src") or "").startswith("data:image/"):
                self.flush()
                self.emit("image", text=attributes.get("alt"))
        elif self.mode == "pre":
            if tag == "code":
                self.language = next((c[9:] for c in classes if c.startswith("language-")), None)
        elif self.mode == "table":
            if tag == "tr":
                self.table.append([])
                self.has_header = False
            elif tag in ("td", "th"):
                self.buffer = []
                self.has_header = self.has_header or tag == "th"
        elif self.mode == "list":
            if tag == "li":
                self.buffer = []
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "pre", "table", "ul", "ol"):
            self.flush()
            self.mode = "list" if tag in ("ul", "ol") else tag
            self.table, self.items, self.header_rows, self.language = [], [], 0, None
        elif tag in _TEXT:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if self.mode == "table":
            if tag in ("td", "th") and self.table:
                self.table[-1].append(self.take())
            elif tag == "tr" and self.has_header:
                self.header_rows += 1
            elif tag == "table":
                rows = [r for r in self.table if r]
                width = max((len(r) for r in rows), default=0)
                if rows:
                    self.emit("table", rows=[r + [""] * (width - len(r)) for r in rows], header_rows=self.header_rows)
                self.mode, self.buffer = None, []
        elif self.mode == "list":
            if tag == "li":
                item = self.take()
                if item:
                    self.items.append(item)
            elif tag in ("ul", "ol"):
                if self.items:
                    self.emit("list", items=self.items, text="\n".join(self.items))
                self.mode, self.buffer = None, []
        elif self.mode == tag:
            text = self.take()
            if text and tag == "pre":
                self.emit("code", text=text, code_language=self.language)
            elif text:
                self.emit("heading", text=text, level=int(tag[1]))
            self.mode = None
        elif self.mode is None and tag in _TEXT:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.buffer.append(data)


def html_blocks(pages: DataFrame) -> DataFrame:
    """Block rows of HTML pages (page_id, html), a bounded number of rows at a time. Ids are numbers or strings."""
    key = pages.schema["page_id"].dataType.simpleString()
    columns = [c.split()[0] for c in BLOCK_SCHEMA.replace("array<array<string>>", "rows_type").split(", ")]

    kinds = {"page_id": "int64" if key == "bigint" else "object", "ordinal": "int32", "level": "Int32", "header_rows": "Int32"}

    def table(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({name: pd.Series([row.get(name) for row in rows], dtype=kinds.get(name, "object")) for name in columns})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[dict] = []
            for page, html in zip(batch["page_id"], batch["html"]):
                reader = _Blocks()
                reader.feed(html or "")
                reader.close()
                reader.flush()
                out.extend({"page_id": page, **row} for row in reader.rows)
                if len(out) >= AT_ONCE:
                    yield table(out)
                    out = []
            yield table(out)

    return pages.select("page_id", "html").mapInPandas(parse, BLOCK_SCHEMA.replace("page_id long", f"page_id {key}"))


def html_title(html: Column) -> Column:
    return X.squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


# Markdown line shapes.
HEADING = r"^#{1,6}[ \t]+"
RULE = r"^(?:\*{3,}|-{3,}|_{3,})[ \t]*$"
QUOTE = r"^>"
LIST_ITEM = r"^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+"
ORDERED = r"^[ \t]*[0-9]+[.)][ \t]+"
TABLE_ROW = r"^\|.*\|[ \t]*$"
TABLE_RULE = r"^\|[ \t:|-]+\|[ \t]*$"
FENCE = r"^```"
LINK = r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"
OUTSIDE = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)"


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of Markdown text (document_id, text) with their exact source lines.

    Lines are flagged by shape, fences by parity, and runs of one shape become
    blocks. All windows are over the lines of one document.
    """
    rows = X.unfold(docs, ["document_id"], F.split("text", "\n"), "line", "n")
    doc = W.partitionBy("document_id").orderBy("n")
    fence = F.rlike("line", F.lit(FENCE))
    fences = F.sum(fence.cast("int")).over(doc)
    marked = rows.withColumn("fence", fence).withColumn("fences", fences)
    inside = F.col("fence") | (F.col("fences") % 2 == 1)
    kind = (
        F.when(inside, "code").when(F.trim("line") == "", "blank")
        .when(F.rlike("line", F.lit(HEADING)), "heading").when(F.rlike("line", F.lit(RULE)), "thematic_break")
        .when(F.rlike("line", F.lit(QUOTE)), "blockquote").when(F.rlike("line", F.lit(TABLE_ROW)), "table")
        .when(F.rlike("line", F.lit(LIST_ITEM)), "list").otherwise("paragraph"))
    typed = marked.withColumn("kind", kind)
    opens = F.col("fence") & (F.col("fences") % 2 == 1)
    starts = (
        F.lag("kind").over(doc).isNull() | (F.col("kind") != F.lag("kind").over(doc))
        | F.col("kind").isin("heading", "thematic_break") | opens)
    islands = typed.withColumn("block", F.sum(starts.cast("int")).over(doc)).filter("kind <> 'blank'")
    plain = (
        F.when(F.col("kind") == "heading", F.regexp_replace("line", HEADING, ""))
        .when(F.col("kind") == "blockquote", F.regexp_replace("line", r"^>[ \t]?", ""))
        .when(F.col("kind") == "list", F.regexp_replace("line", LIST_ITEM, "")).otherwise(F.col("line")))
    keep = ~((F.col("kind") == "code") & F.col("fence"))
    lines = F.array_sort(F.collect_list(F.struct("n", "line", plain.alias("plain"), keep.alias("keep"))))
    blocks = islands.groupBy("document_id", "block", "kind").agg(lines.alias("ls"))
    source = F.array_join(F.transform("ls", lambda r: r["line"]), "\n")
    text = F.array_join(F.transform(F.filter("ls", lambda r: r["keep"]), lambda r: r["plain"]), "\n")
    first = F.get("ls", F.lit(0))
    shaped = blocks.select(
        "document_id", "kind", first["n"].alias("start_line"), F.size("ls").alias("n_lines"),
        source.alias("source"), F.trim(text).alias("text"), first["line"].alias("first_line"))
    links = F.filter(F.regexp_extract_all("source", F.lit(LINK), F.lit(1)), lambda t: ~F.rlike(t, F.lit(OUTSIDE)))
    return shaped.filter("text <> ''").select(
        "document_id", "kind", "start_line", "n_lines", "source", "text",
        F.when(F.col("kind") == "heading", F.length(F.regexp_extract("first_line", r"^(#+)", 1))).alias("level"),
        F.when(F.col("kind") == "code", F.nullif(F.trim(F.regexp_extract("first_line", r"^```(.*)$", 1)), F.lit(""))).alias("code_language"),
        F.when(F.col("kind") == "list", F.rlike("first_line", F.lit(ORDERED))).alias("ordered"),
        F.when(F.col("kind") != "code", links).otherwise(F.array().cast("array<string>")).alias("links"))
