"""Chunking strategies by document type.

Each strategy prepares block rows (text, type, what may merge with what), folds
the state its headings carry, and hands the units to the one packer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.scale import cut
from corpusloom.operators import chunk as H
from corpusloom.operators import classify as C

# Shapes of book headings and contents lines.
CARDINAL = (
    "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|"
    "seventeen|eighteen|nineteen|twenty")
TOC_MARKER = r"(?i)^(?:table\s+of\s+)?contents(?:\s+with\s+clickable\s+chapter\s+links?)?:?$"
PAGE_SUFFIX = r"(?i)(?:\.{2,}|\s{2,}|!)\s*(?:\d+|[ivxlcdm]+)\s*$"
PART = rf"(?i)^part\s+(?:[ivxlcdm]+|\d+|{CARDINAL})\b"
CHAPTER = rf"(?i)^(?:chapter|book)\s+(?:[ivxlcdm]+|\d+|{CARDINAL})\b"
SECTION, SUBSECTION = r"(?i)^section\b", r"(?i)^subsection\b"
DECIMAL = r"^(\d+(?:\.\d+)*)(?:[.)\s:-]|$)"
SUMMARY = r"(?i)^(?:(?:chapter|section)\s+)?(?:summary|synopsis|overview)\b"
MATTER = (
    r"(?i)^(?:preface|foreword|introduction|acknowledgements?|prologue|epilogue|appendix(?:\s+[a-z0-9]+)?|"
    r"notes|bibliography|index)$")
VERBATIM_ROLES = ["quote", "quotation", "blockquote", "definition", "claim", "key_definition", "key_claim"]
TOC_AHEAD, TOC_FOLLOW, TOC_DENSITY = 20, 0.6, 0.7

# Canonical paper sections by heading.
PAPER_SECTIONS = {
    "abstract": "abstract", "introduction": "introduction", "background": "background", "related work": "background",
    "literature review": "background", "methods": "methods", "method": "methods", "methodology": "methods",
    "materials and methods": "methods", "experimental setup": "methods", "experiments": "methods", "results": "results",
    "findings": "results", "discussion": "discussion", "conclusion": "conclusion", "conclusions": "conclusion",
    "limitations": "limitations", "future work": "future_work", "acknowledgement": "acknowledgements",
    "acknowledgements": "acknowledgements", "acknowledgment": "acknowledgements", "acknowledgments": "acknowledgements",
    "references": "references", "bibliography": "references",
}
NUMBER_PREFIX = r"(?i)^(?:(?:\d+(?:\.\d+)*)|(?:[ivxlcdm]+))[.)]?\s+"
DECIMAL_PREFIX = r"^(\d+(?:\.\d+)*)[.)]?\s+"
SUMMARY_HEADING = r"(?i)^(?:summary|executive summary)$"


def dots(column: Column) -> Column:
    return F.length(column) - F.length(F.replace(column, F.lit("."), F.lit("")))


# -- books --------------------------------------------------------------------
def entry_text(line: Column) -> Column:
    """A contents line without its page number and edge dots."""
    return F.regexp_replace(F.regexp_replace(X.strip(line), PAGE_SUFFIX, ""), r"^[ .\t]+|[ .\t]+$", "")


def toc_level(text: Column) -> Column:
    """Level of a contents entry, null if the text is none."""
    bad = (text == "") | (F.size(F.split(X.squeeze(text), " ")) > 16) | F.rlike(text, F.lit(r"[.!?]$"))
    decimal = F.regexp_extract(text, DECIMAL, 1)
    level = (
        F.when(F.rlike(text, F.lit(PART)), 1).when(F.rlike(text, F.lit(CHAPTER)), 2)
        .when(F.rlike(text, F.lit(SUBSECTION)), 4).when(F.rlike(text, F.lit(SECTION)), 3)
        .when(decimal != "", F.least(F.lit(4), dots(decimal) + 2)).otherwise(2))
    return F.when(~bad, level.cast("int"))


def strong_line(text: Column) -> Column:
    out = F.rlike(text, F.lit(PAGE_SUFFIX))
    for pattern in (PART, CHAPTER, SECTION, SUBSECTION, DECIMAL):
        out = out | F.rlike(text, F.lit(pattern))
    return out


def normal_title(text: Column) -> Column:
    bare = F.regexp_replace(X.strip(text), PAGE_SUFFIX, "")
    return X.squeeze(F.regexp_replace(F.lower(bare), r"^[ .:\t]+|[ .:\t]+$", ""))


def detect_toc(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of the first table of contents per document, and its titled levels.

    A marker block is followed for up to 20 blocks, to the first heading or block
    of low entry density; it counts with at least 3 entries, density 0.7, and 2
    strong lines or 4 entries. Blocks meet their marker by document and distance.
    """
    carries = blocks.filter(F.col("kind").isin("heading", "text", "caption", "table")).select(
        "document_id", "ordinal", "kind", "text")
    marks = carries.filter(F.rlike(X.strip(F.regexp_extract("text", r"^\s*(\S[^\n]*)", 1)), F.lit(TOC_MARKER))).select(
        "document_id", F.col("ordinal").alias("mark"))
    reach = carries.join(marks, "document_id").filter(
        (F.col("ordinal") >= F.col("mark")) & (F.col("ordinal") <= F.col("mark") + TOC_AHEAD))
    rows = X.unfold(reach, ["document_id", "mark", "ordinal", "kind"], F.split("text", "\n"), "line", "line_no")
    full = rows.filter(X.strip(F.col("line")) != "")
    # At most 21 blocks per marker are left; they are rated once.
    lines = cut(
        full.withColumn("entry", entry_text(F.col("line"))).withColumn("bare", X.strip(F.col("line")))
        .withColumn("level", toc_level(F.col("entry"))).withColumn("strong", strong_line(F.col("bare"))).drop("entry", "bare"))
    counted = lines.groupBy("document_id", "mark", "ordinal", "kind").agg(
        F.count("*").alias("n"), F.count("level").alias("entries"), F.min("line_no").alias("first_line"))
    stops = (F.col("kind") == "heading") | (F.col("entries") / F.col("n") < TOC_FOLLOW)
    key = W.partitionBy("document_id", "mark")
    bounded = counted.withColumn(
        "stop", F.min(F.when(stops & (F.col("ordinal") > F.col("mark")), F.col("ordinal"))).over(key)).filter(
        F.col("stop").isNull() | (F.col("ordinal") < F.col("stop")))
    owned = bounded.select(
        "document_id", "mark", "ordinal", F.when(F.col("ordinal") == F.col("mark"), F.col("first_line")).otherwise(-1).alias("head_no"))
    judged = owned.join(lines, ["document_id", "mark", "ordinal"]).filter("line_no > head_no")
    totals = judged.groupBy("document_id", "mark").agg(
        F.count("*").alias("n"), F.count("level").alias("entries"), F.count_if(F.col("strong")).alias("strong"))
    good = totals.filter(
        (F.col("entries") >= 3) & (F.col("entries") / F.col("n") >= TOC_DENSITY) & ((F.col("strong") >= 2) | (F.col("entries") >= 4)))
    first = good.groupBy("document_id").agg(F.min("mark").alias("mark"))
    members = owned.join(first, ["document_id", "mark"], "left_semi")
    levels = judged.filter("level is not null").join(first, ["document_id", "mark"], "left_semi").groupBy(
        "document_id", normal_title(F.col("line")).alias("title")).agg(F.max_by("level", "ordinal").alias("toc_level"))
    return members.select("document_id", "ordinal").distinct(), levels


_BOOK_OUT = "struct<path:array<string>,section:int,chapter:int>"
_BOOK_STATE = (
    f"struct<path:array<string>,section:int,chapter:int,part:boolean,page:int,level:int,parts:array<string>,first:{_BOOK_OUT},out:array<{_BOOK_OUT}>>")
_BOOK_INIT = (
    "cast(named_struct('path', array(), 'section', 0, 'chapter', 0, 'part', false, 'page', null, 'level', null, 'parts', array(), "
    f"'first', named_struct('path', array(), 'section', 0, 'chapter', 0), 'out', array()) as {_BOOK_STATE})")


def _book_step() -> str:
    """Next state after a heading; the pending title of a chapter joins its lines."""
    pending = "h.other and h.decimal = 0 and s.level is not null and h.adjacent and h.page <=> s.page"
    level = "if(h.hkind = 'chapter', if(s.part, 2, 1), h.hlevel)"
    opens = "(h.hkind in ('part', 'chapter', 'matter') or h.level = 1 or (s.part and h.level = 2))"
    path = (f"if({pending}, concat(slice(s.path, 1, s.level - 1), array(array_join(array_append(s.parts, h.text), ' '))), "
            f"concat(slice(s.path, 1, {level} - 1), array(h.text)))")
    chapter = f"if(not ({pending}) and {opens}, s.chapter + 1, s.chapter)"
    moved = f"""named_struct('path', {path}, 'section', s.section + 1, 'chapter', {chapter}, 'part', s.part or h.hkind = 'part',
        'page', if({pending}, s.page, if(h.hkind = 'chapter', h.page, if({opens} or not h.adjacent, null, s.page))),
        'level', if({pending}, s.level, if(h.hkind = 'chapter', least(4, {level} + 1), if({opens} or not h.adjacent, null, s.level))),
        'parts', if({pending}, array_append(s.parts, h.text), if(h.hkind = 'chapter' or {opens} or not h.adjacent, slice(s.parts, 1, 0), s.parts)),
        'first', s.first, 'out', array_append(s.out, named_struct('path', {path}, 'section', s.section + 1, 'chapter', {chapter})))"""
    cleared = """named_struct('path', slice(s.path, 1, 0), 'section', s.section, 'chapter', s.chapter, 'part', s.part, 'page', s.page,
        'level', s.level, 'parts', s.parts, 'first', s.first,
        'out', array_append(s.out, named_struct('path', slice(s.path, 1, 0), 'section', s.section, 'chapter', s.chapter)))"""
    return f"if(h.is_title, {cleared}, {moved})"


def book_units(blocks: DataFrame, titles: DataFrame, target: int, limit: int) -> DataFrame:
    """Units of books: contents removed, levels from contents or headings, roles by
    heading and block role. ``titles``: document_id, title."""
    members, levels = detect_toc(blocks)
    body = blocks.join(members, ["document_id", "ordinal"], "left_anti").join(titles, "document_id", "left")
    heading = F.col("kind") == "heading"
    spread = body.filter(heading).groupBy("document_id").agg((F.count_distinct("level") > 1).alias("informative"))
    named = body.withColumn("norm", F.when(heading, normal_title(F.col("text")))).join(
        levels.withColumnRenamed("title", "norm"), ["document_id", "norm"], "left").join(spread, "document_id", "left")
    bare = F.col("bare")
    decimal = F.col("decimal_mark")
    staged = named.withColumn("bare", X.strip(F.col("text"))).withColumn("decimal_mark", F.regexp_extract(bare, DECIMAL, 1)).withColumn(
        "hkind", F.when(F.rlike(bare, F.lit(PART)), "part").when(F.rlike(bare, F.lit(CHAPTER)), "chapter")
        .when(F.rlike(bare, F.lit(MATTER)), "matter").otherwise("other")).withColumn(
        "deep", F.when(decimal != "", F.least(F.lit(4), dots(decimal) + 2)).otherwise(0))
    hkind, deep = F.col("hkind"), F.col("deep")
    by_name = F.coalesce(
        "toc_level", F.when(hkind == "part", 1).when(hkind == "chapter", 2), F.when(deep > 0, deep), F.least(F.lit(4), F.col("level")))
    doc = W.partitionBy("document_id").orderBy("ordinal")
    shown = F.when(~((F.col("kind") == "image") & (F.coalesce("text", F.lit("")) == "")), F.col("kind"))
    before = F.last(shown, ignorenulls=True).over(doc.rowsBetween(W.unboundedPreceding, -1))
    ctype = (
        F.when(F.col("kind") == "code", "code").when(F.col("kind").isin("caption", "image"), "caption")
        .when(F.col("kind") == "equation", "equation").when(F.lower(F.coalesce("role", F.lit(""))).isin(VERBATIM_ROLES), "verbatim")
        .otherwise("passage"))
    # Text below a summary heading is a summary; that heading is the last one before it.
    last = F.last(F.when(heading, F.col("text")), ignorenulls=True).over(doc.rowsBetween(W.unboundedPreceding, -1))
    summary = (F.col("kind") == "text") & F.coalesce(F.rlike(last, F.lit(SUMMARY)), F.lit(False))
    shaped = staged.select(
        "document_id", "ordinal", "kind", "level", "page", "text", hkind.alias("hkind"), (hkind == "other").alias("other"), deep.alias("decimal"),
        F.when(F.col("informative"), F.least(F.lit(4), F.col("level"))).otherwise(by_name).alias("hlevel"),
        F.coalesce(F.col("norm") == normal_title(F.col("title")), F.lit(False)).alias("is_title"),
        F.coalesce(before == "heading", F.lit(False)).alias("adjacent"), F.coalesce("title", F.lit("")).alias("title"),
        F.when(summary, "summary").otherwise(ctype).alias("ctype"), F.col("kind").isin("code", "table", "equation").alias("atomic"), F.lit("").alias("mkey"))
    sized = H.with_units(shaped, target, limit, H.SENTENCE_END_CJK)
    columns = ["kind", "level", "page", "text", "hkind", "other", "decimal", "hlevel", "is_title", "adjacent", "title", "ctype", "atomic", "mkey", "units"]
    docs = H.heading_states(H.collect_blocks(sized, columns), _BOOK_INIT, _book_step())
    return H.units_of_segments(
        docs, path="if(b.title = '', g.state.path, concat(array(b.title), g.state.path))", key="g.state.chapter")


# -- papers -------------------------------------------------------------------
def paper_section(heading: Column) -> Column:
    bare = F.regexp_replace(X.strip(heading), NUMBER_PREFIX, "")
    name = X.squeeze(F.regexp_replace(F.lower(bare), r"^[ .:]+|[ .:]+$", ""))
    pairs = [F.lit(v) for item in PAPER_SECTIONS.items() for v in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), F.lit("other"))


_PAPER_OUT = "struct<path:array<string>,section:int,name:string,refs:boolean>"
_PAPER_STATE = f"struct<path:array<string>,section:int,name:string,major:int,refs:boolean,first:{_PAPER_OUT},out:array<{_PAPER_OUT}>>"
_PAPER_INIT = (
    "cast(named_struct('path', array(), 'section', 0, 'name', 'other', 'major', 1, 'refs', false, "
    f"'first', named_struct('path', array(), 'section', 0, 'name', 'other', 'refs', false), 'out', array()) as {_PAPER_STATE})")


def _paper_step() -> str:
    relative = "if(h.informative, least(4, greatest(1, h.level - s.major + 1)), if(h.decimal > 0, least(4, h.decimal), least(4, h.level)))"
    nested = "h.found <> 'other' and h.found = s.name and size(s.path) > 0 and h.level > s.major"
    fresh = f"(h.found = 'references' or (h.found <> 'other' and not ({nested})) or (h.found = 'other' and {relative} = 1))"
    path = f"if({fresh}, array(h.text), concat(slice(s.path, 1, {relative} - 1), array(h.text)))"
    name = f"if(h.found <> 'other', h.found, if({relative} = 1, 'other', s.name))"
    refs = "(h.found = 'references' or (s.refs and h.found = 'other' and h.level <> 1))"
    return f"""named_struct('path', {path}, 'section', s.section + 1, 'name', {name},
        'major', if({fresh} and h.found <> 'references', h.level, s.major), 'refs', {refs}, 'first', s.first,
        'out', array_append(s.out, named_struct('path', {path}, 'section', s.section + 1, 'name', {name}, 'refs', {refs})))"""


def paper_units(blocks: DataFrame, target: int, limit: int) -> DataFrame:
    """Units of papers: references dropped, abstracts joined whole, summaries typed."""
    heading = F.col("kind") == "heading"
    spread = blocks.filter(heading).groupBy("document_id").agg((F.count_distinct("level") > 1).alias("informative"))
    decimal = F.regexp_extract(X.strip(F.col("text")), DECIMAL_PREFIX, 1)
    shaped = H.generic_blocks(blocks.join(spread, "document_id", "left")).withColumn(
        "found", F.when(heading, paper_section(F.col("text")))).withColumn(
        "decimal", F.when(decimal != "", dots(decimal) + 1).otherwise(0))
    sized = H.with_units(shaped, target, limit, H.SENTENCE_END_CJK)
    columns = [*H.COLUMNS, "found", "decimal", "informative"]
    docs = H.heading_states(H.collect_blocks(sized, columns), _PAPER_INIT, _paper_step())
    prose = "forall(g.bs, b -> b.kind = 'text')"
    kept = docs.withColumn("segs", F.expr("filter(segs, g -> not g.state.refs)"))
    whole = kept.withColumn("segs", F.expr(f"""transform(segs, g -> if(g.state.name = 'abstract' and size(g.bs) > 0 and {prose},
        named_struct('state', g.state, 'bs', transform(slice(g.bs, 1, 1), b -> named_struct(
            'ordinal', b.ordinal, 'last', element_at(g.bs, -1).ordinal, 'page', b.page, 'ctype', 'passage', 'atomic', true, 'mkey', 'abstract',
            'texts', array_join(transform(g.bs, x -> x.text), '\\n\\n'), 'units', slice(b.units, 1, 0)))),
        named_struct('state', g.state, 'bs', transform(g.bs, b -> named_struct(
            'ordinal', b.ordinal, 'last', b.ordinal, 'page', b.page,
            'ctype', if(b.kind = 'text' and element_at(g.state.path, -1) RLIKE r'{SUMMARY_HEADING}', 'summary', b.ctype),
            'atomic', b.atomic, 'mkey', '', 'texts', '', 'units', b.units)))))""".replace("element_at(g.state.path, -1)", "coalesce(try_element_at(g.state.path, -1), '')")))
    count = f"cast(regexp_count({{0}}, r'{X.TOKEN_PATTERN}') as int)"
    one = ("array(named_struct('t', b.texts, 'sep', '\\n\\n', 'c', " + count.replace("{0}", "b.texts")
           + ", 'jc', 1 + " + count.replace("{0}", "b.texts") + "))")
    return whole.withColumn("us", F.expr(f"""flatten(transform(segs, g -> flatten(transform(g.bs, b -> transform(
        if(b.texts <> '', {one}, b.units), u -> named_struct('t', u.t, 'sep', u.sep, 'c', u.c, 'jc', u.jc, 'start', b.ordinal, 'end', b.last,
            'page', b.page, 'ctype', b.ctype, 'ok', not b.atomic, 'mkey', concat_ws('|', b.ctype, b.mkey),
            'section', g.state.section, 'path', g.state.path))))))""")).drop("segs", "bs")


# -- Markdown -----------------------------------------------------------------
def markdown_units(blocks: DataFrame, target: int, limit: int) -> DataFrame:
    """Units of Markdown blocks (kind, text, source, level, links).

    Lists, quotes, tables and code are whole, the first three with their source as
    text; formatted paragraphs are whole but may merge. A thematic break only opens
    a section.
    """
    sourced = F.col("kind").isin("list", "blockquote", "table")
    formatted = (F.col("kind") == "paragraph") & ((F.size("links") > 0) | (X.strip(F.col("source")) != X.strip(F.col("text"))))
    ctype = F.when(F.col("kind") == "code", "code").when(F.col("kind") == "blockquote", "verbatim").otherwise("passage")
    ordered = blocks.withColumn("ordinal", F.row_number().over(W.partitionBy("document_id").orderBy("start_line")) - 1)
    shaped = ordered.select(
        "document_id", "ordinal", "kind", "level", F.lit(None).cast("int").alias("page"),
        F.when(sourced, F.col("source")).otherwise(F.col("text")).alias("text"), ctype.alias("ctype"),
        (sourced | (F.col("kind") == "code") | formatted).alias("atomic"), (sourced | (F.col("kind") == "code")).alias("closed"), F.lit("").alias("mkey"))
    sized = H.with_units(shaped, target, limit, paragraphs=False).withColumn("atomic", F.col("closed"))
    docs = H.heading_states(
        H.collect_blocks(sized, H.COLUMNS), H.PATH_INIT,
        H.PATH_STEP.replace("concat(slice(s.path, 1, h.level - 1), array(h.text))",
                            "if(h.kind = 'heading', concat(slice(s.path, 1, h.level - 1), array(h.text)), s.path)"),
        control="b.kind in ('heading', 'thematic_break')")
    return H.units_of_segments(docs)


# -- code ---------------------------------------------------------------------
def code_units(blocks: DataFrame, target: int, limit: int) -> DataFrame:
    """Units of code documents: code over the target is cut at line ends, each part a chunk of its own."""
    sized = H.with_units(H.generic_blocks(blocks), target, limit)
    cost = X.token_count(F.col("text"))
    long = (F.col("kind") == "code") & F.coalesce(cost > target, F.lit(False))
    parts = F.transform("parts", lambda p: F.struct(
        p.alias("t"), F.lit("").alias("sep"), X.token_count(p).alias("c"), X.token_count(p).alias("jc")))
    cut_up = H.with_line_parts(sized.withColumn("_full", F.col("text")).withColumn("text", F.when(long, F.col("text"))), limit)
    shaped = cut_up.withColumn("units", F.coalesce(parts, "units")).withColumn("atomic", F.col("atomic") | F.col("parts").isNotNull()).withColumn(
        "text", F.when(F.col("kind") == "heading", F.col("_full")))
    return H.units_of_segments(H.heading_states(H.collect_blocks(shaped, H.COLUMNS), H.PATH_INIT, H.PATH_STEP))


# -- resumes, documentation, mail ---------------------------------------------
def resume_units(blocks: DataFrame, target: int, limit: int) -> DataFrame:
    """Units of resumes: a section begins where (section, role) changes."""
    annotated = C.annotate_resume(blocks)
    doc = W.partitionBy("document_id").orderBy("ordinal")
    boundary = F.concat_ws("|", F.coalesce("section", F.lit("unknown")), F.coalesce("role", F.lit("")))
    changed = (~F.lag(boundary).over(doc).eqNullSafe(boundary)).cast("int")
    numbered = annotated.withColumn("changed", changed).withColumn("part", F.sum("changed").over(doc).cast("int"))
    shaped = H.generic_blocks(numbered).withColumn("mkey", F.col("part").cast("string"))
    sized = H.with_units(shaped, target, limit)
    docs = H.heading_states(H.collect_blocks(sized, [*H.COLUMNS, "part"]), H.PATH_INIT, H.PATH_STEP)
    return H.units_of_segments(docs, section="b.part")


def documentation_units(blocks: DataFrame, target: int, limit: int) -> DataFrame:
    """Units of documentation: headings are text of their own section, task blocks
    and callouts whole, roles part of the merge key."""
    annotated = C.annotate_documentation(blocks)
    shaped = H.generic_blocks(annotated).withColumn(
        "atomic", F.col("kind").isin("table", "equation", "image", "code") | F.coalesce(F.col("role").isin("task_block", "callout"), F.lit(False))).withColumn(
        "mkey", F.concat_ws("|", F.coalesce("role", F.lit("")), F.coalesce("callout_type", F.lit("")))).withColumn(
        "ctype", F.when(F.col("kind").isin("heading", "caption"), "passage").otherwise(F.col("ctype")))
    sized = H.with_units(shaped, target, limit)
    docs = H.heading_states(H.collect_blocks(sized, H.COLUMNS), H.PATH_INIT, H.PATH_STEP)
    # A heading opens its segment: put it in front of the blocks that follow it.
    opened = docs.withColumn("heads", F.expr("filter(bs, b -> b.kind = 'heading')")).withColumn(
        "segs", F.expr("""transform(segs, (g, k) -> named_struct('state', g.state,
            'bs', if(k = 0, g.bs, concat(slice(heads, k, 1), g.bs))))""")).drop("heads")
    return H.units_of_segments(opened)


def email_units(regions: DataFrame, target: int, limit: int) -> DataFrame:
    """Units of messages (document_id, ordinal, message_no, region, body_format, text):
    merging stays within message, region and format."""
    shaped = regions.select(
        "document_id", "ordinal", F.lit("text").alias("kind"), F.lit(None).cast("int").alias("level"), "text",
        F.lit(None).cast("int").alias("page"), F.lit("passage").alias("ctype"), F.lit(False).alias("atomic"),
        F.concat_ws("|", F.col("message_no").cast("string"), "region", "body_format").alias("mkey"), "message_no")
    sized = H.with_units(shaped, target, limit, H.SENTENCE_END_CJK, paragraphs=False)
    docs = H.heading_states(H.collect_blocks(sized, [*H.COLUMNS, "message_no"]), H.PATH_INIT, H.PATH_STEP)
    return H.units_of_segments(docs, section="cast(b.message_no as int)")


def reply_parent_chunks(chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """Parent chunk of every chunk of a reply: the first body chunk of the parent
    message, else its first chunk. ``chunks``: message_id, chunk_no, region;
    ``messages``: message_id, parent_id."""
    body = F.when(F.col("region") == "body", F.col("chunk_no"))
    first = chunks.groupBy("message_id").agg(F.coalesce(F.min(body), F.min("chunk_no")).alias("parent_chunk"))
    linked = messages.filter("parent_id is not null").select("message_id", "parent_id").join(
        first.withColumnRenamed("message_id", "parent_id"), "parent_id")
    return chunks.join(linked, "message_id", "left").select("message_id", "chunk_no", "region", "parent_id", "parent_chunk")


# -- slides -------------------------------------------------------------------
def chunk_slides(blocks: DataFrame, maximum: int) -> tuple[DataFrame, DataFrame]:
    """One chunk per slide: title, body and notes; the title slide is a summary.

    ``blocks``: document_id, ordinal, slide, role, text. Slides whose numbers do
    not rise by one, without text, or over the maximum refuse the document.
    """
    def joined(roles: list[str]) -> Column:
        kept = F.filter("bs", lambda b: b["role"].isin(roles) & (b["text"] != ""))
        return F.array_join(F.transform(kept, lambda b: b["text"]), " ")

    grouped = blocks.groupBy("document_id", "slide").agg(F.sort_array(F.collect_list(F.struct(
        "ordinal", "role", F.coalesce("text", F.lit("")).alias("text"), "page"))).alias("bs"))
    parts = grouped.select(
        "document_id", "slide", joined(["title", "section_divider"]).alias("title"), joined(["body"]).alias("body"), joined(["notes"]).alias("notes"),
        F.exists("bs", lambda b: b["role"] == "section_divider").alias("divides"), F.get("bs", F.lit(0))["page"].alias("page"),
        F.get("bs", F.lit(0))["ordinal"].alias("start_ordinal"), F.element_at("bs", -1)["ordinal"].alias("end_ordinal"))
    text = F.concat_ws(
        "\n\n", F.when(F.col("title") != "", F.concat(F.lit("Title: "), "title")), F.nullif("body", F.lit("")),
        F.when(F.col("notes") != "", F.concat(F.lit("Speaker Notes: "), "notes")))
    doc = W.partitionBy("document_id").orderBy("slide")
    placed = parts.withColumn("text", text).withColumn("tokens", X.token_count(F.col("text"))).withColumn(
        "section_index", F.sum((F.col("divides") & (F.col("slide") > 1)).cast("int")).over(doc).cast("int")).withColumn(
        "gap", F.col("slide") - F.lag("slide", 1, 0).over(doc)).withColumn(
        "rewinds", F.coalesce(F.col("start_ordinal") < F.lag("end_ordinal").over(doc), F.lit(False)))
    reason = (
        F.when(F.col("gap") != 1, "slides not contiguous").when(F.col("rewinds"), "slides not contiguous")
        .when(F.col("text") == "", "slide without text").when(F.col("tokens") > maximum, "unit exceeds the token maximum"))
    judged = placed.withColumn("reason", reason)
    rejects = judged.filter("reason is not null").select("document_id", "slide", "reason")
    good = judged.join(rejects.select("document_id").distinct(), "document_id", "left_anti")
    index = F.row_number().over(W.partitionBy("document_id", "section_index").orderBy("slide")) - 1
    return good.select(
        "document_id", "slide", "section_index", index.alias("chunk_index"), "start_ordinal", "end_ordinal", "page",
        F.when(F.col("slide") == 1, "summary").otherwise("passage").alias("chunk_type"), "title", "tokens", "text"), rejects


def chunk_all(blocks: DataFrame, titles: DataFrame, target: int = H.TARGET, maximum: int = H.MAXIMUM) -> tuple[DataFrame, DataFrame]:
    """Chunks of documents of every type: units by strategy, then one packing.

    ``blocks`` carries doc_type; role, source and ordered may be null.
    """
    limit = H.hard_max(target, maximum)

    def of(*types: str) -> DataFrame:
        return blocks.filter(F.col("doc_type").isin(*types))

    fields = ["document_id", "us"]
    units = (
        H.generic_units(of("generic", "markdown", "email"), target, limit).select(fields)
        .unionByName(code_units(of("code"), target, limit).select(fields))
        .unionByName(book_units(of("book"), titles, target, limit).select(fields))
        .unionByName(paper_units(of("paper"), target, limit).select(fields))
        .unionByName(resume_units(of("resume").drop("role"), target, limit).select(fields)))
    # Packing and rejects both read the units; they are stored once.
    good, bad = H.split_rejects(cut(units), limit)
    packed = H.pack(good, target, limit)
    guides = cut(documentation_units(of("documentation").drop("role"), target, limit).select(fields))
    docs_good, docs_bad = H.split_rejects(guides, limit)
    docs = H.pack(docs_good, target, limit, tail=False)
    slides, slide_bad = chunk_slides(C.annotate_slides(of("slides").drop("role")), limit)
    slides = slides.select(
        "document_id", (F.col("slide") - 1).alias("chunk_no"), "section_index", "chunk_index", "start_ordinal", "end_ordinal", "page",
        "chunk_type", F.array("title").alias("heading_path"), F.lit("").alias("mkey"), F.lit(1).alias("n_units"), "tokens", "text")
    rejects = bad.unionByName(docs_bad).select("document_id", "reason").unionByName(slide_bad.select("document_id", "reason"))
    return packed.unionByName(docs).unionByName(slides), rejects
