"""Document types and the annotation of resumes, slides and documentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.sources.files import extension

# Extensions that decide the type, and heading patterns in their order.
CODE_TYPES = [
    ".py", ".js", ".ts", ".rs", ".go", ".java", ".c", ".cpp", ".h", ".hpp", ".sh", ".json", ".yaml", ".yml",
    ".toml", ".ini", ".css", ".html", ".xml", ".rb", ".php"]
HEADING_TYPES = [
    ("paper", r"^(abstract|references|methodology|conclusion)$"),
    ("book", r"^(?:chapter\s+(?:\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|"
             r"thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)|prologue|epilogue|table of contents)$"),
    ("resume", r"^(experience|education|skills|employment history|resume|cv)$"),
    ("documentation", r"^(api reference|getting started|installation|quickstart)$"),
    ("slides", r"^(slide 1|presentation)$"),
]
RESUME_SECTIONS = [
    ("experience", r"^(experience|employment history|work history)$"),
    ("education", r"^(education|academic background)$"),
    ("skills", r"^(skills|technical skills|core competencies)$"),
    ("projects", r"^(projects|personal projects)$"),
    ("publications", r"^(publications|papers|selected publications)$"),
    ("summary", r"^(summary|profile|objectives|professional summary)$"),
    ("contact", r"^(contact|contact information)$"),
]
TOC_HEADING = r"^(table of contents|contents|in this article|on this page)$"
API_HEADING = (
    r"^(api(\s+reference)?|reference|endpoints?|functions?|methods?|classes?|interfaces?|types?|parameters?|"
    r"arguments?|returns?|responses?|properties?)$")
CALLOUT_FENCE = r"(?m)^:::(note|warning|tip|caution|important)\b"
CALLOUT_QUOTE = r"(?m)^>\s*(?:\*\*)?(note|warning|tip|caution|important)(?:\*\*)?:?"
CALLOUT_START = r"^(note|warning|tip|caution|important)\b"
CODE_SHARE = 0.8


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first pattern that fits, in the order of the rules."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(F.rlike(low, F.lit(pattern)), name).otherwise(out)
    return out


def classify(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Document type: extension, then first telling heading, then share of code.

    One aggregation over the blocks, combined before the exchange.
    """
    ext = extension(F.col("path"))
    by_name = (
        F.when(ext.isin(CODE_TYPES), "code").when(ext.isin(".md", ".markdown"), "markdown")
        .when(ext.isin(".eml", ".msg"), "email").when(ext.isin(".ppt", ".pptx"), "slides"))
    heading = F.when(F.col("kind") == "heading", first_match(F.trim("text"), HEADING_TYPES))
    told = blocks.withColumn("told", heading)
    counted = told.groupBy("document_id").agg(
        F.min_by("told", F.when(F.col("told").isNotNull(), F.col("ordinal"))).alias("by_heading"),
        F.count_if(F.col("kind") == "code").alias("code"),
        F.count_if(F.col("kind").isin("code", "text", "table")).alias("structural"))
    mostly_code = F.when((F.col("structural") > 0) & (F.col("code") / F.col("structural") > CODE_SHARE), "code")
    return files.select("document_id", by_name.alias("by_name")).join(counted, "document_id", "left").select(
        "document_id", F.coalesce("by_name", "by_heading", mostly_code, F.lit("generic")).alias("doc_type"))


def _with_headings(blocks: DataFrame, init: str, step: str, output: str) -> DataFrame:
    """Blocks with the state after their last heading, folded over headings only.

    ``step`` maps state ``s`` and heading ``h`` (ordinal, level, text) to the next
    state struct; ``output`` names the fields kept. Headings of one document are
    collected, blocks are not.
    """
    window = W.partitionBy("document_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    placed = blocks.withColumn("heading_no", F.sum((F.col("kind") == "heading").cast("int")).over(window))
    heads = blocks.filter("kind = 'heading'").groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "level", F.lower(F.trim("text")).alias("text")))).alias("hs"))
    folded = heads.select("document_id", F.expr(f"aggregate(hs, {init}, (s, h) -> {step})").alias("s"))
    states = folded.select("document_id", F.posexplode(F.col("s.out")).alias("no", "state")).withColumn(
        "heading_no", F.col("no") + 1).drop("no")
    return placed.join(states, ["document_id", "heading_no"], "left").select(
        *[F.col(c) for c in blocks.columns], *[F.col(f"state.{f}").alias(f) for f in output.split()])


def _sql_rules(rules: list[tuple[str, str]], text: str) -> str:
    cases = " ".join(f"WHEN {text} RLIKE r'{pattern}' THEN '{name}'" for name, pattern in rules)
    return f"CASE {cases} END"


def annotate_resume(blocks: DataFrame) -> DataFrame:
    """Section of every block and the running role below an experience heading."""
    section = _sql_rules(RESUME_SECTIONS, "h.text")
    kind = "struct<section:string,section_level:int,roles:int,role:int,role_level:int,m:string,out:array<struct<section:string,role:int>>>"
    init = f"cast(named_struct('section', null, 'section_level', 0, 'roles', 0, 'role', null, 'role_level', null, 'm', null, 'out', array()) as {kind})"
    # The heading is matched once per step by folding over a one-element array.
    starts = ("x.m is null and s.section = 'experience' and h.level > s.section_level "
              "and (s.role_level is null or h.level <= s.role_level)")
    step = f"""aggregate(array(named_struct('m', {section})), s, (z, x) -> named_struct(
        'section', coalesce(x.m, s.section),
        'section_level', if(x.m is not null, h.level, s.section_level),
        'roles', if({starts}, s.roles + 1, s.roles),
        'role', if(x.m = 'experience', null, if({starts}, s.roles + 1, s.role)),
        'role_level', if(x.m = 'experience', null, if({starts}, h.level, s.role_level)),
        'm', x.m,
        'out', array_append(s.out, named_struct('section', coalesce(x.m, s.section),
               'role', if(x.m = 'experience', null, if({starts}, s.roles + 1, s.role))))))"""
    annotated = _with_headings(blocks, init, step, "section role")
    role = F.when((F.col("section") == "experience") & F.col("role").isNotNull(),
                  F.concat(F.lit("role-"), F.lpad(F.col("role").cast("string"), 6, "0")))
    return annotated.withColumn("role", role)


def annotate_slides(blocks: DataFrame) -> DataFrame:
    """Slide number by first appearance of the page; first heading is the title.

    Without any page all blocks are on slide 1; otherwise each block without a
    page is a slide of its own.
    """
    doc = W.partitionBy("document_id")
    key = F.when(F.col("page").isNull(), -1 - F.col("ordinal")).otherwise(F.col("page"))
    keyed = blocks.withColumn("slide_key", F.when(F.count("page").over(doc) == 0, F.lit(0)).otherwise(key))
    first = keyed.withColumn("first_ordinal", F.min("ordinal").over(W.partitionBy("document_id", "slide_key")))
    numbered = first.withColumn("slide", F.dense_rank().over(doc.orderBy("first_ordinal")))
    heading = F.col("kind") == "heading"
    place = F.sum(heading.cast("int")).over(
        W.partitionBy("document_id", "slide").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0))
    role = F.when(heading & (place == 1), "title").otherwise("body")
    return numbered.withColumn("role", role).withColumn("is_title_slide", F.col("slide") == 1).drop("slide_key", "first_ordinal")


def callout(source: Column, text: Column, kind: Column) -> Column:
    """Callout type from a fence, a quote, or the first words of a text block."""
    fence = F.lower(F.regexp_extract(source, "(?i)" + CALLOUT_FENCE, 1))
    quote = F.lower(F.regexp_extract(source, "(?i)" + CALLOUT_QUOTE, 1))
    start = F.regexp_extract(F.trim(text), r"^[^\n]*", 0)
    word = F.regexp_extract(start, "(?i)" + CALLOUT_START, 1)
    follows = F.substring(start, F.length(word) + 1, F.lit(1)) == ":"
    shout = (F.upper(start) == start) & (F.lower(start) != start)
    plain = F.when((kind == "text") & (word != "") & (follows | shout), F.lower(word))
    return F.coalesce(F.nullif(fence, F.lit("")), F.nullif(quote, F.lit("")), plain)


def annotate_documentation(blocks: DataFrame) -> DataFrame:
    """Roles of documentation blocks: toc, api_reference, callout, task_block.

    ``blocks`` has ``source`` (Markdown source or null) and ``ordered`` (lists).
    """
    kind = "struct<toc:boolean,api:int,out:array<struct<toc:boolean,api:boolean>>>"
    init = f"cast(named_struct('toc', false, 'api', null, 'out', array()) as {kind})"
    toc, api = f"h.text RLIKE r'{TOC_HEADING}'", f"h.text RLIKE r'{API_HEADING}'"
    level = f"CASE WHEN {toc} THEN null WHEN {api} THEN h.level WHEN s.api is not null and h.level > s.api THEN s.api END"
    step = f"""named_struct('toc', {toc}, 'api', {level},
        'out', array_append(s.out, named_struct('toc', {toc}, 'api', ({level}) is not null)))"""
    state = _with_headings(blocks, init, step, "toc api")
    callout_type = F.when(F.col("kind") != "heading", callout(F.coalesce("source", F.lit("")), F.col("text"), F.col("kind")))
    marked = state.withColumn("callout_type", callout_type)
    heading = F.col("kind") == "heading"
    role = (
        F.when(F.col("callout_type").isNotNull(), "callout")
        .when((F.col("kind") == "list") & F.col("ordered"), "task_block")
        .when(heading & F.col("toc"), "toc").when(heading & F.col("api"), "api_reference")
        .when(~heading & F.col("toc") & F.col("kind").isin("list", "text"), "toc")
        .when(~heading & F.col("api"), "api_reference"))
    return marked.withColumn("role", role).drop("toc", "api")
