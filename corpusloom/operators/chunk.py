"""Chunking: text reduction, heading paths, greedy packing and identities.

Blocks of one document are collected into one row (a document is one stored text,
so this is bounded); reduction to sentences and token counting happen before that,
block by block, and packing is a fold over integer costs inside the row. One
exchange by document serves every strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.scale import broadcast_checked, cut

# Default sizes, short-chunk bound, verbatim bound.
TARGET, MAXIMUM, SHORT, VERBATIM_TARGET = 512, 1024, 15, 150
SENTENCE_END = r"(?<=[.!?])\s+"
SENTENCE_END_CJK = r"(?<=[.!?\x{3002}\x{ff01}\x{ff1f}])\s+"

_STRIP = "regexp_replace({0}, r'^" + X.WS + "+|" + X.WS + "+$', '')"


def hard_max(target: int, maximum: int) -> int:
    return min(maximum, 2 * target)


def _strip(sql: str) -> str:
    return _STRIP.replace("{0}", sql)


#: What ``$`` of the expression above lets stand behind the white space that it strips; texts that end so are left to it.
_ODD_ENDS = "\u2028\u2029"
_BLANKS = " \t\n\r\f\x0b\x85\xa0"


def _trimmed(name: str) -> str:
    """``_strip`` of a column or variable that looks at the ends of the text alone."""
    odd = " or ".join(f"endswith({name}, '{c}')" for c in _ODD_ENDS)
    return f"if({odd}, {_strip(name)}, trim(BOTH '{_BLANKS}' FROM {name}))"


def _count(sql: str) -> str:
    return f"cast(regexp_count({sql}, r'{X.TOKEN_PATTERN}') as int)"


def _words(text: str, target: str) -> str:
    """Greedy words of one oversized text; words keep the white space before them."""
    pieces = rf"regexp_extract_all({text}, r'(?:^|\s+)\S+', 0)"
    bare = r"regexp_replace(w, r'^\s+', '')"
    costed = f"transform({pieces}, w -> named_struct('w', w, 'b', {bare}, 'c', {_count(bare)}, 'jc', {_count('w')}))"
    return f"""aggregate({costed}, cast(named_struct('n', 0, 'acc', '', 'out', array()) as struct<n:int,acc:string,out:array<string>>),
        (s, w) -> if(s.acc <> '' and s.n + w.jc > {target},
            named_struct('n', w.c, 'acc', w.b, 'out', array_append(s.out, s.acc)),
            named_struct('n', if(s.acc = '', w.c, s.n + w.jc), 'acc', if(s.acc = '', w.b, concat(s.acc, w.w)), 'out', s.out)),
        s -> if(s.acc <> '', array_append(s.out, s.acc), s.out))"""


def with_units(
    blocks: DataFrame, target: int, maximum: int, sentence_end: str = SENTENCE_END, paragraphs: bool = True
) -> DataFrame:
    """Add ``units``: array<struct<t, sep, c, jc>> to block rows.

    Expects text, atomic and ctype. A text within the target stays whole; a larger
    one becomes sentences, and a sentence over the maximum becomes greedy words.
    ``c`` counts the unit, ``jc`` the unit with its separator in front: counts add
    up over white-space joints, so packing needs only these integers.
    """
    t = f"if(ctype = 'verbatim', {min(target, VERBATIM_TARGET)}, {target})"
    h = str(maximum)

    def counted(texts: str, x: str) -> str:
        """Each text is counted here and nowhere again."""
        return f"transform({texts}, {x} -> named_struct('t', {x}, 'c', {_count(x)}))"

    def words(text: str) -> str:
        return counted(_words(text, t), "y")

    sentences = f"filter(transform(split(p.t, r'{sentence_end}'), x -> {_trimmed('x')}), x -> x <> '')"
    parts = f"""if(p.c <= {t}, array(p), get(transform(array({sentences}), ss -> if(size(ss) > 1,
        flatten(transform({counted('ss', 'x')}, x -> if(x.c <= {h}, array(x), {words('x.t')}))),
        if(p.c <= {h}, array(p), {words('p.t')}))), 0))"""
    whole = f"array(named_struct('t', text, 'c', {_count('text')}, 'sep', '\\n\\n'))"
    cut = f"if(contains(text, '\\n'), split({_trimmed('text')}, r'\\n[ \\t]*\\n+'), array({_trimmed('text')}))" if paragraphs else "array(text)"
    paras = counted(f"filter(transform({cut}, x -> {_trimmed('x')}), x -> x <> '')", "x")
    reduced = f"flatten(transform({paras}, p -> transform({parts}, (x, k) -> named_struct('t', x.t, 'c', x.c, 'sep', if(k = 0, '\\n\\n', ' ')))))"
    none = "cast(array() as array<struct<t:string,c:int,sep:string>>)"
    raw = blocks.withColumn(
        "_parts", F.expr(f"CASE WHEN text is null OR text = '' THEN {none} WHEN atomic THEN {whole} ELSE {reduced} END"))
    # A separator can join the first word alone, so that only this is counted twice.
    first = r"regexp_extract(u.t, r'^[ \t\n\r\f]*[^ \t\n\r\f]*', 0)"
    joint = f"get(transform(array({first}), w -> u.c + {_count('concat(u.sep, w)')} - {_count('w')}), 0)"
    costed = f"transform(_parts, u -> named_struct('t', u.t, 'sep', u.sep, 'c', u.c, 'jc', {joint}))"
    return raw.withColumn("units", F.expr(costed)).drop("_parts")


def heading_states(docs: DataFrame, init: str, step: str, control: str = "b.kind = 'heading'") -> DataFrame:
    """Add ``segs``: the runs of blocks between control blocks with the folded state.

    ``docs`` has ``bs``, the ordered blocks of a document. ``step`` maps state ``s``
    and control block ``h`` to the next state, which appends one entry to ``s.out``;
    the entry before any control block is ``first`` of the initial state.
    """
    heads = docs.withColumn("hs", F.expr(f"filter(bs, b -> {control})")).withColumn(
        "hx", F.expr(f"filter(transform(bs, (b, i) -> if({control}, i, -1)), i -> i >= 0)"))
    folded = heads.withColumn("st", F.expr(f"aggregate(hs, {init}, (s, h) -> {step})")).withColumn(
        "states", F.expr("concat(array(st.first), st.out)"))
    return folded.withColumn(
        "segs", F.expr("""transform(states, (x, k) -> named_struct('state', x, 'bs',
            slice(bs, if(k = 0, 1, get(hx, k - 1) + 2),
                if(k < size(hx), get(hx, k), size(bs)) - if(k = 0, 0, get(hx, k - 1) + 1))))""")
    ).drop("hs", "hx", "st", "states")


PATH_STATE = "struct<path:array<string>,section:int>"
PATH_INIT = (f"cast(named_struct('path', array(), 'section', 0, 'first', named_struct('path', array(), 'section', 0), 'out', array()) "
             f"as struct<path:array<string>,section:int,first:{PATH_STATE},out:array<{PATH_STATE}>>)")
_NEW_PATH = "concat(slice(s.path, 1, h.level - 1), array(h.text))"
PATH_STEP = (f"named_struct('path', {_NEW_PATH}, 'section', s.section + 1, 'first', s.first, "
             f"'out', array_append(s.out, named_struct('path', {_NEW_PATH}, 'section', s.section + 1)))")


def collect_blocks(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """One row per document with its ordered blocks."""
    return blocks.groupBy("document_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", *columns))).alias("bs"))


def pack(docs: DataFrame, target: int, maximum: int, tail: bool = True) -> DataFrame:
    """Chunk rows from documents with ``us``: ordered array<struct<t, sep, c, jc,
    start, end, page, ctype, ok, mkey, section, path>>.

    A unit joins the current chunk if both may merge, share key and section, touch,
    and the joined count is within the target, or the current one is short and the
    joined count within the maximum. A short last chunk folds back.
    """
    joins = """transform(us, (u, i) -> named_struct('c', u.c, 'jc', u.jc, 'j', i > 0 and u.ok and get(us, i - 1).ok
        and u.mkey <=> get(us, i - 1).mkey and u.section = get(us, i - 1).section and u.start <= get(us, i - 1).end + 1))"""
    fold = f"""aggregate(costs, cast(named_struct('i', 0, 'cur', 0, 'prev', 0, 'starts', array()) as struct<i:int,cur:int,prev:int,starts:array<int>>),
        (s, u) -> if(u.j and (s.cur + u.jc <= {target} or (s.cur < {SHORT} and s.cur + u.jc <= {maximum})),
            named_struct('i', s.i + 1, 'cur', s.cur + u.jc, 'prev', s.prev, 'starts', s.starts),
            named_struct('i', s.i + 1, 'cur', u.c, 'prev', s.cur, 'starts', array_append(s.starts, s.i))))"""
    costed = docs.withColumn("costs", F.expr(joins)).withColumn("f", F.expr(fold)).withColumn(
        "head", F.expr("get(costs, try_element_at(f.starts, -1))")
    )
    folds_back = (
        f"size(f.starts) > 1 and f.cur < {SHORT} and head.j and f.prev + f.cur - head.c + head.jc <= {maximum}" if tail else "false")
    starts = costed.withColumn(
        "starts", F.expr(f"if({folds_back}, slice(f.starts, 1, size(f.starts) - 1), f.starts)"))
    grouped = starts.withColumn(
        "groups", F.expr("""transform(starts, (a, g) -> slice(us, a + 1, coalesce(get(starts, g + 1), size(us)) - a))""")
    ).withColumn("secs", F.expr("transform(groups, g -> get(g, 0).section)")).withColumn(
        "cs", F.expr("""transform(groups, (g, i) -> named_struct(
            'text', array_join(transform(g, (u, k) -> if(k = 0, u.t, concat(u.sep, u.t))), ''),
            'tokens', aggregate(g, 0, (n, u) -> n + u.jc) - get(g, 0).jc + get(g, 0).c,
            'ctype', get(g, 0).ctype, 'section', get(g, 0).section,
            'index', i - cast(array_position(secs, get(g, 0).section) as int) + 1,
            'path', get(g, 0).path, 'page', get(g, 0).page, 'mkey', get(g, 0).mkey, 'n_units', size(g),
            'start', get(g, 0).start, 'end', element_at(g, -1).end))"""))
    return X.unfold(grouped, ["document_id"], F.col("cs"), "c", "chunk_no").select(
        "document_id", "chunk_no", F.col("c.section").alias("section_index"), F.col("c.index").alias("chunk_index"),
        F.col("c.start").alias("start_ordinal"), F.col("c.end").alias("end_ordinal"), F.col("c.page").alias("page"),
        F.col("c.ctype").alias("chunk_type"), F.col("c.path").alias("heading_path"), F.col("c.mkey").alias("mkey"),
        F.col("c.n_units").alias("n_units"), F.col("c.tokens").alias("tokens"), F.col("c.text").alias("text"))


def units_of_segments(docs: DataFrame, section: str = "g.state.section", path: str = "g.state.path", key: str = "b.mkey") -> DataFrame:
    """Flatten segments into ``us`` with the state of their segment."""
    return docs.withColumn("us", F.expr(f"""flatten(transform(segs, g -> flatten(transform(g.bs, b -> transform(b.units, u ->
        named_struct('t', u.t, 'sep', u.sep, 'c', u.c, 'jc', u.jc, 'start', b.ordinal, 'end', b.ordinal, 'page', b.page,
            'ctype', b.ctype, 'ok', not b.atomic, 'mkey', concat_ws('|', b.ctype, {key}), 'section', {section}, 'path', {path}))))))""")
    ).drop("segs", "bs")


def oversized(docs: DataFrame, maximum: int) -> Column:
    """A document with a unit over the maximum is refused whole."""
    return F.exists("us", lambda u: u["c"] > maximum)


def split_rejects(docs: DataFrame, maximum: int) -> tuple[DataFrame, DataFrame]:
    """Documents that can be packed, and one reason row for each of the others."""
    marked = docs.withColumn("_worst", F.expr("aggregate(us, 0, (m, u) -> greatest(m, u.c))"))
    good = marked.filter(F.col("_worst") <= maximum).drop("_worst")
    bad = marked.filter(F.col("_worst") > maximum).select(
        "document_id", F.lit("unit exceeds the token maximum").alias("reason"), F.col("_worst").alias("tokens"))
    return good, bad


def generic_blocks(blocks: DataFrame) -> DataFrame:
    """Chunk types of the general strategy; equations and tables are never split."""
    ctype = (
        F.when(F.col("kind") == "code", "code").when(F.col("kind").isin("caption", "image"), "caption")
        .when(F.col("kind") == "equation", "equation").otherwise("passage"))
    return blocks.withColumn("ctype", ctype).withColumn("atomic", F.col("kind").isin("equation", "table")).withColumn(
        "mkey", F.lit(""))


COLUMNS = ["kind", "level", "text", "page", "ctype", "atomic", "mkey", "units"]


def generic_units(blocks: DataFrame, target: int, maximum: int) -> DataFrame:
    typed = with_units(generic_blocks(blocks), target, maximum)
    light = typed.withColumn("text", F.when(F.col("kind") == "heading", F.col("text")))
    docs = heading_states(collect_blocks(light, COLUMNS), PATH_INIT, PATH_STEP)
    return units_of_segments(docs)


def chunk_generic(blocks: DataFrame, target: int = TARGET, maximum: int = MAXIMUM) -> tuple[DataFrame, DataFrame]:
    """Chunks and rejects of the general strategy."""
    limit = hard_max(target, maximum)
    good, bad = split_rejects(generic_units(blocks, target, limit), limit)
    return pack(good, target, limit), bad


def heading_paths(blocks: DataFrame) -> DataFrame:
    """(document_id, ordinal, section, path) of every block that is no heading.

    A heading cuts the path above its level and adds itself; a skipped level
    leaves the deeper heading in place.
    """
    docs = heading_states(collect_blocks(blocks, ["kind", "level", "text"]), PATH_INIT, PATH_STEP)
    rows = F.expr("""flatten(transform(segs, g -> transform(g.bs, b -> named_struct(
        'ordinal', b.ordinal, 'section', g.state.section, 'path', g.state.path))))""")
    return X.unfold(docs, ["document_id"], rows, "r").select("document_id", "r.ordinal", "r.section", "r.path")


def drop_short(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop drafts under the short bound; short parents with children are errors.

    ``drafts``: document_id, idx, parent_idx, tokens, preserve. Survivors are
    renumbered and parents remapped.
    """
    short = (F.col("tokens") < SHORT) & ~F.col("preserve")
    marked = drafts.withColumn("short", short)
    parents = drafts.filter("parent_idx is not null").select("document_id", F.col("parent_idx").alias("idx")).distinct()
    errors = marked.filter("short").join(parents, ["document_id", "idx"], "left_semi").select("document_id", "idx")
    kept = marked.filter("not short").withColumn(
        "new_idx", F.row_number().over(W.partitionBy("document_id").orderBy("idx")) - 1)
    renamed = kept.select("document_id", F.col("idx").alias("parent_idx"), F.col("new_idx").alias("new_parent"))
    return kept.join(renamed, ["document_id", "parent_idx"], "left").select(
        "document_id", "idx", "new_idx", "new_parent", "tokens"), errors


def chunk_id(version: Column, start: Column, end: Column, text: Column) -> Column:
    """SHA-256 of the JSON array [version, [start, end], text]."""
    return F.sha2(F.concat(
        F.lit("["), X.json_text(F.lower(version)), F.lit(",["), start.cast("string"), F.lit(","), end.cast("string"), F.lit("],"),
        X.json_text(text), F.lit("]")), 256)


def with_ids(chunks: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk ids, and the documents in which an id repeats."""
    named = chunks.join(versions.select("document_id", "version_id"), "document_id").withColumn(
        "chunk_id", chunk_id(F.col("version_id"), F.col("start_ordinal"), F.col("end_ordinal"), F.col("text")))
    return named, repeated_ids(named)


def repeated_ids(named: DataFrame) -> DataFrame:
    """Documents in which an id repeats."""
    return named.groupBy("document_id", "chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("document_id").distinct()


def families(chunks: DataFrame) -> DataFrame:
    """(parent_id, chunk_id, position, sibling_ids): every child with the others of its family, in order.

    A family is the children of one parent chunk, which the packer bounds by its
    size; its ids stand in one array per parent.
    """
    children = chunks.filter("parent_id is not null").select("parent_id", "ordinal", "chunk_id")
    family = children.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id"))).alias("members"))
    ids = F.transform("members", lambda m: m["chunk_id"])
    return family.select("parent_id", ids.alias("ids"), F.posexplode(ids).alias("position", "chunk_id")).select(
        "parent_id", "chunk_id", (F.col("position") + 1).cast("long").alias("position"),
        F.filter("ids", lambda x: x != F.col("chunk_id")).alias("sibling_ids"))


def finish(chunks: DataFrame, versions: DataFrame, parents: DataFrame | None = None, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Drafts of every strategy as chunks: short leaves dropped, ids, parents and siblings; and rejected documents.

    ``parents``: document_id, chunk_no, parent_no of the drafts that have a parent.
    ``keep``: drafts that stay however short. A short parent with children refuses its
    document, and so do two drafts with one identity. The rest is numbered from 0.
    """
    short = (F.col("tokens") < SHORT) & ~(F.lit(False) if keep is None else F.coalesce(keep, F.lit(False)))
    drafts = chunks.withColumn("_short", short)
    if parents is None:
        drafts = drafts.withColumn("parent_no", F.lit(None).cast("int"))
    else:
        drafts = drafts.join(parents.select("document_id", "chunk_no", "parent_no"), ["document_id", "chunk_no"], "left")
    # Drafts with their ids are stored once: checks, parents, siblings and the rows themselves read them.
    drafts = cut(drafts.join(versions.select("document_id", "version_id", F.lit(True).alias("_known")), "document_id", "left").withColumn(
        "chunk_id", chunk_id(F.col("version_id"), F.col("start_ordinal"), F.col("end_ordinal"), F.col("text"))))
    used = drafts.filter("parent_no is not null").select("document_id", F.col("parent_no").alias("chunk_no")).distinct()
    orphaned = drafts.filter("_short").select("document_id", "chunk_no").join(used, ["document_id", "chunk_no"], "left_semi").select("document_id").distinct()
    live = drafts.filter("_known and not _short").drop("_known", "_short")
    reasons = orphaned.select("document_id", F.lit("short parent").alias("reason")).unionByName(
        repeated_ids(live).select("document_id", F.lit("repeated chunk").alias("reason")))
    rejects = cut(reasons.groupBy("document_id").agg(F.max("reason").alias("reason")))
    good = live.join(broadcast_checked(rejects.select("document_id")), "document_id", "left_anti")
    above = good.select("document_id", F.col("chunk_no").alias("parent_no"), F.col("chunk_id").alias("parent_id"))
    placed = good.join(above, ["document_id", "parent_no"], "left").withColumn(
        "ordinal", F.row_number().over(W.partitionBy("document_id").orderBy("chunk_no")) - 1)
    kin = families(placed).select("chunk_id", "parent_id", "sibling_ids")
    none = F.array().cast("array<string>")
    done = placed.join(kin, ["chunk_id", "parent_id"], "left").withColumn("sibling_ids", F.coalesce("sibling_ids", none))
    return done.drop("parent_no", "chunk_no"), rejects


def table_chunks(tables: DataFrame, target: int, maximum: int) -> DataFrame:
    """Tables (document_id, ordinal, rows, header_rows) as chunks of whole rows.

    A table within the maximum stays whole; a larger one repeats its header in
    batches that reach the target. A row over the maximum is reported.
    """
    render = "array_join(transform({0}, r -> array_join(r, '\\t')), '\\n')"
    based = tables.withColumn("full", F.expr(_strip(render.replace("{0}", "rows")))).withColumn(
        "n", F.expr(_count("full"))).withColumn(
        "head", F.expr(render.replace("{0}", "slice(rows, 1, header_rows)"))).withColumn(
        "body", F.expr("transform(slice(rows, header_rows + 1, size(rows)), r -> array_join(r, '\\t'))"))
    costed = based.withColumn("head_cost", F.expr(_count(_strip("head")))).withColumn(
        "costs", F.expr(f"transform(body, r -> {_count('concat(chr(10), r)')})"))
    fold = f"""aggregate(costs, cast(named_struct('i', 0, 'cur', 0, 'starts', array()) as struct<i:int,cur:int,starts:array<int>>),
        (s, c) -> if(s.i > 0 and head_cost + s.cur + c <= {target},
            named_struct('i', s.i + 1, 'cur', s.cur + c, 'starts', s.starts),
            named_struct('i', s.i + 1, 'cur', c, 'starts', array_append(s.starts, s.i)))).starts"""
    cut = costed.withColumn("starts", F.expr(f"if(n <= {maximum}, array(0), {fold})")).withColumn(
        "worst", F.expr("head_cost + coalesce(array_max(costs), 0)"))
    batches = cut.withColumn("parts", F.expr(f"""if(n <= {maximum}, array(full), transform(starts, (a, g) ->
        {_strip("concat(head, chr(10), array_join(slice(body, a + 1, coalesce(get(starts, g + 1), size(body)) - a), chr(10)))")}))"""))
    rows = X.unfold(batches, ["document_id", "ordinal", "n", "worst"], F.col("parts"), "text", "part")
    return rows.select(
        "document_id", "ordinal", "part", "text", X.token_count(F.col("text")).alias("tokens"),
        ((F.col("n") > maximum) & (F.col("worst") > maximum)).alias("refused"))


def with_line_parts(rows: DataFrame, maximum: int) -> DataFrame:
    """Add ``parts``: consecutive pieces of ``text`` within the limit, cut at line ends.

    A longer line is cut after its last blank that still fits; nothing is lost:
    the parts joined give the text again.
    """
    pieces = r"regexp_extract_all(ln, r'[^ \t]*(?:[ \t]+|$)', 0)"
    words = (f"aggregate(transform(filter({pieces}, p -> p <> ''), p -> named_struct('p', p, 'c', {_count('p')})), "
             "cast(named_struct('n', 0, 'acc', '', 'out', array()) as struct<n:int,acc:string,out:array<string>>), "
             f"(s, w) -> if(s.acc <> '' and s.n + w.c > {maximum}, named_struct('n', w.c, 'acc', w.p, 'out', array_append(s.out, s.acc)), "
             "named_struct('n', s.n + w.c, 'acc', concat(s.acc, w.p), 'out', s.out)), s -> if(s.acc <> '', array_append(s.out, s.acc), s.out))")
    lines = r"filter(regexp_extract_all(text, r'[^\n]*(?:\n|$)', 0), x -> x <> '')"
    segments = rows.withColumn(
        "segs", F.expr(f"flatten(transform({lines}, ln -> if({_count('ln')} <= {maximum}, array(ln), {words})))")).withColumn(
        "cs", F.expr(f"transform(segs, x -> {_count('x')})"))
    fold = f"""aggregate(cs, cast(named_struct('i', 0, 'cur', 0, 'starts', array()) as struct<i:int,cur:int,starts:array<int>>),
        (s, c) -> if(s.i > 0 and s.cur + c <= {maximum},
            named_struct('i', s.i + 1, 'cur', s.cur + c, 'starts', s.starts),
            named_struct('i', s.i + 1, 'cur', c, 'starts', array_append(s.starts, s.i)))).starts"""
    return segments.withColumn("starts", F.expr(fold)).withColumn(
        "parts", F.expr("transform(starts, (a, g) -> array_join(slice(segs, a + 1, coalesce(get(starts, g + 1), size(segs)) - a), ''))")
    ).drop("segs", "cs", "starts")


def line_windows(sources: DataFrame, maximum: int) -> DataFrame:
    """Line parts of code (symbol, text), one row each."""
    rows = with_line_parts(sources, maximum)
    return X.unfold(rows, ["symbol", F.size("parts").alias("part_count")], F.col("parts"), "text", "part_index")


def called_by(declarations: DataFrame) -> DataFrame:
    """(file, symbol, caller) pairs: callers of every declared symbol.

    ``declarations``: file_id, symbol, calls. Calls are made distinct before the
    join, so a symbol called often in one body counts once.
    """
    calls = X.unfold(declarations, ["file_id", F.col("symbol").alias("caller")], F.array_distinct("calls"), "symbol")
    return declarations.select("file_id", "symbol").distinct().join(calls, ["file_id", "symbol"])
