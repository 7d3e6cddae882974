"""Registered context, citation, embedding, graph and thread queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.scale import broadcast_checked
from corpusloom.operators import context as C
from corpusloom.operators import embed as E
from corpusloom.operators import graph as G
from corpusloom.operators import retrieve as Q
from corpusloom.operators import threads as M
from corpusloom.plans.library_plans import uuid_sql
from corpusloom.plans.retrieval_plans import DENSE, ranked
from corpusloom.plans.sqlbase import ntok, oracle
from corpusloom.plans.tables import Library

PROMPT = "Answer only from the sources below and cite them."
NOW = "2025-01-01 00:00:00"


def _context(lib: Library) -> DataFrame:
    """Dense candidates packed into budgets that differ by query; every tenth has none."""
    top = Q.dense_topk(lib.vectors(), lib.query_vectors(), 10).filter("qid % 10 <> 9")
    rows = lib.passages().join(broadcast_checked(top), "chunk_id").join(lib.versions().select("document_id", "title"), "document_id").select(
        "qid", "rank", "chunk_id", "document_id", "version_id", "title", F.array("source_name").alias("heading_path"), "page", "text")
    queries = lib.queries().select("qid", F.col("text").alias("query"), (F.lit(40) + F.col("qid") * 37 % 900).cast("int").alias("budget"))
    return C.build_context(queries, rows, PROMPT)


def pack_context(spark: SparkSession, d: str) -> DataFrame:
    return C.context_items(_context(Library(spark, d))).select("qid", "source_number", "chunk_id", "kind", "rendered")


def context_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _context(Library(spark, d)).select(
        "qid", "budget", "overhead", "available", "context_tokens", "empty_reason", F.size("taken").alias("n_items"),
        (F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)) - F.size("taken")).alias("n_omitted"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    scores = Q.dense_topk(lib.vectors(), lib.query_vectors(), 10).select("qid", "chunk_id", F.round("score", 6).alias("confidence"))
    return C.context_items(_context(lib)).join(scores, ["qid", "chunk_id"]).select("qid", "source_number", "chunk_id", "title", "page", "confidence")


FORMS = [
    " [source:1] and [source:2].", " [source:2][source:1][source:2]", "", " [source:01] [source:1]", " [Source:1] [source:3]", " [source:99] x [source:1",
]


def _answers(lib: Library) -> DataFrame:
    """Turns as answers with one of six marker forms, to all queries in turn."""
    asked = lib.queries().count()
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return lib.read("conversations").select(
        F.concat_ws("-", F.lit("A"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"),
        (F.col("conv_id") % asked).alias("qid"), F.concat("text", form).alias("answer"))


def citation_markers(spark: SparkSession, d: str) -> DataFrame:
    answers = _answers(Library(spark, d))
    return C.marker_verdicts(answers).join(C.markers(answers), "answer_id", "left")


def citation_compliance(spark: SparkSession, d: str) -> DataFrame:
    return C.compliance(_answers(Library(spark, d)).withColumn("n_items", (F.col("qid") % 4).cast("int")))


def resolve_citations(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return C.resolve(_answers(lib), C.context_items(_context(lib)))[0]


# -- embeddings ---------------------------------------------------------------
def embed_cache_join(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return E.cache_lookup(lib.documents(), lib.cache(), "m", NOW, 64).select("key", "status")


def cache_ttl(spark: SparkSession, d: str) -> DataFrame:
    return E.live_entries(Library(spark, d).cache(), NOW).select("key", "written", "dimensions")


def cache_clear(spark: SparkSession, d: str) -> DataFrame:
    return E.clear_namespace(Library(spark, d).cache(), "a").select("key", "written")


def embed_missing(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return E.embed_missing(lib.documents(), E.cache_lookup(lib.documents(), lib.cache(), "m", NOW, 64), "m")


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    return E.hashed_buckets(Library(spark, d).documents().select(F.col("doc_id").alias("text_id"), "text"))


def plan_dense_query(spark: SparkSession, d: str) -> DataFrame:
    sub = Library(spark, d).read("conversations").select(
        F.col("conv_id").alias("plan_id"), F.col("turn").alias("idx"), "text",
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "sparse").when(F.col("turn") % 2 == 0, "hybrid").otherwise("dense").alias("mode"))
    return E.dense_query(sub)


# -- graph --------------------------------------------------------------------
def graph_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Supplies edges arrive again for every line item with a weight from its discount."""
    lib = Library(spark, d)
    old = lib.edges().withColumn("weight", F.lit(0.5))
    new = lib.read("lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_id"), F.lit("supplies").alias("relation"),
        (F.col("l_discount") * 12).alias("weight"), "l_orderkey", "l_linenumber")
    merged, _ = G.upsert_edges(old, new, [F.col("l_orderkey").desc(), F.col("l_linenumber").desc(), F.col("weight")])
    return merged.select("edge_id", F.round("weight", 6).alias("weight"))


def find_entities(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    names = lib.read("part").select(F.col("p_name").alias("name"))
    return G.find_entities(lib.entities(), names, "part", [str(i) for i in range(25)], 500)


def k_hop(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return G.k_hop(lib.entities().filter("entity_type = 'region'"), lib.edges(), 3)


def graph_delete(spark: SparkSession, d: str) -> DataFrame:
    """Documents labelled toxic lose their entities, and these their edges."""
    lib = Library(spark, d)
    gone = lib.read("labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    entities, edges = G.delete_document(lib.entities(), lib.edges(), gone)
    return entities.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id")).unionByName(
        edges.select(F.lit("edge").alias("kind"), G.edge_id().alias("id")))


def notebook_graph(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    nodes, edges = G.notebook_graph(lib.sources(), lib.entities(), lib.edges())
    return nodes.select("notebook_id", F.lit("node").alias("kind"), F.col("entity_id").alias("id")).unionByName(
        edges.select("notebook_id", F.lit("edge").alias("kind"), G.edge_id().alias("id")))


# -- threads ------------------------------------------------------------------
def thread_components(spark: SparkSession, d: str) -> DataFrame:
    messages = Library(spark, d).messages()
    return M.components(M.identifiers(messages).select("id").distinct(), M.links(messages))


def reply_parent(spark: SparkSession, d: str) -> DataFrame:
    return M.reply_parents(Library(spark, d).messages())


def reply_cycles(spark: SparkSession, d: str) -> DataFrame:
    return M.cycle_members(M.reply_parents(Library(spark, d).messages()))


def thread_key(spark: SparkSession, d: str) -> DataFrame:
    return M.thread_keys(Library(spark, d).messages())


def thread_order(spark: SparkSession, d: str) -> DataFrame:
    return M.thread_order(Library(spark, d).messages()).select("thread_key", "source_index", "parent", F.col("position").cast("long").alias("position"))


def _bodies(lib: Library) -> DataFrame:
    """Turns as mail bodies with quotes, a reply line and a signature by line."""
    def shape(line, i):
        return (
            F.when(i % 6 == 2, F.concat(F.lit("> "), line)).when(i == 3, F.concat(line, F.lit("\nOn Monday, someone wrote:")))
            .when(i == 5, F.concat(F.lit("-- \n"), line)).otherwise(line))
    return lib.documents().select(
        F.col("doc_id").cast("string").alias("message_id"), F.array_join(F.transform(X.lines(F.col("text")), shape), "\n").alias("body"))


def mail_regions(spark: SparkSession, d: str) -> DataFrame:
    return M.split_regions(_bodies(Library(spark, d))).select("message_id", F.col("run").cast("int").alias("run"), "region", "text")


QUERIES = {f.__name__: f for f in (
    pack_context, context_reasons, evidence, citation_markers, citation_compliance, resolve_citations,
    embed_cache_join, cache_ttl, cache_clear, embed_missing, hashed_vectors, plan_dense_query,
    graph_upsert, find_entities, k_hop, graph_delete, notebook_graph,
    thread_components, reply_parent, reply_cycles, thread_key, thread_order, mail_regions)}

HEAD = """'=== Source [' || {0} || '] | document_id=' || document_id || ' | version_id=' || version_id || ' | title=' || to_json(title)
  || ' | heading=' || to_json(source_name) || ' | page=' || page || ' ===' || chr(10) || text"""
CONTEXT = {
    **DENSE, "top": ranked("dense_scored", 10),
    "cand": f"SELECT t.qid, t.rank, t.score, p.*, v.title, {HEAD.format(1)} AS r1 FROM top t JOIN passages p USING (chunk_id) JOIN (SELECT document_id AS vd, title FROM versions) v ON v.vd = p.document_id WHERE qid % 10 <> 9".replace(
        "document_id || ' | version", "p.document_id || ' | version"),
    "cost": f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS no, {ntok('r1')} AS c, {ntok('(chr(10) || chr(10) || r1)')} AS jc FROM cand",
    "asked": f"""SELECT qid, CAST(40 + qid * 37 % 900 AS INTEGER) AS budget, CAST({ntok("('SYSTEM' || chr(10) || '" + PROMPT + "' || chr(10) || 'QUESTION' || chr(10) || text || chr(10) || 'HISTORY' || chr(10))")} AS INTEGER) AS overhead FROM queries""",
    "avail": "SELECT *, greatest(0, budget - overhead) AS available FROM asked",
    "ctx": """SELECT qid, no, c AS n, true AS taken FROM cost WHERE no = 1
        UNION ALL SELECT k.qid, k.no, CASE WHEN k.no <= 3 OR x.n + k.jc <= a.available THEN x.n + k.jc ELSE x.n END, k.no <= 3 OR x.n + k.jc <= a.available
        FROM ctx x JOIN cost k ON k.qid = x.qid AND k.no = x.no + 1 JOIN avail a ON a.qid = x.qid""",
    "judged": """SELECT a.*, CASE WHEN l.lead IS NULL THEN 'no_candidates' WHEN overhead >= budget THEN 'fixed_overhead_exhausted' WHEN l.lead > available THEN 'verbatim_prefix_does_not_fit' END AS empty_reason,
        coalesce(size, 0) AS size FROM avail a LEFT JOIN (SELECT qid, max(n) FILTER (no <= 3) AS lead, count(*) AS size FROM ctx GROUP BY 1) l USING (qid)""",
    "picked": """SELECT k.*, CAST(row_number() OVER (PARTITION BY k.qid ORDER BY k.no) AS INTEGER) AS source_number FROM ctx x JOIN cost k USING (qid, no) JOIN judged j USING (qid) WHERE x.taken AND j.empty_reason IS NULL""",
}
FORMS_SQL = "[" + ", ".join("'" + f + "'" for f in FORMS) + "]"
ANSWERS = f"SELECT 'A-' || conv_id || '-' || turn AS answer_id, conv_id % (SELECT count(*) FROM benchmark) AS qid, text || {FORMS_SQL}[(conv_id + turn) % 6 + 1] AS answer FROM conversations"
MARKS_SQL = {
    "answers_in": ANSWERS,
    "found": r"""SELECT answer_id, CAST(number AS BIGINT) AS source_number, CAST(min(pos) - 1 AS INTEGER) AS position FROM (
        SELECT answer_id, unnest(regexp_extract_all(answer, '\[source:([1-9][0-9]*)\]', 1)) AS number, generate_subscripts(regexp_extract_all(answer, '\[source:([1-9][0-9]*)\]', 1), 1) AS pos FROM answers_in) GROUP BY 1, 2""",
    "verdicts": r"""SELECT answer_id, CAST(len(regexp_extract_all(answer, '\[source:')) AS INTEGER) AS opened, CAST(len(regexp_extract_all(answer, '\[source:([1-9][0-9]*)\]')) AS INTEGER) AS formed FROM answers_in""",
}
CACHE = {"live": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY written DESC) AS n FROM cache) WHERE n = 1 AND (expires_at IS NULL OR expires_at >= TIMESTAMP '2025-01-01')"}
LINKS = {
    "mentions": """SELECT source_index, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM (
        SELECT source_index, list_filter(list_concat(refs, [in_reply_to, message_id]), lambda x: x IS NOT NULL) AS ids FROM messages)""",
    "links": """SELECT refs[1] AS parent, refs[2] AS child FROM messages WHERE len(refs) = 2
        UNION ALL SELECT coalesce(in_reply_to, refs[len(refs)]), message_id FROM messages WHERE coalesce(in_reply_to, refs[len(refs)]) IS NOT NULL""",
    "ids": "SELECT DISTINCT id FROM mentions",
    "near": "SELECT parent AS a, child AS b FROM links UNION SELECT child, parent FROM links",
    "reach": "SELECT id, id AS r FROM ids UNION SELECT r.id, n.b FROM reach r JOIN near n ON n.a = r.r",
    "comps": "SELECT id, min(r) AS component FROM reach GROUP BY 1",
    "firsts": "SELECT id, min(source_index * 1000 + pos) AS seen FROM mentions GROUP BY 1",
    "seeds": """SELECT component, coalesce(arg_min(id, seen) FILTER (id NOT IN (SELECT child FROM links WHERE parent <> child)), min(id)) AS seed
        FROM comps JOIN firsts USING (id) GROUP BY 1""",
    "keys": "SELECT source_index, sha256('email-thread-v1:' || seed) AS thread_key FROM (SELECT source_index, arg_min(id, pos) AS id FROM mentions GROUP BY 1) JOIN comps USING (id) JOIN seeds USING (component)",
    "options": """SELECT source_index, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM (
        SELECT source_index, list_filter(list_concat([in_reply_to], list_reverse(refs)), lambda x: x IS NOT NULL) AS ids FROM messages)""",
    "occurs": "SELECT message_id AS id, count(*) AS times, min(source_index) AS target FROM messages GROUP BY 1",
    "parents_of": """SELECT m.source_index, CASE WHEN times = 1 AND target <> m.source_index THEN target END AS parent FROM messages m LEFT JOIN (
        SELECT source_index, arg_min(times, pos) AS times, arg_min(target, pos) AS target FROM options JOIN occurs USING (id) GROUP BY 1) h ON h.source_index = m.source_index""",
    "walk": "SELECT source_index, parent AS spot FROM parents_of WHERE parent IS NOT NULL UNION SELECT w.source_index, p.parent FROM walk w JOIN parents_of p ON p.source_index = w.spot WHERE p.parent IS NOT NULL",
    "cyclic": "SELECT DISTINCT source_index FROM walk WHERE spot = source_index",
}

ORACLES = {
    "pack_context": oracle(f"SELECT qid, source_number, chunk_id, 'verbatim' AS kind, {HEAD.format('source_number')} AS rendered FROM picked", **CONTEXT),
    "context_reasons": oracle("""
        SELECT j.qid, budget, overhead, available, CAST(CASE WHEN empty_reason IS NULL THEN (SELECT max(n) FROM ctx x WHERE x.qid = j.qid) ELSE 0 END AS INTEGER) AS context_tokens, empty_reason,
          CAST((SELECT count(*) FROM picked p WHERE p.qid = j.qid) AS INTEGER) AS n_items, CAST(size - (SELECT count(*) FROM picked p WHERE p.qid = j.qid) AS INTEGER) AS n_omitted FROM judged j""", **CONTEXT),
    "evidence": oracle("SELECT qid, source_number, chunk_id, title, page, score AS confidence FROM picked", **CONTEXT),
    "citation_markers": oracle("SELECT answer_id, opened, formed, opened <> formed AS malformed, source_number, position FROM verdicts LEFT JOIN found USING (answer_id)", **MARKS_SQL),
    "citation_compliance": oracle(r"""
        SELECT answer_id, CASE WHEN len(ms) = 0 THEN 'no marker' ELSE coalesce(list_filter(list_transform(ms, lambda m: CASE WHEN NOT regexp_full_match(m, '\[source:[1-9][0-9]*\]') THEN 'noncanonical marker'
          WHEN CAST(regexp_extract(m, '[0-9]+') AS BIGINT) > qid % 4 THEN 'unavailable source' ELSE '' END), lambda c: c <> '')[1], 'ok') END AS verdict
        FROM (SELECT answer_id, qid, regexp_extract_all(answer, '(?i)\[source:[0-9]*\]?') AS ms FROM answers_in)""", **MARKS_SQL),
    "resolve_citations": oracle(f"""
        SELECT {uuid_sql("'citation:v1:' || lower(answer_id) || ':' || source_number || ':' || chunk_id")} AS citation_id, answer_id, source_number, position, chunk_id, document_id, title, page, text AS quote
        FROM matched WHERE chunk_id IS NOT NULL AND answer_id NOT IN (SELECT answer_id FROM matched WHERE chunk_id IS NULL) AND answer_id NOT IN (SELECT answer_id FROM verdicts WHERE opened <> formed)""",
        **CONTEXT, **MARKS_SQL,
        matched="SELECT f.answer_id, f.source_number, f.position, p.chunk_id, p.document_id, p.title, p.page, p.text FROM found f JOIN answers_in a USING (answer_id) LEFT JOIN picked p ON p.qid = a.qid AND p.source_number = f.source_number"),
    "embed_cache_join": oracle("""SELECT DISTINCT k.key, CASE WHEN l.key IS NULL THEN 'miss' WHEN dimensions = 64 AND len(vector) = 64 THEN 'hit' ELSE 'corrupt' END AS status
        FROM (SELECT sha256(text) || '::m' AS key FROM documents) k LEFT JOIN live l ON l.key = k.key""", **CACHE),
    "cache_ttl": oracle("SELECT key, written, dimensions FROM live", **CACHE),
    "cache_clear": oracle("SELECT key, written FROM cache WHERE NOT starts_with(key, 'a')"),
    "hashed_vectors": rf"""SELECT doc_id AS text_id, CAST(('0x' || substr(md5(term), 1, 6))::INTEGER % 64 AS INTEGER) AS bucket, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(lower(text), '{X.TERM_PATTERN}')) AS term FROM documents) GROUP BY 1, 2""",
    "plan_dense_query": "SELECT conv_id AS plan_id, arg_min(text, turn) FILTER ((conv_id + turn) % 3 <> 0) AS text FROM conversations GROUP BY 1",
    "graph_upsert": oracle("""
        SELECT source_id || '_' || e.relation || '_' || target_id AS edge_id, round(coalesce(n.weight, 0.5), 6) AS weight FROM edges e LEFT JOIN (
          SELECT 's' || l_suppkey || '_supplies_p' || l_partkey AS edge_id, l_discount * 12 AS weight FROM lineitem WHERE l_discount * 12 BETWEEN 0 AND 1
          QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, weight) = 1) n ON n.edge_id = source_id || '_' || e.relation || '_' || target_id"""),
    "find_entities": oracle("""SELECT entity_id, name, entity_type, document_id FROM entities WHERE entity_type = 'part' AND name IN (SELECT p_name FROM part)
        AND CAST(document_id AS INTEGER) < 25 ORDER BY entity_id LIMIT 500"""),
    "k_hop": oracle("SELECT DISTINCT a.source_id AS start, c.target_id AS node FROM edges a JOIN edges b ON b.source_id = a.target_id JOIN edges c ON c.source_id = b.target_id WHERE a.source_id LIKE 'r%'"),
    "graph_delete": oracle("""
        SELECT 'entity' AS kind, entity_id AS id FROM entities WHERE document_id NOT IN (SELECT document_id FROM gone)
        UNION ALL SELECT 'edge', source_id || '_' || relation || '_' || target_id FROM edges WHERE source_id NOT IN (SELECT entity_id FROM lost) AND target_id NOT IN (SELECT entity_id FROM lost)""",
        gone="SELECT CAST(doc_id AS VARCHAR) AS document_id FROM labels WHERE toxic = 1", lost="SELECT entity_id FROM entities WHERE document_id IN (SELECT document_id FROM gone)"),
    "notebook_graph": oracle("""
        SELECT notebook_id, 'node' AS kind, entity_id AS id FROM nodes
        UNION ALL SELECT a.notebook_id, 'edge', source_id || '_' || relation || '_' || target_id FROM edges JOIN nodes a ON a.entity_id = source_id JOIN nodes b ON b.entity_id = target_id AND b.notebook_id = a.notebook_id""",
        nodes="SELECT DISTINCT notebook_id, entity_id FROM sources JOIN entities USING (document_id)"),
    "thread_components": oracle("SELECT id, component FROM comps", **LINKS),
    "reply_parent": oracle("SELECT source_index, parent FROM parents_of", **LINKS),
    "reply_cycles": oracle("SELECT source_index FROM cyclic", **LINKS),
    "thread_key": oracle("SELECT source_index, thread_key FROM keys", **LINKS),
    "mail_regions": oracle(rf"""
        SELECT message_id, CAST(run AS INTEGER) AS run, region, regexp_replace(string_agg(line, chr(10) ORDER BY n), '^{X.WS}+|{X.WS}+$', '', 'g') AS text FROM runs GROUP BY 1, 2, 3 HAVING text <> ''""".replace("x0B", "v"),
        bodies="""SELECT CAST(doc_id AS VARCHAR) AS message_id, string_agg(CASE WHEN ordinal % 6 = 2 THEN '> ' || line WHEN ordinal = 3 THEN line || chr(10) || 'On Monday, someone wrote:' WHEN ordinal = 5 THEN '-- ' || chr(10) || line ELSE line END, chr(10) ORDER BY ordinal) AS body FROM doc_lines GROUP BY 1""",
        body_lines="SELECT message_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM bodies",
        regions=r"""SELECT *, CASE WHEN bool_or(line = '-- ') OVER w THEN 'signature' WHEN bool_or(regexp_full_match(trim(line), '(?i)(?:-{2,}\s*(?:original message|forwarded message)\s*-{2,}|on .+ wrote:)\s*')) OVER w OR starts_with(ltrim(line), '>') THEN 'quoted' ELSE 'body' END AS region
            FROM body_lines WINDOW w AS (PARTITION BY message_id ORDER BY n)""",
        changes="SELECT *, CAST(region IS DISTINCT FROM lag(region) OVER (PARTITION BY message_id ORDER BY n) AS INTEGER) AS fresh FROM regions",
        runs="SELECT *, sum(fresh) OVER (PARTITION BY message_id ORDER BY n) AS run FROM changes"),
}
