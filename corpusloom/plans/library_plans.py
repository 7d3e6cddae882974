"""Registered library, filter and projection queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import filters as P
from corpusloom.operators import library as B
from corpusloom.plans.sqlbase import TITLE, oracle
from corpusloom.plans.tables import Library


def _when(col: str) -> F.Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


WHEN = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def page_documents(spark: SparkSession, d: str) -> DataFrame:
    ready = Library(spark, d).versions().filter("status = 'indexed'")
    return B.keyset_page(ready.select("document_id", "title", "doc_type"), "document_id", "15", 50)


def page_turns(spark: SparkSession, d: str) -> DataFrame:
    turns = Library(spark, d).turns()
    anchors = turns.filter("sequence = 0").select(F.col("turn_id").alias("after_turn_id"))
    return B.turn_pages(turns, anchors, 3).select("session_id", "turn_id", "sequence", "role", "n")


def _notebooks(lib: Library) -> DataFrame:
    return lib.sources().select("notebook_id").distinct()


def notebook_counts(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return B.counts_by_notebook(_notebooks(lib), lib.sources())


def notebook_summary(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return B.notebook_summary(_notebooks(lib), lib.insights(), lib.sources(), lib.versions())


def source_insights(spark: SparkSession, d: str) -> DataFrame:
    insights = Library(spark, d).insights()
    direct = B.source_insights(insights, "fact", 5).withColumn("form", F.lit("filter then page"))
    paged = B.source_insights(insights, "fact", 5, True).withColumn("form", F.lit("page then filter"))
    return direct.unionByName(paged).select("form", "notebook_id", "source_id", "insight_id", "insight_type", "n")


def timeline(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return B.timeline(lib.sources(), lib.notes(), lib.sessions(), 20).select(
        "notebook_id", _when("happened_at"), "kind", "item_id", "n")


def session_detail(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    cited = lib.turns().filter("role = 'assistant'").select(
        "turn_id", F.explode(F.sequence(F.lit(1), (F.col("sequence") % 3 + 1).cast("int"))).alias("source_number"))
    cited = cited.withColumn("citation_id", F.concat_ws("#", "turn_id", "source_number"))
    return B.session_detail(lib.sessions(), lib.turns(), cited)


def append_turns(spark: SparkSession, d: str) -> DataFrame:
    """The longest half of the conversation rows arrives again as new turns."""
    turns = Library(spark, d).turns()
    new = turns.select(
        F.when(F.col("role") == "user", F.col("session_id")).otherwise(F.concat(F.lit("x"), "session_id")).alias("session_id"),
        F.col("turn_id").alias("arrival"), "role", "content")
    return B.append_turns(turns, new).select("session_id", "arrival", "role", F.col("sequence").cast("bigint").alias("sequence"))


def upsert(spark: SparkSession, d: str) -> DataFrame:
    """Order rows replace the stored customer totals; the newest order wins."""
    lib = Library(spark, d)
    old = lib.read("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), F.lit("stored").alias("origin"))
    new = lib.read("orders").select(
        F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.lit("order").alias("origin"), "o_orderdate", "o_orderkey")
    return B.upsert(old, new, ["key"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


def patch(spark: SparkSession, d: str) -> DataFrame:
    """Labels patch the versions: toxic ones get a new title and a metadata key."""
    lib = Library(spark, d)
    old = lib.versions().select(
        "document_id", "title", "status", F.create_map(F.lit("kind"), "doc_type", F.lit("state"), "status").alias("meta"))
    change = lib.read("labels").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.when(F.col("toxic") == 1, F.lit("withheld")).alias("title"),
        F.when(F.col("quality") == 0, F.lit("failed")).alias("status"),
        F.create_map(F.lit("state"), F.concat(F.lit("q"), F.col("quality").cast("string")), F.lit("reviewed"), F.lit("yes")).alias("meta"))
    out = B.patch(old, change, "document_id", ["title", "status"], "meta")
    return out.select(
        "document_id", "title", "status", F.col("meta")["kind"].alias("kind"), F.col("meta")["state"].alias("state"),
        F.col("meta")["reviewed"].alias("reviewed"))


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Documents labelled toxic are deleted everywhere; survivors are counted."""
    lib = Library(spark, d)
    gone = lib.read("labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    left = B.cascade(
        {"versions": lib.versions(), "chunks": lib.chunk_rows(), "sources": lib.sources(), "vectors": lib.vectors(),
         "entities": lib.entities()}, gone, "document_id")
    parts = [df.groupBy().agg(F.count("*").alias("survivors")).withColumn("table_name", F.lit(n)) for n, df in left.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def duplicate_sources(spark: SparkSession, d: str) -> DataFrame:
    """Copies of one text count as one document of their notebook."""
    lib = Library(spark, d)
    canonical = lib.documents().select(
        F.col("source").alias("notebook_id"), F.sha2("text", 256).alias("document_id"))
    return B.duplicate_pairs(canonical)


def ingest_decision(spark: SparkSession, d: str) -> DataFrame:
    """All documents arrive at two notebooks; English ones of each source are stored."""
    lib = Library(spark, d)
    stored = lib.documents().filter("lang = 'en'").select(
        F.col("doc_id").cast("string").alias("document_id"), F.sha2("text", 256).alias("content_hash"), "source")
    sources = stored.select(F.col("source").alias("notebook_id"), "document_id")
    files = lib.documents().select(
        F.explode(F.array("source", F.concat(F.lit("lang-"), "lang"))).alias("notebook_id"),
        F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("arrival"))
    return B.ingest_decision(files, stored, sources)


def version_violations(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents with broken rules planted by label and language."""
    lib = Library(spark, d)
    versions = lib.versions().select("document_id", "version_id", "content_hash")
    doc = F.col("document_id").cast("bigint")
    documents = lib.versions().select(
        "document_id",
        F.when(doc % 50 == 1, F.lit("none")).otherwise(F.col("version_id")).alias("version_id"),
        F.when(doc % 50 == 2, F.lit("other")).otherwise(F.col("content_hash")).alias("content_hash"),
        "created_at",
        F.when(doc % 50 == 3, F.col("created_at") - F.expr("interval 1 day")).otherwise(F.col("created_at")).alias("updated_at"))
    twice = versions.filter(doc % 50 == 4)
    blocks = lib.blocks().select("document_id", F.when((doc % 50 == 5), F.col("ordinal") + 1).otherwise(F.col("ordinal")).alias("ordinal"))
    return B.version_violations(documents, versions.unionByName(twice), blocks)


def source_listing(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return B.source_listing(lib.sources(), lib.versions().filter("status <> 'failed'"))


def lookup_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a copy of a labelled text, with their sources."""
    lib = Library(spark, d)
    keys = lib.documents().join(lib.read("labels").filter("quality = 1"), "doc_id").select(F.sha2("text", 256).alias("content_hash"))
    found = B.lookup(keys, "content_hash", lib.versions(), lib.sources().select("document_id", "source_id", "notebook_id"), "document_id")
    return found.select("document_id", "version_id", "content_hash", "title", "source_id", "notebook_id")


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Derived rows whose document is no longer indexed."""
    lib = Library(spark, d)
    owners = lib.versions().filter("status = 'indexed'")
    return B.orphans(
        {"chunks": lib.chunk_rows().select("document_id"), "titles": P.title_projection(lib.passages(), lib.versions()).select("document_id"),
         "vectors": lib.vectors().select("document_id"), "sources": lib.sources().select("document_id")}, owners, "document_id")


def _requests(lib: Library) -> DataFrame:
    q = lib.queries()
    return q.select(
        F.concat(F.lit("r"), F.col("qid").cast("string")).alias("request_id"), F.col("text").alias("query"),
        F.coalesce("notebook_id", F.lit("")).alias("notebook_id"), "mode", F.lit(10).alias("limit"))


def request_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Requests meet a store that holds two thirds of them, some in another mode."""
    rows = _requests(Library(spark, d))
    fields = ["query", "notebook_id", "mode", "limit"]
    stored = rows.filter("mode <> 'dense'").withColumn(
        "mode", F.when(F.col("mode") == "hybrid", F.lit("sparse")).otherwise(F.col("mode"))).withColumn(
        "fingerprint", B.request_fingerprint(fields))
    asked = rows.withColumn("fingerprint", B.request_fingerprint(fields))
    return B.dedup_requests(asked, stored).select("request_id", "fingerprint", "outcome")


STATES = ["running", "validated", "assistant_published", "published"]


def _moves(lib: Library) -> tuple[DataFrame, DataFrame]:
    c, t = F.col("conv_id"), F.col("turn")
    states = F.array(*[F.lit(s) for s in STATES])
    conv = lib.read("conversations")
    current = conv.select("conv_id").distinct().select(
        F.concat(F.lit("e"), c.cast("string")).alias("execution_id"), F.element_at(states, (c % 4 + 1).cast("int")).alias("state"))
    moves = conv.select(
        F.concat(F.lit("e"), c.cast("string")).alias("execution_id"), F.element_at(states, (t % 3 + 1).cast("int")).alias("expected"),
        F.element_at(states, (t % 3 + 2).cast("int")).alias("target"), t.alias("arrival"))
    return current, moves


def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    current, moves = _moves(Library(spark, d))
    after, verdicts = B.transition_states(current, moves)
    return verdicts.join(after, "execution_id").select("execution_id", "arrival", "expected", "target", "verdict", "state")


def snapshot_append(spark: SparkSession, d: str) -> DataFrame:
    """Turns as snapshots: two phases per conversation, later rewrites refused."""
    conv = Library(spark, d).read("conversations")
    rows = conv.select(
        F.concat(F.lit("e"), F.col("conv_id").cast("string")).alias("execution_id"),
        F.when(F.col("turn") % 2 == 0, "validated").otherwise("published").alias("phase"),
        F.sha2("text", 256).alias("payload"), F.col("turn").alias("arrival"))
    stored, incoming = rows.filter("arrival = 0"), rows.filter("arrival > 0")
    kept, refused = B.append_snapshots(stored, incoming)
    return kept.withColumn("outcome", F.lit("kept")).unionByName(refused.select(kept.columns).withColumn("outcome", F.lit("refused")))


def asset_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = Library(spark, d).documents()
    return B.asset_rows(docs.select(F.encode("text", "UTF-8").alias("content"), F.col("doc_id").alias("arrival")))


def ir_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Line blocks offered twice; the second offer drops the failed documents' casing."""
    lib = Library(spark, d)
    rows = lib.documents().select(F.concat(F.col("doc_id").cast("string"), F.lit(".1")).alias("version_id"), "text", "lang")
    first = rows.select("version_id", F.sha2("text", 256).alias("digest"))
    second = rows.select("version_id", F.sha2(F.when(F.col("lang") == "de", F.lower("text")).otherwise(F.col("text")), 256).alias("digest"))
    return B.ir_conflicts(first.unionByName(second))


def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Even sources are stored; all lines arrive with a new ending, German ones twice."""
    lib = Library(spark, d)
    rows = lib.passages().select("chunk_id", "version_id", "text", "source_name")
    stored = rows.filter("source_name < 'src5'")
    repeated = lib.documents().filter("lang = 'de'").select(F.concat(F.col("doc_id").cast("string"), F.lit(".1")).alias("version_id"))
    batch = rows.withColumn("text", F.concat("text", F.lit(" (new)")))
    batch = batch.unionByName(batch.join(repeated, "version_id", "left_semi").select(batch.columns))
    merged, refused = B.upsert_chunks(stored, batch)
    return merged.select("chunk_id", "version_id", F.sha2("text", 256).alias("digest"), F.lit("chunk").alias("kind")).unionByName(
        refused.select(F.lit("").alias("chunk_id"), "version_id", F.lit("").alias("digest"), F.lit("refused").alias("kind")))


def merge_filters(spark: SparkSession, d: str) -> DataFrame:
    q = Library(spark, d).queries()
    i = F.col("qid")
    types = ["book", "paper", "code", "email"]
    plans = q.select(
        "qid", F.col("notebook_id").alias("p_notebook"),
        F.when(i % 3 == 0, F.col("notebook_id")).when(i % 3 == 1, F.lit("src4")).alias("h_notebook"),
        F.col("date_after").alias("p_after"), F.when(i % 5 < 3, F.date_add(F.lit("2021-01-01").cast("date"), (i * 20).cast("int"))).alias("h_after"),
        F.col("date_before").alias("p_before"), F.when(i % 5 > 1, F.lit("2022-01-01").cast("date")).alias("h_before"),
        F.when(i % 4 > 0, F.slice(F.array(*[F.lit(t) for t in types]), (i % 4).cast("int"), F.lit(2))).otherwise(F.array().cast("array<string>")).alias("p_types"),
        F.when(i % 2 == 0, F.array(F.lit("book"), F.lit("email"))).otherwise(F.array().cast("array<string>")).alias("h_types"),
        F.array(F.concat(F.lit("s"), (i % 3).cast("string"))).alias("p_sources"),
        F.when(i % 7 < 4, F.array(F.lit("s0"), F.lit("s1"))).otherwise(F.array().cast("array<string>")).alias("h_sources"))
    return P.merge_filters(plans).select(
        "qid", "notebook_id", F.col("date_after").cast("string").alias("date_after"), F.col("date_before").cast("string").alias("date_before"),
        F.array_join("doc_types", ",").alias("doc_types"), F.array_join("source_ids", ",").alias("source_ids"), "error")


def plan_validate(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as sub-queries: one plan per conversation and role."""
    conv = Library(spark, d).read("conversations")
    base = conv.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), "role").alias("plan_id"), F.col("turn").alias("idx"),
        F.concat(F.lit("  "), "text", F.lit(" \n ")).alias("text"),
        F.when(F.col("turn") % 2 == 0, "dense").otherwise("hybrid").alias("mode"),
        F.lit("{}").alias("filters"), (F.col("turn") * 25).cast("int").alias("k"))
    again = base.filter("idx = 2").select("plan_id", (F.col("idx") + 100).alias("idx"), F.lower("text").alias("text"), "mode", "filters", F.lit(7).alias("k"))
    return P.validate_plans(base.unionByName(again))


def _digests(lib: Library) -> DataFrame:
    return lib.documents().filter("n_chars > 200").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".1")).alias("version_id"),
        F.sha2(F.when(F.col("lang") == "es", F.upper("text")).otherwise(F.col("text")), 256).alias("ir_hash"))


def retrieval_projection(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return P.retrieval_projection(lib.versions(), lib.sources(), _digests(lib)).withColumn(
        "publication_date", F.col("publication_date").cast("string"))


def membership_refresh(spark: SparkSession, d: str) -> DataFrame:
    """French documents leave the notebook of their language; the rest keep their rows."""
    lib = Library(spark, d)
    projection = P.retrieval_projection(lib.versions(), lib.sources(), _digests(lib)).select(
        "document_id", "version_id", "doc_type", "source_id", "notebook_id")
    changed = lib.documents().filter("lang = 'fr'").select(F.col("doc_id").cast("string").alias("document_id"))
    return P.refresh_memberships(projection, lib.sources(), changed, "lang-fr")


def title_projection(spark: SparkSession, d: str) -> DataFrame:
    lib = Library(spark, d)
    return P.title_projection(lib.passages(), lib.versions())


def query_route(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts, each also asked with one of the routing words in front."""
    words = ["Compare", "the exact formula value", "verse 2.47 of", "which endpoint", "what is"]
    q = Library(spark, d).queries().select(
        "qid", F.posexplode(F.array(*[F.lit(w) for w in words])).alias("form", "word"), "text")
    asked = q.withColumn("query", F.concat_ws(" ", "word", "text"))
    return asked.select("qid", "form", P.answer_template(F.col("query")).alias("template"))


QUERIES = {f.__name__: f for f in (
    page_documents, page_turns, notebook_counts, notebook_summary, source_insights, timeline, session_detail,
    append_turns, upsert, patch, cascade_delete, duplicate_sources, ingest_decision, version_violations,
    source_listing, lookup_documents, orphans, request_dedup, state_transitions, snapshot_append, asset_dedup,
    ir_conflicts, upsert_chunks, merge_filters, plan_validate, retrieval_projection, membership_refresh,
    title_projection, query_route)}

NOTEBOOKS = "SELECT DISTINCT notebook_id FROM sources"
REQ = """SELECT 'r' || qid AS request_id, text AS query, coalesce(notebook_id, '') AS notebook_id, mode, 10 AS lim FROM queries"""
FP = """sha256('{"limit":' || lim || ',"mode":' || to_json(mode) || ',"notebook_id":' || to_json(notebook_id) || ',"query":' || to_json(query) || '}')"""
UUID = """(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
  || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)
  FROM (SELECT sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode({0})) AS h))"""


def uuid_sql(name: str) -> str:
    return UUID.replace("{0}", name)


PROJ = {
    "digests": """SELECT CAST(doc_id AS VARCHAR) || '.1' AS version_id, sha256(CASE WHEN lang = 'es' THEN upper(text) ELSE text END) AS ir_hash
        FROM documents WHERE n_chars > 200""",
    "projection": """SELECT v.document_id, v.version_id, doc_type, CAST(publication_date AS VARCHAR) AS publication_date, title, source_id, notebook_id,
        CASE WHEN ir_hash IS NULL THEN 'no blocks' WHEN ir_hash <> content_hash THEN 'hash differs' END AS error
        FROM versions v LEFT JOIN digests USING (version_id) LEFT JOIN (SELECT DISTINCT document_id, source_id, notebook_id FROM sources) USING (document_id)""",
}

ORACLES = {
    "page_documents": oracle("""
        SELECT document_id, title, doc_type, CASE WHEN (SELECT count(*) FROM taken) > 50 THEN (SELECT document_id FROM taken ORDER BY document_id LIMIT 1 OFFSET 49) END AS next_cursor
        FROM taken ORDER BY document_id LIMIT 50""",
        taken="SELECT document_id, title, doc_type FROM versions WHERE status = 'indexed' AND document_id > '15' ORDER BY document_id LIMIT 51"),
    "page_turns": oracle("""
        SELECT t.session_id, t.turn_id, t.sequence, t.role, CAST(row_number() OVER (PARTITION BY t.session_id ORDER BY t.sequence) AS INTEGER) AS n
        FROM turns t JOIN turns a ON a.session_id = t.session_id AND a.sequence = 0 AND t.sequence > 0 QUALIFY n <= 3"""),
    "notebook_counts": oracle("SELECT notebook_id, count(*) AS source_count FROM sources GROUP BY 1"),
    "notebook_summary": oracle("""
        SELECT n.notebook_id, CASE WHEN EXISTS (SELECT 1 FROM insights i WHERE i.notebook_id = n.notebook_id AND insight_type = 'summary') THEN 'ready' ELSE 'empty' END AS status,
          kind, item_id, body FROM notebooks n LEFT JOIN items USING (notebook_id)""", notebooks=NOTEBOOKS,
        items="""SELECT notebook_id, 'summary' AS kind, insight_id AS item_id, content AS body FROM insights WHERE insight_type = 'summary'
            UNION ALL SELECT notebook_id, 'source', source_id, title FROM sources LEFT JOIN versions USING (document_id)"""),
    "source_insights": oracle("""
        SELECT 'filter then page' AS form, notebook_id, source_id, insight_id, insight_type, CAST(row_number() OVER (PARTITION BY notebook_id ORDER BY insight_id) AS INTEGER) AS n
        FROM insights WHERE insight_type = 'key_fact' QUALIFY n <= 5
        UNION ALL SELECT * FROM (SELECT 'page then filter', notebook_id, source_id, insight_id, insight_type, CAST(row_number() OVER (PARTITION BY notebook_id ORDER BY insight_id) AS INTEGER) AS n
          FROM insights QUALIFY n <= 5) WHERE insight_type = 'key_fact'"""),
    "timeline": oracle(f"""
        SELECT notebook_id, {WHEN.format('happened_at')}, kind, item_id, n FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY notebook_id ORDER BY happened_at DESC, kind, item_id) AS INTEGER) AS n FROM acts) WHERE n <= 20""",
        acts="""SELECT notebook_id, created_at AS happened_at, 'source_added' AS kind, source_id AS item_id FROM sources
            UNION ALL SELECT notebook_id, created_at, 'note_created', note_id FROM notes
            UNION ALL SELECT notebook_id, created_at, 'session_started', session_id FROM sessions"""),
    "session_detail": oracle("""
        SELECT s.session_id, s.notebook_id, t.sequence, t.turn_id, t.role, source_number, t.turn_id || '#' || source_number AS citation_id
        FROM sessions s JOIN turns t USING (session_id) LEFT JOIN (
          SELECT turn_id, unnest(range(1, CAST(sequence % 3 + 2 AS INTEGER)))::INTEGER AS source_number FROM turns WHERE role = 'assistant') USING (turn_id)"""),
    "append_turns": oracle("""
        SELECT session_id, arrival, role, coalesce(last, -1) + row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS sequence
        FROM (SELECT CASE WHEN role = 'user' THEN session_id ELSE 'x' || session_id END AS session_id, turn_id AS arrival, role FROM turns)
          LEFT JOIN (SELECT session_id, max(sequence) AS last FROM turns GROUP BY 1) USING (session_id)"""),
    "upsert": """
        WITH win AS (SELECT o_custkey AS key, o_totalprice AS value, 'order' AS origin FROM orders
            QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
        SELECT * FROM win UNION ALL SELECT c_custkey, c_acctbal, 'stored' FROM customer WHERE c_custkey NOT IN (SELECT key FROM win)""",
    "patch": oracle("""
        SELECT document_id, CASE WHEN toxic = 1 THEN 'withheld' ELSE title END AS title, CASE WHEN quality = 0 THEN 'failed' ELSE status END AS status,
          doc_type AS kind, CASE WHEN l.doc_id IS NULL THEN status ELSE 'q' || quality END AS state, CASE WHEN l.doc_id IS NOT NULL THEN 'yes' END AS reviewed
        FROM versions LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = document_id"""),
    "cascade_delete": oracle("""
        SELECT 'versions' AS table_name, count(*) AS survivors FROM versions WHERE document_id NOT IN (SELECT document_id FROM gone)
        UNION ALL SELECT 'chunks', count(*) FROM chunk_rows WHERE document_id NOT IN (SELECT document_id FROM gone)
        UNION ALL SELECT 'sources', count(*) FROM sources WHERE document_id NOT IN (SELECT document_id FROM gone)
        UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE document_id NOT IN (SELECT document_id FROM gone)
        UNION ALL SELECT 'entities', count(*) FROM entities WHERE document_id NOT IN (SELECT document_id FROM gone)""",
        gone="SELECT CAST(doc_id AS VARCHAR) AS document_id FROM labels WHERE toxic = 1"),
    "duplicate_sources": "SELECT source AS notebook_id, sha256(text) AS document_id, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "ingest_decision": oracle(f"""
        SELECT f.notebook_id, f.content_hash, f.arrival,
          CASE WHEN h.notebook_id IS NOT NULL OR f.arrival > min(f.arrival) OVER (PARTITION BY f.notebook_id, f.content_hash) THEN 'conflict'
               WHEN k.document_id IS NOT NULL OR f.arrival > min(f.arrival) OVER (PARTITION BY f.content_hash) THEN 'new_source' ELSE 'new_document' END AS decision,
          coalesce(k.document_id, {uuid_sql("'document:' || f.content_hash")}) AS document_id
        FROM files f LEFT JOIN (SELECT content_hash, min(document_id) AS document_id FROM stored GROUP BY 1) k USING (content_hash)
          LEFT JOIN (SELECT DISTINCT source AS notebook_id, content_hash FROM stored) h ON h.notebook_id = f.notebook_id AND h.content_hash = f.content_hash""",
        stored="SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(text) AS content_hash, source FROM documents WHERE lang = 'en'",
        files="SELECT unnest([source, 'lang-' || lang]) AS notebook_id, sha256(text) AS content_hash, doc_id AS arrival FROM documents"),
    "version_violations": oracle("""
        SELECT document_id, 'no current version' AS problem FROM versions WHERE CAST(document_id AS BIGINT) % 50 = 1
        UNION ALL SELECT document_id, 'hash differs' FROM versions WHERE CAST(document_id AS BIGINT) % 50 = 2
        UNION ALL SELECT document_id, 'created after updated' FROM versions WHERE CAST(document_id AS BIGINT) % 50 = 3
        UNION ALL SELECT document_id, 'repeated hash' FROM versions WHERE CAST(document_id AS BIGINT) % 50 = 4
        UNION ALL SELECT DISTINCT document_id, 'ordinals not contiguous' FROM blocks WHERE CAST(document_id AS BIGINT) % 50 = 5"""),
    "source_listing": oracle("""
        SELECT source_id, notebook_id, s.document_id, coalesce(status, 'unknown') AS status, coalesce(content_hash, '') AS content_hash,
          coalesce(doc_type, 'generic') AS doc_type, coalesce(n_chars, 0) AS size
        FROM sources s LEFT JOIN (SELECT * FROM versions WHERE status <> 'failed') v ON v.document_id = s.document_id"""),
    "lookup_documents": oracle("""
        SELECT v.document_id, version_id, content_hash, title, source_id, notebook_id FROM versions v LEFT JOIN sources s ON s.document_id = v.document_id
        WHERE content_hash IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 1)"""),
    "orphans": oracle("""
        SELECT 'chunks' AS table_name, count(*) AS orphans FROM chunk_rows WHERE document_id NOT IN (SELECT document_id FROM owners)
        UNION ALL SELECT 'titles', count(*) FROM passages JOIN versions USING (version_id) WHERE trim(title) <> '' AND versions.document_id NOT IN (SELECT document_id FROM owners)
        UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE document_id NOT IN (SELECT document_id FROM owners)
        UNION ALL SELECT 'sources', count(*) FROM sources WHERE document_id NOT IN (SELECT document_id FROM owners)""",
        owners="SELECT document_id FROM versions WHERE status = 'indexed'"),
    "request_dedup": oracle("""
        SELECT request_id, a.fp AS fingerprint, CASE WHEN s.fp IS NULL THEN 'new' WHEN s.fp = a.fp THEN 'replay' ELSE 'conflict' END AS outcome
        FROM asked a LEFT JOIN kept s USING (request_id)""",
        asked=f"SELECT request_id, {FP} AS fp FROM ({REQ})",
        kept=f"SELECT request_id, {FP} AS fp FROM (SELECT * REPLACE (CASE WHEN mode = 'hybrid' THEN 'sparse' ELSE mode END AS mode) FROM ({REQ}) WHERE mode <> 'dense')"),
    "state_transitions": f"""
        WITH cur AS (SELECT DISTINCT 'e' || conv_id AS execution_id, {STATES}[conv_id % 4 + 1] AS state FROM conversations),
        moves AS (SELECT 'e' || conv_id AS execution_id, {STATES}[turn % 3 + 1] AS expected, {STATES}[turn % 3 + 2] AS target, turn AS arrival FROM conversations),
        won AS (SELECT execution_id, min(arrival) AS won, arg_min(target, arrival) AS won_target FROM moves JOIN cur USING (execution_id) WHERE expected = state GROUP BY 1)
        SELECT execution_id, arrival, expected, target, CASE WHEN arrival = won THEN 'applied' ELSE 'lost' END AS verdict, coalesce(won_target, state) AS state
        FROM moves JOIN cur USING (execution_id) LEFT JOIN won USING (execution_id)""",
    "snapshot_append": """
        WITH r AS (SELECT 'e' || conv_id AS execution_id, CASE WHEN turn % 2 = 0 THEN 'validated' ELSE 'published' END AS phase, sha256(text) AS payload, turn AS arrival FROM conversations)
        SELECT *, CASE WHEN arrival = 0 OR (phase = 'published' AND arrival = min(arrival) OVER (PARTITION BY execution_id, phase)) THEN 'kept' ELSE 'refused' END AS outcome FROM r""",
    "asset_dedup": f"""SELECT content_hash, {uuid_sql("'asset:' || content_hash")} AS asset_id, arrival, size FROM (
        SELECT sha256(text) AS content_hash, doc_id AS arrival, CAST(strlen(text) AS INTEGER) AS size FROM documents
        QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1)""",
    "ir_conflicts": """SELECT version_id, count(DISTINCT digest) AS digests FROM (
        SELECT CAST(doc_id AS VARCHAR) || '.1' AS version_id, sha256(text) AS digest FROM documents
        UNION ALL SELECT CAST(doc_id AS VARCHAR) || '.1', sha256(CASE WHEN lang = 'de' THEN lower(text) ELSE text END) FROM documents) GROUP BY 1 HAVING count(DISTINCT digest) > 1""",
    "upsert_chunks": oracle("""
        SELECT chunk_id, version_id, sha256(CASE WHEN german THEN text ELSE text || ' (new)' END) AS digest, 'chunk' AS kind FROM rows_in WHERE NOT german OR source_name < 'src5'
        UNION ALL SELECT DISTINCT '', version_id, '', 'refused' FROM rows_in WHERE german""",
        rows_in="SELECT p.*, lang = 'de' AS german FROM passages p JOIN documents d ON CAST(d.doc_id AS VARCHAR) = p.document_id"),
    "merge_filters": oracle("""
        SELECT qid, coalesce(h_notebook, p_notebook) AS notebook_id, CAST(a AS VARCHAR) AS date_after, CAST(b AS VARCHAR) AS date_before,
          CASE WHEN len(p_types) = 0 THEN array_to_string(h_types, ',') WHEN len(h_types) = 0 THEN array_to_string(p_types, ',')
               ELSE coalesce(array_to_string(list_filter(p_types, lambda x: list_contains(h_types, x)), ','), '') END AS doc_types,
          CASE WHEN len(h_sources) = 0 THEN array_to_string(p_sources, ',') ELSE coalesce(array_to_string(list_filter(p_sources, lambda x: list_contains(h_sources, x)), ','), '') END AS source_ids,
          CASE WHEN p_notebook <> h_notebook THEN 'notebook conflict' WHEN a > b THEN 'inverted dates'
               WHEN len(p_types) > 0 AND len(h_types) > 0 AND NOT list_has_any(p_types, h_types) THEN 'empty doc_types'
               WHEN len(h_sources) > 0 AND NOT list_has_any(p_sources, h_sources) THEN 'empty source_ids' END AS error
        FROM (SELECT *, greatest(date_after, h_after) AS a, least(date_before, h_before) AS b FROM plans_in)""",
        plans_in="""SELECT qid, notebook_id AS p_notebook, CASE WHEN qid % 3 = 0 THEN notebook_id WHEN qid % 3 = 1 THEN 'src4' END AS h_notebook,
          date_after, CASE WHEN qid % 5 < 3 THEN DATE '2021-01-01' + CAST(qid * 20 AS INTEGER) END AS h_after,
          date_before, CASE WHEN qid % 5 > 1 THEN DATE '2022-01-01' END AS h_before,
          CASE WHEN qid % 4 > 0 THEN list_slice(['book', 'paper', 'code', 'email'], qid % 4, qid % 4 + 1) ELSE CAST([] AS VARCHAR[]) END AS p_types,
          CASE WHEN qid % 2 = 0 THEN ['book', 'email'] ELSE CAST([] AS VARCHAR[]) END AS h_types,
          ['s' || qid % 3] AS p_sources, CASE WHEN qid % 7 < 4 THEN ['s0', 's1'] ELSE CAST([] AS VARCHAR[]) END AS h_sources FROM queries"""),
    "plan_validate": """
        WITH base AS (SELECT conv_id || '-' || role AS plan_id, turn AS idx, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text,
            CASE WHEN turn % 2 = 0 THEN 'dense' ELSE 'hybrid' END AS mode, CAST(turn * 25 AS INTEGER) AS k FROM conversations),
        rows_in AS (SELECT * FROM base UNION ALL SELECT plan_id, idx + 100, lower(text), mode, 7 FROM base WHERE idx = 2)
        SELECT plan_id, idx, text, mode, k, CASE WHEN text = '' THEN 'empty query' WHEN count(*) OVER (PARTITION BY plan_id) > 16 THEN 'too many sub-queries'
          WHEN k < 1 OR k > 100 THEN 'k out of range' WHEN count(*) OVER (PARTITION BY plan_id, replace(lower(text), 'ß', 'ss'), mode) > 1 THEN 'duplicate sub-query' END AS error FROM rows_in""",
    "retrieval_projection": oracle("SELECT * FROM projection", **PROJ),
    "membership_refresh": oracle("""
        SELECT document_id, version_id, doc_type, source_id, notebook_id FROM projection WHERE NOT notebook_id = 'lang-fr'""", **PROJ),
    "title_projection": oracle("SELECT chunk_id, p.document_id, version_id, title FROM passages p JOIN versions USING (version_id) WHERE trim(title) <> ''"),
    "query_route": oracle(r"""
        SELECT qid, form, CASE WHEN regexp_matches(q, 'compare|contrast|across|between|connect with|connects with') THEN 'cross_document'
          WHEN regexp_matches(q, '\b(?:exact|verbatim|precise)\b.*\b(?:text|verse|formula|equation|value|measurement|estimate|tolerance|specification)\w*\b')
            OR regexp_matches(q, '\b(?:verse|chapter|section)\s+\d+(?:[.:]\d+)+\b') THEN 'exact_passage'
          WHEN regexp_matches(q, 'endpoint|route|function|method|class|source code|parameter|http header|csv|table|dataset|row|column|record') THEN 'code_table'
          ELSE 'grounded' END AS template
        FROM (SELECT qid, CAST(unnest(range(0, 5)) AS INTEGER) AS form, lower(unnest(['Compare', 'the exact formula value', 'verse 2.47 of', 'which endpoint', 'what is']) || ' ' || text) AS q FROM queries)"""),
}
