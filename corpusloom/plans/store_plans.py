"""Registered queries on stored assets, parsed blocks and parts of mails with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import sinks
from corpusloom.operators import threads as M
from corpusloom.plans import network_plans
from corpusloom.plans.library_plans import uuid_sql
from corpusloom.plans.sqlbase import oracle
from corpusloom.plans.tables import Library
from corpusloom.sources import mime
from corpusloom.streaming.jobs import work_folder

STORE_BUCKETS = 32


def asset_read(spark: SparkSession, d: str) -> DataFrame:
    """English texts are stored first, then all; the assets of German texts are deleted; all are asked for."""
    store = sinks.AssetStore(spark, work_folder(spark, "assets"), STORE_BUCKETS)
    docs = Library(spark, d).documents().select("lang", F.encode("text", "UTF-8").alias("content"), F.concat(F.lit("text/"), "source").alias("mime_type"))
    store.put(docs.filter("lang = 'en'").select("content", "mime_type"))
    put = store.put(docs.select("content", "mime_type"))
    german = docs.filter("lang = 'de'").select(F.sha2("content", 256).alias("content_hash"))
    store.delete(put.join(german, "content_hash", "left_semi").select("asset_id"))
    got = store.get(put).select("asset_id", F.col("outcome").alias("read"), F.sha2("content", 256).alias("read_hash"), F.length("content").alias("size"))
    return put.join(got, "asset_id").select("asset_id", "content_hash", "outcome", "read", "read_hash", "size")


def blocks_scan(spark: SparkSession, d: str) -> DataFrame:
    """Blocks are stored, then offered again with German text in lower case; the stored ones are scanned."""
    lib = Library(spark, d)
    store = sinks.BlockStore(spark, work_folder(spark, "blocks"), STORE_BUCKETS)
    langs = lib.documents().select(F.col("doc_id").cast("string").alias("document_id"), "lang")
    version = F.concat("document_id", F.lit(".1")).alias("version_id")
    store.put(lib.blocks().select(version, "ordinal", "kind", "text", "level", "page"))
    text = F.when(F.col("lang") == "de", F.lower("text")).otherwise(F.col("text")).alias("text")
    again = store.put(lib.blocks().join(langs, "document_id").select(version, "ordinal", "kind", text, "level", "page"))
    rows = store.scan(again).join(again.select("version_id", "outcome"), "version_id")
    return rows.select("version_id", "ordinal", "kind", F.sha2("text", 256).alias("text_hash"), "level", "page", "outcome")


def _raw_mails(lib: Library) -> DataFrame:
    """Messages as bytes: plain ones, mixed ones around an alternative, related ones whose root stands last."""
    m = lib.messages()
    wrapped = F.array_join(F.transform("refs", lambda r: F.concat(F.lit("<"), r, F.lit(">"))), "\n ")
    head = F.concat(
        F.lit("From: One <one@example.org>, two@example.org\nTo: three@example.org\nMessage-ID: <"), "message_id", F.lit(">\n"),
        F.coalesce(F.concat(F.lit("In-Reply-To: <"), "in_reply_to", F.lit(">\n")), F.lit("")),
        F.when(F.size("refs") > 0, F.concat(F.lit("References: "), wrapped, F.lit("\n"))).otherwise(""),
        F.lit("Date: Mon, 01 Jan 2024 10:00:00 +0100\nMIME-Version: 1.0\n"))
    text = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n"))
    plain = F.concat(head, text, F.lit("\n"), "body")
    mixed = F.concat(
        head, F.lit('Content-Type: multipart/mixed; boundary="=_m"\n\n--=_m\nContent-Type: multipart/alternative; boundary="=_a"\n\n'
                    "--=_a\nContent-Type: text/html; charset=utf-8\n\n<p>x</p>\n--=_a\n"), text, F.lit("\n"), "body",
        F.lit('\n--=_a--\n--=_m\nContent-Type: text/plain\nContent-Disposition: attachment; filename="'), F.col("source_index").cast("string"),
        F.lit('.txt"\n\nattached\n--=_m--\n'))
    related = F.concat(
        head, F.lit('Content-Type: multipart/related; boundary="=_r"; start="<root@Example.org>"\n\n--=_r\nContent-Type: image/gif\nContent-ID: <pic@Example.org>\n'
                    "Content-Transfer-Encoding: base64\n\n"), F.base64(F.encode(F.col("source_index").cast("string"), "UTF-8")),
        F.lit("\n--=_r\nContent-ID: <root@Example.org>\n"), text, F.lit("\n"), "body", F.lit("\n--=_r--\n"))
    kind = F.col("source_index") % 3
    raw = F.when(kind == 0, plain).when(kind == 1, mixed).otherwise(related)
    return m.select(F.col("source_index").cast("string").alias("mail_id"), F.encode(raw, "UTF-8").alias("raw"))


def mime_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of all turns as mails, with the identifiers their headers name."""
    parts = mime.mime_parts(_raw_mails(Library(spark, d)))
    return parts.select(
        F.col("mail_id").cast("bigint").alias("mail_id"), "part_index", "parent_index", "role", "inline", "content_type", "filename", "content_id",
        F.sha2("text", 256).alias("text_hash"), F.decode("content", "UTF-8").alias("content"), "message_id", "in_reply_to",
        F.array_join("references", " ").alias("refs"), F.array_join("senders", " ").alias("senders"), "sent_at", "error")


def mime_parents(spark: SparkSession, d: str) -> DataFrame:
    """Reply parents from the headers of raw mails instead of a table of messages."""
    read = mime.messages(mime.mime_parts(_raw_mails(Library(spark, d))))
    return M.reply_parents(read.withColumn("source_index", F.col("mail_id").cast("bigint")))


QUERIES = {f.__name__: f for f in (asset_read, blocks_scan, mime_parts, mime_parents)}

ORACLES = {
    "mime_parents": network_plans.ORACLES["reply_parent"],
    "mime_parts": oracle("""
        SELECT source_index AS mail_id, CAST(p.n AS INTEGER) AS part_index, CAST(p.up AS INTEGER) AS parent_index, p.role, p.inline, p.kind AS content_type,
          CASE WHEN p.kind = 'text/plain' AND p.role = 'attachment' THEN source_index || '.txt' END AS filename, p.cid AS content_id,
          CASE WHEN p.role = 'body' THEN sha256(body) END AS text_hash, CASE WHEN p.inline THEN CAST(source_index AS VARCHAR) END AS content,
          CASE WHEN p.n = 0 THEN message_id END AS message_id, CASE WHEN p.n = 0 THEN in_reply_to END AS in_reply_to,
          CASE WHEN p.n = 0 THEN coalesce(array_to_string(refs, ' '), '') END AS refs, CASE WHEN p.n = 0 THEN 'one@example.org two@example.org' END AS senders,
          CASE WHEN p.n = 0 THEN '2024-01-01T10:00:00+01:00' END AS sent_at, NULL AS error
        FROM messages JOIN shapes p ON p.shape = source_index % 3""",
        shapes="""SELECT * FROM (VALUES (0, 0, NULL, 'body', false, 'text/plain', NULL),
          (1, 0, NULL, 'container', false, 'multipart/mixed', NULL), (1, 1, 0, 'container', false, 'multipart/alternative', NULL), (1, 2, 1, 'unused', false, 'text/html', NULL),
          (1, 3, 1, 'body', false, 'text/plain', NULL), (1, 4, 0, 'attachment', false, 'text/plain', NULL),
          (2, 0, NULL, 'container', false, 'multipart/related', NULL), (2, 1, 0, 'attachment', true, 'image/gif', 'pic@example.org'),
          (2, 2, 0, 'body', false, 'text/plain', 'root@example.org')) AS v(shape, n, up, role, inline, kind, cid)"""),
    "asset_read": f"""
        SELECT {uuid_sql("'asset:' || content_hash")} AS asset_id, content_hash, CASE WHEN english THEN 'known' ELSE 'stored' END AS outcome,
          CASE WHEN german THEN 'absent' ELSE 'read' END AS read, CASE WHEN NOT german THEN content_hash END AS read_hash, CASE WHEN NOT german THEN size END AS size
        FROM (SELECT sha256(text) AS content_hash, coalesce(bool_or(lang = 'en'), false) AS english, coalesce(bool_or(lang = 'de'), false) AS german,
          CAST(any_value(strlen(text)) AS INTEGER) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1)""",
    "blocks_scan": oracle("""
        SELECT document_id || '.1' AS version_id, ordinal, kind, sha256(text) AS text_hash, level, page,
          CASE WHEN lang = 'de' AND bool_or(text <> lower(text)) OVER (PARTITION BY document_id) THEN 'conflict' ELSE 'known' END AS outcome
        FROM blocks JOIN (SELECT CAST(doc_id AS VARCHAR) AS document_id, lang FROM documents) USING (document_id)"""),
}
