"""The derivations of ``tables`` in DuckDB SQL, as named common table expressions."""

from __future__ import annotations

import re

from corpusloom.functions.expr import TERM_PATTERN, TOKEN_PATTERN
from corpusloom.plans.tables import DOC_TYPES, HEADINGS, KINDS


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


NTOK = "len(regexp_extract_all({0}, '" + TOKEN_PATTERN + "'))"
WS = r"[ \t\n\r\f\x0B\x{85}\x{A0}]"


def ntok(column: str) -> str:
    return NTOK.replace("{0}", column)


TITLE = r"trim(regexp_extract(text, '^[^.!?\n]*'))"
LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"

CTE: dict[str, str] = {
    "versions": f"""
SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(doc_id AS VARCHAR) || '.1' AS version_id,
  sha256(text) AS content_hash, {TITLE} AS title,
  CASE WHEN doc_id % 11 <> 0 THEN DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) END AS publication_date,
  {quoted(DOC_TYPES)}[doc_id % 9 + 1] AS doc_type,
  CASE WHEN doc_id % 10 < 8 THEN 'indexed' WHEN doc_id % 10 = 8 THEN 'indexing' ELSE 'failed' END AS status,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS created_at, n_chars
FROM documents""",
    "sources": """
SELECT notebook_id || ':' || document_id AS source_id, notebook_id, document_id, created_at FROM (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest([source, 'lang-' || lang]) AS notebook_id,
    TIMESTAMP '2024-02-01' + to_minutes(CAST(doc_id AS INTEGER)) AS created_at FROM documents)""",
    "doc_lines": f"""
SELECT doc_id, source, lang, CAST(pos - 1 AS INTEGER) AS ordinal, line FROM (
  SELECT doc_id, source, lang, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) AS pos FROM documents)""",
    "blocks": f"""
SELECT CAST(doc_id AS VARCHAR) AS document_id, {quoted(DOC_TYPES)}[doc_id % 9 + 1] AS doc_type, ordinal,
  CASE WHEN length(line) < 60 THEN 'heading'
       WHEN (doc_id * 7 + ordinal) % 12 < {len(KINDS)} THEN {quoted(KINDS)}[(doc_id * 7 + ordinal) % 12 + 1]
       ELSE 'text' END AS kind,
  CASE WHEN length(line) < 60 AND (doc_id + ordinal) % 3 = 0
       THEN {quoted(HEADINGS)}[(doc_id + ordinal) % {len(HEADINGS)} + 1] ELSE line END AS text,
  CASE WHEN length(line) < 60 THEN CAST(length(line) % 3 + 1 AS INTEGER) END AS level,
  CAST(ordinal // 10 + 1 AS INTEGER) AS page
FROM doc_lines""",
    "passages": """
SELECT CAST(doc_id AS VARCHAR) || '-' || lpad(CAST(ordinal AS VARCHAR), 5, '0') AS chunk_id,
  CAST(doc_id AS VARCHAR) AS document_id, CAST(doc_id AS VARCHAR) || '.1' AS version_id, ordinal, line AS text,
  CAST(ordinal // 10 + 1 AS INTEGER) AS page,
  CAST(doc_id AS VARCHAR) || '-p' || lpad(CAST(ordinal // 4 AS VARCHAR), 5, '0') AS parent_id,
  source AS source_name
FROM doc_lines""",
    "parents": """
SELECT CAST(doc_id AS VARCHAR) || '-p' || lpad(CAST(ordinal // 4 AS VARCHAR), 5, '0') AS chunk_id,
  CAST(doc_id AS VARCHAR) AS document_id, CAST(doc_id AS VARCHAR) || '.1' AS version_id,
  CAST(min(ordinal) AS INTEGER) AS ordinal, string_agg(line, chr(10) ORDER BY ordinal) AS text,
  CAST(min(ordinal) // 10 + 1 AS INTEGER) AS page, CAST(NULL AS VARCHAR) AS parent_id, min(source) AS source_name
FROM doc_lines GROUP BY doc_id, ordinal // 4""",
    "chunk_rows": "SELECT * FROM passages UNION ALL SELECT * FROM parents",
    "titles": """
SELECT chunk_id, title AS text FROM passages JOIN versions USING (document_id) WHERE trim(title) <> ''""",
    "vectors": """
SELECT CAST(vec_id AS VARCHAR) || '-00000' AS chunk_id, CAST(vec_id AS VARCHAR) AS document_id,
  CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)""",
    "queries": """
SELECT item_id AS qid, text, ['dense', 'sparse', 'hybrid'][item_id % 3 + 1] AS mode,
  CASE WHEN item_id % 2 = 0 THEN 'src' || CAST(item_id % 20 AS VARCHAR) END AS notebook_id,
  CASE WHEN item_id % 4 <> 1 THEN DATE '2020-01-01' + CAST(item_id * 3 AS INTEGER) END AS date_after,
  CASE WHEN item_id % 4 <> 2 THEN DATE '2022-06-01' + CAST(item_id * 5 AS INTEGER) END AS date_before,
  CASE WHEN item_id % 3 <> 0 THEN ['generic', 'book', 'paper', 'code', 'markdown', 'email', 'resume', 'slides', 'documentation'][item_id % 4 + 1:item_id % 4 + 5] END AS doc_types,
  CASE WHEN item_id % 6 = 2 THEN list_transform(range(item_id, item_id + 301), lambda d: 'src' || CAST(d % 20 AS VARCHAR) || ':' || CAST(d AS VARCHAR))
       WHEN item_id % 9 = 1 THEN list_transform(range(item_id, item_id + 201), lambda d: 'lang-en:' || CAST(d AS VARCHAR))
       WHEN item_id % 50 = 3 THEN ['none:0'] END AS source_ids
FROM benchmark""",
    "query_vectors": """
SELECT item_id AS qid, CAST(embedding AS DOUBLE[]) AS vec FROM benchmark JOIN embeddings ON vec_id = item_id""",
    "turns": """
SELECT 's' || CAST(conv_id AS VARCHAR) AS session_id,
  't:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS turn_id, turn AS sequence, role,
  text AS content, TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 10 + turn AS INTEGER)) AS created_at
FROM conversations""",
    "sessions": """
SELECT session_id, min(created_at) AS created_at, max(created_at) AS updated_at,
  'src' || CAST(CAST(substr(session_id, 2) AS BIGINT) % 20 AS VARCHAR) AS notebook_id
FROM turns GROUP BY session_id""",
    "notes": """
SELECT 'n' || CAST(conv_id AS VARCHAR) AS note_id, 'src' || CAST(conv_id % 20 AS VARCHAR) AS notebook_id,
  text AS content, TIMESTAMP '2024-01-15' + to_minutes(CAST(conv_id AS INTEGER)) AS created_at
FROM conversations WHERE turn = 0""",
    "insights": f"""
SELECT 'i' || CAST(doc_id AS VARCHAR) AS insight_id, source AS notebook_id,
  source || ':' || CAST(doc_id AS VARCHAR) AS source_id,
  CASE WHEN toxic = 1 THEN 'claim' WHEN quality = 1 THEN 'key_fact' ELSE 'summary' END AS insight_type,
  {TITLE} AS content
FROM labels JOIN documents USING (doc_id)""",
    "messages": """
SELECT conv_id * 100000 + turn AS source_index,
  CASE WHEN conv_id % 7 = 3 AND turn = 2 THEN format('c{}.{}@example.org', conv_id, 1)
       ELSE format('c{}.{}@example.org', conv_id, turn) END AS message_id,
  CASE WHEN turn = 0 THEN CASE WHEN conv_id % 10 = 0 AND last_turn > 0 THEN format('c{}.{}@example.org', conv_id, last_turn)
                               WHEN conv_id % 5 = 1 THEN format('lost{}@example.org', conv_id) END
       WHEN turn % 3 <> 0 THEN format('c{}.{}@example.org', conv_id, turn - 1) END AS in_reply_to,
  CASE WHEN turn >= 2 THEN [format('c{}.{}@example.org', conv_id, turn - 2), format('c{}.{}@example.org', conv_id, turn - 1)]
       WHEN turn = 1 THEN [format('c{}.{}@example.org', conv_id, turn - 1)] ELSE CAST([] AS VARCHAR[]) END AS refs,
  text AS body, conv_id
FROM conversations JOIN (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id) USING (conv_id)""",
    "entities": """
SELECT 'r' || r_regionkey AS entity_id, r_name AS name, 'region' AS entity_type, CAST(r_regionkey % (SELECT count(*) FROM documents) AS VARCHAR) AS document_id FROM region
UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation', CAST(n_nationkey % (SELECT count(*) FROM documents) AS VARCHAR) FROM nation
UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier', CAST(s_suppkey % (SELECT count(*) FROM documents) AS VARCHAR) FROM supplier
UNION ALL SELECT 'p' || p_partkey, p_name, 'part', CAST(p_partkey % (SELECT count(*) FROM documents) AS VARCHAR) FROM part""",
    "edges": """
SELECT 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id, 'contains' AS relation FROM nation
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'hosts' FROM supplier
UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'supplies' FROM lineitem""",
    "cache": """
SELECT sha256(text) || '::m' AS key, CAST(len(embedding) AS INTEGER) AS dimensions, embedding AS vector,
  CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' WHEN doc_id % 3 = 1 THEN TIMESTAMP '2030-01-01' END AS expires_at,
  doc_id AS written
FROM documents JOIN embeddings ON vec_id = doc_id""",
}


def oracle(body: str, **extra: str) -> str:
    """``body`` with the common table expressions it names, in dependency order.

    ``extra`` holds expressions of one query; they may name the shared ones.
    """
    names = {**CTE, **extra}
    needed: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for name in names:
            if name in open_names or name in needed:
                continue
            if re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                open_names.add(name)
                visit(names[name])
                open_names.discard(name)
                needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = []
    for name in needed:
        parts.append(f"{name} AS ({names[name]})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
