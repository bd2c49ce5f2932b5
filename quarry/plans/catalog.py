"""The application's tables as views over the shared test tables.

Each view is one SELECT that both engines read; the few places where their dialects differ are
written in Spark's form and rewritten for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunking import page_chunks

#: The moment that sweeps, windows of retention and labels count from.
AS_OF = "2024-01-31 00:00:00"

_EXT = "CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'hwp' ELSE 'txt' END"
_EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"

VIEWS: dict[str, str] = {
    "kb_documents": f"""
SELECT doc_id AS id,
       concat(source, '_', lang, '_', CAST(doc_id AS STRING), '.', {_EXT}) AS filename,
       {_EXT} AS file_type,
       CASE doc_id % 5 WHEN 0 THEN 'spec' WHEN 1 THEN 'research' WHEN 2 THEN 'presentation' WHEN 3 THEN 'report' ELSE 'other' END AS category,
       CASE WHEN doc_id % 20 = 0 THEN 'failed' WHEN doc_id % 20 = 1 THEN 'parsing' ELSE 'success' END AS status,
       doc_id % 11 = 0 AS has_flagged,
       CASE WHEN doc_id % 13 = 0 THEN 'anonymous' ELSE concat('u', CAST(doc_id % 50 AS STRING), '@ex.com') END AS uploaded_by,
       CASE doc_id % 4 WHEN 0 THEN 'rnd' WHEN 1 THEN 'sales' WHEN 2 THEN 'ops' ELSE NULL END AS department,
       sha256_hex(text) AS sha256,
       {_EPOCH} + INTERVAL '1' MINUTE * (doc_id % 40000) AS uploaded_at,
       {_EPOCH} + INTERVAL '1' MINUTE * (doc_id % 40000 + doc_id % 60) AS updated_at,
       CASE WHEN doc_id % 3 = 0 THEN concat('Report ', source, ' ', CAST(doc_id % 100 AS STRING)) WHEN doc_id % 3 = 1 THEN '' ELSE NULL END AS title,
       CASE WHEN doc_id % 6 = 0 THEN concat('memo ', lang, ' the note') ELSE NULL END AS memo,
       1 + doc_id % 40 AS page_count,
       CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 17 END AS download_count,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('in/', source, '/', lang, {_EXT}) END AS original_path,
       lang, text
FROM documents""",
    "kb_users": """
SELECT DISTINCT concat('u', CAST(doc_id % 50 AS STRING), '@ex.com') AS email,
       CASE WHEN (doc_id % 50) % 7 = 0 THEN NULL ELSE concat('User ', CAST(doc_id % 50 AS STRING)) END AS name,
       CASE (doc_id % 50) % 4 WHEN 0 THEN 'rnd' WHEN 1 THEN 'sales' WHEN 2 THEN 'ops' ELSE NULL END AS department
FROM documents""",
    "kb_permissions": """
SELECT doc_id, concat('u', CAST((doc_id * 3) % 50 AS STRING), '@ex.com') AS user_email FROM documents WHERE doc_id % 6 = 0""",
    "kb_search_logs": """
SELECT event_id AS id,
       CASE WHEN CAST(json_k(props) AS BIGINT) % 10 = 0 THEN ' ' ELSE concat(event_type, ' ', json_k(props)) END AS query,
       concat('u', CAST(user_id % 50 AS STRING), '@ex.com') AS user_email,
       ts AS searched_at
FROM events WHERE event_type IN ('view', 'click')""",
    "kb_bookmarks": """
SELECT event_id % (SELECT count(*) FROM documents) AS doc_id,
       concat('u', CAST(user_id % 50 AS STRING), '@ex.com') AS user_email,
       min(ts) AS created_at
FROM events WHERE event_type = 'click' GROUP BY 1, 2""",
    "kb_downloads": """
SELECT event_id AS id, event_id % (SELECT count(*) FROM documents) AS doc_id, ts AS at FROM events WHERE event_type = 'purchase'""",
    "kb_comments": f"""
SELECT conv_id * 100 + turn AS id, conv_id % (SELECT count(*) FROM documents) AS doc_id,
       concat('u', CAST((conv_id * 7 + turn) % 50 AS STRING), '@ex.com') AS user_email,
       substring(text, 1, 1000) AS content,
       {_EPOCH} + INTERVAL '1' MINUTE * ((conv_id * 13 + turn) % 40000) AS created_at
FROM conversations WHERE role = 'user'""",
    "kb_page_scores": """
SELECT doc_id AS page_id,
       CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.3e0 WHEN 2 THEN 0.65e0 WHEN 3 THEN 0.85e0 ELSE 0.95e0 END AS parse_score,
       CASE (doc_id / 5) % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.3e0 WHEN 2 THEN 0.65e0 WHEN 3 THEN 0.85e0 ELSE 0.95e0 END AS ocr_score,
       text
FROM documents""",
    "kb_deletion_logs": f"""
SELECT doc_id AS id, doc_id, concat('d', CAST(doc_id AS STRING)) AS filename,
       CASE doc_id % 4 WHEN 0 THEN 'trashed' WHEN 1 THEN 'restored' WHEN 2 THEN 'purged' ELSE NULL END AS status,
       {_EPOCH} + INTERVAL '1' HOUR * (doc_id % 720) - INTERVAL '1' DAY * (doc_id % 97) AS deleted_at,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('[', CAST(doc_id AS STRING), ']') END AS snapshot,
       CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('trash/', CAST(doc_id AS STRING)) END AS trash_dir
FROM documents WHERE doc_id % 9 = 0""",
    "kb_revoked_sessions": """
SELECT user_id AS session_id, max(ts) AS revoked_at FROM events GROUP BY user_id
HAVING max(ts) = max(CASE WHEN event_type = 'error' THEN ts END)""",
    "kb_admin_emails": """
SELECT DISTINCT concat('U', CAST(doc_id % 50 AS STRING), '@ex.com') AS email FROM documents WHERE (doc_id % 50) % 9 = 4""",
    "kb_chunk_vectors": "SELECT vec_id AS chunk_id, vec_id % 100 AS doc_id, embedding, label FROM embeddings",
}

#: Ids of chunks: the document's times this, and the chunk's place in it.
CHUNKS_EACH = 1_000_000

_TRIM = r"'^\s+|\s+$', '', 'g'"
# Fixed values, as in operators.chunking: headings, and boundaries in the order in which they are preferred.
_HEADING = r"'^(?:#{1,4}\s+.+|\d+(?:\.\d+)*\.\s+\S.{0,60}|제\s*\d+\s*[장절항].{0,40})'"
_BOUNDARIES = ("chr(10) || chr(10)", "chr(10)", "'. '", "'? '", "'! '", "'。'", "'？'", "'！'")


def spans_sql(source: str) -> str:
    """DuckDB: doc_id, chunk_idx, cs, ce, text of the chunks of the rows (doc_id, text) of source."""
    found = [f"strpos(reverse(w), reverse({b}))" for b in _BOUNDARIES]
    cut = " ".join(f"WHEN {f} > 0 THEN start + 401 - {f}" for f in found)
    return f"""WITH RECURSIVE lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}),
placed AS (SELECT doc_id, text, 1 + coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines),
heads AS (SELECT doc_id, CAST(pos - 1 AS BIGINT) AS b FROM placed WHERE regexp_matches(substring(text, CAST(pos AS BIGINT)), {_HEADING})),
many AS (SELECT doc_id FROM heads GROUP BY doc_id HAVING count(*) > 1),
edge AS (SELECT doc_id, b, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS e FROM heads WHERE doc_id IN (FROM many) UNION ALL SELECT doc_id, 0, NULL FROM {source} WHERE doc_id NOT IN (FROM many)),
sec AS (SELECT doc_id, b, regexp_replace(substring(text, b + 1, coalesce(e, length(text)) - b), {_TRIM}) AS s FROM edge JOIN {source} USING (doc_id)),
r AS (SELECT doc_id, b, s, CAST(0 AS BIGINT) AS start, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS z, FALSE AS found, TRUE AS more FROM sec WHERE length(s) > 400
  UNION ALL SELECT doc_id, b, s, CASE WHEN cut IS NULL THEN start WHEN cut - 80 > start THEN cut - 80 ELSE cut END, CASE WHEN cut IS NOT NULL OR length(part) >= 80 OR NOT found THEN start END, coalesce(cut, length(s)),
    found OR (cut IS NOT NULL AND part <> ''), cut IS NOT NULL
  FROM (SELECT *, regexp_replace(substring(s, start + 1, coalesce(cut, length(s)) - start), {_TRIM}) AS part
    FROM (SELECT *, CASE WHEN start + 400 >= length(s) THEN NULL {cut} ELSE start + 400 END AS cut FROM (SELECT *, substring(s, start + 301, 100) AS w FROM r WHERE more)))),
c AS (SELECT doc_id, b AS cs, b + length(s) AS ce, s AS text FROM sec WHERE s <> '' AND length(s) <= 400
  UNION ALL SELECT doc_id, b + a, b + z, regexp_replace(substring(s, a + 1, z - a), {_TRIM}) FROM r WHERE a IS NOT NULL AND regexp_replace(substring(s, a + 1, z - a), {_TRIM}) <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cs) - 1 AS INT) AS chunk_idx, cs, ce, text FROM c"""


#: Views that only the oracle reads as SQL; Spark has them from the chunker and the embedder.
ORACLE_VIEWS: dict[str, str] = {
    "kb_pages": f"""
SELECT doc_id, page, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
FROM (SELECT doc_id, i AS page, regexp_replace(ls[i], {_TRIM}) AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE i % 7 <> 0) WHERE text <> ''""",
    "kb_joined": "SELECT doc_id, string_agg(text, chr(10) ORDER BY page) AS text FROM kb_pages GROUP BY doc_id",
    "kb_spans": spans_sql("kb_joined"),
    "kb_chunks": f"SELECT s.doc_id * {CHUNKS_EACH} + s.chunk_idx AS chunk_id, s.doc_id, s.chunk_idx, page AS page_num, s.text FROM kb_spans s ASOF JOIN kb_pages p ON s.doc_id = p.doc_id AND s.cs >= p.off WHERE length(s.text) >= 20",
    "kb_chunk_embeddings": """
SELECT chunk_id, list(CASE WHEN norm > 0 THEN CAST(v / norm AS FLOAT) ELSE CAST(0 AS FLOAT) END ORDER BY i) AS embedding
FROM (SELECT chunk_id, i, CAST(coalesce(v, 0) AS DOUBLE) AS v, sqrt(CAST(sum(coalesce(v, 0) * coalesce(v, 0)) OVER (PARTITION BY chunk_id) AS DOUBLE)) AS norm
  FROM (SELECT chunk_id, unnest(range(0, 64)) AS i FROM kb_texts) LEFT JOIN (SELECT chunk_id, h % 64 AS i, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS BIGINT) AS v
    FROM (SELECT chunk_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT chunk_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> '')) AS w FROM kb_texts)) GROUP BY ALL) USING (chunk_id, i))
GROUP BY chunk_id""",
}

_SPARK = {"vec_id / 100": "vec_id DIV 100", "sha256_hex(text)": "sha2(text, 256)", "json_k(props)": "get_json_object(props, '$.k')", "(doc_id / 5) %": "(doc_id DIV 5) %"}
_DUCK = {
    "vec_id / 100": "vec_id // 100",
    "sha256_hex(text)": "sha256(text)",
    "json_k(props)": "json_extract_string(props, '$.k')",
    "(doc_id / 5) %": "(doc_id // 5) %",
    "TIMESTAMP_NTZ '": "TIMESTAMP '",
}


def _dialect(sql: str, words: dict[str, str]) -> str:
    for a, b in words.items():
        sql = sql.replace(a, b)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS as a DataFrame; nothing is registered in the session."""
    sql = _dialect(VIEWS[name], _SPARK)
    for base in ("documents", "events", "conversations", "embeddings"):
        sql = sql.replace(f"FROM {base}", f"FROM {{{base}}}").replace(f"JOIN {base}", f"JOIN {{{base}}}")
    used = {b: table(spark, sf_dir, b) for b in ("documents", "events", "conversations", "embeddings") if f"{{{b}}}" in sql}
    return spark.sql(sql, **used)


def paged(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Each document, or each of docs (doc_id, text), as pages at its line ends, every seventh flagged."""
    lines = F.split("text", "\n")
    pages = F.transform(lines, lambda t, i: F.struct((i + 1).cast("long").alias("page"), t.alias("text"), (i % 7 == 6).alias("flagged")))
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return docs.select("doc_id", pages.alias("pages"))


def chunk_rows(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """chunk_id, doc_id, chunk_idx, page_num, text of the chunks of every document, or of docs (doc_id, text)."""
    return page_chunks(paged(spark, sf_dir, docs)).select((F.col("doc_id") * CHUNKS_EACH + F.col("chunk_idx")).alias("chunk_id"), "doc_id", "chunk_idx", "page_num", "text")


def oracle(query: str, question: str | None = None) -> str:
    """query with the views that it names, and those that these name, as common table expressions for
    DuckDB. kb_texts is what is embedded: the chunks and, as chunk -1, a question."""
    asked = f" UNION ALL SELECT -1, '{question}'" if question else ""
    known = VIEWS | ORACLE_VIEWS | {"kb_texts": f"SELECT chunk_id, text FROM kb_chunks{asked}"}
    used: list[str] = []

    def want(sql: str) -> None:
        for name in known:
            if re.search(rf"\b{name}\b", sql) and name not in used:
                want(known[name])
                used.append(name)

    want(query)
    ctes = [f"{name} AS {'MATERIALIZED ' if name in ORACLE_VIEWS else ''}({_dialect(known[name], _DUCK)})" for name in used]
    body = _dialect(query.strip(), _DUCK)
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body
