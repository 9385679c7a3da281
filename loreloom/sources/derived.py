"""A vault made from the parquet tables by rule: notes with front matter, links and tags.

The same SQL text runs on Spark and, for the oracle, on DuckDB; only the date arithmetic
differs. Spark's queries then start from the rendered ``content`` alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a document, by rule from its id; links are made so that some notes have none.
_COLUMNS = """
SELECT doc_id, coalesce(text, '') AS text, lang, source,
  CASE WHEN doc_id % 10 = 1 THEN '03-Resources/' ELSE '01-Projects/' END || source || '/' || lang || '/doc-' || CAST(CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END AS {string}) || '.md' AS path,
  CASE doc_id % 5 WHEN 0 THEN 'task' WHEN 1 THEN 'adr' WHEN 2 THEN 'research' WHEN 3 THEN 'devlog' ELSE 'permanent' END AS type,
  CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'active' WHEN 2 THEN 'done' ELSE 'cancelled' END AS status,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'low' WHEN doc_id % 4 = 1 THEN 'normal' WHEN doc_id % 4 = 2 THEN 'high' ELSE 'urgent' END AS priority,
  CASE WHEN doc_id % 11 <> 0 THEN CAST({created} AS {string}) END AS created,
  CASE WHEN doc_id % 5 = 0 AND doc_id % 6 <> 0 THEN CAST({due} AS {string}) END AS due,
  CASE WHEN doc_id % 3 <> 0 THEN source END AS project,
  CASE WHEN doc_id % 4 = 0 THEN upper(lang) ELSE lang END AS tag1, 'src/' || source AS tag2,
  CASE WHEN doc_id % 19 <> 0 THEN 'topic/t' || CAST(doc_id % 7 AS {string}) END AS inline_tag,
  (7 * doc_id + 1) % (SELECT count(*) FROM {documents}) AS u, (3 * doc_id + 2) % (SELECT count(*) FROM {documents}) AS v
FROM {documents}
"""
_LINKS = """
SELECT c.*,
  CASE WHEN c.doc_id % 19 <> 0 AND c.u % 19 <> 0 AND NOT (c.u % 10 = 0 AND (c.u + 1) % 19 = 0) THEN 'doc-' || CAST(c.u AS {string}) END AS link1,
  CASE WHEN c.doc_id % 19 <> 0 AND NOT (c.v % 19 = 0 AND c.v % 38 <> 0) THEN substr(t.path, 1, length(t.path) - 3) END AS link2,
  CASE WHEN c.doc_id % 19 <> 0 AND c.doc_id % 13 = 0 THEN 'missing-' || CAST(c.doc_id AS {string}) END AS link3,
  CASE WHEN c.doc_id % 19 <> 0 AND c.doc_id % 17 = 0 THEN 'img.png' END AS link4
FROM columns_of_notes c LEFT JOIN (SELECT doc_id AS v, path FROM columns_of_notes) t ON c.v = t.v
"""
_CONTENT = """
SELECT doc_id, path, type, status, priority, created, due, project, lower(tag1) AS tag1, lower(tag2) AS tag2, inline_tag, link1, link2, link3, link4, text,
  '---' || chr(10) || 'type: ' || type || chr(10) || 'status: ' || status || chr(10)
  || coalesce('priority: ' || priority || chr(10), '') || coalesce('created: ' || created || chr(10), '') || coalesce('due: ' || due || chr(10), '') || coalesce('project: "' || project || '"' || chr(10), '')
  || CASE WHEN doc_id % 2 = 0 THEN 'tags: [' || tag1 || ', ' || tag2 || ']' || chr(10) ELSE 'tags:' || chr(10) || '  - ' || tag1 || chr(10) || '  - ' || tag2 || chr(10) END
  || '---' || chr(10) || chr(10) || '# Doc ' || CAST(doc_id AS {string}) || chr(10) || chr(10) || '## Text' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Links' || chr(10)
  || coalesce(chr(10) || '- [[' || link1 || ']]', '') || coalesce(chr(10) || '- [[' || link2 || '|alias]]', '') || coalesce(chr(10) || '- [[' || link3 || ']]', '') || coalesce(chr(10) || '![[' || link4 || ']]', '')
  || chr(10) || chr(10) || '### Topics' || chr(10) || coalesce('about #' || inline_tag || chr(10), '') AS content,
  1700000000000 + (doc_id * 7919) % 100003 * 1000 AS mtime_ms
FROM links_of_notes
"""
SPARK = {"string": "STRING", "created": "date_add(DATE '2025-01-01', CAST(doc_id % 365 AS INT))", "due": "date_add(DATE '2025-06-01', CAST(doc_id % 200 AS INT))"}
DUCKDB = {"string": "VARCHAR", "created": "(DATE '2025-01-01' + CAST(doc_id % 365 AS INTEGER))", "due": "(DATE '2025-06-01' + CAST(doc_id % 200 AS INTEGER))", "documents": "documents"}


def vault_sql(engine: dict[str, str]) -> str:
    """The common table expressions of the vault; the last one is ``vault``."""
    columns, links, content = (x.format(**engine) for x in (_COLUMNS, _LINKS, _CONTENT))
    return f"WITH columns_of_notes AS ({columns}), links_of_notes AS ({links}), vault AS ({content})"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, mtime_ms, size."""
    sql = vault_sql(SPARK | {"documents": "{documents}"}) + " SELECT path, content, mtime_ms, CAST(octet_length(content) AS BIGINT) AS size FROM vault"
    return spark.sql(sql, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file_path, chunk_index, heading, content_preview, embedding: vectors dealt to notes two at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sql = vault_sql(SPARK | {"documents": "{documents}"}).replace("coalesce(text, '') AS text", "'' AS text") + " SELECT doc_id, path AS file_path FROM vault"
    paths = spark.sql(sql, documents=docs)
    n = docs.count()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    dealt = vectors.withColumn("doc_id", F.floor(F.col("vec_id") / 2) % n)
    heading = F.concat(F.lit("label "), F.col("label").cast("string"))
    return dealt.join(paths, "doc_id").select(F.col("vec_id").alias("id"), "file_path", (F.col("vec_id") % 2).cast("int").alias("chunk_index"), heading.alias("heading"), F.lit("").alias("content_preview"), "embedding")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, timestamp (ISO text), session_id, tool_name, args_json."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return e.select(F.col("event_id").alias("id"), stamp.alias("timestamp"), F.md5(F.col("user_id").cast("string").cast("binary")).alias("session_id"), F.col("event_type").alias("tool_name"), F.col("props").alias("args_json"))
