"""Registered queries of the vault engine, each beside the DuckDB SQL that must agree with it.

A query starts from rendered note contents and goes through YAML, links and text
operators; its SQL computes the same from the columns that the contents were made of.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.frontmatter import parsed, with_meta
from ..operators import batch, catalog, chunking, events, graph, links, mutate, reading, vector
from ..sources import derived
from ..sources.shared import cut, shared_folder
from ..streaming import link_index, refresh, text_index
from . import reports

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
VAULT = derived.vault_sql(derived.DUCKDB)
LINKS = r"""
, link_lists AS (SELECT path AS src, list_filter([link1, link2, link3, link4], lambda x: x IS NOT NULL) AS l FROM vault)
, links AS (SELECT src, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM link_lists)
, names AS (SELECT path, lower(regexp_extract(path, '([^/]+)\.md$', 1)) AS name FROM vault)
, resolved AS (SELECT l.src, l.pos, l.raw, coalesce(e.path, b.path) AS dst,
    CASE WHEN e.path IS NOT NULL THEN 1 ELSE count(b.path) OVER (PARTITION BY l.src, l.pos) END AS n_candidates
  FROM links l LEFT JOIN names e ON e.path = l.raw || '.md'
  LEFT JOIN names b ON e.path IS NULL AND b.name = lower(regexp_extract(l.raw, '([^/]+)$', 1)))
"""
DEGREES = """
, degree AS (SELECT v.path, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming FROM vault v
  LEFT JOIN (SELECT src, count(DISTINCT pos) AS n FROM resolved WHERE dst IS NOT NULL GROUP BY src) o ON o.src = v.path
  LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM resolved WHERE dst <> src GROUP BY dst) i ON i.dst = v.path)
"""
START = "(SELECT path FROM vault WHERE doc_id = 3)"


def _levels(depth: int, steps: str = "SELECT src AS a, dst AS b FROM resolved WHERE dst IS NOT NULL UNION SELECT dst, src FROM resolved WHERE dst IS NOT NULL") -> str:
    """Common table expressions ``nodes`` (path, depth) around the start note."""
    out = f", steps AS ({steps}), l0 AS (SELECT {START} AS path, 0 AS depth)"
    for k in range(1, depth + 1):
        out += f", l{k} AS (SELECT * FROM l{k - 1} UNION ALL SELECT DISTINCT s.b, {k} FROM l{k - 1} x JOIN steps s ON s.a = x.path WHERE x.depth = {k - 1} AND s.b NOT IN (SELECT path FROM l{k - 1}))"
    return out + f", nodes AS (SELECT * FROM l{depth})"


KNN = """
, chunk AS (SELECT vec_id AS id, v.path AS file_path, embedding FROM embeddings e JOIN vault v ON v.doc_id = (e.vec_id // 2) % (SELECT count(*) FROM documents))
, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)
, near AS (SELECT c.id, c.file_path, sqrt(list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) AS d FROM chunk c, q)
, cand AS (SELECT *, greatest(0.0, least(1.0, 1 - d / 2)) AS s FROM near ORDER BY d, id LIMIT {k})
, best AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY d, id) AS n FROM cand WHERE {where})
, hits AS (SELECT file_path AS path, floor(s * 1000 + 0.5) / 1000 AS score, d, id FROM best WHERE n = 1 ORDER BY d, id LIMIT {limit})
"""


def _knn(limit: int, where: str = "true", k: int | None = None) -> str:
    return KNN.format(k=k or min(3 * limit, 50), where=where, limit=limit)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` follows the vault's common table expressions."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql if sql.startswith("--own") else VAULT + sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {k: v.removeprefix("--own\n") for k, v in _sql.items()}


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return derived.notes(spark, d)


def _path(spark: SparkSession, d: str, doc: int) -> str:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    row = docs.where(F.col("doc_id") == doc).select("lang", "source").first()
    return f"01-Projects/{row.source}/{row.lang}/doc-{doc}.md"


def _vector(spark: SparkSession, d: str) -> list[float]:
    return spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id = 0").first().embedding


# --- scans, listing, search -------------------------------------------------------------


@query(" SELECT path, length(content) AS n_chars, octet_length(encode(content)) AS size, mtime_ms FROM vault")
def scan_notes(spark, d):
    return _notes(spark, d).select("path", F.length("content").cast("long").alias("n_chars"), "size", "mtime_ms")


@query(" SELECT path, mtime_ms, strftime(make_timestamp(mtime_ms * 1000), '%Y-%m-%d') AS day FROM vault ORDER BY mtime_ms DESC, path LIMIT 10")
def recent_notes(spark, d):
    return catalog.recent(_notes(spark, d))


@query(" SELECT DISTINCT '01-Projects/' || split_part(path, '/', 2) AS entry, true AS is_dir FROM vault WHERE starts_with(path, '01-Projects/')")
def list_dir(spark, d):
    return catalog.list_directory(_notes(spark, d), "01-Projects")


@query(" SELECT path AS entry, false AS is_dir FROM vault WHERE path LIKE '01-Projects/src3/en/doc-%3%.md'")
def glob_filter(spark, d):
    return catalog.list_directory(_notes(spark, d), "01-Projects/src3/en", recursive=True, pattern="doc-*3*.md")


@query(" SELECT path FROM vault WHERE contains(lower(content), 'topic/t3') AND starts_with(path, '03-Resources/') ORDER BY path LIMIT 10")
def search_text(spark, d):
    return catalog.search(_notes(spark, d), "TOPIC/t3", "03-Resources").select("path").distinct()


@query(" , h AS (SELECT path, content FROM vault WHERE contains(lower(content), 'en') ORDER BY path LIMIT 10), l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM h) SELECT path, CAST(line_no AS INTEGER) AS line_no, substr(trim(line), 1, 100) AS line FROM l WHERE contains(lower(line), 'en') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 3")
def search_lines_top3(spark, d):
    return catalog.search(_notes(spark, d), "en")


_ASKED = ("TOPIC/t3", "missing-1", "### Top", "\n- [[doc-1", "en", "no such text")


@query(" , q AS (SELECT unnest(['topic/t3', 'missing-1', '### top', chr(10) || '- [[doc-1', 'en', 'no such text']) AS query), h AS (SELECT query, path, content FROM q, vault WHERE contains(lower(content), query) QUALIFY row_number() OVER (PARTITION BY query ORDER BY path) <= 5), l AS (SELECT query, path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM h), m AS (SELECT query, path, CAST(n AS INTEGER) AS line_no FROM l WHERE contains(lower(line), query) QUALIFY row_number() OVER (PARTITION BY query, path ORDER BY n) <= 3) SELECT h.query, h.path, m.line_no FROM h LEFT JOIN m ON m.query = h.query AND m.path = h.path")
def indexed_text_search(spark, d):
    """Six texts through the index of pieces, after a refresh with older contents and one that mends them."""
    notes = cut(_notes(spark, d), compression="zstd")  # made once: every use of their rule exchanges all contents
    index = text_index.TextIndex(spark, shared_folder(spark, "pieces"), buckets=16)
    index.sync(notes.select("path", F.when(F.col("mtime_ms") % 3000 == 0, F.concat("content", F.lit("no such text"))).otherwise(F.col("content")).alias("content"), (F.col("mtime_ms") - 1).alias("mtime_ms"), "size"))
    index.sync(notes)
    found = [index.search(notes, q, limit=5).select(F.lit(q.lower()).alias("query"), "path", "line_no") for q in _ASKED]
    return functools.reduce(DataFrame.unionByName, found)


# --- metadata ----------------------------------------------------------------------------


@query(" SELECT path, type, status FROM vault WHERE type = 'task' AND status = 'pending'")
def query_type_status(spark, d):
    return catalog.query(_notes(spark, d), type="task", status="pending", limit=None).select("path", "meta.type", "meta.status")


@query(" SELECT path, tag1 || ',' || tag2 AS tags FROM vault WHERE tag1 = 'en' AND tag2 = 'src/src3'")
def query_tags_all(spark, d):
    found = catalog.query(_notes(spark, d), tags=["EN", "src/src3"], limit=None)
    return found.select("path", F.array_join(F.transform("meta.tags", F.lower), ",").alias("tags"))


@query(" SELECT path FROM vault WHERE tag1 = 'fr' OR tag2 = 'src/src5'")
def query_tags_any(spark, d):
    return catalog.query(_notes(spark, d), tags_any=["FR", "src/src5"], limit=None).select("path")


@query(" SELECT path, created FROM vault WHERE coalesce(created, '') <= '2025-03-31'")
def query_created_before(spark, d):
    return catalog.query(_notes(spark, d), created_before="2025-03-31", limit=None).select("path", "meta.created")


@query(" SELECT path, created FROM vault WHERE created >= '2025-03-01' AND created <= '2025-06-30'")
def query_created_range(spark, d):
    return catalog.query(_notes(spark, d), created_after="2025-03-01", created_before="2025-06-30", limit=None).select("path", "meta.created")


@query(" SELECT path, project FROM vault WHERE project = 'src4'")
def query_custom_field(spark, d):
    return catalog.query(_notes(spark, d), custom_fields={"project": "src4"}, limit=None).select("path", "meta.project")


@query(" SELECT path FROM vault WHERE priority IS NULL AND due IS NULL")
def query_custom_null(spark, d):
    return catalog.query(_notes(spark, d), custom_fields={"priority": None, "due": ""}, limit=None).select("path")


_RANK = "CASE priority WHEN 'urgent' THEN 3 WHEN 'high' THEN 2 WHEN 'normal' THEN 1 WHEN 'low' THEN 0 END"


@query(f" SELECT path, priority FROM vault WHERE type = 'task' ORDER BY priority IS NULL DESC, {_RANK} DESC, path LIMIT 50")
def query_sort_priority_desc(spark, d):
    return catalog.query(_notes(spark, d), type="task", sort_by="priority", sort_order="desc").select("path", "meta.priority")


@query(" SELECT path, due FROM vault WHERE type = 'task' ORDER BY due IS NULL, due, path LIMIT 40")
def query_sort_due_asc_limit(spark, d):
    return catalog.query(_notes(spark, d), type="task", sort_by="due", limit=40).select("path", "meta.due")


@query(" SELECT tag, count(*) AS n_notes FROM (SELECT unnest([tag1, tag2]) AS tag FROM vault) GROUP BY tag")
def tags_count(spark, d):
    return catalog.tag_counts(_notes(spark, d))


@query(" SELECT tag, count(*) AS n_notes FROM (SELECT unnest([tag1, tag2]) AS tag FROM vault) WHERE starts_with(tag, 'src/') GROUP BY tag")
def tags_pattern(spark, d):
    return catalog.tag_counts(_notes(spark, d), pattern="SRC/*")


_FORMS = ("*RC3*", "f*", "*5", "EN")


@query(" , t AS (SELECT unnest([tag1, tag2]) AS tag FROM vault), m AS (SELECT unnest(['*RC3*', 'f*', '*5', 'EN']) AS pattern, unnest([contains(tag, 'rc3'), starts_with(tag, 'f'), suffix(tag, '5'), tag = 'en']) AS hit, tag FROM t) SELECT pattern, tag, count(*) AS n_notes FROM m WHERE hit GROUP BY pattern, tag")
def tags_pattern_forms(spark, d):
    forms = F.array_compact(F.array(*(F.when(tx.tag_matches(F.col("tag"), p), F.lit(p)) for p in _FORMS)))
    return catalog.note_tags(_notes(spark, d)).select("tag", F.explode(forms).alias("pattern")).groupBy("pattern", "tag").agg(F.count("*").alias("n_notes"))


@query(" SELECT tag, count(*) AS n_notes FROM (SELECT unnest([tag1, tag2, inline_tag]) AS tag FROM vault) WHERE tag IS NOT NULL GROUP BY tag")
def inline_tags(spark, d):
    return catalog.tag_counts(_notes(spark, d), include_inline=True)


@query(" SELECT count(*) AS n_notes FROM vault WHERE starts_with(path, '03-Resources/')")
def notes_with_tags(spark, d):
    return catalog.notes_with_tags(_notes(spark, d), "03-Resources")


@query(" SELECT path, created IS NOT NULL AS valid, CASE WHEN created IS NULL THEN 1 ELSE 0 END AS n_errors FROM vault")
def validate_required(spark, d):
    return catalog.validation(_notes(spark, d)).select("path", "valid", F.size("errors").alias("n_errors"))


# --- reading -------------------------------------------------------------------------------

_SPLIT = ", body AS (SELECT path, doc_id, content, text, substr(content, 1, strpos(content, '---' || chr(10) || chr(10) || '# Doc') + 2) AS front, substr(content, strpos(content, chr(10) || '---' || chr(10) || chr(10) || '# Doc') + 4) AS body, strpos(content, chr(10) || '## Links' || chr(10)) AS at_links FROM vault)"
_HASH = "sha256(encode({0}))"


@query(" SELECT path, unnest(['# Doc ' || doc_id, '## Text', '## Links', '### Topics']) AS heading, unnest([1, 2, 2, 3]) AS level FROM vault")
def headings_outline(spark, d):
    h = F.explode(tx.headings(F.col("content")))
    return _notes(spark, d).select("path", h.alias("heading")).withColumn("level", tx.heading_level(F.col("heading")))


@query(_SPLIT + f" SELECT path, {_HASH.format('substr(content, at_links + 1)')} AS digest FROM body")
def section_slice(spark, d):
    return _notes(spark, d).select("path", F.sha2(reading.section(F.col("content"), "## Links").cast("binary"), 256).alias("digest"))


@query(_SPLIT + f" SELECT path, {_HASH.format('front || chr(10) || array_to_string(list_slice(string_split(body, chr(10)), -4, -1), chr(10))')} AS digest FROM body")
def tail_lines(spark, d):
    return _notes(spark, d).select("path", F.sha2(reading.tail_lines(F.col("content"), 4).cast("binary"), 256).alias("digest"))


@query(_SPLIT + f" SELECT path, {_HASH.format('front || chr(10) || substr(content, at_links + 1)')} AS digest FROM body")
def tail_sections(spark, d):
    return _notes(spark, d).select("path", F.sha2(reading.tail_sections(F.col("content"), 1, 2).cast("binary"), 256).alias("digest"))


@query(" SELECT path, array_to_string(list_slice(string_split(content, chr(10)), 2, 5), chr(10)) AS text FROM vault")
def line_range(spark, d):
    return _notes(spark, d).select("path", reading.line_range(F.col("content"), 2, 5.9).alias("text"))


@query(f" SELECT path, {_HASH.format('substr(content, 1001, 1000)')} AS digest FROM vault WHERE length(content) > 1000")
def char_chunk(spark, d):
    chunk = reading.char_chunk(F.col("content"), 2, 1000)
    return _notes(spark, d).select("path", F.sha2(chunk.cast("binary"), 256).alias("digest")).where("digest IS NOT NULL")


@query(" SELECT path, length(content) > 80000 AS redirected, CASE WHEN length(content) <= 80000 THEN length(content) END AS n FROM vault")
def read_full(spark, d):
    return reading.read(_notes(spark, d)).select("path", "redirected", F.length("text").cast("long").alias("n"))


@query(_SPLIT + " SELECT path, length(content) AS size_chars, len(string_split(content, chr(10))) AS size_lines, CAST(ceil(length(content) / 80000.0) AS INTEGER) AS total_chunks, 4 AS n_headings, length(content) - at_links AS links_chars FROM body")
def peek_metrics(spark, d):
    p = reading.peek(_notes(spark, d))
    links_head = F.filter("headings", lambda h: h["heading"] == "## Links")[0]["char_count"]
    return p.select("path", F.col("size_chars").cast("long"), F.col("size_lines").cast("long"), "total_chunks", F.size("headings").alias("n_headings"), links_head.cast("long").alias("links_chars"))


# --- links and graph -------------------------------------------------------------------------


@query(LINKS + " SELECT src, pos, raw FROM links")
def wikilinks_outgoing(spark, d):
    return links.outgoing(_notes(spark, d)).select("src", F.col("pos").cast("long"), "raw")


@query(LINKS + " SELECT src, pos, raw, dst, n_candidates > 1 AS ambiguous, n_candidates FROM resolved")
def link_resolution(spark, d):
    return links.edges(_notes(spark, d)).select("src", F.col("pos").cast("long"), "raw", "dst", "ambiguous", F.col("n_candidates").cast("long"))


@query(LINKS + " SELECT DISTINCT dst, src FROM resolved WHERE dst <> src")
def incoming_links(spark, d):
    return links.incoming(links.edges(_notes(spark, d)))


@query(LINKS + f" SELECT DISTINCT src AS path FROM resolved WHERE dst = {START} AND src <> dst")
def files_linking_to(spark, d):
    return links.linking_to(_notes(spark, d), _path(spark, d, 3))


@query(LINKS + f" SELECT 'outgoing' AS direction, raw AS target FROM links WHERE src = {START} UNION ALL SELECT DISTINCT 'incoming', src FROM resolved WHERE dst = {START} AND src <> dst")
def note_links(spark, d):
    return links.note_links(_notes(spark, d), _path(spark, d, 3))


@query(LINKS + DEGREES + " SELECT * FROM degree")
def degree(spark, d):
    return links.degrees(_notes(spark, d))


@query(LINKS + DEGREES + " SELECT path FROM degree WHERE outgoing = 0 AND incoming = 0")
def orphans(spark, d):
    return links.orphans(links.degrees(_notes(spark, d)))


@query(LINKS + DEGREES + " SELECT * FROM degree WHERE outgoing + incoming = 1")
def weak_notes(spark, d):
    return links.weak(links.degrees(_notes(spark, d)))


@query(LINKS + " SELECT src, pos, raw FROM resolved WHERE dst IS NULL AND NOT contains(raw, '.')")
def broken_links(spark, d):
    return links.broken(links.factored(_notes(spark, d))).withColumn("pos", F.col("pos").cast("long"))


@query(LINKS + " SELECT raw, min(src) AS src, max(n_candidates) AS n_candidates FROM resolved WHERE n_candidates > 1 GROUP BY raw")
def ambiguous_links(spark, d):
    return links.ambiguous(links.factored(_notes(spark, d))).withColumn("n_candidates", F.col("n_candidates").cast("long"))


@query(LINKS + DEGREES + " SELECT path FROM degree WHERE outgoing = 0 AND incoming = 0 AND starts_with(path, '01-Projects/') ORDER BY path LIMIT 20")
def health_folder_orphans(spark, d):
    return links.health(_notes(spark, d), "01-Projects", ("orphans",))["orphans"]


@query(LINKS + DEGREES + ", inner_links AS (SELECT * FROM resolved WHERE starts_with(src, '01-Projects/')), w AS (SELECT * FROM degree WHERE outgoing + incoming = 1 AND starts_with(path, '01-Projects/') ORDER BY path LIMIT 20), b AS (SELECT src, raw FROM inner_links WHERE dst IS NULL AND NOT contains(raw, '.') ORDER BY src, pos LIMIT 20), a AS (SELECT raw, min(src) AS src, max(n_candidates) AS n FROM inner_links WHERE n_candidates > 1 GROUP BY raw ORDER BY src, raw LIMIT 20) SELECT 'weak' AS \"check\", path, outgoing || ' ' || incoming AS detail FROM w UNION ALL SELECT 'broken', src, raw FROM b UNION ALL SELECT 'ambiguous', src, raw || ' ' || n FROM a")
def health_folder_checks(spark, d):
    h = links.health(_notes(spark, d), "01-Projects", ("broken", "weak", "ambiguous"))
    shown = {"weak": ("path", F.concat_ws(" ", "outgoing", "incoming")), "broken": ("src", F.col("raw")), "ambiguous": ("src", F.concat_ws(" ", "raw", "n_candidates"))}
    parts = [h[c].select(F.lit(c).alias("check"), F.col(at).alias("path"), detail.alias("detail")) for c, (at, detail) in shown.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(LINKS + DEGREES + " SELECT 'orphans' AS \"check\", count(*) AS findings FROM degree WHERE outgoing + incoming = 0 UNION ALL SELECT 'weak', count(*) FROM degree WHERE outgoing + incoming = 1 UNION ALL SELECT 'broken', count(*) FROM resolved WHERE dst IS NULL AND NOT contains(raw, '.') UNION ALL SELECT 'ambiguous', count(DISTINCT raw) FROM resolved WHERE n_candidates > 1")
def link_audit(spark, d):
    return reports.link_audit(_notes(spark, d))


def _around(spark, d, depth, direction="both"):
    start = spark.createDataFrame([(_path(spark, d, 3),)], "path string")
    return graph.neighborhood(_notes(spark, d), start, depth, direction)


@query(LINKS + _levels(2) + " SELECT * FROM nodes")
def neighborhood_both(spark, d):
    return _around(spark, d, 2).select("path", "depth")


@query(LINKS + _levels(2, "SELECT DISTINCT src AS a, dst AS b FROM resolved WHERE dst IS NOT NULL") + " SELECT * FROM nodes")
def neighborhood_out(spark, d):
    return _around(spark, d, 2, "outgoing").select("path", "depth")


@query(LINKS + _levels(2, "SELECT DISTINCT dst AS a, src AS b FROM resolved WHERE dst IS NOT NULL") + " SELECT * FROM nodes")
def neighborhood_in(spark, d):
    return _around(spark, d, 2, "incoming").select("path", "depth")


@query(LINKS + _levels(3) + " SELECT depth, count(*) AS n_notes FROM nodes GROUP BY depth")
def neighborhood_depth_counts(spark, d):
    return graph.depth_groups(_around(spark, d, 3))


def _walk(depth: int) -> str:
    """``walk`` (path, depth, ambiguous, trail): the first step that reaches each note, level by level."""
    out = """, steps AS (SELECT src AS a, dst AS b, n_candidates > 1 AS ambiguous, {'kind': 0, 'pos': pos, 'path': dst} AS step FROM resolved WHERE dst IS NOT NULL
  UNION ALL SELECT DISTINCT dst, src, false, {'kind': 1, 'pos': 0, 'path': src} FROM resolved WHERE dst <> src)"""
    out += f", w0 AS (SELECT {START} AS path, 0 AS depth, false AS ambiguous, []::STRUCT(kind INTEGER, pos BIGINT, path VARCHAR)[] AS trail)"
    for k in range(1, depth + 1):
        out += f""", s{k} AS (SELECT s.b, s.ambiguous, list_append(x.trail, s.step) AS trail FROM w{k - 1} x JOIN steps s ON s.a = x.path WHERE x.depth = {k - 1} AND s.b NOT IN (SELECT path FROM w{k - 1}))
, w{k} AS (SELECT * FROM w{k - 1} UNION ALL SELECT b, {k}, arg_min(ambiguous, trail), min(trail) FROM s{k} GROUP BY b)"""
    return out + f", walk AS (SELECT * FROM w{depth})"


@query(LINKS + _walk(3) + " SELECT path, depth, ambiguous, row_number() OVER (PARTITION BY depth ORDER BY trail) AS place FROM walk")
def neighborhood_in_order(spark, d):
    """Whether the first step to each note is ambiguous, and the note's place in its level."""
    start = spark.createDataFrame([(_path(spark, d, 3),)], "path string")
    nodes = graph.neighborhood(_notes(spark, d), start, 3, ordered=True)
    return nodes.select("path", "depth", "ambiguous", F.row_number().over(Window.partitionBy("depth").orderBy("trail")).cast("long").alias("place"))


@query(LINKS + _walk(3) + " SELECT path, depth, ambiguous, row_number() OVER (PARTITION BY depth ORDER BY trail) AS place FROM walk")
def neighborhood_stored(spark, d):
    """The same from stored links, after a refresh with other links and one that mends them."""
    notes = _notes(spark, d)
    index = link_index.LinkIndex(spark, shared_folder(spark, "links"), buckets=16)
    other = F.when(F.col("mtime_ms") % 3000 == 0, F.concat("content", F.lit("[[doc-3]]"))).otherwise(F.col("content"))
    index.sync(notes.select("path", other.alias("content"), (F.col("mtime_ms") - 1).alias("mtime_ms"), "size"))
    index.sync(notes)
    nodes = index.neighborhood(spark.createDataFrame([(_path(spark, d, 3),)], "path string"), 3, ordered=True)
    return nodes.select("path", "depth", "ambiguous", F.row_number().over(Window.partitionBy("depth").orderBy("trail")).cast("long").alias("place"))


# --- vectors ------------------------------------------------------------------------------------


@query(_knn(5) + " SELECT path, score FROM hits")
def knn_raw(spark, d):
    return vector.search_raw(derived.chunks(spark, d), _vector(spark, d)).select("path", "score")


@query(_knn(20, "starts_with(file_path, '03-Resources/')") + " SELECT path, score FROM hits")
def knn_folder_postfilter(spark, d):
    return vector.search_raw(derived.chunks(spark, d), _vector(spark, d), 20, folder="03-Resources").select("path", "score")


@query(_knn(10, "s >= 0.4") + " SELECT path, score FROM hits")
def knn_threshold(spark, d):
    return vector.search_raw(derived.chunks(spark, d), _vector(spark, d), 10, threshold=0.4).select("path", "score")


_BLEND = " , b AS (SELECT h.path, h.score, n.depth, floor((h.score * 0.7 + coalesce(CASE WHEN n.depth <= 1 THEN 1.0 WHEN n.depth = 2 THEN 0.5 WHEN n.depth = 3 THEN 0.25 END, 0.0) * 0.3) * 1000 + 0.5) / 1000 AS combined FROM hits h LEFT JOIN nodes n ON n.path = h.path)"


@query(LINKS + _levels(3) + _knn(40, f"file_path <> {START}", 50) + _BLEND + " SELECT * FROM b ORDER BY combined DESC, score DESC, path LIMIT 20")
def anchor_blend(spark, d):
    hits = vector.search_raw(derived.chunks(spark, d), _vector(spark, d), 40, exclude=[_path(spark, d, 3)])
    return vector.blend(hits, _around(spark, d, 3), 0.3, 20).select("path", "score", "depth", "combined")


def _linked_names(spark, d):
    raw = links.outgoing(_notes(spark, d).where(F.col("path") == _path(spark, d, 3)))
    return raw.select(F.lower(tx.basename(F.col("raw"))).alias("name"))


_LINKED = f" lower(regexp_extract(path, '([^/]+)\\.md$', 1)) NOT IN (SELECT lower(regexp_extract(raw, '([^/]+)$', 1)) FROM links WHERE src = {START})"


@query(LINKS + _knn(15) + f" SELECT path, score FROM hits WHERE {_LINKED} ORDER BY score DESC, path LIMIT 5")
def suggest_links(spark, d):
    return vector.suggestions(vector.search_raw(derived.chunks(spark, d), _vector(spark, d), 15), _linked_names(spark, d)).select("path", "score")


@query(LINKS + _levels(2) + _knn(25, "true", 50) + _BLEND + f" SELECT path, score, depth, combined, depth IS NULL AS missing_link FROM b WHERE {_LINKED} ORDER BY combined DESC, score DESC, path LIMIT 5")
def suggest_links_graph(spark, d):
    hits = vector.suggestions(vector.search_raw(derived.chunks(spark, d), _vector(spark, d), 25), _linked_names(spark, d), 25)
    return vector.blend(hits, _around(spark, d, 2)).select("path", "score", "depth", "combined", F.col("depth").isNull().alias("missing_link"))


@query(LINKS + _levels(2) + _knn(10) + " SELECT path, score FROM hits WHERE path NOT IN (SELECT path FROM nodes)")
def unlinked_semantic(spark, d):
    return vector.unlinked(vector.search_raw(derived.chunks(spark, d), _vector(spark, d), 10), _around(spark, d, 2)).select("path", "score")


@query(LINKS + _levels(2) + _knn(10) + " SELECT coalesce(h.path, n.path) AS path, CASE WHEN h.path IS NOT NULL AND n.path IS NOT NULL THEN 'both' WHEN n.path IS NOT NULL THEN 'graph' ELSE 'semantic' END AS found FROM hits h FULL JOIN nodes n ON n.path = h.path")
def gap_analysis(spark, d):
    return reports.gap_analysis(vector.search_raw(derived.chunks(spark, d), _vector(spark, d), 10), _around(spark, d, 2))


@query(_knn(10) + " SELECT path, score, score > 0.8 AS likely FROM hits")
def duplicate_check(spark, d):
    return reports.duplicates(vector.search_raw(derived.chunks(spark, d), _vector(spark, d), 10)).select("path", "score", "likely")


@query(_knn(10) + " SELECT h.path, h.score, v.type, v.status FROM hits h JOIN vault v ON v.path = h.path")
def semantic_enriched(spark, d):
    hits = vector.search_raw(derived.chunks(spark, d), _vector(spark, d), 10)
    return with_meta(_notes(spark, d).join(F.broadcast(hits.select("path", "score")), "path")).select("path", "score", "meta.type", "meta.status")


# --- activity -------------------------------------------------------------------------------------

_LOG = "--own\nWITH log AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS \"timestamp\", md5(CAST(user_id AS VARCHAR)) AS session_id, event_type AS tool_name, props AS args_json FROM events)"


@query(_LOG + " SELECT * FROM log WHERE tool_name = 'click' ORDER BY \"timestamp\" DESC, id DESC LIMIT 50")
def activity_query(spark, d):
    return events.query(derived.activity(spark, d), tool="click")


@query(_LOG + " SELECT * FROM log WHERE starts_with(session_id, 'c') AND contains(lower(args_json), '\"k\": 1') AND \"timestamp\" >= '2024-01-05' ORDER BY \"timestamp\" DESC, id DESC LIMIT 100")
def activity_filtered(spark, d):
    return events.query(derived.activity(spark, d), 100, session="C", path='"K": 1', since="2024-01-05")


@query(_LOG + " SELECT id, \"timestamp\" FROM log WHERE NOT (tool_name = 'view' AND \"timestamp\" < '2024-01-15')")
def activity_clear_keep(spark, d):
    return events.kept_after_clear(derived.activity(spark, d), tool="view", before="2024-01-15").select("id", "timestamp")


@query(_LOG + " SELECT id, \"timestamp\", tool_name FROM log WHERE NOT (tool_name = 'view' AND \"timestamp\" < '2024-01-15') AND \"timestamp\" >= '2024-01-10' AND \"timestamp\" <= '2024-01-20T12' ORDER BY \"timestamp\" DESC, id DESC LIMIT 500")
def activity_log(spark, d):
    """The stored log: three appends, a clear, a merge; then the latest entries of ten days."""
    log, rows = events.ActivityLog(spark, shared_folder(spark, "activity")), derived.activity(spark, d)
    for i in range(3):
        log.append(rows.where(F.col("id") % 3 == i))
    log.clear(tool="view", before="2024-01-15")
    log.compact()
    return log.query(500, since="2024-01-10", before="2024-01-20T12").select("id", "timestamp", "tool_name")


# --- index, chunks, mutations ------------------------------------------------------------------------

_FILES = ", files AS (SELECT path, CASE WHEN doc_id % 5 = 2 THEN mtime_ms - 1 ELSE mtime_ms END AS mtime_ms FROM vault WHERE doc_id % 7 <> 3 UNION ALL SELECT 'gone/' || doc_id || '.md', 1 FROM vault WHERE doc_id % 9 = 4)"


def _files(spark, d):
    n = _notes(spark, d).withColumn("doc_id", F.regexp_extract("content", r"\n# Doc (\d+)\n", 1).cast("long"))
    own = n.where("doc_id % 7 <> 3").select("path", F.when(F.expr("doc_id % 5 = 2"), F.col("mtime_ms") - 1).otherwise(F.col("mtime_ms")).alias("mtime_ms"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    gone = n.where("doc_id % 9 = 4").select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(1).cast("long").alias("mtime_ms"), F.lit("x").alias("content_hash"))
    return own.unionByName(gone)


@query(_FILES + " SELECT coalesce(v.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'new' WHEN v.path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM vault v FULL JOIN files f ON f.path = v.path WHERE v.path IS NULL OR f.path IS NULL OR f.mtime_ms <> v.mtime_ms")
def index_diff(spark, d):
    return refresh.difference(_notes(spark, d), _files(spark, d))


@query(" SELECT path FROM vault WHERE doc_id % 7 = 3")
def index_to_embed(spark, d):
    return refresh.to_index(_notes(spark, d), _files(spark, d)).select("path")


@query(_FILES + " SELECT (SELECT count(*) FROM files) AS indexed_files, (SELECT max(mtime_ms) FROM files) AS last_sync, (SELECT count(*) FROM embeddings) AS total_chunks, (SELECT count(*) FROM vault) AS vault_files")
def index_stats(spark, d):
    return refresh.stats(_notes(spark, d), _files(spark, d).withColumnRenamed("mtime_ms", "updated_at"), derived.chunks(spark, d))


@query(" SELECT path, sha256(encode(content)) AS digest FROM vault")
def content_hash(spark, d):
    return _notes(spark, d).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


@query()
def note_chunks(spark, d):
    return chunking.note_chunks(_notes(spark, d))


#: White space of both engines' regular expressions.
_SPACE = r"[\p{Z}\x09-\x0D\x1C-\x1F\x{85}]"


@query(_SPLIT + f", b AS (SELECT path, trim(body, chr(10)) AS body FROM body) SELECT path, CASE WHEN length(body) <= 8000 THEN sha256(encode('# ' || regexp_extract(path, '([^/]+)\\.md$', 1) || chr(10) || chr(10) || body)) END AS only_chunk, sha256(encode(regexp_replace(body, '{_SPACE}', '', 'g'))) AS letters FROM b")
def short_note_chunks(spark, d):
    """Every note's chunk where it has one alone, and what its chunks hold besides white space."""
    name = F.concat(F.lit("# "), tx.basename(F.col("path")), F.lit("\n\n"))
    own = F.transform("c", lambda x: F.substr(x["text"], F.length(name) + 1))
    letters = F.regexp_replace(F.array_join(own, ""), _SPACE, "")
    chunks = _notes(spark, d).select("path", chunking.chunks_of(F.col("content"), F.col("path")).alias("c"))
    only = F.when(F.size("c") == 1, F.sha2(F.col("c")[0]["text"].cast("binary"), 256))
    return chunks.select("path", only.alias("only_chunk"), F.sha2(letters.cast("binary"), 256).alias("letters"))


@query()
def index_search(spark, d):
    """From notes through the index's tables to the notes nearest to a text."""
    chunks = refresh.indexed(_notes(spark, d))
    return vector.search_raw(chunks, [float(x) for x in vector.hash_embedder()(["## Links ### Topics"])[0]], 10).select("path", "score")


@query(" SELECT path, mtime_ms, sha256(encode(content)) AS content_hash FROM vault WHERE doc_id % 5 <> 0")
def index_log(spark, d):
    """The files of an index after five refreshes: an older state of all notes, changes, deletes, nothing, and a merge."""
    notes = _notes(spark, d).withColumn("doc", F.regexp_extract("content", r"\n# Doc (\d+)\n", 1).cast("long"))
    index = refresh.Index(spark, shared_folder(spark, "index"), vector.hash_embedder(8), 16)
    older = F.when(F.col("doc") % 3 == 0, F.concat("content", F.lit("\n\nolder"))).otherwise(F.col("content"))
    index.sync(notes.select("path", older.alias("content"), (F.col("mtime_ms") - 1).alias("mtime_ms"), "size").where("doc % 4 <> 1"))
    none = spark.createDataFrame([], "path string")
    index.apply(refresh.to_index(notes.where("doc % 4 = 1"), index.files()), none)
    index.sync(notes.where("doc % 5 <> 0"))
    index.sync(notes.where("doc % 5 <> 0"))
    index.compact()
    changed = notes.select("path", F.col("mtime_ms").alias("now"))
    return index.files().join(changed, "path").select("path", F.col("now").alias("mtime_ms"), "content_hash")


def _hashed(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


@query(f" SELECT path, {_HASH.format('''replace(content, '## Links' || chr(10), '## Links' || chr(10) || '- new' || chr(10))''')} AS digest FROM vault")
def append_after_heading(spark, d):
    return _hashed(_notes(spark, d).withColumn("content", mutate.appended(F.col("content"), "- new", "## Links", "after_heading")))


@query(f" SELECT path, {_HASH.format('''replace(content, '## Links' || chr(10), 'more' || chr(10) || '## Links' || chr(10))''')} AS digest FROM vault")
def append_end_of_section(spark, d):
    return _hashed(_notes(spark, d).withColumn("content", mutate.appended(F.col("content"), "more", "## Text", "end_of_section")))


@query(f" SELECT path, {_HASH.format('''replace(content, '### Topics' || chr(10), 'early' || chr(10) || '### Topics' || chr(10))''')} AS digest FROM vault")
def append_before_heading(spark, d):
    return _hashed(_notes(spark, d).withColumn("content", mutate.appended(F.col("content"), "early", "### Topics", "before_heading")))


@query(f" SELECT path, {_HASH.format('content || chr(10) || chr(35) || 1')} AS digest FROM vault")
def append_plain(spark, d):
    return _hashed(_notes(spark, d).withColumn("content", mutate.appended(F.col("content"), "#1", "## No such heading")))


@query(f" SELECT path, {_HASH.format('''replace(content, '### Topics', '### Themes $1')''')} AS digest FROM vault")
def edit_once(spark, d):
    return _hashed(_notes(spark, d).withColumn("content", mutate.edited(F.col("content"), "### Topics", "### Themes $1")))


@query(_SPLIT + " SELECT b.path, 'done' AS status, CAST(NULL AS VARCHAR) AS project, v.type, v.created, tag1 || ',' || tag2 AS tags, sha256(encode(body)) AS digest FROM body b JOIN vault v ON v.path = b.path")
def update_frontmatter(spark, d):
    new = _notes(spark, d).withColumn("content", mutate.updated_column(F.col("content"), {"status": "done", "project": None}))
    m = with_meta(new)
    return m.select("path", "meta.status", "meta.project", "meta.type", "meta.created", F.lower(F.array_join("meta.tags", ",")).alias("tags"), F.sha2(tx.body(F.col("content")).cast("binary"), 256).alias("digest"))


@query(LINKS + f" SELECT CASE WHEN v.path = {START} THEN '04-Archive/moved.md' ELSE v.path END AS path, {_HASH.format('''CASE WHEN v.path IN (SELECT src FROM resolved WHERE dst = (SELECT path FROM vault WHERE doc_id = 3) AND src <> dst) THEN replace(replace(content, '[[doc-3]]', '[[moved]]'), '[[' || (SELECT substr(path, 1, length(path) - 3) FROM vault WHERE doc_id = 3) || '|', '[[moved|') ELSE content END''')} AS digest FROM vault v")
def move_rewrite(spark, d):
    return _hashed(mutate.move(_notes(spark, d), _path(spark, d, 3), "04-Archive/moved.md"))


@query(LINKS + f" SELECT DISTINCT src AS path FROM resolved WHERE dst = {START} AND n_candidates = 1 AND src <> dst")
def trash_broken_referrers(spark, d):
    return mutate.trash_referrers(_notes(spark, d), _path(spark, d, 3))


def _wanted(spark, d):
    adr = with_meta(_notes(spark, d)).where("meta.type = 'adr'").select("path")
    each = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(t).alias("target"), F.lit(a).alias("annotation")) for i, (t, a) in enumerate([(_path(spark, d, 3), "see"), ("no/such", ""), (_path(spark, d, 3).removesuffix(".md"), "")])))
    return adr.select("path", F.explode(each).alias("w")).select("path", "w.*")


_ALREADY = "(link1 = 'doc-3' OR link2 = (SELECT substr(path, 1, length(path) - 3) FROM vault WHERE doc_id = 3))"


@query(f", a AS (SELECT path, coalesce({_ALREADY}, false) AS linked FROM vault WHERE type = 'adr') SELECT path, 0 AS pos, CASE WHEN linked THEN 'already linked' END AS reason, '- [[doc-3]] — see' AS entry FROM a UNION ALL SELECT path, 1, 'not found', NULL FROM a UNION ALL SELECT path, 2, 'already linked', '- [[doc-3]]' FROM a")
def add_links_decisions(spark, d):
    out = mutate.new_links(_notes(spark, d), _wanted(spark, d))
    return out.select("path", "pos", "reason", F.when(F.coalesce("reason", F.lit("")) != "not found", F.col("entry")).alias("entry"))


@query(f" SELECT path, {_HASH.format(f'''content || CASE WHEN type = 'adr' AND NOT coalesce({_ALREADY}, false) THEN chr(10) || '## Related' || chr(10) || '- [[doc-3]] — see' || chr(10) ELSE '' END''')} AS digest FROM vault")
def add_links(spark, d):
    return _hashed(mutate.add_links(_notes(spark, d), _wanted(spark, d)))


# --- reports -------------------------------------------------------------------------------------------


@query(" SELECT path, 'Doc ' || doc_id AS title, status, coalesce(priority, 'normal') AS priority FROM vault WHERE type = 'task' AND status IN ('active', 'pending')")
def open_tasks(spark, d):
    return reports.open_tasks(_notes(spark, d)).select("path", "title", "status", "priority")


_TOOLS = ("vault_update_frontmatter", "vault_edit", "vault_append", "vault_read")
_TOUCHED = ", log AS (SELECT v.path, e.ts, ['vault_update_frontmatter', 'vault_edit', 'vault_append', 'vault_read'][1 + CAST(event_id % 4 AS INTEGER)] AS tool FROM events e JOIN vault v ON v.doc_id = e.event_id % (SELECT count(*) FROM documents))"
_CHANGES = ", c AS (SELECT path, count(*) AS changes, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_change FROM log WHERE tool <> 'vault_read' AND strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') >= '2024-01-05' GROUP BY path)"


def _touched(spark, d):
    """The activity table as calls of tools on the vault's notes."""
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    paths = _notes(spark, d).select("path", F.regexp_extract("content", r"\n# Doc (\d+)\n", 1).cast("long").alias("doc"))
    log = derived.activity(spark, d).withColumn("doc", F.col("id") % n).join(paths, "doc")
    tool = F.element_at(F.array(*(F.lit(t) for t in _TOOLS)), (1 + F.col("id") % 4).cast("int"))
    return log.select("id", "timestamp", "session_id", tool.alias("tool_name"), F.to_json(F.struct("path")).alias("args_json"))


@query(_TOUCHED + _CHANGES + f" SELECT v.path, 'Doc ' || doc_id AS title, status, coalesce(priority, 'normal') AS priority, coalesce({_RANK}, 1) AS rank, coalesce(changes, 0) AS changes, last_change, CASE WHEN changes > 0 THEN 'recently updated' END AS hint FROM vault v LEFT JOIN c ON c.path = v.path WHERE type = 'task' AND status IN ('active', 'pending')")
def triage_hints(spark, d):
    return reports.triage(_notes(spark, d), _touched(spark, d), "2024-01-05")


_COMMITS = (
    ", tok AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) >= 4) AS w FROM benchmark), c AS (SELECT DISTINCT id, unnest(w) AS word FROM tok)"
    ", n AS (SELECT v.path, list_filter(regexp_extract_all(lower(v.text), '[a-z]+'), lambda x: length(x) >= 4)[1:2] AS w, v.doc_id, v.status, v.priority FROM vault v WHERE type = 'task' AND status IN ('active', 'pending'))"
    ", nw AS (SELECT doc_id, unnest(w) AS word FROM n)"
    ", h AS (SELECT nw.doc_id, max('2024-01-' || lpad(CAST(1 + c.id * 7 % 20 AS VARCHAR), 2, '0')) AS last_commit FROM nw JOIN c ON c.word = nw.word GROUP BY nw.doc_id)"
)


@query(_COMMITS + " SELECT '01-Projects/tasks/' || array_to_string(w, '-') || '-' || n.doc_id || '.md' AS path, status, last_commit, CASE WHEN last_commit IS NOT NULL THEN 'git commits' END AS commit_hint, CAST(NULL AS VARCHAR) AS hint FROM n LEFT JOIN h ON h.doc_id = n.doc_id")
def triage_commits(spark, d):
    """Open tasks named by words of their texts, with the benchmark's items as messages of commits."""
    words = F.slice(F.filter(F.regexp_extract_all(F.lower(F.regexp_extract("content", r"(?s)\n## Text\n\n(.*)\n\n## Links\n", 1)), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 4), 1, 2)
    name = F.concat(F.lit("01-Projects/tasks/"), F.array_join(words, "-"), F.lit("-"), F.regexp_extract("content", r"\n# Doc (\d+)\n", 1), F.lit(".md"))
    day = F.lpad((1 + F.col("item_id") * 7 % 20).cast("string"), 2, "0")
    commits = spark.read.parquet(f"{d}/benchmark.parquet").select(F.concat(F.lit("2024-01-"), day).alias("timestamp"), F.col("text").alias("message"))
    notes = _notes(spark, d).withColumn("path", name)
    return reports.triage(notes, spark.createDataFrame([], events.SCHEMA), "2024-01-01", commits).select("path", "status", "last_commit", "commit_hint", "hint")


_DECIDED = (
    ", decided AS (SELECT path, doc_id, content, status AS was, CASE doc_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'active' ELSE 'finished' END AS value, type FROM vault WHERE doc_id % 2 = 0"
    " UNION ALL SELECT path, doc_id, content, status, 'cancelled', type FROM vault WHERE doc_id % 20 = 0"
    " UNION ALL SELECT 'gone/' || doc_id || '.md', doc_id, NULL, NULL, 'done', NULL FROM vault WHERE doc_id % 50 = 3)"
    ", said AS (SELECT *, CASE WHEN content IS NULL THEN 'not found' WHEN doc_id % 20 = 0 THEN 'conflict' WHEN value = 'finished' AND type = 'task' THEN 'refused' WHEN value = was THEN 'unchanged' ELSE 'applied' END AS outcome FROM decided)"
)


@query(_DECIDED + " SELECT path, value, outcome, CASE WHEN outcome IN ('applied', 'unchanged') THEN value ELSE was END AS status, outcome IN ('applied', 'unchanged') AND value = 'done' AND NOT contains(content, '**Completed**') AS completed FROM said")
def batch_status(spark, d):
    """Statuses of half of all notes set in one pass: decided, decided twice, refused, unchanged, not found."""
    notes = _notes(spark, d).withColumn("doc", F.regexp_extract("content", r"\n# Doc (\d+)\n", 1).cast("long"))
    value = F.element_at(F.array(F.lit("done"), F.lit("active"), F.lit("finished")), (1 + F.col("doc") % 3).cast("int"))
    decided = notes.where("doc % 2 = 0").select("path", value.alias("status"))
    decided = decided.unionByName(notes.where("doc % 20 = 0").select("path", F.lit("cancelled").alias("status")))
    decided = decided.unionByName(notes.where("doc % 50 = 3").select(F.concat(F.lit("gone/"), "doc", F.lit(".md")).alias("path"), F.lit("done").alias("status")))
    changed, outcomes = batch.set_statuses(notes, decided, "2026-01-01")
    after = with_meta(batch.replaced(notes.select("path", "content"), changed)).select("path", "meta.status", F.col("content").endswith("\n\n**Completed**: 2026-01-01\n").alias("ended"))
    outcome = F.when(F.col("outcome").contains("is no status"), "refused").otherwise(F.col("outcome"))
    done = F.coalesce("ended", F.lit(False)) & (F.col("value") == "done")
    return outcomes.join(after, "path", "left").select("path", "value", outcome.alias("outcome"), "status", done.alias("completed"))


@query(" SELECT path, 0::BIGINT AS pos, 'applied' AS outcome, sha256(encode(replace(replace(content, '### Topics', '### Themes'), '## Links' || chr(10), CASE WHEN (length(content) - length(replace(content, '## Links' || chr(10), ''))) / 9 = 1 THEN '## Ways' || chr(10) ELSE '## Links' || chr(10) END))) AS digest FROM vault WHERE doc_id % 3 = 0 UNION ALL SELECT path, 1, CASE WHEN (length(content) - length(replace(content, '## Links' || chr(10), ''))) / 9 = 1 THEN 'applied' ELSE CAST(CAST((length(content) - length(replace(content, '## Links' || chr(10), ''))) / 9 AS BIGINT) AS VARCHAR) || ' matches' END, NULL FROM vault WHERE doc_id % 3 = 0 UNION ALL SELECT path, 2, '0 matches', NULL FROM vault WHERE doc_id % 3 = 0")
def batch_edit(spark, d):
    """Three replacements in a third of all notes; the last asks for what the first took away."""
    notes = _notes(spark, d)
    third = notes.where(F.regexp_extract("content", r"\n# Doc (\d+)\n", 1).cast("long") % 3 == 0)
    asked = F.array(*(F.struct(F.lit(i).cast("long").alias("pos"), F.lit(a).alias("old"), F.lit(b).alias("new")) for i, (a, b) in enumerate([("### Topics", "### Themes"), ("## Links\n", "## Ways\n"), ("### Topics", "x")])))
    changed, said = batch.replace_texts(notes, third.select("path", F.inline(asked)))
    digests = changed.select("path", F.lit(0).cast("long").alias("pos"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    return said.join(digests, ["path", "pos"], "left")


@query(" SELECT 'doc-' || doc_id AS name, '05-Templates/doc-' || doc_id || '.md' AS path, 'Doc ' || doc_id AS description, type FROM vault WHERE type = 'adr'")
def template_scan(spark, d):
    adr = F.col("content").contains("\ntype: adr\n")
    name = F.concat(F.lit("05-Templates/doc-"), F.regexp_extract("content", r"\n# Doc (\d+)\n", 1), F.lit(".md"))
    made = _notes(spark, d).withColumn("path", F.when(adr, name).otherwise(F.col("path")))
    return catalog.templates(made).select("name", "path", "description", "meta.type")


@query(" SELECT path, type, status, priority, created, due FROM vault")
def light_frontmatter(spark, d):
    m = catalog.light_fields(F.col("content"))
    return _notes(spark, d).select("path", *(F.try_element_at(m, F.lit(k)).alias(k) for k in ("type", "status", "priority", "created", "due")))


@query(" SELECT count(*) AS n_notes, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM vault WHERE starts_with(path, '03-Resources/')")
def folder_size(spark, d):
    return catalog.folder_size(_notes(spark, d), "03-Resources")


@query(" SELECT path, 'Doc ' || doc_id AS title, doc_id = 30 AS likely FROM vault WHERE contains(lower(content), 'doc 30') ORDER BY path LIMIT 10")
def duplicate_check_by_text(spark, d):
    return reports.duplicates_by_text(_notes(spark, d), "DOC 30")


def _project_notes(spark, d):
    """The notes of two sources (one has the logs, the other the tasks) laid out as a project."""
    n = with_meta(_notes(spark, d)).where(F.col("path").rlike("^01-Projects/src[35]/"))
    name = tx.basename(F.col("path"))
    doc = F.regexp_extract(name, r"(\d+)", 1).cast("long")
    first = n.agg(F.min(doc)).first()[0]
    log = n.where((F.col("meta.type") == "devlog") & (doc != first)).agg(F.min(doc)).first()[0]
    place = F.when(doc == first, "_index.md").when(doc == log, "development/devlog.md").when(F.col("meta.type") == "task", F.concat(F.lit("tasks/"), name, F.lit(".md"))).otherwise(F.concat(F.lit("notes/"), name, F.lit(".md")))
    return n.withColumn("path", F.concat(F.lit("01-Projects/src3/"), place)).select("path", "content", "mtime_ms", "size")


@query(" , p AS (SELECT *, min(doc_id) OVER () AS first FROM vault WHERE regexp_matches(path, '^01-Projects/src[35]/')) SELECT 'index' AS part, '01-Projects/src3/_index.md' AS path, length(content) AS n FROM p WHERE doc_id = first UNION ALL SELECT 'devlog', '01-Projects/src3/development/devlog.md', NULL FROM p WHERE doc_id = (SELECT min(doc_id) FROM p WHERE type = 'devlog' AND doc_id <> first) UNION ALL SELECT 'task', '01-Projects/src3/tasks/doc-' || doc_id || '.md', NULL FROM p WHERE doc_id <> first AND type = 'task' AND status IN ('active', 'pending')")
def project_context(spark, d):
    c = reports.project_context(_project_notes(spark, d), "01-Projects/src3")
    return c.select("part", "path", F.when(F.col("part") == "index", F.length("text")).cast("long").alias("n"))


_BRIEF = _SPLIT + r""" , p AS (SELECT b.*, v.type, v.status, v.priority, min(b.doc_id) OVER () AS first FROM body b JOIN vault v ON v.path = b.path WHERE regexp_matches(b.path, '^01-Projects/src[35]/'))
, l AS (SELECT *, list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(x, '#')) AS told FROM p WHERE doc_id <> first AND type = 'task' AND status IN ('active', 'pending'))
, c AS (SELECT 'index' AS part, content AS words FROM p WHERE doc_id = first UNION ALL SELECT 'devlog', front || chr(10) || substr(body, strpos(body, '## Text' || chr(10))) FROM p WHERE doc_id = (SELECT min(doc_id) FROM p WHERE type = 'devlog' AND doc_id <> first)
  UNION ALL SELECT 'task', '- Doc ' || doc_id || ' (status: ' || status || ', priority: ' || coalesce(priority, 'normal') || ')' || chr(10) || array_to_string(list_transform(told[1:2], lambda x: trim(x)), chr(10)) FROM l)
"""


def _brief(spark, d):
    return reports.project_context(_project_notes(spark, d), "01-Projects/src3")


@query(_BRIEF + " SELECT part, sha256(encode(words)) AS digest FROM c")
def project_context_texts(spark, d):
    return _brief(spark, d).select("part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query(_BRIEF + _FILES + " SELECT bool_or(part = 'index') AS has_index, bool_or(part = 'devlog') AS has_devlog, count(*) FILTER (part = 'task') AS tasks, CAST(sum(length(words)) AS BIGINT) AS n_chars, (SELECT count(*) FROM files) AS indexed, (SELECT count(*) FROM vault) AS notes FROM c")
def session_summary(spark, d):
    return reports.session_summary(_brief(spark, d), _files(spark, d), _notes(spark, d))


@query(" SELECT DISTINCT '01-Projects/' || split_part(path, '/', 2) AS project FROM vault WHERE lower(split_part(path, '/', 2)) = 'src3' AND starts_with(path, '01-Projects/')")
def resolve_project(spark, d):
    return reports.resolve_project(_notes(spark, d), "SRC3")


@query(" SELECT path, type, status, priority, created, due, project FROM vault")
def frontmatter_parse(spark, d):
    return _notes(spark, d).select("path", parsed(F.col("content")).alias("m")).select("path", *(f"m.{k}" for k in ("type", "status", "priority", "created", "due", "project")))
