"""Listing, recency, search and metadata queries over notes (path, content, mtime_ms, size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frontmatter import with_meta
from ..functions.text import basename, body, front_yaml, glob, inline_tags, lines, tag_matches, trimmed

DANGEROUS = frozenset({"__proto__", "constructor", "prototype"})
PRIORITY = {"low": 0, "normal": 1, "high": 2, "urgent": 3}
TASK_STATUS = ("pending", "active", "done", "cancelled")


def positive(value: object, fallback: int) -> int:
    """A whole number of at least 1, or the fallback."""
    try:
        n = int(float(value))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return fallback
    return n if n >= 1 else fallback


def inside(notes: DataFrame, folder: str | None) -> DataFrame:
    """Notes below a folder; the vault source takes the prefix over and lists nothing else."""
    return notes.where(F.col("path").startswith(folder.rstrip("/") + "/")) if folder else notes


def list_directory(notes: DataFrame, path: str = "", recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """entry and is_dir: the files and folders right below ``path``; recursive adds all notes below its folders.

    The pattern holds for the files right below only. Names that start with a dot are left out.
    """
    prefix = path.rstrip("/") + "/" if path else ""
    rest = F.substr(F.col("path"), F.lit(len(prefix) + 1))
    below = notes.where(F.col("path").startswith(prefix)).select("path", rest.alias("rest"))
    below = below.where(~F.col("rest").startswith("."))
    direct = ~F.col("rest").contains("/")
    files = below.where(direct & (glob(F.col("rest"), pattern) if pattern else F.lit(True))).select(F.col("path").alias("entry"), F.lit(False).alias("is_dir"))
    top = F.concat(F.lit(prefix), F.split("rest", "/")[0])
    folders = below.where(~direct).select(top.alias("entry"), F.lit(True).alias("is_dir")).distinct()
    out = files.unionByName(folders)
    return out.unionByName(below.where(~direct).select(F.col("path").alias("entry"), F.lit(False).alias("is_dir"))) if recursive else out


def recent(notes: DataFrame, limit: object = 10, folder: str | None = None) -> DataFrame:
    """path, mtime_ms and day (UTC) of the notes changed last."""
    day = F.date_format(F.timestamp_millis("mtime_ms"), "yyyy-MM-dd")
    return inside(notes, folder).select("path", "mtime_ms", day.alias("day")).orderBy(F.desc("mtime_ms"), "path").limit(positive(limit, 10))


def search(notes: DataFrame, query: str, folder: str | None = None, limit: object = 10) -> DataFrame:
    """path and up to three matching lines (line_no, line cut to 100 characters) of the first notes that contain a text."""
    q = query.lower()
    hits = inside(notes, folder).where(F.lower("content").contains(q)).select("path", "content").orderBy("path").limit(positive(limit, 10))
    numbered = F.transform(lines(F.col("content")), lambda x, i: F.struct((i + 1).alias("line_no"), trimmed(x).alias("line"), F.lower(x).contains(q).alias("hit")))
    three = F.slice(F.filter(numbered, lambda x: x["hit"]), 1, 3)
    return hits.select("path", F.explode_outer(three).alias("x")).select("path", "x.line_no", F.substring("x.line", 1, 100).alias("line"))


def matches(type: str | None = None, status: str | None = None, tags: list[str] | None = None, tags_any: list[str] | None = None, created_after: str | None = None, created_before: str | None = None, custom_fields: dict[str, str | None] | None = None) -> Column:
    """The conjunction of metadata conditions over ``meta``.

    A missing created passes created_before and fails created_after; a custom field equals
    "" or null where it is missing; notes without metadata match nothing unless no condition is set.
    """
    meta, wanted = F.col("meta"), []
    own = F.transform(F.coalesce(meta["tags"], F.array().cast("array<string>")), F.lower)
    if type:
        wanted.append(meta["type"] == type)
    if status:
        wanted.append(meta["status"] == status)
    if tags:
        wanted.append(F.size(F.array_except(F.array(*(F.lit(t.lower()) for t in tags)), own)) == 0)
    if tags_any:
        wanted.append(F.arrays_overlap(own, F.array(*(F.lit(t.lower()) for t in tags_any))))
    if created_after:
        wanted.append(F.coalesce(meta["created"], F.lit("")) >= created_after)
    if created_before:
        wanted.append(F.coalesce(meta["created"], F.lit("")) <= created_before)
    for key, value in (custom_fields or {}).items():
        if key not in DANGEROUS:
            field = F.try_element_at(meta["fields"], F.lit(key))
            wanted.append(field.isNull() if value is None else F.coalesce(field, F.lit("")) == str(value))
    out = F.lit(True)
    for w in wanted:
        out &= F.coalesce(w, F.lit(False))
    return out & meta.isNotNull() if wanted else out


def sort_keys(field: str, descending: bool = False, nulls_last: bool | None = None) -> list[Column]:
    """Sort columns for a metadata field: known priorities by rank, other values by Unicode collation, then path.

    Ascending puts missing values last. Descending reverses that too, unless nulls_last says otherwise.
    """
    value = F.try_element_at(F.col("meta")["fields"], F.lit(field))
    last = (not descending) if nulls_last is None else nulls_last
    keys = [value.isNull().asc() if last else value.isNull().desc()]
    if field == "priority":
        rank = F.lit(None).cast("int")
        for name, n in PRIORITY.items():
            rank = F.when(value == name, n).otherwise(rank)
        keys.append(rank.desc_nulls_last() if descending else rank.asc_nulls_last())
    text = F.collate(value, "UNICODE")
    return [*keys, text.desc() if descending else text.asc(), F.col("path").asc()]


def _likely(notes: DataFrame, filters: dict) -> DataFrame:
    """Without notes whose front matter can't have a wanted type or status, so that YAML is parsed of fewer.

    A value without white space stands in the front matter as it is, unless by an escape.
    """
    front = front_yaml(F.col("content"))
    for value in (filters.get("type"), filters.get("status")):
        if value and not any(c.isspace() for c in value):
            notes = notes.where(front.contains(value) | front.contains("\\"))
    return notes


def query(notes: DataFrame, folder: str | None = None, limit: object = 50, sort_by: str | None = None, sort_order: str = "asc", nulls_last: bool | None = None, **filters) -> DataFrame:
    """path and meta of the notes that match; the limit comes after the sort, or in path order without one.

    limit=None returns all of them, without an exchange unless sorted.
    """
    found = with_meta(_likely(inside(notes, folder), filters)).where(matches(**filters)).select("path", "meta")
    if limit is None and not sort_by:
        return found
    keys = sort_keys(sort_by, sort_order == "desc", nulls_last) if sort_by else [F.col("path").asc()]
    found = found.orderBy(*keys)
    return found if limit is None else found.limit(positive(limit, 50))


def note_tags(notes: DataFrame, include_inline: bool = False) -> DataFrame:
    """path and tag, each tag of a note once, lower-case."""
    none = F.array().cast("array<string>")
    own = F.transform(F.coalesce(F.col("meta")["tags"], none), F.lower)
    both = F.array_union(own, inline_tags(F.col("content"))) if include_inline else own
    return with_meta(notes).select("path", F.explode(F.array_distinct(both)).alias("tag"))


def tag_counts(notes: DataFrame, folder: str | None = None, pattern: str | None = None, include_inline: bool = False) -> DataFrame:
    """tag and the number of notes that have it, most frequent first."""
    tags = note_tags(inside(notes, folder), include_inline).where(tag_matches(F.col("tag"), pattern))
    return tags.groupBy("tag").agg(F.count("*").alias("n_notes")).orderBy(F.desc("n_notes"), F.collate("tag", "UNICODE"))


def notes_with_tags(notes: DataFrame, folder: str | None = None, include_inline: bool = False) -> DataFrame:
    """One row: how many notes have any tag, whatever pattern a listing has."""
    return note_tags(inside(notes, folder), include_inline).agg(F.count_distinct("path").alias("n_notes"))


def folder_size(notes: DataFrame, folder: str | None = None) -> DataFrame:
    """One row: notes and their bytes in a folder."""
    return inside(notes, folder).agg(F.count("*").alias("n_notes"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


TEMPLATES, SHOWN = "05-Templates/", 80


def templates(notes: DataFrame) -> DataFrame:
    """name, path, description, meta of the notes right below 05-Templates.

    The description is that of the front matter, else the first heading or other line
    behind it that isn't a comment, else what the type says.
    """
    rest = F.substr(F.col("path"), F.lit(len(TEMPLATES) + 1))
    own = with_meta(notes.where(F.col("path").startswith(TEMPLATES) & ~rest.contains("/")))
    text = F.filter(F.transform(lines(body(F.substr(F.col("content"), F.lit(1)))), trimmed), lambda x: (x != "") & (x != "---") & ~x.startswith("<!--"))
    first = F.try_element_at(text, F.lit(1))
    heading = F.regexp_replace(F.regexp_replace(first, r"^#+\s*", ""), "<%[^%]+%>", "{title}")
    line = F.substring(F.when(first.startswith("#"), heading).otherwise(first), 1, SHOWN)
    usual = F.concat(F.lit("Template for "), F.coalesce(F.col("meta")["type"], F.lit("notes")))
    given = F.try_element_at(F.col("meta")["fields"], F.lit("description"))
    return own.select(basename(F.col("path")).alias("name"), "path", F.coalesce(F.nullif(given, F.lit("")), line, usual).alias("description"), "meta")


def light_fields(content: Column) -> Column:
    """Front matter as a map of its ``key: value`` lines, with no YAML: enough for flat fields, and native."""
    flat = F.filter(lines(front_yaml(content)), lambda x: x.rlike(r"^\w+:\s*\S"))
    pair = F.transform(flat, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1), trimmed(F.regexp_extract(x, r"^\w+:\s*(.+)$", 1))))
    keys = F.transform(pair, lambda p: p["col1"])
    last = F.filter(pair, lambda p, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), p["col1"]) == 0)  # of a repeated key
    return F.map_from_entries(last)


def validation(notes: DataFrame) -> DataFrame:
    """path, valid and the errors of each note: required fields, task enumerations, template variables left."""
    meta = F.col("meta")
    blank = lambda c: c.isNull() | (c == "")
    left = F.size(F.regexp_extract_all("content", F.lit(r"(<%[^%]+%>)"), F.lit(1))) > 0
    task = F.coalesce(meta["type"] == "task", F.lit(False))
    checks = [
        (meta.isNull(), "no front matter"),
        (meta.isNotNull() & blank(meta["fields"]["type"]), "type is missing"),
        (meta.isNotNull() & blank(meta["created"]), "created is missing"),
        (meta.isNotNull() & (F.coalesce(F.size(meta["tags"]), F.lit(0)) == 0), "tags are missing"),
        (task & ~F.coalesce(meta["status"].isin(*TASK_STATUS), F.lit(True)), "unknown status"),
        (task & ~F.coalesce(meta["priority"].isin(*PRIORITY), F.lit(True)), "unknown priority"),
        (left, "template variables left"),
    ]
    errors = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in checks)))
    return with_meta(notes).select("path", errors.alias("errors")).withColumn("valid", F.size("errors") == 0)
