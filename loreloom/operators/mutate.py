"""Changes to notes as pure functions from a notes frame to a notes frame.

Each takes all notes and touches those it names; nothing is written. Sinks decide when a
result replaces the old table.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions.text import basename, link_target, occurrences, wikilinks
from .catalog import DANGEROUS, PRIORITY, TASK_STATUS
from .links import edges, linking_to
from .reading import after_heading, heading_start, section_end

PROTECTED = ("type", "created", "tags")
KEY = re.compile(r"[a-zA-Z][a-zA-Z0-9_-]*")
POSITIONS = ("before_heading", "after_heading", "end_of_section")


def _at(notes: DataFrame, path: str, content: Column) -> DataFrame:
    """The notes with another content at one path."""
    return notes.withColumn("content", F.when(F.col("path") == path, content).otherwise(F.col("content")))


def _one(notes: DataFrame, path: str) -> str:
    row = notes.where(F.col("path") == path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return row.content


def inserted(content: Column, text: str, place: Column) -> Column:
    """The text put before a 1-based place."""
    return F.concat(F.substr(content, F.lit(1), place - 1), F.lit(text), F.substr(content, place))


def appended(content: Column, text: str, heading: str | None = None, position: str | None = None) -> Column:
    """The content with the text added; null where a position asks for a heading that isn't there."""
    if not text:
        raise ValueError("nothing to append")
    if position and not heading:
        raise ValueError("a position needs a heading")
    if position and position not in POSITIONS:
        raise ValueError(f"position: {position}")
    plain = F.concat(content, F.lit("\n" + text))
    if not heading:
        return plain
    there = heading_start(content, heading) > 0
    if position == "before_heading":
        out = inserted(content, text + "\n", heading_start(content, heading))
    elif position == "end_of_section":
        end = section_end(content, heading)
        before = F.substr(content, F.lit(1), end - 1)
        gap = F.when((F.length(before) > 0) & ~before.endswith("\n"), "\n").otherwise("")
        out = F.concat(before, gap, F.lit(text + "\n"), F.substr(content, end))
    else:
        out = inserted(content, text + "\n", after_heading(content, heading))
    return F.when(there, out) if position else F.when(there, out).otherwise(plain)


def append(notes: DataFrame, path: str, text: str, heading: str | None = None, position: str | None = None) -> DataFrame:
    new = appended(F.col("content"), text, heading, position)
    row = notes.where(F.col("path") == path).select(new.isNull().alias("missing")).first()
    if row is None:
        raise FileNotFoundError(path)
    if row.missing:
        raise ValueError(f"{path} has no heading that begins with {heading!r}")
    return _at(notes, path, new)


def edited(content: Column, old: str, new: str) -> Column:
    """The content with the only occurrence of a literal replaced; unchanged if there are none or several."""
    return F.when(occurrences(content, old) == 1, F.replace(content, F.lit(old), F.lit(new))).otherwise(content)


def edit(notes: DataFrame, path: str, old: str, new: str) -> DataFrame:
    if not old:
        raise ValueError("nothing to look for")
    row = notes.where(F.col("path") == path).select(occurrences(F.col("content"), old).alias("n")).first()
    if row is None:
        raise FileNotFoundError(path)
    if row.n != 1:
        raise ValueError(f"{row.n} matches for old_string in {path}; exactly one is needed")
    return _at(notes, path, edited(F.col("content"), old, new))


def check_enum(key: str, value: object, type_: str | None) -> None:
    allowed = {"status": TASK_STATUS, "priority": tuple(PRIORITY)}.get(key)
    if type_ == "task" and allowed and value not in allowed:
        raise ValueError(f"{value!r} is no {key} of a task; one of {', '.join(allowed)} is")


def checked_fields(fields: dict) -> None:
    """Refuse keys and deletions that no front matter may have."""
    for key, value in fields.items():
        if key in DANGEROUS or not KEY.fullmatch(key):
            raise ValueError(f"{key!r} can't be a front matter key")
        if value is None and key in PROTECTED:
            raise ValueError(f"{key!r} has to stay")
        if key == "tags" and value is not None and not (isinstance(value, list) and any(value)):
            raise ValueError("tags: a list with at least one tag is needed")


def updated(content: str, fields: dict) -> str:
    """The content with front matter fields set, or removed where the value is None; the body stays as it is."""
    end = content.find("\n---", 3) if content.startswith("---") else -1
    if end < 0:
        raise ValueError("the note has no front matter")
    own = fm.load(content[4:end]) or {}
    type_ = fields.get("type") or own.get("type")
    for key, value in fields.items():
        if value is None:
            own.pop(key, None)
        else:
            if key != "type":
                check_enum(key, value, type_)
            own[key] = value
    return "---\n" + (fm.dump(own) if own else "{}\n") + "---" + content[end + 4 :]


def updated_column(content: Column, fields: dict) -> Column:
    """updated() over a column, in Arrow batches; contents without front matter stay as they are."""
    checked_fields(fields)

    @F.pandas_udf("string")
    def change(s: pd.Series) -> pd.Series:
        return s.map(lambda c: updated(c, fields) if c is not None and c.startswith("---") and c.find("\n---", 3) >= 0 else c)

    return change(content)


def update_frontmatter(notes: DataFrame, path: str, fields: dict) -> DataFrame:
    checked_fields(fields)
    return _at(notes, path, F.lit(updated(_one(notes, path), fields)))


def relinked(content: Column, old: str, new: str) -> Column:
    """Links to ``old`` (its path or its name, in any case) lead to ``new``; fragments and aliases stay."""
    path = old.removesuffix(".md")
    names = "|".join(dict.fromkeys([re.escape(path), re.escape(path.rsplit("/", 1)[-1])]))
    pattern = rf"(?iu)\[\[\s*(?:{names})(?-i:\.md)?\s*(#[^\]|]*)?(\|[^\]]*)?\]\]"
    return F.regexp_replace(content, pattern, "[[" + new.replace("\\", "\\\\").replace("$", "\\$") + "$1$2]]")


def move(notes: DataFrame, old_path: str, new_path: str, update_links: bool = True) -> DataFrame:
    """The notes with one moved, and the links of the notes that link to it rewritten.

    The new link text is the new name, or the new path without .md where another note has that name.
    """
    _one(notes, old_path)
    if not notes.where(F.col("path") == new_path).isEmpty():
        raise FileExistsError(new_path)
    content = F.col("content")
    if update_links:
        name = new_path.removesuffix(".md").rsplit("/", 1)[-1]
        others = notes.where((F.lower(basename(F.col("path"))) == name.lower()) & (F.col("path") != old_path))
        target = name if others.isEmpty() else new_path.removesuffix(".md")
        referrers = linking_to(notes, old_path).withColumn("refers", F.lit(True))
        notes = notes.join(referrers, "path", "left")
        content = F.when(F.col("refers"), relinked(content, old_path, target)).otherwise(content)
    return notes.withColumn("content", content).withColumn("path", F.when(F.col("path") == old_path, new_path).otherwise(F.col("path"))).drop("refers")


def trash(notes: DataFrame, path: str, trashed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes without the one at ``path``, the trash (path, content) with it, and the paths whose links break.

    The trash keeps folders; a name that is taken gets a time stamp.
    """
    row = notes.where(F.col("path") == path).select("path", "content")
    if row.isEmpty():
        raise FileNotFoundError(path)
    name = f".trash/{path}"
    if trashed is not None and not trashed.where(F.col("path") == name).isEmpty():
        name = f"{name.removesuffix('.md')}-{datetime.now(UTC):%Y%m%dT%H%M%S%f}.md"
    gone = row.select(F.lit(name).alias("path"), "content")
    return notes.where(F.col("path") != path), gone if trashed is None else trashed.unionByName(gone), trash_referrers(notes, path)


def trash_referrers(notes: DataFrame, path: str) -> DataFrame:
    """Paths of the notes that have a link which leads to ``path`` and nowhere else."""
    only = edges(notes).where((F.col("dst") == path) & (F.col("n_candidates") == 1) & (F.col("src") != path))
    return only.select(F.col("src").alias("path")).distinct()


def new_links(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, pos, target, reason (null: to be added), entry for wanted links (path, pos, target, annotation).

    A target must be a note's path, with or without .md, and its name not yet linked from
    the note, nor wanted there at an earlier pos. Names that several notes have show as paths.
    """
    own = wanted.withColumn("file", F.when(F.col("target").endswith(".md"), F.col("target")).otherwise(F.concat("target", F.lit(".md"))))
    own = own.withColumn("name", F.lower(basename(F.col("target"))))
    names = notes.select(F.col("path").alias("file"), F.lower(basename(F.col("path"))).alias("name"))
    many = names.groupBy("name").agg(F.count("*").alias("same_name"))
    linked = notes.join(wanted.select("path").distinct(), "path", "left_semi").select("path", F.explode(wikilinks(F.col("content"))).alias("raw"))
    linked = linked.select("path", F.lower(basename(link_target(F.col("raw")))).alias("name"), F.lit(True).alias("linked")).distinct()
    joined = own.join(names.select("file", F.lit(True).alias("there")), "file", "left").join(many, "name", "left").join(linked, ["path", "name"], "left")
    first = joined.where("there").groupBy("path", "name").agg(F.min("pos").alias("first"))
    joined = joined.join(first, ["path", "name"], "left")
    reason = F.when(F.col("there").isNull(), "not found").when(F.col("linked") | (F.col("pos") > F.col("first")), "already linked")
    shown = F.when(F.col("same_name") > 1, F.substring_index("file", ".md", 1)).otherwise(F.element_at(F.split(F.substr(F.col("file"), F.lit(1), F.length("file") - 3), "/"), -1))
    note = F.when(F.coalesce("annotation", F.lit("")) != "", F.concat(F.lit(" — "), "annotation")).otherwise("")
    return joined.select("path", "pos", "target", reason.alias("reason"), F.concat(F.lit("- [["), shown, F.lit("]]"), note).alias("entry"))


def add_links(notes: DataFrame, wanted: DataFrame, section: str = "## Related", create_section: bool = True) -> DataFrame:
    """The notes with the wanted links (path, pos, target, annotation) put at the end of a section."""
    fresh = new_links(notes, wanted).where("reason IS NULL")
    lists = fresh.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("e"))  # as many as a caller asks for
    text = lists.select("path", F.concat(F.array_join(F.transform("e", lambda x: x["entry"]), "\n"), F.lit("\n")).alias("entries"))
    joined = notes.join(text, "path", "left")
    gap = F.when(F.col("content").endswith("\n"), "\n").otherwise("\n\n")
    there = heading_start(F.col("content"), section) > 0
    base = F.when(there | F.lit(not create_section), F.col("content")).otherwise(F.concat("content", gap, F.lit(section + "\n")))
    joined = joined.withColumn("base", base)
    end = section_end(F.col("base"), section)
    new = F.concat(F.substr(F.col("base"), F.lit(1), end - 1), F.col("entries"), F.substr(F.col("base"), end))
    ready = F.col("entries").isNotNull() & (heading_start(F.col("base"), section) > 0)
    return joined.withColumn("content", F.when(ready, new).otherwise(F.col("content"))).select(*notes.columns)


def rendered(template: str, title: str | None = None, variables: dict[str, str] | None = None, fields: dict | None = None, now: datetime | None = None) -> str:
    """A template's text with its date, title and own variables put in, and front matter texts and tags set."""
    now = now or datetime.now(UTC)
    dates = {"YYYY-MM-DD": f"{now:%Y-%m-%d}", "YYYY-MM-DD HH:mm": f"{now:%Y-%m-%d %H:%M}", "YYYY": f"{now:%Y}", "MM": f"{now:%m}", "DD": f"{now:%d}"}
    known = {"tp.file.title": title or "Untitled"} | (variables or {})

    def fill(m: re.Match) -> str:
        name = m[1].strip()
        if date := re.fullmatch(r'tp\.date\.now\("([^"]+)"\)', name):
            return dates.get(date[1], dates["YYYY-MM-DD"])
        return str(known.get(name, m[0]))

    out = re.sub(r"<%([^%]+)%>", fill, template)
    texts = {k: v for k, v in (fields or {}).items() if isinstance(v, str) or k == "tags" and isinstance(v, list)}
    if texts and out.startswith("---") and out.find("\n---", 3) >= 0:
        checked_fields(texts)
        out = updated(out, texts)
    return out


def write(notes: DataFrame, path: str, content: str) -> DataFrame:
    """The notes and a new one; an existing path is an error, as is front matter that isn't valid."""
    own = fm.load(content[4 : content.find("\n---", 3)]) if content.startswith("---") and content.find("\n---", 3) >= 0 else None
    missing = ["front matter"] if own is None else [k for k in PROTECTED if not own.get(k)]
    if left := re.findall(r"<%[^%]+%>", content):
        missing += left
    if missing:
        raise ValueError(f"{path}: missing or unsubstituted: {', '.join(missing)}")
    if not isinstance(own["tags"], list) or not any(own["tags"]):
        raise ValueError(f"{path}: tags: a list with at least one tag is needed")
    check_enum("status", own.get("status", "pending"), own["type"])
    check_enum("priority", own.get("priority", "normal"), own["type"])
    if not notes.where(F.col("path") == path).isEmpty():
        raise FileExistsError(path)
    now = int(datetime.now(UTC).timestamp() * 1000)
    row = notes.sparkSession.createDataFrame([(path, content, now, len(content.encode()))], "path string, content string, mtime_ms long, size long")
    return notes.unionByName(row.select(*notes.columns))
