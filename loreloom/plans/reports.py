"""Reports that combine several operators: project context, triage, gap analysis, duplicates, link audit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frontmatter import with_meta
from ..functions.text import basename, body, lines, trimmed
from ..operators import links
from ..operators.catalog import PRIORITY, inside
from ..operators.reading import tail_sections
from ..sources.shared import cut

OPEN = ("active", "pending")
PROJECTS = "01-Projects/"


#: Tools that change a note.
WRITERS = ("vault_update_frontmatter", "vault_edit", "vault_append")
#: Tasks over which the names that share a word are dealt.
SALTS = 8


def annotated_project(text: str) -> str | None:
    """The vault folder that a line ``# PKM: folder`` of a project's notes names."""
    found = re.search(r"^#\s+PKM:[^\S\n]*(\S.*)$", text, re.M)
    if found is None:
        return None
    folder = found[1].strip().strip("/")
    if ".." in folder.split("/"):
        raise ValueError(f"outside the vault: {folder}")
    return folder


def resolve_project(notes: DataFrame, name: str, annotations: str = "") -> DataFrame:
    """project: the folders below 01-Projects with this name, in any case; without any, the annotated folder if it has notes."""
    own = _named_project(notes, name)
    folder = annotated_project(annotations)
    if folder is None or not own.isEmpty():
        return own
    return notes.where(F.col("path").startswith(folder + "/")).select(F.lit(folder).alias("project")).distinct()


def _named_project(notes: DataFrame, name: str) -> DataFrame:
    folder = F.split("path", "/")[1]
    inside = notes.where(F.col("path").startswith(PROJECTS) & (F.size(F.split("path", "/")) > 2))
    return inside.where(F.lower(folder) == name.lower()).select(F.concat(F.lit(PROJECTS), folder).alias("project")).distinct()


def title(content: Column, path: Column) -> Column:
    """The first ``# `` line of the body, else the name."""
    first = F.try_element_at(F.filter(lines(trimmed(body(content))), lambda x: x.startswith("# ")), F.lit(1))
    return F.coalesce(trimmed(F.substr(first, F.lit(3))), basename(path))


def open_tasks(notes: DataFrame, tasks_only: bool = True) -> DataFrame:
    """path, title, status, priority (normal if missing), description (two lines) of the tasks still to do."""
    c = F.col("content")
    some = F.filter(lines(trimmed(body(c))), lambda x: (trimmed(x) != "") & ~x.startswith("#"))
    description = F.array_join(F.transform(F.slice(some, 1, 2), trimmed), "\n")
    rows = with_meta(notes).where(F.col("meta.status").isin(*OPEN))
    rows = rows.where(F.col("meta.type") == "task") if tasks_only else rows
    return rows.select("path", title(c, F.col("path")).alias("title"), "meta.status", F.coalesce("meta.priority", F.lit("normal")).alias("priority"), description.alias("description"))


def project_context(notes: DataFrame, project: str) -> DataFrame:
    """part (index, devlog, task), path, text of a project: its index, its last three log sections, its open tasks."""
    root, c = project.rstrip("/") + "/", F.col("content")
    index = notes.where(F.col("path") == root + "_index.md").select(F.lit("index").alias("part"), "path", c.alias("text"))
    by_session = c.rlike(r"(?m)^## Sessions\s*$")
    recent = F.when(by_session, tail_sections(c, 3, 3)).otherwise(tail_sections(c, 3, 2))
    devlog = notes.where(F.col("path") == root + "development/devlog.md").select(F.lit("devlog").alias("part"), "path", recent.alias("text"))
    tasks = open_tasks(notes.where(F.col("path").startswith(root + "tasks/")), tasks_only=False)
    line = F.concat(F.lit("- "), "title", F.lit(" (status: "), "status", F.lit(", priority: "), "priority", F.lit(")\n"), "description")
    return index.unionByName(devlog).unionByName(tasks.select(F.lit("task").alias("part"), "path", line.alias("text")))


def session_summary(context: DataFrame, files: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: which parts a context has, its characters, and how much of the vault is indexed."""
    has = [F.coalesce(F.bool_or(F.col("part") == p), F.lit(False)).alias(f"has_{p}") for p in ("index", "devlog")]
    one = context.agg(*has, F.count_if(F.col("part") == "task").alias("tasks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))
    return one.crossJoin(F.broadcast(files.agg(F.count("*").alias("indexed")))).crossJoin(F.broadcast(notes.agg(F.count("*").alias("notes"))))  # single rows


def commit_hints(paths: DataFrame, commits: DataFrame) -> DataFrame:
    """path and last_commit of the notes of whose names a word appears in a commit's message.

    commits: timestamp, message. A name's words are its runs of letters, digits and ``_`` of four
    characters or more, without regard to case; a message has those that are runs of its own. The
    messages of a word are reduced to the latest before anything is joined, and words in very
    many names are dealt over ``SALTS`` tasks, so neither makes pairs of names and messages.
    """
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) >= 4)))
    named = paths.select("path", words(basename(F.col("path"))).alias("word"))
    said = commits.select("timestamp", words(F.col("message")).alias("word")).groupBy("word").agg(F.max("timestamp").alias("last_commit"))
    met = said.join(named.select("word").distinct(), "word", "left_semi")
    salted = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = named.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["word", "salt"]).groupBy("path").agg(F.max("last_commit").alias("last_commit"))


def triage(notes: DataFrame, log: DataFrame, since: str = "", commits: DataFrame | None = None) -> DataFrame:
    """Open tasks, active before pending, urgent first, with the changes that the log has of their paths since then.

    path, title, status, priority, rank, changes, last_change, hint (recently updated, or null);
    with commits (timestamp, message) also last_commit since then and commit_hint (git commits, or null).
    """
    rank = F.coalesce(*(F.when(F.col("priority") == k, v) for k, v in PRIORITY.items()))
    own = log.where(F.col("tool_name").isin(*WRITERS) & (F.col("timestamp") >= since)).select(F.get_json_object("args_json", "$.path").alias("path"), "timestamp")
    changes = own.where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("changes"), F.max("timestamp").alias("last_change"))
    rows = open_tasks(notes).withColumn("rank", rank).join(changes, "path", "left")
    more = []
    if commits is not None:
        rows = rows.join(commit_hints(notes.select("path"), commits.where(F.col("timestamp") >= since)), "path", "left")
        more = ["last_commit", F.when(F.col("last_commit").isNotNull(), "git commits").alias("commit_hint")]
    hint = F.when(F.col("changes") > 0, "recently updated").alias("hint")
    return rows.select("path", "title", "status", "priority", "rank", F.coalesce("changes", F.lit(0)).alias("changes"), "last_change", hint, *more).orderBy((F.col("status") == "pending").asc(), F.desc("rank"), "path")


def gap_analysis(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """path and where it was found: both, graph or semantic."""
    a, b = hits.select("path", F.lit(1).alias("s")), nodes.select("path", F.lit(1).alias("g"))
    found = F.when(F.col("s").isNotNull() & F.col("g").isNotNull(), "both").when(F.col("g").isNotNull(), "graph").otherwise("semantic")
    return a.join(b, "path", "full_outer").select("path", found.alias("found"))


def duplicates(hits: DataFrame, flag: float = 0.8) -> DataFrame:
    """Hits with whether they are likely the same as what was searched for."""
    return hits.withColumn("likely", F.col("score") > flag)


def duplicates_by_text(notes: DataFrame, text: str, folder: str | None = None, limit: int = 10) -> DataFrame:
    """Where there is no index: the first notes that contain a title, and whether it is theirs (likely)."""
    found = inside(notes, folder).where(F.lower("content").contains(text.lower())).orderBy("path").limit(limit)
    own = title(F.col("content"), F.col("path"))
    return found.select("path", own.alias("title"), (F.lower(own) == text.lower()).alias("likely"))


def link_audit(notes: DataFrame, folder: str | None = None) -> DataFrame:
    """check and its number of findings."""
    every = cut(links.factored(notes))  # read, extracted and resolved once
    degree = links.degrees(notes, folder, every)
    found = {"orphans": links.orphans(degree), "weak": links.weak(degree), "broken": links.broken(every), "ambiguous": links.ambiguous(every)}
    rows = [df.agg(F.count("*").alias("findings")).select(F.lit(c).alias("check"), "findings") for c, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
