"""Changes of many notes at once: a table of edits, one keyed join, and an outcome for every edit.

Only notes that an edit names are joined, parsed and returned; ``replaced`` puts them into a
table of all notes, and an index takes them as they are. Nothing comes to the driver.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import frontmatter as fm
from ..sources.shared import cut
from .catalog import DANGEROUS
from .mutate import KEY, PROTECTED, appended, check_enum

#: How people write a status, and the status.
STATUS = {"done": "done", "active": "active", "pending": "pending", "cancel": "cancelled", "cancelled": "cancelled"}
COMPLETED = "**Completed**"
APPLIED, UNCHANGED, CONFLICT, MISSING, HELD = "applied", "unchanged", "conflict", "not found", "held back"

_OUTCOME = T.StructType([T.StructField("field", T.StringType()), T.StructField("outcome", T.StringType())])
_EDITED = T.StructType([T.StructField("content", T.StringType()), T.StructField("outcomes", T.ArrayType(_OUTCOME))])


def refusal(field: Column, value: Column, items: Column) -> Column:
    """Why no note may have this edit; null where some may."""
    bad = field.isNull() | field.isin(*DANGEROUS) | ~field.rlike(f"^(?:{KEY.pattern})\\z")
    nothing = value.isNull() & items.isNull()
    tags = (field == "tags") & ~F.coalesce(F.exists(items, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(False))
    return F.when(bad, "no key of front matter").when(nothing & field.isin(*PROTECTED), "has to stay").when(~nothing & tags, "needs a list of tags")


def _set(content: str, edits: list[dict]) -> tuple[str, list[tuple[str, str]]]:
    """The content with all of a note's fields set, or as it is where one can't be; an outcome a field."""
    end = content.find("\n---", 3) if content.startswith("---") else -1
    if end < 0:
        return content, [(e["field"], "no front matter") for e in edits]
    own = fm.load(content[4:end]) or {}
    wanted = {e["field"]: e["value"] if e["items"] is None else list(e["items"]) for e in edits}
    type_, found, changed = wanted.get("type") or own.get("type"), {}, False
    for key, value in wanted.items():
        same = key not in own if value is None else key in own and own[key] == value
        found[key] = UNCHANGED if same else APPLIED
        try:
            if value is not None and key != "type":
                check_enum(key, value, type_)
        except ValueError as e:
            found[key] = str(e)
    if any(x not in (UNCHANGED, APPLIED) for x in found.values()):
        return content, [(k, HELD if x in (UNCHANGED, APPLIED) else x) for k, x in found.items()]
    for key, value in wanted.items():
        if found[key] == APPLIED:
            changed = True
            own.pop(key, None) if value is None else own.update({key: value})
    text = "---\n" + (fm.dump(own) if own else "{}\n") + "---" + content[end + 4 :] if changed else content
    return text, list(found.items())


@F.pandas_udf(_EDITED)
def _fields_set(content: pd.Series, edits: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if c is None else _set(c, list(e)) for c, e in zip(content, edits, strict=True)]
    return pd.DataFrame({"content": [c for c, _ in rows], "outcomes": [o and [{"field": f, "outcome": x} for f, x in o] for _, o in rows]}, index=content.index)


_fields_set = _fields_set.asNondeterministic()  # else it runs once a use


def _plan(edits: DataFrame) -> DataFrame:
    """Distinct edits (path, field, value, items, n) with ``reason`` where one can't be tried, and ``held`` where another of its note can't."""
    own = edits if "items" in edits.columns else edits.withColumn("items", F.lit(None).cast("array<string>"))
    own = own.groupBy("path", "field", "value", "items").agg(F.count("*").alias("n"))
    ways = own.groupBy("path", "field").agg(F.count("*").alias("ways"))
    own = own.join(ways.withColumnsRenamed({"path": "p", "field": "f"}), F.col("path").eqNullSafe(F.col("p")) & F.col("field").eqNullSafe(F.col("f"))).drop("p", "f")
    reason = F.coalesce(refusal(F.col("field"), F.col("value"), F.col("items")), F.when(F.col("ways") > 1, CONFLICT), F.when(F.col("path").isNull(), MISSING))
    own = own.withColumn("reason", reason).drop("ways")
    bad = own.where("reason IS NOT NULL").select("path").distinct().withColumn("held", F.lit(True))
    return own.join(bad, "path", "left")


def set_fields(notes: DataFrame, edits: DataFrame, completed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Front matter fields of many notes set or removed in one pass: changed notes (path, content), and an outcome for each edit.

    edits: path, field, value, and optionally items (a list in place of a value); both null
    remove the field. Repeated edits count once (``n`` says how often). The edits of a note stand
    or fall together, like one call. Outcomes: applied; unchanged (the field has that value);
    conflict (a field of a note is given different values: none is taken); not found; no front matter;
    why a field can't have the value; held back (another edit of the note can't be made).
    With ``completed``, a date, notes that get the status done and don't hold **Completed** yet have
    it appended. Null paths and paths without a note are not found; no edits give empty tables.
    """
    plan = cut(_plan(edits))
    ready = plan.where("reason IS NULL AND held IS NULL").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("field", "value", "items"))).alias("edits"))  # one entry a field of a note
    old = notes.select("path", F.col("content").alias("before")).where("before IS NOT NULL")
    made = ready.join(old, "path").withColumn("made", _fields_set(F.col("before"), F.col("edits")))
    content = F.col("made.content")
    if completed is not None:
        ends = F.exists("edits", lambda e: (e["field"] == "status") & (e["value"] == "done")) & F.forall("made.outcomes", lambda o: o["outcome"].isin(APPLIED, UNCHANGED))
        content = F.when(ends & ~content.contains(COMPLETED), appended(content, f"\n{COMPLETED}: {completed}\n")).otherwise(content)
    made = cut(made.select("path", content.alias("content"), (content != F.col("before")).alias("changed"), "made.outcomes"))
    said = made.select("path", F.explode("outcomes").alias("o")).select("path", "o.field", "o.outcome")
    there = old.select("path").join(plan.select("path").distinct(), "path", "left_semi").withColumn("there", F.lit(True))
    outcome = F.coalesce(F.when(F.col("there").isNull(), MISSING), "reason", F.when(F.col("held"), HELD), "outcome")
    outcomes = plan.join(said, ["path", "field"], "left").join(there, "path", "left")
    return made.where("changed").select("path", "content"), outcomes.select("path", "field", "value", "items", "n", outcome.alias("outcome"))


def replaced(notes: DataFrame, changed: DataFrame) -> DataFrame:
    """All notes, with the changed contents in place."""
    new = changed.select("path", F.col("content").alias("new"))
    return notes.join(new, "path", "left").withColumn("content", F.coalesce("new", "content")).select(*notes.columns)


def replace_texts(notes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Literal replacements in many notes: changed notes (path, content), and path, pos, outcome of each edit.

    edits: path, pos, old, new. A note's edits apply in the order of pos, each to what the ones
    before it left, and only where ``old`` occurs exactly once then; else its outcome says how
    often. Edits with equal path and pos apply in the order of their texts. An empty ``old`` is found 0 times; a null ``new`` counts as empty.
    """
    own = edits.select("path", "pos", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))
    lists = own.where("path IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "old", "new"))).alias("edits"))  # one after the other on one text
    old = notes.select("path", F.col("content").alias("before")).where("before IS NOT NULL")
    start = F.struct(F.col("before").alias("content"), F.array().cast("array<struct<pos:bigint,outcome:string>>").alias("said"))

    def step(state: Column, e: Column) -> Column:
        text = state["content"]
        n = F.when(e["old"] == "", 0).otherwise(F.floor((F.length(text) - F.length(F.replace(text, e["old"], F.lit("")))) / F.length(e["old"])))
        outcome = F.when(n == 1, APPLIED).otherwise(F.concat(n.cast("string"), F.lit(" matches")))
        said = F.struct(e["pos"].cast("long").alias("pos"), outcome.alias("outcome"))
        return F.struct(F.when(n == 1, F.replace(text, e["old"], e["new"])).otherwise(text).alias("content"), F.concat(state["said"], F.array(said)).alias("said"))

    made = cut(lists.join(old, "path").select("path", "before", F.aggregate("edits", start, step).alias("made")).select("path", "made.content", "made.said", (F.col("made.content") != F.col("before")).alias("changed")))
    said = made.select("path", F.explode("said").alias("s")).select("path", "s.pos", "s.outcome")
    lost = own.join(made.select("path"), "path", "left_anti").select("path", F.col("pos").cast("long").alias("pos"), F.lit(MISSING).alias("outcome"))
    return made.where("changed").select("path", "content"), said.unionByName(lost)


def decisions(text: str) -> tuple[dict[int, str], list[str]]:
    """Numbers and the status decided for them, from words like ``1,2 done | 4 cancel``; and the parts that say nothing."""
    found: dict[int, str] = {}
    left = []
    for part in filter(None, (p.strip() for p in text.split("|"))):
        own = re.fullmatch(r"([\d,\s]+?)\s*([a-zA-Z]+)", part)
        if own and own[2].lower() in STATUS:
            found |= {int(n): STATUS[own[2].lower()] for n in re.findall(r"\d+", own[1])}
        elif part.lower() != "skip":
            left.append(part)
    return found, left


def set_statuses(notes: DataFrame, decided: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """set_fields for decisions (path, status), with the day of completion for those that are done."""
    return set_fields(notes, decided.select("path", F.lit("status").alias("field"), F.col("status").alias("value")), today)
