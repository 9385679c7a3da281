"""Neighbourhoods: level by level from a start, at most five levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .catalog import positive
from .links import factored, note_name

MAX_DEPTH = 5
#: A step's place among those of its note: outgoing before incoming, then by the link's position, then by path.
STEP = "struct<kind:int,pos:int,path:string>"


def _steps(frontier: DataFrame, links: DataFrame, names: DataFrame, direction: str) -> DataFrame:
    """path, trail, ambiguous: one step from the frontier (path, name, trail) along or against factored links.

    Links to one name are reduced to the first of them before its notes are looked up, and
    notes of one name before the links to it are: no pair of both is ever a row.
    """

    def step(path: str, kind: int, pos: str, ambiguous: str) -> list:
        place = F.struct(F.lit(kind).alias("kind"), F.expr(pos).cast("int").alias("pos"), F.col(path).alias("path"))
        return [F.col(path).alias("path"), F.concat("trail", F.array(place)).alias("trail"), F.expr(ambiguous).alias("ambiguous")]

    parts = []
    if direction in ("outgoing", "both"):
        out = frontier.select(F.col("path").alias("src"), "trail").join(links, "src")
        first = out.where("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("trail", "pos", (F.col("n_candidates") > 1).alias("ambiguous"))).alias("first"))
        named = first.select("name", "first.trail", "first.pos", "first.ambiguous").join(names, "name")
        parts += [out.where("exact IS NOT NULL").select(*step("exact", 0, "pos", "false")), named.select(*step("path", 0, "pos", "ambiguous"))]
    if direction in ("incoming", "both"):
        to_path = frontier.select(F.col("path").alias("exact"), "trail").join(links, "exact")
        to_name = frontier.groupBy("name").agg(F.min("trail").alias("trail")).join(links, "name")
        parts += [x.select(*step("src", 1, "0", "false")) for x in (to_path, to_name)]
    if not parts:
        raise ValueError(f"direction: {direction}")
    return reduce(DataFrame.unionByName, parts)


def _touched(frontier: DataFrame, links: DataFrame, names: DataFrame, direction: str) -> DataFrame:
    """Factored links that leave the frontier (path, name) or may lead to it, of stored links (with ``target``, the name they ask for).

    A link leads only to notes with the name that it asks for, so only these are looked at.
    """
    parts = []
    if direction in ("outgoing", "both"):
        parts.append(links.join(frontier.select(F.col("path").alias("src")).distinct(), "src", "left_semi").select(*links.columns))
    if direction in ("incoming", "both"):
        parts.append(links.join(frontier.select(F.col("name").alias("target")).distinct(), "target", "left_semi").select(*links.columns))
    if not parts:
        raise ValueError(f"direction: {direction}")
    own = cut(reduce(DataFrame.unionByName, parts).dropDuplicates(["src", "pos"]))
    near = names.join(own.select(F.col("target").alias("name")).distinct(), "name", "left_semi")
    return cut(_factored(near, own))


def _factored(notes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    return factored(notes, links=links).where("n_candidates > 0").select("src", "pos", "exact", "name", "n_candidates")


def neighborhood(notes: DataFrame, starts: DataFrame, depth: object = 2, direction: str = "both", ordered: bool = False, stored: DataFrame | None = None) -> DataFrame:
    """path, depth, ambiguous: each note within reach of ``starts`` (path), by its least depth.

    A note is ambiguous if the first step that reaches it is one of an ambiguous link. First
    is what a walk with a queue meets first: the steps of its level's notes in their order.
    A note's ``trail`` (with ``ordered``) is that step after its note's trail: five steps at most,
    so trails order a level without gathering it.

    The factored links are written to shared storage once. Each level joins its frontier with
    them before anything is aggregated (a small one is broadcast by its written size) and drops
    what was seen before; levels are written too, so that plans don't nest.

    With ``stored``, the links of a LinkIndex, no content is read (notes: path) and each level resolves
    only the links that leave its frontier or may lead to it.
    """
    links = cut(_factored(notes)) if stored is None else None
    names = cut(notes.select("path", note_name().alias("name")))
    none = F.array().cast(f"array<{STEP}>")
    seen = starts.select("path", F.lit(0).alias("depth"), F.lit(False).alias("ambiguous"), none.alias("trail")).distinct()
    frontier = seen
    for level in range(1, min(positive(depth, 2), MAX_DEPTH) + 1):
        at = frontier.select("path", note_name().alias("name"), "trail")
        steps = _steps(at, _touched(at, stored, names, direction) if links is None else links, names, direction)
        first = steps.groupBy("path").agg(F.min(F.struct("trail", "ambiguous")).alias("first"))
        reached = first.select("path", F.lit(level).alias("depth"), "first.ambiguous", "first.trail")
        frontier = cut(reached.join(seen.select("path"), "path", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen if ordered else seen.drop("trail")


def depth_groups(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth").agg(F.count("*").alias("n_notes"))


def proximity(depth) -> object:
    """1 up to one step, then 0.5 and 0.25; 0 further out or outside the graph."""
    return F.when(depth <= 1, 1.0).when(depth == 2, 0.5).when(depth == 3, 0.25).otherwise(0.0)
