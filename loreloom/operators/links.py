"""The link graph: extraction, resolution, degrees and the health report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, link_target, wikilinks
from ..sources.shared import cut
from .catalog import inside


def outgoing(notes: DataFrame) -> DataFrame:
    """src, pos, raw, cleaned: every link occurrence."""
    found = notes.select(F.col("path").alias("src"), F.posexplode(wikilinks(F.col("content"))).alias("pos", "raw"))
    return found.withColumn("cleaned", link_target(F.col("raw")))


def _want() -> Column:
    """The path that a link's target means if there is such a note."""
    return F.when(F.col("cleaned").endswith(".md"), F.col("cleaned")).otherwise(F.concat("cleaned", F.lit(".md")))


def _own() -> Column:
    """A key that no name equals, as names have no slash."""
    return F.concat_ws("|", F.lit("/"), "src", F.col("pos").cast("string"))


def note_name(path: str = "path") -> Column:
    return F.lower(basename(F.col(path)))


def factored(notes: DataFrame, scope: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """src, pos, raw, cleaned, exact, name, n_candidates: one row a link, however many notes it leads to.

    A link leads to the note ``exact``, or else to all notes with ``name``, or nowhere (both null,
    no candidate). What counts links or notes works on these rows; m links to a name of n
    notes never become m * n rows unless their paths are asked for (``resolve``). Both joins have one
    row a key on their right, so a key that many links share is split at runtime on the left;
    links without a key have values of their own. ``links`` are those of ``outgoing``, where they are stored.
    """
    found = outgoing(notes if scope is None else scope) if links is None else links
    links = found.select("src", "pos", "raw", "cleaned", _want().alias("want"))
    rows = links.join(notes.select(F.col("path").alias("want"), F.col("path").alias("exact")), "want", "left").drop("want")
    rows = rows.withColumn("key", F.when(F.col("exact").isNull() & (F.col("cleaned") != ""), note_name("cleaned")).otherwise(_own()))
    names = notes.select(note_name().alias("name")).groupBy("name").agg(F.count("*").cast("int").alias("same_name"))
    n = F.when(F.col("exact").isNotNull(), 1).otherwise(F.coalesce("same_name", F.lit(0)))
    return rows.join(names, F.col("key") == F.col("name"), "left").select("src", "pos", "raw", "cleaned", "exact", "name", n.alias("n_candidates"))


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """src, pos, raw, cleaned, dst, ambiguous, n_candidates: a row for each path that a link leads to.

    A target is a path (with or without .md, case-sensitive), else the name of any notes
    (case-insensitive, whatever its folder). A link that leads nowhere keeps one row with a
    null dst. Two equi-joins; unresolved keys get values of their own, so none piles up.
    """
    names = notes.select(F.col("path").alias("dst"), note_name().alias("name"))
    counted = names.join(names.groupBy("name").agg(F.count("*").cast("int").alias("same_name")), "name")
    exact = links.withColumn("want", _want()).join(names.select(F.col("dst").alias("exact")), F.col("want") == F.col("exact"), "left").drop("want")
    open_ = F.when(F.col("exact").isNull() & (F.col("cleaned") != ""), note_name("cleaned")).otherwise(_own())
    both = exact.withColumn("key", open_).join(counted, F.col("key") == F.col("name"), "left")
    n = F.when(F.col("exact").isNotNull(), 1).otherwise(F.coalesce("same_name", F.lit(0)))
    return both.select("src", "pos", "raw", "cleaned", F.coalesce("exact", "dst").alias("dst"), (n > 1).alias("ambiguous"), n.alias("n_candidates"))


def edges(notes: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Resolved links of the notes (or of those in ``scope``) against all notes."""
    return resolve(outgoing(notes if scope is None else scope), notes)


def incoming(resolved: DataFrame) -> DataFrame:
    """dst and each distinct src that links to it; links to oneself don't count."""
    return resolved.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).select("dst", "src").distinct()


def linking_to(notes: DataFrame, path: str) -> DataFrame:
    """Paths of the notes with a link that leads to ``path``, itself left out."""
    links = factored(notes).where(F.col("src") != path)
    named = notes.where(F.col("path") == path).select(note_name().alias("name"))
    return links.where(F.col("exact") == path).select("src").unionByName(links.join(named, "name").select("src")).distinct().select(F.col("src").alias("path"))


def note_links(notes: DataFrame, path: str, direction: str = "both") -> DataFrame:
    """direction, target: raw outgoing targets of a note as often as they occur, and the notes that link to it."""
    parts = []
    if direction in ("outgoing", "both"):
        parts.append(outgoing(notes.where(F.col("path") == path)).select(F.lit("outgoing").alias("direction"), F.col("raw").alias("target")))
    if direction in ("incoming", "both"):
        parts.append(linking_to(notes, path).select(F.lit("incoming").alias("direction"), F.col("path").alias("target")))
    if not parts:
        raise ValueError(f"direction: {direction}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def degrees(notes: DataFrame, folder: str | None = None, links: DataFrame | None = None) -> DataFrame:
    """path, outgoing (link occurrences that lead somewhere), incoming (distinct other notes); links: all factored ones, if known.

    Who links to a name is counted once a name. A note adds the notes that link to its path
    and not to its name, and takes itself off where it links to its own name.
    """
    links = cut(factored(notes)) if links is None else links
    out = links.where("n_candidates > 0").groupBy(F.col("src").alias("path")).agg(F.count("*").alias("outgoing"))
    by_name = links.where("name IS NOT NULL").select("src", "name").distinct()
    by_path = links.where("exact <> src").select("src", F.col("exact").alias("path"), note_name("exact").alias("name")).distinct()
    also = by_path.join(by_name, ["src", "name"], "left_anti").groupBy("path").agg(F.count("*").alias("by_path"))
    own = by_name.where(F.col("name") == note_name("src")).select(F.col("src").alias("path"), F.lit(1).alias("own"))
    all_ = inside(notes, folder).select("path", note_name().alias("name"))
    all_ = all_.join(by_name.groupBy("name").agg(F.count("*").alias("by_name")), "name", "left")
    all_ = all_.join(out, "path", "left").join(also, "path", "left").join(own, "path", "left")
    none = F.lit(0)
    back = F.coalesce("by_name", none) + F.coalesce("by_path", none) - F.coalesce("own", none)
    return all_.select("path", F.coalesce("outgoing", none).alias("outgoing"), back.alias("incoming"))


def orphans(degree: DataFrame) -> DataFrame:
    """Notes that no link joins with another."""
    return degree.where("outgoing = 0 AND incoming = 0").select("path")


def weak(degree: DataFrame) -> DataFrame:
    """Notes with a single link in all."""
    return degree.where("outgoing + incoming = 1").select("path", "outgoing", "incoming")


def broken(links: DataFrame) -> DataFrame:
    """src, pos, raw of links that lead nowhere; targets with an extension other than md name attachments and don't count."""
    extension = F.regexp_extract("raw", r"\.([^.]*)$", 1)
    attachment = F.col("raw").contains(".") & (F.lower(extension) != "md")
    return links.where((F.col("n_candidates") == 0) & ~attachment).select("src", "pos", "raw")


def ambiguous(links: DataFrame) -> DataFrame:
    """raw, its number of candidates, and the first note (in path order) that has the link."""
    first = F.struct("src", "pos")
    return links.where("n_candidates > 1").groupBy("raw").agg(F.min(first).alias("first"), F.max("n_candidates").alias("n_candidates")).select("raw", F.col("first.src").alias("src"), "n_candidates")


CHECKS = ("orphans", "broken", "weak", "ambiguous")


def health(notes: DataFrame, folder: str | None = None, checks: tuple[str, ...] = CHECKS, limit: int = 20) -> dict[str, DataFrame]:
    """The chosen checks of the notes in a folder, each with at most ``limit`` rows; links from anywhere count."""
    scope = inside(notes, folder)
    every = cut(factored(notes))  # once for all checks
    degree, links = degrees(notes, folder, every), every.join(scope.select(F.col("path").alias("src")), "src", "left_semi")
    made = {
        "orphans": lambda: orphans(degree).orderBy("path"),
        "broken": lambda: broken(links).orderBy("src", "pos"),
        "weak": lambda: weak(degree).orderBy("path"),
        "ambiguous": lambda: ambiguous(links).orderBy("src", "raw"),
    }
    return {c: made[c]().limit(limit) for c in checks}
