"""Reading parts of notes: sections, tails, chunks, line ranges and the structural peek."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frontmatter import with_meta
from ..functions.text import READ_CAP, READ_CHUNK, READ_REDIRECT, body, bound, front_block, heading_level, level_of, lines, trimmed

MODES = ("heading", "tail", "tail_sections", "chunk", "lines")


def heading_start(content: Column, heading: str) -> Column:
    """1-based place of the first line that begins with ``heading``; 0 if there is none."""
    return F.when(content.startswith(heading), 1).otherwise(F.locate("\n" + heading, content) + F.when(F.locate("\n" + heading, content) > 0, 1).otherwise(0))


def after_heading(content: Column, heading: str) -> Column:
    """1-based place of the line after the heading's."""
    start = heading_start(content, heading)
    end = F.position(F.lit("\n"), content, start)
    return F.when(end == 0, F.length(content) + 1).otherwise(end + 1)


def section_end(content: Column, heading: str) -> Column:
    """1-based place behind the section: the next heading of the same or a higher level, or the end."""
    after = after_heading(content, heading)
    level = level_of(heading)
    if not level:
        return F.length(content) + 1
    next_ = F.regexp_instr(F.substr(content, after), F.lit(rf"(?m)^#{{1,{level}}}[^\S\n]"))
    return F.when(next_ == 0, F.length(content) + 1).otherwise(after + next_ - 1)


def section(content: Column, heading: str) -> Column:
    """The section from its heading line on; null without that heading."""
    start = heading_start(content, heading)
    return F.when(start > 0, F.substr(content, start, section_end(content, heading) - start))


def tail_lines(content: Column, n: int) -> Column:
    """Front matter and the last n lines of the body."""
    parts = lines(body(content))
    last = F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n)
    front = front_block(content)
    return F.concat(front, F.when(F.length(front) > 0, "\n").otherwise(""), F.array_join(last, "\n"))


def tail_sections(content: Column, n: int, level: int = 2) -> Column:
    """Front matter and the body from the n-th last heading of exactly that level; all without such a heading."""
    front = front_block(content)

    def cut(parts: Column) -> Column:
        marked = F.transform(parts, lambda x, i: F.when(x.rlike(rf"^#{{{level}}}\s"), i + 1))
        at = F.array_compact(marked)
        return bound(at, lambda at: F.when(F.size(at) > 0, F.array_join(F.slice(parts, F.element_at(at, F.greatest(F.size(at) - n + 1, F.lit(1))), F.size(parts)), "\n")))

    rest = bound(lines(body(content)), cut)
    return F.coalesce(F.concat(front, F.when(F.length(front) > 0, "\n").otherwise(""), rest), content)


def char_chunk(content: Column, k: int, size: int = READ_CHUNK) -> Column:
    """The k-th slice of ``size`` characters; null out of range."""
    return F.when((F.length(content) > (k - 1) * size) & F.lit(k >= 1), F.substring(content, (k - 1) * size + 1, size))


def line_range(content: Column, start: float, end: float) -> Column:
    """Lines start to end, both included and counted from 1; the end is clamped. Null if start is out of range."""
    parts = lines(content)
    a, b = int(start), int(end)
    return F.when((F.size(parts) >= a) & F.lit(1 <= a <= b), F.array_join(F.slice(parts, a, b - a + 1), "\n"))


def read(notes: DataFrame, heading: str | None = None, tail: int | None = None, tail_sections_: int | None = None, section_level: int = 2, chunk: int | None = None, lines_: tuple[float, float] | None = None, force: bool = False) -> DataFrame:
    """path, redirected (a peek stands for the text), text.

    At most one mode. Whole notes over 80 000 characters redirect unless forced, and over
    400 000 always.
    """
    given = [m for m, v in zip(MODES, (heading, tail, tail_sections_, chunk, lines_), strict=True) if v is not None]
    if len(given) > 1:
        raise ValueError(f"only one of {', '.join(MODES)} at a time, not {', '.join(given)}")
    c = F.col("content")
    text = c
    if heading:
        text = section(c, heading)
    elif tail:
        text = tail_lines(c, int(tail))
    elif tail_sections_:
        text = tail_sections(c, int(tail_sections_), section_level)
    elif chunk is not None:
        text = char_chunk(c, int(chunk))
    elif lines_ is not None:
        text = line_range(c, *lines_)
    large = F.lit(not given and not force) & (F.length(c) > READ_REDIRECT) | F.lit(force) & (F.length(c) > READ_CAP)
    return notes.select("path", large.alias("redirected"), F.when(~large, text).alias("text"))


def _first_line(content: Column, parts: Column) -> Column:
    """Number of the line behind the front matter's closing line, which must be the fence alone."""
    close = F.array_position(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), "---")
    return F.when(content.startswith("---") & (close > 0), close + 2).otherwise(1).cast("int")


def outline(content: Column) -> Column:
    """heading, level, line_no, char_count of the heading lines behind the front matter."""

    def found(parts: Column) -> Column:
        levels = F.transform(parts, lambda x, i: F.when(x.startswith("#"), F.struct(x.alias("heading"), heading_level(x).alias("level"), (i + 1).alias("line_no"))))
        return bound(_first_line(content, parts), lambda first: F.filter(F.array_compact(levels), lambda h: (h["level"] > 0) & (h["line_no"] >= first)))

    def measured(parts: Column, heads: Column) -> Column:
        def one(h: Column) -> Column:
            later = F.filter(heads, lambda x: (x["line_no"] > h["line_no"]) & (x["level"] <= h["level"]))
            end = F.coalesce(F.try_element_at(later, F.lit(1))["line_no"], F.size(parts) + 1)
            size = bound(end, lambda e: F.length(F.array_join(F.slice(parts, h["line_no"], e - h["line_no"]), "\n")))
            return F.struct(h["heading"].alias("heading"), h["level"].alias("level"), h["line_no"].alias("line_no"), size.alias("char_count"))

        return F.transform(heads, one)

    return bound(lines(content), lambda parts: bound(found(parts), lambda heads: measured(parts, heads)))


def preview(content: Column) -> Column:
    """The first ten lines of the body that aren't blank, cut to 200 characters."""

    def ten(parts: Column) -> Column:
        some = F.filter(F.slice(parts, _first_line(content, parts), F.size(parts)), lambda x: trimmed(x) != "")
        return F.transform(F.slice(some, 1, 10), lambda x: F.when(F.length(x) > 200, F.concat(F.substring(x, 1, 200), F.lit("..."))).otherwise(x))

    return F.array_join(bound(lines(content), ten), "\n")


def peek(notes: DataFrame) -> DataFrame:
    """path, size_chars, size_lines, total_chunks, headings, preview, meta."""
    c = F.col("content")
    columns = [F.length(c).alias("size_chars"), F.size(lines(c)).alias("size_lines"), F.ceil(F.length(c) / READ_CHUNK).cast("int").alias("total_chunks"), outline(c).alias("headings"), preview(c).alias("preview")]
    return with_meta(notes).select("path", *columns, "meta")
