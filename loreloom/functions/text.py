"""Column expressions over note contents; all stay in the JVM.

Lengths and positions are in code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

READ_REDIRECT, READ_CAP, READ_CHUNK = 80_000, 400_000, 80_000
LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
INLINE_TAG = r"(?:^|[^a-zA-Z0-9&])#([a-zA-Z_][a-zA-Z0-9_/-]*)"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once a row however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def trimmed(c: Column) -> Column:
    """Without any white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def front_end(content: Column) -> Column:
    """1-based position of the line break before the closing fence; 0 without front matter."""
    return F.when(content.startswith("---"), F.locate("\n---", content, 4)).otherwise(0)


def front_yaml(content: Column) -> Column:
    """What stands between the fences; null without front matter."""
    end = front_end(content)
    return F.when(end > 0, F.substr(content, F.lit(5), F.greatest(end - 5, F.lit(0))))


def front_block(content: Column) -> Column:
    """The front matter with its fences; empty without one."""
    end = front_end(content)
    return F.when(end > 0, F.substr(content, F.lit(1), end + 3)).otherwise("")


def body(content: Column) -> Column:
    end = front_end(content)
    return F.when(end > 0, F.substr(content, end + 4)).otherwise(content)


def basename(path: Column) -> Column:
    """The last part of a path without ``.md``."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last.endswith(".md") & (F.length(last) > 3), F.substr(last, F.lit(1), F.length(last) - 3)).otherwise(last)


def lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def heading_level(line: Column) -> Column:
    """1 to 6, or 0 for other lines."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))


def level_of(heading: str) -> int:
    found = re.match(r"(#{1,6})\s", heading)
    return len(found[1]) if found else 0


def headings(content: Column) -> Column:
    """Heading lines outside the front matter."""
    return F.filter(lines(body(content)), lambda x: x.rlike(r"^#{1,6}\s"))


def inline_tags(content: Column) -> Column:
    """Distinct lower-case #tags of the body without code and heading marks."""
    text = F.regexp_replace(body(content), r"```[\s\S]*?```", "")
    text = F.regexp_replace(text, r"`[^`]+`", "")
    text = F.regexp_replace(text, r"(?m)^#+\s", "")
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(INLINE_TAG), F.lit(1)), F.lower))


def wikilinks(content: Column) -> Column:
    """Raw link targets in text order, repeated ones too."""
    return F.regexp_extract_all(content, F.lit(LINK), F.lit(1))


def link_target(raw: Column) -> Column:
    """A raw target without heading and block references."""
    return trimmed(F.substring_index(F.substring_index(raw, "#", 1), "^", 1))


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal; none of an empty one."""
    if not part:
        return F.lit(0)
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def tag_pattern(pattern: str) -> tuple[str, str]:
    """What a pattern asks of a tag (below, part, start, end, whole) and its literal, lower-case.

    A star at either end leaves that end open; ``p/*`` also means ``p`` itself.
    """
    low = pattern.lower()
    if low.endswith("/*"):
        return "below", low[:-2]
    ends = (low.startswith("*") and low != "**", low.endswith("*"))
    kind = {(True, True): "part", (False, True): "start", (True, False): "end", (False, False): "whole"}[ends]
    return kind, low[ends[0] : len(low) - ends[1]]


TAG_TESTS: dict[str, Callable[[Column, str], Column]] = {
    "below": lambda t, x: F.concat(t, F.lit("/")).startswith(f"{x}/"),
    "part": lambda t, x: t.contains(x),
    "start": lambda t, x: t.startswith(x),
    "end": lambda t, x: t.endswith(x),
    "whole": lambda t, x: t == x,
}


def tag_matches(tag: Column, pattern: str | None) -> Column:
    """Does a tag match, without regard to case? No pattern matches all."""
    if not pattern:
        return F.lit(True)
    kind, literal = tag_pattern(pattern)
    return TAG_TESTS[kind](F.lower(tag), literal)


def glob(name: Column, pattern: str) -> Column:
    """An anchored, case-sensitive pattern in which only * is special.

    What is left of the name shrinks part by part: cut after the first place of each part
    between stars, null once one is missing. Nothing backtracks, as LIKE would.
    """
    parts = pattern.split("*")
    if len(parts) == 1:
        return name == pattern

    def behind(rest: Column, part: Column) -> Column:
        place = F.position(part, rest)
        return F.when(place > 0, F.substr(rest, place + F.length(part)))

    rest = F.when(name.startswith(parts[0]), F.substr(name, F.lit(len(parts[0]) + 1)))
    inner = [F.lit(p) for p in parts[1:-1] if p]
    rest = F.aggregate(F.array(*inner), rest, behind) if inner else rest
    return F.coalesce(rest.endswith(parts[-1]), F.lit(False))


def round3(x: Column) -> Column:
    """Half up at the third decimal, for numbers that aren't negative."""
    return F.floor(x * 1000 + 0.5) / 1000
