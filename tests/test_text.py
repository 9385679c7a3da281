"""Column functions against plain cases."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loreloom.functions import frontmatter as fm
from loreloom.functions import text as tx
from loreloom.operators import chunking, reading

NOTE = "---\ntype: research\ntags: [Dev, mcp]\n---\n\n# Title\n\n## One\n\na #Tag/x `#code` &#123;\n\n### Deep\n\nb\n\n## One more\n\nc #tag/X"


def one(spark, content, *columns):
    return spark.createDataFrame([(content,)], "content string").select(*columns).first()


def test_front_matter_and_body(spark):
    c = F.col("content")
    row = one(spark, NOTE, tx.front_yaml(c), tx.body(c), tx.front_block(c))
    assert row[0] == "type: research\ntags: [Dev, mcp]" and row[1].startswith("\n\n# Title") and row[2].endswith("\n---")
    assert one(spark, "--- \nx", tx.front_yaml(c))[0] is None
    assert one(spark, "a\n---\nb\n---", tx.body(c))[0] == "a\n---\nb\n---"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a: yes\nb: 2026-01-01\nc: 1:30", {"a": "yes", "b": "2026-01-01", "c": "1:30"}),
        ("a: 0x1F\nb: 1_000\nc: 0o17\nd: 1.5", {"a": 31, "b": 1000, "c": 15, "d": 1.5}),
        ("a: !!python/object/apply:os.system [x]", None),
        ("a: [", None),
        ("just text", None),
        ("", None),
        ("a: null\nb: ~\nc:", {"a": None, "b": None, "c": None}),
    ],
)
def test_yaml_dialect(text, expected):
    assert fm.load(text) == expected


def test_dump_round_trip():
    value = {"type": "task", "created": "2026-01-01", "n": 3, "yes": "true", "tags": ["a", "b: c"], "none": None, "é": "1.0"}
    assert fm.load(fm.dump(value)) == value


def test_scalar_tags_are_no_tags(spark):
    rows = spark.createDataFrame([("---\ntags: foo\n---",), ("---\ntags: [A, null, b]\nn: 1.0\n---",), ("none",)], "content string")
    got = [r.meta for r in fm.with_meta(rows).collect()]
    assert got[0].tags is None and got[1].tags == ["A", "b"] and got[1].fields["n"] == "1" and got[2] is None


def test_inline_tags_and_headings(spark):
    row = one(spark, NOTE, tx.inline_tags(F.col("content")), tx.headings(F.col("content")))
    assert row[0] == ["tag/x"] and row[1] == ["# Title", "## One", "### Deep", "## One more"]


def test_wikilinks(spark):
    text = "[[a]] [[b|B]] [[c#h]] ![[p.png]] [[d|]] [[a]]"
    assert one(spark, text, tx.wikilinks(F.col("content")))[0] == ["a", "b", "c#h", "p.png", "a"]
    cleaned = one(spark, "x#h^b ", tx.link_target(F.col("content")), tx.link_target(F.lit(" n^b#h")))
    assert cleaned[0] == "x" and cleaned[1] == "n"


def test_sections_match_by_prefix_at_line_start(spark):
    c = F.col("content")
    assert one(spark, NOTE, reading.section(c, "## One"))[0].startswith("## One\n\na") and "One more" not in one(spark, NOTE, reading.section(c, "## One"))[0]
    assert one(spark, NOTE, reading.section(c, "### Deep"))[0] == "### Deep\n\nb\n\n"
    assert one(spark, NOTE, reading.section(c, "# Absent"))[0] is None
    assert one(spark, NOTE, reading.tail_sections(c, 1, 2))[0].endswith("---\n## One more\n\nc #tag/X")
    assert one(spark, "no headings", reading.tail_sections(c, 1, 2))[0] == "no headings"
    assert one(spark, NOTE, reading.tail_lines(c, 1))[0] == "---\ntype: research\ntags: [Dev, mcp]\n---\nc #tag/X"


def test_peek(spark):
    notes = spark.createDataFrame([("n.md", NOTE), ("e.md", "")], "path string, content string")
    rows = {r.path: r for r in reading.peek(notes).collect()}
    heads = [(h.heading, h.level, h.line_no) for h in rows["n.md"].headings]
    assert heads == [("# Title", 1, 6), ("## One", 2, 8), ("### Deep", 3, 12), ("## One more", 2, 16)]
    assert rows["n.md"].headings[2].char_count == len("### Deep\n\nb\n") and rows["e.md"].total_chunks == 0 and rows["e.md"].size_lines == 1


def test_read_modes(spark):
    notes = spark.createDataFrame([("s.md", "a\nb\nc"), ("l.md", "x" * 90_000), ("h.md", "y" * 400_001)], "path string, content string")
    assert {r.path: r.redirected for r in reading.read(notes).collect()} == {"s.md": False, "l.md": True, "h.md": True}
    assert {r.path: r.redirected for r in reading.read(notes, force=True).collect()} == {"s.md": False, "l.md": False, "h.md": True}
    assert reading.read(notes.where("path = 's.md'"), lines_=(2, 9.7)).first().text == "b\nc"
    assert len(reading.read(notes.where("path = 'l.md'"), chunk=2).first().text) == 10_000
    with pytest.raises(ValueError, match="only one"):
        reading.read(notes, heading="# A", tail=3)


def test_occurrences_and_patterns(spark):
    c = F.col("content")
    assert one(spark, "aaa", tx.occurrences(c, "aa"))[0] == 1
    for pattern, tag, expected in (("p/*", "p", True), ("p/*", "p/q", True), ("p/*", "pq", False), ("*x*", "axb", True), ("x*", "Xy", True), ("*x", "yx", True), ("x", "xy", False), (None, "z", True)):
        assert one(spark, tag, tx.tag_matches(c, pattern))[0] is expected
    assert one(spark, "doc-12.md", tx.glob(c, "doc-*.md"))[0] and not one(spark, "Doc-1.md", tx.glob(c, "doc-*"))[0]
    assert not one(spark, "a" * 30_000, tx.glob(c, "a*" * 25 + "b"))[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#", max_size=30), max_size=12), st.integers(5, 40))
def test_packed_paragraphs_keep_the_text(parts, limit):
    text = "\n\n".join(parts)
    pieces = chunking.packed(text, limit)
    assert all(0 < len(p) <= limit for p in pieces)
    assert "".join(pieces).replace("\n", "") == text.replace("\n", "")


def test_chunks_by_heading():
    text = "intro\n## A\n" + "x" * 30 + "\n\n" + "y" * 30 + "\n## B\nz"
    got = chunking.chunk(text, "t", 40)
    assert [c["heading"] for c in got] == [None, "A (1)", "A (2)", "B"] and got[0]["text"] == "# t\n\nintro"
    assert chunking.preview("# H\n\nsome words") == "H some words..." and chunking.preview("one two") == "one two"


def test_glob_places_its_parts_in_order(spark):
    c = F.col("content")
    for pattern, name, expected in (("*", "", True), ("a*b*c", "a.b.b.c", True), ("a*b*c", "acb", False), ("a*a", "a", False), ("*b*", "abc", True), ("a", "ab", False), ("a%*", "a%x", True), ("a_*", "abx", False)):
        assert one(spark, name, tx.glob(c, pattern))[0] is expected, (pattern, name)
