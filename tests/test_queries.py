"""Registered queries against their SQL on the smallest tables, and the entry point."""

from __future__ import annotations

import itertools
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators import chunking, vector
from loreloom.plans import registry
from loreloom.sources import derived

from .conftest import DATA

SOME = ["neighborhood_stored", "indexed_text_search", "activity_log", "triage_commits", "batch_status", "batch_edit", "neighborhood_in_order", "index_log", "search_lines_top3", "tags_pattern_forms", "health_folder_checks", "append_before_heading", "append_plain", "project_context", "project_context_texts", "session_summary", "short_note_chunks", "triage_hints", "template_scan", "light_frontmatter", "folder_size", "duplicate_check_by_text", "link_audit", "query_sort_priority_desc", "query_created_before", "tags_pattern", "peek_metrics", "link_resolution", "degree", "neighborhood_out", "neighborhood_both", "orphans", "weak_notes", "broken_links", "ambiguous_links", "files_linking_to", "anchor_blend", "activity_filtered", "index_diff", "move_rewrite", "add_links_decisions", "update_frontmatter"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order] for r in values), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_query_agrees_with_sql(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    got = db.execute(registry.oracle_sql()[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    mine = rows([tuple(r) for r in df.collect()], df.columns)
    assert mine == rows(got.fetchall(), names) and mine


def test_index_search_agrees_with_brute_force(spark):
    embed = vector.hash_embedder()
    chunks = chunking.note_chunks(derived.notes(spark, DATA)).select("path", "text").collect()
    far = np.linalg.norm(embed([c.text for c in chunks]).astype(np.float32).astype(float) - embed(["## Links ### Topics"])[0], axis=1)
    best: dict[str, float] = {}
    for d, c in sorted(zip(far, (c.path for c in chunks), strict=True))[:30]:
        best.setdefault(c, round(float(1 - d / 2), 3))
    got = registry.queries()["index_search"](spark, DATA).collect()
    assert [r.score for r in got] == pytest.approx(sorted(best.values(), reverse=True)[:10], abs=0.0011) and len(got) == 10


def test_chunks_are_as_full_as_the_limit_lets_them(spark):
    limit, seen = 300, 0
    for note in derived.notes(spark, DATA).select(tx.trimmed(tx.body(F.col("content"))).alias("body")).collect():
        made = chunking.chunk(note.body, "t", limit)
        assert "".join("".join(c["text"][len("# t\n\n") :] for c in made).split()) == "".join(note.body.split())
        for a, b in itertools.pairwise(made):
            x, y = (c["text"].removeprefix("# t\n\n") for c in (a, b))
            assert 0 < len(x) <= limit
            if a["heading"] and b["heading"] and a["heading"].rsplit(" (", 1)[0] == b["heading"].rsplit(" (", 1)[0]:
                seen += 1
                assert len(x) + 2 + len(y.split("\n\n", 1)[0]) > limit
    assert seen


def test_every_sql_parses(db):
    for sql in registry.oracle_sql().values():
        db.execute("EXPLAIN " + sql)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
