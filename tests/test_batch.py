"""Changes of many notes at once, hints from commits, the stored log, a flaky embedding service, the text index."""

from __future__ import annotations

import contextlib
import glob
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreloom.api import Vault
from loreloom.operators import batch, events, graph, mutate, vector
from loreloom.plans import reports
from loreloom.sources import shared
from loreloom.streaming import link_index, refresh, text_index

TASK = "---\ntype: task\nstatus: {0}\ncreated: 2026-01-01\ntags: [a]\n---\nwork\n"


@pytest.fixture(scope="module")
def tasks(spark):
    rows = [("t/a.md", TASK.format("pending")), ("t/b.md", TASK.format("done")), ("t/c.md", TASK.format("active")), ("t/d.md", TASK.format("active") + "\n**Completed**: 2025-01-01\n"), ("plain.md", "no front matter")]
    return spark.createDataFrame(rows, "path string, content string")


def test_fields_of_many_notes_agree_with_one_at_a_time(spark, tasks):
    schema = "path string, field string, value string, items array<string>"
    rows = [
        ("t/a.md", "status", "done", None),
        ("t/a.md", "status", "done", None),
        ("t/a.md", "tags", None, ["x", "y"]),
        ("t/b.md", "status", "done", None),
        ("t/c.md", "status", "done", None),
        ("t/c.md", "status", "active", None),
        ("t/c.md", "due", "2026-02-02", None),
        ("t/d.md", "priority", "high", None),
        ("t/d.md", "status", "finished", None),
        ("plain.md", "status", "done", None),
        ("none.md", "status", "done", None),
        (None, "status", "done", None),
        ("t/d.md", "prototype", "x", None),
    ]
    changed, outcomes = batch.set_fields(tasks, spark.createDataFrame(rows, schema))
    got = {(r.path, r.field, r.value): (r.n, r.outcome) for r in outcomes.collect()}
    assert got[("t/a.md", "status", "done")] == (2, "applied") and got[("t/a.md", "tags", None)] == (1, "applied")
    assert got[("t/b.md", "status", "done")][1] == "unchanged" and got[("plain.md", "status", "done")][1] == "no front matter"
    assert got[("t/c.md", "status", "done")][1] == got[("t/c.md", "status", "active")][1] == "conflict" and got[("t/c.md", "due", "2026-02-02")][1] == "held back"
    assert got[("t/d.md", "prototype", "x")][1] == "no key of front matter" and got[("t/d.md", "status", "finished")][1] == "held back"
    assert got[("none.md", "status", "done")][1] == got[(None, "status", "done")][1] == "not found" and len(got) == 12
    own = {r.path: r.content for r in changed.collect()}
    assert own == {"t/a.md": mutate.updated(TASK.format("pending"), {"status": "done", "tags": ["x", "y"]})}
    none, said = batch.set_fields(tasks, spark.createDataFrame([], schema))
    assert none.count() == said.count() == 0


def test_statuses_decided(spark, tasks):
    assert batch.decisions("1,2 done | 4 cancel|3 Active | what | skip") == ({1: "done", 2: "done", 4: "cancelled", 3: "active"}, ["what"])
    decided = spark.createDataFrame([(f"t/{x}.md", s) for x, s in (("a", "done"), ("b", "done"), ("c", "finished"), ("d", "done"))], "path string, status string")
    changed, outcomes = batch.set_statuses(tasks, decided, "2026-03-04")
    new = {r.path: r.content for r in changed.collect()}
    assert set(new) == {"t/a.md", "t/b.md", "t/d.md"} and new["t/a.md"].endswith("work\n\n\n**Completed**: 2026-03-04\n") and "status: done" in new["t/d.md"] and new["t/d.md"].count("**Completed**") == 1
    assert {r.path: r.outcome.split(" ")[-1] if "finished" in r.outcome else r.outcome for r in outcomes.collect()} == {"t/a.md": "applied", "t/b.md": "unchanged", "t/c.md": "is", "t/d.md": "applied"}
    assert {r.path: r.content for r in batch.replaced(tasks, changed).collect()} == {r.path: new.get(r.path, r.content) for r in tasks.collect()}


def test_replacements_apply_in_order(spark, tasks):
    edits = [("plain.md", 0, "front", "back"), ("plain.md", 1, "back", "$1"), ("plain.md", 2, "t", "x"), ("plain.md", 3, "", "x"), ("plain.md", 4, " no such", None), ("gone.md", 0, "a", "b")]
    changed, said = batch.replace_texts(tasks, spark.createDataFrame(edits, "path string, pos int, old string, new string"))
    assert [tuple(r) for r in changed.collect()] == [("plain.md", "no $1 matter")]
    assert sorted((r.path, r.pos, r.outcome) for r in said.collect()) == [("gone.md", 0, "not found"), ("plain.md", 0, "applied"), ("plain.md", 1, "applied"), ("plain.md", 2, "2 matches"), ("plain.md", 3, "0 matches"), ("plain.md", 4, "0 matches")]


def test_commit_hints(spark):
    paths = spark.createDataFrame([("p/add-cache-layer.md",), ("p/fix-it.md",), ("p/Rename-Repo.md",), ("p/layers.md",)], "path string")
    commits = spark.createDataFrame([("2026-01-01", "feat: Cache, finally"), ("2026-01-03", "add LAYER to it"), ("2026-01-02", "fix: rename_repo"), ("2026-01-04", None)], "timestamp string, message string")
    assert [tuple(r) for r in reports.commit_hints(paths, commits).collect()] == [("p/add-cache-layer.md", "2026-01-03")]
    assert reports.commit_hints(paths, commits.limit(0)).count() == 0


def test_stored_log_prunes_days_and_keeps_what_others_add(spark, tmp_path):
    log = events.ActivityLog(spark, f"file://{tmp_path}/log", "s")
    rows = [(i, f"2024-05-{1 + i % 9:02}T0{i % 7}:00:00.000Z", f"s{i % 2}", "read" if i % 3 else "edit", "{}") for i in range(90)] + [(90, None, "s1", "read", None), (91, "soon", None, "edit", "{}")]
    frame = lambda some: spark.createDataFrame(some, events.SCHEMA)
    for i in range(3):
        log.append(frame(rows[i::3]))
    assert log.append(frame([])) == 3
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(log.read()) == list(range(92))
    some = log.read("2024-05-03T03", "2024-05-04")
    assert {f.split("day=")[1].split("/")[0] for f in some.inputFiles()} == {"2024-05-03", "2024-05-04", "undated"}
    for args in ({"since": "2024-05-03T03"}, {"before": "2024-05-04"}, {"since": "2024-05-02", "before": "2024-05-02T05"}, {"tool": "edit"}, {"since": "2024"}, {"before": "2024-05"}):
        assert ids(log.query(500, **args)) == ids(events.query(frame(rows), 500, **args))
    whole = {str(f) for f in tmp_path.rglob("*.parquet")}
    left = ids(events.kept_after_clear(frame(rows), tool="edit", before="2024-05-02T03"))
    assert log.clear(tool="edit", before="2024-05-02T03") == 92 - len(left) and ids(log.read()) == left
    assert {f.split("day=")[1].split("/")[0] for f in {str(f) for f in tmp_path.rglob("*.parquet")} - whole} <= {"2024-05-01", "2024-05-02"}
    assert log.compact() and ids(log.read()) == left and log.vacuum() > 0 and ids(log.read()) == left
    taking = log._take

    def late(manifest):
        log._take = taking
        events.ActivityLog(spark, f"file://{tmp_path}/log").append(frame([(99, "2024-05-05", "s", "edit", "{}")]))
        return taking(manifest)

    log._take = late
    assert log.clear(tool="edit") > 0 and [r.id for r in log.read().where("tool_name = 'edit'").collect()] == [99]
    with pytest.raises(ValueError, match="condition"):
        log.clear()
    assert log.clear(everything=True) and ids(log.read()) == [] and log.clear(everything=True) == 0


def test_tools_are_logged_before_they_run(spark, tasks, tmp_path):
    log = events.ActivityLog(spark, f"file://{tmp_path}/calls", "me")
    v = Vault(tasks.withColumn("mtime_ms", F.lit(1)).withColumn("size", F.lit(1)), log=log)
    v.query(type="task", limit=3)
    v.search("work", limit=2)
    with pytest.raises(FileNotFoundError):
        v.read("none")
    got = [(r.tool_name, json.loads(r.args_json)) for r in v.activity(session="ME").collect()]
    assert got == [("vault_read", {"path": "none"}), ("vault_search", {"query": "work", "limit": 2}), ("vault_query", {"type": "task", "limit": 3})]
    assert {r.tool_name for r in v.activity("clear", tool="vault_read").collect()} == {"vault_search", "vault_query"}
    log.folder = "nowhere://x"
    with pytest.warns(UserWarning, match="activity log"):
        assert v.peek("t/a.md").count() == 1


def test_service_is_asked_again_and_answers_are_put_in_order():
    asked, waits = [], []

    def call(texts, timeout):
        asked.append(len(texts))
        if len(asked) in (1, 2):
            raise vector.Busy if len(asked) == 1 else TimeoutError
        return [(i, [float(len(t))]) for i, t in reversed(list(enumerate(texts)))]

    embed = vector.served(call, batch=3, wait=waits.append)
    assert embed(["a", "bb", "ccc", "dddd"]).tolist() == [[1], [2], [3], [4]]
    assert asked == [3, 3, 3, 1] and waits == [1, 2]

    def busy(texts, timeout):
        raise vector.Busy

    with pytest.raises(vector.Busy):
        vector.served(busy, wait=waits.append)(["a"])
    assert waits == [1, 2, 1, 2]
    with pytest.raises(RuntimeError, match="not one for each"):
        vector.served(lambda texts, timeout: [(0, [1.0])] * 2)(["a", "b"])


def test_one_refused_note_is_skipped_and_tried_again(spark, tmp_path):
    sound = vector.hash_embedder(8)

    def flaky(word):
        def call(texts, timeout):
            if any(word in t for t in texts):
                raise vector.Refused(word)
            return list(enumerate(sound(texts).tolist()))[::-1]

        return vector.served(call)

    schema = "path string, content string, mtime_ms long, size long"
    rows = [(f"n{i}.md", f"note {i}", 1, 1) for i in range(20)]
    index = refresh.Index(spark, f"file://{tmp_path}/ix", flaky("note 7"), 4)
    index.sync(spark.createDataFrame(rows, schema))
    got = {r.file_path: r.embedding for r in index.chunks().collect()}
    assert set(got) == {r[0] for r in rows} - {"n7.md"}
    index.embedder = flaky("note x")
    index.sync(spark.createDataFrame([*rows[:3], ("n3.md", "note x", 2, 1), *rows[4:]], schema))
    held = {r.file_path: (r.text, r.embedding) for r in index.chunks().collect()}
    assert set(held) == {r[0] for r in rows} and held["n3.md"][0].endswith("note 3")
    assert all(held[k][1] == pytest.approx(sound([held[k][0]])[0].tolist(), abs=1e-6) for k in held)


def test_text_index_agrees_with_a_scan(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abcAB \n\U0001f600é") for _ in range(rng.randrange(60)))
    rows = [(f"f{i % 3}/n{i}.md", text(), 1, 1) for i in range(60)] + [("e.md", "", 1, 0), ("s.md", "ab", 1, 2)]
    schema = "path string, content string, mtime_ms long, size long"
    index = text_index.TextIndex(spark, f"file://{tmp_path}/ix", buckets=2)
    index.sync(spark.createDataFrame(rows, schema))
    rows[:5] = [(p, c[::-1] + "zzz", 2, 1) for p, c, _, _ in rows[:5]]
    notes = spark.createDataFrame(rows[:-3] + rows[-2:], schema)
    assert index.sync(notes) == 2 and index.sync(notes) == 2
    for q, folder in (("ab ", None), ("A\U0001f600", None), ("zzz", "f1"), ("BÉA", None), ("ab", "f2"), ("\U0001f600éb", None)):
        want = sorted(p for p, c, _, _ in notes.select("*").collect() if q.lower() in c.lower() and (folder is None or p.startswith(folder + "/")))
        assert sorted({r.path for r in index.search(notes, q, folder, 100).collect()}) == want
        near = index.candidates(q, folder)
        assert near is None or set(want) <= {r.path for r in near.collect()} and near.count() < 50


def test_numbers_and_packed_pairs_come_back():
    values = [0, 1, 127, 128, 16_383, 16_384, 2**21, 2**28 - 1, 2**28, 2**32 - 1]
    assert text_index.read_numbers(text_index.numbers(np.array(values)).tobytes()).tolist() == values
    assert text_index.numbers(np.array([], np.int64)).size == 0 == text_index.read_numbers(b"").size
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc\U0001f600é") for _ in range(rng.randrange(3, 90))) for _ in range(400)]
    own = text_index.keys(texts)
    hashed = lambda t: set(text_index.hashes(np.array([ord(c) for c in t])).tolist())
    assert own.tolist() == sorted((h << 32) | i for i, t in enumerate(texts) for h in hashed(t))
    assert text_index.unpacked(*text_index.packed(own)).tolist() == own.tolist()


def test_text_index_has_rows_for_lists_not_for_pieces_and_merges_what_holds(spark, tmp_path, monkeypatch):
    """One row for each piece of a block: a row for each piece of each note was sorted and written before."""
    schema = "path string, content string, mtime_ms long, size long"
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    text = lambda: " ".join(rng.choice(words) for _ in range(200))
    held = {f"n{i:03}.md": text() for i in range(300)} | {"s.md": "ab", "o.md": None}
    pieces = lambda t: len({t.lower()[i : i + 3] for i in range(len(t) - 2)})
    frame = lambda at: spark.createDataFrame([(p, c, at, 1) for p, c in held.items()], schema)
    index = text_index.TextIndex(spark, f"file://{tmp_path}/ix", buckets=2)
    index.sync(frame(1))
    every = sum(pieces(c) for c in held.values() if c)
    assert index._rows(index.TABLE, index.ROWS, index._manifest(index.version())).count() < every / 10
    assert {r.path: r.chunk_count for r in index.files().collect()} == {p: pieces(c) if c and len(c) > 2 else None for p, c in held.items()}
    for i in range(1, 4):
        held |= {f"n{k:03}.md": text() + f" only {i}" for k in range(i, 300, 50)}
        held.pop(f"n{i + 100:03}.md")
        index.sync(frame(i + 1))
    before = sorted(map(tuple, index.chunks().collect()))
    assert len(before) == len(set(before)) == sum(pieces(c) for c in held.values() if c)
    index.compact()
    assert sorted(map(tuple, index.chunks().collect())) == before
    notes = frame(9)
    want = {q: sorted(p for p, c in held.items() if c and q in c) for q in ("only 3", words[0], words[1] + " ", " ")}
    for listed in (1_000, 3):
        monkeypatch.setattr(text_index, "LISTED", listed)
        for q, paths in want.items():
            for limit in (2, 500):
                assert sorted({r.path for r in index.search(notes, q, None, limit).collect()}) == paths[:limit]


def test_writes_of_an_index_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    """Those of all writes of a query lay on the disk together before."""
    notes = spark.range(3_000).selectExpr("concat(id, '.md') path", "repeat(md5(string(id)), 9) content", "id mtime_ms", "id size").repartition(3)
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    blocks = lambda: {p for d in manager.localDirsString() for p in glob.glob(f"{d}/*/shuffle_*.data")}

    def left(name):
        old, setting = blocks(), spark.conf.get(shared._CLEANED, "false")
        text_index.TextIndex(spark, f"file://{tmp_path}/{name}", buckets=2).sync(notes)
        assert spark.conf.get(shared._CLEANED, "false") == setting
        return len(blocks() - old)

    assert left("a") == 0
    monkeypatch.setattr(refresh, "brief_shuffles", contextlib.nullcontext)
    assert left("b") > 0


def test_stored_links_give_the_same_neighbourhoods_without_contents(spark, tmp_path):
    rng = random.Random(9)
    names = [f"{'abc'[i % 3]}/{'n' if i % 4 else 'N'}{i // 3}.md" for i in range(24)]

    def text():
        ends = [rng.choice(names).removesuffix(".md") for _ in range(rng.randrange(3))]
        return " ".join(f"[[{rng.choice([e, e.split('/')[1], e.split('/')[1].upper(), e + '.md', e + '#h', 'no', ' '])}]]" for e in ends)

    rows = [(p, text(), 1, 1) for p in names]
    schema = "path string, content string, mtime_ms long, size long"
    index = link_index.LinkIndex(spark, f"file://{tmp_path}/ix", buckets=2)
    index.sync(spark.createDataFrame(rows[:-4], schema))
    rows[0] = (names[0], f"[[n1]] [[{names[5]}]]", 2, 1)
    notes = spark.createDataFrame([r for r in rows if r[0] != names[3]], schema)
    index.sync(notes)
    start = notes.where(F.col("path") == names[0]).select("path")
    for direction, depth in (("both", 3), ("outgoing", 4), ("incoming", 4)):
        want = graph.neighborhood(notes, start, depth, direction, ordered=True)
        got = index.neighborhood(start, depth, direction, ordered=True)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    v = Vault(notes, stored_links=index)
    assert {(r.path, r.depth) for r in v.neighborhood(names[0]).collect()} == {(r.path, r.depth) for r in graph.neighborhood(notes, start).collect()}
    with pytest.raises(ValueError, match="direction"):
        index.neighborhood(start, 1, "up")
