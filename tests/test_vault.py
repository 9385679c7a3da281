"""A small vault on disk through the operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loreloom.operators import catalog, events, graph, links, mutate, vector
from loreloom.plans import reports
from loreloom.sources.shared import cut
from loreloom.sources.vault import read_vault
from loreloom.streaming import refresh


def front(type_, tags, created="2026-01-01", **more):
    extra = "".join(f"{k}: {v}\n" for k, v in more.items())
    return f"---\ntype: {type_}\ncreated: {created}\ntags: [{', '.join(tags)}]\n{extra}---\n"


FILES = {
    "garden/soil.md": front("permanent", ["Ground", "care"], "2024-03-02") + "\nFed with [[compost]]; see [[beds/raised|the bed]] and [[raised#Filling]].\n",
    "garden/compost.md": front("research", ["care", "heap"], "2024-03-05", status="active") + "\n[[SOIL]] likes it. [[weather]] [[no such note]] [[#Heat]] ![[heap.jpg]]\n",
    "beds/raised.md": front("adr", ["wood"], "2024-01-20") + "\n## Filling\n\nBottom up, then [[away/soil]].\n",
    "beds/weather.md": front("fleeting", ["sky"], "2024-02-01") + "\nA shelf with no links\n",
    "log/weather.md": front("devlog", ["sky", "log"], "2024-02-02") + "\n[[compost]] steams in frost\n",
    "todo/dig.md": front("task", ["work"], "2024-03-09", status="active", priority="urgent", due="2024-04-01"),
    "todo/water.md": front("task", ["work"], "2024-03-10", status="pending", priority="low", due="~"),
    "todo/rest.md": front("task", ["leisure"], "2024-03-11", status="done", priority="normal", due="2024-02-11"),
    "_index.md": "plain",
    "_sub/q.md": "---\ntags: scalar\n---\n",
    ".hidden.md": "hidden",
    ".trash/old.md": "old",
    "skip.txt": "no",
}


@pytest.fixture(scope="module")
def notes(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for path, content in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    (root / "link.md").symlink_to(root / "garden/soil.md")
    return read_vault(spark, str(root)).cache()


def paths(df):
    return [r.path for r in df.collect()]


def test_scan(spark, notes):
    assert sorted(paths(notes)) == sorted(set(FILES) - {".trash/old.md", "skip.txt"})


def test_listing(notes):
    got = {(r.entry, r.is_dir) for r in catalog.list_directory(notes).collect()}
    assert got == {("_index.md", False), ("_sub", True)} | {(d, True) for d in ("garden", "beds", "log", "todo")}
    assert {r.entry for r in catalog.list_directory(notes, "garden", pattern="*so*.md").collect()} == {"garden/soil.md"}
    assert {r.entry for r in catalog.list_directory(notes, "", True, "none*").collect()} >= {"todo/dig.md", "garden", "log/weather.md"}


def test_queries(notes):
    q = lambda **k: paths(catalog.query(notes, **k))
    assert q(type="task", sort_by="due") == ["todo/rest.md", "todo/dig.md", "todo/water.md"]
    assert q(type="task", sort_by="due", sort_order="desc") == ["todo/water.md", "todo/dig.md", "todo/rest.md"]
    assert q(type="task", sort_by="due", sort_order="desc", nulls_last=True)[-1] == "todo/water.md"
    assert q(type="task", sort_by="priority", limit=2) == ["todo/water.md", "todo/rest.md"]
    assert q(tags=["GROUND", "care"]) == ["garden/soil.md"] and set(q(tags_any=["heap", "wood"])) == {"garden/compost.md", "beds/raised.md"}
    assert set(q(created_before="2024-01-31")) == {"beds/raised.md", "_sub/q.md"} and "_sub/q.md" not in q(created_after="1999")
    assert q(custom_fields={"due": None}, type="task") == ["todo/water.md"] and "_index.md" not in q(custom_fields={"due": ""})
    assert q(custom_fields={"constructor": "x"}, type="adr") == ["beds/raised.md"]


def test_search(notes):
    rows = catalog.search(notes, "WITH NO").collect()
    assert [(r.path, r.line_no, r.line) for r in rows] == [("beds/weather.md", 7, "A shelf with no links")] and len(catalog.search(notes, "priority:", limit=2).collect()) == 2


def test_tags(notes):
    counts = {r.tag: r.n_notes for r in catalog.tag_counts(notes).collect()}
    assert counts == {"ground": 1, "care": 2, "heap": 1, "wood": 1, "sky": 2, "log": 1, "work": 2, "leisure": 1}
    assert [r.tag for r in catalog.tag_counts(notes, pattern="*r*").collect()] == ["care", "work", "ground", "leisure"]


def test_link_graph(spark, notes):
    resolved = links.edges(notes).cache()
    found = resolved.collect()
    to = lambda raw: sorted({x.dst or "" for x in found if x.raw == raw})
    assert to("weather") == ["beds/weather.md", "log/weather.md"] and to("away/soil") == to("SOIL") == ["garden/soil.md"] and to("raised#Filling") == ["beds/raised.md"]
    degree = {r.path: (r.outgoing, r.incoming) for r in links.degrees(notes).collect()}
    assert degree["garden/soil.md"] == (3, 2) and degree["garden/compost.md"] == (2, 2) and degree["beds/weather.md"] == (0, 1)
    assert {r.raw for r in links.broken(links.factored(notes)).collect()} == {"#Heat", "no such note"}
    assert [(r.raw, r.n_candidates) for r in links.ambiguous(links.factored(notes)).collect()] == [("weather", 2)]
    assert paths(links.weak(links.degrees(notes))) == ["beds/weather.md"]
    start = spark.createDataFrame([("beds/raised.md",)], "path string")
    around = {r.path: r.depth for r in graph.neighborhood(notes, start, 2).collect()}
    assert around == {"beds/raised.md": 0, "garden/soil.md": 1, "garden/compost.md": 2}
    assert {r.path for r in graph.neighborhood(notes, start, 9, "outgoing").collect()} == {"beds/raised.md", "garden/soil.md", "garden/compost.md", "beds/weather.md", "log/weather.md"}
    assert {"todo/dig.md", "todo/rest.md", "todo/water.md"} <= set(paths(links.orphans(links.degrees(notes))))


def test_blend(spark):
    hits = spark.createDataFrame([("a", 0.8), ("b", 0.82)], "path string, score double")
    nodes = spark.createDataFrame([("a", 1)], "path string, depth int")
    assert [(r.path, r.combined) for r in vector.blend(hits, nodes, 0.3).collect()] == [("a", 0.86), ("b", 0.574)]
    assert vector.blend(hits, nodes, 0.5).first().combined == 0.9
    with pytest.raises(ValueError, match="between 0 and 1"):
        vector.blend(hits, nodes, 1.5)


def test_embedder_and_search(spark):
    rows = spark.createDataFrame([(1, "x/a.md", "h", "", "red fish"), (2, "x/a.md", "h", "", "blue bird"), (3, "y/b.md", "h", "", "green tree"), (4, "z.md", "h", "", None)], "id long, file_path string, heading string, content_preview string, text string")
    embed = vector.hash_embedder(64)
    chunks = vector.embedded(rows, "text", embed)
    got = vector.search_raw(chunks, embed(["red fish"])[0].tolist(), 2).collect()
    assert got[0].path == "x/a.md" and got[0].score == 1.0 and len(got) == 2
    assert vector.search_raw(chunks, embed(["red fish"])[0].tolist(), 2, folder="y").count() == 1


def test_activity(spark):
    log = spark.createDataFrame([(1, "2026-01-01T00:00:00.000Z", "AbC1", "read", '{"path": "a_b.md"}'), (2, "2026-01-02T00:00:00.000Z", "abd", "write", '{"path": "axb.md"}'), (3, "2026-01-02T00:00:00.000Z", "abd", "read", None)], events.SCHEMA)
    ids = lambda **k: [r.id for r in events.query(log, **k).collect()]
    assert ids() == [3, 2, 1] and ids(path="A_B") == [1] and ids(session="abc") == [1] and ids(before="2026-01-01T00:00:00.000Z") == [1] and ids(since="2026-01-02") == [3, 2]
    assert [r.id for r in events.kept_after_clear(log, before="2026-01-02T00:00:00.000Z").collect()] == [2, 3]
    with pytest.raises(ValueError, match="condition"):
        events.kept_after_clear(log)
    assert events.entry(spark, "vault_read", {"path": "x"}, "s").first().tool_name == "vault_read"


def content(df, path):
    return df.where(F.col("path") == path).first().content


def test_mutations(spark, notes):
    n = notes.select("path", "content", "mtime_ms", "size")
    assert content(mutate.append(n, "beds/weather.md", "new"), "beds/weather.md").endswith("links\n\nnew")
    assert content(mutate.append(n, "beds/raised.md", "first", "## Filling", "before_heading"), "beds/raised.md").count("first\n## Filling") == 1
    with pytest.raises(ValueError, match="no heading"):
        mutate.append(n, "beds/weather.md", "new", "## No", "end_of_section")
    with pytest.raises(ValueError, match="exactly one"):
        mutate.edit(n, "garden/soil.md", "[[", "x")
    assert "Fed by $& [[compost]]" in content(mutate.edit(n, "garden/soil.md", "Fed with", "Fed by $&"), "garden/soil.md")
    new = content(mutate.update_frontmatter(n, "todo/dig.md", {"status": "done", "due": None}), "todo/dig.md")
    assert "status: done" in new and "due" not in new and new.index("type") < new.index("created")
    for bad in ({"status": "nope"}, {"created": None}, {"prototype": "x"}, {"1a": "x"}, {"tags": []}):
        with pytest.raises(ValueError, match="."):
            mutate.update_frontmatter(n, "todo/dig.md", bad)
    moved = mutate.move(n, "garden/compost.md", "attic/humus.md")
    assert "[[humus]]; see" in content(moved, "garden/soil.md") and content(moved, "attic/humus.md") == FILES["garden/compost.md"]
    left, gone, broke = mutate.trash(n, "garden/compost.md")
    assert left.count() == n.count() - 1 and paths(gone) == [".trash/garden/compost.md"] and sorted(paths(broke)) == ["garden/soil.md", "log/weather.md"]
    wanted = spark.createDataFrame([("beds/weather.md", 0, "garden/soil", "why"), ("beds/weather.md", 1, "nope", ""), ("beds/weather.md", 2, "log/weather.md", None)], "path string, pos int, target string, annotation string")
    assert content(mutate.add_links(n, wanted), "beds/weather.md").endswith("\n\n## Related\n- [[soil]] — why\n- [[log/weather]]\n")
    template = "---\ntype: task\ncreated: <% tp.date.now(\"YYYY-MM-DD\") %>\ntags: []\n---\n# <% tp.file.title %>\n<% who %>"
    text = mutate.rendered(template, "T", {"who": "me $1"}, {"tags": ["a"], "status": "pending"})
    assert "- a" in text and text.endswith("# T\nme $1") and mutate.write(n, "new.md", text).count() == n.count() + 1
    with pytest.raises(FileExistsError):
        mutate.write(n, "todo/dig.md", text)
    with pytest.raises(ValueError, match="unsubstituted"):
        mutate.write(n, "other.md", template)


def test_validation(notes):
    got = {r.path: r.errors for r in catalog.validation(notes).collect()}
    assert got["todo/dig.md"] == [] and got["_index.md"] == ["no front matter"] and "tags are missing" in got["_sub/q.md"]


def test_project_context(spark):
    log = "---\ntype: devlog\n---\n## Sessions\n\n### a\n1\n### b\n2\n### c\n3\n### d\n4"
    rows = [("01-Projects/App/_index.md", "# App"), ("01-Projects/App/development/devlog.md", log), ("01-Projects/App/tasks/t.md", front("task", ["x"], status="active") + "# Do it\n\nfirst\nsecond\nthird")]
    n = spark.createDataFrame(rows, "path string, content string")
    assert [r.project for r in reports.resolve_project(n, "APP").collect()] == ["01-Projects/App"]
    got = {r.part: r.text for r in reports.project_context(n, "01-Projects/App").collect()}
    assert got["task"] == "- Do it (status: active, priority: normal)\nfirst\nsecond" and "### a" not in got["devlog"] and "### b" in got["devlog"]
    assert reports.session_summary(reports.project_context(n, "01-Projects/App"), n, n).first().tasks == 1


def test_refresh(spark, tmp_path):
    schema = "path string, content string, mtime_ms long, size long"
    index = refresh.Index(spark, f"file://{tmp_path}/index")
    v1 = spark.createDataFrame([("a.md", "alpha", 1, 5), ("b.md", "beta", 1, 4), ("e.md", "", 1, 0)], schema)
    index.sync(v1)
    assert {r.path for r in index.files().collect()} == {"a.md", "b.md"}
    v2 = spark.createDataFrame([("a.md", "alpha", 2, 5), ("c.md", "gamma", 2, 5)], schema)
    assert {(r.path, r.change) for r in refresh.difference(v2, index.files()).collect()} == {("a.md", "changed"), ("b.md", "deleted"), ("c.md", "new")}
    assert paths(refresh.to_index(v2, index.files())) == ["c.md"]
    index.sync(v2)
    assert {r.path for r in index.files().collect()} == {"a.md", "c.md"} and {r.file_path for r in index.chunks().collect()} == {"a.md", "c.md"}
    spark.createDataFrame([("c.md", "gamma two", 3, 9), ("c.md", "older", 2, 5)], schema).write.parquet(f"{tmp_path}/in")
    query = index.follow(refresh.change_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/cp")
    query.awaitTermination(60)
    assert [r.text for r in index.chunks().where("file_path = 'c.md'").collect()] == ["# c\n\ngamma two"]
    assert refresh.stats(v2, index.files(), index.chunks()).first().total_chunks == 2


def test_tools(spark, notes):
    from loreloom.api import Vault
    from loreloom.operators.chunking import note_chunks

    embed = vector.hash_embedder(32)
    made = note_chunks(notes).withColumn("id", F.xxhash64("path", "chunk_index")).withColumnsRenamed({"path": "file_path", "preview": "content_preview"})
    v = Vault(notes.select("path", "content", "mtime_ms", "size"), vector.embedded(made, "text", embed).cache(), embedder=embed)
    assert v.resolve_path("Compost") == "garden/compost.md" and v.resolve_path("beds/raised") == "beds/raised.md" and v.resolve_folder("GARD") == "garden"
    with pytest.raises(ValueError, match="ambiguous"):
        v.resolve_path("weather")
    with pytest.raises(FileNotFoundError):
        v.resolve_path("absent")
    assert v.read("raised", tail=1).first().text.endswith("---\n") and v.peek("raised").first().total_chunks == 1
    assert {r.path: r.depth for r in v.neighborhood("raised", 1).collect()} == {"beds/raised.md": 0, "garden/soil.md": 1}
    assert v.semantic_search("a shelf with no links", 2).first().path == "beds/weather.md" and "combined" in v.semantic_search("frost", 3, anchor="soil").columns
    assert "garden/compost.md" not in paths(v.suggest_links(path="soil", limit=10)) and "missing_link" in v.suggest_links(path="soil", graph_context=True).columns
    assert set(v.link_health()) == set(links.CHECKS) and v.tags(pattern="l*").count() == 2
    assert content(v.add_links("beds/weather.md", [{"target": "beds/raised"}]), "beds/weather.md").endswith("- [[raised]]\n")


def test_resolving_past_many_candidates(spark):
    from loreloom.api import Vault

    folders = [f"a{i:03}-zoo-x" for i in range(150)] + ["zoo"] + [f"p{i:03}-log-x" for i in range(150)] + ["a-log", "z-log"] + [f"q{i:03}-pen-x" for i in range(150)] + ["z-pen"]
    v = Vault(spark.createDataFrame([(f"{f}/_index.md", "x", 0, 1) for f in folders], "path string, content string, mtime_ms long, size long"))
    assert v.resolve_folder("zoo") == "zoo" and v.resolve_folder("pen") == "z-pen"
    with pytest.raises(ValueError, match="ambiguous"):
        v.resolve_folder("log")
    assert v.resolve_path("_index", "zoo") == "zoo/_index.md" and v.resolve_path("_index", "z-pen/") == "z-pen/_index.md"
    with pytest.raises(ValueError, match="ambiguous"):
        v.resolve_path("_index")


def test_vault_stream_follows_files_whatever_their_time(spark, tmp_path):
    import os

    from loreloom.sources.vault import VaultSource

    root = tmp_path / "vault"
    root.mkdir()

    def put(name, text, seconds):
        (root / name).write_text(text)
        os.utime(root / name, (seconds, seconds))

    def indexed():
        query = index.follow(spark.readStream.format("vault").load(str(root)), f"{tmp_path}/vcp", availableNow=True)
        assert query.awaitTermination(60)
        return {r.file_path: r.text.split()[-1] for r in index.chunks().collect()}, index.version()

    spark.dataSource.register(VaultSource)
    index = refresh.Index(spark, f"file://{tmp_path}/vindex")
    put("a.md", "alpha", 2_000_000)
    put("b.md", "beta", 2_000_000)
    assert indexed() == ({"a.md": "alpha", "b.md": "beta"}, 1)
    put("old.md", "restored", 1_000_000)
    put("a.md", "older", 1_500_000)
    put("b.md", "longer", 2_000_000)
    assert indexed() == ({"a.md": "older", "b.md": "longer", "old.md": "restored"}, 2)
    assert indexed()[1] == 2


def test_index_feeds_search_and_follows_deletes(spark, tmp_path):
    from loreloom.api import Vault

    schema = "path string, content string, mtime_ms long, size long"
    embed = vector.hash_embedder(64)
    index = refresh.Index(spark, f"file://{tmp_path}/ix", embed)
    notes = spark.createDataFrame([("a.md", "red fish swim", 1, 1), ("b.md", "blue birds sing", 1, 1), ("c.md", "old stones", 1, 1)], schema)
    index.sync(notes)
    assert sorted(index.chunks().columns) == sorted(["id", "file_path", "chunk_index", "heading", "text", "content_preview", "embedding"])
    v = Vault(notes, index.chunks(), embedder=embed)
    hits = v.semantic_search("# a red fish swim", 3).collect()
    chunks = index.chunks().collect()
    own = embed(["# a red fish swim"])[0]
    best = sorted(chunks, key=lambda c: sum((x - y) ** 2 for x, y in zip(c.embedding, own, strict=True)))
    assert [h.path for h in hits] == [c.file_path for c in best] and hits[0].path == "a.md" and hits[0].preview == "red fish swim"
    near = {r.path: (r.depth, r.score is not None) for r in v.neighborhood("a", include_semantic=True).collect()}
    assert near == {"a.md": (0, False), "b.md": (None, True), "c.md": (None, True)}
    left = notes.where("path <> 'c.md'")
    spark.createDataFrame([("b.md", "blue birds rest", 2, 1)], schema).write.parquet(f"{tmp_path}/changes")
    assert index.follow(refresh.change_stream(spark, f"{tmp_path}/changes"), f"{tmp_path}/dcp", lambda: left).awaitTermination(60)
    assert {r.file_path: r.text.split()[-1] for r in index.chunks().collect()} == {"a.md": "swim", "b.md": "rest"}


def test_activity_is_stored(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    for tool in ("vault_read", "vault_edit"):
        events.record(spark, folder, tool, {"path": "todo/dig.md"}, "s1")
    assert sorted(r.tool_name for r in events.query(events.stored(spark, folder), path="DIG").collect()) == ["vault_edit", "vault_read"]


def test_triage_counts_changes_of_the_task(spark, notes):
    log = spark.createDataFrame([(i, f"2024-05-0{i}T", "s", t, a) for i, (t, a) in enumerate([("vault_edit", '{"path": "todo/dig.md"}'), ("vault_read", '{"path": "todo/water.md"}'), ("vault_append", '{"path": "todo/dig.md"}'), ("vault_edit", None)], 1)], events.SCHEMA)
    rows = reports.triage(notes, log, "2024-05-02").collect()
    assert [(r.path, r.changes, r.hint) for r in rows] == [("todo/dig.md", 1, "recently updated"), ("todo/water.md", 0, None)]


def test_annotated_projects(spark):
    n = spark.createDataFrame([("01-Projects/App/x.md", ""), ("areas/Home Lab/y.md", "")], "path string, content string")
    names = lambda *a: [r.project for r in reports.resolve_project(n, *a).collect()]
    assert names("app", "# PKM: areas/Home Lab\n") == ["01-Projects/App"] and names("lab", "text\n# PKM: areas/Home Lab \n") == ["areas/Home Lab"]
    assert names("lab") == names("lab", "# PKM: none/such") == []
    with pytest.raises(ValueError, match="outside"):
        names("lab", "# PKM: ../etc")


def test_templates_and_light_fields(spark):
    rows = [("05-Templates/t.md", "---\ntype: task\n---\n<!-- c -->\n## For <% tp.file.title %>\nx"), ("05-Templates/d.md", "---\ntype: adr\ndescription: Own words\n---\n# H"), ("05-Templates/e.md", "---\ntype: log\n---\n"), ("05-Templates/sub/n.md", "no")]
    n = spark.createDataFrame(rows, "path string, content string")
    assert {r.name: r.description for r in catalog.templates(n).collect()} == {"t": "For {title}", "d": "Own words", "e": "Template for log"}
    light = {r[0]: r[1] for r in n.select("path", catalog.light_fields(F.col("content"))).collect()}
    assert light["05-Templates/d.md"] == {"type": "adr", "description": "Own words"} and light["05-Templates/sub/n.md"] is None
    twice = spark.createDataFrame([("---\na: 1\nb: x y \na: 2\n  c: 3\n---",)], "content string")
    assert twice.select(catalog.light_fields(F.col("content"))).first()[0] == {"a": "2", "b": "x y"}


def test_tag_patterns():
    from loreloom.functions.text import tag_pattern

    cases = {"P/*": ("below", "p"), "*x*": ("part", "x"), "X*": ("start", "x"), "*x": ("end", "x"), "x": ("whole", "x"), "*": ("part", ""), "**": ("start", "*"), "*a*b*": ("part", "a*b")}
    assert {p: tag_pattern(p) for p in cases} == cases


def _size(folder):
    return {str(f.relative_to(folder)): f.stat().st_size for f in folder.rglob("*.parquet")}


def test_index_is_a_log_of_buckets(spark, tmp_path):
    """One changed note writes one bucket, nothing changed writes nothing; merging and deleting keep every row."""
    schema = "path string, content string, mtime_ms long, size long"
    index = refresh.Index(spark, f"file://{tmp_path}/log", vector.hash_embedder(8), 32)
    rows = [(f"n/{i}.md", f"note {i} " + "text " * 300, 1, 1) for i in range(2000)]
    notes = lambda: spark.createDataFrame(rows, schema)
    assert index.sync(notes()) == 1
    whole = _size(tmp_path / "log")
    assert index.sync(notes()) == 1 and _size(tmp_path / "log") == whole
    rows[7] = ("n/7.md", "new words", 2, 1)
    assert index.sync(notes()) == 2
    more = {k: v for k, v in _size(tmp_path / "log").items() if k not in whole}
    assert len({k.split("bucket=")[1].split("/")[0] for k in more}) == 1 and sum(more.values()) < sum(whole.values()) / 20

    def state():
        return {r.path: (r.mtime_ms, r.chunk_count) for r in index.files().collect()}, sorted((r.file_path, r.text) for r in index.chunks().collect())

    del rows[9]
    rows[3] = ("n/3.md", "", 3, 0)
    assert index.sync(notes()) == 3
    files, chunks = state()
    assert len(files) == len(chunks) == 1998 and "n/9.md" not in files and "n/3.md" not in files and files["n/7.md"] == (2, 1)
    assert len(index.files(1).collect()) == 2000
    assert index.compact() == 4 and state() == (files, chunks) and index.compact() is None
    assert index.vacuum() > 0 and state() == (files, chunks) and index.version() == 4
    for i in range(refresh.DELTAS + 1):
        rows[0] = ("n/0.md", f"turn {i}", 10 + i, 1)
        index.sync(notes())
    live = index._manifest(index.version())["live"]
    assert max(map(len, live.values())) <= refresh.DELTAS and ("n/0.md", f"# 0\n\nturn {refresh.DELTAS}") in state()[1]


def test_two_writers_take_different_versions(spark, tmp_path, monkeypatch):
    schema = "path string, content string, mtime_ms long, size long, content_hash string"
    first, second = (refresh.Index(spark, f"file://{tmp_path}/two", vector.hash_embedder(8)) for _ in range(2))
    none = spark.createDataFrame([], "path string")
    note = lambda p, t: spark.createDataFrame([(p, t, 1, 1, t)], schema)
    taking = first._take

    def late(manifest):
        monkeypatch.setattr(first, "_take", taking)
        assert second.apply(note("b.md", "second"), none) == manifest["version"] == 1
        return taking(manifest)

    monkeypatch.setattr(first, "_take", late)
    assert first.apply(note("a.md", "first"), none) == 2
    assert paths(first.files()) == paths(second.files()) == ["a.md", "b.md"]
    monkeypatch.setattr(first, "_take", lambda manifest: False)
    with pytest.raises(refresh.Conflict):
        first.apply(note("c.md", "third"), none)
    assert paths(second.files()) == ["a.md", "b.md"]


def test_conditions_on_paths_reach_the_scan(spark, tmp_path, capsys):
    """Folders that can't hold what is asked for are never listed; the plan names the conditions."""
    from loreloom.sources.vault import Files, VaultReader

    for name in ("a/x.md", "a/b/y.md", "a/b/c/d/e/f.md", "ab/z.md", "q/_i.md", ".dot/n.md", "top.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = lambda rows: sorted(paths(rows))
    notes = read_vault(spark, str(tmp_path))
    assert found(notes) == ["a/b/c/d/e/f.md", "a/b/y.md", "a/x.md", "ab/z.md", "q/_i.md", "top.md"]
    below = notes.where(F.col("path").startswith("a/b/"))
    assert found(below) == ["a/b/c/d/e/f.md", "a/b/y.md"]
    below.explain("formatted")
    assert "PushedFilters: [StringStartsWith(path,a/b/)]" in capsys.readouterr().out
    assert found(notes.where("path IN ('top.md', 'a/x.md', 'no.md') AND content <> 'top.md'")) == ["a/x.md"]
    assert found(notes.where("path = 'a/b/y.md'")) == ["a/b/y.md"] and found(notes.where("path = 'top.md' AND path = 'a/x.md'")) == []
    from pyspark.sql.datasource import StringStartsWith

    reader = VaultReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([StringStartsWith(("path",), "a/")])) == []
    assert reader.partitions() == [Files(["a/x.md", "a/b/y.md"]), Files([], "a/b/c/d")]


def test_watcher_waits_for_a_path_to_settle_and_tells_of_deletes(spark, tmp_path):
    """Three changes in quick order give one row; a deleted file drops its chunks without a listing of what is left."""
    import time

    from loreloom.sources.vault import watch_vault

    root = tmp_path / "vault"
    root.mkdir()
    index = refresh.Index(spark, f"file://{tmp_path}/windex", vector.hash_embedder(8), 4)
    seen: list = []
    changes = refresh.settled(watch_vault(spark, str(root), f"{tmp_path}/listings"), 3_000)
    (root / "gone.md").write_text("soon gone")

    def batch(rows, n):
        seen.extend(r.path for r in rows.select("path").collect())
        follow(rows, n)

    class Caught:
        """What follow() starts on a stream, to watch its rows on their way."""

        writeStream = property(lambda self: self)
        foreachBatch = lambda self, f: setattr(self, "f", f) or self
        option = trigger = lambda self, *a, **k: self
        start = lambda self: self

    follow = index.follow(Caught(), "").f
    query = changes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/wcp").trigger(processingTime="200 milliseconds").start()
    try:
        def until(done):
            end = time.time() + 90
            while not done():
                assert time.time() < end and query.isActive, query.exception()
                time.sleep(0.2)

        until(lambda: seen == ["gone.md"])
        for i in range(3):
            (root / "a.md").write_text("words " * (i + 1))
            time.sleep(0.7)
        (root / "gone.md").unlink()
        until(lambda: index.version() and {r.file_path: r.text for r in index.chunks().collect()} == {"a.md": "# a\n\nwords words words"})
        assert sorted(seen) == ["a.md", "gone.md", "gone.md"]
    finally:
        query.stop()
    assert len(list((tmp_path / "listings").iterdir())) <= 3


def _most_rows(df):
    """The greatest number of rows that any operator of a frame's executed plan gave."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        metric = plan.metrics().get("numOutputRows")
        own = metric.get().value() if metric.isDefined() else 0
        below = plan.children()
        return max([own, *(walk(below.apply(i)) for i in range(below.size()))])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_links_to_a_hot_name_are_counted_without_their_pairs(spark):
    m = 1500
    rows = [(f"d{i}/hot.md", "") for i in range(m)] + [(f"s/{i}.md", f"[[hot]] then [[d{i}/hot]]") for i in range(m)]
    rows += [("own/hot.md", "[[HOT]]"), ("t.md", "[[t]] [[nowhere]]")]
    notes = spark.createDataFrame(rows, "path string, content string")
    every = cut(links.factored(notes))
    degree = links.degrees(notes, links=every)
    assert _most_rows(degree) <= 10 * m
    got = {r.path: (r.outgoing, r.incoming) for r in degree.collect()}
    assert len(got) == len(rows) and got["d7/hot.md"] == (0, m + 1) and got["own/hot.md"] == (1, m) and got["s/7.md"] == (2, 0) and got["t.md"] == (1, 0)
    assert [(r.raw, r.src, r.n_candidates) for r in links.ambiguous(every).orderBy("raw").collect()] == [("HOT", "own/hot.md", m + 1), ("hot", "s/0.md", m + 1)]
    assert [r.raw for r in links.broken(every).collect()] == ["nowhere"]
    assert links.linking_to(notes, "d7/hot.md").count() == m + 1 and links.linking_to(notes, "e/hot.md").count() == 0
    start = spark.createDataFrame([("s/3.md",)], "path string")
    steps = graph._steps(start.select("path", links.note_name().alias("name"), F.array().cast(f"array<{graph.STEP}>").alias("trail")), every, notes.select("path", links.note_name().alias("name")), "both")
    assert _most_rows(steps) <= 10 * m
    around = graph.neighborhood(notes, start, 2)
    assert {(r.depth, r.ambiguous, r["count"]) for r in around.groupBy("depth", "ambiguous").count().collect()} == {(0, False, 1), (1, True, m + 1), (2, False, m - 1)}


def test_factored_links_agree_with_a_walk(spark):
    rng = random.Random(5)
    names = ["a.md", "b.md", "A.md", "x/a.md", "y/a.md", "x/b.md", "y/c.md", "z/c.md", "e.md", "f.md", "z/g.md"]
    for _ in range(2):
        texts = {p: " ".join(f"[[{rng.choice(['a', 'b', 'C', 'x/a', 'y/a.md', 'x/nope', 'e#h', 'f', 'G', 'e', '#h'])}]]" for _ in range(rng.randrange(4))) for p in names}
        notes = spark.createDataFrame(list(texts.items()), "path string, content string").repartition(3)
        leads = {p: [] for p in names}
        for r in links.edges(notes).where("dst IS NOT NULL").collect():
            leads[r.src].append((r.pos, r.dst, r.ambiguous))
        into = {p: sorted({q for q in names if q != p and any(d == p for _, d, _ in leads[q])}) for p in names}
        got = {r.path: (r.outgoing, r.incoming) for r in links.degrees(notes).collect()}
        assert got == {p: (len({x[0] for x in leads[p]}), len(into[p])) for p in names}
        for direction in ("outgoing", "incoming", "both"):
            first, queue = {"a.md": (0, False)}, ["a.md"]
            for p in queue:
                steps = [(d, amb) for _, d, amb in sorted(leads[p])] if direction != "incoming" else []
                steps += [(q, False) for q in into[p]] if direction != "outgoing" else []
                for q, amb in steps:
                    if q not in first and first[p][0] < 3:
                        first[q] = (first[p][0] + 1, amb)
                        queue.append(q)
            near = graph.neighborhood(notes, spark.createDataFrame([("a.md",)], "path string"), 3, direction)
            assert {r.path: (r.depth, r.ambiguous) for r in near.collect()} == first
