"""The tools of a vault as methods that return DataFrames.

Read-only tools find notes and folders fuzzily; changing ones want exact paths and return
new frames, which the caller writes. Arguments carry the tools' names and defaults.
"""

from __future__ import annotations

import functools
import inspect
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import basename, body
from .operators import catalog, events, graph, mutate, reading, vector
from .operators import links as link_ops
from .streaming.link_index import LinkIndex
from .streaming.text_index import TextIndex


#: Candidates that an error names; the first two decide whether there is only one.
SHOWN = 20


def _only(asked: str, found: list[tuple[str, bool]]) -> str:
    """The only candidate, or the only better one; better ones come first."""
    if len(found) == 1 or found[0][1] and not found[1][1]:
        return found[0][0]
    raise ValueError(f"{asked} is ambiguous: {', '.join(f for f, _ in found)}{', ...' if len(found) == SHOWN else ''}")


def tool(f: Callable) -> Callable:
    """A method whose calls a stored log gets before they run. A log that can't be written warns and stops no call."""
    signature = inspect.signature(f)

    @functools.wraps(f)
    def call(self: Vault, *args, **kwargs):
        if isinstance(self.log, events.ActivityLog):
            given = dict(signature.bind(self, *args, **kwargs).arguments)
            given |= {k: v for name, p in signature.parameters.items() if p.kind is p.VAR_KEYWORD for k, v in given.pop(name, {}).items()}
            try:
                self.log.record(f"vault_{f.__name__}", {k: v for k, v in given.items() if k != "self"})
            except Exception as e:  # noqa: BLE001
                warnings.warn(f"activity log: {e}", stacklevel=2)
        return f(self, *args, **kwargs)

    return call


class Vault:
    """notes: path, content, mtime_ms, size. chunks and log are optional, as is another embedder.

    A log that is an ActivityLog also gets each call of a tool, apart from ``activity`` itself.
    Where there is a LinkIndex or a TextIndex of these notes, neighbourhoods and search read it.
    """

    def __init__(self, notes: DataFrame, chunks: DataFrame | None = None, log: DataFrame | events.ActivityLog | None = None, embedder: vector.Embedder | None = None, stored_links: LinkIndex | None = None, pieces: TextIndex | None = None):
        self.notes, self.chunks, self.log, self.embedder = notes, chunks, log, embedder or vector.hash_embedder()
        self.stored_links, self.pieces = stored_links, pieces

    # --- finding notes and folders

    def resolve_path(self, path: str, folder: str | None = None) -> str:
        """The path itself, with .md, or the only note of this name (below ``folder``, if several have it)."""
        exact = F.col("path").isin(path, f"{path}.md")
        named = F.lower(basename(F.col("path"))) == path.rsplit("/", 1)[-1].removesuffix(".md").lower()
        inside = F.col("path").startswith(folder.rstrip("/") + "/") if folder else F.lit(False)
        rows = self.notes.where(exact | named).select("path", (F.col("path") == path).alias("same"), exact.alias("exact"), inside.alias("better"))
        rows = rows.orderBy(F.desc("same"), F.desc("exact"), F.desc("better"), "path").limit(SHOWN).collect()
        if not rows:
            raise FileNotFoundError(path)
        return rows[0].path if rows[0].exact else _only(path, [(r.path, r.better) for r in rows])

    def resolve_folder(self, folder: str | None) -> str | None:
        """The folder itself, or the only one whose path contains the text in any case; an ending match settles a tie."""
        if not folder:
            return None
        name = folder.strip("/").lower()
        parts = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        all_ = self.notes.where(F.col("path").contains("/")).select(F.explode(above).alias("folder")).distinct()
        own = F.col("folder") == folder.strip("/")
        rows = all_.where(F.lower("folder").contains(name)).select("folder", own.alias("exact"), F.lower("folder").endswith(name).alias("better"))
        rows = rows.orderBy(F.desc("exact"), F.desc("better"), "folder").limit(SHOWN).collect()
        if not rows:
            raise ValueError(f"{folder} is not a folder")
        return rows[0].folder if rows[0].exact else _only(folder, [(r.folder, r.better) for r in rows])

    def _note(self, path: str) -> DataFrame:
        return self.notes.where(F.col("path") == self.resolve_path(path))

    def _around(self, path: str, depth: object, direction: str = "both") -> DataFrame:
        start = self._note(path).select("path")
        return self.stored_links.neighborhood(start, depth, direction) if self.stored_links else graph.neighborhood(self.notes, start, depth, direction)

    def _vector(self, text: str) -> list[float]:
        return [float(x) for x in self.embedder([text[:8_000]])[0]]

    def _chunks(self) -> DataFrame:
        if self.chunks is None:
            raise RuntimeError("semantic search needs an index of chunks")
        return self.chunks

    # --- reading

    @tool
    def read(self, path: str, heading=None, tail=None, tail_sections=None, section_level: int = 2, chunk=None, lines=None, force: bool = False) -> DataFrame:
        return reading.read(self._note(path), heading, tail, tail_sections, section_level, chunk, lines, force)

    @tool
    def peek(self, path: str) -> DataFrame:
        return reading.peek(self._note(path))

    @tool
    def search(self, query: str, folder: str | None = None, limit: object = 10) -> DataFrame:
        look = self.pieces.search if self.pieces else catalog.search
        return look(self.notes, query, self.resolve_folder(folder), limit)

    @tool
    def list(self, path: str = "", recursive: bool = False, pattern: str | None = None) -> DataFrame:
        return catalog.list_directory(self.notes, path, recursive, pattern)

    @tool
    def recent(self, limit: object = 10, folder: str | None = None) -> DataFrame:
        return catalog.recent(self.notes, limit, self.resolve_folder(folder))

    @tool
    def query(self, folder: str | None = None, limit: object = 50, sort_by: str | None = None, sort_order: str = "asc", **filters) -> DataFrame:
        return catalog.query(self.notes, self.resolve_folder(folder), limit, sort_by, sort_order, **filters)

    @tool
    def tags(self, folder: str | None = None, pattern: str | None = None, include_inline: bool = False) -> DataFrame:
        return catalog.tag_counts(self.notes, self.resolve_folder(folder), pattern, include_inline)

    # --- links and graph

    @tool
    def links(self, path: str, direction: str = "both") -> DataFrame:
        return link_ops.note_links(self.notes, self.resolve_path(path), direction)

    @tool
    def neighborhood(self, path: str, depth: object = 2, direction: str = "both", include_semantic: bool = False, semantic_limit: int = 5) -> DataFrame:
        """path, depth, ambiguous, meta; with include_semantic also score, of near notes outside (their depth is null)."""
        nodes = self._around(path, depth, direction)
        found = catalog.with_meta(nodes.join(self.notes.select("path", "content"), "path")).drop("content")
        if not include_semantic:
            return found
        return found.unionByName(self.semantic_neighbors(path, nodes, semantic_limit).drop("preview"), allowMissingColumns=True)

    def templates(self) -> DataFrame:
        return catalog.templates(self.notes)

    def semantic_neighbors(self, path: str, nodes: DataFrame, semantic_limit: int = 5) -> DataFrame:
        """Notes near in meaning and outside a neighbourhood, with their metadata."""
        row = self._note(path).select("path", body(F.col("content")).alias("body")).first()
        hits = vector.search_raw(self._chunks(), self._vector(row.body), 2 * semantic_limit, exclude=[row.path])
        far = vector.unlinked(hits, nodes).orderBy(F.desc("score"), "path").limit(semantic_limit)
        return catalog.with_meta(self.notes.join(F.broadcast(far), "path")).select("path", "score", "preview", "meta")  # a few hits

    @tool
    def link_health(self, folder: str | None = None, checks: tuple[str, ...] = link_ops.CHECKS, limit: int = 20) -> dict[str, DataFrame]:
        return link_ops.health(self.notes, self.resolve_folder(folder), tuple(checks), limit)

    # --- meaning

    @tool
    def semantic_search(self, query: str, limit: int = 5, folder: str | None = None, threshold: float | None = None, anchor: str | None = None, graph_weight: float = 0.3) -> DataFrame:
        folder, vec = self.resolve_folder(folder), self._vector(query)
        if anchor is None:
            return vector.search_raw(self._chunks(), vec, limit, folder, threshold)
        path = self.resolve_path(anchor)
        hits = vector.search_raw(self._chunks(), vec, 2 * limit, folder, threshold, [path])
        return vector.blend(hits, self._around(path, 3), graph_weight, limit)

    @tool
    def suggest_links(self, content: str | None = None, path: str | None = None, limit: int = 5, folder: str | None = None, threshold: float | None = None, graph_context: bool = False) -> DataFrame:
        if not content and not path:
            raise ValueError("content or path is needed")
        if graph_context and not path:
            raise ValueError("graph_context needs a path")
        own = self.resolve_path(path) if path else None
        text = content or self.notes.where(F.col("path") == own).select(body(F.col("content"))).first()[0]
        hits = vector.search_raw(self._chunks(), self._vector(text), limit * (5 if graph_context else 3), self.resolve_folder(folder), threshold, [own] if own else None)
        raw = link_ops.outgoing(self.notes.where(F.col("path") == own)) if own else link_ops.outgoing(self.notes.limit(0))
        names = raw.select(F.lower(basename(F.col("raw"))).alias("name"))
        if not graph_context:
            return vector.suggestions(hits, names, limit)
        blended = vector.blend(vector.suggestions(hits, names, 5 * limit), self._around(own, 2), 0.3, limit)
        return blended.withColumn("missing_link", F.col("depth").isNull())

    # --- activity

    def activity(self, action: str = "query", **args) -> DataFrame:
        """Entries that match (query), or what clearing leaves (clear); a stored log is cleared, another only shown so."""
        if self.log is None:
            raise RuntimeError("no activity log")
        if isinstance(self.log, events.ActivityLog):
            if action != "clear":
                return self.log.query(**args)
            self.log.clear(**args)
            return self.log.read()
        if action == "clear":
            return events.kept_after_clear(self.log, **args)
        return events.query(self.log, **args)

    # --- changes; each returns the new notes

    @tool
    def write(self, path: str, template: str, variables: dict | None = None, frontmatter: dict | None = None) -> DataFrame:
        """A note from the template of this name in 05-Templates."""
        row = self.notes.where(F.col("path") == f"05-Templates/{template.removesuffix('.md')}.md").select("content").first()
        if row is None:
            raise FileNotFoundError(f"template {template}")
        title = path.rsplit("/", 1)[-1].removesuffix(".md")
        return mutate.write(self.notes, path, mutate.rendered(row.content, title, variables, frontmatter))

    @tool
    def append(self, path: str, content: str, heading: str | None = None, position: str | None = None) -> DataFrame:
        return mutate.append(self.notes, path, content, heading, position)

    @tool
    def edit(self, path: str, old_string: str, new_string: str) -> DataFrame:
        return mutate.edit(self.notes, path, old_string, new_string)

    @tool
    def update_frontmatter(self, path: str, fields: dict) -> DataFrame:
        return mutate.update_frontmatter(self.notes, path, fields)

    @tool
    def move(self, old_path: str, new_path: str, update_links: bool = True) -> DataFrame:
        return mutate.move(self.notes, old_path, new_path, update_links)

    @tool
    def trash(self, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return mutate.trash(self.notes, path)

    @tool
    def add_links(self, path: str, links: list[dict], section: str = "## Related", create_section: bool = True) -> DataFrame:
        rows = [(path, i, x["target"], x.get("annotation")) for i, x in enumerate(links)]
        wanted = self.notes.sparkSession.createDataFrame(rows, "path string, pos int, target string, annotation string")
        return mutate.add_links(self.notes, wanted, section, create_section)
