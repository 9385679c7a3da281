"""A tree of markdown files as a Spark data source.

Spark's own file sources leave out names that start with ``_`` or ``.``; a vault needs
``_index.md`` and keeps ``.name.md``. Directories that start with a dot and symbolic links
are skipped. The tree must be on storage that the executors mount.

    spark.dataSource.register(VaultSource)
    spark.read.format("vault").option("folder", "01-Projects").load("/path/to/vault")

The driver looks at the first levels only; tasks list what lies below. With
``spark.sql.python.filterPushdown.enabled`` (``read_vault`` sets it) conditions that name a
path, several, or how it begins decide which folders are listed at all.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith

SCHEMA = "path string, content string, mtime_ms long, size long"
FILES_A_TASK = 500
#: Folders from which on the driver leaves listing to the tasks, and levels that it looks at.
FOLDERS, LEVELS = 64, 4


@dataclass
class Files(InputPartition):
    """Notes, a folder that the task lists, and paths of the files that went (streams only)."""

    paths: list[str]
    folder: str | None = None
    gone: tuple[str, ...] = ()


def _entries(root: str, folder: str) -> tuple[list[str], list[str]]:
    """Folders and notes right below a folder; no links, no dot directories."""
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            entries = [(os.path.join(folder, e.name), e.is_dir(follow_symlinks=False)) for e in found if not e.is_symlink()]
    except (FileNotFoundError, NotADirectoryError):
        return [], []
    return sorted(p for p, d in entries if d and not os.path.basename(p).startswith(".")), sorted(p for p, d in entries if not d and p.endswith(".md"))


@dataclass
class Wanted:
    """What conditions leave: paths (None: any) that all begin with each of some texts."""

    paths: frozenset[str] | None = None
    starts: tuple[str, ...] = ()

    def take(self, f: Filter) -> bool:
        """Whether a condition is wholly one on the path, which is then taken over."""
        if getattr(f, "attribute", None) != ("path",):
            return False
        if isinstance(f, (EqualTo, EqualNullSafe)) and isinstance(f.value, str):
            own = frozenset([f.value])
        elif isinstance(f, In) and all(isinstance(v, str) for v in f.value):
            own = frozenset(f.value)
        elif isinstance(f, StringStartsWith):
            self.starts += (f.value,)
            return True
        else:
            return False
        self.paths = own if self.paths is None else self.paths & own
        return True

    def note(self, path: str) -> bool:
        return (self.paths is None or path in self.paths) and all(path.startswith(s) for s in self.starts)

    def below(self, folder: str) -> bool:
        """Whether a folder can hold what is wanted."""
        inside = folder + "/"
        return all(inside.startswith(s) or s.startswith(inside) for s in self.starts) and (self.paths is None or any(p.startswith(inside) for p in self.paths))


def listed(root: str, folder: str = "", recursive: bool = True) -> list[str]:
    """Vault-relative paths of the markdown files, ascending; no links, no dot directories."""
    found = []
    for top, directories, names in os.walk(os.path.join(root, folder)):
        directories[:] = [d for d in directories if recursive and not d.startswith(".") and not os.path.islink(os.path.join(top, d))]
        found += [os.path.relpath(os.path.join(top, n), root) for n in names if n.endswith(".md") and not os.path.islink(os.path.join(top, n))]
    return sorted(found)


def _row(root: str, path: str) -> tuple | None:
    """None for a file that went between listing and reading."""
    try:
        with open(os.path.join(root, path), encoding="utf-8", errors="replace", newline="") as f:
            content, stat = f.read(), os.fstat(f.fileno())
    except FileNotFoundError:
        return None
    return path, content, int(stat.st_mtime_ns // 1_000_000), stat.st_size


def _rows(root: str, paths: Iterable[str]) -> Iterator[tuple]:
    for path in paths:
        if (row := _row(root, path)) is not None:
            yield row


class VaultSource(DataSource):
    """Options: path, folder (only below it), recursive (true)."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VaultReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return VaultStream(self.options)


class VaultReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        folder = os.path.relpath(os.path.join(self.root, options.get("folder", "")), self.root)
        self.folder, self.recursive = "" if folder == os.curdir else folder, str(options.get("recursive", "true")).lower() != "false"
        if folder.split(os.sep)[0] == os.pardir:
            raise ValueError(f"outside the vault: {self.folder}")
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Files]:
        """Notes near the top, and folders, a level deeper while they are few."""
        folders, notes = [self.folder], []
        for _ in range(LEVELS if self.recursive else 1):
            if not folders or len(folders) >= FOLDERS:
                break
            further: list[str] = []
            for folder in folders:
                below, own = _entries(self.root, folder)
                notes += filter(self.wanted.note, own)
                further += filter(self.wanted.below, below)
            folders = further if self.recursive else []
        parts = [Files(notes[i : i + FILES_A_TASK]) for i in range(0, len(notes), FILES_A_TASK)]
        return parts + [Files([], f) for f in folders] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from _rows(self.root, partition.paths)
        folders = [] if partition.folder is None else [partition.folder]
        while folders:
            below, notes = _entries(self.root, folders.pop())
            folders += filter(self.wanted.below, below)
            yield from _rows(self.root, filter(self.wanted.note, notes))


class VaultStream(DataSourceStreamReader):
    """New and changed files, and with ``state`` deleted ones: rows without content.

    Any difference in time or size counts, so a file that arrives with an old time is read.
    The driver lists; executors read. ``state`` names a folder that outlives the query, for
    one query alone: listings are kept there, the last two, and an offset is the number of
    one. Without it the offset is the listing itself, which grows with the number of files.
    """

    def __init__(self, options: dict):
        self.root, self.state = options["path"], options.get("state")
        self.known: tuple[int, dict[str, list[int]]] | None = None

    def _listing(self) -> dict[str, list[int]]:
        found = {}
        for path in listed(self.root):
            try:
                stat = os.stat(os.path.join(self.root, path))
            except FileNotFoundError:
                continue
            found[path] = [stat.st_mtime_ns, stat.st_size]
        return found

    def _file(self, version: int) -> str:
        return os.path.join(self.state, f"listing-{version:012}")

    def _at(self, offset: dict) -> dict[str, list[int]]:
        if "files" in offset:
            return _unpacked(offset["files"])
        version = offset["version"]
        if not version:
            return {}
        if self.known is None or self.known[0] != version:
            with open(self._file(version), encoding="ascii") as f:
                return _unpacked(f.read())
        return self.known[1]

    def initialOffset(self) -> dict:
        return {"version": 0} if self.state else {"files": _packed({})}

    def latestOffset(self) -> dict:
        now = self._listing()
        if not self.state:
            return {"files": _packed(now)}
        os.makedirs(self.state, exist_ok=True)
        last = max((int(n.removeprefix("listing-")) for n in os.listdir(self.state) if n.startswith("listing-")), default=0)
        if not last or self._at({"version": last}) != now:
            last += 1
            with open(draft := os.path.join(self.state, ".draft"), "w", encoding="ascii") as f:
                f.write(_packed(now))
            os.replace(draft, self._file(last))
        self.known = last, now
        return {"version": last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        before, now = self._at(start), self._at(end)
        paths = [p for p, seen in now.items() if before.get(p) != seen]
        gone = sorted(before.keys() - now.keys()) if self.state else []
        parts = [Files(paths[i : i + FILES_A_TASK]) for i in range(0, len(paths), FILES_A_TASK)]
        return parts + [Files([], None, tuple(gone[i : i + FILES_A_TASK])) for i in range(0, len(gone), FILES_A_TASK)]

    def commit(self, end: dict) -> None:
        """Forget the listings that no batch can ask for again: all but that of this offset and later ones."""
        if self.state:
            for name in os.listdir(self.state):
                if name.startswith("listing-") and int(name.removeprefix("listing-")) < end["version"] - 1:
                    os.remove(os.path.join(self.state, name))

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from _rows(self.root, partition.paths)
        yield from ((path, None, None, None) for path in partition.gone)


def _packed(files: dict[str, list[int]]) -> str:
    return base64.b64encode(zlib.compress(json.dumps(files, sort_keys=True).encode())).decode()


def _unpacked(files: str) -> dict[str, list[int]]:
    return json.loads(zlib.decompress(base64.b64decode(files)))


def watch_vault(spark: SparkSession, root: str, state: str) -> DataFrame:
    """A stream of the notes that come, change or go (no content); see VaultStream for ``state``."""
    spark.dataSource.register(VaultSource)
    return spark.readStream.format("vault").option("state", state).load(root)


def read_vault(spark: SparkSession, root: str, folder: str = "") -> DataFrame:
    """The notes below ``root``: path, content, mtime_ms, size."""
    spark.dataSource.register(VaultSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("vault").option("folder", folder).load(root)
