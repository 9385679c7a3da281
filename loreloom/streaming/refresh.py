"""Keeping an index of chunks up to date with the notes: snapshot differences and a stream of changes.

Two tables: files (path, mtime_ms, content_hash, chunk_count, updated_at) and chunks (id,
file_path, chunk_index, heading, text, content_preview, embedding), which semantic search
reads as they are. They are kept as a log. Rows lie in buckets by a hash of their path; a
refresh writes the rows of the notes that changed, and a mark for those that went, to a new
folder, which has files for the buckets it touches and no others. A version is one small
manifest: which folders hold for each bucket, and since when. Readers take the folders of
the last manifest, and of each path the rows of the latest version. A bucket with more than
``DELTAS`` folders is merged into one.

Manifests are those of ``versions``: two writers never take the same version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chunking import note_chunks
from ..operators.vector import Embedder, embedded, hash_embedder
from ..sources.shared import brief_shuffles
from ..sources.vault import SCHEMA as NOTES
from .versions import Conflict as Conflict
from .versions import Versions

FILES = "path string, mtime_ms long, content_hash string, chunk_count long, updated_at string"
#: Folders of a bucket from which it is merged.
DELTAS = 8
CHUNKS = "id long, file_path string, chunk_index int, heading string, text string, content_preview string, embedding array<float>"


def difference(notes: DataFrame, files: DataFrame) -> DataFrame:
    """path and change (new, changed, deleted) of notes (path, mtime_ms) against the indexed files."""
    a, b = notes.select("path", F.col("mtime_ms").alias("now")), files.select("path", F.col("mtime_ms").alias("then"))
    change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def to_index(notes: DataFrame, files: DataFrame, by_time: bool = True) -> DataFrame:
    """The notes whose content is new: changed by time (unless all are known to be changed) and by hash. A changed time alone isn't stored."""
    hashed = notes.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    known = files.select("path", F.col("mtime_ms").alias("then"), F.col("content_hash").alias("old_hash"))
    joined = hashed.join(known, "path", "left")
    if by_time:
        joined = joined.where(F.col("then").isNull() | (F.col("then") != F.col("mtime_ms")))
    return joined.where(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("content_hash"))).drop("then", "old_hash")


def indexed(fresh: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """The embedded chunks of notes, in the columns of ``CHUNKS``."""
    made = note_chunks(fresh).withColumnsRenamed({"path": "file_path", "preview": "content_preview"}).withColumn("id", F.xxhash64("file_path", "chunk_index"))
    return embedded(made, "text", embedder or hash_embedder()).select(*(x.split()[0] for x in CHUNKS.split(", ")))


def stats(notes: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: indexed_files, total_chunks, vault_files, last_sync."""
    return files.agg(F.count("*").alias("indexed_files"), F.max("updated_at").alias("last_sync")).crossJoin(F.broadcast(chunks.agg(F.count("*").alias("total_chunks")))).crossJoin(F.broadcast(notes.agg(F.count("*").alias("vault_files"))))  # single rows


class Index(Versions):
    """An index in a folder of shared storage; any number of writers and readers may use it."""

    TABLE, ROWS = "chunks", CHUNKS

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None, buckets: int = 64):
        super().__init__(spark, folder)
        self.embedder, self.buckets = embedder, buckets

    def _first(self) -> dict:
        return {"buckets": self.buckets}

    # --- what the table holds of a note

    def _made(self, fresh: DataFrame) -> DataFrame:
        """The rows of fresh notes."""
        return indexed(fresh, self.embedder)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """The table's rows as they are stored, those of a bucket together."""
        return rows.hint("rebalance", "bucket")

    def _counted(self, fresh: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The fresh notes that get into the index, and how many rows each has (path, chunk_count)."""
        counts = made.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("chunk_count"), F.bool_or(F.col("embedding").isNull()).alias("refused"))
        return fresh.join(counts.where("refused").select("path"), "path", "left_anti"), counts.drop("refused")

    def _empty(self) -> Column:
        """Whether a note with this chunk_count is dropped."""
        return F.col("chunk_count").isNull()

    # --- reading

    def _rows(self, table: str, schema: str, manifest: dict, buckets: Iterable[str] | None = None) -> DataFrame:
        """Rows of a table with the version of their folder, of some buckets or all."""
        live = {b: f for b, f in manifest["live"].items() if buckets is None or b in buckets}
        paths = [f"{self.folder}/data/{name}/{table}/bucket={b}" for b, folders in live.items() for _, name, tables in folders if table in tables]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, version long").where(F.lit(False))  # the planner sees that it is empty
        versions = sorted({(name, v) for folders in live.values() for v, name, _ in folders})  # DELTAS a bucket at most
        known = F.create_map(*(F.lit(x) for pair in versions for x in pair))
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1)
        return self.spark.read.schema(schema).parquet(*paths).select("*", known[name].cast("long").alias("version"))

    def _latest(self, manifest: dict, buckets: Iterable[str] | None = None) -> DataFrame:
        """The files' rows that hold, marks of gone ones among them."""
        rows = self._rows("files", f"{FILES}, gone boolean", manifest, buckets)
        whole = F.struct(*(c for c in rows.columns if c not in ("path", "version")))
        return rows.groupBy("path").agg(F.max_by(whole, "version").alias("row"), F.max("version").alias("version")).select("path", "row.*", "version")

    def _last(self, manifest: dict, buckets: Iterable[str] | None = None) -> DataFrame:
        """file_path and version of the notes that are there."""
        rows = self._rows("files", f"{FILES}, gone boolean", manifest, buckets).groupBy(F.col("path").alias("file_path"))
        return rows.agg(F.max_by("gone", "version").alias("gone"), F.max("version").alias("version")).where("NOT gone").drop("gone")

    def _held(self, manifest: dict, buckets: Iterable[str] | None = None) -> DataFrame:
        """The table's rows that hold."""
        last = self._last(manifest, buckets)
        return self._rows(self.TABLE, self.ROWS, manifest, buckets).join(last, ["file_path", "version"]).select(*(x.split()[0] for x in self.ROWS.split(", ")))

    def files(self, version: int | None = None) -> DataFrame:
        return self._latest(self._manifest(self.version() if version is None else version)).where("NOT gone").drop("gone", "version")

    def chunks(self, version: int | None = None) -> DataFrame:
        return self._held(self._manifest(self.version() if version is None else version))

    # --- writing

    def _written(self, table: str, rows: DataFrame, path: str, name: str, buckets: int) -> list[str]:
        """Write rows to the buckets they touch and name these; a bucket with very many rows is split over tasks."""
        bucket = F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")
        to, own = f"data/{name}/{table}", rows.withColumn("bucket", bucket)
        placed = self._placed(own) if table == self.TABLE else own.hint("rebalance", "bucket")
        with brief_shuffles(self.spark):
            placed.sortWithinPartitions("bucket", placed.columns[0]).write.partitionBy("bucket").parquet(f"{self.folder}/{to}")
        return [n.removeprefix("bucket=") for n in (s.getPath().getName() for s in self._store().listStatus(self._path(to))) if n.startswith("bucket=")]

    def apply(self, fresh: DataFrame, removed: DataFrame) -> int:
        """Index fresh notes (with content_hash) in place of their rows, and drop removed paths; the version that has this.

        A note without chunks is dropped. Only fresh notes are embedded; one of which the embedder
        refuses a chunk keeps its rows as they were, and the next refresh tries it again. Where nothing changes, nothing stays written.
        """
        name, buckets = uuid.uuid4().hex, self._manifest(self.version())["buckets"]
        chunked = self._written(self.TABLE, self._made(fresh), "file_path", name, buckets)
        made = self.spark.read.schema(self.ROWS).parquet(f"{self.folder}/data/{name}/{self.TABLE}") if chunked else self.spark.createDataFrame([], self.ROWS)
        fresh, counts = self._counted(fresh, made)
        own = fresh.join(counts, "path", "left").select("path", "mtime_ms", "content_hash", "chunk_count", F.lit(datetime.now(UTC).isoformat()).alias("updated_at"), self._empty().alias("gone"))
        away = removed.select("path").distinct().join(fresh.select("path"), "path", "left_anti")
        touched = self._written("files", own.unionByName(away.withColumn("gone", F.lit(True)), allowMissingColumns=True), "path", name, buckets)
        if not touched:
            self._store().delete(self._path(f"data/{name}"), True)
            return self.version()

        def add(manifest: dict) -> None:
            for b in touched:
                manifest["live"].setdefault(b, []).append([manifest["version"], name, ["files", *[self.TABLE] * (b in chunked)]])

        version = self._commit(add)
        return self.compact(DELTAS) or version

    def compact(self, most: int = 1) -> int | None:
        """Merge the folders of every bucket that has more than ``most`` of them; the new version, if any.

        What other writers add meanwhile stays after what was merged.
        """
        manifest = self._manifest(self.version())
        read = manifest["version"]
        old = {b: folders for b, folders in manifest["live"].items() if len(folders) > most}
        if not old:
            return None
        name = uuid.uuid4().hex
        chunked = self._written(self.TABLE, self._held(manifest, old), "file_path", name, manifest["buckets"])
        filed = self._written("files", self._latest(manifest, old).where("NOT gone").drop("version"), "path", name, manifest["buckets"])

        def replace(manifest: dict) -> None:
            for b, folders in old.items():
                self._merge(manifest, b, folders, [[read, name, ["files", *[self.TABLE] * (b in chunked)]]] if b in filed else [])

        return self._commit(replace)

    def sync(self, notes: DataFrame) -> int:
        """Bring the index to a snapshot of all notes: new, changed and deleted ones."""
        files = self.files()
        deleted = difference(notes, files).where("change = 'deleted'").select("path")
        return self.apply(to_index(notes, files), deleted)

    def follow(self, changes: DataFrame, checkpoint: str, present: Callable[[], DataFrame] | None = None, **trigger) -> StreamingQuery:
        """Index a stream of notes; the latest row of a path in a batch counts, and one without content drops the path.

        For streams that don't tell of deleted files: with ``present``, which lists the paths there
        are now, each batch also drops those that are gone.
        """

        def batch(rows: DataFrame, _: int) -> None:
            order = F.struct(F.col("content").isNull(), "mtime_ms")  # what is gone has no time; where it came again, the next batch says so
            last = rows.groupBy("path").agg(F.max_by(F.struct("content", "mtime_ms", "size"), order).alias("row")).select("path", "row.*")
            files = self.files()
            fresh = to_index(last.where("content IS NOT NULL"), files, by_time=False)
            gone = last.where("content IS NULL").select("path").join(files.select("path"), "path", "left_semi")
            if present is not None:
                gone = gone.unionByName(files.select("path").join(present().select("path"), "path", "left_anti"))
            self.apply(fresh, gone)

        return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class PartIndex(Index):
    """An index of parts of notes that aren't embedded; it also holds notes without any."""

    def _counted(self, fresh: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
        return fresh, made.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("chunk_count"))

    def _empty(self) -> Column:
        return F.lit(False)


def settled(changes: DataFrame, wait_ms: int = 2_000) -> DataFrame:
    """The last row of each path, once no other has come for ``wait_ms``: a timer for every path.

    State holds a path's last row until its timer fires. Rows that come together count in
    the order of their time; a deleted note's row (no content, no time) is the last of them.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            content, mtime, size = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "content": [content], "mtime_ms": pd.array([mtime], "Int64"), "size": pd.array([size], "Int64")})
            return
        rows = [r for b in batches for r in zip(b["content"], b["mtime_ms"], b["size"], strict=True)]
        content, mtime, size = max(rows, key=lambda r: (r[0] is None, 0 if pd.isna(r[1]) else r[1]))
        state.update((content, None if pd.isna(mtime) else int(mtime), None if pd.isna(size) else int(size)))
        state.setTimeoutDuration(wait_ms)

    return changes.groupBy("path").applyInPandasWithState(run, NOTES, "content string, mtime_ms long, size long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of notes from Parquet files that arrive in a folder (path, content, mtime_ms, size)."""
    return spark.readStream.schema(NOTES).parquet(folder)
