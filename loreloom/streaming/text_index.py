"""An index of three-character pieces, kept by the refresh like that of chunks: a text search reads only notes that can match.

A note that contains a text contains every three characters in a row of it, in any case. The
postings say for each such piece, by its hash, which notes have it; those with all pieces of
the text are candidates, and the search proper looks at no others. So results are those of a
search of all notes, whatever the hashes do.

Postings are kept by blocks of notes of one bucket. A block has a row that lists its notes, and
a row for each piece with the places of its notes in that list: about a byte for each piece of
a note. A task makes blocks of the notes that it reads, these are exchanged packed, and those of a
bucket that meet are merged. Rows of a bucket are sorted by piece, so that a reader skips most pages of a file.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog
from .refresh import PartIndex

GRAM = 3
#: Characters of notes that a task holds, those of a packed block, and pieces of notes in a merged one; one note may have more.
HELD, CHARS, PAIRS = 16 << 20, 4 << 20, 1 << 20
#: Candidates up to which their paths are a condition on the notes, which a source of files takes over; more are joined.
LISTED = 1_000
PACKED = "file_path string, paths array<string>, grams binary, counts binary, notes binary"
_LOW = np.uint64(2**32 - 1)


def hashes(points: np.ndarray) -> np.ndarray:
    """For each three code points in a row a hash of 32 bits (in uint64)."""
    c = points.astype(np.uint64)
    return (((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def keys(texts: list[str]) -> np.ndarray:
    """The distinct pairs of a piece's hash (high 32 bits) and the place of a text that has it, in order."""
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) for t in texts])
    if len(owner) < GRAM:
        return np.empty(0, np.uint64)
    own = owner[2:]
    pairs = ((hashes(_points("".join(texts))) << np.uint64(32)) | own)[own == owner[:-2]]
    return _distinct(pairs)


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs.sort()
    return pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] if len(pairs) else pairs


def _widths(values: np.ndarray) -> np.ndarray:
    """How many bytes each number takes in ``numbers``."""
    out = np.ones(len(values), np.uint8)
    for k in range(1, 5):
        out += values >= 1 << 7 * k
    return out


def numbers(values: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 35 in bytes of 7 bits each, low ones first; all bytes of a number but its last have the high bit."""
    v = values.astype(np.uint64)
    length = _widths(v)
    at = np.cumsum(length, dtype=np.int64) - length
    out = np.empty(int(length.sum(dtype=np.int64)), np.uint8)
    for k in range(5):
        has = np.flatnonzero(length > k)
        if not len(has):
            break
        out[at[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)) | (np.uint64(128) * (length[has] > k + 1))
    return out


def read_numbers(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(5):
        has = np.flatnonzero(begins + k <= ends)
        if not len(has):
            break
        out[has] |= (b[begins[has] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def _lists(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs in order: the pieces, where the list of each begins, and the places, each as its distance from the one before in its list."""
    grams, places = pairs >> np.uint64(32), (pairs & _LOW).astype(np.int64)
    begins = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(pairs) else np.empty(0, np.int64)
    gaps = np.diff(places, prepend=0)
    gaps[begins] = places[begins]
    return grams[begins], begins, gaps


def _places(gaps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of lists one after the other, from their distances."""
    sums, ends = np.cumsum(gaps.astype(np.int64)), np.cumsum(counts.astype(np.int64))
    before = np.concatenate(([0], sums[ends[:-1] - 1])) if len(ends) else ends
    return sums - np.repeat(before, counts.astype(np.int64))


def packed(pairs: np.ndarray) -> tuple[bytes, bytes, bytes]:
    grams, begins, gaps = _lists(pairs)
    counts = np.diff(begins, append=len(pairs))
    return tuple(numbers(x).tobytes() for x in (np.diff(grams, prepend=np.uint64(0)), counts, gaps))


def unpacked(grams: bytes, counts: bytes, notes: bytes) -> np.ndarray:
    sizes = read_numbers(counts)
    own = np.repeat(np.cumsum(read_numbers(grams)), sizes.astype(np.int64))
    return (own << np.uint64(32)) | _places(read_numbers(notes), sizes).astype(np.uint64)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<struct<path:string,n:int>>": pa.list_(pa.struct([("path", pa.string()), ("n", pa.int32())]))}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(named)], [n for n, _ in named])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks (with bucket) of the notes that a task reads (bucket, file_path, text in lower case as bytes)."""
    held, chars = defaultdict(list), Counter()

    def flushed(bucket: int) -> pa.RecordBatch:
        own = held.pop(bucket)
        chars.pop(bucket)
        paths = [p for p, _ in own]
        return _batch([(paths[0], paths, *packed(keys([t for _, t in own])), bucket)], f"{PACKED}, bucket int")

    for batch in batches:
        for bucket, path, content in zip(batch["bucket"].to_pylist(), batch["file_path"].to_pylist(), batch["text"], strict=True):
            text = content.as_py().decode("utf-8", "replace")
            if len(text) >= GRAM:
                held[bucket].append((path, text))
                chars[bucket] += len(text)
                if chars[bucket] >= CHARS:
                    yield flushed(bucket)
                elif chars.total() >= HELD:
                    yield from map(flushed, list(held))
    yield from map(flushed, list(held))


def _stored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of merged blocks; packed blocks come in the order of their buckets."""
    bucket, paths, parts, size = None, [], [], 0

    def merged() -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate(parts)
        pairs.sort()
        block = uuid.uuid4().int >> 65
        has = np.bincount((pairs & _LOW).astype(np.int64), minlength=len(paths))
        names = [{"path": p, "n": int(n)} for p, n in zip(paths, has, strict=True)]
        yield _batch([(None, block, None, names, bucket)], f"{TextIndex.ROWS}, bucket int")
        grams, begins, gaps = _lists(pairs)
        offsets = np.concatenate(([0], np.cumsum(np.add.reduceat(_widths(gaps), begins, dtype=np.int64)))).astype(np.int32)
        n = len(grams)
        lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(numbers(gaps))])
        columns = [pa.array(grams.astype(np.uint32).view(np.int32)), pa.array(np.full(n, block, np.int64)), lists, pa.nulls(n, pa.list_(pa.struct([("path", pa.string()), ("n", pa.int32())]))), pa.array(np.full(n, bucket, np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["gram", "block", "notes", "paths", "bucket"])

    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            own = unpacked(row["grams"], row["counts"], row["notes"])
            if parts and (row["bucket"] != bucket or size + len(own) > PAIRS):
                yield from merged()
                paths, parts, size = [], [], 0
            bucket, size = row["bucket"], size + len(own)
            parts.append(own + np.uint64(len(paths)))
            paths += row["paths"]
    if parts:
        yield from merged()


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks of the notes that are still there (lists, alive)."""
    for batch in batches:
        for lists, alive in zip(batch["lists"], batch["alive"], strict=True):
            alive, lists = sorted((x["place"], x["file_path"]) for x in alive.as_py()), lists.as_py()
            paths, old = [p for _, p in alive], np.array([k for k, _ in alive], np.int64)
            grams = np.array([x["gram"] for x in lists], np.int32).view(np.uint32).astype(np.uint64)
            each = [read_numbers(x["notes"]) for x in lists]
            counts = np.array([len(x) for x in each], np.int64)
            places = _places(np.concatenate(each), counts)
            at = np.searchsorted(old, places)
            there = old[np.minimum(at, len(old) - 1)] == places
            pairs = ((np.repeat(grams, counts) << np.uint64(32)) | at.astype(np.uint64))[there]
            yield _batch([(paths[0], paths, *packed(_distinct(pairs)))], PACKED)


def _common(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places that all lists of a block have."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            each = [np.cumsum(read_numbers(x)) for x in row["lists"]]
            common, n = np.unique(np.concatenate(each), return_counts=True)
            rows.append((row["version"], row["block"], common[n == len(each)].astype(np.int32)))
        if rows:
            yield _batch(rows, "version long, block long, places array<int>")


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            pairs = unpacked(row["grams"], row["counts"], row["notes"])
            grams, places = (pairs >> np.uint64(32)).astype(np.uint32).view(np.int32), (pairs & _LOW).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(row["paths"], pa.string()).take(pa.array(places))], ["gram", "file_path"])


class TextIndex(PartIndex):
    """An index of the pieces of all notes."""

    TABLE, ROWS = "pieces", "gram int, block long, notes binary, paths array<struct<path:string,n:int>>"

    def _manifest(self, version: int) -> dict:
        manifest = super()._manifest(version)
        if any("grams" in tables for folders in manifest["live"].values() for *_, tables in folders):
            raise RuntimeError(f"{self.folder} has rows for each piece of a note, as they were stored before blocks; it must be made anew")
        return manifest

    def _made(self, fresh: DataFrame) -> DataFrame:
        return fresh.select(F.col("path").alias("file_path"), F.lower("content").cast("binary").alias("text")).where("text IS NOT NULL")

    def _placed(self, rows: DataFrame) -> DataFrame:
        blocks = rows.select("bucket", "file_path", "text").mapInArrow(_blocks, f"{PACKED}, bucket int") if "text" in rows.columns else rows
        return blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket").mapInArrow(_stored, f"{self.ROWS}, bucket int")

    def _counted(self, fresh: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = made.where("gram IS NULL").select(F.explode("paths").alias("x")).select("x.path", "x.n")
        return fresh, own.groupBy("path").agg(F.sum("n").alias("chunk_count"))

    def _held(self, manifest: dict, buckets: Iterable[str] | None = None) -> DataFrame:
        rows = self._rows(self.TABLE, self.ROWS, manifest, buckets)
        listed = rows.where("gram IS NULL").select("version", "block", F.posexplode("paths").alias("place", "note")).withColumn("file_path", F.col("note.path"))
        alive = listed.join(self._last(manifest, buckets), ["file_path", "version"]).groupBy("version", "block").agg(F.collect_list(F.struct("place", "file_path")).alias("alive"))
        lists = rows.where("gram IS NOT NULL").groupBy("version", "block").agg(F.collect_list(F.struct("gram", "notes")).alias("lists"))
        return lists.join(alive, ["version", "block"]).select("lists", "alive").mapInArrow(_kept, PACKED)

    def chunks(self, version: int | None = None) -> DataFrame:
        """gram, file_path: the hashes of each note's distinct pieces."""
        return super().chunks(version).mapInArrow(_pieces, "gram int, file_path string")

    def candidates(self, query: str, folder: str | None = None) -> DataFrame | None:
        """path of the indexed notes that have every piece of the text; None where it has none."""
        points = _points(query.lower())
        if len(points) < GRAM:
            return None
        wanted = np.unique(hashes(points)).astype(np.uint32).view(np.int32).tolist()
        manifest = self._manifest(self.version())
        rows = self._rows(self.TABLE, self.ROWS, manifest)
        lists = rows.where(F.col("gram").isin(*wanted)).groupBy("version", "block").agg(F.collect_list("notes").alias("lists"))
        common = lists.where(F.size("lists") == len(wanted)).mapInArrow(_common, "version long, block long, places array<int>").where(F.size("places") > 0)
        named = rows.where("gram IS NULL").select("version", "block", F.col("paths.path").alias("paths"))
        have = common.join(named, ["version", "block"]).select("version", F.explode(F.transform("places", lambda k: F.col("paths")[k])).alias("file_path"))
        have = have.where(F.col("file_path").startswith(folder.rstrip("/") + "/")) if folder else have
        return have.join(self._last(manifest), ["file_path", "version"]).select(F.col("file_path").alias("path"))

    def search(self, notes: DataFrame, query: str, folder: str | None = None, limit: object = 10) -> DataFrame:
        """catalog.search(notes, ...), looking only at candidates; texts of fewer than three characters look at all.

        The first candidates by path are looked at first; all the others only where these hold too few.
        The notes must be those that were indexed last.
        """
        found = self.candidates(query, folder)
        if found is None:
            return catalog.search(notes, query, folder, limit)
        few = [r.path for r in found.orderBy("path").limit(LISTED + 1).collect()]
        own = notes.where(F.col("path").isin(*few))
        if len(few) > LISTED:
            n = catalog.positive(limit, 10)
            hits = [r.path for r in own.where(F.lower("content").contains(query.lower())).select("path").orderBy("path").limit(n).collect()] if n <= LISTED else []
            own = notes.where(F.col("path").isin(*hits)) if len(hits) == n else notes.join(found, "path", "left_semi")
        return catalog.search(own, query, folder, limit)
