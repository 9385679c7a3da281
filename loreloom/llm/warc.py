"""Operator 2: WARC archives, written with revisit records and read by byte ranges.

Writing: every page becomes one gzip member with one record. Of pages whose payloads
are equal and at least ``MIN_REVISIT`` bytes long, those with the smallest page_id are
response records; the others are revisit records that name it and hold no payload.

Reading is splittable: a task gets a byte range of a file, looks for the gzip magic,
takes a candidate as a record only if it decodes to a WARC version line and header lines of
any length that name a type and a length, and owns the records that start inside its range, reading
past the end to finish the last. Archives of other programs are read too: records of every
type, with whatever identifiers. Inside a record nothing is searched, so a payload that looks like a record is not one,
unless a range begins in the middle of it and it is stored uncompressed.

Damage is never passed over: where something else than a sound member follows a member, or
begins a file, reading fails, or gives a row that says where, and goes on at the next sound
record. A member that decodes to its end but holds no record is left out. A record is held
whole by the task that reads it, whatever its length.

Defined results: a null payload counts as empty; a null url is left out; payloads
shorter than the limit are always responses; rows that share the smallest page_id are
all responses; pages without page_id never count as the smallest, and refer to it if
there is one; an empty table gives no archive and no rows. Further columns are ignored.
Reading gives page_id and refers_to only for identifiers that this writer makes; the
payload of a response or request is what follows its HTTP header, that of other types the
whole block, and null for revisits; header lines without a colon are passed over.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import chunks, shared_dir

MIN_REVISIT = 100
#: Ways that the pages of one digest are split when they look up its first page.
SALTS = 16
SPLIT_BYTES, MAX_TASKS = 8 << 20, 100_000
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null for responses).

    Equal payloads meet by digest in a join whose one side has ``SALTS`` rows for each
    digest that pages share, so that a hot digest's pages are split over as many keys. Short
    payloads have keys of their own.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    firsts = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("key")).agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))
    firsts = firsts.where("pages > 1").select("key", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    key = F.when(F.col("payload_bytes") >= min_bytes, F.col("payload_digest")).otherwise(F.concat(F.lit("short-"), F.coalesce(F.col("page_id"), F.lit(-1)).cast("string")))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    joined = rows.withColumns({"key": key, "salt": salt}).join(firsts, ["key", "salt"], "left")
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def _record(page_id, url, payload, size, digest, refers_to, date: str) -> bytes:
    name = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write archives below ``path`` (shared storage) and return their list: file, bytes, records.

    Each task attempt writes a file under a name of its own. Only names that the list has,
    which Spark commits one attempt at a time, belong to the archive, so lost executors
    and repeated attempts leave nothing that a reader would see twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        file = f"{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        for whole in batches:
            for batch in chunks(whole, "payload"):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        out = store.open_output_stream(f"{folder}/{file}", compression=None)
                    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = gz.compress(_record(*row, date)) + gz.flush()
                    out.write(member)
                    size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.record_batch([[f"{path}/{file}"], pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["file", "bytes", "records"])

    schema = "file string, bytes long, records long"
    with_record_types(pages).mapInArrow(run, schema).write.parquet(f"{path}-list")
    return pages.sparkSession.read.schema(schema).parquet(f"{path}-list")


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """file and bytes of archives that other programs wrote; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


class _Window:
    """A sliding view of a file from some offset."""

    def __init__(self, file, at: int, step: int = 1 << 18):
        self.file, self.start, self.data, self.step, self.ended = file, at, bytearray(), step, False
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(self.step)
        self.data += got
        self.ended = not got
        return bool(got)

    def drop(self, to: int) -> None:
        del self.data[: to - self.start]
        self.start = to


def _fields(head: bytes) -> dict[str, str] | None:
    """Header fields by lower-case name; None if this is no WARC header."""
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def _member(view: _Window, at: int, whole: bool = True) -> tuple[bytes | None, int] | None:
    """The record whose gzip member starts at this offset and where it ends; no record for other content, None if nothing sound starts here.

    A header may have any length. Without ``whole`` a sound header is enough.
    """
    gz, out, begin = zlib.decompressobj(31), bytearray(), at
    head, other = -1, False
    try:
        while not gz.eof:
            part = bytes(view.data[begin - view.start :])
            if not part:
                if not view.more():
                    return None
                continue
            seen, begin = len(out), begin + len(part)
            got = gz.decompress(part)
            if other:
                continue
            out += got
            if head < 0 and len(out) >= 5:
                if not out.startswith(b"WARC/"):
                    other, out = True, bytearray()
                elif (head := out.find(b"\r\n\r\n", max(0, seen - 3))) >= 0:
                    if (fields := _fields(bytes(out[:head]))) is None:
                        return None
                    if not whole:
                        return b"", begin
    except zlib.error:
        return None
    end = begin - len(gz.unused_data)
    if other or not out.startswith(b"WARC/"):
        return None, end
    return (bytes(out), end) if head >= 0 and len(out) >= head + 4 + int(fields["content-length"]) else None


def records_in_range(file, begin: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """Offset and content of the records that start in [begin, end), and offsets (without content) from which on bytes are in no member.

    Members follow each other. So behind a member, and at the start of a file, what isn't one
    is damage, which the range of the member before it tells of, even past its own end.
    """
    view, at, follows = _Window(file, begin), begin, begin == 0
    while follows or at < end:
        if follows:
            while at - view.start >= len(view.data):
                if not view.more():
                    return
            got = _member(view, at, whole=at < end)
            if got is None:
                yield at, None
                at, follows = at + 1, False
            elif at >= end:
                return
        else:
            found = view.data.find(MAGIC, at - view.start)
            if found < 0:
                at = max(at, view.start + len(view.data) - len(MAGIC) + 1)
                view.drop(min(at, view.start + len(view.data)))
                if at >= end or not view.more():
                    return
                continue
            at = view.start + found
            if at >= end:
                return
            view.drop(at)
            got = _member(view, at)
            if got is None or got[0] is None:
                at += 1
                continue
        if got is not None:
            if got[0] is not None:
                yield at, got[0]
            at, follows = got[1], True
            view.drop(at)


RECORDS = "page_id long, record_id string, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string, at long"


def _parse(record: bytes) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = _fields(head) or {}
    block = block[: int(fields["content-length"])]

    def page(key: str) -> int | None:
        name = fields.get(key, "").removeprefix("<urn:page:").removesuffix(">")
        return int(name) if name.isascii() and name.isdigit() or name[:1] == "-" and name[1:].isdigit() else None

    kind, length = fields["warc-type"].lower(), fields.get("x-payload-length", "")
    http = kind in ("response", "request") and fields.get("content-type", "application/http").lower().startswith("application/http")
    payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2] if http else block
    size = len(payload) if payload is not None else int(length) if length.isdigit() else None
    return page("warc-record-id"), fields.get("warc-record-id"), fields.get("warc-target-uri"), kind, page("warc-refers-to"), size, fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, payload


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES, keep_damaged: bool = False) -> DataFrame:
    """All records of archives given by ``file`` and ``bytes``; payload is null for revisits.

    Bytes that are in no member are an error, or with ``keep_damaged`` a row of the type ``damaged``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for part in batches:
            for file, begin, end in zip(*(c.to_pylist() for c in part.columns), strict=True):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as f:
                    rows, size = [], 0
                    for at, record in records_in_range(f, begin, end):
                        if record is None:
                            if not keep_damaged:
                                raise ValueError(f"{file}: no sound member at byte {at}")
                            rows.append((None, None, None, "damaged", *[None] * 4, file, at))
                            continue
                        rows.append((*_parse(record), file, at))
                        size += len(record)
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("begin")
    ranges = archives.where("bytes > 0").select("file", "bytes", begin).select("file", "begin", F.least(F.col("begin") + split_bytes, "bytes").alias("end"))
    n = archives.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(0))).first()[0]
    return ranges.repartition(max(1, min(int(n), MAX_TASKS)), "file", "begin").mapInArrow(run, RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``pages`` through archives and back; response digests are those of the payloads read."""
    archives = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark, "warc"))
    digest = F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return read_warc(archives).select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM r
"""
