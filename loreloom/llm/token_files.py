"""Operator 1: token-id files in frequency-ranked, byte-aligned variable-length coding.

Each distinct text piece is encoded once per Python worker with the ``tokenizers``
library; ids are replaced by their corpus-wide frequency rank (the most frequent id is
0) and coded in 1 to 4 bytes each. Two bits an id say how many: four ids share one
control byte, and control bytes are stored apart from the data bytes, so that numpy
reads a whole block with one table lookup and no loop over ids.

Files: a folder with ``ranks`` (rank, token_id) and ``blocks``. A row of ``blocks`` has
up to ``BLOCK_IDS`` ids of consecutive documents (a longer document has a row to
itself): shard, block, start (ids before it in its shard), doc_ids and lengths (one
entry a document), control, data. Shards cover ascending ranges of doc_id; a doc_id that
many rows share may run over several of them.

Defined results: a null text counts as empty and has the end id only; rows with the
same doc_id each keep their own entry, ordered by the crc32 of their ids; a null doc_id
comes first; an empty table gives empty files. Further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import chunks, discard, shared_dir, staged, tasks

BLOCK_IDS = 1 << 17
#: Pieces and ids that fill a generation of a worker's cache.
CACHED_PIECES, CACHED_IDS = 300_000, 4_000_000
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
#: First bytes of characters that may be white space outside ASCII, and their second bytes.
_LEADS, _SECONDS = np.zeros(256, bool), np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SECONDS[[0x80, 0x81, 0x85, 0x9A, 0xA0]] = True
#: ASCII letters, digits and marks; 0 is everything else, the apostrophe too, as it may begin a token with letters.
_KIND = np.zeros(256, np.int8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = 3


def piece_starts(raw: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where pieces of the texts begin that pre-tokenization keeps apart; docs: where the texts begin.

    A space or line break before what is surely no white space is a cut: the space belongs
    to what follows, the line break is a token of its own. So is a change between ASCII
    letters, digits and marks.
    """
    edge = np.zeros(len(raw) + 1, bool)
    first = np.zeros(len(raw) + 1, bool)
    first[docs] = True
    at = np.flatnonzero((raw[:-1] == 0x20) | (raw[:-1] == 0x0A)) if len(raw) else np.zeros(0, np.int64)
    after = raw[at + 1]
    second = raw[np.minimum(at + 2, len(raw) - 1)]
    solid = ((after > 0x20) & (after != 0x7F) & ~(_LEADS[after] & _SECONDS[second])) & ~first[at + 1]
    at = at[solid]
    edge[at] = True
    edge[at[raw[at] == 0x0A] + 1] = True
    kind = _KIND[raw]
    edge[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    return np.flatnonzero((edge | first)[:-1])


def gathered(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices of ``values`` with these beginnings and lengths, one after another."""
    upto = np.cumsum(length)
    return values[np.repeat(begin - upto + length, length) + np.arange(upto[-1] if len(upto) else 0)]


class Generation:
    """Pieces and their ids, in flat arrays."""

    def __init__(self, dtype: np.dtype):
        self.code: dict[str, int] = {}
        self.ids, self.end = np.zeros(0, dtype), np.zeros(1, np.int64)

    def find(self, pieces: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1."""
        return np.fromiter(map(self.code.get, pieces, repeat(-1)), np.int64, len(pieces))

    def ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.end[codes + 1] - self.end[codes]
        return gathered(self.ids, self.end[codes], length), length

    def add(self, pieces: np.ndarray, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Take new pieces in and number them."""
        n = len(self.end) - 1
        self.code.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.end = np.r_[self.end, self.end[-1] + np.cumsum(length)]
        self.ids = np.r_[self.ids, ids]
        return np.arange(n, n + len(pieces))


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct piece once.

    A text that holds an added token (the library finds these before it pre-tokenizes) is
    encoded whole. The cache has two generations: a piece that occurs again is taken into
    the newer one, and when that is full the older one goes, so frequent pieces stay.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.starts = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.breaks = np.zeros(size, bool)
        self.breaks[self.tokenizer.token_to_id("Ċ")] = True
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.new, self.old = Generation(self.dtype), Generation(self.dtype)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _holds_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def _learn(self, pieces: np.ndarray) -> None:
        """Take new pieces in. Words go to the library in long lines, whose ids part where words begin."""
        kinds = pa.array(pieces, pa.string())
        spaces = pa.compute.count_substring(kinds, " ").to_numpy()
        led = pa.compute.starts_with(kinds, " ").to_numpy(zero_copy_only=False)
        plain = pa.compute.utf8_is_printable(kinds).to_numpy(zero_copy_only=False) & (spaces == led) & (pa.compute.binary_length(kinds).to_numpy() > led)
        for own, mark in ((plain & led, ""), (plain & ~led, "\n")):
            words = pieces[own]
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                joined = mark.join(part)
                ids = self._ids(joined)
                begin = np.r_[0, np.flatnonzero(self.breaks[ids]) + 1] if mark else np.flatnonzero(self.starts[ids])
                if len(begin) == len(part) and not self._holds_added(joined):
                    length = np.diff(np.r_[begin, len(ids) + len(mark)]) - len(mark)
                    self.new.add(part, gathered(ids, begin, length), length)
                else:
                    self._learn_each(part)
        self._learn_each(pieces[~plain])

    def _learn_each(self, pieces: np.ndarray) -> None:
        ids = [self._ids(p) for p in pieces]
        self.new.add(pieces, np.concatenate([self.new.ids[:0], *ids]), np.array([len(x) for x in ids], np.int64))

    def _known(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after another, and their numbers."""
        if len(self.new.code) > CACHED_PIECES or len(self.new.ids) > CACHED_IDS:
            self.old, self.new = self.new, Generation(self.dtype)
        codes = self.new.find(pieces)
        gaps = np.flatnonzero(codes < 0)
        if len(gaps):
            before = self.old.find(pieces[gaps])
            again = gaps[before >= 0]
            codes[again] = self.new.add(pieces[again], *self.old.ids_of(before[before >= 0]))
            missing = gaps[before < 0]
            self._learn(pieces[missing])
            codes[missing] = self.new.find(pieces[missing])
        return self.new.ids_of(codes)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers."""
        whole = {i: self._ids(t).tobytes() for i, t in enumerate(texts) if self._holds_added(t)}
        plain = ["" if i in whole else t for i, t in enumerate(texts)]
        data = "".join(plain).encode()
        size = np.array([len(t) if t.isascii() else len(t.encode()) for t in plain], np.int64)
        docs = np.cumsum(size) - size
        begin = piece_starts(np.frombuffer(data, np.uint8), docs[size > 0])
        pieces = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.r_[begin, len(data)].astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        table, length = self._known(pieces.dictionary.to_numpy(zero_copy_only=False))
        code = pieces.indices.to_numpy()
        n = length[code]
        ids = gathered(table, (np.cumsum(length) - length)[code], n)
        edge = np.r_[0, np.cumsum(n)][np.searchsorted(begin, np.r_[docs, len(data)])].tolist()
        raw, step = ids.tobytes(), ids.itemsize
        return [whole.get(i, raw[a * step : b * step]) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


TOKENS = "doc_id long, ids binary, crc long, place long, counts array<struct<token_id:int,n:long>>"


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """A row a document: doc_id, ids (with the end id, little-endian; 2 bytes each where the vocabulary allows, else 4, compressed), crc, place.

    place tells rows apart. The last row of a task has the counts of its ids and nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        own = encoder(tokenizer_path)
        end = np.array([end_id], own.dtype).tobytes()
        pack = zstandard.ZstdCompressor(level=1).compress
        place, total = TaskContext.get().partitionId() << 40, np.zeros(0, np.int64)
        pair = pa.list_(pa.struct([("token_id", pa.int32()), ("n", pa.int64())]))
        names = ["doc_id", "ids", "crc", "place", "counts"]
        for whole in batches:
            for batch in chunks(whole, "text"):
                ids = [x + end for x in own.encode(["" if t is None else t for t in batch.column("text").to_pylist()])]
                n = np.bincount(np.frombuffer(b"".join(ids), own.dtype), minlength=len(total))
                n[: len(total)] += total
                total = n
                columns = [pa.array(map(pack, ids), pa.binary()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(np.arange(place, place + len(ids)))]
                place += len(ids)
                yield pa.record_batch([batch.column("doc_id"), *columns, pa.nulls(len(ids), pair)], names=names)
        used = np.flatnonzero(total)
        if len(used):
            counts = [{"token_id": i, "n": x} for i, x in zip(used.tolist(), total[used].tolist(), strict=True)]
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([counts], pair)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKENS)


def pack_ids(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned integers under 2**32."""
    ranks = ranks.astype("<u4")
    extra = ((ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]].tobytes()


def unpack_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers behind control and data bytes, by table lookup of each control byte."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


BLOCKS = "shard int, block int, start long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0) -> None:
    """Encode all of ``docs`` into token files below ``path``.

    One pass tokenizes and counts ids (the sums, one row an id of the vocabulary, are all
    that reaches the driver); a range exchange on doc_id then orders the files.
    """
    spark = docs.sparkSession
    rows, temporary = staged(tokenize(docs, tokenizer_path, end_id), "tokens", compression="none")
    counts = rows.where("counts IS NOT NULL").select(F.explode("counts").alias("c")).groupBy("c.token_id").agg(F.sum("c.n").alias("n"))
    ranked = [r.token_id for r in counts.orderBy(F.desc("n"), "token_id").collect()]
    tokens = rows.where("place IS NOT NULL").select("doc_id", "ids", "crc", "place")
    spark.createDataFrame([(i, t) for i, t in enumerate(ranked)], "rank int, token_id int").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        unpack, dtype, rank = zstandard.ZstdDecompressor().decompress, encoder(tokenizer_path).dtype, shared.value
        shard, block, start, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            lengths = [len(x) // dtype.itemsize for _, x in held]
            control, data = pack_ids(rank[np.frombuffer(b"".join(x for _, x in held), dtype)])
            row = [[shard], [block], [start], [[d for d, _ in held]], [lengths], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["shard", "block", "start", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for doc, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = unpack(packed.as_py())
                n = len(ids) // dtype.itemsize
                if held and size + n > BLOCK_IDS:
                    yield flush()
                    block, start, held, size = block + 1, start + size, [], 0
                held.append((doc, ids))
                size += n
        if held:
            yield flush()

    key = ["doc_id", "crc", "place"]  # place only parts rows that are alike, so that none can be a hot key
    ordered = tokens.repartitionByRange(tasks(spark), *key).sortWithinPartitions(*key).select("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(spark, temporary)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, then ids, or their ids_crc32.

    Document starts need one row a shard, not a pass in one task.
    """
    ranks = np.array([r.token_id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()] or [0], "<u4")
    shared = spark.sparkContext.broadcast(ranks)
    last = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, docs, lengths, control, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "doc_ids", "lengths", "control", "data")), strict=True):
                n = np.array(lengths, np.int64)
                ids = shared.value[unpack_ids(control, data, int(n.sum()))]
                ends = np.cumsum(n)
                starts = ends - n
                parts = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = pa.array([zlib.crc32(x) for x in parts], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32()))
                yield pa.record_batch([pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts + start), pa.array(n), out], names=["shard", "doc_id", "at", "n_tokens", last.split()[0]])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("shard").agg(F.max(F.col("start") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    rows = blocks.select("shard", "start", "doc_ids", "lengths", "control", "data").mapInArrow(run, f"shard int, doc_id long, at long, n_tokens long, {last}")
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", last.split()[0])


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` through token files and back."""
    import public_tokenizers

    path = shared_dir(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_files(spark, path, digest=True)
