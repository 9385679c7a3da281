"""Operator 5: benchmark decontamination by winnowing.

Hashes of ``K`` consecutive words; of every ``WINDOW`` consecutive ones the least is a
fingerprint. Any shared span of K + WINDOW - 1 = 10 words has the same fingerprint in a
document and in an item, so joining fingerprints misses none. Each hit is extended to the
ten-word windows around it, which are then compared in full, word by word. Items shorter
than ten words are one window each and their own fingerprint.

A benchmark of up to ``BLOCK_BYTES`` of text is indexed once and broadcast (an index takes
about six times its text), and documents are joined with it where they are read, without
an exchange. A larger one is dealt to blocks of that size. Then fingerprints of documents
and items are joined by an exchange, hot ones split ``SALTS`` ways, which gives the blocks
that each document must meet; items and documents meet there, a block and up to
``MEETING`` documents in a task at a time, and what a document's blocks find is merged.

Defined results: a null or empty text has no words and is not contaminated; items
without words or without item_id match nothing; an item_id that occurs repeatedly counts
once; repeated documents each keep a row; empty tables work; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import chunks, staged, tasks
from .words import ALNUM, Words, words_of

K, WINDOW = 5, 6
SPAN = K + WINDOW - 1
BLOCK_BYTES, SALTS, MEETING = 4 << 20, 16, 20_000
TEXT = 1 << 20
HITS = "starts array<int>, ends array<int>, items array<long>"


def fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of K words in each ten-word window, and the window's first word."""
    grams, at = words.grams(K)
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = grams[:n].copy()
    for i in range(1, WINDOW):
        np.minimum(least, grams[i : i + n], out=least)
    whole = at[WINDOW - 1 :] - at[:n] == WINDOW - 1
    whole &= words.doc[at[:n]] == words.doc[at[WINDOW - 1 :]]
    return least[whole], at[:n][whole]


class Index:
    """Windows of some items by length: their hashes in order and first words, and the fingerprints that lead to them.

    Words stay where they are in the items' text, so an index is a few flat arrays.
    """

    def __init__(self, items: list[tuple[int, str]]):
        words = words_of([t for _, t in items], ALNUM)
        ids = np.array([i for i, _ in items], np.int64)
        self.prints = np.unique(fingerprints(words)[0])
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        counts = words.counts()
        for k in sorted({SPAN, *np.unique(counts[(counts > 0) & (counts < SPAN)]).tolist()}):
            hashes, at = words.grams(k)
            if k < SPAN:
                own = counts[words.doc[at]] == k
                hashes, at = hashes[own], at[own]
            if len(hashes):
                order = np.argsort(hashes, kind="stable")
                self.windows[k] = hashes[order], at[order].astype(np.int32)
        self.item = ids[words.doc]
        self.words = Words(words.data, words.begin.astype(np.int32), words.end.astype(np.int32), words.doc[:0], words.hash[:0], len(items))

    def hits(self, words: Words) -> list[tuple[int, int, int, list[int]]]:
        """Text, first word, length and items of each window that an item has."""
        out = []
        for k, (keys, places) in self.windows.items():
            hashes, at = words.grams(k)
            if k == SPAN:
                prints, begin = fingerprints(words)
                near = begin[np.searchsorted(self.prints, prints, "right") > np.searchsorted(self.prints, prints, "left")] if len(prints) else begin
                hashes, at = hashes[np.searchsorted(at, near)], near
            left = np.searchsorted(keys, hashes, "left")
            right = np.searchsorted(keys, hashes, "right")
            for i in np.flatnonzero(right > left).tolist():
                own = words.text(int(at[i]), k)
                same = {int(self.item[p]) for p in places[left[i] : right[i]].tolist() if self.words.text(p, k) == own}
                if same:
                    out.append((int(words.doc[at[i]]), int(at[i]), k, sorted(same)))
        return out

    def found(self, words: Words) -> list[tuple[list[int], list[int], list[int]]]:
        """Starts and ends of the hit spans (word positions in their text) and the items, of each text."""
        first = np.searchsorted(words.doc, np.arange(words.n_docs)).tolist()
        marks: dict[int, tuple[list, set]] = {}
        for doc, at, k, items in self.hits(words):
            spans, found = marks.setdefault(doc, ([], set()))
            spans.append((at - first[doc], at - first[doc] + k))
            found.update(items)
        empty: tuple[list[int], list[int], list[int]] = ([], [], [])
        return [(*_spans(marks[d][0]), sorted(marks[d][1])) if d in marks else empty for d in range(words.n_docs)]


def _spans(marks: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of intervals."""
    starts, ends = [], []
    for a, b in sorted(marks):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _columns(found: list[tuple]) -> list[pa.Array]:
    kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return [pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)]


def _schema(docs: DataFrame, more: str) -> T.StructType:
    return T.StructType([*docs.schema.fields, *T.StructType.fromDDL(more).fields])


def _by_broadcast(docs: DataFrame, index: Index) -> DataFrame:
    """docs with n_words and HITS, where the index is small."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", TEXT):
                words = words_of(batch.column("text").to_pylist(), ALNUM)
                yield pa.record_batch([*batch.columns, pa.array(words.counts()), *_columns(shared.value.found(words))], names=names)

    schema = _schema(docs, f"n_words long, {HITS}")
    names = schema.fieldNames()
    return docs.mapInArrow(run, schema)


def _fingerprinted(rows: DataFrame, short: list[int]) -> DataFrame:
    """rows with n_words and prints: the distinct fingerprints of their texts, those of windows of the short lengths too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", TEXT):
                words = words_of(batch.column("text").to_pylist(), ALNUM)
                parts = [fingerprints(words), *(words.grams(k) for k in short)]
                h, doc = np.concatenate([p for p, _ in parts]), np.concatenate([words.doc[at] for _, at in parts])
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
                ends = np.searchsorted(doc[new], np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.record_batch([*batch.columns, pa.array(words.counts()), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[new].view(np.int64)))], names=names)

    schema = _schema(rows, "n_words long, prints array<long>")
    names = schema.fieldNames()
    return rows.mapInArrow(run, schema)


def _meeting(rows: DataFrame) -> DataFrame:
    """serial and HITS of documents in the block they meet.

    rows: block, chunk, guest (0: item, 1: document), id, text. A task holds a block's index;
    documents stream past it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items, index = None, [], None
        for whole in batches:
            for batch in chunks(whole, "text", TEXT):
                held: list[tuple[int, str]] = []

                def flush() -> Iterator[pa.RecordBatch]:
                    if held and index is not None:
                        found = [(i, *f) for (i, _), f in zip(held, index.found(words_of([t for _, t in held], ALNUM)), strict=True) if f[0]]
                        yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), *_columns([f[1:] for f in found])], names=["serial", "starts", "ends", "items"])
                    held.clear()

                for block, chunk, guest, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (block, chunk) != key:
                        yield from flush()
                        key, items, index = (block, chunk), [], None
                    if not guest:
                        items.append((i, text))
                        continue
                    if index is None:
                        index, items = Index(items), []
                    held.append((i, text))
                yield from flush()

    n = tasks(rows.sparkSession)
    return rows.select("block", "chunk", "guest", "id", "text").repartition(n, "block", "chunk").sortWithinPartitions("block", "chunk", "guest").mapInArrow(run, f"serial long, {HITS}")


def _merged(starts: Column, ends: Column) -> Column:
    """The union of intervals, as an ordered array of structs (a, b)."""
    none = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        joins = (F.size(acc) > 0) & (x["a"] <= F.try_element_at(acc, F.lit(-1))["b"])
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(x)))

    pairs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(F.array_sort(pairs), none, step)


def _by_exchange(docs: DataFrame, items: DataFrame, blocks: int) -> DataFrame:
    """docs with n_words and HITS, for a benchmark of any size."""
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    items, _ = staged(_fingerprinted(items, list(range(1, SPAN))), "benchmark")
    short = [r.n_words for r in items.where((F.col("n_words") > 0) & (F.col("n_words") < SPAN)).select("n_words").distinct().collect()]  # nine at most
    # A short item's own fingerprint is its whole window's hash, the only one of its own length.
    rows, _ = staged(_fingerprinted(docs.withColumn("serial", F.monotonically_increasing_id()), [int(k) for k in sorted(short)]), "documents")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    known = items.select("block", F.explode("prints").alias("print")).distinct().select("block", "print", salts)
    asked = rows.select("serial", F.explode("prints").alias("print")).withColumn("salt", F.pmod("serial", F.lit(SALTS)).cast("int"))
    pairs, _ = staged(asked.join(known, ["print", "salt"]).select("serial", "block").distinct(), "meetings")
    parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / MEETING).cast("int").alias("parts"))
    chunk = F.pmod(F.xxhash64("serial"), F.col("parts")).cast("int").alias("chunk")
    guests = pairs.join(parts, "block").join(rows.select("serial", "text"), "serial").select("block", chunk, F.lit(1).alias("guest"), F.col("serial").alias("id"), "text")
    hosts = items.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), F.lit(0).alias("guest"), F.col("item_id").alias("id"), "text")
    found = _meeting(guests.unionByName(hosts)).groupBy("serial").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")))  # of one document
    spans = _merged(F.col("starts"), F.col("ends"))
    found = found.select("serial", spans.alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    out = rows.join(found, "serial", "left")
    return out.select(*docs.columns, "n_words", none(F.col("spans.a"), "array<int>").alias("starts"), none(F.col("spans.b"), "array<int>").alias("ends"), none(F.col("items"), "array<long>").alias("items"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, kept columns, n_words, starts and ends (word positions of the hit spans), items (ids, ascending)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    names = {f"_own_{i}": c for i, c in enumerate(keep)}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(n) for n, c in names.items()))
    if total <= block_bytes:
        found = _by_broadcast(rows, Index([(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()]))
    else:
        found = _by_exchange(rows, items, -(-int(total) // block_bytes))
    return found.toDF(*(names.get(c, c) for c in found.columns))


def with_counts(found: DataFrame) -> DataFrame:
    """The counts and digest of what was found."""
    zero = F.lit(0).cast("long")
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), zero, lambda s, x: s + x)
    digest = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against the whole ``benchmark``."""
    return with_counts(find_overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP5_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
dw AS (SELECT r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ip AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM ip),
dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
dg AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM dp),
hit AS (SELECT dg.r, dg.n, dg.i, win.item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
spot AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit),
counted AS (SELECT r, count(*) AS n_hit FROM spot GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN counted USING (r) LEFT JOIN items USING (r)
"""
