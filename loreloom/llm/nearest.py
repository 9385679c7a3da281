"""Operator 7: approximate nearest neighbours by multiprobe p-stable hashing.

The largest inner products with a query are the least Euclidean distances once each vector
has one more coordinate that brings all to the greatest norm. Gaussian projections cut into
cells of equal width hash those vectors; a bucket of a table is a tuple of cells. Each of the
``TABLES`` tables holds all rows, dealt by bucket: buckets that share their first cells are a
part, and a part of more than ``PART_ROWS`` rows lies in chunks. Every row is indexed and
buckets have no caps.

The chance that a neighbour at some distance lies in a bucket is a product of normal
probabilities over its cells. A query first probes the ``FIRST`` likeliest buckets of each
table. Its k-th candidate there is no nearer than its k-th neighbour: that gives the distance,
each query's own, at which it probes perturbed buckets in the order of their chance until it
has ``SUCCESS`` of it, and a score below which nothing needs to leave a task. Queries go by an
exchange to the parts that hold their buckets, one row a part. Products are computed for rows
of probed buckets only; candidates of all tables are merged by query and row, then ranked by
exact products. A query with less than k first candidates probes every bucket of a table.

Of equal vectors only the k + 1 least ids can be among a query's k nearest (it may be one of
them itself), so larger ones aren't indexed: a hot vector is as cheap as any.

Recall on the test tables, against brute force: see the README.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do rows without vec_id; vectors are compared with those of the same
length; rows with the query's vec_id are its own; equal scores go to the smaller vec_id;
repeated rows each take a rank as candidates and are one query; rows with one vec_id and
different vectors are queries of their own; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import staged, tasks
from .words import mix

PART_ROWS, QUERIES_AT_ONCE = 8_192, 256
TABLES, SUCCESS, WIDTH = 2, 0.8, 1.0
#: Buckets of a table that a query probes first; buckets it considers at most; cells to either side.
FIRST, CONSIDERED, REACH = 32, 2_048, 3
ROWS = "tab int, part long, cell long, vec_id long, v long, copies long, embedding array<double>"
PROBES = "part long, query_id long, q long, bound double, cells array<long>, embedding array<double>"
FOUND = "query_id long, q long, vec_id long, v long, copies long, score double"


def _cdf(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (an approximation good to 1e-3 is enough to order buckets)."""
    x = np.clip(x, -12, 12)
    return 1 / (1 + np.exp(-1.5976 * x - 0.07056 * x**3))


class Hashes:
    """The hash functions for vectors of one length."""

    def __init__(self, length: int, rows: int, norm: float):
        self.norm, self.spread, self.length = norm, norm * WIDTH, length
        self.count = 4 + max(0, math.ceil(math.log(max(rows, 1) / 2**17, 4)))
        self.shared = min(self.count, max(0, math.ceil(math.log(max(rows, 1) / PART_ROWS, 4))))
        rng = np.random.RandomState(7 + length)
        self.axes = rng.standard_normal((TABLES, length + 1, self.count))
        self.offset = rng.random_sample((TABLES, self.count))

    def _code(self, table: int, cells: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(cells), (self.length << 8) + table, np.uint64)
        for j in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, j].astype(np.int64).view(np.uint64))
        return h.view(np.int64)

    def buckets(self, table: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part and bucket of tuples of cells."""
        return self._code(table, cells, self.shared), self._code(table, cells, self.count)

    def rows(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Part and bucket of each vector in each table."""
        lifted = np.c_[vectors, np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(1), 0))]
        for t in range(TABLES):
            yield self.buckets(t, np.floor(lifted @ self.axes[t] / self.spread + self.offset[t]))

    def probes(self, vector: np.ndarray, distance: float | None) -> Iterator[tuple[int, np.ndarray]]:
        """A part and the buckets in it that a query probes: the FIRST likeliest, or, at a distance, those with SUCCESS of the chance."""
        query = np.r_[vector * (self.norm / np.sqrt((vector**2).sum())), 0.0]
        for t in range(TABLES):
            at = query @ self.axes[t] / self.spread + self.offset[t]
            near = np.floor(at)[:, None] + np.arange(-REACH, REACH + 1)
            scale = self.spread / (self.norm if distance is None else distance)
            p = _cdf((near + 1 - at[:, None]) * scale) - _cdf((near - at[:, None]) * scale)
            chance, cells = np.ones(1), np.zeros((1, 0))
            for j in range(self.count):  # the likeliest tuples, cell by cell
                chance = (chance[:, None] * p[j]).ravel()
                best = np.argsort(-chance, kind="stable")[:CONSIDERED]
                chance, cells = chance[best], np.c_[cells[best // p.shape[1]], near[j][best % p.shape[1]]]
            n = FIRST if distance is None else int(np.searchsorted(np.cumsum(chance), SUCCESS * min(1.0, chance.sum()))) + 1
            parts, buckets = self.buckets(t, cells[:n])
            for part in np.unique(parts).tolist():
                yield part, buckets[parts == part]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(good, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Lengths of the lists, and for each length the rows that have it and their matrix."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(n) - n
    own = [(int(d), np.flatnonzero(n == d)) for d in np.unique(n)]
    return n, [(d, at, flat[begin[at][:, None] + np.arange(d)]) for d, at in own]


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values, kind))


def keyed(rows: DataFrame, n: int, norm: float) -> DataFrame:
    """ROWS: each row once a table, with its part and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, vectors in _matrix(batch.column("embedding"))[1]:
                own = batch.take(pa.array(at))
                for t, (part, cell) in enumerate(Hashes(d, n, norm).rows(vectors)):
                    yield pa.record_batch([pa.array(np.full(len(part), t, np.int32)), pa.array(part), pa.array(cell), *(own.column(c) for c in ("vec_id", "v", "copies", "embedding"))], names=[x.split()[0] for x in ROWS.split(", ")])

    return rows.select("vec_id", "v", "copies", "embedding").mapInArrow(run, ROWS)


def probing(queries: DataFrame, n: int, norm: float) -> DataFrame:
    """PROBES of queries (query_id, q, bound, embedding): a row for each part that holds buckets of the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, QUERIES_AT_ONCE):
                batch = whole.slice(a, QUERIES_AT_ONCE)
                bounds = batch.column("bound").to_pylist()
                for d, at, vectors in _matrix(batch.column("embedding"))[1]:
                    hashes, of, parts, cells = Hashes(d, n, norm), [], [], []
                    for i, vector in zip(at.tolist(), vectors, strict=True):
                        distance = None
                        if bounds[i] is not None:
                            product = bounds[i] * norm / math.sqrt(float((vector**2).sum()))
                            distance = math.sqrt(max(2 * norm**2 - 2 * product, 1e-12 * norm**2))
                        for part, own in hashes.probes(vector, distance):
                            of.append(i)
                            parts.append(part)
                            cells.append(own)
                    own = batch.take(pa.array(of, pa.int64()))
                    lists = _lists(np.concatenate(cells), np.array([len(c) for c in cells]), pa.int64())
                    yield pa.record_batch([pa.array(parts, pa.int64()), own.column("query_id"), own.column("q"), own.column("bound"), lists, own.column("embedding")], names=[x.split()[0] for x in PROBES.split(", ")])

    return queries.select("query_id", "q", "bound", "embedding").mapInArrow(run, PROBES)


class Chunk:
    """Rows of a part, ordered by bucket."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows.column("cell").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order)).combine_chunks()
        self.ids, self.v, self.copies = (rows.column(c).to_numpy() for c in ("vec_id", "v", "copies"))
        flat = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.vectors = flat.reshape(len(self.ids), -1)
        self.cells, begin = np.unique(rows.column("cell").to_numpy(), return_index=True)
        self.edges = np.r_[begin, len(self.ids)].tolist()

    def search(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
        """Candidates of each query in the buckets that it probes here: those that reach its bound, the k best ties included. No list of buckets: all."""
        asked = queries.column("query_id").to_numpy(zero_copy_only=False)
        vectors = queries.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1)
        if vectors.shape[1] != self.vectors.shape[1]:
            return None
        lists = queries.column("cells")
        n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        wanted = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.cells, wanted), len(self.cells) - 1)
        there = self.cells[at] == wanted
        probed = np.zeros((len(asked), len(self.cells)), bool)
        probed[np.repeat(np.arange(len(asked)), n)[there], at[there]] = True
        probed[lists.is_null().to_numpy(zero_copy_only=False)] = True
        products = np.full((len(asked), len(self.ids)), -np.inf)
        for c in np.flatnonzero(probed.any(0)).tolist():
            own, a, b = np.flatnonzero(probed[:, c]), self.edges[c], self.edges[c + 1]
            products[own, a:b] = vectors[own] @ self.vectors[a:b].T
        products[self.ids[None, :] == asked[:, None]] = -np.inf
        least = np.nan_to_num(queries.column("bound").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
        if k < products.shape[1]:
            least = np.maximum(least, np.partition(products, -k, axis=1)[:, -k])
        slack = 1e-9 * np.sqrt((vectors**2).sum(1) * float((self.vectors**2).sum(1).max()))
        of, row = np.nonzero((products >= (least - slack)[:, None]) & (products > -np.inf))
        score = (self.vectors[row] * vectors[of]).sum(1)  # the same for equal vectors, wherever they lie
        return pa.record_batch([pa.array(asked[of]), pa.array(queries.column("q").to_numpy()[of]), *(pa.array(x[row]) for x in (self.ids, self.v, self.copies)), pa.array(score)], names=[x.split()[0] for x in FOUND.split(", ")])


def _meet(rows: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """FOUND: what queries find where a chunk's rows lie; a task holds one chunk, and queries stream past it.

    rows: ROWS and chunk; probes: PROBES and chunk (cells null: all).
    """
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    left = rows.select("part", "chunk", F.lit(0).alias("guest"), "cell", "vec_id", "v", "copies", none("query_id", "long"), none("q", "long"), none("bound", "double"), none("cells", "array<long>"), "embedding")
    right = probes.select("part", "chunk", F.lit(1).alias("guest"), none("cell", "long"), none("vec_id", "long"), none("v", "long"), none("copies", "long"), "query_id", "q", "bound", "cells", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, chunk = None, [], None
        for batch in batches:
            keys = np.c_[batch.column("part").to_numpy(), batch.column("chunk").to_numpy(), batch.column("guest").to_numpy()]
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part, guest = keys[a, :2].tolist(), keys[a, 2]
                if part != key:
                    key, held, chunk = part, [], None
                if not guest:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    chunk, held = Chunk(pa.Table.from_batches(held)), []
                for i in range(a, b if chunk else a, QUERIES_AT_ONCE):
                    if (found := chunk.search(batch.slice(i, min(QUERIES_AT_ONCE, b - i)), k)) is not None:
                        yield found

    n = max(tasks(rows.sparkSession), 1)
    return left.unionByName(right).repartition(n, "part", "chunk").sortWithinPartitions("part", "chunk", "guest").mapInArrow(run, FOUND)


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of the rows that ``is_query`` selects."""
    rows = usable(vectors).groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")).withColumn("v", F.xxhash64("embedding"))
    few = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    base = rows.withColumn("n", few).where(F.col("n") <= k + 1)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    n, longest = usable(vectors).agg(F.count("*"), F.max(norm)).first()
    longest = (longest or 1.0) * (1 + 1e-12)
    index, _ = staged(keyed(base, n, longest), "nearest-index")
    chunks = index.groupBy("part").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("chunks"), F.min(F.size("embedding")).alias("length"), F.min("tab").alias("tab"))
    chunks, _ = staged(chunks, "nearest-parts")
    dealt = index.join(chunks.select("part", "chunks"), "part").withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.col("chunks")).cast("int"))
    queries = usable(vectors).where(is_query).dropDuplicates(["vec_id", "embedding"]).select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("q"), "embedding")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")

    def found(asked: DataFrame) -> DataFrame:
        return _meet(dealt, probing(asked, n, longest).join(chunks.select("part", "chunks"), "part").select("*", everywhere), k)

    first, _ = staged(found(queries.withColumn("bound", F.lit(None).cast("double"))), "nearest-first")
    best = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score")))
    distinct = first.dropDuplicates(["query_id", "q", "vec_id", "v"])
    bounds = distinct.withColumn("n", best).where(F.col("n") == k).select("query_id", "q", F.col("score").alias("bound"))
    bounded, _ = staged(queries.join(bounds, ["query_id", "q"], "left"), "nearest-bounds")
    whole = chunks.where("tab = 0").select("part", "length", everywhere)
    rest = bounded.where("bound IS NULL").withColumn("length", F.size("embedding")).join(whole, "length").withColumn("cells", F.lit(None).cast("array<long>"))
    more = found(bounded.where("bound IS NOT NULL")).unionByName(_meet(dealt, rest, k))
    merged = first.unionByName(more).dropDuplicates(["query_id", "q", "vec_id", "v"])
    each = merged.select("*", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``embeddings`` whose vec_id is divisible by 20, against all rows."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
