"""Operator 8: near-duplicate classes by a chosen-path set similarity join.

Documents with the same words in the same order (by SHA-256) have equal shingle sets and are
one class from the start; its smallest doc_id stands for it. All other links, those of equal
sets too, come from comparing full sets. In each of ``TREES`` independent trees a class descends to the node of its
minwise shingle. A node small enough to compare exhaustively ends there; a larger one
branches: each member goes on by ``BRANCHES`` further minwise shingles, so that members
that only share a passage part, while similar ones meet again in at least one child. Two
sets of Jaccard similarity s miss each other in a tree with probability 1 - s on the
first level and at most (1 - s) ** BRANCHES on each further one: with 8 trees, 3e-6 at 0.8.

Only class numbers and minwise values descend. Texts are joined to the end nodes alone
(nodes that several trees repeat count once) and compared there on full shingle sets. A
comparison takes members as pivots: members similar to the pivot are linked to it and need
no turn of their own, and by the triangle inequality of Jaccard distance only those within
twice the linking distance of the pivot could still reach them, so these, and all that
no pivot covers, become pivots too. No pair is emitted but links that join two groups.

End nodes that are still too large are dealt into chunks. One pass compares every member
with one pivot; a second one streams what that pivot doesn't cover past every chunk, dealt
into lanes of about as many guests as a chunk has members. So no task holds more than a
chunk or reads more than one lane of guests, and no link is lost.

Defined results: words are what white space parts, A-Z lower-cased; a document with fewer
words than a shingle has its whole sequence as one; null, empty and blank texts have no
shingles, no links and are their own component. doc_id names a vertex: rows that share one
share its links. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .staging import chunks, staged, tasks
from .words import SPACED, words_of

TREES, BRANCHES, LEVELS = 8, 2, 3
#: Members of a node, and members times shingles, that a task compares at once.
MEMBERS, WORK = 1_000, 400_000_000
WIDTH = 1 + BRANCHES * (LEVELS - 1)
PERCENT = 80


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and shingle hash, ordered by both, each pair once."""
    words = words_of(texts, SPACED)
    counts = words.counts()
    hashes, at = words.grams(k)
    parts = [(words.doc[at], hashes)]
    for j in range(1, k):
        if (counts == j).any():
            hashes, at = words.grams(j)
            own = counts[words.doc[at]] == j
            parts.append((words.doc[at[own]], hashes[own]))
    doc, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


def sketches(docs: DataFrame, k: int, seed: int = 8) -> DataFrame:
    """doc_id, n_shingles, key (a digest of the words in order), minwise (TREES * WIDTH values); no exchange."""
    schema = "doc_id long, n_shingles long, key binary, minwise array<long>"
    factors = np.random.RandomState(seed).randint(1, 1 << 62, TREES * WIDTH, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                n, texts = batch.num_rows, batch.column("text").to_pylist()
                doc, h = shingle_sets(texts, k)
                size = np.bincount(doc, minlength=n)
                some = np.flatnonzero(size)
                start = (np.cumsum(size) - size)[some]
                keys = [hashlib.sha256(b" ".join((t or "").encode().lower().split())).digest() for t in texts]
                least = np.zeros((n, len(factors)), np.int64)
                if len(some):
                    for i, f in enumerate(factors):
                        v = h * f
                        v ^= v >> np.uint64(31)
                        least[some, i] = np.minimum.reduceat(v, start).view(np.int64)
                values = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(factors), pa.array(least.ravel()))
                yield pa.record_batch([batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(keys, pa.binary()), values], names=["doc_id", "n_shingles", "key", "minwise"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path and member hash of the end nodes among (path, rep, n), and the paths that must branch."""
    node = rows.groupBy("path").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"), F.min("rep").alias("low"))
    node = node.where("members > 1")
    big = (F.col("members") > MEMBERS) | (F.col("members") * F.col("shingles") > WORK)
    ends = node.where(~big).groupBy("members", "who", "low").agg(F.min("path").alias("path")).select("path")
    return ends, node.where(big).select("path", "members", "shingles")


class _Sets:
    """Sets in CSR form, their values numbered from 0."""

    def __init__(self, doc: np.ndarray, h: np.ndarray, first: int, last: int):
        a, b = np.searchsorted(doc, [first, last])
        self.starts = np.searchsorted(doc[a:b], np.arange(first, last + 1))
        values, self.local = np.unique(h[a:b], return_inverse=True)
        self.size = np.diff(self.starts)
        self.flag = np.zeros(len(values), bool)

    def shared(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the intersections and unions of all sets with set p; no set is empty."""
        own = self.local[self.starts[p] : self.starts[p + 1]]
        self.flag[own] = True
        both = np.add.reduceat(self.flag[self.local], self.starts[:-1], dtype=np.int64)
        self.flag[own] = False
        return both, self.size + self.size[p] - both


class _Union:
    def __init__(self, n: int):
        self.up, self.parts = list(range(n)), n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        self.parts -= a != b
        return a != b


def _links(sets: _Sets, percent: int) -> Iterator[tuple[int, int]]:
    """Links that together join all sets that links connect.

    Say y and z are linked and neither is a pivot. A pivot p covers y, so z lies within
    twice the linking distance of p: p covers it as well, or has it wait for a turn.
    """
    n = len(sets.size)
    union, covered, waiting, done = _Union(n), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)

    def turn(p: int) -> Iterator[tuple[int, int]]:
        both, either = sets.shared(p)
        near = 100 * both >= percent * either
        done[p] = covered[p] = True
        if p_covers:
            covered[near] = True
            waiting[~near & (100 * both >= (2 * percent - 100) * either)] = True
        yield from ((p, q) for q in np.flatnonzero(near).tolist() if union.join(p, q))

    p_covers = True
    for p in range(n):
        if not covered[p] or waiting[p]:
            yield from turn(p)
        if union.parts == 1:
            return
    p_covers = False
    for p in np.flatnonzero(waiting & ~done).tolist():
        yield from turn(p)
        if union.parts == 1:
            return


def _groups(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[list[tuple]]:
    """Rows (key first) of batches ordered by key, in lists of whole groups of about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > limit and row[0] != held[-1][0]:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[-1] or "")
    if held:
        yield held


def _bounds(keys: list) -> list[tuple[int, int]]:
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


EDGES = "a long, b long"


def _end_links(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) inside the nodes of members (path, rep); texts meet there, ordered by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            doc, h = shingle_sets([r[2] for r in rows], k)
            reps, out = [r[1] for r in rows], []
            for first, last in _bounds([r[0] for r in rows]):
                out += [(reps[first + p], reps[first + q]) for p, q in _links(_Sets(doc, h, first, last), percent)]
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    spark = docs.sparkSession
    rows = members.join(docs, "rep").select("path", "rep", "text")
    return rows.repartition(4 * tasks(spark), "path").sortWithinPartitions("path", "rep").mapInArrow(run, EDGES)


def _chunk_links(rows: DataFrame, k: int, percent: int, every: bool = False) -> DataFrame:
    """Links (a, b) of guests with members: every one, or as many as join a chunk's groups.

    rows: path, chunk, lane, guest (0: member, 1: guest), rep, text. A task holds a chunk's
    members; the guests of one lane stream past them in blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, guests, size, group = None, [], [], 0, np.zeros(0, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            """Links that join two groups; the members' groups so far are kept."""
            nonlocal guests, size, group
            if held and guests:
                doc, h = shingle_sets([r[5] for r in [*held, *guests]], k)
                out, m = [], len(held)
                sets = _Sets(doc, h, 0, m + len(guests))
                group = group if len(group) else np.arange(m)
                for p in range(m, m + len(guests)):
                    both, either = sets.shared(p)
                    near = np.flatnonzero(100 * both[:m] >= percent * either[:m])
                    met, one = np.unique(group[near], return_index=True)
                    out += [(guests[p - m][4], held[q][4]) for q in (near if every else near[one]).tolist()]
                    if len(met) > 1:
                        group[np.isin(group, met)] = met[0]
                if out:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
            guests, size = [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    yield from flush()
                    key, held, group = row[:3], [], group[:0]
                if row[3] == 0:
                    held.append(row)
                else:
                    guests.append(row)
                    size += len(row[5] or "")
                    if size > 2 << 20 or len(guests) >= 200:
                        yield from flush()
        yield from flush()

    n = 4 * tasks(rows.sparkSession)
    order = ("path", "chunk", "lane")
    return rows.select(*order, "guest", "rep", "text").repartition(n, *order).sortWithinPartitions(*order, "guest", "rep").mapInArrow(run, EDGES)


def _big_links(rows: DataFrame, big: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links inside end nodes that no task could hold: see the module's text."""
    parts = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(F.col("shingles") / (WORK / MEMBERS))).cast("int")
    members, _ = staged(rows.join(big.select("path", parts.alias("parts")), "path").select("path", "parts", "rep"), "big-nodes")
    chunk, lane = (F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int") for salt, n in (("chunk", "parts"), ("lane", "lanes")))

    def all_of(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def met(own: DataFrame, guests: DataFrame) -> DataFrame:
        """Members in their chunk, once a lane; guests in their lane, once a chunk."""
        held = own.join(docs, "rep").select("path", chunk.alias("chunk"), all_of("lanes").alias("lane"), F.lit(0).alias("guest"), "rep", "text")
        come = guests.join(docs, "rep").select("path", all_of("parts").alias("chunk"), lane.alias("lane"), F.lit(1).alias("guest"), "rep", "text")
        return held.unionByName(come)

    pivots = members.groupBy("path", "parts").agg(F.min("rep").alias("rep"))
    one = F.lit(1).alias("lanes")
    first, _ = staged(_chunk_links(met(members.select("*", one), pivots.select("*", one)), k, percent, every=True), "pivot-links")
    covered = first.select(F.col("a").alias("pivot"), F.col("b").alias("rep")).distinct()
    tied = members.join(pivots.select("path", F.col("rep").alias("pivot")), "path")
    rest, _ = staged(tied.where("rep <> pivot").join(covered, ["pivot", "rep"], "left_anti").select("path", "parts", "rep"), "guests")
    lanes, _ = staged(rest.groupBy("path").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("lanes")), "lanes")
    return first.unionByName(_chunk_links(met(members.join(lanes, "path"), rest.join(lanes, "path")), k, percent))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for all documents."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    sketch, _ = staged(sketches(docs, k), "sketches")
    classes = sketch.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("minwise").alias("minwise")).where("rep IS NOT NULL")
    classes, _ = staged(classes, "classes")

    def value(tree, i: int):
        return F.get("minwise", tree * WIDTH + i)

    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("rep", "n", "minwise", trees).select("rep", "n", "tree", F.xxhash64("tree", value(F.col("tree"), 0)).alias("path"))
    members, links = None, None
    for level in range(1, LEVELS + 1):
        ends, big = _nodes(rows)
        own = rows.join(ends, "path").select("path", "rep")
        members = own if members is None else members.unionByName(own)
        big, _ = staged(big, "branching")
        if big.isEmpty():
            break
        if level == LEVELS:
            links = _big_links(rows.select("path", "rep"), big, texts, k, percent)
            break
        at = 1 + BRANCHES * (level - 1)
        further = rows.join(big.select("path"), "path").join(classes.select("rep", "minwise"), "rep")
        choices = F.array(*(F.xxhash64("path", F.lit(level * BRANCHES + j), value(F.col("tree"), at + j)) for j in range(BRANCHES)))
        rows, _ = staged(further.select("rep", "n", "tree", F.explode(choices).alias("path")), "branches")
    found = _end_links(members, texts, k, percent)
    found = found if links is None else found.unionByName(links)
    found, _ = staged(found, "links")
    parts = components(found)
    mine = sketch.join(classes.select("key", "rep"), "key", "left").join(parts.withColumnRenamed("vertex", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    return mine.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, shingles of four words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)


OP8_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, least(len(w), 4) AS n, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + n - 1], ' ') AS g FROM p),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN size m ON m.doc_id = a JOIN size o ON o.doc_id = b WHERE 100 * common >= 80 * (m.n + o.n - common)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS c FROM size UNION SELECT e.b, r.c FROM reach r JOIN either e ON e.a = r.v),
component AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) IS NOT DISTINCT FROM d.doc_id AS kept
FROM d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN component ON v = d.doc_id
"""
