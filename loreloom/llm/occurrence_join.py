"""Operator 13: similarity join of n-gram sets by T-occurrence search.

Two sets of Jaccard similarity s or more share at least T = s * n members of the one with
n. Documents with the same words in the same order are one class, whose smallest doc_id
stands for it. Which classes must meet follows from one order of all n-grams: frequent ones
last (a bounded summary of counts, merged over tasks, gives their class), then by hash. A
larger set's first n - ceil(s * n) + m n-grams hold m of the first n - ceil(2s / (1 + s) * n) + m
of any smaller set it links with, so only these prefixes are exchanged, as numbers.

An n-gram that no other class of a size to link with has in its prefix is dropped, and then
every class that is left with fewer than m (``LEAD`` percent of its n-grams): what only
shares a passage goes here. A class's home is the first n-gram that is left. Where the
prefixes with an n-gram lead to a few homes, their classes visit these homes as guests, if m
of their n-grams lead there; where they lead to more than ``HOMES``, the n-gram gets a node of
its own, or one with n-grams that nearly the same classes have. Texts are joined to nodes of two classes or more, and a node is searched by its inverted lists:
of a query's lists the longest ones are set aside as DivideSkip does, the short ones are
merged by a heap that skips what can't reach T, and what remains is probed in the long
ones by binary search. (Where the short lists together have over ``HEAP`` members, one count
of these takes the heap's place: it merges the same lists.) What links to a query is covered
by it, so a group of near copies takes few searches. Guests are queries only where they wait
for a turn, as their own homes compare them with each other. Nodes that are too large are
split: guests over lanes, or all by set size, and what is too large then is compared by
``near_dups``'s chunks and lanes.

Everything is exact: no link is lost, no n-gram or candidate dropped for being frequent.

Defined results: words are what white space parts, A-Z lower-cased; a document with fewer
words than an n-gram has its whole sequence as one; null, empty and blank texts have no
n-grams, no links and are their own component, as are rows without doc_id. doc_id names a
vertex: rows that share one share its links. Empty tables give no rows; texts of any
length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .near_dups import MEMBERS, WORK, _big_links, _bounds, _groups, _Union, shingle_sets
from .staging import chunks, staged, tasks

PERCENT = 85
#: Counters of a task's summary, n-grams in the merged one, and the count from which an n-gram is called frequent.
COUNTERS, FREQUENT, OFTEN = 1 << 14, 1 << 16, 32
#: Percent of a set by which its prefix is longer than one common n-gram would need, and how often what shares too few is left out.
LEAD, TURNS = 4, 2
#: Homes up to which the classes with an n-gram visit each of them.
HOMES = 32
#: DivideSkip's factor: how much dearer a probe's halving is than a merged element. A node of 664 near copies took 3.0 s at 0.1, 1.3 at 1, 0.9 at 10.
MU = 1.0
#: Elements up to which lists are merged by the heap.
HEAP = 512
#: Long lists that are probed at once.
PROBED = 64
#: Bits of the filter that texts pass before they are joined.
FILTER = 1 << 23
SALTS = 16


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(values, return_inverse=True)
    return values, np.bincount(at, weights=counts, minlength=len(values)).astype(np.int64)


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent n-grams, ascending, and a class of each: the binary digits of its count.

    A task's summary is Misra and Gries's: COUNTERS values, from which what would need more
    is taken off evenly. Counts that are too low change the order only, never a result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                _, h = shingle_sets(batch.column("text").to_pylist(), k)
                new, n = np.unique(h, return_counts=True)
                values, counts = _summed(np.concatenate([values, new]), np.concatenate([counts, n]))
                if len(values) > COUNTERS:
                    counts = counts - np.partition(counts, len(counts) - COUNTERS - 1)[len(counts) - COUNTERS - 1]
                    values, counts = values[counts > 0], counts[counts > 0]
        if len(values):
            yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(counts)], names=["h", "n"])

    summary = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, n long")
    most = summary.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    most.sort(key=lambda r: r.h % (1 << 64))
    return np.array([r.h % (1 << 64) for r in most], np.uint64), np.array([int(r.n).bit_length() for r in most], np.int64)


def lengths(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many first n-grams of a set of n are looked up, and how many of these are found by larger sets."""
    more = n * LEAD // 100 + 1
    return n + (-percent * n // 100) + more, n + (-2 * percent * n // (100 + percent)) + more


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, key (a digest of the words in order), prefix (hashes in the common order), found; no exchange."""
    grams, classes = frequent(docs, k)
    sent = docs.sparkSession.sparkContext.broadcast((grams, classes))  # FREQUENT entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, classes = sent.value
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                texts = batch.column("text").to_pylist()
                doc, h = shingle_sets(texts, k)
                often = np.zeros(len(h), np.int64)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
                    often = np.where(grams[at] == h, classes[at], 0)
                order = np.lexsort((h, often, doc))
                size = np.bincount(doc, minlength=len(texts))
                sought, found = (np.where(size > 0, x, 0) for x in lengths(size, percent))
                rank = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                h = h[order][rank < np.repeat(sought, size)]
                keys = [hashlib.sha256(b" ".join((t or "").encode().lower().split())).digest() for t in texts]
                prefix = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sought)].astype(np.int32), pa.array(h.view(np.int64)))
                yield pa.record_batch([batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(keys, pa.binary()), prefix, pa.array(found.astype(np.int32))], names=["doc_id", "n_shingles", "key", "prefix", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, key binary, prefix array<long>, found int")


def merge_skip(lists: list[list[int]], t: int) -> list[tuple[int, int]]:
    """Values that t lists or more have, and how many; lists ascend.

    Where the least value is in fewer lists, the next t - 1 least ones are skipped with it up to
    the value that is then least: what lies between can't be in t lists.
    """
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    out = []
    while len(heap) >= t:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
        if len(popped) >= t:
            out.append((value, len(popped)))
            moved = [(i, at + 1) for _, i, at in popped]
        else:
            while heap and len(popped) < t - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            moved = [(i, bisect_left(lists[i], heap[0][0], at)) for _, i, at in popped]
        for i, at in moved:
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))
    return out


class Lists:
    """Inverted lists of the sets of one node, searched by DivideSkip."""

    def __init__(self, doc: np.ndarray, h: np.ndarray, first: int, last: int):
        a, b = np.searchsorted(doc, [first, last])
        self.starts = np.searchsorted(doc[a:b], np.arange(first, last + 1))
        self.size = np.diff(self.starts)
        _, self.local, self.length = np.unique(h[a:b], return_inverse=True, return_counts=True)
        self.begin = np.cumsum(self.length) - self.length
        order = np.argsort(self.local, kind="stable")
        self.member = (doc[a:b] - first)[order]
        #: Numbers of n-gram and member as one, ascending: what a probe searches.
        self.key = self.local[order] * len(self.size) + self.member

    def _merged(self, lists: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Members of t of the lists or more, ascending, and of how many."""
        length = self.length[lists]
        if (total := int(length.sum())) <= HEAP:
            met = merge_skip([self.member[a : a + n].tolist() for a, n in zip(self.begin[lists].tolist(), length.tolist(), strict=True)], t)
            return np.array([x[0] for x in met], np.int64), np.array([x[1] for x in met], np.int64)
        at = np.arange(total) + np.repeat(self.begin[lists] - (np.cumsum(length) - length), length)
        shared = np.bincount(self.member[at], minlength=len(self.size))
        found = np.flatnonzero(shared >= t)
        return found, shared[found]

    def search(self, p: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets that share T members with set p, itself among them, and how many they share."""
        n = int(self.size[p])
        own = self.local[self.starts[p] : self.starts[p + 1]]
        own, t = own[self.length[own] > 1], -(-percent * n // 100)
        if len(own) < t:
            return np.array([p]), np.array([n])
        own = own[np.argsort(self.length[own], kind="stable")]
        long = min(t - 1, int(t / (MU * math.log2(self.length[own[-1]]) + 1)))
        found, shared = self._merged(own[: len(own) - long], t - long)
        for begin in range(len(own) - long, len(own), PROBED):
            keep = shared + len(own) - begin >= t
            found, shared = found[keep], shared[keep]
            probe = (own[begin : begin + PROBED, None] * len(self.size) + found).ravel()
            at = np.minimum(np.searchsorted(self.key, probe), len(self.key) - 1)
            shared = shared + (self.key[at] == probe).reshape(-1, len(found)).sum(0)
        shared = np.where(found == p, n, shared)
        return found[shared >= t], shared[shared >= t]


def _joined(lists: Lists, members: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links that together join what links of the first ``members`` sets with all sets connect.

    A set that links to p is covered: what links with it lies within twice the linking
    distance of p, so p covers that as well, or has it wait for a turn. A turn is skipped
    where all that lies so near to common pivots is joined already.
    """
    n = len(lists.size)
    union, near = _Union(n), _Union(n)
    covered, waiting, done = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)

    def turn(p: int, reach: int) -> Iterator[tuple[int, int]]:
        found, both = lists.search(p, reach)
        either = lists.size[found] + lists.size[p] - both
        linked = 100 * both >= percent * either
        done[p] = True
        if reach < percent:
            covered[found[linked]] = True
            met = found[~linked & (100 * both >= reach * either)]
            waiting[met] = True
            for q in found[linked].tolist() + met.tolist():
                near.join(p, q)
        yield from ((p, q) for q in found[linked].tolist() if union.join(p, q))

    for p in range(members):
        if not covered[p] or waiting[p]:
            yield from turn(p, 2 * percent - 100)
    groups: dict[int, list[int]] = {}
    for p in np.flatnonzero(covered | waiting | done).tolist():
        groups.setdefault(near.find(p), []).append(p)
    for own in groups.values():
        for p in own:
            if waiting[p] and not done[p] and len({union.find(q) for q in own}) > 1:
                yield from turn(p, percent)


def _node_links(rows: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) inside the nodes of rows (path, guest, rep) but those of two guests; texts meet there, ordered by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            doc, h = shingle_sets([r[3] for r in rows], k)
            reps, out = [r[2] for r in rows], []
            for first, last in _bounds([r[0] for r in rows]):
                members = sum(not r[1] for r in rows[first:last])
                out += [(reps[first + p], reps[first + q]) for p, q in _joined(Lists(doc, h, first, last), members, percent)]
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    order = ("path", "guest", "rep")
    rows = rows.join(docs, "rep").select(*order, "text")
    return rows.repartition(4 * tasks(docs.sparkSession), "path").sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def _of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The documents (rep, text) but most of those that ``reps`` lacks, so that joining texts moves fewer of them.

    A filter of ``FILTER`` bits, whatever the tables hold: it lets all wanted ones through.
    """
    place = F.pmod(F.xxhash64("rep"), F.lit(FILTER))
    parts = reps.select((place + 1).alias("at")).select(F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
    parts, _ = staged(parts.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "filter")
    bit = place.bitwiseAND((1 << 15) - 1)
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3).cast("int") + 1, 1)), 16, 10).cast("int")
    known = docs.withColumn("bucket", F.bitmap_bucket_number(place + 1)).join(F.broadcast(parts), "bucket")
    return known.where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(7).cast("int"))) > 0).select("rep", "text")


def _nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path of the nodes that a task can hold among rows (path, guest, rep, n), of equal ones the first; and the larger ones with their sizes."""
    who = F.sum(F.xxhash64("rep", "guest").cast("decimal(38,0)")).alias("who")
    node = rows.groupBy("path").agg(F.count("*").alias("all"), F.sum(F.col("guest").cast("long")).alias("guests"), F.sum("n").alias("grams"), who, F.min("rep").alias("low")).where("all > 1 AND all > guests")
    large = (F.col("all") > MEMBERS) | (F.col("all") * F.col("grams") > WORK)
    ends = node.where(~large).groupBy("all", "who", "low").agg(F.min("path").alias("path")).select("path")
    return ends, node.where(large).select("path", "all", "guests", "grams")


def _banded(grams: DataFrame, percent: int) -> DataFrame:
    """Rows (rep, n, gram, rank, found), once for each ``band`` of sizes in which others may share the n-gram.

    Linked sizes differ by less than the factor of a band, so what larger sets find lies in
    its own band and the next one; what they look up lies in their own.
    """
    band = F.floor(F.log("n") / math.log(100 / (percent - 1)))
    bands = F.when(F.col("found"), F.array(band, band + 1)).otherwise(F.array(band))
    return grams.withColumn("band", F.explode(bands))


def _meetings(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """path (node), guest, rep and n: which classes (rep) must meet, from all documents' prefixes (rep, n, prefix, found).

    Copies go once what only one document has is gone, so that prefixes are exchanged as n-grams alone.

    A class that shares fewer n-grams with all others together than it must share with one
    links with none, and neither do those that it would have to visit for fewer.

    The n-grams of a text that has many near copies would give as many nodes of nearly the same
    classes. Nodes of n-grams whose class of least hash is the same are one: two of them are
    with a probability that is the similarity of their classes, so few remain of those, while
    nodes that have little in common stay apart.
    """
    least = F.floor(F.col("n") * (percent * LEAD) / 10_000) + 1
    grams = rows.select("rep", "n", "found", F.posexplode("prefix").alias("rank", "gram"))
    found = (F.col("rank") < F.col("found")).cast("int")
    shared = grams.groupBy("gram").agg(F.count("*").alias("c"), F.max(found).alias("f")).where("c > 1 AND f = 1").select("gram")
    packed = F.shiftleft(F.col("n"), 32) + 2 * F.col("rank") + found  # one number: all of these rows are exchanged
    grams = grams.select("rep", "gram", packed.alias("of")).join(shared, "gram").repartition("rep")
    rank = F.shiftright(F.col("of").bitwiseAND((1 << 32) - 1), 1)
    grams = grams.select("rep", "gram", F.shiftright("of", 32).alias("n"), rank.alias("rank"), (F.col("of") % 2 == 1).alias("found"))
    at = ("gram", "band")
    by_class, by_gram = Window.partitionBy("rep"), Window.partitionBy("rep", "gram").orderBy("band")
    grams = grams.join(classes.select("rep"), "rep", "left_semi").distinct().withColumn("c", F.count("*").over(by_class))
    grams, _ = staged(grams.where(F.col("c") >= least).drop("c"), "shared-grams", compression="zstd")
    rows = _banded(grams, percent)
    for turn in range(TURNS):
        met = rows.groupBy(*at).agg(F.count("*").alias("c"), F.max("found").alias("f")).where("c > 1 AND f").select(*at)
        rows = rows.join(met, [*at]).repartition("rep").withColumn("nth", F.row_number().over(by_gram))
        rows = rows.withColumn("c", F.sum((F.col("nth") == 1).cast("int")).over(by_class)).withColumn("home", F.min(F.struct("rank", "gram")).over(by_class)["gram"])
        rows, _ = staged(rows.where(F.col("c") >= least).drop("nth", "c"), f"together-{turn}", compression="zstd")
    led = rows.groupBy(*at, "home").agg(F.max(F.col("found").cast("int")).alias("f"), F.min(F.xxhash64("rep")).alias("low"))
    many = led.groupBy(*at).agg(F.min("home").alias("lo"), F.max("home").alias("hi"), F.sum("f").alias("homes"), F.min("low").alias("low"))
    placed = rows.select("rep", "n", *at, "found", "home").join(many.where("lo <> hi").select(*at, "homes", "low"), [*at])
    placed, _ = staged(placed, "placed", compression="zstd")
    few = placed.where(F.col("homes") <= HOMES)
    led = few.where("found").select(*at, F.col("home").alias("to")).distinct()
    visits = few.join(led, [*at]).where("to <> home").groupBy("to", "rep", "n").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    own, guest = F.lit(False).alias("guest"), F.lit(True).alias("guest")
    visits = visits.select(F.xxhash64(F.lit("home"), "to").alias("path"), guest, "rep", "n")
    apart = placed.where(F.col("homes") > HOMES).select(F.xxhash64(F.lit("gram"), "low").alias("path"), own, "rep", "n").distinct()
    home = rows.groupBy("rep").agg(F.min("home").alias("home"), F.max("n").alias("n"))
    return home.select(F.xxhash64(F.lit("home"), "home").alias("path"), own, "rep", "n").unionByName(visits).unionByName(apart)


def _split(rows: DataFrame, big: DataFrame, percent: int) -> DataFrame:
    """Nodes that are too large, in parts: rows as before.

    Where few classes are at home, these go to every lane and each guest to one. Other nodes
    are parted by set size: linked sizes differ by less than the factor of a band, so all meet
    in the upper one's; there are no guests then.
    """
    members = F.col("all") - F.col("guests")
    lanes = F.greatest(F.ceil(2 * F.col("guests") / MEMBERS), F.ceil(F.col("all") * F.col("grams") / WORK))
    tied = rows.join(big.select("path", (2 * members <= MEMBERS).alias("few"), lanes.alias("lanes")), "path")
    lane = F.when(F.col("guest"), F.array(F.pmod(F.xxhash64("rep"), F.col("lanes")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1))
    laned = tied.where("few").select(F.explode(F.transform(lane, lambda i: F.xxhash64("path", F.lit("lane"), i))).alias("path"), "guest", "rep", "n")
    band = F.floor(F.log("n") / math.log(100 / (percent - 1)))
    bands = F.explode(F.array(*(F.xxhash64("path", F.lit("band"), band + i) for i in (0, 1))))
    return laned.unionByName(tied.where("NOT few").select(bands.alias("path"), F.lit(False).alias("guest"), "rep", "n"))


def similar(docs: DataFrame, k: int = 4, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for all documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    sketch, _ = staged(prefixes(docs, k, percent), "prefixes", compression="zstd")
    some = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes, _ = staged(classes, "classes")
    rows = sketch.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "prefix", "found")
    rows, _ = staged(_meetings(rows, classes, percent), "meetings")
    ends, big = _nodes(rows)
    big, _ = staged(big, "large")
    rows, _ = staged(rows.join(ends, "path").unionByName(_split(rows, big, percent)), "nodes") if not big.isEmpty() else (rows.join(ends, "path"), "")
    texts = _of(texts, rows.select("rep"))
    if big.isEmpty():
        found = _node_links(rows, texts, k, percent)
    else:
        ends, big = _nodes(rows)
        big, _ = staged(big, "large-parts")
        found = _node_links(rows.join(ends, "path"), texts, k, percent)
        if not big.isEmpty():
            big = big.select("path", F.col("all").alias("members"), F.col("grams").alias("shingles"))
            found = found.unionByName(_big_links(rows.select("path", "rep"), big, texts, k, percent))
    found, _ = staged(found, "links")
    parts = components(found).withColumnRenamed("vertex", "rep")

    def salt(doc_id: str) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")

    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    known = classes.join(parts, "rep", "left").select("key", F.coalesce("component", "rep").alias("component"), F.explode(F.when(F.col("copies") > 1, every).otherwise(F.array(salt("rep")))).alias("salt"))
    mine = sketch.select("doc_id", "n_shingles", "key", salt("doc_id").alias("salt")).join(known, ["key", "salt"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return mine.select("doc_id", "n_shingles", own.alias("component_id"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, n-grams of four words."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, least(len(w), 4) AS n, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + n - 1], ' ') AS g FROM p),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN size m ON m.doc_id = a JOIN size o ON o.doc_id = b WHERE 100 * common >= 85 * (m.n + o.n - common)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS c FROM size UNION SELECT e.b, r.c FROM reach r JOIN either e ON e.a = r.v),
component AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN component ON v = d.doc_id
"""
