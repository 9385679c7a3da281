"""Operator 12: the prefix trie of conversations, by the skeleton of range splitters.

A turn goes on as a digest of role and text and the count of its words; a conversation is
the concatenation of its turns' digests, so that the bytewise order of paths is that of the
sequences. Conversations are dealt to shards by range of (path, conv_id). Nodes that lie in
several shards are prefixes of the splitters between them: these prefixes, the skeleton,
are numbered and broadcast. Each shard walks its sorted conversations with a stack as deep
as the path, and finishes all nodes that aren't in the skeleton; of those in it, it gives
partial counts, which are reduced to one row each. Copies of one conversation are ordered
by conv_id, so a group of any size is dealt to several shards, whose ends follow each other.

Bounds: a shard gets about a fourth of a task's conversations, whatever they hold. The
skeleton has at most one node for each shard and turn of its splitter. A conversation of
more than ``HEAD`` turns whose head no other one has is cut there: what follows is a chain
of nodes of its own, made without gathering it; those that share their head are kept whole,
20 bytes a turn. The digest of a node's ends is taken over a stream of pieces of up to
``PIECE`` bytes.

Defined results: turns are ordered by turn, null first, and by digest where equal, so
repeated rows are turns of their own; null roles and texts are empty; rows without conv_id
belong to no conversation; an empty table has no node. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import Ranked
from .sql import CRC_TABLE, crc32
from .staging import lowest, staged, tasks

#: Bytes of a turn's digest.
TURN = 16
HEAD, PIECE = 1 << 14, 1 << 16
#: Shards a task, and conversations of the sample a shard, from which splitters are taken.
SHARDS, SAMPLE = 4, 32
WORD = r"[^\x20\x09-\x0D]+"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SHARED = "skeleton int, parent int, part long, seq long, piece binary"
FIELDS = [x.split()[0] for x in f"{NODES}, {SHARED}".split(", ")]
_TYPES = [pa.int64()] * 7 + [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest and words of each turn; texts go no further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    full = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    digest = F.unhex(F.substring(full, 1, 2 * TURN)).alias("digest")
    return rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest, F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"))


def positioned(rows: DataFrame) -> Ranked:
    """Turns in order; positions come from a range exchange, so no conversation is gathered for them."""
    rows, _ = staged(rows.withColumn("place", F.monotonically_increasing_id()), "turns", compression="zstd")
    return Ranked(rows, "conv_id", ["turn", "digest", "place"])


def shared_heads(ranked: Ranked, base: Column, h: Column, most: int) -> DataFrame:
    """conv_id, position, digest, words: up to ``h`` (at most ``most``) first turns of conversation ``base``, then one's own from ``h`` on.

    A conversation that gets no turn has one row without digest.
    """
    convs = ranked.groups.select("conv_id", "n", base.alias("base"), h.alias("h"))
    known = ranked.groups.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(known, "base", "left").withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0))).cast("long"))
    convs, _ = staged(convs.join(ranked.groups.select("conv_id", "start"), "conv_id"), "convs")
    rows = ranked.attach(convs.select("conv_id", "start", "h", "lead"))
    own = rows.where("position >= h").select("conv_id", (F.col("position") - F.col("h") + F.col("lead")).alias("position"), "digest", "words")
    first = ranked.attach().where(F.col("position") < most).select(F.col("conv_id").alias("base"), "position", "digest", "words")
    led = first.join(convs.where("lead > 0").select("conv_id", "base", "lead"), "base").where("position < lead").select("conv_id", "position", "digest", "words")
    nothing = convs.where("lead = 0 AND n <= h").select("conv_id", F.lit(0).cast("long").alias("position"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("words"))
    return own.unionByName(led).unionByName(nothing)


def paths(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """conv_id, path, words (4 bytes a turn) and cut; and the turns that were cut off, if any."""

    def joined(rows: DataFrame) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("position", "digest", "words"))))
        words = F.unhex(F.array_join(F.transform("t", lambda x: F.lpad(F.hex(x["words"]), 8, "0")), ""))
        path = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), ""))
        return rows.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", path.alias("path"), words.alias("words"))

    lengths = rows.groupBy("conv_id").agg(F.max("position").alias("last")).where(F.col("last") >= HEAD - 1)
    long, _ = staged(lengths, "long")
    if long.isEmpty():
        return joined(rows).withColumn("cut", F.lit(False)), None
    heads = joined(rows.where(F.col("position") < HEAD).join(long.select("conv_id"), "conv_id", "left_semi"))
    alone = heads.groupBy("path").agg(F.count("*").alias("k"), F.min("conv_id").alias("conv_id")).where("k = 1")
    alone, _ = staged(alone.join(long.where(F.col("last") >= HEAD), "conv_id").select("conv_id", F.lit(True).alias("cut")), "alone")
    kept = rows.join(alone, "conv_id", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    whole = joined(kept.where(~F.col("cut") | (F.col("position") < HEAD)))
    whole = whole.join(alone, "conv_id", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    return whole, kept.where(F.col("cut") & (F.col("position") >= HEAD)).select("conv_id", "position")


class Skeleton:
    """The trie of splitter paths: node 0 is the root, nodes are numbered before their children."""

    def __init__(self, splitters: list[tuple[bytes, bytes]]):
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.words = [-1], [0], [0]
        for path, words in splitters:
            node = 0
            for i in range(0, len(path), TURN):
                key = (node, path[i : i + TURN])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(i // TURN + 1)
                    self.words.append(int.from_bytes(words[i // TURN * 4 :][:4]))
                node = self.child[key]


class _Node:
    __slots__ = ("begun", "children", "conv_id", "convs", "count", "ended", "ends", "leaves", "saved", "skeleton", "words")

    def __init__(self, skeleton: int, words: int):
        self.skeleton, self.words, self.conv_id = skeleton, words, None
        self.convs = self.count = self.leaves = self.saved = 0
        self.children: list[list] = []
        self.ends, self.ended, self.begun = hashlib.sha256(), bytearray(), False

    def digest(self) -> str:
        """Of the ends so far; what they begin with is a comma."""
        self.take()
        return self.ends.hexdigest()

    def take(self) -> None:
        self.ends.update(self.ended[not self.begun :])
        self.begun, self.ended = self.begun or bool(self.ended), bytearray()

    def met(self, conv_id: int) -> None:
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)


def walk(rows: Iterator[tuple], skeleton: Skeleton, most: int = PIECE) -> Iterator[list]:
    """Finished nodes (skeleton -1), partial ones and pieces of ends, from (part, path, conv_id, words, cut) in that order.

    ``most``: bytes of ends that a node holds.
    """
    part, last, stack, seq = None, b"", [], 0

    def piece(node: _Node) -> list:
        nonlocal seq
        seq += 1
        row = [None] * 8 + [node.skeleton, None, part, seq, bytes(node.ended)]
        node.ended = bytearray()
        return row

    def close(depth: int) -> Iterator[list]:
        """Take nodes off the stack until ``depth`` are left."""
        while len(stack) > depth:
            node, above = stack.pop(), stack[-1] if stack else None
            own = node.skeleton < 0
            if own:
                node.leaves += node.count == 0
                node.saved += (node.convs - 1) * node.words
                for child in node.children:
                    child[2] = node.conv_id
                    yield child
                row = [node.conv_id, len(stack), None, node.convs, node.count, node.leaves, node.saved, node.digest(), -1, above.skeleton, None, None, None]
                if above.skeleton < 0:
                    above.children.append(row)
                else:
                    yield row
            else:
                if node.ended:
                    yield piece(node)
                yield [node.conv_id, len(stack), None, node.convs, node.count, node.leaves, node.saved, None, node.skeleton, None, None, None, None]
            if above is not None:
                above.count += own
                above.convs += node.convs
                above.leaves += node.leaves
                above.saved += node.saved
                above.met(node.conv_id)

    for now, path, conv_id, words, cut in rows:
        if now != part:
            yield from close(0)
            part, last, seq = now, b"", 0
            stack.append(_Node(0, 0))
        same, most = 0, min(len(path), len(last))
        while same < most and path[same : same + TURN] == last[same : same + TURN]:
            same += TURN
        yield from close(same // TURN + 1)
        for i in range(same, len(path), TURN):
            above = stack[-1].skeleton
            stack.append(_Node(skeleton.child.get((above, path[i : i + TURN]), -1) if above >= 0 else -1, int.from_bytes(words[i // TURN * 4 :][:4])))
        node, last = stack[-1], path
        node.convs += 1
        node.met(conv_id)
        if cut:
            node.count += 1
            node.leaves += 1
            continue
        if node.skeleton < 0 and len(node.ended) > most:
            node.take()
        elif len(node.ended) > most:
            yield piece(node)
        node.ended += b",%d" % conv_id
    yield from close(0)


def _batches(rows: Iterator[list], names: list[str], kinds: list[pa.DataType], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _shared_ends(pieces: DataFrame) -> DataFrame:
    """skeleton and ends_sha256 of streams of pieces, in the order of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[tuple]:
            node, ends = None, hashlib.sha256()
            for now, _, _, piece in _rows(batches):
                if now != node:
                    if node is not None:
                        yield node, ends.hexdigest()
                    node, ends, piece = now, hashlib.sha256(), piece[1:]
                ends.update(piece)
            if node is not None:
                yield node, ends.hexdigest()

        return _batches(hashed(), ["skeleton", "ends_sha256"], [pa.int32(), pa.string()])

    order = ("skeleton", "part", "seq")
    return pieces.select(*order, "piece").repartition(tasks(pieces.sparkSession), "skeleton").sortWithinPartitions(*order).mapInArrow(run, "skeleton int, ends_sha256 string")


def trie(paths: DataFrame, tail: DataFrame | None = None) -> DataFrame:
    """The nodes (see ``NODES``) of conversations given by conv_id, path, words and cut."""
    spark = paths.sparkSession
    paths, _ = staged(paths, "paths", compression="zstd")
    shards = SHARDS * tasks(spark)
    sample = sorted(map(tuple, lowest(paths.select("path", "conv_id", "words"), F.xxhash64("conv_id"), SAMPLE * shards).collect()))
    if not sample:
        return spark.createDataFrame([], NODES)
    splitters = [sample[i] for i in sorted({len(sample) * k // shards for k in range(1, shards)})]
    cuts, skeleton = [s[:2] for s in splitters], Skeleton([(s[0], s[2]) for s in splitters])
    sent = spark.sparkContext.broadcast((cuts, skeleton))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value[0]
        for batch in batches:
            at = [bisect.bisect_right(cuts, k) for k in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(at, pa.int64()), *batch.columns], names=["part", *batch.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(walk(_rows(batches), sent.value[1]), FIELDS, _TYPES)

    dealt = paths.select("path", "conv_id", "words", "cut").mapInArrow(deal, "part long, path binary, conv_id long, words binary, cut boolean")
    dealt = dealt.repartition(tasks(spark), "part").sortWithinPartitions("part", "path", "conv_id")
    made, _ = staged(dealt.mapInArrow(run, f"{NODES}, {SHARED}"), "nodes", compression="zstd")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    partial = made.where("skeleton >= 0 AND piece IS NULL").groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *sums)
    found = {r.skeleton: r for r in partial.collect()}  # a row for each node of the skeleton
    more = {s: [0, 0, 0] for s in found}  # what skeleton nodes add: children, leaves, saved tokens
    for s in sorted(found, reverse=True):
        own = more[s]
        own[1] += found[s].n_children + own[0] == 0
        own[2] += (found[s].n_convs - 1) * skeleton.words[s]
        if s:
            above = more[skeleton.parent[s]]
            more[skeleton.parent[s]] = [above[0] + 1, above[1] + own[1], above[2] + own[2]]
    rows = [(s, r.conv_id, skeleton.depth[s], found[skeleton.parent[s]].conv_id if s else None, r.n_convs, *(a + b for a, b in zip(r[3:], more[s], strict=True))) for s, r in found.items()]
    known = spark.createDataFrame(rows, "skeleton int, " + NODES.replace(", ends_sha256 string", ""))
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    names = [x.split()[0] for x in NODES.split(", ")]
    shared = known.join(_shared_ends(made.where("piece IS NOT NULL")), "skeleton", "left").select(*names[:-1], ends)
    parents = known.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("of"))
    local = made.where("skeleton < 0").join(F.broadcast(parents), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of")).select(*names)
    nodes = local.unionByName(shared)
    if tail is None:
        return nodes
    n = paths.where("cut").select("conv_id")
    ends_at = tail.groupBy("conv_id").agg(F.max("position").alias("last")).join(n, "conv_id", "left_semi")
    one, end = F.lit(1).cast("long"), F.col("position") == F.col("last")
    own = F.sha2(F.when(end, F.col("conv_id").cast("string")).otherwise("").cast("binary"), 256)
    chain = tail.join(ends_at, "conv_id").select("conv_id", (F.col("position") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (~end).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), own.alias("ends_sha256"))
    return nodes.unionByName(chain)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``conversations``; of every twenty the first one's head leads the others."""
    ranked = positioned(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    conv = F.col("conv_id")
    rows = shared_heads(ranked, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    return trie(*paths(staged(rows, "rebuilt", compression="zstd")[0]))


OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, sha256(octet_length(encode(r)) || ':' || r || x)) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, ({crc32("conv_id::VARCHAR")}) % 4 AS h FROM o, crc_table),
c AS (SELECT h.conv_id, list_concat(coalesce(b.own[:h.h], []), h.own[h.h + 1:]) AS path FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM c),
n AS (SELECT path[:d] AS node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = d), '')) AS ends_sha256 FROM p GROUP BY ALL),
k AS (SELECT n.*, m.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.node[:n.depth] = n.node) AS n_children,
  CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.node[n.depth].x, '[^ 	-
]+')) END AS saved
  FROM n LEFT JOIN n m ON m.depth = n.depth - 1 AND m.node = n.node[:n.depth - 1]),
u AS (SELECT node[:d] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM k) GROUP BY 1)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM k JOIN u USING (node)
"""
