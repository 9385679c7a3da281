"""Operator 3: sharding by vector bin packing.

Groups (equal texts) have a size in three dimensions: bytes, tokens and rows. Each goes to
the shard whose residual capacity has the greatest dot product with the group's size, the
largest groups first, in three steps so that no task and not the driver holds all groups:

- Large groups, of more than a share 1 / ``FINE`` of a shard (at most 3 * shards * FINE of
  them), are packed on the driver. Those of more than 1 / ``SPLIT`` of a shard are cut into
  pieces by row, so that a hot text can't unbalance a shard.
- The others are dealt to parts of about ``PART_GROUPS`` by hash. Each part packs its own
  groups, one by one, into its share of what the large ones left of every shard.
- The ``LAST`` smallest groups of all are kept for the end and packed on the driver into
  what is left then. The law that holds is ``bytes``: exchanging them between shards, or
  moving them where no exchange helps, settles what is left of the difference in bytes.

Slots are numbered without a shard meeting in one task: rows count up within a shard's
part (by a hash of the row), and the parts' counts, a small table, give each an offset.

Defined results: a null text has no bytes and counts as the empty text; rows are taken as
they are, so repeated rows get slots of their own (in an order that their columns give as
far as they differ); null doc_ids work; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import staged, tasks

SHARDS, OVERHEAD = 40, 16
FINE, SPLIT, PART_GROUPS, LAST = 64, 16, 16_384, 4_096
#: Of bytes, tokens and rows in the dot product.
WEIGHTS = (1.0, 0.25, 0.25)
SIZES = ("bytes", "tokens", "rows")


def pack(items: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The shard of each item (a row: bytes, tokens, rows); room: what each shard can take of these."""
    capacity = np.maximum(room.sum(0) / len(room), 1e-9)
    demand, residual = items / capacity, room / capacity
    weight = np.array(WEIGHTS)
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-demand.max(1, initial=0), kind="stable").tolist():
        s = int(np.argmax(residual @ (demand[i] * weight)))
        out[i] = s
        residual[s] -= demand[i]
    return out


def settle(sizes: np.ndarray, out: np.ndarray, load: np.ndarray, rounds: int = 2_000) -> np.ndarray:
    """Exchange single items between the fullest and the emptiest shard, or else move one, while that evens their bytes.

    load: bytes of each shard, these items included.
    """
    load = load.astype(float)
    own = [np.flatnonzero(out == s) for s in range(len(load))]
    for _ in range(rounds):
        a, b = int(np.argmax(load)), int(np.argmin(load))
        gap = load[a] - load[b]
        x, y = own[a], own[b]
        if gap <= 1 or not len(x):
            break
        want, done = sizes[x] - gap / 2, False
        for back, few in ((sizes[y], y), (np.zeros(1), np.array([-1]))):  # -1: nothing comes back
            if not len(few):
                continue
            rank = np.argsort(back, kind="stable")
            at = np.clip(np.searchsorted(back[rank], want), 0, len(rank) - 1)
            lower = np.maximum(at - 1, 0)
            at = np.where(np.abs(back[rank[lower]] - want) < np.abs(back[rank[at]] - want), lower, at)
            move = sizes[x] - back[rank[at]]
            rest = np.abs(gap - 2 * move)
            i = int(np.argmin(rest))
            if rest[i] >= gap:
                continue
            j = int(few[rank[at[i]]])
            own[a], own[b] = x[np.arange(len(x)) != i], np.r_[y[y != j], x[i]]
            out[x[i]] = b
            if j >= 0:
                own[a] = np.r_[own[a], j]
                out[j] = a
            load[a] -= move[i]
            load[b] += move[i]
            done = True
            break
        if not done:
            break
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tokens, grp (a hash of the text) and serial of all rows; texts go no further."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (F.octet_length("text") + OVERHEAD).cast("long").alias("known"))
    spaces = F.length("text") - F.length(F.translate("text", " \n\t\r", "")) + 1
    return rows.select("doc_id", F.coalesce("known", F.lit(OVERHEAD).cast("long")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), spaces.cast("long").alias("tokens"), F.xxhash64("text").alias("grp"), F.monotonically_increasing_id().alias("serial"))


def _sizes(rows: list) -> np.ndarray:
    return np.array([[r[c] for c in SIZES] for r in rows], float).reshape(-1, 3)


def _packed_parts(groups: DataFrame, room: np.ndarray) -> DataFrame:
    """grp, text_crc32, shard and the sizes of groups, packed part by part; room: of all parts together."""
    share = room / np.maximum(room.sum(0), 1e-9)
    schema = "grp long, text_crc32 long, shard int, bytes long, tokens long, rows long"

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("grp", "ascending"), ("text_crc32", "ascending")])
        items = np.c_[tuple(part.column(c).to_numpy() for c in SIZES)].astype(float)
        shard = pack(items, share * items.sum(0))
        return pa.table([part.column("grp"), part.column("text_crc32"), pa.array(shard.astype(np.int32)), *(part.column(c) for c in SIZES)], names=["grp", "text_crc32", "shard", *SIZES])

    return groups.groupBy("part").applyInArrow(run, schema)


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all rows."""
    spark = docs.sparkSession
    rows, _ = staged(measured(docs), "measured")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups, _ = staged(rows.groupBy("grp", "text_crc32").agg(*sums), "groups")
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SIZES), F.count("*").alias("n")).first()
    capacity = np.array([max(1.0, total[c] / shards) for c in SIZES])
    share = F.greatest(*(F.col(c) / float(x) for c, x in zip(SIZES, capacity, strict=True)))
    pieces = F.greatest(F.lit(1), F.ceil(share * SPLIT)).cast("int").alias("pieces")
    large = groups.where(share > 1 / FINE).select("grp", "text_crc32", pieces)  # at most 3 * shards * FINE rows
    cut = rows.join(F.broadcast(large), ["grp", "text_crc32"]).withColumn("piece", F.pmod(F.xxhash64("serial"), F.col("pieces")).cast("int"))
    items = cut.groupBy("grp", "text_crc32", "piece").agg(*sums).orderBy("grp", "text_crc32", "piece").collect()  # the large groups' pieces
    where = pack(_sizes(items), np.tile(capacity, (shards, 1)))
    taken = np.stack([np.bincount(where, weights=x, minlength=shards) for x in _sizes(items).T], 1)

    small = groups.where(share <= 1 / FINE)
    last = small.orderBy("bytes", "grp", "text_crc32").limit(LAST).collect()
    ends = spark.createDataFrame([(r.grp, r.text_crc32) for r in last], "grp long, text_crc32 long")
    parts = max(1, -(-total["n"] // PART_GROUPS))
    others = small.join(F.broadcast(ends), ["grp", "text_crc32"], "left_anti").withColumn("part", F.pmod(F.xxhash64("grp", "text_crc32"), F.lit(parts)))
    middle, _ = staged(_packed_parts(others, np.maximum(capacity - taken, 1e-9)), "packed")
    for r in middle.groupBy("shard").agg(*(F.sum(c).alias(c) for c in SIZES)).collect():  # a row a shard
        taken[r.shard] += [r[c] for c in SIZES]
    room = np.maximum(capacity - taken, 0)
    left = pack(_sizes(last), np.where(room.sum(0) > 0, room, 1.0))
    sizes = _sizes(last)[:, 0]
    left = settle(sizes, left, taken[:, 0] + np.bincount(left, weights=sizes, minlength=shards))

    ended = spark.createDataFrame([(r.grp, r.text_crc32, int(s)) for r, s in zip(last, left, strict=True)], "grp long, text_crc32 long, shard int")
    table = spark.createDataFrame([(r.grp, r.text_crc32, r.piece, int(s)) for r, s in zip(items, where, strict=True)], "grp long, text_crc32 long, piece int, shard int")
    columns = ["doc_id", "size", "text_crc32", "serial", "shard"]
    whole = rows.join(F.broadcast(large), ["grp", "text_crc32"], "left_anti").join(middle.select("grp", "text_crc32", "shard").unionByName(ended), ["grp", "text_crc32"]).select(columns)
    placed = whole.unionByName(cut.join(F.broadcast(table), ["grp", "text_crc32", "piece"]).select(columns)).withColumn("part", F.pmod(F.xxhash64("serial"), F.lit(tasks(spark))).cast("int"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset"))  # shards * parts rows
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "serial")) - 1
    numbered = placed.withColumn("within", within).join(F.broadcast(offsets), ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` over 40 shards."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
