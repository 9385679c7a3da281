"""Operator 11: a Merkle manifest of a dataset, with a proof for every row.

Every row is a leaf, the digest of its length-prefixed fields. In each source the leaves
ascend by doc_id and every ``FAN`` consecutive nodes become one; the sources' subroots are
folded in the same way to the root. Digests are lower-case hex SHA-256, folded as hex text.

Leaves are hashed where documents are read, and only ids and digests go on. Their places
come from a range exchange, so a source of any size is spread over all tasks. Superblocks
of ``BLOCK`` consecutive leaves of a source (or some whole small sources) reduce to their
top nodes; what lies above is folded level by level, a run of FAN nodes a row, and then
handed down again as each superblock's path to the root. Leaves and these outer nodes are
cogrouped by superblock: each group finishes its own levels, joins both to a proof for
each leaf, and folds the leaf that was found up to the root. No group holds more than two
superblocks, and no step above them more than FAN nodes a row.

Defined results: null fields are hashed as ``-`` and differ from empty ones; a null source
comes before all others, rows without doc_id before the others of their source; rows of one
source and doc_id come in the order of their leaves, so repeated rows each have their own
proof; a row is tampered with only if it has a doc_id and a text. An empty table has no
root and gives no rows; texts of any length are hashed whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import Ranked
from .sql import CRC_TABLE, crc32
from .staging import staged

FAN = 16
BLOCK = FAN**3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest of fields, each as its byte count, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)).cast("binary"), 256)


def leaves(docs: DataFrame, found: Column | None = None, where: Column | None = None) -> DataFrame:
    """source, doc_id, leaf, and the leaf of what was found in place of ``text`` (null: the same)."""
    fields = {c: F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string") for c in FIELDS}
    other = F.lit(None).cast("string") if found is None else F.when(where & fields["text"].isNotNull(), leaf([*(fields[c] for c in FIELDS[:-1]), found]))
    source = F.when(fields["source"].isNull(), "0").otherwise(F.concat(F.lit("1"), fields["source"]))
    return docs.select(source.alias("source"), fields["doc_id"].alias("doc_id"), leaf(list(fields.values())).alias("leaf"), other.alias("other"))


class Folded:
    """Trees over nodes (tree, idx, digest, width): one row for each run of FAN nodes of a level."""

    def __init__(self, nodes: DataFrame):
        self._nodes, self._levels, roots = nodes, [], None
        while True:
            own = nodes.where("width = 1").select("tree", "digest")
            roots = own if roots is None else roots.unionByName(own)
            many = nodes.where("width > 1")
            if many.isEmpty():
                break
            ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
            runs, _ = staged(many.groupBy("tree", F.floor(F.col("idx") / FAN).alias("run")).agg(ordered.alias("nodes"), F.first("width").alias("width")), "runs")
            self._levels.append(runs)
            nodes = runs.select("tree", F.col("run").alias("idx"), F.sha2(F.concat_ws("", "nodes").cast("binary"), 256).alias("digest"), F.ceil(F.col("width") / FAN).alias("width"))
        #: tree, digest
        self.roots = roots

    def paths(self, above: DataFrame) -> DataFrame:
        """tree, idx and path of every node: the runs it passes, lowest first, then ``above`` (tree, path).

        A run's path is handed to its FAN nodes, so no key of these joins repeats more often.
        """
        down = None
        for runs in reversed(self._levels):
            top = runs.where(F.col("width") <= FAN).select("tree", "run").join(above, "tree")
            down = top if down is None else top.unionByName(down.withColumnRenamed("idx", "run"))
            rows = runs.join(down, ["tree", "run"]).select("tree", "run", "nodes", "path", F.posexplode("nodes").alias("at", "_"))
            step = F.struct(F.col("at"), F.col("nodes"))
            down, _ = staged(rows.select("tree", (F.col("run") * FAN + F.col("at")).alias("idx"), F.concat(F.array(step), "path").alias("path")), "paths")
        alone = self._nodes.where("width = 1").select("tree", "idx").join(above, "tree")
        return alone if down is None else down.unionByName(alone)


PATH = "array<struct<at:int,nodes:array<string>>>"


def _levels(nodes: list[str], width: int, most: int) -> list[list[str]]:
    """The nodes and what they become, level by level, as long as their tree has several and a superblock lasts."""
    levels, size = [nodes], 1
    while width > 1 and size < most:
        levels.append([digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)])
        nodes, width, size = levels[-1], -(-width // FAN), size * FAN
    return levels


def _trees(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of each source and superblock, in order."""
    for _, own in rows.sort_values(["tree", "position"]).groupby(["tree", "block"], sort=False):
        yield own


def _tops(most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        made = [(int(own["tree"].iloc[0]), int(own["block"].iloc[0]), _levels(own["leaf"].tolist(), int(own["n"].iloc[0]), most)[-1][0], int(own["width"].iloc[0])) for own in _trees(rows)]
        return pd.DataFrame(made, columns=["tree", "idx", "digest", "width"])

    return run


def _proved(root: str, most: int):
    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        above: dict[tuple, list] = {}
        for r in outer.sort_values("step").itertuples():
            above.setdefault((r.tree, r.block), []).append((r.at, list(r.nodes), r.up))
        out = []
        for own in _trees(rows):
            levels = _levels(own["leaf"].tolist(), int(own["n"].iloc[0]), most)
            steps = above.get((own["tree"].iloc[0], own["block"].iloc[0]), [])
            subroot = next((nodes[at] for at, nodes, up in steps if up), root)
            for i, (doc_id, first, other) in enumerate(zip(own["doc_id"], levels[0], own["other"], strict=True)):
                proof, node, at = [], other if isinstance(other, str) else first, i
                for level in levels[:-1]:
                    begin = at - at % FAN
                    run = level[begin : begin + FAN]
                    proof += run[: at - begin] + run[at - begin + 1 :]
                    run[at - begin] = node
                    node, at = digest("".join(run)), at // FAN
                for k, nodes, _ in steps:
                    proof += nodes[:k] + nodes[k + 1 :]
                    node = digest("".join([*nodes[:k], node, *nodes[k + 1 :]]))
                out.append((doc_id, first, subroot, root, digest("".join(proof)), node, node == root))
        return pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    return run


def manifest(found: DataFrame, most: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of rows of ``leaves``.

    ``most``: leaves of a superblock, a power of FAN.
    """
    spark = found.sparkSession
    rows, _ = staged(found.withColumn("place", F.monotonically_increasing_id()), "leaves", compression="zstd")
    ranked = Ranked(rows, "source", ["doc_id", "leaf", "place"])
    if not ranked.total:
        return spark.createDataFrame([], RESULT)
    block = F.floor(F.col("position") / most)
    large = F.col("n") > most
    placed = ranked.attach().select(
        F.col("start").alias("tree"), "position", "n", block.alias("block"), F.when(large, F.ceil(F.col("n") / most)).otherwise(1).alias("width"), F.col("doc_id").cast("string").alias("doc_id"), "leaf", "other",
        F.when(large, F.col("start")).otherwise(-1).alias("a"), F.when(large, block).otherwise(F.floor(F.col("start") / most)).alias("b"),
    )
    tops = placed.select("a", "b", "tree", "block", "position", "n", "width", "leaf").groupBy("a", "b").applyInPandas(_tops(most), "tree long, idx long, digest string, width long")
    sources = Folded(staged(tops, "tops")[0])
    subroots = Ranked(staged(sources.roots.select(F.lit(0).alias("one"), F.col("tree").alias("of"), "digest"), "subroots")[0], "one", ["of"])
    of = staged(subroots.attach().select(F.lit(0).cast("long").alias("tree"), F.col("position").alias("idx"), "digest", F.col("n").alias("width"), "of"), "of")[0]
    whole = Folded(of.drop("of"))
    root = whole.roots.first()["digest"]
    start = spark.createDataFrame([(0, [])], f"tree long, path {PATH}")
    of = whole.paths(start).join(of.select("idx", "of"), "idx").select(F.col("of").alias("tree"), "path")
    of, _ = staged(of, "source-paths")
    height = len(whole._levels)
    paths = sources.paths(of.select("tree", "path")).withColumn("inner", F.size("path") - height)
    inner = F.col("inner") > 0
    outer = paths.select(
        F.when(inner, F.col("tree")).otherwise(-1).alias("a"), F.when(inner, F.col("idx")).otherwise(F.floor(F.col("tree") / most)).alias("b"),
        "tree", F.col("idx").alias("block"), "inner", F.posexplode("path").alias("step", "s"),
    )
    outer = outer.select("a", "b", "tree", "block", "step", "s.at", "s.nodes", (F.col("step") >= F.col("inner")).alias("up"))
    proved = placed.drop("width").groupBy("a", "b").cogroup(outer.groupBy("a", "b")).applyInPandas(_proved(root, most), RESULT.replace("long", "string", 1))
    return proved.withColumn("doc_id", F.col("doc_id").cast("long"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; where 5 divides the id's crc32, the text was found with A-Z lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(leaves(docs, lower, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0))


def _sql() -> str:
    """Levels unrolled: six for the leaves of a source, three for the sources."""
    text, heights = [], {"d": 6, "s": 3}

    def levels(name: str, first: str) -> str:
        """Nodes t (tree), i, h, n of each level; runs of each level; the last level's one node a tree."""
        at = first
        for k in range(heights[name]):
            text.append(f"{name}r{k} AS (SELECT t, i // 16 AS r, max(n) AS n, list(h ORDER BY i) AS ns FROM {at} GROUP BY ALL)")
            text.append(f"{name}n{k} AS (SELECT t, r AS i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN ns[1] ELSE sha256(array_to_string(ns, '')) END AS h FROM {name}r{k})")
            at = f"{name}n{k}"
        return at

    def climb(name: str, at: str, key: str, more: str) -> str:
        for k in range(heights[name]):
            r = f"{name}r{k}"
            proof = f"CASE WHEN r.n = 1 THEN '' ELSE array_to_string(list_concat(r.ns[:a.i % 16], r.ns[a.i % 16 + 2:]), '') END"
            fold = f"CASE WHEN r.n = 1 THEN a.f ELSE sha256(array_to_string(list_concat(r.ns[:a.i % 16], [a.f], r.ns[a.i % 16 + 2:]), '')) END"
            text.append(f"{name}c{k} AS (SELECT {more}, a.{key}, a.i // 16 AS i, a.p || {proof} AS p, {fold} AS f FROM {at} a JOIN {r} r ON r.t = a.{key} AND r.r = a.i // 16)")
            at = f"{name}c{k}"
        return at

    fields = lambda t: "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", t)) + ")"
    text.append(CRC_TABLE)
    text.append(f"o AS (SELECT *, {crc32('doc_id::VARCHAR')} AS crc FROM documents, crc_table)")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    text.append(f"l AS (SELECT doc_id, source, {fields('text')} AS h, CASE WHEN crc % 5 = 0 AND text IS NOT NULL THEN {fields(lower)} END AS other FROM o)")
    text.append("ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM l)")
    text.append(f"top AS (SELECT 0 AS t, t AS i, count(*) OVER () AS n, h FROM {levels('d', 'ranked')})")
    end = levels("s", "top")
    low = climb("d", "(SELECT doc_id, h, t, i, '' AS p, coalesce(other, h) AS f FROM ranked)", "t", "a.doc_id, a.h")
    text.append(f"up AS (SELECT doc_id, a.h, top.h AS subroot, a.t AS i, 0 AS z, a.p, a.f FROM {low} a JOIN top ON top.i = a.t)")
    high = climb("s", "up", "z", "a.doc_id, a.h, a.subroot")
    return "WITH " + ",\n".join(text) + f"\nSELECT a.doc_id, a.h AS leaf, subroot, e.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = e.h AS verified FROM {high} a, {end} e"


OP11_SQL = _sql()
