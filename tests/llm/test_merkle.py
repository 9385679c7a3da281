"""Operator 11 against a recursive restatement on rows, and its SQL on odd tables."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loreloom.llm import merkle

from .conftest import ASCII_LOWER

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def fold(nodes):
    """The root, and for each node its path: the runs it passes and its place in each."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for i, a in enumerate(at):
            paths[i].append((runs[a // 16], a % 16))
        level, at = [h("".join(r)) for r in runs], [a // 16 for a in at]
    return level[0], paths


def expected(rows):
    sources = {}
    for r in rows:
        sources.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    trees = []
    for _, own in sorted(sources.items()):
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *fold([leaf(r) for r in own])))
    root, tops = fold([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            found = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                found = (*r[:4], r[4].translate(ASCII_LOWER))
            node, proof = leaf(found), ""
            for run, at in [*path, *top]:
                proof += "".join(run[:at] + run[at + 1 :])
                node = h("".join([*run[:at], node, *run[at + 1 :]]))
            out.append((r[0], leaf(r), subroot, root, h(proof), node, node == root))
    return sorted(out, key=repr)


def manifest(docs, most=merkle.BLOCK):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = merkle.leaves(docs, lower, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return sorted(map(tuple, merkle.manifest(found, most).collect()), key=repr)


def test_manifest_is_the_rule(spark):
    """One hot source over several superblocks, sources of one row, nulls, ties and repeated rows."""
    rows = [(i, "hot", "en", 3, f"Text {i}") for i in range(700)]
    rows += [(i, f"s{i % 23}", None, None, "É" * i) for i in range(60)] + [(1, "one", "de", 2, None), (2**60 + 1, "", "de", 2, "")]
    rows += [(5, "hot", "en", 3, "other"), (5, "hot", "en", 3, "Other")] + [(None, "hot", None, 1, "No id"), (None, None, None, None, None)] + [(7, None, "x", 1, "Same row")] * 20
    expect = expected(rows)
    docs = spark.createDataFrame([(*r, "a", 9) for r in rows], f"{DOCS}, leaf string, position int")
    assert manifest(docs) == expect
    assert manifest(docs, 16) == expect


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257])
def test_heights(spark, n):
    rows = [(i, "s", "l", 1, "Ab") for i in range(n)]
    assert manifest(spark.createDataFrame(rows, DOCS)) == expected(rows)


def test_long_and_no_texts(spark):
    rows = [(0, "s", "l", 1, "Ab " * 700_000), (1, None, "l", 1, "")]
    assert manifest(spark.createDataFrame(rows, DOCS)) == expected(rows)
    assert manifest(spark.createDataFrame([], DOCS)) == []
