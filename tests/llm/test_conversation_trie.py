"""Operator 12 against a brute-force trie."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loreloom.llm import conversation_trie as ct

TURNS = "conv_id long, turn long, role string, text string"


def expected(rows):
    own: dict[int, list] = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).hexdigest(), (r or "", x or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        k = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:k] + ts[k:])
    return nodes_of(paths)


def nodes_of(paths):
    members: dict[tuple, list] = {}
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = sum(len(x) == len(node) + 1 for x in below)
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in who if len(paths[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(rows):
    ranked = ct.positioned(ct.turns(rows))
    c = F.col("conv_id")
    made = ct.shared_heads(ranked, c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, 3)
    return sorted(map(tuple, ct.trie(*ct.paths(made)).collect()), key=repr)


def odd_turns(seed, convs=130):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), 400, 415, -7, -20, 10**17]:
        rows += [(c, rng.choice([None, t, t]), rng.choice(["user", None, ""]), rng.choice([None, "", "a b", "x\ty", "same words here"])) for t in range(rng.choice([1, 1, 2, 3, 6]))]
    rows += [(c, t, "user", f"hot {t}") for c in range(500, 600) for t in range(3)]
    return rows + [(None, 1, "user", "no conversation"), (3, 2, "u", "twice"), (3, 2, "u", "twice")]


@pytest.mark.parametrize("head", [1, 2, 5, 1 << 14])
def test_trie_is_the_rule(spark, monkeypatch, head):
    """Copies of one conversation over many shards, repeated turns, nulls, absent leaders; heads cut at any length."""
    rows = odd_turns(head)
    monkeypatch.setattr(ct, "HEAD", head)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{TURNS}, path string, depth int")
    assert rebuilt(frame) == expected(rows)


def test_long_conversation_and_none(spark):
    rows = [(c, t, "user", f"w {t}") for c in (40, 60) for t in range(1500)] + [(80, 0, "user", "y " * 300_000)]
    got = rebuilt(spark.createDataFrame(rows, TURNS))
    one, end = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"40,60").hexdigest()
    chain = {(40, d, 40, 2, int(d < 1500), 1, 2 * (1501 - d), end if d == 1500 else one) for d in range(1, 1501)}
    rest = [(40, 0, None, 3, 2, 2, 3000, one), (80, 1, 40, 1, 0, 1, 0, hashlib.sha256(b"80").hexdigest())]
    assert got == sorted([*chain, *rest], key=repr)
    assert rebuilt(spark.createDataFrame([], TURNS)) == []


def test_walk_needs_no_skeleton():
    """Shards that no splitter parts: the root is partial, all else is finished."""
    paths = {c: bytes([c % 3]) * ct.TURN + (bytes([9]) * ct.TURN if c % 2 else b"") for c in range(12)}
    rows = sorted((0, p, c, b"\0\0\0\1" * (len(p) // ct.TURN), False) for c, p in paths.items())
    made = list(ct.walk(iter(rows), ct.Skeleton([]), 2))
    expect = nodes_of({c: tuple(("", "w") if x == 9 else (str(x), "w") for x in p[:: ct.TURN]) for c, p in paths.items()})
    assert sorted(([x[0], x[1], *x[3:8]] for x in made if x[8] < 0), key=repr) == sorted(([x[0], x[1], *x[3:]] for x in expect if x[1]), key=repr)


def test_pieces_of_shared_ends_follow_each_other(spark):
    """Copies of one path over shards: what they give, in order, is the joined ids."""
    path, words = b"a" * ct.TURN, b"\0\0\0\2"
    rows = [(c // 40, path, c, words, False) for c in range(100)]
    made = [r for r in ct.walk(iter(rows), ct.Skeleton([(path, words)]), 20) if r[12] is not None]
    pieces = spark.createDataFrame([(r[8], r[10], r[11], r[12]) for r in made], "skeleton int, part long, seq long, piece binary")
    expect = hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest()
    assert len(made) > 10 and list(map(tuple, ct._shared_ends(pieces).collect())) == [(1, expect)]
