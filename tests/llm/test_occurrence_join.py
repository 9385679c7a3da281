"""Operator 13 against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loreloom.llm import near_dups, occurrence_join as oj

from .conftest import words


def grams(text, k=4):
    w = words(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected(rows, percent=85):
    sets = [(i, grams(t)) for i, t in rows]
    group = {i: i for i, _ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return sorted(((i, len(x), None if i is None else find(i)) for i, x in sets), key=repr)


def found(docs):
    return sorted(map(tuple, oj.similar(docs).collect()), key=repr)


@given(st.lists(st.lists(st.integers(0, 25), max_size=12).map(lambda x: sorted(set(x))), max_size=9), st.integers(1, 6))
def test_merge_skip_counts_what_reaches_the_threshold(lists, t):
    counts = Counter(x for own in lists for x in own)
    assert sorted(oj.merge_skip(lists, t)) == sorted((v, n) for v, n in counts.items() if n >= t)


@pytest.mark.parametrize("heap", [0, 1 << 30])
def test_search_finds_all_that_share_enough(monkeypatch, heap):
    """Some lists long, some short; by the heap and by the sort."""
    monkeypatch.setattr(oj, "HEAP", heap)
    rng = random.Random(heap % 7)
    sets = [set(rng.sample(range(60), rng.randint(1, 40))) for _ in range(60)] + [set(range(50)) - {i} for i in range(40)] + [{1000 + i} for i in range(5)]
    doc = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)])
    h = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    for percent in (70, 85):
        lists = oj.Lists(doc, h, 0, len(sets))
        for p, own in enumerate(sets):
            ids, shared = lists.search(p, percent)
            expect = {i: len(own & s) for i, s in enumerate(sets) if 100 * len(own & s) >= percent * len(own)}
            got = dict(zip(ids.tolist(), shared.tolist(), strict=True))
            assert got == expect | {p: len(own)}


def corpus():
    """Copies, near copies of many degrees, chains, shared passages, short, odd and repeated texts."""
    rng = random.Random(13)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    passage = [word() for _ in range(40)]
    texts = [None, "", " \t\n", "one", "one two", "One TWO", "one two three four", "é  x y z"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([5, 30, 120]))]
        for n in range(rng.choice([2, 9, 25])):
            edited = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited + [word()] * rng.choice([0, 0, 1, n % 5])))
    chain = [word() for _ in range(60)]
    for i in range(20):
        texts.append(" ".join(chain))
        chain[i * 3] = word()
    texts += [" ".join([word() for _ in range(rng.choice([2, 20, 60]))] + passage) for _ in range(60)] + ["hot text of just six words"] * 80
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(None, "one two three four"), (rows[5][0], rows[5][1])]


@pytest.mark.parametrize(("members", "homes", "often"), [(1000, 32, 32), (1000, 0, 2), (6, 32, 32), (3, 1, 4)])
def test_join_is_the_rule(spark, monkeypatch, members, homes, often):
    """Also where every node is too large for a task, and where every n-gram has a node of its own."""
    monkeypatch.setattr(near_dups, "MEMBERS", members)
    monkeypatch.setattr(oj, "MEMBERS", members)
    monkeypatch.setattr(oj, "HOMES", homes)
    monkeypatch.setattr(oj, "OFTEN", often)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1, b"k") for r in rows], "doc_id long, text string, path string, n int, key binary")
    assert found(docs) == expected(rows)


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd) == expected(rows)
    assert found(odd.limit(0)) == []


def test_prefixes_of_linked_sets_meet():
    """Any order: a linked pair's prefixes share as many n-grams as each must have, and the smaller set's found part has them."""
    rng = random.Random(2)
    for _ in range(2000):
        n = rng.randint(1, 200)
        a = set(rng.sample(range(1000), n))
        b = set(rng.sample(sorted(a), rng.randint(max(1, n - n // 8), n))) | {2000 + i for i in range(rng.randint(0, n // 8))}
        if 100 * len(a & b) < 85 * len(a | b):
            continue
        small, large = sorted((a, b), key=len)
        order = {x: rng.random() for x in a | b}
        (_, f), (s, _) = (tuple(int(x[0]) for x in oj.lengths(np.array([len(x)]), 85)) for x in (small, large))
        common = set(sorted(small, key=order.get)[:f]) & set(sorted(large, key=order.get)[:s])
        assert all(len(common) >= len(x) * 85 * oj.LEAD // 10_000 + 1 for x in (small, large))


def test_near_copies_of_one_text_meet_in_few_nodes(spark, monkeypatch):
    """Each of its n-grams is in nearly the same classes: not a node each, and no link is lost."""
    monkeypatch.setattr(oj, "HOMES", 4)
    rng = random.Random(5)
    rows = []
    for i in range(80):
        edited = [f"w{at}" for at in range(200)]
        for at in rng.sample(range(200), rng.randint(2, 6)):
            edited[at] = f"x{at}-{rng.randint(0, 1)}"
        rows.append((i, " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = oj.prefixes(docs, 4, 85).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "prefix", "found")
    met = Counter(r.path for r in oj._meetings(sketch, sketch.select("rep"), 85).collect())
    assert sum(n for n in met.values() if n > 1) < 10 * len(rows)
    assert found(docs) == expected(rows)
