"""The conversation trie against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from regframe.llm import common, trie

TURNS = T.StructType(
    [T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("depth", T.LongType()), ("node", T.StringType()))]
)


def brute(convs):
    """``convs``: id -> turns. Rows as (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def rows_of(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def table_of(spark, convs):
    rows = [(c, i, role, text, 9, "x") for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, TURNS)


def forest(seed, n=120):
    rng = random.Random(seed)
    out = {}
    for c in rng.sample(range(-5 * n, 5 * n), n):
        old = list(rng.choice(list(out.values()))) if out and rng.random() < 0.7 else []
        turns = old[: rng.randint(0, len(old))] + [(rng.choice(["user", "assistant"]), rng.choice(["", "a", "é\U0001f600", f"t{rng.randrange(30)}"])) for _ in range(rng.randint(0, 4))]
        if turns:
            out[c] = turns
    out[10**12] = out[10**12 + 1] = [("user", "deep")] * 70
    return out


@pytest.mark.parametrize("cells,heavy", [(trie.MOST_CELLS, common.HEAVY), (2 * trie.BLOCK, 2)])
def test_matches_dictionary(spark, monkeypatch, cells, heavy):
    monkeypatch.setattr(trie, "MOST_CELLS", cells)
    monkeypatch.setattr(common, "HEAVY", heavy)
    monkeypatch.setattr(trie, "END_SPAN", 3)
    convs = forest(3)
    got = trie.nodes(trie.steps(table_of(spark, convs).repartition(5)))
    assert rows_of(got) == brute(convs)


def test_nothing_hangs_on_the_sketch(spark, monkeypatch):
    convs = forest(4, 60)
    monkeypatch.setattr(trie, "sketch", lambda paths: (np.full(2 * trie.BLOCK // 8, 255, np.uint8), trie.BLOCK))
    assert rows_of(trie.nodes(trie.steps(table_of(spark, convs)))) == brute(convs)


def test_screen_proves_singletons(spark):
    convs = forest(5)
    paths = common.written(trie._prefixes(trie.steps(table_of(spark, convs))), "t")
    bits, width = trie.sketch(paths)
    seen = defaultdict(int)
    for r in paths.collect():
        for i in range(0, len(r["digests"]), 16):
            seen[bytes(r["digests"][i : i + 16])] += 1
    more = trie._estimates_more(bits, width, b"".join(seen))
    assert all(m for m, n in zip(more, seen.values()) if n > 1)
    assert sum(bool(m) for m, n in zip(more, seen.values()) if n == 1) < 0.05 * len(seen)


def test_edges(spark):
    rows = [
        (1, 0, "user", None, 0, ""), (1, None, None, "first", 0, ""), (None, 0, "user", "x", 0, ""), (2, None, "", "first", 0, ""),
        (3, 1, "user", "b", 0, ""), (3, 1, "user", "b", 0, ""), (3, 1, "assistant", "z", 0, ""), (4, 0, "user", "x" * 300_000, 0, ""), (5, None, None, None, 0, ""),
    ]
    df = spark.createDataFrame(rows, TURNS)
    want = {1: [("", "first"), ("user", "")], 2: [("", "first")], 3: [("assistant", "z"), ("user", "b"), ("user", "b")], 4: [("user", "x" * 300_000)], 5: [("", "")]}
    got = trie.nodes(trie.steps(df))
    assert rows_of(got) == brute(want)
    texts = {(r["conv_id"], r["depth"]): r["text"] for r in trie.with_texts(got, df).collect()}
    assert texts[(1, 0)] is None and texts[(1, 1)] == "first" and texts[(3, 1)] == "z" and len(texts) == len(brute(want))
    assert trie.nodes(trie.steps(df.where("false"))).count() == 0
    # turnless conversations are members and ends of the root
    none = trie.steps(df).withColumn("digests", F.expr("X''")).withColumn("chars", F.expr("cast(array() as array<bigint>)"))
    assert rows_of(trie.nodes(none)) == brute({c: [] for c in want})
