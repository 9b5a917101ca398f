"""First copies of 20-word windows against a plain dictionary."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from conftest_llm import EDGES
from regframe.llm import common, debruijn

K = debruijn.K
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(texts):
    ws = [WORD.findall(t or "") for t in texts]
    seen, gone = set(), [set() for _ in ws]
    for d, w in enumerate(ws):
        for i in range(len(w) - K + 1):
            e = tuple(w[i : i + K])
            if e in seen:
                gone[d].update(range(i, i + K))
            seen.add(e)
    return [(d, len(w), len(gone[d]), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone[d]).encode()).hexdigest()) for d, w in enumerate(ws)]


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def planted(seed, n=80):
    """Copies, near copies, shared passages near the limit, periods, self repeats."""
    rng = random.Random(seed)
    shared = [words(rng, k) for k in (K - 1, K, K + 1, 60, 200)]
    texts = []
    for i in range(n):
        w = words(rng, rng.randint(0, 150), rng.choice([5000, 3]))
        kind = i % 8
        if kind == 1:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(shared)
        elif kind == 2 and texts:
            w = list(rng.choice(texts))
            if w:
                w[rng.randrange(len(w))] = "Q"
        elif kind == 3 and texts:
            w = list(rng.choice(texts))
        elif kind == 4:
            w += rng.choice(shared)[: rng.randint(15, 30)]
        elif kind == 5:
            w = ["a", "b", "c"] * rng.randint(5, 40) + w
        elif kind == 6:
            w = w + w[: rng.randint(0, len(w))] + w
        elif kind == 7 and texts:
            a = rng.choice(texts)
            s = rng.randint(0, len(a))
            w[:0] = a[s : s + rng.randint(K - 2, 3 * K)]
        texts.append(w)
    return [rng.choice([" ", "\n", "\t\x0b"]).join(w) for w in texts]


def rows_of(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("seed,heavy", [(1, common.HEAVY), (2, 1)])
def test_matches_dictionary(spark, make_docs, monkeypatch, seed, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    texts = [*EDGES, "no\x1cbreak\x85here x " * 30, *planted(seed)]
    got = debruijn.remove(make_docs(texts).repartition(7))
    assert rows_of(got) == brute(texts)


def test_paths_do_not_branch(spark, make_docs):
    rng = random.Random(6)
    shared = words(rng, 120)
    texts = [" ".join(words(rng, 40) + shared + words(rng, 40)) for _ in range(6)]
    rows = debruijn.passages(make_docs(texts)).collect()
    copies = {}
    for r in rows:
        w = texts[r["doc_id"]].split()[r["start"] : r["end"]]
        assert copies.setdefault(r["path"], (w, r["n_copies"]))[0] == w
    assert max(len(w) for w, _ in copies.values()) > 60 and all(n == 6 for w, n in copies.values())
    sources = [r["path"] for r in rows if r["is_source"]]
    assert sorted(sources) == sorted(copies) and all(r["doc_id"] == 0 for r in rows if r["is_source"])


def test_repeated_and_null_ids(spark, make_docs):
    text = " ".join(f"u{i}" for i in range(50))
    docs = make_docs([text, "short text", None])
    docs = docs.unionByName(docs).unionByName(docs.selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    rows = debruijn.remove(docs).collect()
    kept = [r["doc_id"] for r in rows if r["n_words"] == 50 and r["n_removed"] == 0]
    assert len(rows) == 9 and kept == [None] and sum(r["n_removed"] for r in rows) == 100
    assert debruijn.remove(docs.where("false")).count() == 0
