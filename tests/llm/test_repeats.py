"""Repeated passages against a brute-force count of all 200-byte strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest_llm import EDGES
from regframe.llm import queries, repeats

L = repeats.LENGTH


def brute(texts):
    datas = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + L] for d in datas for i in range(len(d) - L + 1))
    out = []
    for d in datas:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - L + 1):
            if n[d[i : i + L]] > 1:
                gone[i : i + L] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        starts = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(d) else 0
        out.append((len(d), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def planted(seed, n=60):
    """Texts with copies, near copies, shared passages near the limit, periods."""
    rng = random.Random(seed)
    shared = [words(rng, 80) for _ in range(3)]
    exact = "".join(rng.choice("xyz ") for _ in range(L + 1))
    texts = []
    for i in range(n):
        t = words(rng, rng.randint(5, 120))
        kind = i % 8
        if kind == 1:
            t = t[: len(t) // 2] + rng.choice(shared) + t[len(t) // 2 :]
        elif kind == 2 and texts:
            w = rng.choice(texts).split(" ")
            w[rng.randrange(len(w))] = "Q"
            t = " ".join(w)
        elif kind == 3 and texts:
            t = rng.choice(texts)
        elif kind == 4:
            t = t + exact[: L - 1 + i % 3]  # 199, 200 and 201 bytes
        elif kind == 5:
            t = "ab" * rng.randint(50, 300) + t
        elif kind == 6:
            t = t + " " + t[: rng.randint(0, len(t))] + t
        texts.append(t)
    return texts


def rows_of(spark, texts):
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, q string, rid long")
    got = {r["doc_id"]: r for r in repeats.remove(df).collect()}
    return [tuple(got[i][k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    texts = planted(seed)
    assert rows_of(spark, texts) == brute(texts)


def test_crowded_parses(spark, monkeypatch):
    monkeypatch.setattr(repeats, "ORDERED", 1)
    texts = planted(3)
    assert rows_of(spark, texts) == brute(texts)


def test_edges(spark):
    texts = [t for t in EDGES if not t or len(t) < 50_000] + ["y" * 5000, "é" * 400, None, "z" * 199, "z" * 200, "z" * 201]
    assert rows_of(spark, texts) == brute(texts)
    df = spark.createDataFrame([(None, "k" * 300), (None, "m" * 300), (5, "n n" * 90), (5, "n n" * 90)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in repeats.remove(df).collect()) == [270, 270, 300, 300]
    assert repeats.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op4_repeats(spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r[0] for r in docs], brute([r[1] for r in docs])))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
