"""Text: tokenizer twins, Jaro-Winkler against DuckDB, BM25 against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from regframe.functions.text import jaro_winkler_bytes, like_contains, py_tokens, tokens, tokens_sql
from regframe.operators import textsearch

TEXTS = [
    "São Paulo d'água Ltda",
    "ÉÇÃ über straße 123 x-y",
    "",
    None,
    "the quick  brown fox, the lazy dog",
    "Ñandú ÆØÅ œuvre",
]


def test_tokenizer_twins(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    spark_toks = [r[0] for r in df.select(tokens("t")).collect()]
    con = duckdb.connect()
    for t, st in zip(TEXTS, spark_toks):
        py = py_tokens(t)
        assert (st or []) == py
        if t is not None:
            esc = t.replace("'", "''")
            dk = con.execute(f"SELECT {tokens_sql(repr_sql(esc))}").fetchall()[0][0]
            assert dk == py


def repr_sql(esc: str) -> str:
    return f"'{esc}'"


def test_jaro_winkler_matches_duckdb():
    rnd = random.Random(7)
    alphabet = "abcde fgé"
    con = duckdb.connect()
    pairs = []
    for _ in range(400):
        a = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12)))
        b = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12)))
        pairs.append((a, b))
    con.execute("CREATE TABLE p(a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", pairs)
    ref = con.execute("SELECT a, b, jaro_winkler_similarity(a, b) FROM p").fetchall()
    for a, b, s in ref:
        assert math.isclose(jaro_winkler_bytes(a.encode(), b.encode()), s, abs_tol=1e-9), (a, b)


def test_jaro_winkler_udf(spark):
    from regframe.functions.text import jaro_winkler

    df = spark.createDataFrame([("empresa teste ltda", "empresa teste ltd"), ("", "x"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(jaro_winkler("a", "b")).collect()]
    assert got[0] > 0.98 and got[1] == 0.0 and got[2] is None


def test_like_escape():
    assert like_contains("a_b%") == "%a_b%%"
    assert like_contains("a\\b") == "%a\\\\b%"


def _brute_bm25(docs: dict[int, str], q: str, k1=1.2, b=0.75) -> dict[int, float]:
    toks = {k: py_tokens(v) for k, v in docs.items()}
    n = len(toks)
    avgdl = sum(len(t) for t in toks.values()) / n
    df = Counter(t for ts in toks.values() for t in set(ts))
    out = {}
    for k, ts in toks.items():
        tf = Counter(ts)
        s = 0.0
        hit = False
        for term in set(py_tokens(q)):
            if term in tf:
                hit = True
                idf = math.log10((n - df[term] + 0.5) / (df[term] + 0.5) + 1)
                s += idf * tf[term] * (k1 + 1) / (tf[term] + k1 * (1 - b + b * len(ts) / avgdl))
        if hit:
            out[k] = s
    return out


def test_bm25_matches_brute_force(spark):
    rnd = random.Random(3)
    words = ["alfa", "beta", "gama", "delta", "ltda", "comércio", "são", "sa", "x1"]
    docs = {i: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for i in range(60)}
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    idx = textsearch.build_index(df, "id", "text")
    q = "alfa comercio SAO delta delta"
    got = {r["id"]: r["score"] for r in textsearch.scores(idx, q).collect()}
    want = _brute_bm25(docs, q)
    assert got.keys() == want.keys()
    for k in want:
        assert math.isclose(got[k], want[k], rel_tol=1e-9)
    top = textsearch.top_k(idx, q, 5).collect()
    assert [r["id"] for r in top] == sorted(want, key=lambda k: (-want[k], k))[:5]
    assert textsearch.scores(idx, "123 !!").count() == 0


@pytest.mark.parametrize("q", ["abc ab", "é ção", "a", "aaaa bbbb", "éa"])
def test_fuzzy_prune_is_exact(spark, q):
    """The native bound is never below the similarity, and names it lets go never reach 0.85."""
    rnd = random.Random(11)
    letters = "abc " if q.isascii() else "aècéão "
    names = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, rnd.choice([8, 40])))) for _ in range(400)]
    names += [q, q[::-1], q + "b", "b" + q]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    score = {n.lower(): jaro_winkler_bytes(n.lower().encode(), q.encode()) for n in names}
    bound = {r[0]: r[1] for r in df.select(F.lower("n"), textsearch.similarity_bound(F.lower("n"), q)).collect()}
    assert all(bound[n] >= s - 1e-9 for n, s in score.items())
    assert {r[0] for r in textsearch.fuzzy_name_hits(df, "n", q).collect()} == {n for n, s in score.items() if s >= 0.85}
    if q.isascii():
        assert textsearch.fuzzy_candidates(df, "n", q).count() < 0.7 * len(score)


@pytest.mark.parametrize("q", ["", "   "])
def test_bm25_empty_query(spark, q):
    df = spark.createDataFrame([(1, "alfa")], "id long, text string")
    idx = textsearch.build_index(df, "id", "text")
    assert textsearch.scores(idx, q).count() == 0
    assert F is not None
