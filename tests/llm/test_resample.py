"""Importance resampling against a plain count of word runs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import EDGES
from regframe.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, grams=2):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return w, [" ".join(w[i : i + n]) for n in range(1, grams + 1) for i in range(len(w) - n + 1)]


def brute(texts, targets, ids, percent=25, least=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in side for f in features(x)[1]) for side in (texts, targets))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, x in zip(ids, texts):
        w, f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("joined", [resample.JOINED, 10])
def test_matches_brute_force(spark, make_docs, monkeypatch, joined):
    monkeypatch.setattr(resample, "JOINED", joined)
    texts = [*EDGES] + [" ".join(f"W{(i * j) % 23}é-x{j % 5}" for j in range(i)) for i in range(60)]
    targets = ["w1é x0 W2é", None, "", "w0é x1 " * 9, "İ ß \U0001f600"]
    got = resample.resample(make_docs(texts), spark.createDataFrame([(t,) for t in targets], "text string"))
    assert rows_of(got) == brute(texts, targets, range(len(texts)))


def test_words_never_cross_documents():
    buckets, of, n = resample.runs([b"a b", b"", b"c", b"d e f"], grams=3)
    want = Counter((zlib.crc32(f) % 10_000, d) for f, d in [(b"a", 0), (b"b", 0), (b"a b", 0), (b"c", 2), (b"d", 3), (b"e", 3), (b"f", 3), (b"d e", 3), (b"e f", 3), (b"d e f", 3)])
    assert Counter(zip(buckets.tolist(), of.tolist())) == want and n.tolist() == [2, 0, 1, 3]


def test_ties_repeated_ids_and_empty_tables(spark, make_docs):
    words = " ".join(f"w{i}" for i in range(30))
    docs = make_docs([words] * 12)
    docs = docs.unionByName(docs.where("doc_id < 8")).unionByName(docs.limit(4).selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    target = spark.createDataFrame([("w1 w2",)], "text string")
    got = resample.resample(docs, target, percent=50).collect()
    assert len(got) == 24 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 13))
    drawn = sorted(r["score"] for r in got if r["rank"])
    assert drawn == sorted((r["score"] for r in got))[12:]
    assert sorted(resample.chosen(make_docs([words] * 8), target).columns) == sorted(docs.columns)
    assert resample.chosen(make_docs([words] * 8), target).count() == 2
    assert resample.resample(docs.where("false"), target).count() == 0
    got = resample.resample(make_docs([words]), target.where("false"), percent=100).collect()
    assert [r["rank"] for r in got] == [1]
