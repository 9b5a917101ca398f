"""The pipeline's stages against brute force, each on its own input, and as a whole."""

from __future__ import annotations

import re

import corpus_pipeline
from conftest_llm import EDGES
from pyspark.sql import functions as F
from regframe.llm import common

SF = "/root/testdata/sf0.001"


def shingle_set(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """Smallest id reachable by links, by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                comp[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def hit(text, items):
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    flat = " " + " ".join(words(text)) + " "
    for t in items:
        w = words(t)
        n = min(10, len(w))
        if n and any(" " + " ".join(w[i : i + n]) + " " in flat for i in range(len(w) - n + 1)):
            return True
    return False


def test_stages_one_by_one(spark):
    docs = common.table(spark, SF, "documents")
    items = [r[0] for r in common.table(spark, SF, "benchmark").select("text").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = common.written(stage(spark, docs, SF), "t")
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if name != "source_mix":
            assert out.columns == columns
        if name == "language_id":
            gone = [before[i]["text"] for i in set(before) - set(after)]
            assert all(not re.search(r"[^\W\d_]", t or "") for t in gone)
        elif name == "near_duplicates":
            want = {i for i, c in groups([(i, r["text"]) for i, r in before.items()]).items() if i == c}
            assert set(after) == want
        elif name == "benchmark_leaks":
            assert set(after) == {i for i, r in before.items() if not hit(r["text"], items)}
        elif name == "secret_scan":
            assert set(after) == set(before)
            for i, r in after.items():
                assert r["n_chars"] == len(r["text"])
                assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"])
                if r["text"] != before[i]["text"]:
                    assert "[secret]" in r["text"]
        else:
            size = {i: len(re.findall("[^\x20\x09-\x0d]+", r["text"])) for i, r in before.items()}
            for i, r in after.items():
                assert r["mix_size"] == size[i] and r["mix_taken"] == size[i] * r["mix_copies"] and 1 <= r["mix_copies"] <= 3
            by = {}
            for r in after.values():
                t = by.setdefault(r["source"], [0, r["mix_target"]])
                t[0] += r["mix_taken"]
            largest = max(size.values())
            assert all(abs(n - t) <= largest for n, t in by.values())
        docs = out


def test_edges_and_clashing_names(spark, make_docs):
    short = [t for t in EDGES if not t or len(t) < 1000]
    docs = make_docs([*short, ("der die das", None, None), ("words in no source", "en", None), ("token=abcdef123 words", "en", "s")])
    docs = docs.unionByName(docs.limit(2)).unionByName(docs.where("doc_id > 5").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, SF), "t")
        if name != "source_mix":
            assert out.columns == docs.columns and out.count() > 0, name
        assert common.written(stage(spark, docs.where("false"), SF), "t").count() == 0, name
        docs = out


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and {"doc_id", "mix_taken"} <= set(out.columns)
