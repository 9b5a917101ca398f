"""Queries that SQL can express, against DuckDB; edges of their operators."""

from __future__ import annotations

import random

import pytest
from conftest_llm import EDGES
from oracle_compare import compare, duck
from pyspark.sql import functions as F
from pyspark.sql import types as T
from regframe.llm import chat, decontaminate, graph, jaccard, mixing, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    r = compare(spark, duck(SF), name, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert r["rows"][0] == r["rows"][1] and r["cols_ok"] and r["hash_ok"], r


def test_registry_has_all():
    names = registry.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in names


# --- chat ----------------------------------------------------------------------

CONV = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("segments", T.StringType()))])
NASTY = ["", "\\", "\\\\", "###", "### User: x </turn>\n", "</turn", "</turn>", "\\</turn>\\", " </turn>\n### Assistant: y", "a\n\nb", "é\U0001f600", ":", "\\:"]


def test_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "a:b", "", "###"]), "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 4)))) for _ in range(rng.randint(0, 5))]
        for t in (chat.DEFAULT, chat.Template(headers={"user": "<u> ", "assistant": "<a> "}, other="<{}> ", close=" <end>\n")):
            parts = chat.segments(turns, t)
            back, loss = chat.read_back(parts, t)
            assert back == turns and loss == [x for r, x in turns if r == "assistant"]


@pytest.mark.parametrize("roles,ok", [(["user", "assistant"], True), (["system", "user", "assistant"], True), (["user", "assistant", "user"], False),
                                      (["assistant"], False), (["user", "user", "assistant"], False), (["system", "assistant"], False), ([], False), ([""], False)])
def test_turn_order(roles, ok):
    assert (chat.check_order(roles) is None) == ok


def test_chat_edges(spark):
    rows = [(1, 0, "user", None, "s"), (1, 1, "assistant", "x" * 200_000, "s"), (None, 0, "user", "n", "s"), (2, 0, None, "t", "s"), (2, 0, "user", "t", "s"), (2, 0, "user", "t", "s"), (3, None, "user", "q", "s")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, CONV))).collect()}
    assert got[1]["valid"] and got[1]["loss_chars"] == 200_000 and got[2]["n_turns"] == 3 and not got[2]["valid"] and got[None]["n_turns"] == 1
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], CONV))).count() == 0


# --- decontamination -------------------------------------------------------------


def test_decontaminate_edges_and_blocks(spark, make_docs):
    items = spark.createDataFrame([("a", "One, TWO three"), ("b", " ".join(f"w{i}" for i in range(12))), (None, "odd text"), ("c", None), ("d", "!!"), ("a", "One, TWO three")], "item_id string, text string")
    docs = make_docs([*EDGES, "x one-two...Three y", "w0 " + " ".join(f"W{i}" for i in range(11)) + " w1", "\x00 odd text é"])
    out = {}
    for block in (decontaminate.BLOCK_BYTES, 20):
        rows = decontaminate.scan(docs, items, carry=["doc_id", "spans", "n_words"], block_bytes=block)
        out[block] = sorted((r["row"]["doc_id"], r["n_words"], tuple(map(tuple, r["ranges"])), tuple(r["items"]), tuple(map(tuple, r["hit_spans"]))) for r in rows.collect())
    assert out[20] == out[decontaminate.BLOCK_BYTES]
    by = {r[0]: r for r in out[20]}
    n = len(EDGES)
    assert by[0][1:] == (0, (), (), ()) and by[n][2:] == (((1, 4),), ("a",), ((2, 17),))
    assert by[n + 1][2] == ((1, 12),) and by[n + 1][3] == ("b",) and by[n + 2][2:4] == (((0, 2),), ())
    assert by[4][1:3] == (4, ())  # the line separator of that text is a word of its own
    assert decontaminate.scan(docs, items.where("false")).where("size(ranges) > 0").count() == 0
    assert decontaminate.scan(docs.where("false"), items).count() == 0


# --- mixing ----------------------------------------------------------------------


def test_mixing_edges(spark, make_docs):
    docs = make_docs([*[(t, "en", None) for t in EDGES], *[("a b c d", "en", "é")] * 5, ("one", "en", "a"), (None, "en", "empty")])
    docs = docs.unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    rows = mixing.mix(docs, carry=["size", "row"]).collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    target = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert abs(sum(t for t, _ in target.values()) - total) < 1e-6 * total and all(t <= 3 * s + 1e-9 for t, s in target.values())
    assert target["a"] == (3.0, 1) and target["empty"] == (0.0, 0) and all(r["taken"] <= 3 * r["size"] for r in rows)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["source"] or "", r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(docs.where("false")).count() == 0


# --- Jaccard ---------------------------------------------------------------------


def near(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block,frequent", [(2048, 1 << 19), (4, 50)])
def test_jaccard_matches_all_pairs(spark, make_docs, monkeypatch, block, frequent):
    from test_pipeline import groups

    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 4)
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 150))] for _ in range(8)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [*EDGES, "one two three four", "One Two three FOUR", "one two three four five", "one two three four five six"]
    for w in base:
        texts += [near(rng, w, k) for k in (0, 0, 1, 1, 2, 3, 4, 5)]  # chains of near copies
    texts += [" ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(10, 60))) + " " + passage for _ in range(20)]
    docs = make_docs(texts)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert got == groups([(i, t) for i, t in enumerate(texts)])
    assert jaccard.join(docs.where("false")).count() == 0


def test_trees_lose_no_link():
    import numpy as np

    rng = random.Random(2)
    sets = []
    for i in range(150):
        s = {rng.randrange(1 << 62) for _ in range(rng.choice([rng.randint(1, 300), rng.randint(200, 2500)]))} if not sets or i % 3 else set(rng.sample(sorted(sets[-1]), max(1, int(len(sets[-1]) * 0.9))))
        sets.append(s)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    bits = [jaccard._bitmap(a).tobytes() for a in arrays]
    n = np.array([len(a) for a in arrays])
    found = {tuple(sorted((int(a), int(b)))) for i, j in jaccard.group_pairs(bits, n, n, np.arange(len(n))) for a, b in zip(i, j)}
    group = np.arange(len(n)) // 10
    leaves = {(int(a), int(b)) for i, j in jaccard.leaf_pairs(group, bits, n, n, np.arange(len(n))) for a, b in zip(i, j)}
    assert leaves == {(a, b) for a, b in found if group[a] == group[b]}
    links = {(a, b) for a in range(150) for b in range(a + 1, 150) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert links <= found and len(found) < 2000


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == got[100] == 100
