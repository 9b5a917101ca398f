"""Personal data against the contract's patterns as written; disguises; offsets."""

from __future__ import annotations

import hashlib
import re

import pytest
from conftest_llm import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st
from regframe.llm import pii, queries

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def keeps(k, s):
    d = re.sub("[^0-9]", "", s)
    if k == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if k == 2:
        n = [int(c) for c in d[::-1]]
        return 13 <= len(d) <= 19 and (sum(n[::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0
    return k == 0 or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if keeps(k, m[0])]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1+@. -()25é0", max_size=60))
def test_base_matches_patterns(text):
    assert pii.base_spans(text) == brute(text)


CASES = [
    ("write jane [at] mail (dot) example.com now", 0, "jane [at] mail (dot) example.com"),
    ("write jane.doe at mail dot example dot com.", 0, "jane.doe at mail dot example dot com"),
    ("jаne@example.com", 0, "jаne@example.com"),  # Cyrillic a
    ("call plus four nine one five one two three four five six seven today", 3, "plus four nine one five one two three four five six seven"),
    ("card ４１１１ １１１１ １１１１ １１１１.", 2, "４１１１ １１１１ １１１１ １１１１"),
    ("host 10 dot 20 dot 30 dot 40 up", 1, "10 dot 20 dot 30 dot 40"),
    ("zero​width a​b@ex​ample.org", 0, "zero​width a​b@ex​ample.org".split()[1]),
]


@pytest.mark.parametrize("text,kind,found", CASES)
def test_disguises(text, kind, found):
    _, spans = pii.find(text)
    assert (kind, text.index(found), text.index(found) + len(found)) in spans, spans


def test_clean_text_stays_clean(documents):
    plain = ["meet me at the dot of noon and look at one of two", "at home at work", "a dot b", "one two three four"]
    for t in plain:
        assert pii.find(t) == ([], [])
    extra = 0
    for (t,) in documents.select("text").collect():
        base, spans = pii.find(t)
        assert set(base) <= set(spans)
        extra += len(spans) - len(base)
    assert extra == 0


def test_query(spark, make_docs):
    sf = "/root/testdata/sf0.01"
    text = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op7_pii(spark, sf)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    for r in got.collect():
        want = brute(text[r["doc_id"]])
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == i for x in want) for i in range(4)]


def test_edges_and_long_runs(spark, make_docs):
    docs = make_docs([*EDGES, "a" * 100_000 + "@", "1" * 100_000, "+1" * 40_000, "@" * 50_000, "1." * 50_000, "one " * 30_000])
    rows = pii.scan(docs, carry=["doc_id", "spans"]).collect()
    assert len(rows) == len(EDGES) + 6 and rows[0]["base"] == [] and rows[0]["spans"] == []
    assert pii.scan(make_docs([])).count() == 0


MORE = [
    ("write to jane at example.com today", 0, "jane at example.com"),
    ("escribe a maria at correo dot es hoy", 0, "maria at correo dot es"),
    ("ask maria at mail.correo dot museum", 0, "maria at mail.correo dot museum"),
    ("ask john dot doe at example dot com", 0, "john dot doe at example dot com"),
    ("ask john dot a dot doe at mail.example.org.", 0, "john dot a dot doe at mail.example.org"),
    ("ask john at example dot com dot br", 0, "john at example dot com dot br"),
    ("host one nine two dot one six eight dot one dot two oh up", 1, "one nine two dot one six eight dot one dot two oh"),
    ("host one nine two [dot] 168 [dot] zero [dot] 7 up", 1, "one nine two [dot] 168 [dot] zero [dot] 7"),
    ("call plus 4 four 9 nine 1 one 5 five 2 now", 3, "plus 4 four 9 nine 1 one 5 five 2"),
]


@pytest.mark.parametrize("text,kind,found", MORE)
def test_more_disguises(text, kind, found):
    _, spans = pii.find(text)
    assert (kind, text.index(found), text.index(found) + len(found)) in spans, spans


def test_running_text_is_no_address():
    plain = [
        "look at example.com and meet us at example.org", "available at docs.example.com", "she was at home.Then he left", "look at the dot on it",
        "One. Two. Three. Four.", "nine nine nine dot one dot one dot one", "one dot two dot three", "he stood at noon. it was hot",
    ]
    for t in plain:
        assert pii.find(t) == ([], []), t
