"""Secret scans: base patterns, and Markov models of random strings and identifiers.

Only DataFrame functions run here. Match positions come from splitting a text at
the pattern: gaps and matches alternate, so a running length gives each start.

Two character Markov chains of order one score every long token: one of random
strings (transitions of the secrets that the base patterns label, over all
documents, mixed half and half with a uniform chain, so that it also fits
alphabets it has not met), one of ordinary identifiers (transitions of the words of
a sample of documents of at most about ``SAMPLE_DOCS``, chosen by a hash of the
id). A token whose summed log-likelihood ratio passes ``MIN_LLR`` and whose mean
passes ``MIN_MEAN`` is a span of kind ``markov`` unless it meets a base span.

Both models are tables of 64 x 64 transitions, whatever the input's size.

Defined cases: a null text is empty and has no spans; an empty table gives no rows
(the chains are then uniform); repeated rows each get their row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regframe.llm import common

#: Kinds in the order that breaks ties, with their patterns. The length limits of the
#: contract are part of the patterns where a failing match could not hide another one.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Tokens that the chains score: whole runs of characters that keys are written in.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
#: What counts as a sample of an ordinary identifier: letters, joined by _ - or /, a short number behind.
PLAIN = r"\A[A-Za-z]+([_/-][A-Za-z]+)*[0-9]{0,3}\z"
MIN_ASSIGN = 6
KINDS = ("assign", "access", "hex", "markov")

#: Documents that the identifier chain is fitted on (expected number; chosen by hash).
SAMPLE_DOCS = 4000
MIN_LLR = 8.0
MIN_MEAN = 0.5
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
N = len(ALPHABET) + 1  # and one for any other character
_SPAN = "array<struct<start:int,end:int,value:string>>"


def found(text: Column, pattern: str) -> Column:
    """All non-overlapping matches as structs (start, end, value), code points."""
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")),
    )
    empty = F.array().cast(_SPAN)

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("value"))
        more = F.when(piece["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span)))
        return F.struct(end.alias("at"), more.cast(_SPAN).alias("spans"))

    whole = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda a: a["spans"])
    return F.when(text.rlike(pattern), whole).otherwise(empty)


def base_spans(docs: DataFrame, text: str, carry: Sequence[str]) -> DataFrame:
    """``row`` and the arrays ``assign, access, hex, token`` of matches."""
    t = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    long_enough = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= MIN_ASSIGN
    return docs.select(
        F.struct(*[docs[f"`{c}`"].alias(c) for c in carry]).alias("row"),
        F.filter(found(t, ASSIGN), long_enough).alias("assign"),
        found(t, ACCESS).alias("access"),
        found(t, HEX).alias("hex"),
        found(t, TOKEN).alias("token"),
    )


def _index(char: Column) -> Column:
    """Position in the alphabet, from 1; 0 for any other character."""
    return F.instr(F.lit(ALPHABET), char)


def _steps(value: Column) -> Column:
    """Transition numbers of a string, in order (each character looked up once)."""
    codes = F.transform(F.split(value, ""), _index)
    return F.get(
        F.transform(F.array(codes), lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: x * N + y)),
        0,
    )


def _pairs(strings: DataFrame, column: str) -> dict[int, int]:
    """Transition counts over all rows: at most N x N rows come back."""
    pair = F.explode(F.when(F.length(column) > 1, _steps(F.col(column))))
    return {r[0]: r[1] for r in strings.select(pair.alias("pair")).groupBy("pair").count().collect()}


def _chain(counts: dict[int, int], uniform: float) -> list[float]:
    """Transition probabilities with half a count added, mixed with a uniform chain."""
    out = []
    for a in range(N):
        row = [counts.get(a * N + b, 0) + 0.5 for b in range(N)]
        total = sum(row)
        out += [(1 - uniform) * x / total + uniform / N for x in row]
    return out


def train(spans: DataFrame, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> list[float]:
    """Log-likelihood ratio of each transition, random against identifier."""
    secrets = spans.select(F.explode(F.concat("assign", "access", "hex")).alias("s")).select(
        F.when(F.col("s.value").rlike(ASSIGN), F.regexp_extract("s.value", ASSIGN, 1)).otherwise(F.col("s.value")).alias("w")
    )
    rows = spans.count()
    share = min(1.0, SAMPLE_DOCS / rows) if rows else 1.0
    chosen = F.pmod(F.xxhash64(docs[f"`{doc_id}`"]), F.lit(1_000_000)) < int(share * 1_000_000)
    words = docs.where(chosen).select(
        F.explode(F.split(docs[f"`{text}`"].cast("string"), r"[^A-Za-z0-9+/_-]+")).alias("w")
    )
    words = words.where(F.col("w").rlike(PLAIN))
    random, plain = _chain(_pairs(secrets, "w"), 0.5), _chain(_pairs(words, "w"), 0.0)
    return [round(math.log(r / p), 6) for r, p in zip(random, plain)]


def score(value: Column, model: list[float]) -> Column:
    """Summed log-likelihood ratio of a string's transitions."""
    llr = F.from_json(F.lit(json.dumps(model)), "array<double>")
    return F.aggregate(_steps(value), F.lit(0.0), lambda a, k: a + F.get(llr, k))


def scan(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] | None = None
) -> DataFrame:
    """Per document: struct ``row``, the arrays ``assign, access, hex, markov`` and
    ``spans``: all as structs (start, kind number, end), by start, then kind."""
    carry = list(carry or [doc_id])
    base = common.written(base_spans(docs, text, carry), "secrets")
    model = train(base, docs, doc_id=doc_id, text=text)
    taken = F.concat("assign", "access", "hex")
    llr = lambda s: score(s["value"], model)
    odd = F.filter(
        "token",
        lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        & (llr(s) >= F.greatest(F.lit(MIN_LLR), MIN_MEAN * (F.length(s["value"]) - 1))),
    )
    full = base.withColumn("markov", F.when(F.size("token") > 0, odd).otherwise(F.col("token")))
    return full.withColumn("spans", _ordered(KINDS)).drop("token")


def _ordered(kinds: Sequence[str]) -> Column:
    def tagged(kind: str) -> Column:
        number = F.lit(KINDS.index(kind))
        return F.transform(
            F.col(kind), lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end"))
        )

    return F.array_sort(F.concat(*[tagged(k) for k in kinds]))


def as_text(kinds: Sequence[str]) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(_ordered(kinds), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redact(scanned: DataFrame, text: str = "text", mask: str = "[secret]") -> Column:
    """The carried text with every span, overlaps joined, replaced by ``mask``."""
    t = F.col("row").getField(text)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))),
    )
    return F.when(F.size("spans") > 0, done).otherwise(t)
