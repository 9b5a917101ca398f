"""Language identification in two steps.

A text becomes the relative counts of its hashed byte n-grams (two and three bytes
of the lower-cased text, letters only). Linear support vector machines decide: first
one against one between language families, then one against one between the
languages of the winning family. Families are a parameter; by default languages
whose mean profiles are alike are put together.

Fitting takes a sample of labelled rows of about ``SAMPLE_PER_LANG`` a language,
chosen by a hash of the id; each pair of labels is fitted in its own task. A label
set of L gives at most L * (L - 1) / 2 machines of ``DIM`` weights, which is what
travels to the tasks. Prediction reads every whole text once.

Defined cases: a null text or one without a letter is ``und`` with score 0; without
labelled rows every text is ``und``; one label is predicted for every text with
letters. Repeated rows get equal predictions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regframe.llm import common

DIM = 4096
SAMPLE_PER_LANG = 500
EPOCHS = 12
C = 30.0
#: Profiles with at least this share of the largest similarity form a family.
FAMILY_SHARE = 0.75
UND = "und"

_NOT_LETTER = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def profile(text: str) -> np.ndarray:
    """Hashed byte 2- and 3-grams, square-rooted and scaled to length one."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_NOT_LETTER) + b" ", np.uint8).astype(np.uint32)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)  # runs of other characters count as one
    b = b[keep]
    two = (b[:-1] * 0x9E3779B1 + b[1:] * 0x85EBCA6B) >> np.uint32(20)
    v = np.bincount(two, minlength=DIM).astype(np.float64)
    if len(b) > 2:
        three = (b[:-2] * 0xC2B2AE35 + b[1:-1] * 0x27D4EB2F + b[2:] * 0x165667B1) >> np.uint32(20)
        v += np.bincount(three, minlength=DIM)
    v = np.sqrt(v)
    n = np.linalg.norm(v)
    return v / n if n else v


def fit_pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Linear SVM (hinge loss, dual coordinate descent); the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    norms = (x * x).sum(1)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), C)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, *, doc_id: str, text: str, lang: str, per_lang: int) -> DataFrame:
    """``lang, profile`` of about ``per_lang`` rows a label, chosen by hash."""
    known = docs.select(
        docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"), docs[f"`{lang}`"].cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    # One count per label comes back (the labels are what the model holds anyway), so the
    # sample is a filter of the scan: no text is moved to find it.
    share = F.lit(0.0)
    for r in known.groupBy("lang").count().collect():
        share = F.when(F.col("lang") == r["lang"], F.lit(per_lang / r["count"])).otherwise(share)
    rows = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    out = T.StructType([T.StructField("profile", T.ArrayType(T.FloatType()))])

    def fn(texts: list) -> dict:
        return {"profile": [profile(t).astype(np.float32).tolist() if has_letter(t) else None for t in texts]}

    got = common.map_texts(rows, fn, out, carry=["lang"])
    return got.where("profile is not null").select("row.lang", "profile")


def families_of(means: dict[str, np.ndarray]) -> dict[str, str]:
    """Family by language: labels joined by profiles nearly as alike as the likeliest pair."""
    names = sorted(means)
    family = {n: n for n in names}
    sims = {(a, b): float(means[a] @ means[b]) for i, a in enumerate(names) for b in names[i + 1 :]}
    if sims:
        spread = np.array(list(sims.values()))
        limit = spread.min() + FAMILY_SHARE * (spread.max() - spread.min())
        for (a, b), s in sims.items():
            if s >= limit and len(set(family.values())) > 2 - (len(names) < 3):
                old, new = family[b], family[a]
                family = {k: new if v == old else v for k, v in family.items()}
    return family


class Model:
    """Families and the machines between pairs of labels."""

    def __init__(self, family: dict[str, str], machines: dict[tuple[str, str, str], np.ndarray]):
        self.family = family
        self.levels: dict[str, tuple[list[str], list, np.ndarray]] = {}
        groups: dict[str, list[str]] = {"": sorted(set(family.values()))}
        for lang, f in sorted(family.items()):
            groups.setdefault("f:" + f, []).append(lang)
        for level, labels in groups.items():
            pairs = [k[1:] for k in machines if k[0] == level]
            w = np.array([machines[(level, *p)] for p in pairs]) if pairs else np.zeros((0, DIM + 1))
            self.levels[level] = (labels, pairs, w)

    def _vote(self, level: str, x: np.ndarray) -> tuple[str, float]:
        """The label with most won pairs (then margin) and how sure its weakest win is."""
        labels, pairs, w = self.levels[level]
        if len(labels) == 1:
            return labels[0], 1.0
        margins = w[:, :-1] @ x + w[:, -1]
        wins, total, least = dict.fromkeys(labels, 0), dict.fromkeys(labels, 0.0), dict.fromkeys(labels, np.inf)
        for (a, b), m in zip(pairs, margins):
            wins[a if m >= 0 else b] += 1
            for lab, v in ((a, m), (b, -m)):
                total[lab] += v
                least[lab] = min(least[lab], v)
        best = max(labels, key=lambda k: (wins[k], total[k], k))
        return best, float(1 / (1 + np.exp(-2.0 * np.clip(least[best], -30, 30))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.family or not has_letter(text):
            return UND, 0.0
        x = profile(text)
        f, p = self._vote("", x)
        lang, q = self._vote("f:" + f, x)
        return lang, min(p, q)


def train(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_lang: int = SAMPLE_PER_LANG,
    families: dict[str, str] | None = None,
) -> Model:
    """Fit families and machines on the labelled sample that is not held out."""
    rows = common.written(sample(docs, doc_id=doc_id, text=text, lang=lang, per_lang=per_lang), "langid-sample")
    spots = F.posexplode("profile")
    means: dict[str, np.ndarray] = {}
    for r in rows.select("lang", spots).groupBy("lang", "pos").agg(F.avg("col")).collect():
        means.setdefault(r[0], np.zeros(DIM))[r[1]] = r[2]
    means = {k: v / (np.linalg.norm(v) or 1) for k, v in means.items()}
    family = {k: (families or {}).get(k, k) for k in means} if families else families_of(means)

    names = sorted(set(family.values()))
    jobs = [("", a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for f in names:
        own = sorted(k for k, v in family.items() if v == f)
        jobs += [("f:" + f, a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
    if not jobs:
        return Model(family, {})
    spark = docs.sparkSession
    by_label = [(j[0], j[1], j[2], k, 1.0 if (family[k] if not j[0] else k) == j[1] else -1.0)
                for j in jobs for k in family if (family[k] if not j[0] else k) in j[1:]]
    todo = spark.createDataFrame(by_label, "level string, a string, b string, j_lang string, y double")

    def fit(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("y")
        x = np.array(df["profile"].tolist(), np.float64)
        # equal rows in another order must not change the machine
        x, y = (lambda o: (x[o], df["y"].to_numpy()[o]))(np.lexsort((x[:, 0], x.sum(1), df["y"].to_numpy())))
        return pd.DataFrame({"level": [key[0]], "a": [key[1]], "b": [key[2]], "w": [fit_pair(x, y).tolist()]})

    fitted = (
        rows.join(todo, F.col("lang") == F.col("j_lang"))
        .groupBy("level", "a", "b")
        .applyInPandas(fit, "level string, a string, b string, w array<double>")
    )
    return Model(family, {(r[0], r[1], r[2]): np.array(r[3]) for r in fitted.collect()})


def predict(docs: DataFrame, model: Model, *, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document: struct ``row``, ``lang_pred`` and ``score`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def fn(texts: list) -> dict:
        got = [shared.value.predict(t) for t in texts]
        return {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}

    return common.map_texts(docs, fn, out, text=text, carry=carry)
