"""Ranked (BM25) and fuzzy (Jaro-Winkler) text search as Spark jobs.

BM25 index = three tables:
  postings(term, key, tf, len)   one row per (document, term); the document
                                 length rides along, so scoring needs no join
                                 with a length table
  terms(term, df)                document frequency per term
  stats(n_docs, avgdl)           one row
Building is an explode + one grouped count (partial aggregation absorbs hot
terms); searching filters postings to the query terms (pushed to the Parquet
scan; stored files are sorted by term so row groups are skipped), joins the query's few ``terms``
rows (bounded by the number of query words, broadcast) and sums per document.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regframe.operators import maintain
from regframe.functions.text import jaro_winkler, like_contains, py_tokens, tokens

K1 = 1.2
B = 0.75


@dataclass
class BM25Index:
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    key: str
    docs: DataFrame | None = None  # the indexed keys (for the document count)

    def write(self, path: str, *, partitions: int | None = None) -> None:
        """Store the index. Postings (the one tokenising pass) are written first,
        clustered by term with a skew-splitting rebalance (a term present in a
        third of all documents is split, not sent to one task) and sorted by
        term inside each file, so a term filter skips row groups; terms and
        stats are then derived from the stored postings."""
        p = self.postings
        p = p.hint("rebalance", partitions, "term") if partitions else p.hint("rebalance", "term")
        p.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        stored = self.postings.sparkSession.read.parquet(f"{path}/postings")
        _terms(stored).write.mode("overwrite").parquet(f"{path}/terms")
        docs = self.docs if self.docs is not None else stored.select(self.key).distinct()
        _stats(stored, docs, self.key).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    def write_version(self, table_dir: str, *, partitions: int | None = None) -> str:
        """Store the index as the next version under ``table_dir`` and publish it whole."""
        spark = self.postings.sparkSession
        path = maintain.next_version(spark, table_dir)
        self.write(path, partitions=partitions)
        maintain.publish(spark, path)
        return path

    @classmethod
    def read(cls, spark, path: str, key: str) -> "BM25Index":
        return cls(
            spark.read.parquet(f"{path}/postings"),
            spark.read.parquet(f"{path}/terms"),
            spark.read.parquet(f"{path}/stats"),
            key,
        )


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _stats(postings: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(n_docs, avgdl) as one aggregate over a union: every document counts once
    (documents without terms included), every posting adds its ``tf``."""
    ones = docs.select(F.lit(1).cast("long").alias("_d"), F.lit(0).cast("long").alias("_t"))
    tfs = postings.select(F.lit(0).cast("long").alias("_d"), F.col("tf").cast("long").alias("_t"))
    return ones.unionByName(tfs).agg(
        F.sum("_d").alias("n_docs"),
        (F.sum("_t") / F.sum("_d")).cast("double").alias("avgdl"),
    )


def build_index(docs: DataFrame, key: str, text: str) -> BM25Index:
    """Index ``text`` of ``docs`` keyed by ``key`` (whole texts, every document).

    Tokenising is CPU-bound: when the input has fewer partitions than the
    cluster has task slots (a few large files), it is spread first; a big
    input already has enough partitions and is not moved.
    """
    slots = docs.sparkSession.sparkContext.defaultParallelism
    src = docs.select(key, text)
    if src.rdd.getNumPartitions() < slots:
        src = src.repartition(slots)
    # The length is taken before the explode so the generator does not carry
    # the token array into each of its output rows (a copy per token: quadratic
    # in the length of a long text). ``explode_outer`` + a NULL filter keeps
    # Catalyst from inferring a ``size > 0`` filter that it would push below
    # the projection and so tokenise every text twice; texts without terms
    # still count as documents through ``keys``.
    toks = src.select(F.col(key), tokens(text).alias("_t")).select(
        key, F.size("_t").alias("len"), "_t"
    )
    postings = (
        toks.select(key, "len", F.explode_outer("_t").alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("term", key, "len")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    keys = docs.select(key)
    return BM25Index(postings, _terms(postings), _stats(postings, keys, key), key, keys)


def scores(index: BM25Index, q: str, *, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of every document sharing at least one term with ``q``.

    Query terms are a set. ``idf = log10((N - df + 0.5) / (df + 0.5) + 1)``.
    """
    qterms = sorted(set(py_tokens(q)))
    key = index.key
    if not qterms:
        return index.postings.where(F.lit(False)).select(key, F.lit(0.0).alias("score"))
    st = index.stats.first()  # one row: document count and mean length
    n_docs, avgdl = float(st["n_docs"]), float(st["avgdl"] or 0.0)
    terms = F.broadcast(index.terms.where(F.col("term").isin(qterms)))  # <= len(qterms) rows
    hits = index.postings.where(F.col("term").isin(qterms)).join(terms, "term")
    idf = F.log10((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    norm = F.lit(k1) * (1.0 - b + b * F.col("len") / F.lit(avgdl if avgdl else 1.0))
    w = idf * F.col("tf") * (k1 + 1.0) / (F.col("tf") + norm)
    return hits.groupBy(key).agg(F.sum(w).alias("score"))


def top_k(index: BM25Index, q: str, k: int) -> DataFrame:
    """Best ``k`` documents by score (key as tie-break): a per-partition top-k."""
    s = scores(index, q)
    return s.orderBy(F.desc("score"), F.asc(index.key)).limit(k)


#: A score this far below the threshold is taken for rounding.
_ROUNDING = 1e-9


def similarity_bound(name: Column, q: str) -> Column:
    """Greatest Jaro-Winkler similarity that ``name`` can have to ``q``, from counts alone.

    Characters that match are common to both, so there are at most as many as the two
    multisets share: by byte for the ASCII characters of ``q``, all other bytes together.
    Without transpositions that many matches give the greatest Jaro value, and the common
    beginning gives the greatest boost. Only native functions: it runs before any Python.
    """
    data = q.encode()
    ascii_ = sorted({c for c in q if c.isascii()})
    length = F.octet_length(name)
    held = lambda c: length - F.octet_length(F.replace(name, F.lit(c), F.lit("")))
    terms = [F.least(held(c), F.lit(q.count(c))) for c in ascii_]
    if len(data) > sum(q.count(c) for c in ascii_):
        others = F.octet_length(F.regexp_replace(name, "[\\x00-\\x7f]", ""))
        terms.append(F.least(others, F.lit(sum(b > 127 for b in data))))
    common = functools.reduce(operator.add, terms, F.lit(0))
    jaro = F.when(common > 0, (common / length + common / len(data) + 1) / 3).otherwise(F.lit(0.0))
    prefix = F.lit(0)
    for n in range(1, 5):
        prefix = F.when(F.substring(name, 1, n) == q[:n], F.lit(n)).otherwise(prefix)
    # the boost counts bytes, and letters may share their first one: then take the most
    first = F.substring(name, 1, 4)
    boost = F.when(F.octet_length(first) > F.length(first), F.lit(4)).otherwise(prefix)
    return F.when(jaro > 0.7, jaro + boost * 0.1 * (1 - jaro)).otherwise(jaro)


def fuzzy_name_hits(names: DataFrame, col: str, q: str, threshold: float = 0.85) -> DataFrame:
    """Distinct lower-cased values of ``col`` with Jaro-Winkler >= threshold to ``q``."""
    found = fuzzy_candidates(names, col, q, threshold)
    # Marked nondeterministic so the optimizer keeps the filter above the
    # distinct: a deterministic predicate on the grouping column would be pushed
    # below the aggregate and the UDF would then run once per row, not once per
    # distinct name.
    once = jaro_winkler.asNondeterministic()
    return found.where(once(F.col("_nm"), F.lit(q.lower())) >= threshold).select("_nm")


def fuzzy_candidates(names: DataFrame, col: str, q: str, threshold: float = 0.85) -> DataFrame:
    """Distinct lower-cased values of ``col`` that may reach the threshold: an exact prune
    by :func:`similarity_bound` before the distinct, so that only candidates are shuffled."""
    ql = q.lower()
    name = F.lower(F.coalesce(F.col(col), F.lit("")))
    nm = names.select(name.alias("_nm")).where(F.col("_nm") != "")
    if not ql:
        return nm.where(F.lit(False))
    return nm.where(similarity_bound(F.col("_nm"), ql) >= threshold - _ROUNDING).distinct()


def ilike_any(q: str, *cols: str):
    pat = like_contains(q)
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.col(c).ilike(pat), F.lit(False))
    return cond
