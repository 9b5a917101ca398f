"""The corpus pipeline: five stages from raw documents to a training mix.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All stages but the last
return the columns of their documents.

A null or repeated doc_id does not stop a stage: rows are then told apart by row
numbers of a written copy. Null and empty texts go at the first stage (they have no
language). Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regframe.llm import common, decontaminate, jaccard, langid, mixing, secrets

#: The language stage rejects what it cannot tell at least this surely.
MIN_LANG_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; rejects ``und`` and unsure ones."""
    got = langid.predict(docs, langid.train(docs), carry=docs.columns)
    return got.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_LANG_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least id."""
    rows = common.numbered(docs)
    found = jaccard.join(rows, doc_id="rid")
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("stay"))
    return rows.join(stay, F.col("rid") == F.col("stay"), "left_semi").select("row.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    got = decontaminate.scan(docs, common.table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return got.where(F.size("ranges") == 0).select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; ``n_chars`` follows the text."""
    got = secrets.scan(docs, carry=docs.columns)
    text = secrets.redact(got)
    new = {"text": text, "n_chars": F.when(F.size("spans") > 0, F.length(text)).otherwise(F.col("row.n_chars"))}
    return got.select(
        *[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns]
    )


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often: ``mix_size``, ``mix_target``
    (of the source), ``mix_copies``, ``mix_taken``."""
    got = mixing.mix(docs, carry=docs.columns).where("copies > 0")
    added = {"mix_size": "size", "mix_target": "target", "mix_copies": "copies", "mix_taken": "taken"}
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return got.select(*kept, *[F.col(v).alias(k) for k, v in added.items()])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: The language and secret stages are trained models, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
