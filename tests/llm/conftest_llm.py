"""Fixtures shared by the tests of the training-data operators."""

from __future__ import annotations

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators might use themselves
        T.StructField("row", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_words", T.LongType()),
    ]
)


def docs_of(spark, texts, *, lang="en", source="s", first_id=0):
    """A documents table with clashing extra columns; texts may be (text, lang, source)."""
    rows = []
    for i, t in enumerate(texts):
        t = t if isinstance(t, tuple) else (t, lang, source)
        rows.append((first_id + i, *t, None if t[0] is None else len(t[0]), "x", -1, "y", None))
    return spark.createDataFrame(rows, DOC_SCHEMA)


#: Texts every operator must take: null, empty, blank, one word, very long, repeated rows.
EDGES = [
    None,
    "",
    " \t\n ",
    "word",
    "\x00\x01 odd   text \U0001f600",
    "long " * 40_000,
    "x" * 120_000,
    "same row of text here for a tie",
    "same row of text here for a tie",
]
