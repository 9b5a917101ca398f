"""Near copies of one text: windows are counted only where the hulls of a kernel differ."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from regframe.llm import repeats
from test_repeats import brute, rows_of, words


def test_windows_of_equal_hulls_are_not_counted(spark, monkeypatch):
    rng = random.Random(5)
    base = words(rng, 150)
    texts = []
    for _ in range(60):
        i = rng.randrange(len(base))
        texts.append(base[:i] + "Q" + base[i + 1 :])
    monkeypatch.setattr(repeats, "ORDERED", 1)
    written, seen = repeats.common.written, {}
    monkeypatch.setattr(repeats.common, "written", lambda df, folder: seen.setdefault(folder, written(df, folder)))
    assert rows_of(spark, texts) == brute(texts)
    cells = seen["repeat-cells"].agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0]
    assert 0 < seen["repeat-windows"].count() < 0.7 * cells
