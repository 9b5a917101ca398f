from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest_llm import SF, docs_of  # noqa: E402


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda texts, **k: docs_of(spark, texts, **k)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
