"""The registered queries: one Spark plan and (where SQL can say it) one
independent SQL text per operator, both over the driver's tables.

Each Spark entry takes ``(spark, sf_dir)``; the SQL text runs in DuckDB with
the driver tables registered as views and the derived registry written out as
common table expressions (:mod:`regframe.plans.oracle_registry`).
"""

from __future__ import annotations

import hashlib
import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regframe.bundle import Registry
from regframe.operators import maintain
from regframe.session import checkpoint_dir
from regframe.plans.oracle_registry import with_registry
from regframe.sources import starmap

SparkFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, SparkFn] = {}
_ORACLE: dict[str, str] = {}
_REGISTRIES: dict[tuple, Registry] = {}
_LOCK = threading.RLock()


def registry(spark: SparkSession, sf_dir: str, *, materialized: bool = True) -> Registry:
    """The derived registry of one scale directory, built once per session.

    By default the model is written once as Parquet under the session's shared
    checkpoint folder and read back (a loaded base, as the queries expect);
    ``materialized=False`` gives the lazy derivation instead.
    """
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, materialized)
    with _LOCK:  # concurrent callers must not write the same tables twice
        return _registry(spark, sf_dir, materialized, key)


def _registry(spark: SparkSession, sf_dir: str, materialized: bool, key: tuple) -> Registry:
    if materialized:
        # Keyed by the input files' names, sizes and times and by the deriving code: other
        # tables under the same path, or other code, give another folder.
        names = ("customer", "orders", "lineitem", "part", "nation", "region")
        stamps = maintain.file_stamps(spark, [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names])
        inputs = maintain.fingerprint(*stamps, _code_hash())
        key = (*key, inputs)
    if key not in _REGISTRIES:
        if materialized:
            root = f"{checkpoint_dir(spark).rstrip('/')}/regframe-model/{inputs[:20]}"
            reg = maintain.open_model(spark, root, ano_mes=starmap.STARMAP_MONTH, data_ref=starmap.STARMAP_DATE)
            if reg is None:
                a = starmap.inputs(spark, sf_dir)
                reg = maintain.materialize_model(
                    a.pop("raw"), a.pop("codes"), root, ano_mes=starmap.STARMAP_MONTH, inputs=inputs, **a
                )
        else:
            reg = starmap.load(spark, sf_dir)
        _REGISTRIES[key] = reg
    return _REGISTRIES[key]


def _code_hash() -> str:
    """Hash of the package's source, so that a shared checkpoint folder that outlives a
    run never serves tables written by another derivation."""
    h = hashlib.sha1()
    for part in ("sources", "operators", "functions", ""):
        folder = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), part)
        for name in sorted(os.listdir(folder)):
            if name.endswith(".py"):
                with open(os.path.join(folder, name), "rb") as fh:
                    h.update(fh.read())
    return h.hexdigest()


def query(name: str, sql: str | None = None, *, extra_ctes: list[tuple[str, str]] | None = None, own_base: bool = False):
    """Register ``fn(reg, spark, sf_dir)``; ``sql`` is the body after the registry CTEs.
    ``own_base``: the query loads a base of its own and reads no other, so none is built
    for it and ``reg`` is None."""

    def deco(fn: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(None if own_base else registry(spark, sf_dir), spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLE[name] = with_registry(sql, extra_ctes)
        return fn

    return deco


def queries() -> dict[str, SparkFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)


def _load_all() -> None:
    # importing the modules registers their queries
    from regframe.plans import (  # noqa: F401
        q_adhoc,
        q_aggregates,
        q_dims,
        q_ingest,
        q_model,
        q_profile,
        q_quality,
        q_search,
    )
