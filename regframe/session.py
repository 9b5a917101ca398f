"""Session construction and shared-folder helpers.

On a cluster the session already exists and names a shared checkpoint folder
in ``spark.checkpoint.dir``; we only read it. A local folder is set only when
that setting is absent (tests, benches on one machine).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(
    master: str | None = None,
    *,
    shuffle_partitions: int | None = None,
    app_name: str = "regframe",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with AQE, skew-join splitting and UTC time, UI off.

    ``master`` is only for local runs; on a cluster call with ``master=None`` and
    the launcher's settings are kept.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        # checkpoints of list-sized intermediates are removed once unreferenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the session's setting, else a local one.

    A local folder is only created when nothing is configured (single-machine
    runs); a cluster is expected to name a shared one.
    """
    current = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the whole cluster shares")
    local = tempfile.mkdtemp(prefix="regframe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set(CHECKPOINT_KEY, local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, of a size the planner knows."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
