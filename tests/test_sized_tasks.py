"""Shuffles of a table's build are cut by what it reads, whatever the session's number is."""

from __future__ import annotations

from pyspark.sql import functions as F

from regframe.operators import maintain

KEYS = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "in")
    spark.range(200_000).select(F.col("id").alias("cnpj_basico"), F.uuid().alias("t")).write.parquet(path)
    monkeypatch.setattr(maintain, "SPLIT_BYTES", 1 << 20)
    monkeypatch.setattr(maintain, "TASK_BYTES", 2 << 20)
    before = [spark.conf.get(k, None) for k in KEYS]
    df = spark.read.parquet(path)
    shuffled = df.groupBy("cnpj_basico").agg(F.max("t").alias("t"))
    number = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = maintain._write_all(spark, {"empresas": shuffled}, str(tmp_path / "base"), None, "x", frozenset({"empresas"}))["empresas"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", number)
    assert maintain.input_bytes(df) > 4 << 20
    assert len(got.inputFiles()) > 2
    assert got.count() == 200_000
    assert [spark.conf.get(k, None) for k in KEYS] == before
