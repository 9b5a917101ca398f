"""Compaction, versions, snapshots, table counts, materialisation reuse."""

from __future__ import annotations

import os

import pytest

from regframe.operators import maintain


def test_compaction_keeps_counts(spark, scratch):
    src = os.path.join(scratch, "compact", "t")
    df = spark.range(0, 5000).selectExpr("id", "cast(id % 37 as string) AS k")
    maintain.write_version(df.repartition(50), src)
    assert maintain.count_files(spark, f"{src}/v=1") == 50
    res = maintain.compact(spark, src, target_files=3, key="k")
    assert res["linhas"] == 5000 and res["arquivos_antes"] == 50 and res["arquivos_depois"] <= 3
    assert res["bytes_antes"] > res["bytes_depois"] > 0
    assert maintain.current_version(spark, src) == 2
    assert maintain.read_current(spark, src).count() == 5000
    assert maintain.expire_versions(spark, src, keep=1, dry_run=True) == [f"{src}/v=1"]
    gone = maintain.expire_versions(spark, src, keep=1)
    assert gone == [f"{src}/v=1"] and maintain.read_current(spark, src).count() == 5000


def test_compaction_of_a_flat_table_does_not_double_rows(spark, scratch):
    root = os.path.join(scratch, "flat-base")
    flat = spark.range(100).selectExpr("cast(id as string) AS cnpj_basico").repartition(7)
    flat.write.parquet(f"{root}/empresas")  # written before versions existed
    for expected in (100, 100):
        maintain.compact_base(spark, root, target_files=2)
        got = maintain.read_tables(spark, root)["empresas"]
        assert got.count() == expected and got.columns == ["cnpj_basico"]


def test_compaction_publishes_all_or_nothing(spark, scratch, monkeypatch):
    root = os.path.join(scratch, "all-or-nothing")
    for t in ("a", "b"):
        maintain.write_version(spark.range(10), f"{root}/{t}")
    real = maintain.write_version

    def lossy(df, table_dir, **kw):
        return real(df.limit(9) if table_dir.endswith("/b") else df, table_dir, **kw)

    monkeypatch.setattr(maintain, "write_version", lossy)
    with pytest.raises(RuntimeError):
        maintain.compact_base(spark, root, target_files=1)
    assert [maintain.published(spark, f"{root}/{t}") for t in ("a", "b")] == [[1], [1]]


def test_expire_never_takes_the_last_complete_version(spark, scratch):
    t = os.path.join(scratch, "unfinished", "t")
    maintain.write_version(spark.range(3), t)
    maintain.write_version(spark.range(5), t, visible=False)  # a rebuild that did not end
    assert maintain.expire_versions(spark, t, keep=1) == []
    assert maintain.read_current(spark, t).count() == 3
    maintain.write_version(spark.range(7), t)
    assert maintain.expire_versions(spark, t, keep=1) == [f"{t}/v=2", f"{t}/v=1"]


def test_snapshot_months(spark, scratch):
    root = os.path.join(scratch, "snaps")
    for m in ("202607", "202608", "202609"):
        maintain.write_version(spark.range(3), f"{maintain.snapshot_path(root, m)}/empresas")
        maintain.touch(spark, f"{maintain.snapshot_path(root, m)}/{maintain.MODEL_MARKER}")
    spark.range(1).write.parquet(f"{maintain.snapshot_path(root, '202610')}/_raw/g=1/empresas")  # half landed
    assert maintain.months(spark, root) == ["202609", "202608", "202607"]
    assert maintain.current_month(spark, root) == "202609"
    assert maintain.expire_months(spark, root, keep=2, dry_run=True) == [maintain.snapshot_path(root, "202607")]
    gone = maintain.expire_months(spark, root, keep=2)
    assert gone == [maintain.snapshot_path(root, "202607")]
    reg = maintain.open_snapshot(spark, root)
    assert reg.ano_mes == "202609" and reg["empresas"].count() == 3
    with pytest.raises(FileNotFoundError):
        maintain.open_snapshot(spark, root, "202610")


def test_table_counts(spark):
    t = {"a": spark.range(3), "b": spark.range(0)}
    got = {r["tabela"]: r["linhas"] for r in maintain.table_counts(t).collect()}
    assert got == {"a": 3, "b": 0}


def test_materialize_follows_its_inputs(spark, scratch):
    from regframe.bundle import Registry

    root = os.path.join(scratch, "mat")
    reg = lambda n: Registry({"estabelecimento": spark.range(n).selectExpr("cast(id as string) AS cnpj_basico")})
    assert maintain.materialize(reg(10), root, partitions=2, inputs="a")["estabelecimento"].count() == 10
    # the same inputs: the published table is reused
    assert maintain.materialize(reg(99), root, partitions=2, inputs="a")["estabelecimento"].count() == 10
    # other inputs: it is built again
    assert maintain.materialize(reg(99), root, partitions=2, inputs="b")["estabelecimento"].count() == 99


def test_registry_follows_changed_input_files(spark, scratch):
    import shutil

    from mini_fixture import SF_SMALL

    from regframe.plans import catalog

    d = os.path.join(scratch, "inputs")
    shutil.copytree(SF_SMALL, d)
    before = catalog.registry(spark, d)["estabelecimento"].count()
    more = spark.read.parquet(f"{d}/orders.parquet")
    more = more.unionByName(more.limit(5).withColumn("o_orderkey", more["o_orderkey"] + 10_000_000)).toPandas()
    import pyarrow as pa
    import pyarrow.parquet as pq

    schema = pq.read_schema(f"{d}/orders.parquet")
    pq.write_table(pa.Table.from_pandas(more, schema=schema, preserve_index=False), f"{d}/orders.parquet")
    assert catalog.registry(spark, d)["estabelecimento"].count() == before + 5


def test_staged_model_marker_and_reopen(spark, scratch):
    import os

    from mini_fixture import SF_SMALL

    from regframe.operators import maintain
    from regframe.sources import starmap

    root = os.path.join(scratch, "staged-model")
    assert maintain.open_model(spark, root, ano_mes="202609", data_ref="x") is None
    a = starmap.inputs(spark, SF_SMALL)
    reg = maintain.materialize_model(a.pop("raw"), a.pop("codes"), root, ano_mes="202609", **a)
    again = maintain.open_model(spark, root, ano_mes="202609", data_ref="x")
    assert again is not None
    names = {k for k, v in reg.frames.items() if v is not None}
    assert names == set(again.frames)
    for k in ("estabelecimento", "socios", "cnpj_base2matriz", "estabelecimento_cnae"):
        assert again[k].count() == reg[k].count()
    # branch numbers: one head office per company, numbers consecutive from 1
    est = again["estabelecimento"]
    assert est.where("matriz_filial = '1'").count() == est.select("cnpj_basico").distinct().count()


def test_compacted_files_follow_the_bytes(spark, scratch):
    root = os.path.join(scratch, "compact_bytes")
    rows = spark.range(0, 20000, 1, 12).selectExpr("id AS k", "sha2(CAST(id AS STRING), 256) AS v")
    maintain.write_version(rows, f"{root}/a")
    size = maintain._bytes(spark, maintain.current_path(spark, f"{root}/a"))
    (done,) = maintain.compact_base(spark, root, file_bytes=size // 5 + 1)
    assert done["arquivos_depois"] == 5 and done["linhas"] == 20000
    (done,) = maintain.compact_base(spark, root)
    assert done["arquivos_depois"] == 1


def test_reload_month_replaces_one_of_many_files(spark, monkeypatch):
    from regframe.operators import load
    from regframe.plans import catalog, q_ingest

    folders = []
    plain = load.load_dump

    def seen(spark, folder, base, **kw):
        out = plain(spark, folder, base, **kw)
        names = load.open_base(spark, base)["empresas"]
        folders.append((sum(n.endswith(".EMPRECSV") for n in os.listdir(folder.removeprefix("file:"))), names.where("razao_social = 'ANTES'").count(), names.count()))
        return out

    monkeypatch.setattr(q_ingest.load, "load_dump", seen)
    inputs = q_ingest.starmap.inputs

    def in_parts(*a):  # the small table comes in one partition
        got = inputs(*a)
        return got | {"raw": got["raw"] | {"empresas": got["raw"]["empresas"].repartition(4, "cnpj_basico")}}

    monkeypatch.setattr(q_ingest.starmap, "inputs", in_parts)
    got = catalog.queries()["reload_month"](spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(q_ingest.starmap, "inputs", inputs)
    want = catalog.registry(spark, "/root/testdata/sf0.001")["empresas"].select(*got.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    (files, stale, rows), (files_again, left, rows_again) = folders
    assert files == files_again > 1 and rows == rows_again == want.count()
    assert left == 0 and 0 < stale < rows


def test_compaction_by_range_opens_one_file(spark, scratch):
    root = os.path.join(scratch, "by-range")
    rows = spark.range(0, 4000).selectExpr("lpad(cast(id % 500 as string), 8, '0') AS cnpj_basico", "cast(id as string) AS cnpj")
    hot = spark.range(4000, 6000).selectExpr("'00000250' AS cnpj_basico", "cast(id as string) AS cnpj")
    maintain.write_version(rows.unionByName(hot).repartition(9), f"{root}/estabelecimento")
    maintain.commit_current(spark, root, ["estabelecimento"])
    maintain.compact_base(spark, root, target_files=8)
    path = maintain.table_path(spark, root, "estabelecimento")
    assert maintain.table_paths(spark, root) == {"estabelecimento": path} and path.endswith("v=2")
    files = lambda k: maintain.files_of_key(spark, path, "cnpj_basico", k)
    assert len(files("00000010")) == 1 and len(files("99999999")) == 0
    # a key with a third of all rows is cut over several files, and found in all of them
    assert len(files("00000250")) > 1 and spark.read.parquet(*files("00000250")).where("cnpj_basico = '00000250'").count() == 2008
    assert maintain.files_of_key(spark, path, "cnpj", "1") is None


def test_a_month_is_switched_at_once(spark, scratch):
    root = os.path.join(scratch, "switch")
    for t in ("a", "b"):
        maintain.write_version(spark.range(3), f"{root}/{t}")
    assert maintain.commit_current(spark, root, ["a", "b"]) == 1
    maintain.write_version(spark.range(5), f"{root}/a")  # a reload that stops here
    counts = lambda: {t: df.count() for t, df in maintain.read_tables(spark, root).items()}
    assert counts() == {"a": 3, "b": 3}
    # neither retention nor compaction loses or mixes what the month is made of
    assert maintain.expire_versions(spark, f"{root}/a", keep=1) == []
    maintain.compact_base(spark, root, target_files=1)
    assert counts() == {"a": 3, "b": 3} and maintain.snapshot(spark, root)["a"] == "a/v=3"
    maintain.write_version(spark.range(7), f"{root}/a")
    maintain.write_version(spark.range(7), f"{root}/b")
    maintain.commit_current(spark, root, ["a", "b"])
    assert counts() == {"a": 7, "b": 7} and maintain.snapshot(spark, root, 1) == {"a": "a/v=1", "b": "b/v=1"}
    # two runs cannot both write the same snapshot
    real = maintain._snapshot_numbers
    maintain._snapshot_numbers = lambda spark, root: [2]
    try:
        with pytest.raises(RuntimeError):
            maintain.commit(spark, root, {"a": f"{root}/a/v=1"})
    finally:
        maintain._snapshot_numbers = real
