"""The load job on larger dumps: what it cuts, builds, shuffles and keeps."""

from __future__ import annotations

import os
import time

import pytest
from mini_fixture import SF_SMALL
from pyspark.sql import functions as F
from test_records import _companies

from regframe.operators import maintain, model
from regframe.plans import catalog, q_ingest
from regframe.schemas import PARTNER_COLUMNS
from regframe.session import written
from regframe.streaming import landing


def test_blocks_grow_with_the_dump(spark, tmp_path, monkeypatch):
    directory = str(tmp_path / "dump")
    os.makedirs(directory)
    _companies(f"{directory}/K3241.K03200Y0.D60925.EMPRECSV", 300)
    size = os.path.getsize(f"{directory}/K3241.K03200Y0.D60925.EMPRECSV")
    monkeypatch.setattr(landing, "MOST_BLOCKS", 4)
    with pytest.warns(UserWarning):
        at, rows = landing.land(spark, directory, str(tmp_path / "raw"), ano_mes="202609", block_bytes=1000)
    assert size > 10_000 and rows["empresas"] == 300
    assert spark.read.parquet(f"{at}/_blocks/empresas").count() == 4
    assert landing.read_landed(spark, at, "empresas").where("razao_social = 'nome\\nem duas linhas'").count() == 300
    # not beyond the session's size, and as asked while the dump is small
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        assert landing.block_size(spark, 1000, size) == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert landing.block_size(spark, 1000, 3000) == 1000 and landing.block_size(spark, None, size) is None


def test_two_steps_write_large_files_in_parallel(spark, monkeypatch):
    """The late rows of a large table are several files, each cut into blocks; no other base
    is built beside the one that is loaded."""
    files = []
    load_dump = q_ingest.load.load_dump

    def seen(spark, folder, base, **kw):
        files.append(sum(n.startswith("B") and n.endswith("ESTABELE") for n in os.listdir(folder.removeprefix("file:"))))
        return load_dump(spark, folder, base, **kw)

    want = catalog.registry(spark, SF_SMALL)["estabelecimento"].select("cnpj", "uf", "situacao_cadastral", "cnae_fiscal_secundaria")

    def unused(*a, **kw):
        raise AssertionError("a registry that the query does not read")

    monkeypatch.setattr(q_ingest.load, "load_dump", seen)
    monkeypatch.setattr(catalog, "registry", unused)
    monkeypatch.setattr(q_ingest, "_LARGE_BYTES", 1)
    # the small table comes in one partition
    monkeypatch.setattr(q_ingest, "written", lambda df, folder: written(df.repartition(4), folder))
    got = catalog.queries()["load_two_steps"](spark, SF_SMALL).select(*want.columns)
    assert files[0] == 0 and files[1] > 1
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


@pytest.mark.parametrize("name", ["load_without_simples", "load_validated", "reload_month", "reload_failed_keeps_month", "upgrade_dimensions"])
def test_queries_that_load_build_no_other_base(spark, monkeypatch, name):
    class Reached(Exception):
        pass

    def inputs(*a):
        raise Reached

    monkeypatch.setattr(catalog, "registry", lambda *a, **kw: pytest.fail("a registry that the query does not read"))
    monkeypatch.setattr(q_ingest.starmap, "inputs", inputs)
    with pytest.raises(Reached):
        catalog.queries()[name](spark, SF_SMALL)


def test_shuffle_files_of_written_tables_go(spark, tmp_path):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = manager.getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    before = shuffled()
    df = spark.range(50_000).select(F.col("id").cast("string").alias("cnpj_basico"))
    maintain._write_all(spark, {"empresas": df}, str(tmp_path / "base"), None, "x")
    deadline = time.time() + 20  # Spark's cleaner runs beside the caller
    while (left := shuffled() - before) and time.time() < deadline:
        with maintain.sized_tasks(spark, []):  # the next step of a load
            time.sleep(0.2)
    assert not left and maintain.read_current(spark, str(tmp_path / "base/empresas")).count() == 50_000


def test_only_companies_among_partners_are_looked_up_by_document(spark, tmp_path):
    rows = [("00000001", "1", "00000002"), ("00000001", "1", "00000009"), ("00000002", "1", None), ("00000002", "2", "00000001"), ("00000003", "3", None), ("00000001", None, "00000002")]
    text = ", ".join(f"{c} string" for c in PARTNER_COLUMNS)
    full = [dict.fromkeys(PARTNER_COLUMNS) | {"cnpj_basico": b, "identificador_de_socio": k, "cnpj_cpf_socio": d} for b, k, d in rows]
    spark.createDataFrame(full, text).write.parquet(str(tmp_path / "p"))
    heads = spark.createDataFrame([("00000001", "00000001000191"), ("00000002", "00000002000272")], "cnpj_basico string, cnpj string")
    got = model.partners(spark.read.parquet(str(tmp_path / "p")), heads, "202609")
    assert sorted(((r["cnpj"], r["identificador_de_socio"], r["cnpj_cpf_socio"]) for r in got.collect()), key=str) == sorted(
        [
            ("00000001000191", "1", "00000002000272"),
            ("00000001000191", "1", None),
            ("00000002000272", "1", None),
            ("00000002000272", "2", "00000001"),
            (None, "3", None),
        ],
        key=str,
    )
    # people cross the network once, by their company
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    lookup = next(line for line in plan.splitlines() if "Join LeftOuter" in line and "cnpj_cpf_socio" in line)
    below = plan.split(lookup)[1].splitlines()
    assert any("Filter" in x and "identificador_de_socio" in x and "= 1)" in x for x in below[:4])


def test_the_failed_reload_had_written_tables(spark, monkeypatch):
    """The month stays although newer tables of it lie beside the old ones."""
    seen = []
    compact = q_ingest.maintain.compact_base

    def spy(spark, month, **kw):
        seen.append({t: maintain.published(spark, f"{month}/{t}") for t in ("empresas", "estabelecimento", "cnpj_base2matriz", "socios")})
        return compact(spark, month, **kw)

    monkeypatch.setattr(q_ingest.maintain, "compact_base", spy)
    got = catalog.queries()["reload_failed_keeps_month"](spark, SF_SMALL)
    assert seen == [{"empresas": [2, 1], "estabelecimento": [2, 1], "cnpj_base2matriz": [2, 1], "socios": [1]}]
    assert got.where("razao_social = 'DEPOIS'").count() == 0
    assert got.count() == catalog.registry(spark, SF_SMALL)["estabelecimento"].count()
