"""Records of quoted text, cut inside files, against a reader of whole files."""

from __future__ import annotations

import csv
import os
import random

import pytest

from regframe.sources import dump, records
from regframe.streaming import landing

COLUMNS = ["a", "b", "c"]


def _field(rng):
    return rng.choice(["", "x", "é ção", "um\ndois", "\n", "a;b", 'dito "isto"', "fim\n\n", "w" * rng.randint(1, 60), "cr\r\nlf"])


def _write(path, seed, n, end="\n"):
    rng = random.Random(seed)
    rows = []
    with open(path, "wb") as f:
        for i in range(n):
            row = [f"{seed}-{i}", _field(rng), _field(rng)][: rng.choice([3, 3, 3, 2])]
            cells = [('"' + v.replace('"', '""') + '"') if v or rng.random() < 0.5 else None for v in row]
            f.write((";".join(c or "" for c in cells) + end).encode("cp1252"))
            if rng.random() < 0.1:
                f.write(end.encode())
            rows.append(tuple(v or None for v in row) + (None,) * (3 - len(row)))
    return rows


def _key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("block", [64, 333, 10_000_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cut_anywhere(spark, tmp_path, block, end):
    want = _write(tmp_path / "one.T", 1, 150, end) + _write(tmp_path / "two.T", 2, 40, end)
    with records.grid(spark, block):
        got = dump.read_files(spark, str(tmp_path), ["one.T", "two.T"], COLUMNS, block_bytes=block)
        rows = [tuple(r[c] for c in COLUMNS) for r in got.collect()]
        if block < 1000:
            assert got.rdd.getNumPartitions() > 1
    assert _key(rows) == _key(want)


def test_a_record_longer_than_blocks(spark, tmp_path):
    long = "line\n" * 500
    with open(tmp_path / "x.T", "wb") as f:
        f.write(f'"1";"{long}";"z"\n"2";"b";"c"'.encode("cp1252"))
    with records.grid(spark, 100):
        rows = dump.read_files(spark, str(tmp_path), ["x.T"], COLUMNS, block_bytes=100).collect()
    assert sorted((r["a"], r["b"], r["c"]) for r in rows) == [("1", long, "z"), ("2", "b", "c")]


def _companies(path, n, first=0, name="nome\nem duas linhas"):
    with open(path, "w", encoding="cp1252", newline="") as f:
        w = csv.writer(f, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator="\n")
        for i in range(first, first + n):
            w.writerow([f"{i:08d}", name, "2062", "49", "1,00", "01", ""])


def test_landing_cuts_files_and_resumes(spark, tmp_path):
    from regframe.schemas import RAW_KINDS

    directory, root = str(tmp_path / "dump"), str(tmp_path / "raw")
    os.makedirs(directory)
    tag = "K3241.K03200Y0.D60925"
    _companies(f"{directory}/{tag}.EMPRECSV", 300)
    with pytest.warns(UserWarning):
        at, rows = landing.land(spark, directory, root, ano_mes="202609", block_bytes=1000)
    assert rows["empresas"] == 300 and len(RAW_KINDS) > 1
    got = landing.read_landed(spark, at, "empresas")
    assert got.where("razao_social = 'nome\\nem duas linhas'").count() == 300 and got.select("cnpj_basico").distinct().count() == 300
    blocks = spark.read.parquet(f"{at}/_blocks/empresas")
    assert blocks.count() > 10 and blocks.where("inside").count() > 0
    # a second file joins the generation, the first is not landed again
    _companies(f"{directory}/B.K03200Y0.D60925.EMPRECSV", 50, 1000)
    with pytest.warns(UserWarning):
        again, rows = landing.land(spark, directory, root, ano_mes="202609", block_bytes=1000)
    assert again == at and rows["empresas"] == 50 and landing.read_landed(spark, at, "empresas").count() == 350


def test_a_file_replaced_after_a_run_that_was_cut_short(spark, tmp_path, monkeypatch):
    directory, root = str(tmp_path / "dump"), str(tmp_path / "raw")
    os.makedirs(directory)
    path = f"{directory}/K3241.K03200Y0.D60925.EMPRECSV"
    _companies(path, 20, name="antes")
    real = landing._note

    def stopped(spark, path, stamps):
        if path.endswith("_MANIFEST"):
            raise RuntimeError("stopped")
        real(spark, path, stamps)

    monkeypatch.setattr(landing, "_note", stopped)
    with pytest.warns(UserWarning), pytest.raises(RuntimeError):
        landing.land(spark, directory, root, ano_mes="202609")
    monkeypatch.setattr(landing, "_note", real)
    _companies(path, 30, name="depois")
    with pytest.warns(UserWarning):
        at, rows = landing.land(spark, directory, root, ano_mes="202609")
    got = landing.read_landed(spark, at, "empresas")
    assert at.endswith("g=2") and got.count() == 30 and got.where("razao_social = 'depois'").count() == 30


def test_streams_cut_files_as_their_states_were_counted(spark, tmp_path, scratch):
    """Where the session cuts finer than the grid: a stream that plans its batch late still
    meets the blocks that were counted."""
    (tmp_path / "dump").mkdir()
    for i, kind in enumerate(("EMPRECSV", "ESTABELE", "SOCIOCSV", "CNAECSV")):
        name = f"F.{kind}" if kind == "CNAECSV" else f"A{i}.K03200Y0.D60925.{kind}"
        _companies(tmp_path / "dump" / name, 400, first=1000 * i)
    keys = {"spark.sql.files.openCostInBytes": "64", "spark.sql.files.minPartitionNum": "40"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        _, n = landing.land(spark, str(tmp_path / "dump"), f"{scratch}/grid/_raw", ano_mes="202609")
        assert {k: spark.conf.get(k) for k in keys} == keys
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert n == {"empresas": 400, "estabelecimento": 400, "socios_original": 400, "cnae": 400}
