"""Load the hand-made dump end to end and check the published facts."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from regframe.operators import analytics, enrich, geo, load, maintain, profile, quality, search
from regframe.operators.search import SearchSpec


def _keys(df, col="cnpj"):
    return {r[col] for r in df.select(col).collect()}


def test_counts(mini_base, mini_reg):
    _, summary, _ = mini_base
    c = summary["contagens"]
    assert (c["empresas"], c["estabelecimento"], c["socios"]) == (3, 5, 3)
    assert c["estabelecimento_cnae"] == 8  # 5 principal + 3 secondary
    assert summary["ano_mes"] == "202609" and summary["referencia"] == "25/09/2026"
    assert summary["fts"] is True


def test_views(mini_reg):
    from regframe.operators import model

    assert model.view_active(mini_reg).count() == 4
    assert model.view_head_office(mini_reg).count() == 3
    assert model.view_mei(mini_reg).count() >= 1


def test_capital_and_keys(mini_reg):
    caps = {r[0]: r[1] for r in mini_reg["empresas"].select("cnpj_basico", "capital_social").collect()}
    assert caps == {"12345678": 1000.0, "87654321": 50000.5, "12ABC345": 20000.0}
    assert "12ABC34501DE35" in _keys(mini_reg["estabelecimento"])


def test_profile_full_key(mini_reg):
    p = profile.profile(mini_reg, "12345678000195")
    est = p.estabelecimentos.collect()
    assert len(est) == 1 and est[0]["situacao_cadastral_desc"] == "Ativa"
    assert est[0]["cnae_descricao"] and est[0]["municipio_ibge"] == "3550308"
    emp = p.empresas.collect()[0]
    assert emp["natureza_juridica_desc"] == "Sociedade Empresária Limitada"
    assert emp["porte_empresa_desc"] == "Microempresa (ME)"
    assert p.socios.count() == 2


def test_profile_alphanumeric(mini_reg):
    p = profile.profile(mini_reg, "12.abc.345/01de-35")
    assert p.cnpj_consultado == "12ABC34501DE35"
    assert p.cnpj_formatado == "12.ABC.345/01DE-35"
    assert p.alfanumerico and p.dv_valido
    assert p.estabelecimentos.collect()[0]["municipio_ibge"] == "3304557"
    assert profile.profile(mini_reg, "12ABC345").estabelecimentos.count() == 1


def test_profile_bad_digits(mini_reg):
    p = profile.profile(mini_reg, "87654321000200")
    assert p.dv_valido is False and p.dv_esperado == "79"
    assert p.estabelecimentos.count() == 1


def test_profile_invalid_key(mini_reg):
    with pytest.raises(ValueError):
        profile.profile(mini_reg, "123")


def test_search_state_activity(mini_reg):
    rows = search.search(mini_reg, SearchSpec(uf="sp", cnae="6201501")).collect()
    assert rows and {r["cnae_origem"] for r in rows} <= {"principal", "secundario"}
    assert {r["cnpj"]: r["cnae_origem"] for r in rows} == {
        "12345678000195": "principal",
        "87654321000198": "secundario",
    }


def test_search_dimensions(mini_reg):
    s = lambda **kw: _keys(search.search(mini_reg, SearchSpec(**kw)))
    assert s(municipio_ibge="3304557") == {"87654321000200", "12ABC34501DE35"}
    assert s(cnae_secao="j") == {"12345678000195", "12ABC34501DE35"}
    assert s(cnae_divisao="46") == {"87654321000198", "87654321000200"}
    assert s(cnae_secao="Z") == set()
    assert s(municipio_ibge="9999999") == set()
    assert s(municipio="rio de") == {"87654321000200", "12ABC34501DE35"}
    assert s(mei=True) == {"12345678000195", "12345678000276"}
    assert s(capital_min=20000, capital_max=20000) == {"12ABC34501DE35"}
    assert s(q="alfa") == {"12ABC34501DE35"}
    # 'empresa alfa ltda' scores 0.866 against the query, so it matches too
    assert s(q="EMPRESA TESTE LTD", fuzzy=True) == {"12345678000195", "12345678000276", "12ABC34501DE35"}
    assert s(q="outra empressa", fuzzy=True) == {"87654321000198", "87654321000200"}
    assert s(q="zzzz qqqq", fuzzy=True) == set()


def test_ranked_search(spark, mini_base, mini_reg):
    idx = load.text_index(spark, mini_base[0])
    assert idx is not None
    rows = search.search(mini_reg, SearchSpec(q="ALFA"), index=idx).collect()
    assert rows[0]["cnpj"] == "12ABC34501DE35"
    assert "_fts_score" in rows[0].asDict()


def test_partner_by_document(mini_reg):
    rows = profile.partner_search(mini_reg, documento="12.ABC.345/01DE-35").collect()
    assert [r["razao_social"] for r in rows] == ["OUTRA EMPRESA SA"]
    with pytest.raises(ValueError):
        profile.partner_search(mini_reg)


def test_aggregates(mini_reg):
    sec = {r["secao"]: r["n"] for r in analytics.by_activity(mini_reg, nivel="secao").collect()}
    assert sec == {"J": 2, "G": 2}
    with pytest.raises(ValueError):
        analytics.by_activity(mini_reg, nivel="bogus")
    mun = {r["municipio_ibge"]: r["n"] for r in analytics.by_municipality(mini_reg).collect()}
    assert mun["3550308"] == 2
    st = {r["situacao"]: (r["n"], r["situacao_desc"]) for r in analytics.by_status(mini_reg).collect()}
    assert st == {"02": (4, "Ativa"), "08": (1, "Baixada")}


def test_cohorts(mini_reg):
    y = {r["periodo"]: r for r in analytics.cohorts(mini_reg, freq="ano").collect()}
    assert (y["2021"]["aberturas"], y["2021"]["ativas_hoje"], y["2021"]["taxa_sobrevivencia"]) == (2, 1, 0.5)
    assert (y["2025"]["aberturas"], y["2025"]["baixas"], y["2025"]["saldo"]) == (0, 1, -1)
    assert y["2025"]["taxa_sobrevivencia"] is None
    m = analytics.cohorts(mini_reg, freq="mes", uf="rj", desde="2026").collect()
    assert [r["periodo"] for r in m] == ["202608"]
    sp = analytics.cohorts(mini_reg, freq="ano", uf="SP").collect()
    assert {r["periodo"] for r in sp} == {"2019", "2020", "2021"}
    with pytest.raises(ValueError):
        analytics.cohorts(mini_reg, freq="dia")


def test_enrich_order_and_flags(spark, mini_reg):
    inputs = ["12345678000195", "87654321", "191", "xx", "87654321000200", None]
    rows = enrich.enrich(mini_reg, enrich.entries_from_list(spark, inputs)).collect()
    assert [r["pos"] for r in rows] == list(range(6))
    assert rows[0]["encontrado"] and rows[0]["dv_valido"] is True
    assert rows[1]["cnpj"] == "87654321000198" and rows[1]["dv_valido"] is None
    assert rows[2]["cnpj_normalizado"] == "00000191" and not rows[2]["encontrado"]
    assert rows[3]["erro"] and rows[3]["cnpj_normalizado"] is None
    assert rows[4]["encontrado"] and rows[4]["dv_valido"] is False
    assert rows[5]["erro"] and rows[5]["entrada"] == ""
    assert rows[0]["situacao_cadastral_desc"] == "Ativa" and rows[3]["situacao_cadastral_desc"] is None
    assert len(rows[0].asDict()) == 38  # pos + 37 columns


def test_key_list_reader(spark, scratch):
    from regframe.sources import keylist

    d = os.path.join(scratch, "lists")
    os.makedirs(d, exist_ok=True)
    txt = os.path.join(d, "keys.txt")
    with open(txt, "w") as f:
        f.write("12345678000195\n87654321\n191\n")
    got = keylist.read_key_list(spark, txt).orderBy("pos").collect()
    assert [(r["pos"], r["entrada"]) for r in got] == [(0, "12345678000195"), (1, "87654321"), (2, "191")]
    csvp = os.path.join(d, "keys.csv")
    with open(csvp, "w") as f:
        f.write("nome;CNPJ\nA;12345678000195\nB;87654321\n")
    got = keylist.read_key_list(spark, csvp).orderBy("pos").collect()
    assert [r["entrada"] for r in got] == ["12345678000195", "87654321"]
    with pytest.raises(ValueError):
        keylist.read_key_list(spark, csvp, coluna="nope")


def test_geocode_cache(spark, mini_reg):
    inputs = spark.createDataFrame(
        [(0, "01001000"), (1, "01001-000"), (2, "20040020"), (3, "abc")], "pos long, cep string"
    )
    pend = geo.pending(inputs, None)
    assert [r["cep"] for r in pend.collect()] == ["01001000", "20040020"]
    calls = []

    def fake_lookup(df):
        rows = df.collect()  # the test's stand-in service: a handful of codes
        calls.extend(r["cep"] for r in rows)
        return spark.createDataFrame(
            [(r["cep"], "ok", -23.55, -46.63) for r in rows],
            "cep string, status string, latitude double, longitude double",
        )

    cache = geo.merge(None, fake_lookup(pend))
    assert cache.count() == 2 and len(calls) == 2
    assert geo.pending(inputs, cache).count() == 0  # second run: nothing to ask
    reg = mini_reg.with_frames(cep_geo=cache)
    rows = {
        r["cnpj"]: r["geo_precisao"]
        for r in search.search(reg, SearchSpec(uf="SP")).collect()
    }
    assert rows["12345678000195"] == "cep" and rows["12345678000276"] == "municipio"
    st = geo.stats(pend, cache).collect()[0]
    assert (st["pendentes"], st["ok"]) == (2, 2)


def test_quality(mini_reg):
    rep = {r["check_name"]: r for r in quality.report(mini_reg).collect()}
    assert rep["cnpj_dv"]["valor"] == "1" and rep["cnpj_dv"]["ok"] is False
    assert rep["cnpj_alfanumerico"]["valor"] == "1"
    assert rep["municipio_ibge_cobertura"]["ok"] is True
    assert quality.overall_ok(quality.report(mini_reg)).first()["ok"] is True


def test_resume_without_raw_partners(spark, scratch):
    """Re-running after the raw partner data is gone keeps the resolved partners."""
    import mini_fixture

    dump_dir = mini_fixture.write_dump(os.path.join(scratch, "dump_resume"))
    base = os.path.join(scratch, "base_resume")
    first = load.load_dump(spark, dump_dir, base, text_index=False, partitions=2)
    assert first["contagens"]["socios"] == 3
    snap = maintain.snapshot_path(base, "202609")
    maintain.delete(spark, f"{snap}/_raw/g=1/socios_original")
    maintain.delete(spark, f"{dump_dir}/{mini_fixture.MONTH_TAG}.SOCIOCSV")
    again = load.load_dump(spark, dump_dir, base, text_index=False, partitions=2)
    assert again["contagens"]["socios"] == 3
    assert again["lotes"].get("empresas", 0) == 0  # nothing new to land
    assert first["lotes"]["estabelecimento"] == 5


def test_rerun_is_idempotent(spark, scratch):
    import mini_fixture

    dump_dir = mini_fixture.write_dump(os.path.join(scratch, "dump_again"))
    base = os.path.join(scratch, "base_again")
    first = load.load_dump(spark, dump_dir, base, text_index=False, partitions=2)
    again = load.load_dump(spark, dump_dir, base, text_index=False, partitions=2)
    assert again["contagens"] == first["contagens"] and set(again["lotes"].values()) == {0}
    snap = maintain.snapshot_path(base, "202609")
    assert maintain.published(spark, f"{snap}/estabelecimento") == [1]  # nothing was rebuilt


def _append_company(dump_dir, base, name):
    import mini_fixture

    row = [base, name, "2062", "49", "1,00", "01", ""]
    est = list(mini_fixture.establishment_rows()[0])
    est[0], est[1] = base, "0001"
    with open(os.path.join(dump_dir, f"X2.{mini_fixture.MONTH_TAG.split('.', 1)[1]}.EMPRECSV"), "wb") as f:
        f.write((mini_fixture._line(row) + "\n").encode("cp1252"))
    with open(os.path.join(dump_dir, f"X2.{mini_fixture.MONTH_TAG.split('.', 1)[1]}.ESTABELE"), "wb") as f:
        f.write((mini_fixture._line(est) + "\n").encode("cp1252"))


def test_late_files_changed_files_and_reload(spark, scratch):
    import mini_fixture

    dump_dir = mini_fixture.write_dump(os.path.join(scratch, "dump_late"))
    base = os.path.join(scratch, "base_late")
    run = lambda **kw: load.load_dump(spark, dump_dir, base, text_index=False, validate=False, partitions=2, **kw)
    assert run()["contagens"]["estabelecimento"] == 5
    _append_company(dump_dir, "99999999", "CHEGOU DEPOIS")
    out = run()  # a second file of the month reaches the model
    assert out["contagens"]["estabelecimento"] == 6 and out["contagens"]["empresas"] == 4
    assert out["lotes"]["estabelecimento"] == 1
    assert load.open_base(spark, base)["estabelecimento_cnae"].where("cnpj LIKE '99999999%'").count() == 3
    _append_company(dump_dir, "99999998", "CORRIGIDA: nome mais longo")  # the same file, other content
    out = run()
    names = {r["razao_social"] for r in load.open_base(spark, base)["empresas"].collect()}
    assert out["contagens"]["empresas"] == 4 and "CHEGOU DEPOIS" not in names
    os.remove(os.path.join(dump_dir, f"X2.{mini_fixture.MONTH_TAG.split('.', 1)[1]}.EMPRECSV"))
    os.remove(os.path.join(dump_dir, f"X2.{mini_fixture.MONTH_TAG.split('.', 1)[1]}.ESTABELE"))
    assert run(resume=False)["contagens"]["empresas"] == 3  # a reload replaces the month


def test_two_months_and_double_code_tables_in_one_folder(spark, scratch):
    import mini_fixture

    dump_dir = mini_fixture.write_dump(os.path.join(scratch, "dump_two"))
    mini_fixture.write_dump(dump_dir, month_tag="K3241.K03200Y0.D60820")
    with open(os.path.join(dump_dir, "G.MUNICCSV"), "wb") as f:
        f.write(b'"7107";"SAO PAULO OUTRA VEZ"\n')
    base = os.path.join(scratch, "base_two")
    out = load.load_dump(spark, dump_dir, base, text_index=False, validate=False, partitions=2)
    assert out["ano_mes"] == "202609" and out["contagens"]["estabelecimento"] == 5
    assert out["contagens"]["municipio"] == 4
    old = load.load_dump(spark, dump_dir, base, ano_mes="202608", text_index=False, validate=False, partitions=2)
    assert old["ano_mes"] == "202608" and old["contagens"]["estabelecimento"] == 5
    assert load.open_base(spark, base).ano_mes == "202609"
    reg = load.open_base(spark, base)
    assert search.search(reg, SearchSpec(limit=None)).count() == 5


def test_failed_checks_do_not_expire_the_last_good_month(spark, scratch, monkeypatch):
    import mini_fixture
    from pyspark.sql import functions as F

    from regframe.operators import quality

    base = os.path.join(scratch, "base_bad")
    good = mini_fixture.write_dump(os.path.join(scratch, "bad_sep"))
    load.load_dump(spark, good, base, text_index=False, partitions=2)
    bad = mini_fixture.write_dump(os.path.join(scratch, "bad_oct"), month_tag="K3241.K03200Y0.D61025")
    report = quality.report
    monkeypatch.setattr(quality, "report", lambda reg: report(reg).withColumn("ok", F.lit(False)))
    out = load.load_dump(spark, bad, base, text_index=False, partitions=2, keep_months=1)
    assert out["validacao_ok"] is False and out["expirados"] == []
    assert maintain.months(spark, base) == ["202610", "202609"]


def test_upgrade_rebuilds(spark, scratch, mini_base):
    """Rebuild derived artefacts on a loaded base (its own copy of the dump)."""
    import mini_fixture
    from regframe.sources import dims

    mcsv, ccsv = mini_base[2]
    dump_dir = mini_fixture.write_dump(os.path.join(scratch, "dump_upgrade"))
    base = os.path.join(scratch, "base_upgrade")
    first = load.load_dump(spark, dump_dir, base, text_index=False, partitions=2)
    assert "cnae_hierarquia" not in first["contagens"]  # loaded without dimensions
    out = load.upgrade(
        spark,
        base,
        municipio_ibge=dims.municipalities_from_csv(spark, mcsv),
        cnae_classes=dims.activity_classes_from_csv(spark, ccsv),
    )
    assert out["contagens"]["estabelecimento_cnae"] == 8
    assert out["contagens"]["cnae_hierarquia"] == 3
    assert set(out["reconstruidos"]) == {"estabelecimento_cnae", "municipio_ibge", "cnae_hierarquia"}
    assert out["validacao_ok"] is True


def test_export(spark, mini_reg, scratch):
    df = search.search(mini_reg, SearchSpec(uf="SP", limit=None))
    p = search.export(df, os.path.join(scratch, "exp", "busca.parquet"))
    assert spark.read.parquet(p).count() == 3
    c = search.export(df, os.path.join(scratch, "exp", "busca.csv"))
    assert spark.read.option("header", True).csv(c).count() == 3
    with pytest.raises(ValueError):
        search.export(df, os.path.join(scratch, "exp", "busca.xlsx"))
    assert df.select(F.col("cnpj")).count() == 3


def test_monthly_sync_keeps_newest(spark, scratch):
    """Two monthly dumps into one base: each month in its own directory, the
    newest is current, older ones beyond ``keep_months`` are expired."""
    import mini_fixture

    base = os.path.join(scratch, "base_sync")
    d1 = mini_fixture.write_dump(os.path.join(scratch, "sync_sep"))
    d2 = mini_fixture.write_dump(os.path.join(scratch, "sync_oct"), month_tag="K3241.K03200Y0.D61025")
    load.load_dump(spark, d1, base, text_index=False, validate=False, partitions=2, keep_months=2)
    out = load.load_dump(spark, d2, base, text_index=False, validate=False, partitions=2, keep_months=1)
    assert out["ano_mes"] == "202610" and out["referencia"] == "25/10/2026"
    assert maintain.months(spark, base) == ["202610"]
    assert out["expirados"] == [maintain.snapshot_path(base, "202609")]
    assert load.open_base(spark, base).ano_mes == "202610"


def test_key_list_of_several_files(spark, scratch):
    from regframe.sources import keylist

    d = os.path.join(scratch, "many-lists")
    os.makedirs(d)
    for name, n in (("a.csv", 3), ("b.csv", 4000), ("c.csv", 10)):  # the largest is not the first
        with open(os.path.join(d, name), "w") as f:
            f.write("nome;CNPJ\n" + "".join(f'"x;\ny";"{name[0]}{i}"\n' for i in range(n)))
    got = keylist.read_key_list(spark, d).orderBy("pos").collect()
    assert [r["entrada"] for r in got] == [f"{c}{i}" for c, n in (("a", 3), ("b", 4000), ("c", 10)) for i in range(n)]
    assert [r["pos"] for r in got] == list(range(4013))


def test_check_digit_service(spark):
    from regframe.functions import ids

    df = spark.createDataFrame([("12ABC34501DE",), ("12.ABC.345/01DE-36",), ("123",), (None,)], "k string")
    rows = [r["dv"] for r in ids.check_digit_service(df, "k").collect()]
    assert (rows[0]["dv_esperado"], rows[0]["cnpj"], rows[0]["dv_valido"]) == ("35", "12ABC34501DE35", None)
    assert (rows[1]["dv_valido"], rows[1]["dv_esperado"], rows[1]["alfanumerico"]) == (False, "35", True)
    assert rows[1]["cnpj_formatado"] == "12.ABC.345/01DE-36" and rows[1]["erro"] is None
    assert rows[2]["erro"] and rows[2]["cnpj"] is None and rows[3]["erro"]
