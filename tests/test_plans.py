"""Physical-plan properties that matter at scale (read from the plan text)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mini_fixture import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_enrichment_broadcasts_a_small_list(spark):
    from regframe.operators import enrich
    from regframe.plans import catalog

    reg = catalog.registry(spark, SF_SMALL)
    ent = enrich.entries_from_list(spark, ["00000001", "not a key"])
    out = enrich.enrich(reg, ent)
    out.collect()
    plan = _plan(out).split("== Initial Plan ==")[0]
    # from the sizes met at run time the registry tables are filtered map-side by the
    # list: their semi joins are broadcast joins, so no big table is shuffled
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi), semi


def test_enrichment_scans_each_table_once(spark):
    """One scan of each big table; six hash exchanges with a short list, ten with one that
    is too large to broadcast."""
    from regframe.operators import enrich
    from regframe.plans import catalog

    reg = catalog.registry(spark, SF_SMALL)
    ent = enrich.entries_from_list(spark, ["00000001", "not a key", "00.000.001/0001-36"])
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    for threshold, most in ((before, 6), ("-1", 10)):
        spark.conf.set(key, threshold)
        try:
            plan = _plan(enrich.enrich(reg, ent))
        finally:
            spark.conf.set(key, before)
        for column in ("nome_fantasia", "razao_social", "opcao_mei"):  # one of each big table
            scans = [line for line in plan.splitlines() if "FileScan" in line and column in line.split("Batched")[0]]
            assert len(scans) == 1, (column, scans)
        joins = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(joins) <= most, (threshold, len(joins))


def test_index_tokenises_each_text_once(spark):
    from regframe.operators import textsearch

    docs = spark.createDataFrame([(1, "Olá mundo mundo"), (2, "")], "doc_id long, text string")
    plan = _plan(textsearch.build_index(docs, "doc_id", "text").postings)
    assert plan.count("regexp_replace(translate(lower(") == 1
    # the generator keeps only the key and the length from its input row
    gen = [line for line in plan.splitlines() if "Generate" in line][0]
    assert "_t#" not in gen.split("],")[1]


def test_index_counts(spark):
    from regframe.operators import textsearch

    docs = spark.createDataFrame(
        [(1, "Olá mundo mundo"), (2, ""), (3, "mundo 42")], "doc_id long, text string"
    )
    idx = textsearch.build_index(docs, "doc_id", "text")
    rows = {(r["term"], r["doc_id"]): (r["tf"], r["len"]) for r in idx.postings.collect()}
    assert rows == {("ola", 1): (1, 3), ("mundo", 1): (2, 3), ("mundo", 3): (1, 1)}
    st = idx.stats.first()
    assert st["n_docs"] == 3 and abs(st["avgdl"] - 4 / 3) < 1e-12


def test_search_predicates_reach_the_scan(spark):
    from regframe.operators import search
    from regframe.plans import catalog

    reg = catalog.registry(spark, SF_SMALL)
    # unlimited (the bounded path would run the scan inside its checkpoint)
    df = search.search(reg, search.SearchSpec(uf="u1", situacao="02", limit=None))
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(uf), IsNotNull(situacao_cadastral), EqualTo(uf,U1)" in plan or (
        "EqualTo(uf,U1)" in plan and "EqualTo(situacao_cadastral,02)" in plan
    )


def test_aggregates_are_partial_before_the_shuffle(spark):
    from regframe.operators import analytics
    from regframe.plans import catalog

    reg = catalog.registry(spark, SF_SMALL)
    plan = _plan(analytics.by_state(reg))
    assert "partial_count" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_fuzzy_udf_runs_on_distinct_names(spark):
    from regframe.operators import textsearch

    names = spark.createDataFrame([("ACME LTDA",)] * 50 + [("ACME LTD",), (None,)], "n string")
    hits = textsearch.fuzzy_name_hits(names, "n", "acme ltda")
    plan = _plan(hits)
    # the aggregate (distinct) sits below the Python evaluation
    assert plan.index("ArrowEvalPython") < plan.index("HashAggregate")
    assert sorted(r["_nm"] for r in hits.collect()) == ["acme ltd", "acme ltda"]


def test_partner_search_joins_only_the_top_partners(spark):
    from regframe.operators import profile
    from regframe.plans import catalog

    reg = catalog.registry(spark, SF_SMALL)
    plan = _plan(profile.partner_search(reg, nome="socio", limit=50))
    assert "SortMergeJoin" not in plan
    # the top partners are computed once (checkpointed); only the result is cut here
    assert plan.count("TakeOrderedAndProject") == 1
    assert "socios" not in plan


def _jobs(spark, make):
    """``make()`` and how many jobs ran meanwhile."""
    group = "plan-test"
    spark.sparkContext.setJobGroup(group, group)
    out = make()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def test_planning_runs_nothing_but_lists_of_names_and_keys(spark):
    from regframe.operators import enrich, search
    from regframe.plans import catalog

    reg = catalog.registry(spark, SF_SMALL)
    reg.dim("municipio")  # the dimensions' row bounds are checked once, on first use
    specs = (
        search.SearchSpec(uf="u1", limit=20),
        search.SearchSpec(q="ring", modo="substring", limit=20),
        search.SearchSpec(mei=True, municipio_nome="nation_1", limit=20),
    )
    for spec in specs:
        assert _jobs(spark, lambda s=spec: search.search(reg, s))[1] == 0, spec
    keys = reg["estabelecimento"].select(F.monotonically_increasing_id().alias("pos"), F.col("cnpj").alias("entrada"))
    # the resolved list and the names that are alike are written once, before the plan
    fuzzy = search.SearchSpec(q="blue bolts", fuzzy=True, uf="u1", limit=20)
    for build in (lambda: enrich.enrich(reg, keys), lambda: search.search(reg, fuzzy)):
        assert 0 < _jobs(spark, build)[1] <= 6


def test_limited_search_fetches_only_its_keys(spark):
    from pyspark.sql import functions as F

    from regframe.operators import search
    from regframe.plans import catalog

    reg = catalog.registry(spark, SF_SMALL)
    plan = _plan(search.search(reg, search.SearchSpec(uf="u1", limit=20)))
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan
    # an establishment whose company is missing does not take a place of the limit
    first = reg["estabelecimento"].orderBy("cnpj").first()["cnpj_basico"]
    reg2 = reg.with_frames(empresas=reg["empresas"].where(F.col("cnpj_basico") != first))
    got = [r["cnpj"] for r in search.search(reg2, search.SearchSpec(limit=5)).collect()]
    want = [
        r["cnpj"]
        for r in reg2["estabelecimento"]
        .join(reg2["empresas"], "cnpj_basico")
        .orderBy("cnpj")
        .limit(5)
        .collect()
    ]
    assert got == want and len(got) == 5


def test_ranked_search_bounded_path_is_exact(spark):
    from regframe.operators import search, textsearch
    from regframe.plans import catalog

    reg = catalog.registry(spark, SF_SMALL)
    idx = textsearch.build_index(reg["empresas"], "cnpj_basico", "razao_social")
    q = "red widget automobile"
    for n in (1, 7, 40):
        got = search.search(reg, search.SearchSpec(q=q, limit=n), index=idx).collect()
        full = search.search(reg, search.SearchSpec(q=q, limit=None), index=idx).limit(n).collect()
        assert [(r["cnpj"], round(r["_fts_score"], 9)) for r in got] == [
            (r["cnpj"], round(r["_fts_score"], 9)) for r in full
        ]


def test_dimensions_broadcast_only_within_the_checked_bound(spark):
    from regframe.bundle import DIMENSION_ROW_BOUND, Registry

    small = spark.range(10).selectExpr("CAST(id AS STRING) AS codigo", "'x' AS descricao")
    big = spark.range(DIMENSION_ROW_BOUND + 1).selectExpr("CAST(id AS STRING) AS codigo", "'x' AS descricao")
    reg = Registry({"estabelecimento": small, "cnae": small, "municipio": big})

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()

    assert hinted(reg.dim("cnae"))
    assert not hinted(reg.dim("municipio"))
    assert set(reg._dims) == {"cnae", "municipio"}  # both checked by the first call


def test_partners_cross_the_network_twice_unsorted(spark, scratch):
    """The partners are shuffled by document and by company, and written from there: no third
    shuffle to cluster them, no sort of a join, whether or not the map could be broadcast."""
    from regframe.operators import maintain, model
    from regframe.schemas import PARTNER_COLUMNS, PARTNER_RULE_MONTH

    raw = spark.createDataFrame(
        [(f"{i % 7:08d}", "1" if i % 3 else "2", f"S{i}", f"{i % 9:08d}", *[None] * 7) for i in range(60)],
        ", ".join(f"{c} string" for c in PARTNER_COLUMNS),
    )
    heads = spark.createDataFrame([(f"{i:08d}", f"{i:08d}000100") for i in range(5)], "cnpj_basico string, cnpj string")
    out = model.partners(raw, heads, PARTNER_RULE_MONTH)
    plan = _plan(out)
    assert plan.count("ShuffledHashJoin") == 2 and plan.count("Exchange hashpartitioning") == 4, plan
    assert "Sort" not in plan.replace("SortOrder", "") and "Broadcast" not in plan, plan
    table = f"{scratch}/clustered/socios"
    maintain.write_version(out, table, key="cnpj_basico", clustered=True)
    got = maintain.read_current(spark, table)
    assert sorted(map(str, got.collect())) == sorted(map(str, out.collect())) and got.count() == 60
    files = [sorted({r["cnpj_basico"] for r in spark.read.parquet(f).collect()}) for f in got.inputFiles()]
    assert sum(map(len, files)) == 7  # a company lies in one file


def test_files_of_a_given_number_stay_bounded(spark, scratch, monkeypatch):
    """A base compacted into few files gets more where one task would sort too many bytes."""
    from regframe.operators import maintain

    root = f"{scratch}/bounded"
    rows = spark.range(3000).select(F.format_string("%08d", "id").alias("cnpj_basico"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    maintain.write_version(rows, f"{root}/empresas")
    maintain.compact_base(spark, root, target_files=2)
    assert len(maintain.read_current(spark, f"{root}/empresas").inputFiles()) == 2
    monkeypatch.setattr(maintain, "SORT_BYTES", 20_000)
    maintain.compact_base(spark, root, target_files=2)
    got = maintain.read_current(spark, f"{root}/empresas")
    assert len(got.inputFiles()) > 5 and got.count() == 3000
