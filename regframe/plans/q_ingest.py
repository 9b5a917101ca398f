"""Queries of the load job, storage upkeep, key lists and other service operators.

The raw dump is written from the derived registry as the published files are: CP1252
text with quoted fields, a newline inside some, rows cut short where the last columns
are empty, several files per kind, two files of one code table. Every run uses a
folder of its own in the session's shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regframe.functions import ids
from regframe.functions.text import tokens, tokens_sql
from regframe.operators import adhoc, load, maintain
from regframe.operators import profile as P
from regframe.operators import search as S
from regframe.plans.catalog import query
from regframe.plans.oracle_registry import dv_sql
from regframe.plans.q_profile import establishments_sql
from regframe.plans.q_quality import REPORT_SQL
from regframe.schemas import CODE_TABLES
from regframe.session import checkpoint_dir, written
from regframe.sources import dims, dump, keylist, starmap

_TAG = "K03200Y0.D60925"
#: Columns of an establishment row that is cut short: what follows is empty.
_SHORT = 21
#: Bytes of a compacted file of the small test bases.
_FILE_BYTES = 4 << 20
#: Least size of the blocks that the raw files of the test dumps are cut into.
_BLOCK_BYTES = 256 << 10
#: Stored bytes of the establishments for each large raw file written of them.
_LARGE_BYTES = 32 << 20


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/regframe-runs/{name}-{uuid.uuid4().hex}"


def _put(df: DataFrame, folder: str, first: str, rest: str) -> None:
    """Write ``df`` as raw files ``<first><i>.<rest>`` of ``folder``, one per partition."""
    spark = df.sparkSession
    dump.enable_charsets(spark)
    parts = f"{folder}/_parts-{uuid.uuid4().hex}"
    out = df.write.option("sep", ";").option("quote", '"').option("escape", '"').option("encoding", dump.ENCODING)
    with maintain.sized_tasks(spark, [df]):
        out.option("header", False).csv(parts)
    fs, p = maintain._fs(spark, parts)
    names = sorted(str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    path = spark._jvm.org.apache.hadoop.fs.Path
    for i, name in enumerate(names):
        fs.rename(path(name), path(f"{folder}/{first}{i:05d}.{rest}"))


def _note(est: DataFrame) -> DataFrame:
    """A line break, a quote, a delimiter and accents inside a field of some rows."""
    text = F.concat(F.lit('SALA "é"; nº'), F.lit("\n"), F.col("numero"))
    return est.withColumn("complemento", F.when(F.col("numero").cast("int") % 7 == 0, text))


@query(
    "load_two_steps",
    """SELECT cnpj, uf, situacao_cadastral, nullif(data_inicio_atividades, '') AS data_inicio_atividades, nome_fantasia, cnae_fiscal_secundaria,
              if(CAST(numero AS INT) % 7 = 0, 'SALA "é"; nº' || chr(10) || numero, NULL) AS complemento,
              (SELECT any_value(descricao) FROM municipio WHERE codigo = estabelecimento.municipio) AS cidade,
              (SELECT any_value(razao_social) FROM empresas e WHERE e.cnpj_basico = estabelecimento.cnpj_basico) AS razao_social
       FROM estabelecimento""",
    own_base=True,
)
def load_two_steps(reg, spark, sf_dir):
    """A month is loaded from raw text; more files of it arrive and it is loaded again:
    the base then holds every establishment once, decoded by one code table."""
    folder, base = _folder(spark, "dump"), _folder(spark, "base")
    a = starmap.inputs(spark, sf_dir)
    raw = a["raw"]
    # derived once: three kinds of files are written of it
    with maintain.sized_tasks(spark, [raw["estabelecimento"]]):
        est = written(_note(raw["estabelecimento"]), "regframe-runs/establishments")
    first = F.col("uf") < "U2"
    _put(est.where(first), folder, "A", f"{_TAG}.ESTABELE")
    _put(raw["empresas"], folder, "A", f"{_TAG}.EMPRECSV")
    _put(raw["socios_original"], folder, "A", f"{_TAG}.SOCIOCSV")
    for table, suffix in (("cnae", "CNAECSV"), ("municipio", "MUNICCSV")):
        _put(a["codes"][table].coalesce(1), folder, "F", suffix)
        _put(a["codes"][table].coalesce(1), folder, "G", suffix)  # a second file of the table: not taken
    _put(est.limit(5), folder, "A", "K03200Y0.D60825.ESTABELE")  # another month: not taken
    load.load_dump(spark, folder, base, text_index=False, validate=False, block_bytes=_BLOCK_BYTES)
    late = est.where(~first)
    # large files (one, while they are few rows), which are cut into blocks inside their records
    files = max(1, maintain.input_bytes(est) // _LARGE_BYTES)
    _put(late.select(*late.columns[:_SHORT]).coalesce(files), folder, "B", f"{_TAG}.ESTABELE")
    load.load_dump(spark, folder, base, text_index=False, validate=False, block_bytes=_BLOCK_BYTES)
    got = load.open_base(spark, base)
    rows = got["estabelecimento"].join(got["empresas"].select("cnpj_basico", "razao_social"), "cnpj_basico", "left")
    cities = got["municipio"].select(F.col("codigo").alias("municipio"), F.col("descricao").alias("cidade"))
    return rows.join(cities, "municipio", "left").select(
        "cnpj", "uf", "situacao_cadastral", "data_inicio_atividades", "nome_fantasia", "cnae_fiscal_secundaria",
        "complemento", "cidade", "razao_social",
    )


@query("compact_reopen", "SELECT cnpj, uf, cnae_fiscal FROM estabelecimento")
def compact_reopen(reg, spark, sf_dir):
    """A base of many small files, compacted twice and opened again."""
    root = _folder(spark, "compact")
    maintain.write_version(reg["estabelecimento"].repartition(12), f"{root}/estabelecimento")
    maintain.write_version(reg["empresas"].repartition(12), f"{root}/empresas")
    for _ in range(2):
        maintain.compact_base(spark, root, file_bytes=_FILE_BYTES)
    return maintain.read_tables(spark, root)["estabelecimento"].select("cnpj", "uf", "cnae_fiscal")


@query("profile_compacted", establishments_sql("u.cnpj_basico IN ('00000001', '00000007')"))
def profile_compacted(reg, spark, sf_dir):
    """Profiles out of a base laid out by key range: each opens one file of the table."""
    root = _folder(spark, "ranges")
    names = ("estabelecimento", "empresas", "socios", "simples")
    for name in names:
        maintain.write_version(reg[name].repartition(8), f"{root}/{name}")
    maintain.commit_current(spark, root, list(names))
    maintain.compact_base(spark, root, target_files=6)
    tables = maintain.read_tables(spark, root)
    laid_out = reg.with_frames(**tables)
    laid_out.paths.update(maintain.table_paths(spark, root))
    parts = []
    for base in ("00000001", "00000007"):
        if len(laid_out.of_company("estabelecimento", base).inputFiles()) != 1:
            raise RuntimeError(f"the establishments of {base} lie in more than one file")
        parts.append(P.profile(laid_out, base).estabelecimentos)
    return parts[0].unionByName(parts[1])


@query("expire_keeps_complete", "SELECT cnpj, cnae, tipo FROM estabelecimento_cnae")
def expire_keeps_complete(reg, spark, sf_dir):
    """Retention beside an unfinished version: the last published one stays."""
    table = f"{_folder(spark, 'expire')}/estabelecimento_cnae"
    maintain.write_version(reg["estabelecimento_cnae"].limit(0), table)
    maintain.write_version(reg["estabelecimento_cnae"], table)
    maintain.write_version(reg["estabelecimento_cnae"].limit(0), table, visible=False)
    maintain.expire_versions(spark, table, keep=1)
    return maintain.read_current(spark, table)


@query("reload_month", "SELECT cnpj_basico, razao_social, capital_social FROM empresas", own_base=True)
def reload_month(reg, spark, sf_dir):
    """A month of which one file was replaced by another of the same name is loaded anew."""
    folder, base = _folder(spark, "dump"), _folder(spark, "base")
    raw = starmap.inputs(spark, sf_dir)["raw"]
    firms = raw["empresas"]
    _put(raw["estabelecimento"], folder, "A", f"{_TAG}.ESTABELE")
    _put(raw["socios_original"], folder, "A", f"{_TAG}.SOCIOCSV")
    _put(firms, folder, "A", f"{_TAG}.EMPRECSV")
    # the first file, one partition of the companies, holds other names until the reload
    first, aside = f"A00000.{_TAG}.EMPRECSV", _folder(spark, "aside")
    fs, side = maintain._fs(spark, aside)
    fs.mkdirs(side)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.rename(path(f"{folder}/{first}"), path(f"{aside}/{first}"))
    read = spark.read.option("sep", ";").option("quote", '"').option("escape", '"').option("encoding", dump.ENCODING)
    kept = read.option("multiLine", True).option("header", False).schema(firms.schema).csv(f"{aside}/{first}")
    _put(kept.withColumn("razao_social", F.lit("ANTES")), folder, "A", f"{_TAG}.EMPRECSV")
    load.load_dump(spark, folder, base, text_index=False, validate=False)
    maintain.delete(spark, f"{folder}/{first}")
    _put(kept, folder, "A", f"{_TAG}.EMPRECSV")
    load.load_dump(spark, folder, base, text_index=False, validate=False)
    return load.open_base(spark, base)["empresas"].select("cnpj_basico", "razao_social", "capital_social")


def _dump_of(spark, sf_dir, folder: str, *, firms: DataFrame | None = None, est: DataFrame | None = None, partners: bool = True) -> None:
    """A raw dump of the derived registry, or of the given frames, in ``folder``."""
    a = starmap.inputs(spark, sf_dir)
    raw = a["raw"]
    _put(raw["estabelecimento"] if est is None else est, folder, "A", f"{_TAG}.ESTABELE")
    _put(raw["empresas"] if firms is None else firms, folder, "A", f"{_TAG}.EMPRECSV")
    if partners:
        _put(raw["socios_original"], folder, "A", f"{_TAG}.SOCIOCSV")
    _put(a["codes"]["cnae"].coalesce(1), folder, "F", "CNAECSV")


@query(
    "reload_failed_keeps_month",
    """SELECT u.cnpj, u.uf, e.razao_social, (SELECT count(*) FROM estabelecimento_cnae b WHERE b.cnpj = u.cnpj) AS atividades
       FROM estabelecimento u JOIN empresas e USING (cnpj_basico)""",
    own_base=True,
)
def reload_failed_keeps_month(reg, spark, sf_dir):
    """A reload that stops after some tables of the month were written: readers still see
    the old month whole, and a compaction in between does not mix the two."""
    base, first, second = (_folder(spark, n) for n in ("base", "dump", "dump"))
    _dump_of(spark, sf_dir, first)
    load.load_dump(spark, first, base, text_index=False, validate=False)
    maintain.delete(spark, first)  # raw files may go once they are loaded
    a = starmap.inputs(spark, sf_dir)
    raw = a["raw"]
    _dump_of(
        spark, sf_dir, second, firms=raw["empresas"].withColumn("razao_social", F.lit("DEPOIS")),
        est=raw["estabelecimento"].where("uf < 'U2'"),
    )
    # the hierarchy, one of the last tables, cannot be derived of classes without a section
    broken = a["cnae_classes"].drop("secao")
    month = maintain.snapshot_path(base, maintain.current_month(spark, base))
    before = maintain.snapshot(spark, month)
    try:
        load.load_dump(spark, second, base, cnae_classes=broken, text_index=False, validate=False)
    except Exception as stopped:  # the reload must fail, and only here
        if "secao" not in str(stopped):
            raise
    maintain.delete(spark, second)
    if len(maintain.published(spark, f"{month}/estabelecimento")) < 2:
        raise RuntimeError("the reload stopped before it had written a table")
    if maintain.snapshot(spark, month) != before:
        raise RuntimeError("a reload that failed switched the month")
    maintain.compact_base(spark, month, file_bytes=_FILE_BYTES)
    got = load.open_base(spark, base)
    n = got["estabelecimento_cnae"].groupBy("cnpj").agg(F.count("*").alias("atividades"))
    rows = got["estabelecimento"].join(got["empresas"], "cnpj_basico").join(n, "cnpj", "left")
    return rows.select("cnpj", "uf", "razao_social", F.coalesce("atividades", F.lit(0)).alias("atividades"))


@query(
    "upgrade_dimensions",
    """SELECT u.cnpj, u.cnae_fiscal, h.secao, h.divisao, (SELECT count(*) FROM estabelecimento_cnae b WHERE b.cnpj = u.cnpj) AS atividades
       FROM estabelecimento u LEFT JOIN cnae_hierarquia h ON h.cnae = u.cnae_fiscal""",
    own_base=True,
)
def upgrade_dimensions(reg, spark, sf_dir):
    """A base loaded without dimensions gets the activity hierarchy and a new bridge by an
    upgrade; no other table is written again."""
    base, folder = _folder(spark, "base"), _folder(spark, "dump")
    _dump_of(spark, sf_dir, folder)
    load.load_dump(spark, folder, base, text_index=False, validate=False)
    month = maintain.snapshot_path(base, maintain.current_month(spark, base))
    before = maintain.snapshot(spark, month)
    classes = starmap.inputs(spark, sf_dir)["cnae_classes"]
    done = load.upgrade(spark, base, cnae_classes=classes, text_index=False, validate=False)["reconstruidos"]
    after = maintain.snapshot(spark, month)
    kept = {k for k in before if not k.startswith("_") and after[k] == before[k]}
    if kept != {k for k in before if not k.startswith("_")} - set(done):
        raise RuntimeError(f"an upgrade of {done} changed other tables")
    got = load.open_base(spark, base)
    h = got["cnae_hierarquia"].select(F.col("cnae").alias("cnae_fiscal"), "secao", "divisao")
    n = got["estabelecimento_cnae"].groupBy("cnpj").agg(F.count("*").alias("atividades"))
    rows = got["estabelecimento"].join(h, "cnae_fiscal", "left").join(n, "cnpj", "left")
    return rows.select("cnpj", "cnae_fiscal", "secao", "divisao", F.coalesce("atividades", F.lit(0)).alias("atividades"))


@query(
    "load_without_simples",
    "SELECT cnpj, opcao_simples, opcao_mei FROM estabelecimento CROSS JOIN (SELECT NULL AS opcao_simples, NULL AS opcao_mei)",
    own_base=True,
)
def load_without_simples(reg, spark, sf_dir):
    """A dump without the optional simples files loads all the same: no company has a flag."""
    base, folder = _folder(spark, "base"), _folder(spark, "dump")
    _dump_of(spark, sf_dir, folder)
    load.load_dump(spark, folder, base, text_index=False, validate=False)
    got = load.open_base(spark, base)
    flags = got["simples"].select("cnpj_basico", "opcao_simples", "opcao_mei")
    return got["estabelecimento"].join(flags, "cnpj_basico", "left").select("cnpj", "opcao_simples", "opcao_mei")


@query("load_validated", "SELECT * EXCLUDE (ordem) FROM (" + REPORT_SQL + ")", own_base=True)
def load_validated(reg, spark, sf_dir):
    """The report that a load with validation keeps beside its tables."""
    base, folder = _folder(spark, "base"), _folder(spark, "dump")
    a = starmap.inputs(spark, sf_dir)
    _dump_of(spark, sf_dir, folder)
    suffixes = {table: suffix.lstrip(".") for suffix, table in CODE_TABLES}
    for table, df in a["codes"].items():
        if table != "cnae" and df is not None:
            _put(df.coalesce(1), folder, "F", suffixes[table])
    load.load_dump(spark, folder, base, municipio_ibge=a["municipio_ibge"], cnae_classes=a["cnae_classes"], text_index=False)
    month = maintain.snapshot_path(base, maintain.current_month(spark, base))
    return maintain.read_version(spark, f"{month}/_validacao", maintain.table_path(spark, month, "_validacao"))


@query("dims_csv", "SELECT * FROM municipio_ibge")
def dims_csv(reg, spark, sf_dir):
    """The municipality dimension as the CSV file that bases are given, read back."""
    folder = _folder(spark, "dims")
    reg["municipio_ibge"].withColumn("capital", F.col("capital").cast("int")).write.option("header", True).csv(folder)
    return dims.municipalities_from_csv(spark, folder).select(*reg["municipio_ibge"].columns)


_LITERALS = (
    "SELECT uf, 'a /* b */ c' AS t1, 'x -- y' AS t2, 'drop; it''s' AS t3, count(*) AS n "
    "FROM estabelecimento /* it's a comment */ GROUP BY uf -- the end"
)


@query(
    "adhoc_literals",
    """SELECT uf, 'a /* b */ c' AS t1, 'x -- y' AS t2, 'drop; it''s' AS t3, count(*) AS n FROM estabelecimento GROUP BY uf""",
)
def adhoc_literals(reg, spark, sf_dir):
    """Comment marks, semicolons and keywords inside literals are text."""
    reg.register_views()
    return adhoc.run_sql(spark, _LITERALS, limit=None)


_LETTERS = " Ũẽĩỹơĉŝŭ øđßæ ÀÇÉñ İı ǅ é ﬁ"


@query(
    "bm25_accents",
    f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS terms
        FROM (SELECT doc_id, {tokens_sql("coalesce(text, '') || '" + _LETTERS + "'")} AS t FROM documents)""",
)
def bm25_accents(reg, spark, sf_dir):
    """Index terms of every document and of letters with all kinds of accents."""
    docs = starmap.read_table(spark, sf_dir, "documents")
    t = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(_LETTERS)).alias("t"))
    return t.select("doc_id", tokens("t").alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("terms")
    )


@query(
    "profile_mixed_keys",
    establishments_sql("u.uf = 'U1' OR u.cnpj_basico IN (SELECT cnpj_basico FROM empresas WHERE porte_empresa = '03')"),
)
def profile_mixed_keys(reg, spark, sf_dir):
    """Bulk profile over full keys and base keys, many establishments named by both."""
    full = reg["estabelecimento"].where("uf = 'U1'").select(F.col("cnpj").alias("chave"))
    base = reg["empresas"].where("porte_empresa = '03'").select(F.col("cnpj_basico").alias("chave"))
    return P.profiles(reg, full.unionByName(base))["estabelecimentos"]


@query(
    "key_list_order",
    """SELECT row_number() OVER (ORDER BY cnpj) - 1 AS pos,
              if(CAST(numero AS INT) % 5 = 0, cnpj || chr(10) || 'x', cnpj) AS entrada FROM estabelecimento""",
)
def key_list_order(reg, spark, sf_dir):
    """A key list in several files of unequal size, with line breaks inside fields."""
    folder = _folder(spark, "keys")
    est = reg["estabelecimento"]
    text = F.when(F.col("numero").cast("int") % 5 == 0, F.concat("cnpj", F.lit("\nx"))).otherwise(F.col("cnpj"))
    rows = est.select("cnpj", F.col("uf").alias("nome"), text.alias("CNPJ_lista")).orderBy("cnpj")
    out = rows.select("nome", "CNPJ_lista").write.option("header", True).option("sep", ";").option("escape", '"')
    out.csv(folder)
    return keylist.read_key_list(spark, folder)


_DV_IN = """SELECT cnpj, CASE CAST(numero AS INT) % 4 WHEN 0 THEN cnpj[1:12] WHEN 1 THEN lower(cnpj) WHEN 2 THEN cnpj[1:7]
  ELSE cnpj[1:8] || '/' || cnpj[9:12] || '-' || cnpj[13:14] END AS entrada FROM estabelecimento"""


@query(
    "dv_service",
    f"""SELECT cnpj AS chave, entrada, base, base || coalesce(dado, digitos) AS cnpj,
          regexp_replace(base || coalesce(dado, digitos), '^(..)(...)(...)(....)(..)$', '\\1.\\2.\\3/\\4-\\5') AS cnpj_formatado,
          digitos AS dv_esperado, dado = digitos AS dv_valido,
          regexp_matches(base || coalesce(dado, digitos), '[A-Z]') AS alfanumerico,
          if(base IS NULL, 'Informe 12 (base) ou 14 posições.', NULL) AS erro
        FROM (SELECT *, {dv_sql('base')} AS digitos FROM (
          SELECT *, if(length(limpa) IN (12, 14), limpa[1:12], NULL) AS base, nullif(limpa[13:14], '') AS dado
          FROM (SELECT *, regexp_replace(upper(entrada), '[^0-9A-Z]', '', 'g') AS limpa FROM ({_DV_IN}))))""",
)
def dv_service(reg, spark, sf_dir):
    """Check digits of bases and full keys, computed or checked, in bulk."""
    n = F.col("numero").cast("int") % 4
    dashed = F.concat(F.substring("cnpj", 1, 8), F.lit("/"), F.substring("cnpj", 9, 4), F.lit("-"), F.substring("cnpj", 13, 2))
    entry = F.when(n == 0, F.substring("cnpj", 1, 12)).when(n == 1, F.lower("cnpj")).when(n == 2, F.substring("cnpj", 1, 7))
    rows = reg["estabelecimento"].select(F.col("cnpj").alias("chave"), entry.otherwise(dashed).alias("entrada"))
    return ids.check_digit_service(rows, "entrada").select("chave", "entrada", "dv.*")


@query(
    "export_json",
    """SELECT u.cnpj, u.nome_fantasia, e.capital_social FROM estabelecimento u JOIN empresas e USING (cnpj_basico)
       WHERE u.situacao_cadastral = '08'""",
)
def export_json(reg, spark, sf_dir):
    """Unlimited filtered search written as JSON lines (NULLs included) and read back."""
    out = S.search(reg, S.SearchSpec(situacao="08", limit=None)).select("cnpj", "nome_fantasia", "capital_social")
    path = S.export(out, f"{_folder(spark, 'export')}.json")
    return spark.read.schema(out.schema).json(path)
