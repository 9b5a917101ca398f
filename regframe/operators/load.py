"""The load job: raw monthly dump -> landed Parquet -> derived model -> checks.

Every step is idempotent and resumable:
  1. landing (Structured Streaming, availableNow + checkpoint) skips files
     already committed, lands new ones, and starts again when a landed file
     changed or ``resume=False`` (what was landed before then goes);
  2. each table is published with a fingerprint of what it was built from (the
     landed files and the dimensions); it is rebuilt when that changed and
     reused when not;
  3. the text index, the metadata table and the quality report are published
     anew each run;
  4. one snapshot makes all these versions the month. Until then readers see the
     month as it was: a run that stops anywhere before leaves it whole.
Each month lives in ``<base>/ano_mes=<YYYYMM>``; the newest complete month is
current and older ones beyond ``keep_months`` are expired, but only after the
checks passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regframe.bundle import Registry
from regframe.operators import maintain, model, quality, textsearch
from regframe.schemas import CODE_TABLES, RAW_KINDS
from regframe.sources import dump
from regframe.streaming import landing


def _landed(spark, raw_root, kind) -> DataFrame | None:
    df = landing.read_landed(spark, raw_root, kind)
    return None if df is None else df.drop("_arquivo")


def load_dump(
    spark: SparkSession,
    dump_dir: str,
    base_root: str,
    *,
    ano_mes: str | None = None,
    resume: bool = True,
    municipio_ibge: DataFrame | None = None,
    cnae_classes: DataFrame | None = None,
    keep_months: int = 2,
    text_index: bool = True,
    validate: bool = True,
    partitions: int | None = None,
    block_bytes: int | None = None,
) -> dict:
    """Load one monthly dump into ``base_root``; returns a small summary.

    A folder may hold files of several months: ``ano_mes`` (default: the newest
    there) is loaded, files of other months are left alone. ``resume=False``
    replaces a month: everything is landed and derived again.
    """
    data_ref, ano_mes = dump.detect_reference(dump.list_files(spark, dump_dir), ano_mes)
    snap = maintain.snapshot_path(base_root, ano_mes)
    raw_root, batches = landing.land(spark, dump_dir, f"{snap}/_raw", ano_mes=ano_mes, resume=resume, block_bytes=block_bytes)
    landing.expire_generations(spark, raw_root)

    raw = {k: _landed(spark, raw_root, k) for k in RAW_KINDS}
    if raw["empresas"] is None or raw["estabelecimento"] is None:
        raise FileNotFoundError(f"company or establishment files missing in {dump_dir}")
    if raw["socios_original"] is None:
        held = maintain.table_path(spark, snap, "socios")
        if held is None:
            raise RuntimeError("neither raw nor resolved partners are available; reload without resume")
        raw["socios"] = maintain.read_version(spark, f"{snap}/socios", held)  # resume: already resolved
    codes = {t: _landed(spark, raw_root, t) for _, t in CODE_TABLES}
    inputs = maintain.fingerprint(
        raw_root,
        maintain.get_text(spark, f"{raw_root}/_MANIFEST"),
        maintain.content_stamp(municipio_ibge),
        maintain.content_stamp(cnae_classes),
    )
    reg = maintain.materialize_model(
        raw,
        codes,
        snap,
        ano_mes=ano_mes,
        data_ref=data_ref,
        municipio_ibge=municipio_ibge,
        cnae_classes=cnae_classes,
        partitions=partitions,
        inputs=inputs,
        switch=False,
    )
    return finish(spark, reg, snap, base_root, batches=batches, keep_months=keep_months,
                  text_index=text_index, validate=validate)


def finish(
    spark: SparkSession,
    reg: Registry,
    snap: str,
    base_root: str,
    *,
    batches: dict | None = None,
    keep_months: int = 2,
    text_index: bool = True,
    validate: bool = True,
    changed: list[str] | None = None,
) -> dict:
    """Index, metadata and report of the tables ``reg`` reads, then the switch of the month
    to them (``changed``: only these tables are new; default: all)."""
    fts_ok = False
    if text_index:
        idx = textsearch.build_index(reg["empresas"], "cnpj_basico", "razao_social")
        idx.write_version(f"{snap}/_fts")
        fts_ok = True
    maintain.write_version(model.reference_meta(reg, text_index=fts_ok).coalesce(1), f"{snap}/_referencia")
    ok = None
    if validate:
        maintain.write_version(quality.report(reg).drop("ordem").coalesce(1), f"{snap}/_validacao")
        ok = bool(quality.overall_ok(maintain.read_current(spark, f"{snap}/_validacao")).first()["ok"])
    internal = ["_referencia", *(["_fts"] if text_index else []), *(["_validacao"] if validate else [])]
    tables = [k for k, v in reg.frames.items() if v is not None and not k.startswith("_")] if changed is None else changed
    maintain.complete(spark, snap, tables + internal)
    # an older month is the way back if this one failed its checks
    expired = [] if ok is False else maintain.expire_months(spark, base_root, keep=keep_months)
    counts = {
        r["tabela"]: r["linhas"]
        for r in maintain.table_counts(
            {k: v for k, v in reg.frames.items() if v is not None and not k.startswith("_")}
        ).collect()
    }  # one row per table
    return {
        "ano_mes": reg.ano_mes,
        "referencia": reg.data_ref,
        "lotes": batches or {},
        "contagens": counts,
        "validacao_ok": ok,
        "fts": fts_ok,
        "expirados": expired,
    }


def open_base(spark: SparkSession, base_root: str, ano_mes: str | None = None) -> Registry:
    """The loaded registry of a month (default: newest), with its metadata."""
    reg = maintain.open_snapshot(spark, base_root, ano_mes)
    ref = reg.get("_referencia")
    if ref is not None:
        meta = {r["referencia"]: r["valor"] for r in ref.collect()}  # five rows
        reg.data_ref = meta.get("CNPJ", reg.data_ref)
    for internal in [k for k in reg.frames if k.startswith("_")]:
        reg.frames.pop(internal, None)  # metadata and reports are rewritten by each run
    return reg


def text_index(spark: SparkSession, base_root: str, ano_mes: str | None = None) -> textsearch.BM25Index | None:
    m = ano_mes or maintain.current_month(spark, base_root)
    path = maintain.table_path(spark, maintain.snapshot_path(base_root, m), "_fts")
    return None if path is None else textsearch.BM25Index.read(spark, path, "cnpj_basico")


def upgrade(
    spark: SparkSession,
    base_root: str,
    *,
    ano_mes: str | None = None,
    bridge: bool = True,
    municipio_ibge: DataFrame | None = None,
    cnae_classes: DataFrame | None = None,
    text_index: bool = True,
    validate: bool = True,
) -> dict:
    """Rebuild derived artefacts of a loaded month: each becomes a new version, and the
    month is switched to all of them at once when they are whole."""
    reg = open_base(spark, base_root, ano_mes)
    snap = maintain.snapshot_path(base_root, reg.ano_mes)
    done = []
    if bridge:
        tmp = model.activity_bridge(reg["estabelecimento"])
        maintain.write_table(tmp, f"{snap}/estabelecimento_cnae", key="cnae")
        done.append("estabelecimento_cnae")
    if municipio_ibge is not None:
        maintain.write_table(municipio_ibge, f"{snap}/municipio_ibge")
        done.append("municipio_ibge")
    if cnae_classes is not None:
        h = model.activity_hierarchy(reg["cnae"], cnae_classes)
        maintain.write_table(h, f"{snap}/cnae_hierarquia")
        done.append("cnae_hierarquia")
    reg = reg.with_frames(**{name: maintain.read_current(spark, f"{snap}/{name}") for name in done})
    out = finish(spark, reg, snap, base_root, keep_months=10**6, text_index=text_index, validate=validate, changed=done)
    out["reconstruidos"] = done
    return out
