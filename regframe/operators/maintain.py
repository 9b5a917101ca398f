"""Storage upkeep: materialise the model, count tables, compact, keep snapshots.

Layout on shared storage (HDFS/object store/local for tests)::

    <root>/ano_mes=<YYYYMM>/<table>/v=<n>/          one directory per table version
    <root>/ano_mes=<YYYYMM>/<table>/v=<n>/_SUCCESS  present when the version is published
    <root>/ano_mes=<YYYYMM>/<table>/v=<n>/_INPUTS   what the version was built from
    <root>/ano_mes=<YYYYMM>/_snapshots/<n>.json     which version of each table is the month
    <root>/ano_mes=<YYYYMM>/_MODEL_COMPLETE         present when the month may be used

Nothing in use is ever overwritten: a rebuild or a compaction writes the next
version beside the current one, and publishing it (one marker) makes it complete. A
month is switched as a whole: a load, an upgrade or a compaction writes its versions
first and then one snapshot, a small file that is renamed into place and names one
version of every table. Readers of a month resolve all tables through the newest
snapshot, so they see the old month whole or the new one whole, whatever run failed
in between. A single table outside a month is read at its newest published version.
A table is rebuilt when its inputs changed and reused when they did not.

Fact tables are clustered on ``cnpj_basico`` with a skew-splitting rebalance
and sorted within files by it (row-group min/max prune point lookups); the
activity bridge is sorted by code.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regframe.bundle import Registry

# table -> (partition/sort column) layout when written
LAYOUT = {
    "empresas": "cnpj_basico",
    "estabelecimento": "cnpj_basico",
    "socios": "cnpj_basico",
    "simples": "cnpj_basico",
    "cnpj_base2matriz": "cnpj_basico",
    "estabelecimento_cnae": "cnae",
}


#: Tables whose derivation ends in a shuffle by their key: they are written as it leaves them.
CLUSTERED = frozenset({"socios"})

#: Shuffled bytes that one task of a table's build reads, and input bytes for every shuffle
#: partition. Rows that are sorted take some ten times their shuffled bytes in memory.
TASK_BYTES = 16 << 20
SPLIT_BYTES = 2 << 20
MOST_PARTITIONS = 10_000

#: Bytecode of one method beyond which the JVM does not compile it (it is interpreted then).
METHOD_BYTES = 8000

#: Columns that cut a key with very many rows when a table is laid out by range.
TIES = ("cnpj", "cnpj_cpf_socio", "nome_socio")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty marker file (overwritten when present)."""
    fs, p = _fs(spark, path)
    fs.create(p, True).close()


def count_files(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    it = fs.listFiles(p, True)
    n = 0
    while it.hasNext():
        name = it.next().getPath().getName()
        if not name.startswith(("_", ".")):
            n += 1
    return n


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads (metadata only)."""
    spark = df.sparkSession
    return sum(fs.getFileStatus(p).getLen() for fs, p in (_fs(spark, f) for f in df.inputFiles()))


@contextlib.contextmanager
def sized_tasks(spark: SparkSession, frames: list[DataFrame]):
    """While it lasts, shuffles are cut so fine that a task sorts its share in memory: into
    partitions by the bytes that the largest of ``frames`` is read from (the session's
    number if that is more), of which AQE puts some ``TASK_BYTES`` together again. A stage
    of many long expressions runs as several methods, not as one that is never compiled.
    Shuffle files of what was written before it are let go first, its own at its end."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    advised, first = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    release_shuffles(spark)
    method = "spark.sql.codegen.hugeMethodLimit"
    before = {k: spark.conf.get(k, None) for k in (advised, first, method)}
    wanted = min(max((input_bytes(df) for df in frames), default=0) // SPLIT_BYTES, MOST_PARTITIONS)
    spark.conf.set(advised, str(min(size(spark.conf.get(advised)), TASK_BYTES)))
    spark.conf.set(first, str(max(int(before[first] or spark.conf.get("spark.sql.shuffle.partitions")), wanted)))
    spark.conf.set(method, str(METHOD_BYTES))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        release_shuffles(spark)


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished writes removed now. Spark removes those that the
    driver's garbage collector finds unreferenced; a driver that has little to collect
    would leave every shuffle of a load on the disks until its end."""
    spark._jvm.System.gc()


def _versions(spark: SparkSession, table_dir: str) -> list[int]:
    """All version numbers under a table, published or not, newest first."""
    names = (d.removeprefix("v=") for d in list_dirs(spark, table_dir) if d.startswith("v="))
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def published(spark: SparkSession, table_dir: str) -> list[int]:
    """Published versions, newest first."""
    return [v for v in _versions(spark, table_dir) if exists(spark, f"{table_dir}/v={v}/_SUCCESS")]


def current_version(spark: SparkSession, table_dir: str) -> int | None:
    return next(iter(published(spark, table_dir)), None)


def current_path(spark: SparkSession, table_dir: str) -> str | None:
    """Directory of the current version; a table written flat counts as its only version."""
    v = current_version(spark, table_dir)
    if v is not None:
        return f"{table_dir}/v={v}"
    return table_dir if exists(spark, f"{table_dir}/_SUCCESS") else None


def read_current(spark: SparkSession, table_dir: str) -> DataFrame:
    path = current_path(spark, table_dir)
    if path is None:
        raise FileNotFoundError(f"no published version of {table_dir}")
    return read_version(spark, table_dir, path)


def read_version(spark: SparkSession, table_dir: str, path: str) -> DataFrame:
    """A version's files; of a flat table only its own, not those of versions beside them."""
    return spark.read.parquet(f"{path}/*.parquet" if path == table_dir else path)


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every table of ``root`` (of the internal ones only the metadata table): those of its
    snapshot, or without one every table with a published version."""
    held = snapshot(spark, root)
    known = list_dirs(spark, root) if held is None else sorted(held)
    names = [n for n in known if not n.startswith("_") or n == "_referencia"]
    paths = {name: table_path(spark, root, name, held) for name in names}
    return {name: read_version(spark, f"{root}/{name}", path) for name, path in paths.items() if path is not None}


def table_paths(spark: SparkSession, root: str) -> dict[str, str]:
    """Version directory of every table of a month that has a snapshot."""
    return {name: f"{root}/{path}" for name, path in (snapshot(spark, root) or {}).items()}


def table_path(spark: SparkSession, root: str, name: str, held: dict[str, str] | None = None) -> str | None:
    """Directory of a month's table: as its snapshot says, else the newest published version."""
    held = snapshot(spark, root) if held is None else held
    if held is None:
        return current_path(spark, f"{root}/{name}")
    return f"{root}/{held[name]}" if name in held else None


# --- snapshots: one version of every table -------------------------------------

SNAPSHOTS = "_snapshots"


def _snapshot_numbers(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/{SNAPSHOTS}")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), reverse=True)


def snapshot(spark: SparkSession, root: str, number: int | None = None) -> dict[str, str] | None:
    """Table -> directory (relative to ``root``) of a snapshot, by default the newest."""
    known = _snapshot_numbers(spark, root)
    n = number or next(iter(known), None)
    return None if n is None else json.loads(get_text(spark, f"{root}/{SNAPSHOTS}/{n}.json"))["tables"]


def commit(spark: SparkSession, root: str, changed: dict[str, str], *, dropped: tuple[str, ...] = ()) -> int:
    """Switch a month to other versions of some tables: one new snapshot, which keeps all
    other tables of the last one. ``changed``: table -> version directory."""
    known = _snapshot_numbers(spark, root)
    tables = dict(snapshot(spark, root) or {})
    tables.update({name: path.removeprefix(f"{root}/") for name, path in changed.items()})
    for name in dropped:
        tables.pop(name, None)
    n = (known[0] if known else 0) + 1
    fs, target = _fs(spark, f"{root}/{SNAPSHOTS}/{n}.json")
    draft = f"{root}/{SNAPSHOTS}/.draft-{uuid.uuid4().hex}"
    put_text(spark, draft, json.dumps({"tables": tables}, sort_keys=True, indent=1))
    if fs.exists(target) or not fs.rename(_fs(spark, draft)[1], target):
        delete(spark, draft)
        raise RuntimeError(f"snapshot {n} of {root} was made by another run")
    return n


def commit_current(spark: SparkSession, root: str, names: list[str]) -> int:
    """Switch a month to the newest published version of the named tables."""
    paths = {name: current_path(spark, f"{root}/{name}") for name in names}
    return commit(spark, root, {name: path for name, path in paths.items() if path is not None})


def _pinned(spark: SparkSession, table_dir: str) -> set[int]:
    """Versions of a table that its month's snapshot names."""
    root, name = table_dir.rsplit("/", 1)
    tail = (snapshot(spark, root) or {}).get(name, "").rsplit("/", 1)[-1]
    return {int(tail.removeprefix("v="))} if tail.startswith("v=") else set()


def next_version(spark: SparkSession, table_dir: str) -> str:
    return f"{table_dir}/v={max(_versions(spark, table_dir), default=0) + 1}"


def publish(spark: SparkSession, version_dir: str) -> None:
    touch(spark, f"{version_dir}/_SUCCESS")


def write_version(
    df: DataFrame,
    table_dir: str,
    *,
    key: str | None = None,
    partitions: int | None = None,
    inputs: str | None = None,
    visible: bool = True,
    clustered: bool = False,
) -> str:
    """Write the next version of a table and return its directory.

    ``REBALANCE`` (AQE) clusters rows by key but splits a partition that a hot
    key makes oversized and coalesces small ones, so one company holding a
    third of the rows does not become one task or one file. Files are sorted by
    key: Parquet row-group statistics then prune point lookups. Rows that come
    ``clustered`` by key out of a join (where AQE splits a hot key's partition and
    coalesces small ones too) are not shuffled again. With
    ``visible=False`` the version stays unpublished until :func:`publish`.
    """
    spark = df.sparkSession
    if key:
        if partitions is not None:
            df = df.hint("rebalance", partitions, key)
        elif not clustered:
            df = df.hint("rebalance", key)
        df = df.sortWithinPartitions(key)
    version_dir = next_version(spark, table_dir)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(version_dir)
    if inputs is not None:
        put_text(spark, f"{version_dir}/_INPUTS", inputs)
    if visible:
        publish(spark, version_dir)
    return version_dir


def write_table(df: DataFrame, path: str, *, key: str | None = None, partitions: int | None = None) -> None:
    """Rebuild one table: the new version becomes current once it is whole."""
    write_version(df, path, key=key, partitions=partitions)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small marker file, or None."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


def file_stamps(spark: SparkSession, paths: list[str]) -> list[str]:
    """``name:size:time`` of every data file at or under the paths (metadata only)."""
    out = []
    for path in paths:
        fs, p = _fs(spark, path)
        if fs.exists(p):
            it = fs.listFiles(p, True)
            while it.hasNext():
                f = it.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    out.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return sorted(out)


def fingerprint(*parts) -> str:
    return hashlib.sha1("\n".join(str(x) for x in parts).encode()).hexdigest()


def content_stamp(df: DataFrame | None) -> str:
    """Row count and order-free hash of a small table (a dimension)."""
    if df is None:
        return "-"
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    r = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).first()
    return f"{df.columns}:{r[0]}:{r[1]}"


def materialize(reg: Registry, root: str, *, partitions: int | None = None, inputs: str = "") -> Registry:
    """Write every present table under ``root`` and return a registry reading them.

    Reading back cuts the lineage (the derivation is not replayed by later
    queries) and gives the scans Parquet pushdown. Tables published from the same
    ``inputs`` are reused, so a re-run after a lost executor or a killed job only
    writes what is missing; other inputs give new versions.
    """
    out = _write_all(reg.spark, reg.frames, root, partitions, inputs)
    return Registry(out, ano_mes=reg.ano_mes, data_ref=reg.data_ref)


def is_current(spark: SparkSession, table_dir: str, inputs: str) -> bool:
    v = current_version(spark, table_dir)
    return v is not None and get_text(spark, f"{table_dir}/v={v}/_INPUTS") == inputs


def _write_all(
    spark,
    frames: dict[str, DataFrame | None],
    root: str,
    partitions: int | None,
    inputs: str,
    clustered: frozenset[str] = frozenset(),
) -> dict:
    """Write the tables of one stage that are missing or older than their inputs,
    as concurrent jobs (they do not depend on each other, and small ones would
    leave a cluster idle one after the other), then read every table back."""
    from concurrent.futures import ThreadPoolExecutor

    todo = [(name, df) for name, df in frames.items() if df is not None and not is_current(spark, f"{root}/{name}", inputs)]
    if todo:
        with sized_tasks(spark, [df for _, df in todo]), ThreadPoolExecutor(max_workers=min(4, len(todo))) as pool:
            jobs = [
                pool.submit(
                    write_version, df, f"{root}/{name}", key=LAYOUT.get(name), partitions=partitions, inputs=inputs,
                    clustered=name in clustered,
                )
                for name, df in todo
            ]
            for j in jobs:
                j.result()  # re-raises a failed write
    return {name: None if df is None else read_current(spark, f"{root}/{name}") for name, df in frames.items()}


def materialize_model(
    raw: dict[str, DataFrame | None],
    codes: dict[str, DataFrame | None],
    root: str,
    *,
    ano_mes: str,
    data_ref: str = "desconhecida",
    municipio_ibge: DataFrame | None = None,
    cnae_classes: DataFrame | None = None,
    cep_geo: DataFrame | None = None,
    partitions: int | None = None,
    inputs: str = "",
    switch: bool = True,
) -> Registry:
    """Write the model in dependency order and return a registry reading it.

    ``inputs`` names what the raw tables were read from (:func:`fingerprint`): a
    table built from other inputs is built again.

    Stage 1 writes the tables that come from the raw files; stage 2 derives the
    head-office map from the written companies and establishments; stage 3 the
    bridge, the resolved partners and the hierarchy from the written tables.
    Each raw derivation (key concatenation, capital parse) therefore runs once
    instead of once per dependent table, and every stage is skipped when its
    tables are current, so a re-run after a failure resumes where it stopped. With
    ``switch`` the last step makes these versions the month; without it the caller does
    (:func:`commit_current`), and readers keep what they had.
    """
    from regframe.operators import model

    spark = raw["estabelecimento"].sparkSession
    base = _write_all(
        spark,
        model.base_tables(raw, codes, municipio_ibge=municipio_ibge, cep_geo=cep_geo),
        root,
        partitions,
        inputs,
    )
    heads = _write_all(
        spark,
        {"cnpj_base2matriz": model.head_office_map(base["empresas"], base["estabelecimento"])},
        root,
        partitions,
        inputs,
    )["cnpj_base2matriz"]
    derived = _write_all(
        spark,
        model.derived_tables(base, raw, ano_mes=ano_mes, cnae_classes=cnae_classes, head_offices=heads),
        root,
        partitions,
        inputs,
        CLUSTERED if raw.get("socios_original") is not None else frozenset(),
    )
    frames = {**base, **derived}
    if switch:
        complete(spark, root, [n for n, df in frames.items() if df is not None])
    return Registry(frames, ano_mes=ano_mes, data_ref=data_ref)


def complete(spark: SparkSession, root: str, names: list[str]) -> None:
    """Make the newest published versions of the tables the month (in one step), and
    mark the month as one that may be used."""
    commit_current(spark, root, names)
    touch(spark, f"{root}/{MODEL_MARKER}")


MODEL_MARKER = "_MODEL_COMPLETE"


def open_model(spark: SparkSession, root: str, *, ano_mes: str, data_ref: str) -> Registry | None:
    """The registry written by :func:`materialize_model` under ``root``, or None
    when that run did not finish (then the caller builds what is missing)."""
    if not exists(spark, f"{root}/{MODEL_MARKER}"):
        return None
    return Registry(read_tables(spark, root), ano_mes=ano_mes, data_ref=data_ref, paths=table_paths(spark, root))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(tabela, linhas) for every table: one job, one global count per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("linhas")).select(F.lit(name).alias("tabela"), "linhas")
        for name, df in sorted(tables.items())
        if df is not None
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def _bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())


#: Size of a compacted file, from which the number of files follows.
FILE_BYTES = 128 << 20
#: Most bytes of a table that one task sorts into one file when the number of files is given.
SORT_BYTES = 32 << 20


def compact(spark: SparkSession, table_dir: str, *, target_files: int, key: str | None = None) -> dict:
    """Rewrite one table of many small files; see :func:`compact_tables`."""
    return compact_tables(spark, {table_dir: (target_files, key)})[0]


def compact_base(spark: SparkSession, root: str, *, target_files: int | None = None, file_bytes: int = FILE_BYTES) -> list[dict]:
    """Compact every table of a month or model; all row counts are compared before
    the first new version is published. Without ``target_files`` each table gets as
    many files of about ``file_bytes`` as its bytes need; with it, so many or, if that
    would make files of more than ``SORT_BYTES``, more."""
    held = snapshot(spark, root)
    names = [n for n in (held or list_dirs(spark, root)) if not n.startswith("_") and table_path(spark, root, n, held)]

    def files(name: str) -> int:
        size = _bytes(spark, table_path(spark, root, name, held))
        # a file is sorted by one task: a fixed number of files would let that task grow with the table
        return max(target_files, -(-size // SORT_BYTES)) if target_files else max(1, -(-size // file_bytes))

    return compact_tables(spark, {f"{root}/{n}": (files(n), LAYOUT.get(n)) for n in names})


def compact_tables(spark: SparkSession, tables: dict[str, tuple[int, str | None]]) -> list[dict]:
    """Write a compacted, unpublished version of each table, compare all row counts
    with their sources, and only then publish them. If one count differs nothing
    changes and the new versions are deleted. Old versions stay for
    :func:`expire_versions`. Reports rows, files and bytes before and after.
    """
    done = []
    for table_dir, (target_files, key) in tables.items():
        t0 = time.time()
        src_path = table_path(spark, *table_dir.rsplit("/", 1))
        src = read_version(spark, table_dir, src_path)
        # by range of the key: a key lies in one file (or, if a third of all rows are its
        # own, in neighbouring ones: the second column cuts it); no key: round-robin
        tie = [c for c in TIES if c in src.columns and c != key][:1] if key else []
        df = src.repartitionByRange(target_files, key, *tie) if key else src.repartition(target_files)
        df = df.sortWithinPartitions(key, *tie) if key else df
        inputs = get_text(spark, f"{src_path}/_INPUTS")
        dst_path = write_version(df, table_dir, inputs=inputs, visible=False)
        release_shuffles(spark)
        if key:
            note_ranges(spark, dst_path, key)
        done.append(
            {
                "tabela": table_dir,
                "versao": int(dst_path.rsplit("=", 1)[1]),
                "destino": dst_path,
                "linhas": spark.read.parquet(dst_path).count(),
                "linhas_antes": src.count(),
                "arquivos_antes": _own_files(spark, src_path),
                "arquivos_depois": count_files(spark, dst_path),
                "bytes_antes": _bytes(spark, src_path),
                "bytes_depois": _bytes(spark, dst_path),
                "segundos": round(time.time() - t0, 2),
            }
        )
    wrong = [d for d in done if d["linhas"] != d["linhas_antes"]]
    if wrong:
        for d in done:
            delete(spark, d["destino"])
        raise RuntimeError("row counts differ after rewrite: " + ", ".join(d["tabela"] for d in wrong))
    months: dict[str, dict[str, str]] = {}
    for d in done:
        path = d.pop("destino")
        publish(spark, path)
        root, name = d["tabela"].rsplit("/", 1)
        months.setdefault(root, {})[name] = path
    for root, changed in months.items():
        if snapshot(spark, root) is not None:
            commit(spark, root, changed)
    return done


def note_ranges(spark: SparkSession, path: str, key: str) -> None:
    """Note the least and greatest key of every file of a version (one row a file)."""
    df = spark.read.parquet(path)
    ends = df.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    files = [[r["f"], r["lo"], r["hi"]] for r in ends.orderBy("f").collect()]
    put_text(spark, f"{path}/_RANGES", json.dumps({"key": key, "files": files}))


def files_of_key(spark: SparkSession, path: str, key: str, value: str) -> list[str] | None:
    """The files of a version that may hold a key, or None if its ranges are not known."""
    text = get_text(spark, f"{path}/_RANGES")
    note = json.loads(text) if text else None
    if note is None or note["key"] != key:
        return None
    return [f"{path}/{f}" for f, lo, hi in note["files"] if lo is not None and lo <= value <= hi]


def _own_files(spark: SparkSession, path: str) -> int:
    """Data files directly in a version (a flat table also holds later versions)."""
    fs, p = _fs(spark, path)
    return sum(1 for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))


def expire_versions(spark: SparkSession, table_dir: str, *, keep: int = 1, dry_run: bool = False) -> list[str]:
    """Delete published versions beyond the newest ``keep``, and unfinished versions
    older than the current one, but none that the month's snapshot names; returns what was
    (or would be) removed."""
    kept = published(spark, table_dir)[: max(keep, 1)]
    if not kept:
        return []  # nothing is published: whatever is there may still be finished
    held = {*kept, *_pinned(spark, table_dir)}
    gone = [f"{table_dir}/v={v}" for v in _versions(spark, table_dir) if v not in held and v < kept[0]]
    if not dry_run:
        for g in gone:
            delete(spark, g)
    return gone


# --- monthly snapshots -------------------------------------------------------


def snapshot_path(root: str, ano_mes: str) -> str:
    return f"{root}/ano_mes={ano_mes}"


def months(spark: SparkSession, root: str) -> list[str]:
    """Complete snapshot months, newest first; a month without its marker is not one."""
    names = [d.split("=", 1)[1] for d in list_dirs(spark, root) if d.startswith("ano_mes=")]
    return sorted((m for m in names if exists(spark, f"{snapshot_path(root, m)}/{MODEL_MARKER}")), reverse=True)


def current_month(spark: SparkSession, root: str) -> str | None:
    m = months(spark, root)
    return m[0] if m else None


def expire_months(spark: SparkSession, root: str, *, keep: int, dry_run: bool = False) -> list[str]:
    """Drop complete months beyond the newest ``keep`` (the previous base is kept by
    default); returns what was (or, with ``dry_run``, would be) removed."""
    gone = [snapshot_path(root, m) for m in months(spark, root)[max(keep, 1) :]]
    if not dry_run:
        for g in gone:
            delete(spark, g)
    return gone


def open_snapshot(spark: SparkSession, root: str, ano_mes: str | None = None) -> Registry:
    """Registry of one complete month (default: the newest)."""
    known = months(spark, root)
    m = ano_mes or (known[0] if known else None)
    if m is None or m not in known:
        raise FileNotFoundError(f"no complete snapshot {m or ''} under {root}")
    month = snapshot_path(root, m)
    return Registry(read_tables(spark, month), ano_mes=m, paths=table_paths(spark, month))
