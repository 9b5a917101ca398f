"""Resumable landing of raw dump files as Parquet (Structured Streaming).

Each raw kind is a file-source stream over the dump directory with
``trigger(availableNow=True)``: the checkpoint records which files were
committed, so a re-run (after a crash, a lost executor or a new file arriving
for the same month) lands only what is missing, exactly once, and the
Parquet sink's metadata log hides partial output from readers.

A file is cut into blocks even where fields hold line breaks
(:mod:`regframe.sources.records`): a batch job over the files that are not landed yet
counts quotes by block, the stream meets its blocks with that table, lands whole records
as rows, and what blocks hold of torn records as fragments, which readers join.

Landed data of a month lives in generations ``_raw/g=<k>``. New files join the
current generation. A file that changed or vanished after it was landed cannot be
taken back out of a sink, so it starts the next generation, which lands everything
again; so does ``resume=False``. Size and time of every file are noted before it is landed
(``_PLANNED``) and when its run has ended (``_MANIFEST``), so that a file replaced after
a run that was cut short counts as changed too. A kind whose raw files were removed after
landing keeps its landed rows (the raw dump may be cleared once it is loaded). A
generation that a newer one has landed again goes (:func:`expire_generations`).
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regframe.operators import maintain
from regframe.schemas import CODE_COLUMNS, CODE_TABLES, RAW_KINDS, text_schema
from regframe.sources import dump, records

#: Blocks that one landing is cut into at most, while they are smaller than the session's:
#: each is a task of both passes, a file of the sink and a row of the states.
MOST_BLOCKS = 400


def _stream(spark: SparkSession, directory: str, names: list[str], columns: list[str], starts: DataFrame, max_files: int | None):
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if max_files else spark.readStream
    found = records.decoded(records.pieces(records.lines(reader, directory, names), starts), dump.ENCODING)
    # the columns of a whole record; a fragment keeps its text instead
    whole = F.col("_parte") == records.WHOLE
    text = found.withColumn("_fragmento", F.when(~whole, F.col("_texto")))
    return records.parsed(text, text_schema(columns), dump.CSV_OPTIONS, keep=~whole)


def _block_starts(spark: SparkSession, directory: str, names: list[str], path: str) -> DataFrame:
    """The state of every block of the named files, written under ``path`` (a row a block)."""
    if names:
        records.block_starts(records.lines(spark.read, directory, names)).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    return spark.createDataFrame([], "in_file string, in_block long, inside boolean")


def plan_files(names: list[str], ano_mes: str) -> dict[str, tuple[list[str], list[str]]]:
    """Files and columns per kind for one month. A code table has one file, the first
    by name; a second one would give every code twice. Absent ones are warned about."""
    mine = dump.of_month(sorted(names), ano_mes)
    plan = {kind: (dump.matching(mine, glob), cols) for kind, (glob, cols) in RAW_KINDS.items()}
    for suffix, table in CODE_TABLES:
        plan[table] = (dump.matching(mine, f"*{suffix}")[:1], CODE_COLUMNS)
        if not plan[table][0]:
            warnings.warn(f"code table {table}: no file *{suffix}", stacklevel=2)
    return {kind: v for kind, v in plan.items() if v[0]}


def _stamps(spark: SparkSession, directory: str, plan: dict) -> dict[str, str]:
    """Size and time by file name, for all files of the plan (metadata only)."""
    fs, p = maintain._fs(spark, directory)
    wanted = {n for names, _ in plan.values() for n in names}
    return {
        s.getPath().getName(): f"{s.getLen()}:{s.getModificationTime()}"
        for s in fs.listStatus(p)
        if s.getPath().getName() in wanted
    }


def block_size(spark: SparkSession, asked: int | None, pending: int) -> int | None:
    """Size of the blocks for ``pending`` bytes of raw files: as ``asked`` (None: the
    session's), or more where that would make over ``MOST_BLOCKS`` of them."""
    if asked is None:
        return None
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    own = size(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(asked, min(own, -(-pending // MOST_BLOCKS)))


def _noted(spark: SparkSession, path: str) -> dict[str, str]:
    text = maintain.get_text(spark, path) or ""
    return dict(line.split("\t") for line in text.splitlines())


def _note(spark: SparkSession, path: str, stamps: dict[str, str]) -> None:
    maintain.put_text(spark, path, "\n".join(f"{n}\t{s}" for n, s in sorted(stamps.items())))


def _generations(spark: SparkSession, raw_root: str) -> list[int]:
    names = (d.removeprefix("g=") for d in maintain.list_dirs(spark, raw_root) if d.startswith("g="))
    return sorted(int(n) for n in names if n.isdigit())


def expire_generations(spark: SparkSession, root: str) -> list[str]:
    """Delete the generations before the landed one at ``root``, which no load reads again,
    but none with a kind that ``root`` does not hold; returns what was removed."""
    raw_root, number = root.rsplit("/g=", 1)
    kinds = lambda at: {d for d in maintain.list_dirs(spark, at) if not d.startswith("_")}
    older = [f"{raw_root}/g={n}" for n in _generations(spark, raw_root) if n < int(number)]
    gone = [at for at in older if kinds(at) <= kinds(root)]
    for at in gone:
        maintain.delete(spark, at)
    return gone


def land(
    spark: SparkSession,
    directory: str,
    raw_root: str,
    *,
    ano_mes: str,
    resume: bool = True,
    max_files_per_trigger: int | None = None,
    block_bytes: int | None = None,
) -> tuple[str, dict[str, int]]:
    """Land every pending raw file of the month; returns the generation's directory
    and the rows landed by this run per kind. ``block_bytes``: least size of the blocks that
    files are cut into (default: the session's; see :func:`block_size`)."""
    plan = plan_files(dump.list_files(spark, directory), ano_mes)
    stamps = _stamps(spark, directory, plan)
    known = _generations(spark, raw_root)
    number = known[-1] if known else 1
    before = _noted(spark, f"{raw_root}/g={number}/_MANIFEST") if known else {}
    planned = _noted(spark, f"{raw_root}/g={number}/_PLANNED") if known else {}
    changed = any(n in stamps and stamps[n] != s for n, s in (planned | before).items())
    if known and (changed or not resume):
        number, before, planned = number + 1, {}, {}
    root = f"{raw_root}/g={number}"
    _note(spark, f"{root}/_PLANNED", planned | stamps)

    pending = sum(int(s.split(":")[0]) for n, s in stamps.items() if n not in before)
    own = records.grid_session(spark, block_size(spark, block_bytes, pending))
    dump.enable_charsets(spark)
    dump.enable_charsets(own)
    had = {kind: _rows(spark, root, kind) for kind in plan}
    starts = {
        kind: _block_starts(own, directory, [n for n in names if n not in before], f"{root}/_blocks/{kind}")
        for kind, (names, _) in plan.items()
    }
    # All kinds run at once: landing one after the other would leave a cluster idle.
    queries = {
        kind: (
            _stream(own, directory, names, cols, starts[kind], max_files_per_trigger)
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{root}/_checkpoints/{kind}")
            .option("path", f"{root}/{kind}")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        for kind, (names, cols) in plan.items()
    }
    try:
        for q in queries.values():
            q.awaitTermination()
    except Exception:
        for q in queries.values():  # a failed kind stops the run; the checkpoints resume it
            if q.isActive:
                q.stop()
        raise
    _note(spark, f"{root}/_MANIFEST", before | stamps)
    # counted in what the sink committed: a stream's progress keeps only its last batches
    return root, {kind: _rows(spark, root, kind) - had[kind] for kind in plan}


def _rows(spark: SparkSession, root: str, kind: str) -> int:
    """Landed rows: whole records, and torn ones, each of which has one first fragment."""
    if not maintain.exists(spark, f"{root}/{kind}/_spark_metadata"):
        return 0
    return spark.read.parquet(f"{root}/{kind}").where(F.col("_parte").isin(records.WHOLE, records.TAIL)).count()


def read_landed(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    """A landed raw table (committed files only) with its ``_arquivo``, or None when never
    landed. Records torn by a cut of their file are put together here."""
    if not maintain.exists(spark, f"{root}/{kind}/_spark_metadata"):
        return None
    found = spark.read.parquet(f"{root}/{kind}")
    columns = [c for c in found.columns if c not in ("_arquivo", "_bloco", "_parte", "_fragmento")]
    whole = found.where(F.col("_parte") == records.WHOLE).select(*columns, "_arquivo")
    fragments = found.where(F.col("_parte") != records.WHOLE).select("_arquivo", "_bloco", "_parte", F.col("_fragmento").alias("_texto"))
    torn = records.parsed(records.joined(fragments), text_schema(columns), dump.CSV_OPTIONS)
    return whole.unionByName(torn)
