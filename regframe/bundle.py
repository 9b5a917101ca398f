"""The registry bundle: named DataFrames, optional ones may be absent.

Replaces a catalogue probe: an operator asks ``reg.has('municipio_ibge')``
instead of querying an information schema, and degrades or raises the same way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dimensions are bounded by their domain (activity codes, municipalities,
# countries, ...). They are broadcast only after this row bound is checked.
DIMENSION_ROW_BOUND = 200_000

TABLES = (
    "empresas",
    "estabelecimento",
    "socios",
    "simples",
    "cnae",
    "motivo",
    "municipio",
    "natureza_juridica",
    "pais",
    "qualificacao_socio",
    "cnpj_base2matriz",
    "estabelecimento_cnae",
    "municipio_ibge",
    "cnae_hierarquia",
    "cep_geo",
    "_referencia",
)

DIMENSIONS = (
    "cnae",
    "motivo",
    "municipio",
    "natureza_juridica",
    "pais",
    "qualificacao_socio",
    "municipio_ibge",
    "cnae_hierarquia",
)


def bounded_broadcast(df: DataFrame, max_rows: int = DIMENSION_ROW_BOUND) -> DataFrame:
    """Broadcast ``df`` only when it provably holds at most ``max_rows`` rows.

    The check is an action over ``max_rows + 1`` rows at most; beyond the bound
    the frame is returned as is and the planner shuffles (AQE may still pick a
    broadcast from runtime sizes).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


@dataclass
class Registry:
    frames: dict[str, DataFrame]
    ano_mes: str = "000000"
    data_ref: str = "desconhecida"
    #: Version directories of stored tables (their frames must be those files, unchanged).
    paths: dict[str, str] = field(default_factory=dict)
    _dims: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def has(self, name: str) -> bool:
        return self.frames.get(name) is not None

    def __getitem__(self, name: str) -> DataFrame:
        df = self.frames.get(name)
        if df is None:
            raise KeyError(f"table '{name}' is not in the registry")
        return df

    def get(self, name: str) -> DataFrame | None:
        return self.frames.get(name)

    @property
    def spark(self) -> SparkSession:
        return self["estabelecimento"].sparkSession

    def dim(self, name: str) -> DataFrame:
        """A dimension, broadcast behind a checked row bound (checked once)."""
        if name not in self._dims:
            self._check_dimensions(name)
        return self._dims[name]

    def _check_dimensions(self, name: str) -> None:
        """Row bounds of ``name`` and of every other unchecked dimension in one
        job: a union of per-table ``limit(bound + 1)`` counts (one row each)."""
        names = [n for n in DIMENSIONS if self.has(n) and n not in self._dims]
        if name not in names:
            names.append(name)
        parts = [
            self[n]
            .limit(DIMENSION_ROW_BOUND + 1)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(n).alias("t"), "n")
            for n in names
        ]
        import functools

        counts = {r["t"]: r["n"] for r in functools.reduce(DataFrame.unionByName, parts).collect()}
        for n in names:
            df = self[n]
            self._dims[n] = F.broadcast(df) if counts[n] <= DIMENSION_ROW_BOUND else df

    def with_frames(self, **frames: DataFrame | None) -> "Registry":
        merged = dict(self.frames)
        merged.update(frames)
        stored = {name: path for name, path in self.paths.items() if name not in frames}
        return Registry(merged, self.ano_mes, self.data_ref, stored)

    def of_company(self, name: str, base: str) -> DataFrame:
        """The rows of a table that belong to one company. A table laid out by range of
        the company key is read from the files that may hold it, the others stay closed."""
        from regframe.operators import maintain

        key = F.col("cnpj_basico") == base
        path = self.paths.get(name)
        files = maintain.files_of_key(self.spark, path, "cnpj_basico", base) if path else None
        if files is None:
            return self[name].where(key)
        reader = self.spark.read.schema(self[name].schema)
        return reader.parquet(*files).where(key) if files else self[name].where(F.lit(False))

    def columns_catalog(self) -> DataFrame:
        """(table_name, column_name, data_type, ordinal_position) of every present
        table and view: the catalogue probe as a frame. Built from the schemas
        on the driver (metadata only, one row per column, no data read)."""
        rows = []
        for name, df in sorted({**self.frames, **views(self)}.items()):
            if df is None:
                continue
            for i, f in enumerate(df.schema.fields, start=1):
                rows.append((name, f.name, f.dataType.simpleString(), i))
        return self.spark.createDataFrame(
            rows, "table_name string, column_name string, data_type string, ordinal_position int"
        )

    def register_views(self, prefix: str = "") -> list[str]:
        """Temp views of every present table (for guarded ad hoc SQL), plus the
        catalogue views ``catalogo_tabelas`` and ``catalogo_colunas``."""
        names = []
        for name, df in self.frames.items():
            if df is not None:
                df.createOrReplaceTempView(prefix + name)
                names.append(prefix + name)
        for view, df in views(self).items():
            df.createOrReplaceTempView(prefix + view)
            names.append(prefix + view)
        cols = self.columns_catalog()
        cols.createOrReplaceTempView(prefix + "catalogo_colunas")
        cols.select("table_name").distinct().createOrReplaceTempView(prefix + "catalogo_tabelas")
        names += [prefix + "catalogo_colunas", prefix + "catalogo_tabelas"]
        return names


def views(reg: Registry) -> dict[str, DataFrame]:
    from regframe.operators import model

    out = {
        "mv_estabelecimento_ativo": model.view_active(reg),
        "mv_matriz": model.view_head_office(reg),
    }
    if reg.has("simples"):
        out["mv_mei"] = model.view_mei(reg)
    return out
