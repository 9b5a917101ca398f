"""The geocode cache as a log: answers are appended, merged when read.

Layout::

    <root>/s=<n>/b=<k>/...    answers of append n whose postal code falls into bucket k
    <root>/s=<n>/_SUCCESS     present when append n is whole
    <root>/s=<n>/_KEEPS       of a compaction: the buckets it rewrote and the last append it holds

An append writes its own answers only, whatever the cache holds. A reader takes the
appends that are whole and, by postal code, the last write: the later append, and within
one the later answer (a grouped ``max_by``, so a code asked again and again is no hot
task). A compaction rewrites the buckets that have more than ``files`` appends and leaves
the others where they are; what it replaces stays until :meth:`GeoLog.expire`.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regframe.operators import geo, maintain
from regframe.schemas import GEO_CACHE_SCHEMA

BUCKETS = 64
_COLUMNS = [f.name for f in GEO_CACHE_SCHEMA.fields]


def _bucket(cep: str = "cep"):
    return F.pmod(F.xxhash64(cep), F.lit(BUCKETS)).cast("int")


@dataclass
class GeoLog:
    spark: SparkSession
    root: str

    def _appends(self) -> list[int]:
        names = (d.removeprefix("s=") for d in maintain.list_dirs(self.spark, self.root) if d.startswith("s="))
        return sorted(int(n) for n in names if n.isdigit())

    def _whole(self) -> list[int]:
        return [n for n in self._appends() if maintain.exists(self.spark, f"{self.root}/s={n}/_SUCCESS")]

    def _buckets(self, n: int) -> set[int]:
        return {int(d.removeprefix("b=")) for d in maintain.list_dirs(self.spark, f"{self.root}/s={n}") if d.startswith("b=")}

    def _note(self, n: int) -> dict | None:
        """What a compaction says of itself, None for an append of answers."""
        text = maintain.get_text(self.spark, f"{self.root}/s={n}/_KEEPS")
        return None if text is None else json.loads(text)

    def parts(self) -> dict[int, list[int]]:
        """Bucket -> the appends that hold it, without those a compaction has replaced."""
        held: dict[int, list[int]] = {}
        for n in self._whole():
            note = self._note(n) or {"buckets": []}
            for k in note["buckets"]:
                held[k] = [m for m in held.get(k, []) if m > note["upto"]]
            for k in self._buckets(n):
                held.setdefault(k, []).append(n)
        return held

    def _write(self, rows: DataFrame, keeps: dict | None = None) -> int:
        n = max(self._appends(), default=0) + 1
        path = f"{self.root}/s={n}"
        dealt = rows.withColumn("b", _bucket()).repartition("b")
        dealt.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("b").parquet(path)
        if keeps is not None:
            maintain.put_text(self.spark, f"{path}/_KEEPS", json.dumps(keeps))
        maintain.publish(self.spark, path)
        return n

    def append(self, answers: DataFrame, *, fonte: str = "lookup") -> int:
        """Add answers (of equal codes the latest counts); returns the append's number."""
        return self._write(geo.merge(None, answers, fonte=fonte))

    def _read(self, parts: dict[int, list[int]]) -> DataFrame:
        """The last write of every code of the given parts."""
        paths = [(n, f"{self.root}/s={n}/b={k}") for k, ns in sorted(parts.items()) for n in ns]
        if not paths:
            return self.spark.createDataFrame([], GEO_CACHE_SCHEMA)
        # a compaction is as old as the last append it holds: one written meanwhile is later
        age = {n: (self._note(n) or {"upto": n})["upto"] for n in {n for n, _ in paths}}
        read = self.spark.read.schema(GEO_CACHE_SCHEMA)
        frames = [read.parquet(*[p for m, p in paths if m == n]).withColumn("_s", F.lit(at)) for n, at in sorted(age.items())]
        rest = [c for c in _COLUMNS if c != "cep"]
        every = functools.reduce(DataFrame.unionByName, frames)
        last = every.groupBy("cep").agg(F.max_by(F.struct(*rest), "_s").alias("_v"))  # an append holds a code once
        return last.select("cep", "_v.*").select(*_COLUMNS)

    def read(self) -> DataFrame:
        return self._read(self.parts())

    def compact(self, *, files: int = 1) -> list[int]:
        """Rewrite the buckets that more than ``files`` appends hold; returns these buckets."""
        upto = max(self._whole(), default=0)
        todo = {k: ns for k, ns in self.parts().items() if len(ns) > files}
        if todo:
            self._write(self._read(todo), {"buckets": sorted(todo), "upto": upto})
        return sorted(todo)

    def expire(self) -> list[int]:
        """Delete the appends that no bucket needs any more; returns their numbers."""
        needed = {n for ns in self.parts().values() for n in ns}
        last = max(self._whole(), default=0)
        # a compaction's note is needed as long as an older append is
        noted = {n for n in self._whole() if any(m < n for m in needed)}
        gone = [n for n in self._whole() if n not in needed | noted and n < last]
        for n in gone:
            maintain.delete(self.spark, f"{self.root}/s={n}")
        return gone
