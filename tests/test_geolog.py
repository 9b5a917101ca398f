"""The geocode cache as a log."""

from __future__ import annotations

from regframe.operators import maintain
from regframe.operators.geolog import GeoLog

_COLS = "cep string, status string, latitude double"


def _answers(spark, rows):
    return spark.createDataFrame(rows, _COLS)


def _state(log):
    return {r["cep"]: (r["status"], r["latitude"]) for r in log.read().collect()}


def test_last_write_wins_through_compaction(spark, tmp_path):
    log = GeoLog(spark, str(tmp_path / "log"))
    assert _state(log) == {} and log.compact() == []
    log.append(_answers(spark, [(f"{i:08d}", "erro", None) for i in range(50)]))
    log.append(_answers(spark, [(f"{i:08d}", "ok", 1.0) for i in range(30)] + [("00000099", "ok", 2.0)]))
    want = {f"{i:08d}": ("ok", 1.0) if i < 30 else ("erro", None) for i in range(50)} | {"00000099": ("ok", 2.0)}
    assert _state(log) == want
    touched = log.compact()
    assert touched and _state(log) == want
    # only buckets of two appends were rewritten, the others stay in their files
    parts = log.parts()
    assert all(parts[k] == [3] for k in touched) and any(3 not in ns for ns in parts.values())
    log.append(_answers(spark, [("00000001", "nao_encontrado", None)]))
    want["00000001"] = ("nao_encontrado", None)
    assert _state(log) == want
    log.expire()
    assert _state(log) == want
    log.compact()
    log.expire()
    assert _state(log) == want


def test_unfinished_and_concurrent_appends(spark, tmp_path, monkeypatch):
    log = GeoLog(spark, str(tmp_path / "log"))
    log.append(_answers(spark, [("00000001", "erro", None), ("00000002", "erro", None)]))
    log.append(_answers(spark, [("00000001", "ok", 1.0)]))
    real = maintain.publish
    monkeypatch.setattr(maintain, "publish", lambda *a: None)
    log.append(_answers(spark, [("00000001", "ok", 9.0)]))  # never published
    monkeypatch.setattr(maintain, "publish", real)
    assert _state(log)["00000001"] == ("ok", 1.0)
    # answers that arrive while a compaction runs are later than what it holds
    other, write = GeoLog(spark, log.root), log._write

    def meanwhile(rows, keeps=None):
        other.append(_answers(spark, [("00000001", "ok", 5.0)]))
        return write(rows, keeps)

    log._write = meanwhile
    log.compact()
    assert _state(other) == {"00000001": ("ok", 5.0), "00000002": ("erro", None)}
