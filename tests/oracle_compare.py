"""Side-by-side check of a Spark query and its SQL text in DuckDB.

Row count, column names and an order-insensitive hash of the values (floats
rounded) must agree. Used by the tests and runnable as a script:
``python tests/oracle_compare.py /root/testdata/sf0.01 [name ...]``.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[list[str], int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return [columns[i] for i in order], len(rows), h


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    s = digest(df.columns, s_rows)
    d = digest(d_cols, d_rows)
    out = {
        "name": name,
        "rows": (s[1], d[1]),
        "cols_ok": s[0] == d[0],
        "hash_ok": s[2] == d[2],
        "spark_s": round(t1 - t0, 2),
        "duck_s": round(t2 - t1, 2),
    }
    if not out["cols_ok"]:
        out["cols"] = (s[0], d[0])
    if not out["hash_ok"] and s[1] == d[1]:
        order_s = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        a = sorted("|".join(_norm(r[i]) for i in order_s) for r in s_rows)
        b = sorted("|".join(_norm(r[i]) for i in order_d) for r in d_rows)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        out["first_diff"] = diff
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from regframe.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            print({"name": name, "rows_only": df.count()})
            continue
        try:
            r = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as ex:  # report and continue
            r = {"name": name, "error": repr(ex)[:600]}
        ok = r.get("hash_ok") and r.get("cols_ok") and r["rows"][0] == r["rows"][1]
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
