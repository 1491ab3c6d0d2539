"""Compare registered queries with their SQL on the same parquet files.

``python -m tests.checker [-d FOLDER] [PATTERN ...]``
"""

from __future__ import annotations

import re
import sys
import time

import duckdb
import pyarrow as pa

from tracelake.sources.bindings import DRIVER_TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in DRIVER_TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def arrow(con: duckdb.DuckDBPyConnection, sql: str) -> pa.Table:
    got = con.execute(sql)
    return got.to_arrow_table() if hasattr(got, "to_arrow_table") else got.fetch_arrow_table()


def _type(t: pa.DataType) -> str:
    return {"large_string": "string"}.get(str(t), str(t))


def _rows(table: pa.Table, names: list[str]) -> list[tuple]:
    columns = [table.column(n).to_pylist() for n in names]
    rows = list(zip(*columns)) if columns else []
    rows = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0)
                                            for v in r))


def difference(spark_table: pa.Table, sql_table: pa.Table) -> str | None:
    names = sorted(spark_table.column_names)
    if names != sorted(sql_table.column_names):
        return f"columns {names} != {sorted(sql_table.column_names)}"
    for n in names:
        a, b = _type(spark_table.schema.field(n).type), _type(sql_table.schema.field(n).type)
        if a != b:
            return f"type of {n}: {a} != {b}"
    if spark_table.num_rows != sql_table.num_rows:
        return f"rows {spark_table.num_rows} != {sql_table.num_rows}"
    left, right = _rows(spark_table, names), _rows(sql_table, names)
    for a, b in zip(left, right):
        if a != b:
            return f"{names}\n   {a}\n!= {b}"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tracelake.session import build_session

    folder = "/root/testdata/sf0.01"
    if argv[:1] == ["-d"]:
        folder, argv = argv[1], argv[2:]
    spark, con = build_session("local[8]"), connect(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(re.search(p, name) for p in argv):
            continue
        t0 = time.time()
        try:
            got = fn(spark, folder).toArrow()
        except Exception as e:  # noqa: BLE001 -- report and go on
            bad += 1
            print(f"FAIL {name} spark: {str(e)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if name not in checks:
            print(f"rows {name} {got.num_rows} {t1 - t0:.1f}s", flush=True)
            continue
        try:
            want = arrow(con, checks[name])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name} sql: {str(e)[:1500]}", flush=True)
            continue
        diff = difference(got, want)
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {got.num_rows} "
              f"{t1 - t0:.1f}s sql {time.time() - t1:.1f}s {diff or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
