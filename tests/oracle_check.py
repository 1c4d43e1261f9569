"""Run queries against their DuckDB SQL: python tests/oracle_check.py [sf dir] [query ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns: list, rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    frame = query(spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"{name}: columns {sorted(frame.columns)} instead of {sorted(columns)}"
    if got != want:
        pairs = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return f"{name}: {len(got)} rows against {len(want)}; first differences {pairs}"
    return None if want else f"{name}: no rows to compare"


def main(sf_dir: str, names: list) -> None:
    from __spark_entry__ import oracle_sql, queries
    from filecover.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = oracle_sql()
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = differences(spark, con, name, query, sqls[name], sf_dir)
            else:
                problem = None if query(spark, sf_dir).count() else f"{name}: no rows"
        except Exception as e:
            problem = f"{name}: {type(e).__name__}: {str(e)[:700]}"
        print(f"{time.time() - start:6.1f}s  {'ok  ' + name if problem is None else 'BAD ' + problem}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:])
