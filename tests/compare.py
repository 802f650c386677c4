"""Run registered queries and their SQL oracles side by side.

    python tests/compare.py [--sf 0.001] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

import duckdb

from lectern.queries.registry import TABLES

ROOT = "/root/testdata/sf"


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if isinstance(v, (int, str)) else str(v)


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"bigint": "int", "int": "int", "integer": "int", "smallint": "int", "tinyint": "int", "hugeint": "huge",
         "double": "float", "float": "float", "varchar": "string", "string": "string", "boolean": "boolean"}


def compare(spark, con, name: str, folder: str) -> tuple[str, str]:
    from lectern.queries import ORACLES, QUERIES

    df = QUERIES[name](spark, folder)
    got = canonical(df.columns, df.collect())
    if name not in ORACLES:
        return ("rows" if got else "EMPTY"), f"{len(got)} rows"
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = canonical(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return "SCHEMA", f"spark {sorted(df.columns)} oracle {sorted(cols)}"
    spark_types = {n: KINDS.get(t, t) for n, t in df.dtypes}
    sql_types = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1]).lower()) for d in cur.description}
    odd = {n: (spark_types[n], sql_types[n]) for n in cols if spark_types[n] != sql_types[n]}
    odd = {n: t for n, t in odd.items() if "decimal" in t[1] or "huge" in t[1] or "decimal" in t[0] or {"int", "float"} == set(t)}
    if len(got) != len(want):
        return "ROWS", f"spark {len(got)} oracle {len(want)}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        return "VALUES", f"{len(bad)} of {len(got)} differ; cols {sorted(cols)}; first {bad[0]}"
    if not got:
        return "EMPTY", "no rows on either side"
    if odd:
        return "TYPES", str(odd)
    return "ok", f"{len(got)} rows"


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.001")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from lectern.queries import QUERIES
    from lectern.session import local_session

    spark = local_session()
    folder = ROOT + args.sf
    con = oracle_connection(folder)
    names = [n for n in QUERIES if not args.names or any(n.startswith(a) for a in args.names)]
    failed = 0
    for name in names:
        begun = time.time()
        try:
            status, detail = compare(spark, con, name, folder)
        except Exception as exc:  # report and go on
            status, detail = "ERROR", str(exc)[:900]
        failed += status not in ("ok", "rows")
        print(f"{status:7s} {name:45s} {time.time() - begun:6.2f}s {detail[:1200]}", flush=True)
    print(f"{len(names)} queries, {failed} failing")
