"""Run registered queries beside their SQL twins: ``python tests/check.py [folder] [name …]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else 0.0 if f == 0 else f
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(made, key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    mine = table(df.columns, df.collect())
    cursor = con.execute(sql)
    theirs = table([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows / {len(theirs[1])}: {mine[1][:3]} / {theirs[1][:3]}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"{a} / {b}"
    if not mine[1]:
        return "no rows"
    types = {k: t for k, t in df.dtypes}
    wide = {d[0]: str(d[1]) for d in con.execute(sql).description}
    odd = [c for c in types if _family(types[c]) != _family(wide[c])]
    return f"types {[(c, types[c], wide[c]) for c in odd]}" if odd else None


_FAMILY = {
    "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE",
}


def _family(name: str) -> str:
    if name.startswith("array<"):
        return _family(name[6:-1]) + "[]"
    return _FAMILY.get(name, name.upper())


def main() -> None:
    import __spark_entry__ as entry
    from tablestory.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            problem = compare(df, con, sql[name]) if name in sql else (None if df.count() else "no rows")
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        took = time.time() - start
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {'sql ' if name in sql else 'rows'} {took:6.2f} {name} {problem or ''}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
