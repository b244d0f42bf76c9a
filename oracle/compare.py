"""Run registered queries in Spark and DuckDB and compare: ``python -m oracle.compare sf0.01 [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
         "boolean": "BOOLEAN"}


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, name, build, sql, folder):
    t = time.time()
    df = build(spark, folder)
    columns = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*columns).toLocalIterator()]
    spent = time.time() - t
    if sql is None:
        return f"{name:28s} rows={len(mine):7d} spark={spent:6.2f}s  (no twin)"
    t = time.time()
    rel = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})")
    kinds = [str(d[1]) for d in rel.description]
    theirs = rel.fetchall()
    other = time.time() - t
    wanted = [KINDS.get(df.schema[c].dataType.simpleString(), df.schema[c].dataType.simpleString()) for c in columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    mine, theirs = sorted(map(tuple, mine), key=key), sorted(map(tuple, theirs), key=key)
    ok = mine == theirs and wanted == kinds
    out = f"{name:28s} rows={len(mine):7d} spark={spent:6.2f}s duck={other:6.2f}s  {'OK' if ok else 'DIFFERS'}"
    if not ok:
        a, b = set(mine), set(theirs)
        out += f"\n    types {list(zip(columns, wanted, kinds)) if wanted != kinds else 'equal'} rows {len(mine)}/{len(theirs)}"
        out += f"\n    only spark {sorted(a - b, key=key)[:3]}\n    only duck  {sorted(b - a, key=key)[:3]}"
    return out


def main(argv):
    from quillsift import build_session, catalog
    import oracle

    folder = f"/root/testdata/{argv[0]}"
    spark = build_session(master="local[8]", spark__driver__memory="12g", spark__ui__enabled="false",
                          spark__sql__shuffle__partitions="8", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, twins = duck(folder), oracle.statements()
    for name, build in catalog.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        try:
            print(compare(spark, con, name, build, twins.get(name), folder), flush=True)
        except Exception as error:  # report and go on with the next query
            print(f"{name:28s} FAILED {type(error).__name__}: {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
