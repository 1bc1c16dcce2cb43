"""Compare registered queries with their SQL in DuckDB: names, types, row counts, values.

    python tests/oracle_check.py [--sf DIR] [name prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
             "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def compare(spark, con, folder: str, query, sql: str) -> tuple[str, int]:
    """Empty text when equal, else what differs; and the number of rows."""
    df = query(spark, folder)
    names = sorted(df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ours = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).toLocalIterator()]
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(described) != names:
        return f"columns {names} and {sorted(described)}", len(ours)
    wrong = {n: (types[n], described[n]) for n in names if SAME_TYPE.get(types[n]) != described[n]}
    if wrong:
        return f"types {wrong}", len(ours)
    columns = ", ".join(f'"{n}"' for n in names)
    theirs = con.execute(f"SELECT {columns} FROM ({sql})").fetchall()
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, expected {len(theirs)}", len(ours)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    for a, b in zip(sorted(ours, key=key), sorted(theirs, key=key)):
        if a != b:
            return f"{str(a)[:600]} expected {str(b)[:600]}", len(ours)
    return "", len(ours)


def main() -> int:
    import __spark_entry__ as entry
    from nlcorpus.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("prefix", nargs="*")
    args = parser.parse_args()
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    oracles, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        began = time.time()
        try:
            if name in oracles:
                problem, rows = compare(spark, con, args.sf, query, oracles[name])
            else:
                problem, rows = "", query(spark, args.sf).count()
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:900]}", -1
        bad += bool(problem)
        kind = "sql " if name in oracles else "rows"
        print(f"{'BAD ' if problem else 'ok  '} {kind} {name:34} {rows:8} rows {time.time() - began:6.1f}s {problem}",
              flush=True)
    print(f"{bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
