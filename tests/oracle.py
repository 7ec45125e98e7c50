"""Compare a registered query with its SQL on the same tables.

``python -m tests.oracle [name-fragment ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (2, f"{v + 0.0:.10g}")
    if isinstance(v, int):
        return (2, f"{float(v):.10g}" if abs(v) < 2 ** 53 else str(v))
    return (3, str(v))


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    df = entry_module.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows (no SQL)"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = {c[0]: str(c[1]) for c in cur.description}
    a, b = _rows(got, df.columns), _rows(want, names)
    if len(a) != len(b):
        return False, f"{len(a)} rows vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = [f"{n}:{types[n]}/{kinds[n]}" for n in names if not _same_type(types[n], kinds[n])]
    return True, f"{len(a)} rows" + (f" TYPES {odd}" if odd else "")


def _same_type(spark_type: str, duck_type: str) -> bool:
    duck = duck_type.upper()
    pairs = {"bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE", "FLOAT"),
             "string": ("VARCHAR", "STRING"), "boolean": ("BOOLEAN", "BOOL"), "date": ("DATE",)}
    return duck in pairs.get(spark_type, (duck,))


def main(argv: list[str]) -> int:
    from siteplan_spark.session import build_session
    folder = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        folder, argv = argv[0], argv[1:]
    spark = build_session("oracle", "local[8]", 8, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in entry_module.queries():
        if argv and not any(a in name for a in argv):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:36s} {time.time() - start:6.2f}s {note}",
              flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
