"""Compare registered queries with their SQL on DuckDB: python tests/oracle_check.py [sf_dir] [name prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return "-0.0" if v == 0 and math.copysign(1, v) < 0 else repr(float(f"{v:.12g}"))
    if isinstance(v, int):
        return str(v)
    if hasattr(v, "as_tuple"):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canonical(x) for x in v) + "]"
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in at) for r in rows)


def kinds(columns, rows):
    out = {}
    for i, c in enumerate(columns):
        seen = {type(r[i]).__name__ for r in rows if r[i] is not None}
        out[c] = "/".join(sorted(seen))
    return out


def compare(spark, con, folder: str, name: str, fn, sql: str | None) -> str:
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows only ({len(got)})"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"FAIL columns {sorted(set(cols) ^ set(df.columns))}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return f"FAIL rows {len(a)} vs {len(b)}"
    if not a:
        return "FAIL empty"
    if a != b:
        names = sorted(cols)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        where = {names[i] for x, y in bad for i in range(len(names)) if x[i] != y[i]}
        x, y = bad[0]
        return f"FAIL {len(bad)} of {len(a)} rows differ in {sorted(where)[:8]}\n   spark {dict(zip(names, x))}\n   sql   {dict(zip(names, y))}"
    ka, kb = kinds(df.columns, got), kinds(cols, want)
    odd = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c]}
    return f"ok ({len(a)})" + (f" types {odd}" if odd else "")


def main() -> None:
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    from driftline.session import local_session
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(p) for p in args):
            continue
        start = time.time()
        try:
            result = compare(spark, con, folder, name, fn, entry.oracle_sql().get(name))
        except Exception as e:  # report and go on
            result = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        if result.startswith(("FAIL", "ERROR")):
            failed.append(name)
        print(f"{name}: {result} [{time.time() - start:.1f}s]", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
