"""Run registered queries next to their SQL twins. ``python -m tests.compare [sf_dir] [name …]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(name: str) -> str:
    n = name.lower()
    return {"integer": "int", "int32": "int", "string": "str", "varchar": "str", "bigint": "long", "date32[day]": "date",
            "boolean": "bool"}.get(n, n)


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    return str(v)


def rows_of(table, cols):
    data = [table.column(c).to_pylist() for c in cols]
    return sorted(tuple(_norm(x) for x in row) for row in zip(*data))


def compare(df, con, sql: str) -> str:
    """Empty text when row count, column types and values agree."""
    left, right = df.toArrow(), con.execute(sql).to_arrow_table()
    cols = sorted(left.column_names)
    if cols != sorted(right.column_names):
        return f"columns {cols} != {sorted(right.column_names)}"
    kinds = [(c, str(left.schema.field(c).type), str(right.schema.field(c).type)) for c in cols]
    odd = [k for k in kinds if k[1].replace("large_", "") != k[2].replace("large_", "")]
    if left.num_rows != right.num_rows:
        return f"rows {left.num_rows} != {right.num_rows}"
    a, b = rows_of(left, cols), rows_of(right, cols)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diff)} rows differ in {cols}, e.g. {diff[0]}"
    return f"types {odd}" if odd else ""


def main(argv) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from latewing.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if argv[1:] and not any(name.startswith(a) for a in argv[1:]):
            continue
        begin = time.monotonic()
        try:
            df = fn(spark, sf)
            if name in sqls:
                note = compare(df, con, sqls[name])
            else:
                note = f"rows only: {df.count()}"
        except Exception as e:  # keep going, report at the end
            note = f"ERROR {type(e).__name__}: {str(e)[:400]}"
        ok = note == "" or note.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.monotonic() - begin:6.2f}s {note}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
