"""Side-by-side comparison of registered queries with their SQL in DuckDB."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def _types(schema) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in schema}


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> str | None:
    """None when equal, otherwise what differs."""
    if sql is None:
        return "no SQL"
    got = query(spark, folder).toArrow()
    want = con.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {got.column_names} vs {want.column_names}"
    a, b = _types(got.schema), _types(want.schema)
    diff = {c: (a[c], b[c]) for c in a if a[c] != b[c]}
    if got.num_rows != want.num_rows:
        return f"{got.num_rows} rows vs {want.num_rows}; types {diff}"
    left = _rows(got.column_names, zip(*[c.to_pylist() for c in got.columns]))
    right = _rows(want.column_names, zip(*[c.to_pylist() for c in want.columns]))
    wrong = [(x, y) for x, y in zip(left, right) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, columns {sorted(a)}: {str(wrong[0])[:1500]}"
    return f"types {diff}" if diff else None


def main(folder: str, *names: str) -> int:
    from ragspark import build_session
    from ragspark.queries import ORACLES, QUERIES

    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:400]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(*sys.argv[1:])))
