"""Runs catalogued queries and their SQL side by side."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "item"):
        return value.item()
    return value


def key(row):
    return tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in row)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(normal(row[k]) for k in order) for row in rows), key=key)


def close(x, y) -> bool:
    """Equal, or doubles that a rounding tie moved by one unit of their last digit."""
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-8)
    return x == y


def compare(spark, con, query, sql, sf_dir, exact: bool = False) -> str:
    """Empty when both give the same columns and the same rows; ``exact`` allows no
    difference from rounding ties either."""
    got = query(spark, sf_dir)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(got.columns):
        return f"columns {got.columns} against {columns}"
    table = got.toArrow()
    have = list(zip(*[table.column(k).to_pylist() for k in range(table.num_columns)])) if table.num_columns else []
    a, b = as_rows(got.columns, have), as_rows(columns, want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y and (exact or not all(map(close, x, y)))]
    return f"{len(wrong)} of {len(a)} rows differ, e.g. {wrong[0]}" if wrong else ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from plaidframe.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = build_session(cpus=8), connect(sf_dir)
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, fn, sql[name], sf_dir, exact=True)
            else:
                problem = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{name:34s} {time.time() - start:6.1f}s  {problem or 'ok'}", flush=True)
