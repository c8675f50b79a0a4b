"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows.

    python tests/oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """(problem or None, row count)."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return (None if got else "no rows"), len(got)
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    want = rows_of(columns, answer.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}", len(got)
    for g, w in zip(got, want):
        if g != w:
            return f"first difference:\n   spark {str(g)[:600]}\n   sql   {str(w)[:600]}", len(got)
        if [type(x) for x in g] != [type(x) for x in w]:
            return f"types differ: {g} {w}", len(got)
    return None, len(got)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from clauseflow.session import build_session

    sf_dir, *names = sys.argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    registered, sqls = queries(), oracle_sql()
    for name in names or registered:
        start = time.time()
        try:
            problem, count = compare(spark, con, name, registered[name], sqls.get(name), sf_dir)
        except Exception as exc:  # keep going: one broken query must not hide the others
            problem, count = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        bad += problem is not None
        mark = "BAD " if problem else ("ok  " if name in sqls else "rows")
        print(f"{mark} {name:28s} {count:8d} rows {time.time() - start:6.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
