"""Run every named query against its SQL twin: ``python tests/compare.py [sf_dir] [name ...]``."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from flowloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def norm(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        if isinstance(v, float) and v == 0:
            return 0.0
        return v

    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, db, sf_dir, name):
    """None when both sides agree, else a short account of the difference."""
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if not got:
        return "no rows"
    if got != want:
        differing = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(got)} rows, {len(want)} expected, {len(differing)} differ: {differing[:2]}"
    return None


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark, db = local_session(8), connect(sf)
    failed = 0
    for query in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            problem = compare(spark, db, sf, query)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "sql" if query in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:4} {time.time() - start:6.1f}s {query} {problem or ''}", flush=True)
    print("failed:", failed)
