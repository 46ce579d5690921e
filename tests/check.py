"""Compare registered queries with their SQL: ``python tests/check.py [folder] [names]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(rows, columns):
    """Rows with columns in name order, sorted; values as text."""

    def show(v):
        if isinstance(v, float) and math.isnan(v):
            return "NaN"
        return repr(v + 0.0 if isinstance(v, float) else v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder) -> str:
    """'' if the query and its SQL agree, else what differs."""
    df = fn(spark, folder)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = canonical(cur.fetchall(), columns)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} differ, e.g. {bad[0]}"[:1500] if bad else ""


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from lumenfold.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con, sqls = build_session("8"), connect(folder), oracle_sql()
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, queries()[name], sqls[name], folder)
            else:
                problem = "" if queries()[name](spark, folder).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        mark = "ok  " if not problem else "FAIL"
        print(f"{mark} {name} {time.time() - start:.1f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    sys.exit(bool(failed))
