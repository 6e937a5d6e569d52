"""Run registered queries on Spark and their SQL on DuckDB, and compare every value.

    python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cpus: str = "8", checkpoints: str | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]")
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    spark = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_canon(r[i]) for i in order) for r in rows)


#: Results are rounded to six places; a value beside a half may go either way.
TOLERANCE = 1.5e-6


def _near(a: list[tuple], b: list[tuple]) -> bool:
    """Whether the rows left over on both sides differ by no more than the rounding."""

    def number(text):
        try:
            return float(text)
        except ValueError:
            return None

    plain = lambda row: [round(n, 3) if (n := number(v)) is not None else v for v in row]
    for x, y in zip(sorted(a, key=lambda r: repr(plain(r))), sorted(b, key=lambda r: repr(plain(r)))):
        for v, w in zip(x, y):
            n, m = number(v), number(w)
            if v != w and (n is None or m is None or not abs(n - m) <= TOLERANCE):
                return False
    return len(a) == len(b)


def check(spark, con, q, sf_dir, inspect=None) -> tuple[bool, str]:
    t0 = time.time()
    df = q.run(spark, sf_dir)
    if inspect:
        inspect(df)
    got = df.collect()
    t1 = time.time()
    sql = q.oracle()
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)} ({t1 - t0:.1f}s)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(names)}"
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(names, want)
    nulls = sum(1 for r in got if any(v is None for v in r))
    note = f"{len(got)} rows, {nulls} with null ({t1 - t0:.1f}s / {t2 - t1:.1f}s)"
    if a == b:
        return len(got) > 0, note
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    if got and _near(only_a, only_b):
        return True, f"{note}; {len(only_a)} rows differ in the last place"
    return False, (
        f"{note}; {sorted(df.columns)}\n   {len(only_a)} only Spark {sorted(only_a)[:4]}"
        f"\n   {len(only_b)} only SQL {sorted(only_b)[:4]}"
    )


def main() -> int:
    from marshlight.plans import all_queries

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name, q in all_queries().items():
        if args[1:] and not any(name.startswith(p) for p in args[1:]):
            continue
        try:
            ok, note = check(spark, con, q, sf_dir)
        except Exception as e:  # a broken query must not hide the others
            ok, note = False, f"{type(e).__name__}: {str(e)[:1200]}"
        bad += not ok
        print(("ok  " if ok else "FAIL"), name, note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
