"""Compare every registered query with its SQL on DuckDB: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from checks import ORACLES, QUERIES
from patternflow import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """What differs, or None; queries without SQL only have to run."""
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return None
    con.execute(ORACLES[name])
    names = [c[0] for c in con.description]
    want = con.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = bag(df.columns, got), bag(names, want)
    if a != b:
        return f"rows {len(got)} vs {len(want)}; only Spark {list((a - b))[:2]}; only SQL {list((b - a))[:2]}"
    return None


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in argv[1:] or QUERIES:
        start = time.perf_counter()
        try:
            diff = difference(spark, con, sf_dir, name)
        except Exception as exc:
            diff = f"{type(exc).__name__}: {str(exc)[:600]}"
        took = time.perf_counter() - start
        state = "ok" if diff is None else "DIFF"
        print(f"{state:5}{name:36}{took:7.2f}s {'' if name in ORACLES else '(rows only)'} {(diff or '')[:900]}", flush=True)
        bad += diff is not None
    print(f"{bad} of {len(argv[1:] or QUERIES)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
