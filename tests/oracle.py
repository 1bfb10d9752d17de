"""Run registered queries against their SQL on an independent engine and compare values.

    python tests/oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return tuple(_cell(v) for v in (x.tolist() if hasattr(x, "tolist") else x))
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return float(x)
    if isinstance(x, (pd.Timestamp,)):
        return x.to_pydatetime().isoformat()
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).to_pydatetime().isoformat()
    if isinstance(x, float):
        return x + 0.0
    return x if isinstance(x, str) else float(x) if hasattr(x, "is_nan") else x


def rows_of(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    rows = [tuple(_cell(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)]
    return columns, sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    a_cols, a = rows_of(spark_frame)
    b_cols, b = rows_of(sql_frame)
    if a_cols != b_cols:
        return f"columns: only spark {sorted(set(a_cols) - set(b_cols))}, only sql {sorted(set(b_cols) - set(a_cols))}"
    if len(a) != len(b):
        return f"rows: spark {len(a)}, sql {len(b)}"
    left, right = set(a), set(b)
    if left == right:
        return None
    only_a, only_b = sorted(left - right, key=str), sorted(right - left, key=str)
    counts = {}
    for x, y in zip(only_a, only_b):
        for c, u, w in zip(a_cols, x, y):
            if u != w:
                counts.setdefault(c, [0, u, w])[0] += 1
    return f"{len(only_a)} rows differ of {len(a)}: {counts}"


def main() -> None:
    from catalog import ORACLE, QUERIES
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, bad = make_session(), connect(sf_dir), []
    if "GROUP_ROWS" in os.environ:  # treat small groups as hot
        spark.conf.set("formline.groupRows", os.environ["GROUP_ROWS"])
        spark.conf.set("formline.probeBytes", "0")
    for name, run in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in ORACLE:
                print(f"rows  {name} {len(got)} {took:.1f}s", flush=True)
                continue
            problem = compare(got, con.sql(ORACLE[name]).df())
            if problem is None and len(got) == 0:
                problem = "no rows"
        except Exception as error:  # noqa: BLE001 - report every query
            problem, took = f"{type(error).__name__}: {str(error)[:900]}", time.time() - start
        print(f"{'ok   ' if problem is None else 'FAIL '} {name} {took:.1f}s {problem or len(got)}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
