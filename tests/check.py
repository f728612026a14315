"""Run queries beside their SQL: ``python tests/check.py SF [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = "region nation customer supplier part orders lineitem".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].astype(float)
        elif pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(bool)
        elif pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].astype("int64")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    a, b = normal(left), normal(right)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} / {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    types = [(c, str(x), str(y)) for c, x, y in zip(a.columns, a.dtypes, b.dtypes) if x != y]
    try:
        pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=True)
    except AssertionError as e:
        return f"{types} {str(e)[:600]}"
    return f"types {types}" if types else None


def main(sf: str, names: list[str]) -> int:
    from sparkwalk.oracle import ORACLE
    from sparkwalk.session import local_session
    from sparkwalk.workload import QUERIES

    folder = f"/root/testdata/sf{sf}"
    spark, con, bad = local_session(), connect(folder), 0
    for name in names or QUERIES:
        t0 = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:700]}", flush=True)
            continue
        t1 = time.time()
        if name not in ORACLE:
            print(f"{name}: {len(got)} rows, no SQL, {t1 - t0:.1f} s", flush=True)
            continue
        try:
            diff = differences(got, con.sql(ORACLE[name]).df())
        except Exception as e:  # noqa: BLE001
            diff = f"SQL {type(e).__name__} {str(e)[:700]}"
        bad += diff is not None
        print(f"{name}: {'ok' if diff is None else 'DIFFERS ' + diff} {len(got)} rows, {t1 - t0:.1f} s + {time.time() - t1:.1f} s", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
