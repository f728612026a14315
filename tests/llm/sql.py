"""DuckDB over the generated tables, beside the queries."""

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def same(query, sql, spark, folder):
    """Rows of the query and of its SQL, columns by name, in order."""
    from pyspark.sql import functions as F

    got = query(spark, folder)
    names = sorted(got.columns)
    rel = connect(folder).sql(sql)
    assert sorted(rel.columns) == names
    left = sorted(map(repr, (tuple(r) for r in got.select(*map(F.col, names)).collect())))
    right = sorted(map(repr, rel.select(", ".join(f'"{n}"' for n in names)).fetchall()))
    assert left == right
    return len(left)
