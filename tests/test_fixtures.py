"""Tables derived from generated ones that the small samples do not show."""

from pyspark.sql import functions as F

from sparkwalk.fixtures import table


def test_trips_on_a_tall_network(spark, tmp_path):
    """The ends of a trip may lie so far apart that the square of their distance leaves 64 bits."""
    keys = spark.range(700_000).select(F.col("id").alias("p_partkey"), F.lit(0).alias("p_size"))
    tables = {
        "part": keys,
        "customer": spark.createDataFrame([(0, 1.0)], "c_custkey bigint, c_acctbal double"),
        "supplier": spark.createDataFrame([(0,), (53_846,)], "s_suppkey bigint"),
        "orders": spark.createDataFrame([(1, 0)], "o_orderkey bigint, o_custkey bigint"),
        "lineitem": spark.createDataFrame([(1, 0), (1, 0), (1, 53_846)], "l_orderkey bigint, l_suppkey bigint"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    assert [(r.dest_odpt, r.n_ods, r.vid_o, r.vid_d) for r in table(spark, str(tmp_path), "od").collect()] == [("s0", 2, 0, 0)]
