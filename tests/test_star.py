"""The star adapter's derived tables."""

from stockloom.operators import dashboard
from stockloom.sources.star import NATIONS, StarTables


def test_parts_are_dealt_out_before_they_are_multiplied(spark, tmp_path):
    parts = [(k, f"part {k}", "Brand#1", "T", 1, 10.0) for k in (*range(1, 60), 7)]
    schema = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(parts, schema).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    T = StarTables(spark, str(tmp_path))
    want = sorted((f"P{k}", f"L{n:02d}") for k, *_ in parts for n in range(NATIONS) if (k * 7 + n * 13) % 4 == 0)
    assert sorted((r.stock_id, r.location_id) for r in T.stock_balance.collect()) == want
    assert T.stock_balance.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = dashboard.stockout_rate(T)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan.split("Generate explode(", 1)[1]  # below the rows' multiplication
