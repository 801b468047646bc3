import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockloom.operators import pareto


def _frame(spark, values):
    rows = [(f"S{i:05d}", Decimal(str(v))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "stock_id string, rev decimal(28,4)").repartition(7)


def _expected(values):
    positive = [Decimal(str(v)) for v in values if Decimal(str(v)) > 0]
    return {v: sum(x for x in positive if x >= v) for v in set(positive)}, sum(positive)


def test_running_total_matches_brute_force_with_ties(spark):
    rnd = random.Random(5)
    values = [round(rnd.lognormvariate(4, 3), 4) for _ in range(1500)]
    values += [123.45] * 700 + [0, -5, 0.0001, 0.0002, 99.9999, 100, 1000, 999.9999]  # one value on a third of all rows
    got = {r.rev: r.running_total for r in pareto.cumulative_by_value(_frame(spark, values), "rev").collect()}
    want, _ = _expected(values)
    assert got == want


def test_class_cuts_and_shared_ties(spark):
    values = [50, 30, 10, 5, 5]
    rows = {r.stock_id: r for r in pareto.add_abc(_frame(spark, values), "rev").collect()}
    assert [rows[f"S{i:05d}"].abc_class for i in range(5)] == ["A", "A", "B", "C", "C"]
    assert rows["S00003"].running_total == rows["S00004"].running_total == 100


def test_single_item_over_80_percent_is_not_a(spark):
    rows = {r.stock_id: r.abc_class for r in pareto.add_abc(_frame(spark, [90, 5, 5]), "rev").collect()}
    assert rows == {"S00000": "B", "S00001": "C", "S00002": "C"}


def test_rank_is_a_permutation_ordered_by_value(spark):
    rnd = random.Random(9)
    values = [rnd.choice([1, 2, 2.5, 7, 7, 7, 90]) for _ in range(400)]
    ranked = pareto.add_rank(pareto.add_abc(_frame(spark, values), "rev"), "stock_id", "rev").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 401))
    assert all(a.rev >= b.rev for a, b in zip(ranked, ranked[1:]))


def _brute(values):
    import hashlib

    rows = [(f"S{i:05d}", Decimal(str(v))) for i, v in enumerate(values) if v > 0]
    rows.sort(key=lambda r: (-r[1], hashlib.md5(r[0].encode()).hexdigest()[:2], r[0]))
    return {k: (i + 1, sum(x for _, x in rows if x >= v)) for i, (k, v) in enumerate(rows)}


@pytest.mark.parametrize("values", [
    [Decimal(1000) + Decimal(i) / 10_000 for i in range(1200)],  # all in one narrow band
    [7.5] * 1200,  # one value
    [7.5] * 700 + [9, 9, 9] * 100 + [3, 8] * 100 + [0, -1],
    [5], [3, 3], [],
])
def test_ranges_follow_the_data(spark, values):
    rows = pareto.ranged(_frame(spark, values), "stock_id", "rev").collect()
    want = _brute(values)
    assert {r.stock_id: (r["rank"], r.running_total) for r in rows} == want and len(rows) == len(want)
    assert all(r.total_rows == len(want) and r.grand_total == sum(Decimal(str(v)) for v in values if v > 0) for r in rows)


def test_ranges_are_even_even_for_one_value(spark):
    for values in ([7.5] * 4000, [Decimal(i) / 7 for i in range(1, 4001)]):
        df = _frame(spark, [round(float(v), 4) for v in values])
        place = pareto._place("stock_id", "rev")
        bounds = pareto.range_bounds(df, place, "stock_id", 8)
        dealt = df.withColumn("bounds", bounds).select(pareto.range_number(place, F.col("bounds"), 8).alias("part"))
        sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
        assert len(sizes) >= 8 and max(sizes) < 2 * 4000 / 8


def test_limits_give_the_classes(spark):
    rnd = random.Random(3)
    df = _frame(spark, [rnd.choice([0, -2, 1, 5, 5, 40]) * rnd.randint(1, 30) for _ in range(600)])
    limits = pareto.abc_limits(df, "stock_id", "rev")
    got = {r.stock_id: r.c for r in df.withColumn("l", limits).select("stock_id", pareto.class_of("rev", F.col("l")).alias("c")).collect() if r.c}
    assert got == {r.stock_id: r.abc_class for r in pareto.add_abc(df, "rev").collect()} and set(got.values()) == set("ABC")
    alone = _frame(spark, [90, 5, 5])
    got = {r.stock_id: r.c for r in alone.withColumn("l", pareto.abc_limits(alone, "stock_id", "rev")).select("stock_id", pareto.class_of("rev", F.col("l")).alias("c")).collect()}
    assert got == {"S00000": "B", "S00001": "C", "S00002": "C"}


def test_rows_move_once_and_nothing_runs_while_building(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    got = pareto.add_abc(_frame(spark, range(1, 300)), "rev")
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 1 and "broadcast" in joins[0]  # that of the ranges' offsets
