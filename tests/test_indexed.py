"""Stored order, search index and many-pattern match against the plain forms."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import contains_any, like_text
from stockloom.operators import outlet, paging, textindex

WORDS = ["Blackmores", "fish oil", "MULTIVITAMIN", "Ring", "ring%", "a_b", "ÉTÉ", "ß", "x", "Tiger Balm", "ORAL-B", "naïve", "50\\%", "Vitamin C", "now foods"]


def names(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(f"P{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4))) if i % 9 else None, f"B{i:04d}") for i in range(n)]
    return spark.createDataFrame(rows, "stock_id string, stock_name string, barcode string")


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    df = names(spark)
    index = textindex.SearchIndex(spark, str(tmp_path), ["stock_id", "stock_name", "barcode"], buckets=8)
    index.build(df, 1)
    needles = ["r", "RI", "ring", "Ring", "ring%", "g%r", "a_b", "fish oil", "B00", "P39", "été", "zzz", "ring zzz", "\\%", "50\\%", "vitaminx", " ", "tamin c", "%%", "n%w f__ds"]
    for needle in needles:
        want = sorted(r.stock_id for r in df.filter(like_text(["stock_id", "stock_name", "barcode"], needle)).collect())
        assert sorted(r.stock_id for r in index.search(df, needle).collect()) == want, needle
    assert index.candidates("ri") is None and index.candidates("zzz").count() == 0
    plan = index.search(df, "fish oil")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
    # the next version replaces the lists; the number of buckets is remembered
    again = textindex.SearchIndex(spark, str(tmp_path), ["stock_id", "stock_name", "barcode"])
    again.build(names(spark, 50, 2), 2)
    assert again.buckets == 8 and again.search(names(spark, 50, 2), "ring").count() == names(spark, 50, 2).filter("stock_name ilike '%ring%'").count()


def test_many_patterns_equal_one_contains_each(spark):
    df = names(spark, 600, 3)
    for brands in (config.PROTECTED_BRANDS, config.MUST_HAVE_BRANDS):
        patterns = spark.createDataFrame([(b,) for b in brands], "pattern string")
        want = sorted(r.stock_id for r in df.filter(contains_any("stock_name", brands)).collect())
        assert sorted(r.stock_id for r in textindex.matched(df, "stock_id", "stock_name", patterns).collect()) == want and want


def test_ten_thousand_and_short_patterns(spark):
    rng = random.Random(8)
    df = names(spark, 300, 4)
    many = ["".join(rng.choice("ABCDEFGILMNORSTUVX ") for _ in range(rng.randint(1, 6))) for _ in range(10_000)]
    patterns = spark.createDataFrame([(p,) for p in many], "pattern string")
    rows = df.select("stock_id", F.upper("stock_name").alias("t")).collect()
    for shortest in (1, 2, 3):
        want = sorted(r.stock_id for r in rows if r.t is not None and any(p in r.t for p in many if len(p) >= shortest))
        assert sorted(r.stock_id for r in textindex.matched(df, "stock_id", "stock_name", patterns, shortest=shortest).collect()) == want
    assert textindex.matched(df, "stock_id", "stock_name", patterns.limit(0)).count() == 0


def test_exploded_texts_are_not_broadcast(spark):
    patterns = spark.createDataFrame([("RING",)], "pattern string")
    plan = textindex.matched(names(spark, 50), "stock_id", "stock_name", patterns)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_stored_order_pages_like_the_window(spark, tmp_path):
    rng = random.Random(2)
    # one outlet holds most rows; many ties and nulls
    pick = lambda: rng.choice([None, Decimal(1), Decimal(2), Decimal("7.5")])
    rows = [(rng.choice(["L1"] * 5 + ["L2", "L3"]), f"S{i:05d}", pick(), pick()) for i in range(3000)]
    o = spark.createDataFrame(rows, "location_id string, stock_id string, outlet_ams decimal(18,4), current_balance decimal(18,4)").repartition(5)
    order = paging.OutletOrder(spark, str(tmp_path))
    order.rebuild(o, 1)
    for after, limit in ((0, 10), (100, 200), (1500, 400), (5000, 10)):
        assert sorted(map(tuple, order.page(after, limit).collect()), key=str) == sorted(map(tuple, outlet.outlet_page(o, after, limit).collect()), key=str)
    one = order.page(20, 5, "L2")
    assert [r.row_num for r in one.orderBy("row_num").collect()] == [21, 22, 23, 24, 25]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "GreaterThan(row_num,20)" in plan
    assert len(order.store.current()["tables"]["rows"]) >= 6  # the large outlet is cut too
    order.rebuild(o.filter("location_id = 'L3'"), 2)
    assert {r.location_id for r in order.page(0, 9).collect()} == {"L3"}
