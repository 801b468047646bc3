from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from stockloom.operators import facts
from stockloom.plans import monthly, summary
from tests.tiny import AS_OF, balance, frame, product, rows_by, sale, tables


def _dec(spark, rows, names):
    schema = ", ".join(f"{n} decimal(18,4)" for n in names) + ", k string"
    from decimal import Decimal

    return spark.createDataFrame([tuple(Decimal(str(x)) for x in r[:-1]) + (r[-1],) for r in rows], schema)


def test_trend_boundaries(spark):
    # week and month quantities giving exactly 1.5x, 1.2x, 0.8x and 0.5x the daily rate
    rows = [
        (0, 0, 0, "DEAD"), (0, 0, 5, "STABLE"), (10.5, 30, 60, "STABLE_1.5"), (7, 30, 60, "STABLE"), (8.4, 30, 60, "STABLE"),
        (8.5, 30, 60, "ACCELERATING"), (10.6, 30, 60, "SPIKE_UP"), (5.6, 30, 60, "STABLE"), (5.5, 30, 60, "DECELERATING"),
        (3.5, 30, 60, "DECELERATING"), (3.4, 30, 60, "SPIKE_DOWN"),
    ]
    df = _dec(spark, rows, ["q7", "q30", "q90"]).withColumn("t", summary.trend_status(F.col("q7"), F.col("q30"), F.col("q90")))
    for r in df.collect():
        want = "ACCELERATING" if r.k == "STABLE_1.5" else r.k  # exactly 1.5x is not above it
        assert r.t == want, r


def test_risk_boundaries(spark):
    rows = [
        (0, 30, "STOCKOUT"), (-1, 0, "STOCKOUT"), (7, 30, "CRITICAL"), (7.1, 30, "WARNING"), (14, 30, "WARNING"), (45, 30, "OK"),
        (46, 30, "UNKNOWN"), (90, 30, "UNKNOWN"), (91, 30, "OVERSTOCKED"), (5, 0, "UNKNOWN"),
    ]
    df = _dec(spark, rows, ["bal", "q30"]).withColumn("t", summary.stockout_risk(F.col("bal"), F.col("q30")))
    assert all(r.t == r.k for r in df.collect())


def test_variation_needs_three_months_and_cuts_at_half_and_one(spark):
    day = AS_OF.replace(day=1)
    month = lambda n: (day - timedelta(days=31 * n)).replace(day=5)
    sales = []
    for stock, series in {"TWO": [5, 9], "HALF": [1, 2, 3], "ONE": [0.5, 0.5, 5], "FLAT": [4, 4, 4]}.items():
        sales += [sale(stock, month(i + 1), q, doc=i) for i, q in enumerate(series)]
    T = tables(spark, sales, [product(s) for s in ("TWO", "HALF", "ONE", "FLAT")], [])
    s = rows_by(summary.movement_summary(T, AS_OF))
    assert s["TWO"]["cv_value"] is None and s["TWO"]["xyz_class"] == "Z"
    assert s["HALF"]["cv_value"] == 0.5 and s["HALF"]["xyz_class"] == "Y"
    assert s["FLAT"]["xyz_class"] == "X" and s["FLAT"]["stability_score"] == 100.0
    assert s["ONE"]["xyz_class"] == "Z"


def test_units_convert_and_order_unit_follows_purchases(spark):
    products = [product("A"), product("A", "STRIP", 10), product("A", "BOX", 100), product("N")]
    sales = [sale("A", AS_OF, 2, uom="BOX"), sale("A", AS_OF, 3, uom="STRIP"), sale("A", AS_OF, 4)]
    orders = [dict(doc_id=i, stock_id="A", uom_id=u) for i, u in enumerate(["STRIP", "BOX", "STRIP"])]
    invoices = [dict(doc_id=9, doc_date=AS_OF, location_id="WAREHOUSE", stock_id="A", uom_id="BOX", qty=1, unit_price=7)] * 5
    T = tables(spark, sales, products, [balance("A", 3, uom="BOX"), balance("A", 5)], orders=orders, invoices=invoices)
    s = rows_by(summary.movement_summary(T, AS_OF))
    assert s["A"]["qty_last_7d"] == 234 and s["A"]["current_balance"] == 305
    assert (s["A"]["order_uom"], s["A"]["order_uom_rate"]) == ("STRIP", 10.0)
    assert s["A"]["selling_days_30d"] == 1
    assert s["N"]["order_uom"] == "PCS" and s["N"]["trend_status"] == "DEAD" and s["N"]["doi_score"] == 0.0
    plain = rows_by(summary.movement_summary(T, AS_OF, base_uom=False))
    assert plain["A"]["qty_last_7d"] == 9 and plain["A"]["current_balance"] == 8


def test_largest_active_unit_when_never_bought(spark):
    T = tables(spark, [], [product("A"), product("A", "BOX", 12), product("A", "CASE", 48, active="N")], [])
    r = summary.purchase_uom(T).collect()[0]
    assert (r.order_uom, float(r.order_uom_rate)) == ("BOX", 12.0)


def test_last_purchase_and_cost_fallback(spark):
    inv = [
        dict(doc_id=1, doc_date=AS_OF - timedelta(days=9), location_id="W", stock_id="A", uom_id="PCS", qty=1, unit_price=5),
        dict(doc_id=2, doc_date=AS_OF, location_id="W", stock_id="A", uom_id="PCS", qty=1, unit_price=0),
        dict(doc_id=3, doc_date=AS_OF - timedelta(days=3), location_id="W", stock_id="A", uom_id="PCS", qty=1, unit_price=6),
    ]
    T = tables(spark, [], [product("A"), product("B", ref=9), product("C", cost=2)], [], invoices=inv)
    s = summary.add_last_purchase(summary.movement_summary(T, AS_OF), T.supplier_invoice_line)
    cost = {k: v["unit_cost"] for k, v in rows_by(summary.unit_cost_fallback(s, T.stock_master)).items()}
    assert cost == {"A": 6.0, "B": 9.0, "C": 2.0}


def test_pivot_floors_a_month_of_returns(spark):
    this = AS_OF.replace(day=2)
    prev = (this - timedelta(days=5)).replace(day=3)
    led = [
        dict(stock_id="A", uom_id="PCS", location_id="L1", doc_type="CUS_INVOICE", doc_date=d, qty_out=q, root_uom_qty_out=q, unit_price=1)
        for d, q in ((this, -4), (prev, 6))
    ] + [dict(stock_id="A", uom_id="PCS", location_id="L1", doc_type="TRANSFER", doc_date=this, qty_out=9, root_uom_qty_out=9, unit_price=1)]
    T = tables(spark, [], [product("A"), product("B")], [balance("A", 5)], ledger=led)
    r = monthly.monthly_pivot(T.stock_ledger, AS_OF).collect()[0]
    assert (float(r.qty_m1), float(r.qty_m2), float(r.qty_m3)) == (0, 6, 0)
    m = rows_by(monthly.monthly_analysis(summary.movement_summary(T, AS_OF), T, AS_OF))
    assert m["A"]["ams_3m"] == 2.0 and m["A"]["velocity_category"] == "SLOW" and m["A"]["reorder_point"] == 1.0
    assert m["B"]["qty_m1"] == 0 and m["B"]["seasonality_type"] == "DEAD" and m["B"]["reorder_recommendation"] == "STOCKOUT"
    assert m["A"]["base_uom_desc"] == "Piece"


def test_scores_stay_in_range_and_counts_add_up(spark):
    sales = [sale(f"P{i}", AS_OF - timedelta(days=i), 1 + i % 5, 10 + i) for i in range(40)]
    T = tables(spark, sales, [product(f"P{i}", ud1="FLTHB" if i % 4 == 0 else None) for i in range(40)], [balance(f"P{i}", i) for i in range(40)])
    s = summary.movement_summary(T, AS_OF)
    for r in s.collect():
        for c in ("volume_score", "revenue_score", "doi_score", "strategic_score"):
            assert 0 <= r[c] <= 100
    stats = summary.summary_stats(s).collect()[0]
    assert stats.total_skus == 40 == sum(r["count"] for r in s.groupBy("trend_status").count().collect())


def test_invoice_lines_take_master_cost(spark):
    T = tables(spark, [sale("A", channel="INVOICE", unit_cost=None), sale("Z", channel="INVOICE", unit_cost=None)], [product("A", cost=3)], [])
    cost = {r.stock_id: float(r.unit_cost) for r in facts.invoice_sales(T).collect()}
    assert cost == {"A": 3.0, "Z": 0.0}


@pytest.mark.parametrize("run", [1])
def test_stored_summary_reads_latest(spark, tmp_path, run):
    from stockloom.plans.refresh import latest_summary, store_summary

    T = tables(spark, [sale("A")], [product("A")], [])
    s = summary.movement_summary(T, AS_OF)
    store_summary(s.withColumn("health_score", F.lit(-1.0)), str(tmp_path), run)
    store_summary(s, str(tmp_path), run + 1)
    assert latest_summary(spark, str(tmp_path)).collect()[0].health_score != -1.0
    # a run that is still being written is no run yet
    s.withColumn("health_score", F.lit(-2.0)).write.parquet(str(tmp_path / "stock_movement_summary" / f"run={run + 2}"))
    assert latest_summary(spark, str(tmp_path)).collect()[0].health_score != -2.0


def test_old_runs_are_not_opened_and_can_be_dropped(spark, tmp_path):
    from stockloom.plans.refresh import drop_old_runs, latest_summary, store_summary

    T = tables(spark, [sale("A")], [product("A")], [])
    s = summary.movement_summary(T, AS_OF)
    for run in (1, 2, 3):
        store_summary(s.withColumn("health_score", F.lit(float(run))), str(tmp_path), run)
    (tmp_path / "stock_movement_summary" / "run=1" / "broken.parquet").write_bytes(b"no parquet")
    assert latest_summary(spark, str(tmp_path)).collect()[0].health_score == 3.0
    assert drop_old_runs(spark, str(tmp_path), keep=1) == [2, 1]
    assert latest_summary(spark, str(tmp_path)).collect()[0].health_score == 3.0


def test_streamed_day_sums_give_the_same_summary(spark, tmp_path):
    from stockloom.sources.schemas import SALES_LINE
    from stockloom.streaming import refresh

    sales = [sale(f"P{i % 5}", AS_OF - timedelta(days=7 * i), 1 + i, 10 * i, channel="CASH" if i % 3 else "INVOICE") for i in range(60)]
    T = tables(spark, sales, [product(f"P{i}") for i in range(5)], [balance("P1", 4)])
    src = str(tmp_path / "lines")
    for k in range(3):
        frame(spark, "sales_line", sales[k::3]).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SALES_LINE).option("maxFilesPerTrigger", 2).parquet(src)
    q = refresh.store_day_sums(stream, str(tmp_path / "grain"), str(tmp_path / "ck"), {"availableNow": True})
    q.awaitTermination(120)
    got = refresh.refreshed_summary(T, str(tmp_path / "grain"), AS_OF, spark)
    assert sorted(got.collect()) == sorted(summary.movement_summary(T, AS_OF).collect())
    # the same checkpoint goes on under its own name; a fresh one may not count the lines again
    again = refresh.store_day_sums(stream, str(tmp_path / "grain"), str(tmp_path / "ck"), {"availableNow": True})
    again.awaitTermination(120)
    assert sorted(refresh.refreshed_summary(T, str(tmp_path / "grain"), AS_OF, spark).collect()) == sorted(got.collect())
    with pytest.raises(ValueError):
        refresh.store_day_sums(stream, str(tmp_path / "grain"), str(tmp_path / "new"), {"availableNow": True})
    more = str(tmp_path / "more")
    frame(spark, "sales_line", [sale("P1", AS_OF, 1, 10)]).write.parquet(more)
    other = spark.readStream.schema(SALES_LINE).parquet(more)
    refresh.store_day_sums(other, str(tmp_path / "grain"), str(tmp_path / "ck2"), {"availableNow": True}, another_source=True).awaitTermination(120)
    T = tables(spark, [*sales, sale("P1", AS_OF, 1, 10)], [product(f"P{i}") for i in range(5)], [balance("P1", 4)])
    assert sorted(refresh.refreshed_summary(T, str(tmp_path / "grain"), AS_OF, spark).collect()) == sorted(summary.movement_summary(T, AS_OF).collect())
