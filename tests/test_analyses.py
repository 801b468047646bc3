from datetime import date, timedelta

from pyspark.sql import functions as F

from stockloom.operators import abcxyz, assortment, balance, dashboard, seasonal, sellout, yoy
from tests.tiny import AS_OF, balance as held, product, rows_by, sale, tables


def ago(n):
    return AS_OF - timedelta(days=n)


def test_days_on_hand_and_unsold_marker(spark):
    T = tables(spark, [sale("A", ago(5), 9), sale("A", ago(3), 9, channel="INVOICE"), sale("A", ago(100), 50)],
               [product("A"), product("A", "BOX", 12), product("B")], [held("A", 4), held("B", 7), held("C", 0)])
    r = rows_by(balance.movement_analysis(T, AS_OF, "L1"))
    assert r["A"]["qty_sold_period"] == 18 and r["A"]["days_on_hand"] == 20.0
    assert r["B"]["days_on_hand"] == 999.0 and "C" not in r  # one row per stock although A has two units


def test_balance_probe_lists_each_unit(spark):
    T = tables(spark, [], [product("A1"), product("A1", "BOX", 12), product("B1")], [held("A1", 4), held("B1", 7)])
    assert balance.balance_probe(T, "A").count() == 2
    assert balance.balance_total(T, "A1").collect()[0].total_balance == 4


def test_alert_kinds_in_order(spark):
    sales = [sale("DEAD", ago(40), 5)]
    sales += [sale("SLOW", ago(d), q) for d, q in ((60, 10), (50, 10), (5, 1))]
    sales += [sale("FAST", ago(d), q) for d, q in ((60, 1), (50, 1), (5, 10))]
    sales += [sale("EVEN", ago(d), 5) for d in (60, 5)]
    T = tables(spark, sales, [product(s) for s in ("DEAD", "SLOW", "FAST", "EVEN")], [held("DEAD", 3)])
    out = sellout.movement_alerts(T, AS_OF)
    assert [(r.stock_id, r.alert_type) for r in out.collect()] == [("DEAD", "dead_stock"), ("SLOW", "slow_moving"), ("FAST", "fast_moving")]
    assert {r.alert_type: r.alert_count for r in sellout.alert_summary(out).collect()} == {"dead_stock": 1, "slow_moving": 1, "fast_moving": 1}


def test_selling_day_averages(spark):
    T = tables(spark, [sale("A", ago(20), 4), sale("A", ago(20), 2, channel="INVOICE"), sale("A", ago(2), 2)], [product("A")], [held("A", 8)])
    r = sellout.sellout(T, AS_OF).collect()[0]
    assert (r.active_days, r.avg_daily_sellout, r.days_on_hand, r.trend_status) == (2, 4.0, 2.0, "slow")
    assert r.trend_deviation_pct == -50.0


def test_year_over_year_states(spark):
    this, last = date(2024, 6, 3), date(2023, 6, 3)
    pairs = {"GONE": (0, 10), "DOWN": (5, 10), "UP": (15, 10), "SAME": (10, 10), "NEW": (5, 0), "EDGE": (7, 10)}
    sales = [sale(s, this, c) for s, (c, _) in pairs.items() if c] + [sale(s, last, q) for s, (_, q) in pairs.items() if q]
    got = {k: (v["yoy_status"], v["yoy_change_pct"]) for k, v in rows_by(yoy.yoy(tables(spark, sales, [product(s) for s in pairs]), AS_OF)).items()}
    assert got == {
        "GONE": ("UNDERPERFORMING", -100.0), "DOWN": ("UNDERPERFORMING", -50.0), "UP": ("OUTPERFORMING", 50.0),
        "SAME": ("NORMAL", 0.0), "NEW": ("NEW_THIS_YEAR", 999.0), "EDGE": ("NORMAL", -30.0),
    }


def test_december_pair_ends_in_january():
    assert yoy.month_pair(date(2024, 6, 1), 12) == ((date(2024, 12, 1), date(2025, 1, 1)), (date(2023, 12, 1), date(2024, 1, 1)))


def test_like_for_like(spark):
    this, last = date(2024, 6, 3), date(2023, 6, 3)
    sales = [sale("A", this, 1, 120), sale("A", last, 1, 100), sale("A", this, 1, 60, location="L2"), sale("A", last, 1, 80, location="L3")]
    row = yoy.lfl(tables(spark, sales, [product("A")]), AS_OF)
    r = row.collect()[0]
    assert (r.lfl_cy_revenue, r.lfl_ly_revenue, r.lfl_outlet_count, r.new_outlets_count, r.new_outlets_revenue) == (120, 100, 1, 1, 60)
    m = yoy.lfl_metrics(row).collect()[0]
    assert (m.lfl_growth_pct, m.naive_growth_pct, m.per_outlet_growth_pct, m.expansion_contribution) == (20.0, 0.0, 0.0, 33.3)


def test_outlet_maturity_edges(spark):
    sales = [sale("A", ago(89), location="L1"), sale("A", ago(90), location="L2"), sale("A", ago(180), location="L3")]
    T = tables(spark, sales, [product("A")], locations=("L1", "L2", "L3", "L4"))
    got = {r.location_id: (r.maturity_status, r.alerts_enabled) for r in yoy.outlet_maturity(T, AS_OF).collect()}
    assert got == {"L1": ("NEW", False), "L2": ("RAMPING", True), "L3": ("MATURE", True), "L4": ("MATURE", True)}


def test_seasonal_index_and_peaks(spark):
    sales = [sale("A", date(y, m, 4), 30 if m in (11, 12) else 3) for y in (2021, 2022, 2023) for m in range(1, 13)]
    r = seasonal.seasonal_index(tables(spark, sales, [product("A")])).collect()[0]
    assert r.seasonality_type == "HIGHLY_SEASONAL" and r.seasonal_range == 10.0
    assert r.peak_months == [11, 12] and r.trough_months == list(range(1, 11))  # the list is not cut to three
    p = seasonal.seasonal_patterns(tables(spark, sales, [product("A")]), AS_OF).collect()[0]
    assert p.top_3_peak_months == [11, 12, 1] and p.seasonality_class == "HIGH_VARIANCE"


def test_smart_variation_classes(spark):
    months = [date(2024, 6, 1) - timedelta(days=30 * i) for i in range(1, 9)]
    sales = []
    for i, d in enumerate(months):
        sales += [sale("PROMO", d, 10)] + ([sale("PROMO", d + timedelta(days=2), 90, promo=True)] if i % 4 == 0 else [])
        sales += [sale("SEASON", d, 100 if i == 0 else 20), sale("FLAT", d, 10)]
    T = tables(spark, sales, [product(s) for s in ("PROMO", "SEASON", "FLAT")])
    got = {r.stock_id: r.demand_pattern for r in seasonal.smart_cv(T, AS_OF).collect()}
    assert got == {"PROMO": "PROMO_DRIVEN", "SEASON": "TRUE_SEASONAL", "FLAT": "STABLE"}


def test_abc_pieces(spark):
    sales = [sale(f"S{i}", ago(10 + 31 * m), 1 + m * (i % 3), v, unit_cost=1) for i, v in enumerate([50, 30, 10, 5, 5]) for m in range(3)]
    T = tables(spark, sales, [product(f"S{i}", ud1="FLTHB" if i == 4 else None, name="FISH OIL" if i == 3 else "PLAIN") for i in range(5)], [held("S0", 9)])
    abc = abcxyz.abc_xyz(T, AS_OF).cache()
    assert [r.abc_class for r in abc.orderBy("stock_id").collect()] == ["A", "A", "B", "C", "C"]
    scored = abcxyz.health_score_v1(abc)
    flags = {r.stock_id: (r.is_branded, r.is_protected) for r in scored.collect()}
    assert flags["S3"] == (True, True) and flags["S4"] == (False, True) and flags["S0"] == (False, False)
    matrix = abcxyz.abc_xyz_matrix(abc).collect()
    assert len(matrix) == 9 and sum(r.sku_count for r in matrix) == 5
    assert sum(r.sku_count for r in abcxyz.abc_distribution(abc).collect()) == 5
    assert all(not r.stock_id.startswith("S3") for r in abcxyz.delist_candidates(scored, max_score=101).collect())


def test_dashboard_rows_and_empty_inventory(spark):
    T = tables(spark, [sale("A", ago(5), 2)], [product("A"), product("B")], [held("A", 4), held("B", 0)])
    cards = {r.metric: (r.value, r.status) for r in dashboard.scorecard(dashboard.metrics(T, AS_OF)).collect()}
    assert len(cards) == 7 and cards["stock_out_rate"] == (50.0, "critical") and cards["dead_stock_pct"] == (0.0, "good")
    empty = tables(spark, [], [product("A")], [])
    assert {r.metric: r.value for r in dashboard.scorecard(dashboard.metrics(empty, AS_OF)).collect()}["expiry_risk_value"] == 0.0


def test_missing_code_counts_as_stockable(spark):
    T = tables(spark, [], [product("A", ud1=None), product("B", ud1="SPECIAL REQUEST"), product("C", ud1="NA")], [held("C", 2)])
    r = assortment.true_stockout(T).collect()[0]
    assert (r.total_active_skus, r.stockable_skus, r.stockout_stockable, r.special_request_skus, r.true_stockout_rate) == (3, 2, 1, 1, 50.0)


def test_must_have_and_confidence(spark):
    sales = [sale("A", ago(30 * i + 3), 1, 10, unit_cost=8) for i in range(11)] + [sale("B", ago(30 * i + 3), 1, 10, unit_cost=8) for i in range(7)]
    T = tables(spark, sales, [product("A", name="Panadol x", ud1=None), product("B", name="panadol y", ud1="FLTHB")])
    got = assortment.must_have_confidence(assortment.must_have(T, AS_OF)).collect()
    assert [(r.stock_id, r.confidence) for r in got] == [("A", "high")]
