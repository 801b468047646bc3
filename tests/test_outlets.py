import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockloom.operators import expiry, outlet, purchasing, sku, transfer
from tests.tiny import AS_OF, frame, product, tables


def outlet_row(loc, stock, ams=0.0, bal=0, rec="OPTIMAL", doi=None, total=None, region=1, **more):
    total = ams * 12 if total is None else total
    base = dict(
        location_id=loc, location_name=f"R{region} - {loc}", stock_id=stock, stock_name=stock, total_12m=total, outlet_ams=ams, current_balance=bal,
        days_of_inventory=doi if doi is not None else (bal / (ams / 30) if ams else 9999), order_uom_rate=1, reorder_recommendation=rec,
        outlet_demand_pattern="STABLE", outlet_momentum_status="STEADY", outlet_trend_index=1, outlet_abc_class="A", is_active=True, ud1_code="NA",
    )
    return base | more


def outlets(spark, rows):
    return frame(spark, "outlet_sku", [{k: (round(v, 4) if isinstance(v, float) else v) for k, v in r.items()} for r in rows])


SUMMARY = (
    "stock_id string, stock_name string, order_uom_stock_name string, order_uom string, order_uom_rate double, ud1_code string,"
    " demand_pattern string, abc_class string, gp_abc_class string, is_active boolean"
)


def summary(spark, rows):
    return spark.createDataFrame(rows, SUMMARY)


def known(stock, ud1="NA", pattern="STABLE", abc="A", rate=1.0):
    return (stock, stock, stock, "PCS", rate, ud1, pattern, abc, "A", True)


def test_threshold_table(spark):
    t = {(r.velocity_tier, r.pattern_category, r.house): (r.doi_threshold, float(r.excess_months)) for r in transfer.thresholds(spark).collect()}
    assert len(t) == 32
    assert t["FAST", "SPORADIC", True] == (210, 4.0) and t["FAST", "DECLINING", False] == (15, 0.5)
    assert t["MEDIUM", "GROWING", True] == (135, 1.5) and t["VERY_SLOW", "STABLE", False] == (180, 3.0)


def _random_chain(spark, seed, n_outlets=9, n_stocks=12):
    rnd = random.Random(seed)
    rows = []
    for i in range(n_outlets):
        for j in range(n_stocks):
            ams = rnd.choice([0, 0.5, 2, 6, 20, 60])
            bal = rnd.choice([0, 1, 5, 30, 100, 900])
            rec = "STOCKOUT" if bal == 0 else rnd.choice(["ORDER_NOW", "ORDER_SOON", "OPTIMAL", "STOP_ORDERING"])
            loc = "WAREHOUSE" if i == 0 else f"L{i}"
            name = {"location_name": loc} if i in (0, 3) else {}
            rows.append(outlet_row(loc, f"S{j}", float(ams), bal, rec, region=i % 3, **name))
    pats = ["STABLE", "GROWTH", "DECLINE", "SPORADIC"]
    return outlets(spark, rows), summary(spark, [known(f"S{j}", "FLTHB" if j % 5 == 0 else "NA", pats[j % 4]) for j in range(n_stocks)])


def _region(name):
    return name.split(" ")[0] if name.startswith("R") else None


@pytest.mark.parametrize("seed", [1, 2])
def test_best_partner_equals_trying_every_pair(spark, seed):
    o, s = _random_chain(spark, seed)
    pos = transfer.positions(o, s)
    have = transfer.excess(pos).collect()
    want = transfer.need(pos).collect()
    pseudo = {"WAREHOUSE"}
    best_out, best_in = {}, {}
    for h in have:
        pairs = [w for w in want if w.stock_id == h.stock_id and w.location_id != h.location_id and w.location_id not in pseudo]
        if pairs:
            best_out[h.location_id, h.stock_id] = min(
                pairs, key=lambda w: (0 if w.region and w.region == h.region else 1, w.doi, -w.need_qty, w.location_id)
            ).location_id
    for w in want:
        pairs = [h for h in have if h.stock_id == w.stock_id and h.location_id != w.location_id and h.location_id not in pseudo]
        if pairs:
            best_in[w.location_id, w.stock_id] = min(
                pairs, key=lambda h: (0 if h.region and h.region == w.region else 1, -h.excess_qty, -h.doi, h.location_id)
            ).location_id
    got_out = transfer.transfers_out(o, s).collect()
    assert {(r.from_outlet, r.stock_id): r.to_outlet for r in got_out} == best_out and best_out
    assert {(r.to_outlet, r.stock_id): r.from_outlet for r in transfer.transfers_in(o, s).collect()} == best_in and best_in
    for r in got_out:
        assert r.transfer_qty <= r.excess_qty_order_uom and r.transfer_qty <= r.need_qty_order_uom
        assert (r.transfer_reason == "SAME_REGION") == (_region(r.from_outlet_name) is not None and _region(r.from_outlet_name) == _region(r.to_outlet_name))
    one = transfer.rotation(o, s, "L1").collect()
    assert {r.stock_id for r in one if r.direction == "OUT"} == {k[1] for k in best_out if k[0] == "L1"}


def test_fair_share_invariants(spark):
    o = outlets(spark, [outlet_row("L1", "S", 10.0, 28), outlet_row("L2", "S", 10.0, 1), outlet_row("L3", "S", 10.0, 0), outlet_row("L4", "S", 0.0, 0)])
    s = summary(spark, [known("S")])
    short = transfer.supply_constrained(o, s)
    c = short.collect()[0]
    assert (c.urgency_tier, c.outlet_count, c.priority_score) == ("URGENT", 3, 6.0)
    fs = transfer.fair_share(o, short)
    rows = {r.location_id: r for r in fs.collect()}
    assert abs(sum(r.fair_share_qty for r in rows.values()) - 29) < 1e-9
    assert [rows[k].classification for k in ("L1", "L2", "L3")] == ["DONOR", "RECIPIENT", "RECIPIENT"]
    assert rows["L1"].can_donate_qty <= 0.8 * rows["L1"].fair_share_deviation + 1e-9
    given = transfer.rebalance(fs, s, "L1").collect()
    assert {(r.direction, r.to_outlet) for r in given} == {("DONATE", "L2"), ("DONATE", "L3")}
    assert {(r.direction, r.from_outlet) for r in transfer.rebalance(fs, s, "L2").collect()} == {("RECEIVE", "L1")}


def test_suggestions_skip_what_sells_here(spark):
    rows = [outlet_row(f"L{i}", s, 6.0) for i in range(1, 5) for s in ("GOOD", "HERE")]
    rows += [outlet_row("X", "HERE", 2.0), outlet_row("WAREHOUSE", "GOOD", 99.0), outlet_row("L1", "LONE", 9.0)]
    o, s = outlets(spark, rows), summary(spark, [known("GOOD"), known("HERE"), known("LONE")])
    got = outlet.suggest(o, s, "X").collect()
    assert [r.stock_id for r in got] == ["GOOD"]
    r = got[0]
    # four outlets 17, six a month 10, stable 10, margin A 15; category: 1 stock here against a mean of 2.0 or more
    assert r.confidence_score == r.regional_success_score + r.demand_strength_score + r.growth_trajectory_score + r.profitability_score + r.category_gap_score
    assert (r.regional_success_score, r.demand_strength_score, r.growth_trajectory_score, r.profitability_score) == (17, 10, 10, 15)
    assert r.predicted_monthly_sales == 4.2 and r.suggested_initial_qty == 5
    assert r.why_suggested.startswith("Selling in 4 outlets (avg 6.0/month) • Stable demand • High margin")
    assert outlet.suggestion_summary(outlet.suggest(o, s, "X", min_confidence=101)).collect()[0].total_suggestions == 0


def test_cross_recommend_only_unsold(spark):
    rows = [outlet_row(loc, s, 4.0) for loc in ("L1", "L2") for s in ("A", "B")] + [outlet_row("X", "A", 0.0), outlet_row("X", "B", 0.1)]
    o = outlets(spark, rows)
    peers = spark.createDataFrame([("L1",), ("L2",)], "location_id string")
    got = outlet.cross_recommend(o, summary(spark, [known("A")]), peers, "X").collect()
    assert [(r.stock_id, r.outlet_count, r.suggested_initial_qty) for r in got] == [("A", 2, 2.0)]


STAFF = [
    ("U1", "admin", "ADMINISTRATORS", True, "L1", ["L9"], ["n9"]), ("U2", "area_manager", " area manager ", True, "L1", ["L1", "L2", "L3"], ["a", "b"]),
    ("U3", "staff", "PIC OUTLET", True, "L2", None, None), ("U4", "staff", "CASHIER", True, "L2", None, None),
    ("U5", None, None, True, None, None, None), ("U6", "admin", "CEO", False, "L1", None, None), ("U7", "staff", "PIC OUTLET", True, None, None, None),
]


def staff(spark):
    rows = [dict(staff_id=i, role=r, pos_user_group=g, is_active=a, primary_outlet=p, primary_outlet_name=p, region="R1", allowed_outlets=ao, allowed_outlet_names=an)
            for i, r, g, a, p, ao, an in STAFF]
    return frame(spark, "staff", rows)


def test_access_groups(spark):
    st = staff(spark)
    o = outlets(spark, [outlet_row("L1", "A"), outlet_row("L2", "A"), outlet_row("L2", "B")])
    level = {r.staff_id: r.access for r in sku.access_level(st).collect()}
    assert level == {"U1": "FULL", "U2": "REGION", "U3": "OUTLET", "U4": "NONE", "U5": "NONE", "U7": "OUTLET"}
    shops = {}
    for r in sku.accessible_outlets(st, o).collect():
        shops.setdefault(r.staff_id, []).append(r.location_id)
    # the shorter of the two lists decides how many outlets an area manager gets
    assert {k: sorted(v) for k, v in shops.items()} == {"U1": ["L1", "L2"], "U2": ["L1", "L2"], "U3": ["L2"]}
    assert sorted(r[0] for r in outlet.peer_outlets(st, o, "u1", "L2").collect()) == ["L1"]  # no manager there: all others
    assert sorted(r[0] for r in outlet.peer_outlets(st, o, "U1", "L1").collect()) == ["L1", "L2", "L3"]
    assert sorted(r[0] for r in outlet.peer_outlets(st, o, "U2", "L1").collect()) == ["L2", "L3"]
    assert outlet.peer_outlets(st, o, "U3", "L1").count() == 0


def test_reviews_replay_in_time_order(spark):
    t = lambda h: datetime(2024, 6, 1, h)
    acts = [
        ("A", "APPROVE", "u", "first", t(1)), ("A", "FLAG", "v", None, t(2)), ("B", "FLAG", "v", "look", t(1)), ("B", "DISMISS", "w", None, t(3)),
        ("C", "APPROVE", "x", None, t(1)),
    ]
    actions = spark.createDataFrame(acts, "stock_id string, action string, staff_id string, notes string, at timestamp")
    s = spark.createDataFrame(
        [(k, None, None, "old", None, "NEW_ITEM") for k in "ABCD"],
        "stock_id string, reviewed_at timestamp, reviewed_by string, review_notes string, review_priority int, review_flag string",
    )
    got = {r.stock_id: (r.reviewed_by, r.review_notes, r.review_priority, r.review_flag) for r in sku.apply_reviews(s, actions).collect()}
    assert got == {"A": ("u", None, 1, "APPROVED"), "B": ("w", "look", 1, "DISMISSED"), "C": ("x", "old", None, "APPROVED"), "D": (None, "old", None, "NEW_ITEM")}


def test_purchase_lines_edges(spark):
    cols = (
        "stock_id string, stock_name string, order_uom_stock_name string, reorder_recommendation string, order_uom string, order_uom_rate double, base_uom string,"
        " current_balance double, order_up_to_level double, ams_calculated double, days_of_inventory double, ud1_code string, demand_pattern string, abc_class string,"
        " po_supplier_id string, po_supplier_source string, po_barcode string, po_barcode_source string, po_unit_price double, po_price_source string,"
        " po_price_note string, brand_description string, po_data_updated_at timestamp, po_last_generated_at timestamp, is_active boolean"
    )

    def row(k, rec="ORDER_NOW", bal=5.2, level=10.2, supplier="S1", source="X", barcode="1", price=2.0, psource="INVOICE_UOM", active=True, rate=1.0):
        return (k, k, None, rec, "PCS", rate, "PCS", bal, level, 1.0, 1.0, "NA", "STABLE", "A", supplier, source, barcode, "M", price, psource, None, "b", None, None, active)

    s = spark.createDataFrame(
        [
            row("OK"), row("FULL", bal=50.0), row("NOPRICE", price=None, psource=None), row("NOCODE", barcode=None), row("WHO", supplier=None, source=None),
            row("ANY", psource="INVOICE_ANY"), row("HOLD", rec="HOLD"), row("OPT", rec="OPTIMAL"), row("OFF", active=False),
        ],
        cols,
    )
    lines = purchasing.po_lines(s)
    got = {r.stock_id: r for r in lines.collect()}
    assert set(got) == {"OK", "NOPRICE", "NOCODE", "WHO", "ANY", "OPT"}
    assert got["OK"].order_qty == 5 and got["OK"].line_total == 10.0 and not got["OK"].has_warning  # 10.2 - 5.2 is five, not six
    assert got["NOPRICE"].warning_no_price and got["NOCODE"].warning_no_barcode and got["WHO"].warning_unknown_supplier and got["ANY"].warning_uom_mismatch
    per = {r.supplier_id: r for r in purchasing.po_suppliers(lines).collect()}
    assert per["UNKNOWN"].item_count == 1 and per["S1"].total_value == 40.0 and per["S1"].warning_count == 3
    log, items = purchasing.po_log(lines, AS_OF), purchasing.po_log_items(lines, AS_OF)
    joined = log.join(items.groupBy("po_id").agg(F.sum("line_total").alias("v")), "po_id").collect()
    assert joined and all(r.v == r.total_value for r in joined)
    assert purchasing.po_history(log, AS_OF, supplier="S1").count() == 1
    # a second order on the same day has ids of its own
    n = purchasing.next_order_no(log, AS_OF)
    again, more = purchasing.po_log(lines, AS_OF, order_no=n), purchasing.po_log_items(lines, AS_OF, order_no=n)
    assert n == 2 and purchasing.next_order_no(log.unionByName(again), AS_OF) == 3 and purchasing.next_order_no(log, AS_OF.replace(year=2000)) == 1
    assert not {r.po_id for r in log.collect()} & {r.po_id for r in again.collect()}
    assert {r.po_id for r in more.collect()} == {r.po_id for r in again.collect()}


def test_all_outlets_are_listed_whole(spark):
    o = outlets(spark, [outlet_row(f"L{i}", "A") for i in range(3)])
    assert outlet.outlet_intelligence(o, limit=1).count() == 3
    with pytest.raises(ValueError):
        outlet.outlet_intelligence(o, offset=1)


def batch(kind, qty, text, stock="A", loc="WAREHOUSE"):
    return dict(doc_type=kind, doc_id=1, location_id=loc, stock_id=stock, qty=qty, batch_remark=text)


def test_batches_do_not_multiply_and_bad_dates_drop(spark):
    lines = [batch("SUP_INVOICE", 10, "2024-07-01 x"), batch("RECEIVE", 5, "2024-07-01"), batch("TRANSIT", 3, "2024-07-01"), batch("SUP_CREDIT", 2, "2024-07-01")]
    lines += [batch("SUP_INVOICE", 1, t) for t in ("2024-02-31", "2024-13-01", "N/A", None, "2019-01-01", "2024-08-00")]
    lines += [batch("TRANSFER", 4, "2024-06-14", loc="L1"), batch("TRANSFER", 9, "2024-06-14", loc="WAREHOUSE"), batch("TRANSIT", 7, "2025-01-01")]
    T = tables(spark, [], [product("A", cost=2), product("A", "BOX", 12, cost=24)], batches=lines)
    left = {r.expiry_str: (float(r.qty), str(r.expiry_date)) for r in expiry.warehouse_batches(T).collect()}
    assert left["2024-07-01"] == (10.0, "2024-07-01") and left["2024-08-00"] == (1.0, "2024-08-28")
    assert left["2024-02-31"] == (1.0, "None") and "2025-01-01" not in left and "2019-01-01" not in left
    w = {r.expiry_window: r for r in expiry.expiry_windows(expiry.all_batches(T), AS_OF).collect()}
    assert list(w) == expiry.config.EXPIRY_WINDOWS or len(w) == 6
    assert (w["0_30_days"].warehouse_batches, w["0_30_days"].warehouse_value) == (1, 20.0)
    assert (w["expired"].outlet_units, w["expired"].total_value) == (4, 8.0) and w["over_180_days"].total_batches == 0
    risk = expiry.at_risk(expiry.expiry_windows(expiry.all_batches(T), AS_OF)).collect()[0]
    assert (risk.batches, risk.units, risk.value) == (3, 15, 30.0)
    by = {r.location_id: r for r in expiry.expiry_by_location(T, AS_OF).collect()}
    assert by["L1"].expired_units == 4 and by["WAREHOUSE"].at_risk_batches == 2
    items = expiry.expiry_items(T, AS_OF, window="30_days").collect()
    assert [(r.stock_id, r.days_until_expiry) for r in items] == [("A", 16)]


def test_display_names(spark):
    df = spark.createDataFrame([(x,) for x in ("STOCKOUT", "REVIEW", "UNKNOWN", "STOP_ORDERING", None)], "reorder_recommendation string")
    assert [r[0] for r in df.select(sku.display_recommendation()).collect()] == ["STOCKOUT", "UNCERTAIN", "UNCERTAIN", "OVERSTOCKED", None]
    assert sku.stored_recommendations("UNCERTAIN") == ["REVIEW", "UNKNOWN"] and sku.stored_recommendations("HOLD") == ["HOLD"]


def test_page_rows_follow_each_other(spark):
    o = outlets(spark, [outlet_row("L1", f"S{i}", float(i)) for i in range(9)])
    page = outlet.outlet_page(o, after_row=3, limit=2).collect()
    assert sorted((r.row_num, r.stock_id) for r in page) == [(4, "S5"), (5, "S4")]
    assert Decimal(str(page[0].outlet_ams)) > 0
