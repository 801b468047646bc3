"""Every operator as a query over a folder of star-schema tables.

Where an operator's default window or minimum leaves almost nothing on the
test data, a wider value is passed; the values stand beside each query.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions import sets
from stockloom.functions.expr import days_before, dbl, lng, rnd
from stockloom.operators import (
    abcxyz, assortment, balance, batchlog, dashboard, expiry, facts, outlet, paging, purchasing, seasonal, sellout, sku, textindex, transfer, yoy,
)
from stockloom.plans import closed, incremental, monthly, summary
from stockloom.session import cut_lineage, fresh_folder
from stockloom.sources.catalog import SomeLines
from stockloom.sources.star import AS_OF, EXPIRY_AS_OF, StarTables
from stockloom.streaming import refresh

QUERIES = {}


def query(name):
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(StarTables(spark, sf_dir))
        return build

    return register


# --- balance, days on hand, sell-out, alerts --------------------------------

query("bal1_locations")(lambda T: balance.locations(T))
query("bal2_balance_summary")(lambda T: balance.balance_summary(T))
query("bal3_balance_probe")(lambda T: balance.balance_probe(T, "P1"))
query("bal3_balance_total")(lambda T: balance.balance_total(T, "P12"))
query("mov1_movement_analysis")(lambda T: balance.movement_analysis(T, AS_OF, "L03"))
query("mov2_stock_days_by_location")(lambda T: balance.stock_days_by_location(T, AS_OF))
query("mov3_stock_days_company")(lambda T: balance.stock_days_company(T, AS_OF))
query("sel1_sellout")(lambda T: sellout.sellout(T, AS_OF))
query("alr1_movement_alerts")(lambda T: sellout.movement_alerts(T, AS_OF))
query("alr1_movement_alerts_all")(lambda T: sellout.movement_alerts(T, AS_OF, limit=None))
query("alr2_alert_summary")(lambda T: sellout.alert_summary(sellout.movement_alerts(T, AS_OF, limit=None)))

# --- ABC-XYZ ----------------------------------------------------------------

BRANDS = ["WIDGET", "RING"]  # brand words that occur in the test product names


def _scored(T):
    return abcxyz.health_score_v1(abcxyz.abc_xyz(T, AS_OF), BRANDS)


query("abc1_abc_xyz")(lambda T: abcxyz.abc_xyz(T, AS_OF))
query("abc2_health_score")(
    lambda T: _scored(T).select(
        "stock_id", "strategic_score", "health_score",
        *[rnd(f"{c}_score", 1).alias(f"{c}_score") for c in ("profitability", "volume", "revenue", "stability", "doi")],
    )
)
query("abc3_protection")(lambda T: abcxyz.add_protection(abcxyz.abc_xyz(T, AS_OF), BRANDS).select("stock_id", "is_branded", "is_protected"))
query("abc_report")(lambda T: abcxyz.abc_report(_scored(T)))
query("abc4_distribution")(lambda T: abcxyz.abc_distribution(abcxyz.abc_xyz(T, AS_OF)))
query("abc5_matrix")(lambda T: abcxyz.abc_xyz_matrix(abcxyz.abc_xyz(T, AS_OF)))
query("abc6_delist_candidates")(lambda T: abcxyz.delist_candidates(_scored(T)))

# --- movement summary and monthly analysis ----------------------------------


def _rolled(T, base_uom=True):
    return summary.roll_up(summary.day_grain(facts.cash_sales(T), AS_OF), T, AS_OF, base_uom)


def _summary(T):
    return summary.movement_summary(T, AS_OF)


def _monthly(T):
    return monthly.monthly_analysis(_summary(T), T, AS_OF)


SCORES = ["health_score", "profitability_score", "volume_score", "revenue_score", "stability_score", "doi_score", "strategic_score"]

query("smr1_rolling_sales")(lambda T: summary.rolling_sales(T, AS_OF))
query("smr1b_rolling_sales_plain")(lambda T: summary.rolling_sales(T, AS_OF, base_uom=False))
query("smr2_sku_cv")(lambda T: summary.sku_cv(T, AS_OF))
query("smr3_max_values")(lambda T: summary.max_values(_rolled(T)))
query("smr4_company_balance")(lambda T: summary.company_balance(T).select("stock_id", dbl("balance").alias("balance")))
query("smr5_purchase_uom")(
    lambda T: summary.purchase_uom(T).select("stock_id", "order_uom", dbl("order_uom_rate").alias("order_uom_rate"), "order_uom_desc")
)
query("smr6_abc_class")(lambda T: summary.abc_class(cut_lineage(_rolled(T))))
query("smr7_movement_summary")(_summary)
query("smr7_movement_summary_plain")(lambda T: summary.movement_summary(T, AS_OF, base_uom=False))
query("smr8_health_score")(lambda T: _summary(T).select("stock_id", *SCORES))
query("smr9_summary_stats")(lambda T: summary.summary_stats(_summary(T)))
query("view1_summary")(lambda T: summary.view_summary(with_peak(_monthly(T))))
query("view1_summary_filtered")(
    lambda T: summary.view_summary(with_peak(_monthly(T)), trend="SPIKE_DOWN", risk="OVERSTOCKED", abc="A")
)
query("lpc1_last_purchase")(lambda T: summary.last_purchase(T.supplier_invoice_line))
query("lpc2_unit_cost")(
    lambda T: summary.unit_cost_fallback(summary.add_last_purchase(_summary(T), T.supplier_invoice_line), T.stock_master).select(
        "stock_id", "order_uom", "last_purchase_cost", "last_purchase_date", "last_purchase_doc", "unit_cost"
    )
)
query("mon1_monthly_pivot")(
    lambda T: monthly.monthly_pivot(T.stock_ledger, AS_OF).select("stock_id", *[dbl(m).alias(m) for m in monthly.MONTHS])
)
query("mon2_to_mon10_monthly_analysis")(_monthly)
query("mon11_monthly_stats")(lambda T: monthly.monthly_stats(_monthly(T)))
query("src9_v_monthly_sales")(lambda T: facts.v_monthly_sales(T, AS_OF))
query("src10_v_sku_intelligence")(lambda T: facts.v_sku_intelligence(_monthly(T)))


def with_peak(df):
    """peak_months is filled by another system; the test data leaves it empty."""
    return df.withColumn("peak_months", F.lit(None).cast("string"))

# --- sales facts ------------------------------------------------------------


def _doubles(df, *columns):
    return df.withColumns({c: dbl(c) for c in columns})


def _lines(df):
    return _doubles(df, "qty", "amount", "unit_cost").withColumns({"doc_no": lng("doc_no"), "item_no": lng("item_no")})


query("src1_cash_sales")(lambda T: _lines(facts.cash_sales(T)))
query("src2_invoice_sales")(lambda T: _lines(facts.invoice_sales(T)))
query("src3_combined_sales")(
    lambda T: _doubles(facts.combined_sales(T, days_before(AS_OF, 365), by=("stock_id", "location_id")), "qty", "revenue")
)
query("src4_daily_sales")(lambda T: _doubles(facts.daily_sales(T, days_before(AS_OF, 90)), "qty"))
query("src5_monthly_sales")(lambda T: _doubles(facts.monthly_sales(T), "qty"))
query("src6_base_uom")(
    lambda T: _doubles(
        facts.to_base_uom(facts.combined_sales(T, by=("stock_id", "uom_id")).drop("revenue"), T.stock_master), "qty", "base_qty"
    )
)
query("src7_base_products")(
    lambda T: facts.base_products(T, active_only=True).select("stock_id", F.col("name").alias("stock_name"), "ud1_code", dbl("cost").alias("cost"))
)
query("src8_enrich")(
    lambda T: facts.with_location_name(
        facts.enrich(_doubles(facts.combined_sales(T, by=("stock_id", "location_id")).drop("revenue"), "qty"), T, category=True), T
    )
)

# --- seasonality and year over year -----------------------------------------
# Six months (SEA-1), three years (SEA-3) and July: the test data is thin per stock.


def _text(df, *columns):
    """Month lists as text, so results compare as plain values."""
    return df.withColumns({c: F.array_join(F.transform(c, lambda m: m.cast("string")), ",") for c in columns})


def _sea1(T, limit=500):
    return seasonal.seasonal_patterns(T, AS_OF, min_months=6, limit=limit)


def _sea2(T, limit=500):
    return seasonal.seasonal_index(T, limit=limit)


def _sea3(T, limit=500):
    return seasonal.smart_cv(T, AS_OF, months=36, limit=limit)


query("sea1_seasonal_patterns")(lambda T: _text(_sea1(T), "top_3_peak_months"))
query("sea1_seasonal_patterns_all")(lambda T: _text(_sea1(T, None), "top_3_peak_months"))
query("sea1b_pattern_counts")(lambda T: seasonal.class_counts(_sea1(T, None), "seasonality_class"))
query("sea2_seasonal_index")(lambda T: _text(_sea2(T), "peak_months", "trough_months"))
query("sea2_seasonal_index_all")(lambda T: _text(_sea2(T, None), "peak_months", "trough_months"))
query("sea2b_index_counts")(lambda T: seasonal.class_counts(_sea2(T, None), "seasonality_type"))
query("sea3_smart_cv")(_sea3)
query("sea3_smart_cv_all")(lambda T: _sea3(T, None))
query("sea3b_smart_counts")(lambda T: seasonal.class_counts(_sea3(T, None), "demand_pattern"))
query("yoy1_comparison")(lambda T: yoy.yoy(T, AS_OF, month=7))
query("yoy1_comparison_all")(lambda T: yoy.yoy(T, AS_OF, month=7, limit=None))
query("yoy1b_status_counts")(lambda T: yoy.yoy_summary(yoy.yoy(T, AS_OF, month=7, limit=None)))
query("out1_outlet_maturity")(lambda T: yoy.outlet_maturity(T, AS_OF))
query("out1_maturity_counts")(lambda T: yoy.maturity_counts(yoy.outlet_maturity(T, AS_OF)))
query("lfl1_like_for_like")(lambda T: yoy.lfl(T, AS_OF, month=7))
query("lfl2_growth_metrics")(lambda T: yoy.lfl_metrics(yoy.lfl(T, AS_OF, month=7)))
query("lfl3_cohorts")(lambda T: yoy.lfl_cohorts(T, AS_OF, month=7))

# --- dashboard and assortment -----------------------------------------------

query("dsh1_stockout_rate")(lambda T: dashboard.stockout_rate(T))
query("dsh2_inventory_supply")(lambda T: dashboard.inventory_supply(T, AS_OF))
query("dsh3_turnover_gmroi")(lambda T: dashboard.turnover_gmroi(T, AS_OF))
query("dsh4_dead_stock")(lambda T: dashboard.dead_stock(T, AS_OF))
query("dsh5_short_dated")(lambda T: dashboard.short_dated(T, EXPIRY_AS_OF))
query("dsh6_scorecard")(lambda T: dashboard.scorecard(dashboard.metrics(T, AS_OF, batch_as_of=EXPIRY_AS_OF)))
query("mh1_must_have")(lambda T: assortment.must_have(T, AS_OF, min_months=3, brands=BRANDS))
query("mh2_must_have_confidence")(lambda T: assortment.must_have_confidence(assortment.must_have(T, AS_OF, min_months=3, brands=BRANDS, limit=None)))
query("ud1_stock_type_distribution")(lambda T: assortment.stock_type_distribution(T))
query("ud2_true_stockout")(lambda T: assortment.true_stockout(T))
query("tg1_therapeutic_groups")(lambda T: assortment.therapeutic_groups(T, AS_OF))
query("sr1_special_request")(lambda T: assortment.special_request(T, AS_OF))

# --- stock intelligence, reviews, access ------------------------------------


def _dates(df, *columns):
    return df.withColumns({c: F.col(c).cast("date") for c in columns})


def _sku_list(df):
    return _dates(df, "reviewed_at", "po_last_generated_at").withColumns({"safety_days": lng("safety_days"), "active_months": lng("active_months")})


query("sku1_sku_intelligence")(lambda T: _sku_list(sku.sku_intelligence(T.sku_summary)))
query("sku1_sku_intelligence_filtered")(
    lambda T: _sku_list(sku.sku_intelligence(T.sku_summary, limit=50, offset=10, recommendation="OVERSTOCKED", is_active="Y", search="ring"))
)
query("sku2_sku_counts")(lambda T: sku.sku_counts(T.sku_summary, recommendation="OVERSTOCKED", ud1="NA"))
query("sku3_display_recommendation")(
    lambda T: T.sku_summary.select("stock_id", "reorder_recommendation", sku.display_recommendation().alias("display_name"))
)
query("rv1_apply_reviews")(
    lambda T: _dates(sku.apply_reviews(T.sku_summary, T.review_actions), "reviewed_at").select(
        "stock_id", "reviewed_at", "reviewed_by", "review_notes", lng("review_priority").alias("review_priority"), "review_flag"
    )
)
query("acc1_access_level")(lambda T: sku.access_level(T.staff))
query("acc1_manager_access")(lambda T: sku.manager_access(T.staff))
query("acc2_accessible_outlets")(lambda T: sku.accessible_outlets(T.staff, T.outlet_sku))

# --- outlet level -----------------------------------------------------------


def _joined(df, *columns):
    """Outlet lists as text, so results compare as plain values."""
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def _suggest(T, limit=500):
    return outlet.suggest(T.outlet_sku, T.sku_summary, "L23", limit=limit)


query("osi1_outlet_intelligence")(lambda T: outlet.outlet_intelligence(T.outlet_sku, "L03"))
query("osi1_outlet_intelligence_all")(lambda T: outlet.outlet_intelligence(T.outlet_sku))
query("osi1_outlet_intelligence_joined")(lambda T: outlet.outlet_intelligence_joined(T.outlet_sku, T.sku_summary, "L03"))
query("osi1_joined_brand_search")(lambda T: outlet.outlet_intelligence_joined(T.outlet_sku, T.sku_summary, "L03", search="rand#1"))
query("osi2_pattern_group")(lambda T: outlet.outlet_intelligence(T.outlet_sku, "L03", demand_pattern="GROWTH"))
query("osi3_outlet_page")(lambda T: outlet.outlet_page(T.outlet_sku, after_row=100, limit=200))
query("osi4_outlet_counts")(lambda T: outlet.outlet_counts(T.outlet_sku))
query("osi5_outlet_review_counts")(lambda T: outlet.outlet_review_counts(T.outlet_sku, T.sku_summary))
query("sug1_suggestions")(lambda T: _joined(_suggest(T), "selling_outlets"))
query("sug1_all_outlets")(lambda T: _joined(outlet.suggest_all(T.outlet_sku, T.sku_summary, per_outlet=20), "selling_outlets"))
query("sug1a_category_gap")(lambda T: outlet.category_coverage(T.outlet_sku, T.sku_summary, "L23"))
query("sug2_outlet_profile")(lambda T: outlet.outlet_profile(T.outlet_sku))
query("sug3_suggestion_summary")(lambda T: outlet.suggestion_summary(_suggest(T, None)))
query("xr1_cross_recommend")(
    lambda T: _joined(
        outlet.cross_recommend(T.outlet_sku, T.sku_summary, outlet.peer_outlets(T.staff, T.outlet_sku, "U0", "L23"), "L23"),
        "selling_outlet_ids", "selling_outlet_names",
    )
)
query("xr2_peer_outlets")(lambda T: outlet.peer_outlets(T.staff, T.outlet_sku, "U2"))


# --- rotation and rebalancing -----------------------------------------------

query("rot1_rot6_tiers_and_region")(
    lambda T: transfer.positions(T.outlet_sku, T.sku_summary).select(
        "stock_id", "location_id", "region", transfer.velocity_tier(F.col("ams"), F.col("rate")).alias("velocity_tier"),
        transfer.pattern_category(F.col("pattern")).alias("pattern_category"),
    )
)
query("rot2_rot3_overstock")(
    lambda T: transfer.excess(transfer.positions(T.outlet_sku, T.sku_summary)).select(
        "stock_id", "location_id", "velocity_tier", "pattern_category", lng("doi_threshold").alias("doi_threshold"), dbl("excess_qty").alias("excess_qty")
    )
)
query("rot4_transfers_out")(lambda T: transfer.transfers_out(T.outlet_sku, T.sku_summary))
query("rot5_transfers_in")(lambda T: transfer.transfers_in(T.outlet_sku, T.sku_summary))
query("rot4_rot5_one_outlet")(lambda T: transfer.rotation(T.outlet_sku, T.sku_summary, "L03"))
query("rb1_supply_constrained")(
    lambda T: _doubles(transfer.supply_constrained(T.outlet_sku, T.sku_summary).drop("summary_rate"), "total_balance", "total_ams")
)


def _shares(T):
    return transfer.fair_share(T.outlet_sku, transfer.supply_constrained(T.outlet_sku, T.sku_summary))


query("rb2_fair_share")(
    lambda T: _shares(T).select(
        "stock_id", "location_id", "classification",
        *[rnd(c, 4).alias(c) for c in ("fair_share_qty", "fair_share_deviation", "can_donate_qty", "need_qty")],
    )
)
query("rb3_allocation")(lambda T: transfer.allocate(_shares(T)))
query("rb3_rebalance")(lambda T: transfer.rebalance(_shares(T), T.sku_summary, "L05"))

# --- purchasing -------------------------------------------------------------


def _lines_to_order(T):
    return purchasing.po_lines(T.sku_summary)


query("po1_po_lines")(lambda T: _dates(_lines_to_order(T), "po_data_updated_at", "po_last_generated_at"))
query("po2_po_suppliers")(lambda T: _dates(purchasing.po_suppliers(_lines_to_order(T)), "last_po_generated_at"))
query("po3_po_log")(lambda T: purchasing.po_log(_lines_to_order(T), AS_OF, "U1"))
query("po3_po_log_items")(lambda T: purchasing.po_log_items(_lines_to_order(T), AS_OF))
query("po3_stamp_ordered")(
    lambda T: _dates(
        purchasing.stamp_ordered(T.sku_summary, purchasing.po_log_items(_lines_to_order(T), AS_OF), AS_OF), "po_last_generated_at"
    ).select("stock_id", "po_last_generated_at")
)


def _history(T):
    lines = _lines_to_order(T)
    logs = [purchasing.po_log(lines, AS_OF - timedelta(days=n), "U1") for n in (0, 20, 45)]
    return purchasing.po_history(logs[0].unionByName(logs[1]).unionByName(logs[2]), AS_OF)


query("po4_po_history")(_history)

# --- batch expiry -----------------------------------------------------------

query("exp0_parse_batch")(
    lambda T: expiry.parse_batch(T.batch_line).select(lng("doc_id").alias("doc_id"), "stock_id", "batch_remark", "expiry_str", "expiry_date")
)
query("exp1_warehouse_batches")(
    lambda T: expiry.warehouse_batches(T).select(
        "stock_id", "expiry_str", dbl("qty").alias("remaining"), "stock_name", dbl("unit_cost").alias("unit_cost")
    )
)
query("exp2_outlet_batches")(
    lambda T: _doubles(expiry.outlet_batches(T), "qty", "unit_cost").select("stock_id", "location_id", "expiry_str", "qty", "unit_cost")
)
LOG_DAYS = [date(1998, 6, 30), date(2000, 12, 31), AS_OF]
query("exp1_balances_on_days")(lambda T: batchlog.balances_on(T.batch_log_line, LOG_DAYS).withColumn("units", dbl("units")))
query("exp1_warehouse_batches_by_log")(
    lambda T: batchlog.balances_on(T.batch_log_line.filter(F.col("location_id") == "WAREHOUSE"), [date(2099, 12, 31)]).select("stock_id", "expiry_str", dbl("units").alias("remaining"))
)
query("exp1_draw_down")(lambda T: batchlog.draw_down(T.batch_log_line, AS_OF).withColumn("units", dbl("units")))
query("exp2_lots_left")(lambda T: batchlog.lots_left(T.batch_log_line, AS_OF).select(*batchlog.BATCH, "received_on", dbl("units").alias("units"), lng("age_days").alias("age_days")))
query("exp3_expiry_windows")(lambda T: expiry.expiry_windows(expiry.all_batches(T), EXPIRY_AS_OF))
query("exp4_at_risk")(lambda T: expiry.at_risk(expiry.expiry_windows(expiry.all_batches(T), EXPIRY_AS_OF)))
query("exp5_by_location")(lambda T: expiry.expiry_by_location(T, EXPIRY_AS_OF))
query("exp6_expiry_items")(lambda T: expiry.expiry_items(T, EXPIRY_AS_OF))
query("exp6_expiry_items_expired")(lambda T: expiry.expiry_items(T, EXPIRY_AS_OF, window="expired", limit=None))
query("exp6_expiry_items_outlet")(lambda T: expiry.expiry_items(T, EXPIRY_AS_OF, location="L07", window="60_days"))

# --- stored state -----------------------------------------------------------
# One line in a hundred arrives late, after the state was stored; the results are those of all lines.


def late():
    return F.pmod(F.xxhash64("stock_id", "doc_date"), F.lit(100)) == 7


def _refreshed(T):
    """A summary stored three days earlier without the late lines, then refreshed by them and to the day."""
    state = incremental.SummaryStore(T.spark, fresh_folder(T.spark, "summary"), buckets=16)
    state.rebuild(SomeLines(T, ~late()), AS_OF - timedelta(days=3))
    state.refresh(T.sales(costed=True).filter(late()), T, AS_OF, version=2)
    return state.summary(T)


def _closed(T, kind, lines, qty):
    """Months closed in two goes without the late lines, then corrected by them; the month of AS_OF is open."""
    months = closed.ClosedMonths(T.spark, fresh_folder(T.spark, "months"), {kind: qty})
    this = AS_OF.replace(day=1)
    for version, until in ((1, this.replace(month=5)), (2, this)):
        months.close({kind: lines.filter(~late())}, until, version)
    months.correct({kind: lines.filter(late())}, 3)
    return months


def _mon1_closed(T):
    sold = T.stock_ledger.filter(F.col("doc_type").isin(config.SALES_DOC_TYPES))
    months = _closed(T, "ledger", sold, "root_uom_qty_out")
    start = AS_OF.replace(day=1).replace(year=AS_OF.year - 1)
    return monthly.pivot(months.monthly("ledger", sold, start), AS_OF).select("stock_id", *[dbl(m).alias(m) for m in monthly.MONTHS])


def _sea1_closed(T):
    months = _closed(T, "sales", T.sales(), "qty")
    ready = months.monthly("sales", T.sales(), AS_OF - timedelta(days=seasonal.HISTORY_DAYS))
    return _text(seasonal.seasonal_patterns(T, AS_OF, min_months=6, limit=None, monthly=ready), "top_3_peak_months")


def _batches(lines, reduce):
    """What five batches of lines are reduced to, side by side."""
    number = F.pmod(F.xxhash64("stock_id", "location_id", "doc_date"), F.lit(5))
    parts = [reduce(lines.filter(number == i)) for i in range(5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _days_of_batches(T):
    days = sets.union(_batches(facts.cash_sales(T, costed=False), refresh.selling_days), ["stock_id"])
    return refresh.count_days(days, AS_OF)


def _outlets_of_batches(T):
    numbers = facts.outlet_numbers(T)
    ledger = facts.period(T.stock_ledger, F.add_months(F.lit(AS_OF), -24))
    return facts.merged_monthly_sales(_batches(ledger, lambda lines: facts.month_outlets(lines, numbers)))


query("smr7_refreshed_by_change")(_refreshed)
query("mon1_closed_months")(_mon1_closed)
query("sea1_closed_months")(_sea1_closed)
query("src5_closed_months")(lambda T: _doubles(_closed(T, "sales", T.sales(), "qty").monthly("sales", T.sales()), "qty"))
query("smr1_selling_days_from_sets")(_days_of_batches)
query("src9_outlets_from_sets")(_outlets_of_batches)


def _stored_page(T):
    order = paging.OutletOrder(T.spark, fresh_folder(T.spark, "order"))
    order.rebuild(T.outlet_sku, 1)
    return order.page(after_row=100, limit=200)


def _indexed(T, needle):
    """Products by a needle in id, name or barcode, through a stored index."""
    products = facts.product_names(T)
    index = textindex.SearchIndex(T.spark, fresh_folder(T.spark, "search"), ["stock_id", "stock_name", "barcode"], buckets=16)
    index.build(products, 1)
    return index.search(products, needle)


def _many_brands(T):
    """ABC-3's brand match by a table of patterns: pieces of every fortieth product's name, and the fixed lists."""
    pieces = T.star("part").filter(F.col("p_partkey") % 40 == 0).select(F.substring(F.upper("p_name"), 2, 7).alias("pattern"))
    fixed = T.spark.createDataFrame([(b,) for b in sorted({*config.PROTECTED_BRANDS, *config.MUST_HAVE_BRANDS})], "pattern string")
    names = facts.product_names(T)
    hit = textindex.matched(names, "stock_id", "stock_name", pieces.unionByName(fixed)).withColumn("is_branded", F.lit(True))
    return names.join(hit, "stock_id", "left").select("stock_id", F.coalesce("is_branded", F.lit(False)).alias("is_branded"))


query("osi3_stored_page")(_stored_page)
query("sku1_indexed_search")(lambda T: _indexed(T, "Ring"))
query("sku1_indexed_search_short")(lambda T: _indexed(T, "9"))
query("abc3_many_brands")(_many_brands)
