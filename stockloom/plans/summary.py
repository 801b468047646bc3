"""The per-stock movement summary: rebuilt in one lazy plan, then stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import (
    count_if, day, days_before, dbl, first_match, lng, lookup, ratio, rnd, stddev_from_sums, top,
)
from stockloom.operators import facts, pareto
from stockloom.session import cut_lineage

WINDOWS = (7, 14, 30, 90, 365)
MIN_CV_MONTHS = 3


def day_grain(sales: DataFrame, as_of) -> DataFrame:
    """Cash sales of the last year per (stock, unit, day): what every window is built from."""
    return facts.period(sales, days_before(as_of, 365)).groupBy("stock_id", "uom_id", "doc_date").agg(
        F.sum("qty").alias("qty"),
        F.sum("amount").alias("rev"),
        F.sum(F.col("amount") - F.col("qty") * F.col("unit_cost")).alias("gp"),
    )


def roll_up(grain: DataFrame, T, as_of, base_uom: bool = True) -> DataFrame:
    """SMR-1, SMR-1b, SMR-2: rolling windows, selling days and monthly variation per stock.

    The day grain is small next to the sales lines, so one exchange on the
    stock covers the three sums that follow it.
    """
    if base_uom:
        grain = facts.to_base_uom(grain, T.stock_master)
    else:
        grain = grain.withColumn("base_qty", F.col("qty"))
    days = grain.repartition("stock_id").groupBy("stock_id", "doc_date").agg(
        F.sum("base_qty").cast("decimal(28,4)").alias("qty"), F.sum("rev").alias("rev"), F.sum("gp").alias("gp")
    )
    since = {n: F.col("doc_date") >= days_before(as_of, n) for n in WINDOWS}
    sums = [F.sum(F.when(since[n], F.col("qty")).otherwise(F.lit(0))).alias(f"qty_{n}d") for n in WINDOWS]
    sums += [F.sum(F.when(since[n], F.col(c)).otherwise(F.lit(0))).alias(f"{c}_{n}d") for n in (7, 30, 90, 365) for c in ("rev", "gp")]
    sums += [F.count_if(since[n]).alias(f"selling_days_{n}d") for n in (30, 90)]
    months = days.groupBy("stock_id", F.trunc("doc_date", "month").alias("month")).agg(
        *sums, F.min("doc_date").alias("first_sale"), F.max("doc_date").alias("last_sale")
    )
    # the whole year of a month's days is the month's quantity
    month_qty = F.col("qty_365d").cast("decimal(18,4)")
    add_up = [f"qty_{n}d" for n in WINDOWS] + [f"{c}_{n}d" for n in (7, 30, 90, 365) for c in ("rev", "gp")]
    per_stock = months.groupBy("stock_id").agg(
        *[F.sum(c).alias(c) for c in add_up],
        *[F.sum(f"selling_days_{n}d").alias(f"selling_days_{n}d") for n in (30, 90)],
        F.min("first_sale").alias("first_sale"),
        F.max("last_sale").alias("last_sale"),
        F.count("month").alias("months"),
        F.sum(month_qty * month_qty).alias("qty_sq"),
    )
    deviation = stddev_from_sums(F.col("months"), F.col("qty_365d"), F.col("qty_sq"))
    cv = F.when((F.col("months") >= MIN_CV_MONTHS) & (F.col("qty_365d") > 0), ratio(deviation, ratio("qty_365d", "months")))
    types = {f"qty_{n}d": "decimal(28,4)" for n in WINDOWS}
    types |= {f"rev_{n}d": "decimal(28,4)" for n in (7, 30, 90, 365)}
    return per_stock.withColumn("cv", cv).select(
        "stock_id", *[F.col(c).cast(types.get(c, "decimal(38,8)")).alias(c) for c in add_up],
        "selling_days_30d", "selling_days_90d", "first_sale", "last_sale", "months", "cv",
    )


def rolling_sales(T, as_of, base_uom: bool = True) -> DataFrame:
    """SMR-1 as a report."""
    r = roll_up(day_grain(facts.cash_sales(T), as_of), T, as_of, base_uom)
    return r.select(
        "stock_id", *[dbl(c).alias(c) for c in r.columns if c[:4] in ("qty_", "rev_") or c[:3] == "gp_"],
        lng("selling_days_30d").alias("selling_days_30d"), lng("selling_days_90d").alias("selling_days_90d"), "first_sale", "last_sale",
    )


def sku_cv(T, as_of) -> DataFrame:
    """SMR-2: variation of monthly quantity, from three months on."""
    r = roll_up(day_grain(facts.cash_sales(T), as_of), T, as_of).filter(F.col("months") >= MIN_CV_MONTHS)
    return r.select("stock_id", rnd("cv", 6).alias("cv"))


def max_values(rolled: DataFrame) -> DataFrame:
    """SMR-3: largest yearly quantity and revenue, 1 when there are none."""
    return rolled.agg(
        F.coalesce(dbl(F.max("qty_365d")), F.lit(1.0)).alias("max_qty"), F.coalesce(dbl(F.max("rev_365d")), F.lit(1.0)).alias("max_rev")
    )


def company_balance(T, base_uom: bool = True) -> DataFrame:
    """SMR-4: balance per stock in base units; units the master lacks are left out."""
    if not base_uom:
        return T.stock_balance.groupBy("stock_id").agg(F.sum("balance_qty").alias("balance"))
    per_unit = T.stock_balance.groupBy("stock_id", "uom_id").agg(F.sum("balance_qty").alias("q"))
    rate = T.stock_master.select("stock_id", "uom_id", "uom_rate")
    return per_unit.join(rate, ["stock_id", "uom_id"]).groupBy("stock_id").agg(
        F.sum(F.col("q") * F.coalesce("uom_rate", F.lit(1))).cast("decimal(28,4)").alias("balance")
    )


def _most_used_unit(lines: DataFrame) -> DataFrame:
    """Unit on most lines per stock; equal counts go to the first unit by name."""
    counts = lines.groupBy("stock_id", "uom_id").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("uom_id").alias("u")))
    return counts.groupBy("stock_id").agg(best.alias("b")).select("stock_id", F.col("b.u").alias("unit"))


def purchase_uom(T) -> DataFrame:
    """SMR-5: unit to order in: most used on orders, else on supplier invoices, else the largest active."""
    base = facts.base_products(T, active_only=True).select("stock_id")
    ordered = _most_used_unit(T.purchase_order_line).withColumnRenamed("unit", "po_unit")
    invoiced = _most_used_unit(T.supplier_invoice_line).withColumnRenamed("unit", "inv_unit")
    # the units of one stock are few, so they travel as one array per stock
    unit = F.struct(
        "uom_id", F.col("uom_rate").alias("rate"), F.col("name").alias("desc"), (F.col("is_active") == "Y").alias("active")
    )
    units = T.stock_master.groupBy("stock_id").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    largest = F.element_at(
        F.array_sort(
            F.filter("units", lambda u: u.active),
            lambda a, b: first_match([(a.rate > b.rate, -1), (a.rate < b.rate, 1), (a.uom_id < b.uom_id, -1), (a.uom_id > b.uom_id, 1)], 0),
        ),
        1,
    )
    wanted = F.coalesce("po_unit", "inv_unit")
    found = F.try_element_at(F.filter("units", lambda u: u.uom_id == wanted), F.lit(1))
    return (
        base.join(ordered, "stock_id", "left").join(invoiced, "stock_id", "left").join(units, "stock_id", "left")
        .withColumn("big", largest).withColumn("hit", found)
        .select(
            "stock_id",
            F.coalesce(wanted, "big.uom_id").alias("order_uom"),
            F.coalesce("hit.rate", "big.rate", F.lit(1).cast("decimal(18,4)")).alias("order_uom_rate"),
            F.coalesce("hit.desc", "big.desc").alias("order_uom_desc"),
        )
    )


def abc_class(rolled: DataFrame) -> DataFrame:
    """SMR-6: A/B/C by running share of yearly revenue."""
    return pareto.add_abc(rolled.select("stock_id", "rev_365d"), "rev_365d").select("stock_id", "abc_class")


def add_class(rolled: DataFrame) -> DataFrame:
    """SMR-6 on the rows themselves, by the least revenue of each class; no row is moved."""
    limits = pareto.abc_limits(rolled, "stock_id", "rev_365d")
    return rolled.withColumn("limits", limits).withColumn("abc_class", pareto.class_of("rev_365d", F.col("limits"))).drop("limits")


# --- SMR-7 columns ----------------------------------------------------------
# Comparisons stay in whole decimals (q7/7 > q30/30 * 1.5 as q7*30 > q30*7*1.5),
# so a value exactly on a boundary falls on the right side.


def _factor(x: str):
    return F.lit(x).cast("decimal(4,2)")


def trend_status(q7, q30, q90):
    """SMR-7a: week's daily rate against the month's."""
    week, month = q7 * 30, q30 * 7
    return first_match(
        [
            ((q30 == 0) & (q90 == 0), "DEAD"),
            (week > month * _factor("1.5"), "SPIKE_UP"),
            (week > month * _factor("1.2"), "ACCELERATING"),
            (week < month * _factor("0.5"), "SPIKE_DOWN"),
            (week < month * _factor("0.8"), "DECELERATING"),
        ],
        "STABLE",
    )


def stockout_risk(balance, q30):
    """SMR-7b: by days of cover; 45 to 90 days, and no sales, are both UNKNOWN."""
    sells = q30 > 0
    cover = lambda n: q30 * n  # noqa: E731  balance * 30 against n days of sales
    stock = balance * 30
    return first_match(
        [
            (balance <= 0, "STOCKOUT"),
            (sells & (stock <= cover(7)), "CRITICAL"),
            (sells & (stock <= cover(14)), "WARNING"),
            (sells & (stock <= cover(45)), "OK"),
            (sells & (stock > cover(90)), "OVERSTOCKED"),
        ],
        "UNKNOWN",
    )


def xyz_label(cv):
    return first_match([(cv < 0.5, "X"), (cv <= 1.0, "Y")], "Z")


def health_score_v2(df: DataFrame) -> DataFrame:
    """SMR-8: six component scores and their weighted sum.

    least/greatest skip NULL, so cover scores 0 for a stock without recent sales.
    """
    margin = F.coalesce(F.col("margin"), F.lit(0.0))
    hundred = F.lit(100.0)
    return (
        df.withColumn("s_profit", F.least(margin / 60 * 100, hundred))
        .withColumn("s_volume", ratio("qty_365d", "max_qty") * 100)
        .withColumn("s_revenue", ratio("rev_365d", "max_rev") * 100)
        .withColumn("s_stable", F.least((F.lit(1.0) - F.coalesce("cv", F.lit(1.0))) * 100, hundred))
        .withColumn("s_cover", F.greatest(hundred - F.col("cover") / 90 * 100, F.lit(0.0)))
        .withColumn("s_strategic", lookup("ud1_code", config.STRATEGIC_SCORES, config.STRATEGIC_DEFAULT).cast("double"))
        .withColumn(
            "s_health",
            F.col("s_profit") * 0.25 + F.col("s_volume") * 0.20 + F.col("s_revenue") * 0.20
            + F.col("s_stable") * 0.15 + F.col("s_cover") * 0.10 + F.col("s_strategic") * 0.10,
        )
    )


def movement_summary(T, as_of, base_uom: bool = True, grain: DataFrame | None = None, rolled: DataFrame | None = None) -> DataFrame:
    """SMR-7: one wide row per active stock.

    The rolled-up frame (one row per stock) feeds the maxima, the class limits and the summary
    itself, so it is materialised once. A ready day grain can be passed in, or a ready
    rolled-up frame, as the stored refresh does; nothing runs while the query is built then.
    """
    if rolled is None:
        rolled = cut_lineage(roll_up(day_grain(facts.cash_sales(T), as_of) if grain is None else grain, T, as_of, base_uom))
    peak = max_values(rolled).agg(F.struct(F.max("max_qty").alias("q"), F.max("max_rev").alias("r")).alias("m")).scalar()
    products = facts.base_products(T, active_only=True)
    brand = T.brand.select("brand_id", F.col("description").alias("brand"))
    df = (
        products.join(add_class(rolled), "stock_id", "left")
        .join(company_balance(T, base_uom), "stock_id", "left")
    )
    if base_uom:
        df = df.join(purchase_uom(T), "stock_id", "left")
    else:
        df = df.withColumns({"order_uom": F.col("base_uom_id"), "order_uom_desc": F.col("name"), "order_uom_rate": F.lit(1).cast("decimal(18,4)")})
    df = facts.with_category(df, T).join(brand, "brand_id", "left")
    zeroed = [c for c in rolled.columns if c.startswith(("qty_", "rev_", "gp_"))] + ["selling_days_30d", "selling_days_90d", "balance"]
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zeroed}).withColumn("m", peak)
    q7, q30, q90, bal = F.col("qty_7d"), F.col("qty_30d"), F.col("qty_90d"), F.col("balance")
    df = df.withColumns({
        "max_qty": F.col("m.q"),
        "max_rev": F.col("m.r"),
        "margin": F.when(F.col("rev_365d") > 0, ratio("gp_365d", "rev_365d") * 100).otherwise(0.0),
        "cover": ratio(dbl("balance") * 30, "qty_30d"),
        "order_uom_rate": F.coalesce("order_uom_rate", F.lit(1)),
        "xyz_class": xyz_label(F.col("cv")),
    })
    df = health_score_v2(df)
    in_order_units = lambda x: rnd(ratio(x, "order_uom_rate"), 0)
    return df.select(
        "stock_id", F.col("name").alias("stock_name"), "barcode", "category", "brand", "ud1_code", "therapeutic_group",
        F.col("therapeutic_group").alias("product_family"), "active_ingredient", dbl("cost").alias("unit_cost"),
        *[dbl(f"qty_{n}d").alias(f"qty_last_{n}d") for n in WINDOWS],
        *[rnd(ratio(f"qty_{n}d", F.lit(n)), 2).alias(f"avg_daily_{n}d") for n in (7, 14, 30, 90)],
        lng("selling_days_30d").alias("selling_days_30d"), lng("selling_days_90d").alias("selling_days_90d"),
        rnd(ratio(dbl(q7 * 30 - q30 * 7) * 100, q30 * 7), 1).alias("trend_7d_vs_30d"),
        trend_status(q7, q30, q90).alias("trend_status"),
        "abc_class", "xyz_class", rnd("cv", 2).alias("cv_value"),
        F.concat_ws("", "abc_class", "xyz_class").alias("abc_xyz_class"),
        rnd("s_health", 1).alias("health_score"), rnd("s_profit", 1).alias("profitability_score"),
        rnd("s_volume", 1).alias("volume_score"), rnd("s_revenue", 1).alias("revenue_score"),
        rnd("s_stable", 1).alias("stability_score"), rnd("s_cover", 1).alias("doi_score"),
        F.col("s_strategic").alias("strategic_score"),
        *[rnd(f"rev_{n}d", 2).alias(f"revenue_last_{n}d") for n in (30, 90, 365)],
        *[rnd(f"gp_{n}d", 2).alias(f"gp_last_{n}d") for n in (30, 90, 365)],
        rnd("margin", 1).alias("gp_margin_pct"),
        F.col("base_uom_id").alias("base_uom"), F.col("name").alias("base_uom_desc"),
        F.coalesce("order_uom", "base_uom_id").alias("order_uom"),
        F.coalesce("order_uom_desc", "name").alias("order_uom_desc"),
        dbl("order_uom_rate").alias("order_uom_rate"),
        in_order_units("balance").alias("balance_in_order_uom"),
        dbl("balance").alias("current_balance"),
        rnd(bal * F.coalesce("cost", F.lit(0)), 2).alias("inventory_value"),
        F.coalesce(rnd("cover", 0), F.lit(9999.0)).alias("days_of_inventory"),
        stockout_risk(bal, q30).alias("stockout_risk"),
        # a fortnight's lead with half as much again in reserve, and a month's supply
        in_order_units(dbl(q30 * 21) / 30).alias("suggested_reorder_point"),
        in_order_units("qty_30d").alias("suggested_reorder_qty"),
        F.col("last_sale").alias("last_sale_date"), F.col("first_sale").alias("first_sale_date"),
        day(as_of).alias("last_updated"),
    )


def summary_stats(summary: DataFrame) -> DataFrame:
    """SMR-9: headline counts of a rebuilt summary."""
    return summary.agg(
        lng(F.count("stock_id")).alias("total_skus"),
        count_if(F.col("trend_status") == "SPIKE_UP").alias("spike_up"),
        count_if(F.col("trend_status") == "SPIKE_DOWN").alias("spike_down"),
        count_if(F.col("stockout_risk") == "CRITICAL").alias("stockout_critical"),
        count_if(F.col("stockout_risk") == "WARNING").alias("stockout_warning"),
    )


VIEW_COLUMNS = [
    "stock_id", "stock_name", "barcode", "ud1_code", "abc_xyz_class", "qty_last_7d", "qty_last_30d",
    "avg_daily_30d", "trend_status", "trend_7d_vs_30d", "health_score", "gp_margin_pct", "base_uom",
    "base_uom_desc", "order_uom", "order_uom_desc", "order_uom_rate", "balance_in_order_uom",
    "current_balance", "days_of_inventory", "stockout_risk", "suggested_reorder_qty", "reorder_point",
    "target_doi", "revenue_last_30d", "therapeutic_group", "ams_3m", "velocity_category",
    "lead_time_category", "lead_time_days", "seasonality_type", "seasonal_peak_trough_ratio",
    "peak_months", "reorder_recommendation", *[f"qty_m{i}" for i in range(1, 13)],
]


def view_summary(summary: DataFrame, trend=None, risk=None, abc=None, ud1=None, limit: int | None = 50) -> DataFrame:
    """VIEW-1: browse the summary by equality filters, best recent revenue first."""
    wanted = {"trend_status": trend, "stockout_risk": risk, "abc_class": abc, "ud1_code": ud1}
    for column, value in wanted.items():
        if value:
            summary = summary.filter(F.col(column) == value)
    return top(summary.select(*VIEW_COLUMNS), F.desc_nulls_last("revenue_last_30d"), "stock_id", limit=limit)


def last_purchase(invoices: DataFrame) -> DataFrame:
    """LPC-1: latest paid price per (stock, unit); same-day documents go to the highest id, then price."""
    latest = F.max(F.struct("doc_date", "doc_id", "unit_price"))
    return (
        invoices.filter(F.col("unit_price") > 0).groupBy("stock_id", "uom_id").agg(latest.alias("l"))
        .select(
            "stock_id", "uom_id",
            dbl("l.unit_price").alias("last_purchase_cost"), F.col("l.doc_date").alias("last_purchase_date"),
            F.col("l.doc_id").cast("string").alias("last_purchase_doc"),
        )
    )


def add_last_purchase(summary: DataFrame, invoices: DataFrame) -> DataFrame:
    """LPC-1 on the summary: the purchase in each stock's order unit."""
    lp = last_purchase(invoices).withColumnRenamed("uom_id", "order_uom")
    return summary.join(lp, ["stock_id", "order_uom"], "left")


def unit_cost_fallback(summary: DataFrame, master: DataFrame) -> DataFrame:
    """LPC-2: unit cost from the last purchase, else the reference cost, else the average."""
    ref = master.filter(F.col("reference_cost") > 0).select("stock_id", F.col("uom_id").alias("order_uom"), dbl("reference_cost").alias("ref_cost"))
    return (
        summary.join(ref, ["stock_id", "order_uom"], "left")
        .withColumn("unit_cost", F.coalesce("last_purchase_cost", "ref_cost", "unit_cost"))
        .drop("ref_cost")
    )
