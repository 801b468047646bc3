"""Year-over-year, outlet maturity and like-for-like growth."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.expr import count_if, day, dbl, first_match, lng, ratio, rnd, top
from stockloom.operators import facts

NEW_DAYS, RAMPING_DAYS = 90, 180


def month_pair(as_of: date, month: int | None = None):
    """((start, end) this year, (start, end) last year) of a month, ends exclusive."""
    m = month or as_of.month

    def span(year):
        return date(year, m, 1), date(year + m // 12, m % 12 + 1, 1)

    return span(as_of.year), span(as_of.year - 1)


def _two_periods(sales: DataFrame, as_of, month):
    """Only the rows of the two months, and the test for this year's."""
    this, last = month_pair(as_of, month)
    d = F.col("doc_date")
    in_this = (d >= day(this[0])) & (d < day(this[1]))
    in_last = (d >= day(last[0])) & (d < day(last[1]))
    if "month" in sales.columns:
        sales = sales.filter(F.col("month").isin(this[0], last[0]))
    return sales.filter(in_this | in_last), in_this, in_last


def yoy(T, as_of, location=None, category=None, month=None, limit: int | None = 200) -> DataFrame:
    """YOY-1: a month against the same month last year per stock, biggest change first.

    A stock with last-year sales and none now is UNDERPERFORMING: that rule is
    tested first, so NO_SALES_THIS_YEAR never appears.
    """
    sales, in_this, in_last = _two_periods(facts.period(T.sales(), location=location), as_of, month)
    pair = sales.groupBy("stock_id").agg(
        F.sum(F.when(in_this, F.col("qty")).otherwise(F.lit(0))).alias("cy"),
        F.sum(F.when(in_last, F.col("qty")).otherwise(F.lit(0))).alias("ly"),
    )
    products = facts.product_names(T, "category_id")
    if category is not None:
        pair = pair.join(products.filter(F.col("category_id") == category), "stock_id")
    else:
        pair = pair.join(products, "stock_id", "left")
    cy, ly = dbl("cy"), dbl("ly")
    out = facts.with_category(pair, T).select(
        "stock_id", "stock_name", "barcode", "category",
        ly.alias("last_year_qty"),
        cy.alias("current_year_qty"),
        dbl(F.col("cy") - F.col("ly")).alias("qty_change"),
        first_match([(ly > 0, rnd(ratio(F.col("cy") - F.col("ly"), "ly") * 100, 1)), (cy > 0, F.lit(999.0))], F.lit(0.0)).alias("yoy_change_pct"),
        yoy_status(F.col("cy"), F.col("ly")).alias("yoy_status"),
    )
    return top(out, F.desc(F.abs("qty_change")), "stock_id", limit=limit)


def yoy_status(cy, ly):
    """First rule wins; limits are exact (30 % either way)."""
    tenths = cy * 10
    return first_match(
        [
            ((ly > 0) & (tenths < ly * 7), "UNDERPERFORMING"),
            ((ly > 0) & (tenths > ly * 13), "OUTPERFORMING"),
            ((ly == 0) & (cy > 0), "NEW_THIS_YEAR"),
            ((cy == 0) & (ly > 0), "NO_SALES_THIS_YEAR"),
        ],
        "NORMAL",
    )


def yoy_summary(report: DataFrame) -> DataFrame:
    """YOY-1b: report rows per status."""
    return report.groupBy("yoy_status").agg(lng(F.count("stock_id")).alias("sku_count"))


def _first_sales(T) -> DataFrame:
    """First cash sale per location."""
    return facts.cash_sales(T, costed=False).groupBy("location_id").agg(F.min("doc_date").alias("first_sale_date"))


def outlet_maturity(T, as_of) -> DataFrame:
    """OUT-1: age since first sale and maturity; an outlet that never sold is MATURE."""
    loc = T.location.filter(F.col("is_active") == "Y").select("location_id", F.col("name").alias("location_name"))
    age = F.datediff(day(as_of), "first_sale_date")
    return (
        loc.join(_first_sales(T), "location_id", "left")
        .select(
            "location_id", "location_name", "first_sale_date", lng(age).alias("days_since_first_sale"),
            first_match([(age < NEW_DAYS, "NEW"), (age < RAMPING_DAYS, "RAMPING")], "MATURE").alias("maturity_status"),
            (~F.coalesce(age < NEW_DAYS, F.lit(False))).alias("alerts_enabled"),
        )
        .orderBy(F.desc_nulls_last("first_sale_date"), "location_id")
    )


def maturity_counts(outlets: DataFrame) -> DataFrame:
    """OUT-1: outlets per maturity status."""
    return outlets.groupBy("maturity_status").agg(lng(F.count("location_id")).alias("outlet_count"))


def lfl(T, as_of, month=None) -> DataFrame:
    """LFL-1: same-store and total revenue of a month and of the same month last year, one row."""
    sales, in_this, in_last = _two_periods(T.sales(), as_of, month)
    per = sales.groupBy("location_id").agg(
        F.sum(F.when(in_this, F.col("amount"))).alias("cy"), F.sum(F.when(in_last, F.col("amount"))).alias("ly"),
        F.count_if(in_this).alias("cn"), F.count_if(in_last).alias("ln"),
    )
    now, then = F.col("cn") > 0, F.col("ln") > 0
    money = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("double")
    return per.agg(
        money(now & then, "cy").alias("lfl_cy_revenue"),
        money(now & then, "ly").alias("lfl_ly_revenue"),
        count_if(now & then).alias("lfl_outlet_count"),
        money(now, "cy").alias("total_cy_revenue"),
        money(then, "ly").alias("total_ly_revenue"),
        count_if(now).alias("cy_outlet_count"),
        count_if(then).alias("ly_outlet_count"),
        count_if(now & ~then).alias("new_outlets_count"),
        money(now & ~then, "cy").alias("new_outlets_revenue"),
    )


def lfl_metrics(row: DataFrame) -> DataFrame:
    """LFL-2: growth like for like, per outlet and overall, and the share from new outlets."""
    growth = lambda a, b: F.coalesce(rnd(ratio(a - b, b) * 100, 1), F.lit(0.0))
    c = {n: F.col(n) for n in row.columns}
    cy_each = F.coalesce(ratio("total_cy_revenue", "cy_outlet_count"), F.lit(0.0))
    ly_each = F.coalesce(ratio("total_ly_revenue", "ly_outlet_count"), F.lit(0.0))
    return row.select(
        growth(c["lfl_cy_revenue"], c["lfl_ly_revenue"]).alias("lfl_growth_pct"),
        rnd(cy_each, 2).alias("cy_per_outlet"),
        rnd(ly_each, 2).alias("ly_per_outlet"),
        growth(cy_each, ly_each).alias("per_outlet_growth_pct"),
        growth(c["total_cy_revenue"], c["total_ly_revenue"]).alias("naive_growth_pct"),
        "new_outlets_count",
        rnd("new_outlets_revenue", 2).alias("new_outlets_revenue"),
        F.coalesce(rnd(ratio("new_outlets_revenue", "total_cy_revenue") * 100, 1), F.lit(0.0)).alias("expansion_contribution"),
    )


def lfl_cohorts(T, as_of, month=None) -> DataFrame:
    """LFL-3: cash revenue of the two months by the year an outlet opened."""
    cash = facts.cash_sales(T, costed=False)
    this, last = month_pair(as_of, month)
    d = F.col("doc_date")
    in_this = (d >= day(this[0])) & (d < day(this[1]))
    in_last = (d >= day(last[0])) & (d < day(last[1]))
    # opening year needs all history, so both come from one pass
    per = cash.groupBy("location_id").agg(
        F.year(F.min("doc_date")).alias("opening_year"),
        F.sum(F.when(in_this, F.col("amount"))).alias("cy"), F.sum(F.when(in_last, F.col("amount"))).alias("ly"),
    )
    year = F.col("opening_year")
    zero = F.lit(0)
    return (
        per.groupBy("opening_year")
        .agg(F.count("location_id").alias("n"), F.coalesce(F.sum("cy"), zero).alias("cy"), F.coalesce(F.sum("ly"), zero).alias("ly"))
        .select(
            lng(year).alias("opening_year"), lng("n").alias("outlet_count"), dbl("cy").alias("cy_revenue"), dbl("ly").alias("ly_revenue"),
            F.when(F.col("ly") > 0, rnd(ratio(F.col("cy") - F.col("ly"), "ly") * 100, 1)).alias("yoy_growth_pct"),
            first_match([(year >= as_of.year, "new"), (year >= as_of.year - 1, "ramping")], "mature").alias("cohort_status"),
        )
        .orderBy(F.desc("opening_year"))
    )
