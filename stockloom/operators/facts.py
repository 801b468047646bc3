"""Sales facts: document joins, combined sales, grains, unit conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions import sets
from stockloom.functions.expr import day, first_match, lng, steps_below, total


def join_document(detail: DataFrame, header: DataFrame, key) -> DataFrame:
    """Detail lines with their header's columns (both sides shuffle on the document key)."""
    return detail.join(header, key, "inner")


def cash_sales(T, costed: bool = True) -> DataFrame:
    """SRC-1: cash lines with their own line cost."""
    return T.sales(costed).filter(F.col("channel") == "CASH")


def invoice_sales(T) -> DataFrame:
    """SRC-2: invoice lines; these carry no cost, so it comes from the master by (stock, unit)."""
    cost = T.stock_master.select("stock_id", "uom_id", F.col("cost").alias("master_cost"))
    return (
        T.sales()
        .filter(F.col("channel") == "INVOICE")
        .drop("unit_cost")
        .join(cost, ["stock_id", "uom_id"], "left")
        .withColumn("unit_cost", F.coalesce("master_cost", F.lit(0).cast("decimal(18,4)")))
        .drop("master_cost")
    )


def period(df: DataFrame, start=None, end=None, location=None, stock=None, date_col="doc_date") -> DataFrame:
    """Rows from start (inclusive) to end (exclusive), optionally of one location or stock.

    A fact stored by month is also filtered on its month, so older folders are
    not even listed.
    """
    by_month = "month" in df.columns
    if start is not None:
        df = df.filter(F.col(date_col) >= start)
        if by_month:
            df = df.filter(F.col("month") >= F.trunc(start, "month"))
    if end is not None:
        df = df.filter(F.col(date_col) < end)
        if by_month:
            df = df.filter(F.col("month") < end)
    if location is not None:
        df = df.filter(F.col("location_id") == location)
    if stock is not None:
        df = df.filter(F.col("stock_id") == stock)
    return df


def combined_sales(T, start=None, end=None, location=None, stock=None, by=("stock_id",)) -> DataFrame:
    """SRC-3: cash and invoice quantity and revenue together, summed by key.

    Both channels sit in one scan; the map-side combine collapses hot keys
    before anything is shuffled.
    """
    sales = period(T.sales(), start, end, location, stock)
    return sales.groupBy(*by).agg(F.sum("qty").alias("qty"), F.sum("amount").alias("revenue"))


def daily_sales(T, start=None, location=None, stock=None, per_location=True) -> DataFrame:
    """SRC-4: quantity per stock, day and (optionally) location."""
    keys = ["stock_id", "location_id", "doc_date"] if per_location else ["stock_id", "doc_date"]
    return combined_sales(T, start, None, location, stock, keys).drop("revenue")


def monthly_sales(T, start=None, stock=None) -> DataFrame:
    """SRC-5: quantity per stock and calendar month."""
    sales = period(T.sales(), start, None, None, stock)
    return sales.groupBy("stock_id", F.trunc("doc_date", "month").alias("month")).agg(F.sum("qty").alias("qty"))


def to_base_uom(df: DataFrame, master: DataFrame, qty="qty") -> DataFrame:
    """SRC-6: quantity in base units; an unknown unit counts as rate 1.

    Feed it rows already summed by (stock, unit): the conversion is linear, and
    a hot stock is then a handful of rows when it reaches the join.
    """
    rate = master.select("stock_id", "uom_id", "uom_rate")
    return (
        df.join(rate, ["stock_id", "uom_id"], "left")
        .withColumn("base_qty", F.col(qty) * F.coalesce("uom_rate", F.lit(1).cast("decimal(18,4)")))
        .drop("uom_rate")
    )


def base_products(T, active_only=False) -> DataFrame:
    """SRC-7: one master row per stock, the base unit's."""
    m = T.stock_master.filter(F.col("uom_id") == F.col("base_uom_id"))
    if active_only:
        m = m.filter(F.col("is_active") == "Y")
    return m


def product_names(T, *extra) -> DataFrame:
    """Name and barcode per stock from the base-unit row."""
    return base_products(T).select("stock_id", F.col("name").alias("stock_name"), "barcode", *extra)


def enrich(df: DataFrame, T, category=False, extra=()) -> DataFrame:
    """SRC-8: add product name, barcode and category description by stock."""
    names = product_names(T, *extra, *(["category_id"] if category else []))
    out = df.join(names, "stock_id", "left")
    return with_category(out, T) if category else out


def with_category(df: DataFrame, T) -> DataFrame:
    cat = T.category.select("category_id", F.col("description").alias("category"))
    return df.join(cat, "category_id", "left").drop("category_id")


def with_location_name(df: DataFrame, T) -> DataFrame:
    loc = T.location.select("location_id", F.col("name").alias("location_name"))
    return df.join(loc, "location_id", "left")


def balance_by_stock(T, location=None) -> DataFrame:
    """Balance per stock, over one location or all."""
    b = T.stock_balance
    if location is not None:
        b = b.filter(F.col("location_id") == location)
    return b.groupBy("stock_id").agg(F.sum(F.coalesce("balance_qty", F.lit(0))).alias("balance_qty"))


def valued_balance(T) -> DataFrame:
    """Balance rows with their value at the cost of the same (stock, unit)."""
    cost = T.stock_master.select("stock_id", "uom_id", "cost")
    return T.stock_balance.join(cost, ["stock_id", "uom_id"], "left").select(
        "stock_id",
        "uom_id",
        "location_id",
        F.coalesce("balance_qty", F.lit(0)).alias("balance_qty"),
        (F.coalesce("balance_qty", F.lit(0)) * F.coalesce("cost", F.lit(0))).alias("value"),
    )


def v_monthly_sales(T, as_of, months=24) -> DataFrame:
    """SRC-9: ledger sales per stock, unit and month over two years."""
    led = period(T.stock_ledger, F.add_months(day(as_of), -months)).filter(F.col("doc_type").isin(config.SALES_DOC_TYPES))
    # outlets first: the distinct count then needs no row expansion
    per_outlet = led.groupBy("stock_id", "uom_id", F.trunc("doc_date", "month").alias("sale_month"), "location_id").agg(
        F.sum("qty_out").alias("q"), F.sum(F.col("qty_out") * F.col("unit_price")).alias("r")
    )
    return per_outlet.groupBy("stock_id", F.col("uom_id").alias("stock_uom_id"), "sale_month").agg(
        total("q").alias("total_quantity"),
        total("r").alias("total_revenue"),
        lng(F.count("location_id")).alias("outlets_sold"),
    )


def outlet_numbers(T) -> DataFrame:
    """A number for each outlet, by which sets of outlets are kept; outlets are few."""
    return T.location.select("location_id", (F.row_number().over(Window.orderBy("location_id")) - 1).alias("outlet_no"))


def month_outlets(ledger: DataFrame, numbers: DataFrame) -> DataFrame:
    """SRC-9 of a batch of ledger lines in a form that adds up: sums, and the outlets as a set, per stock, unit, month and set word."""
    sold = ledger.filter(F.col("doc_type").isin(config.SALES_DOC_TYPES)).join(numbers, "location_id", "left")
    # a word of a set is one row; the sums of the lines whose outlets it holds go with it
    return sold.groupBy("stock_id", "uom_id", F.trunc("doc_date", "month").alias("sale_month"), sets.word(F.col("outlet_no")).alias("word")).agg(
        F.sum("qty_out").alias("q"), F.sum(F.col("qty_out") * F.col("unit_price")).alias("r"), F.bit_or(sets.bit(F.col("outlet_no").cast("long"))).alias("bits")
    )


def merged_monthly_sales(batches: DataFrame) -> DataFrame:
    """SRC-9 from the month_outlets of many batches: an outlet that sold in several counts once."""
    united = batches.groupBy("stock_id", "uom_id", "sale_month", "word").agg(F.sum("q").alias("q"), F.sum("r").alias("r"), F.bit_or("bits").alias("bits"))
    return united.groupBy("stock_id", F.col("uom_id").alias("stock_uom_id"), "sale_month").agg(
        total("q").alias("total_quantity"), total("r").alias("total_revenue"), sets.members().alias("outlets_sold")
    )


def v_sku_intelligence(summary: DataFrame) -> DataFrame:
    """SRC-10: the summary under report names, with margin band and house-brand flag."""
    return summary.select(
        "stock_id", "stock_name", "barcode", "category", "brand", "ud1_code",
        "abc_class", "xyz_class", "abc_xyz_class", "cv_value",
        F.col("gp_margin_pct").alias("margin_pct"),
        first_match(
            [(F.col("gp_margin_pct").isNull(), config.MARGIN_CATEGORIES[-1][1])],
            steps_below("gp_margin_pct", config.MARGIN_CATEGORIES),
        ).alias("margin_category"),
        F.col("revenue_last_365d").alias("l12m_revenue"),
        F.col("qty_last_365d").alias("l12m_quantity"),
        F.col("gp_last_365d").alias("l12m_gross_profit"),
        F.col("revenue_last_90d").alias("l3m_revenue"),
        F.col("qty_last_90d").alias("l3m_quantity"),
        "avg_daily_30d",
        F.col("current_balance").alias("current_stock_qty"),
        F.col("days_of_inventory").alias("days_of_stock"),
        F.col("stockout_risk").alias("stock_status"),
        F.col("trend_status").alias("sales_trend"),
        F.col("trend_7d_vs_30d").alias("trend_pct"),
        "ams_3m", "seasonality_type", "velocity_category", "lead_time_category",
        F.col("reorder_recommendation").alias("recommended_action"),
        F.coalesce(F.col("ud1_code") == config.HOUSE_BRAND, F.lit(False)).alias("is_house_brand"),
        "last_updated",
    )
