"""Purchase-order lines, supplier roll-up, order log and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import count_if, day, days_before, dbl, like_text, lng, ratio, rnd, top
from stockloom.operators.sku import display_recommendation, stored_recommendations


def po_lines(s: DataFrame, recommendation=None, supplier=None, ud1=None, search=None) -> DataFrame:
    """PO-1: what to order to reach each stock's target, with data warnings."""
    # the display-only name UNCERTAIN has no stored value here and matches nothing
    wanted = config.ORDERABLE
    if recommendation:
        stored = stored_recommendations(recommendation)
        wanted = stored if len(stored) == 1 else [recommendation]
    s = s.filter(
        F.col("reorder_recommendation").isin(wanted) & F.col("is_active") & (F.col("order_up_to_level") > 0) & (F.col("order_uom_rate") > 0)
    )
    if supplier:
        s = s.filter(F.col("po_supplier_id") == supplier)
    if ud1:
        s = s.filter(F.col("ud1_code") == ud1)
    if search:
        s = s.filter(like_text(["stock_id", "stock_name"], search))
    held = rnd(ratio(F.coalesce("current_balance", F.lit(0)), "order_uom_rate"), 1)
    short = (F.col("order_up_to_level") - F.col("balance_in_order_uom")).cast("decimal(38,10)")
    s = s.withColumn("balance_in_order_uom", held).withColumn("order_qty", lng(F.ceil(short))).filter(F.col("order_qty") > 0)
    price = F.coalesce("po_unit_price", F.lit(0.0))
    no_price = F.coalesce("po_price_source", F.lit("NONE")) == "NONE"
    mismatch = F.coalesce(F.col("po_price_source") == "INVOICE_ANY", F.lit(False))
    no_barcode = F.coalesce("po_barcode", F.lit("")) == ""
    unknown = F.coalesce("po_supplier_source", F.lit("UNKNOWN")) == "UNKNOWN"
    return s.select(
        "stock_id", F.coalesce("order_uom_stock_name", "stock_name").alias("stock_name"), display_recommendation().alias("reorder_recommendation"),
        "order_uom", "order_uom_rate", "base_uom", "balance_in_order_uom", "order_up_to_level", "order_qty", "ams_calculated",
        "days_of_inventory", "ud1_code", "demand_pattern", "abc_class", "po_supplier_id", "po_supplier_source", "po_barcode", "po_barcode_source",
        price.alias("po_unit_price"), "po_price_source", "po_price_note", "brand_description", "po_data_updated_at", "po_last_generated_at",
        rnd(F.col("order_qty") * price, 2).alias("line_total"), no_price.alias("warning_no_price"), mismatch.alias("warning_uom_mismatch"),
        no_barcode.alias("warning_no_barcode"), unknown.alias("warning_unknown_supplier"), (no_price | mismatch | no_barcode | unknown).alias("has_warning"),
    ).orderBy(F.asc_nulls_last("po_supplier_id"), "reorder_recommendation", "stock_name", "stock_id")


def _money(c):
    return F.sum(F.col(c).cast("decimal(28,2)"))


def po_suppliers(lines: DataFrame) -> DataFrame:
    """PO-2: order lines per supplier, largest value first."""
    return (
        lines.groupBy(F.coalesce("po_supplier_id", F.lit("UNKNOWN")).alias("supplier_id"))
        .agg(
            lng(F.count("stock_id")).alias("item_count"), dbl(_money("line_total")).alias("total_value"), lng(F.sum("order_qty")).alias("total_qty"),
            count_if(F.col("has_warning")).alias("warning_count"), F.max("po_last_generated_at").alias("last_po_generated_at"),
        )
        .orderBy(F.desc("total_value"), "supplier_id")
    )


def _po_id(generated_at, order_no: int):
    """Supplier, day, and from the second order of a day on its number."""
    parts = [F.col("supplier_id"), F.date_format(day(generated_at), "yyyyMMdd")]
    return F.concat_ws("-", *parts, *([F.lit(str(order_no))] if order_no > 1 else []))


def next_order_no(log: DataFrame, generated_at) -> int:
    """The number to give to today's next orders: one above those that the log has of that day."""
    today = log.filter(F.col("generated_at") == day(generated_at))
    number = F.coalesce(F.regexp_extract("po_id", r"-[0-9]{8}-([0-9]+)$", 1).try_cast("int"), F.lit(1))
    return (today.agg(F.max(number).alias("n")).first()["n"] or 0) + 1


def po_log(lines: DataFrame, generated_at, staff: str = "SYSTEM", location: str = config.WAREHOUSE, order_no: int = 1) -> DataFrame:
    """PO-3: one log row per supplier order generated from the lines; its items are po_log_items.

    Orders generated later on the same day need another order_no (next_order_no), or their ids and items would meet.
    """
    return po_suppliers(lines).select(
        _po_id(generated_at, order_no).alias("po_id"), "supplier_id", day(generated_at).alias("generated_at"), F.lit(staff).alias("generated_by"),
        "item_count", "total_value", "total_qty", F.lit(location).alias("location_id"),
    )


def po_log_items(lines: DataFrame, generated_at, order_no: int = 1) -> DataFrame:
    """PO-3: the items of the logged orders, one row each, under the same order_no.

    Kept as rows by order id and not nested in the log: one supplier may hold a
    large part of all items.
    """
    named = lines.withColumn("supplier_id", F.coalesce("po_supplier_id", F.lit("UNKNOWN")))
    return named.select(_po_id(generated_at, order_no).alias("po_id"), "stock_id", "order_qty", F.col("po_unit_price").alias("unit_price"), "line_total")


def stamp_ordered(s: DataFrame, items: DataFrame, generated_at) -> DataFrame:
    """PO-3: the summary with the order date on every stock that was ordered."""
    ordered = items.select("stock_id").distinct().withColumn("ordered_at", day(generated_at).cast("timestamp"))
    return s.join(ordered, "stock_id", "left").withColumn("po_last_generated_at", F.coalesce("ordered_at", "po_last_generated_at")).drop("ordered_at")


def po_history(log: DataFrame, as_of, days: int = 30, supplier=None, limit: int | None = 100) -> DataFrame:
    """PO-4: orders of the last days, newest first."""
    rows = log.filter(F.col("generated_at") >= days_before(as_of, days))
    if supplier:
        rows = rows.filter(F.col("supplier_id") == supplier)
    return top(rows, F.desc("generated_at"), "po_id", limit=limit)
