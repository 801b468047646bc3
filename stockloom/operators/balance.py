"""Balances, days on hand and stock days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.expr import count_if, days_before, dbl, lng, ratio, rnd, top, total
from stockloom.operators import facts


def locations(T) -> DataFrame:
    """BAL-1: active locations by name."""
    loc = T.location.filter(F.col("is_active") == "Y")
    return loc.select(F.col("location_id").alias("id"), "name", "address").orderBy("name", "id")


def balance_summary(T, location=None) -> DataFrame:
    """BAL-2: distinct stocks, quantity and value per location, richest first."""
    b = facts.period(facts.valued_balance(T), location=location)
    # one row per (location, stock) first, so the distinct count is a plain count
    per_stock = b.groupBy("location_id", "stock_id").agg(F.sum("balance_qty").alias("q"), F.sum("value").alias("v"))
    out = per_stock.groupBy("location_id").agg(
        lng(F.count("stock_id")).alias("sku_count"), total("q").alias("total_qty"), total("v").alias("total_value")
    )
    return facts.with_location_name(out, T).orderBy(F.desc("total_value"), "location_id")


def balance_probe(T, prefix: str) -> DataFrame:
    """BAL-3: balance rows of the stocks whose id starts with a prefix, per unit variant."""
    b = T.stock_balance.filter(F.col("stock_id").startswith(prefix))
    units = T.stock_master.filter(F.col("stock_id").startswith(prefix)).select(
        "stock_id", F.col("name").alias("stock_name"), F.col("uom_id").alias("variant_uom"), "base_uom_id"
    )
    # every balance row is listed once per unit the stock is sold in
    return b.join(units, "stock_id").select(
        "stock_id", "location_id", dbl("balance_qty").alias("balance_qty"), "stock_name", "variant_uom", "base_uom_id"
    )


def balance_total(T, stock: str) -> DataFrame:
    """BAL-3: total balance of one stock."""
    return facts.period(T.stock_balance, stock=stock).agg(total("balance_qty").alias("total_balance"))


def movement_analysis(T, as_of, location: str, days: int = 90, limit: int | None = 100) -> DataFrame:
    """MOV-1: days on hand at a location, 999 when nothing sold, longest first."""
    sold = facts.combined_sales(T, days_before(as_of, days), location=location).select("stock_id", F.col("qty").alias("sold"))
    held = facts.balance_by_stock(T, location).filter(F.col("balance_qty") > 0)
    out = (
        facts.enrich(held.join(sold, "stock_id", "left"), T)
        .withColumn("sold", F.coalesce("sold", F.lit(0)))
        .select(
            "stock_id",
            "stock_name",
            "barcode",
            dbl("balance_qty").alias("balance_qty"),
            dbl("sold").alias("qty_sold_period"),
            F.when(F.col("sold") > 0, rnd(ratio(dbl("balance_qty") * F.lit(float(days)), "sold"), 1))
            .otherwise(999.0)
            .alias("days_on_hand"),
        )
    )
    return top(out, F.desc("days_on_hand"), "stock_id", limit=limit)


def _cogs(T, as_of, days, *by):
    """Cost of cash sales since a day, optionally per key."""
    sales = facts.period(facts.cash_sales(T), days_before(as_of, days))
    return sales.groupBy(*by).agg(F.sum(F.col("unit_cost") * F.col("qty")).alias("cogs"))


def stock_days_by_location(T, as_of, days: int = 90) -> DataFrame:
    """MOV-2: stock value over daily cost of cash sales, 999 when nothing sold."""
    value = facts.valued_balance(T).groupBy("location_id").agg(F.sum("value").alias("value")).filter(F.col("value") > 0)
    out = value.join(_cogs(T, as_of, days, "location_id"), "location_id", "left")
    out = facts.with_location_name(out, T).select(
        "location_id",
        "location_name",
        rnd("value", 2).alias("stock_value"),
        rnd(F.coalesce("cogs", F.lit(0)), 2).alias("cogs_period"),
        F.when(F.col("cogs") > 0, rnd(ratio(dbl("value") * F.lit(float(days)), "cogs"), 1)).otherwise(999.0).alias("stock_days"),
    )
    return out.orderBy(F.desc("stock_days"), "location_id")


def stock_days_company(T, as_of, days: int = 90) -> DataFrame:
    """MOV-3: the same for the company as one row; 0 when nothing sold."""
    value = facts.valued_balance(T).agg(F.sum("value").alias("value"))
    cogs = _cogs(T, as_of, days).select("cogs").scalar()
    return value.withColumn("cogs", cogs).select(
        F.coalesce(dbl("value"), F.lit(0.0)).alias("total_stock_value"),
        F.coalesce(dbl("cogs"), F.lit(0.0)).alias("period_cogs"),
        F.when(F.col("cogs") > 0, rnd(ratio(dbl("value") * F.lit(float(days)), "cogs"), 1)).otherwise(0.0).alias("stock_days"),
    )
