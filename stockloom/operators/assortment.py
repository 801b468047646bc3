"""Assortment analyses: must-haves, stock types, therapeutic groups, special requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import contains_any, count_if, day, days_before, dbl, lng, ratio, rnd, top
from stockloom.operators import facts


def must_have(T, as_of, min_months: int = 6, max_gp: float = 40.0, brands=None, limit: int | None = 500) -> DataFrame:
    """MH-1: branded products that sell in most months at a modest margin and carry no own-brand code."""
    cash = facts.period(facts.cash_sales(T), days_before(as_of, 365))
    monthly = cash.groupBy("stock_id", F.trunc("doc_date", "month").alias("month")).agg(
        F.sum("qty").alias("q"), F.sum("amount").alias("r"), F.sum(F.col("qty") * F.col("unit_cost")).alias("c")
    )
    per = monthly.groupBy("stock_id").agg(F.count("month").alias("n"), F.sum("q").alias("q"), F.sum("r").alias("r"), F.sum("c").alias("c"))
    gp = F.when(F.col("r") > 0, ratio(F.col("r") - F.col("c"), "r") * 100).otherwise(0.0)
    per = per.filter(F.col("n") >= min_months).withColumn("gp", gp).filter(F.col("gp") < max_gp)
    products = facts.product_names(T, "category_id", "ud1_code").filter(
        (F.col("ud1_code").isNull() | ~F.col("ud1_code").isin(config.MUST_HAVE_EXCLUDED_CODES))
        & contains_any("stock_name", brands or config.MUST_HAVE_BRANDS)
    )
    out = facts.with_category(per.join(products, "stock_id"), T).select(
        "stock_id", "stock_name", "barcode", "category", F.col("ud1_code").alias("current_ud1"),
        lng("n").alias("months_sold"), rnd("q", 0).alias("annual_qty"), rnd("r", 2).alias("annual_revenue"),
        rnd("gp", 1).alias("gp_margin_pct"), F.lit("BRAND_MATCH").alias("detection_reason"),
    )
    return top(out, F.desc("annual_revenue"), "stock_id", limit=limit)


def must_have_confidence(candidates: DataFrame, min_months: int = 10) -> DataFrame:
    """MH-2: high confidence from ten months of sales."""
    return candidates.withColumn("confidence", F.when(F.col("months_sold") >= min_months, "high").otherwise("medium"))


def _active_with_balance(T) -> DataFrame:
    """Active base-unit rows with the balance kept in that unit, 0 when none."""
    held = T.stock_balance.groupBy("stock_id", "uom_id").agg(F.sum("balance_qty").alias("balance"))
    rows = facts.base_products(T, active_only=True).join(held, ["stock_id", "uom_id"], "left")
    return rows.withColumn("balance", F.coalesce("balance", F.lit(0)))


def stock_type_distribution(T) -> DataFrame:
    """UD-1: stocks, balance and value per stock type, with the share of all value."""
    rows = _active_with_balance(T).withColumn("value", F.col("balance") * F.coalesce("cost", F.lit(0)))
    everything = rows.agg(F.sum("value").alias("v")).scalar()
    per = rows.groupBy("ud1_code").agg(F.count("stock_id").alias("n"), F.sum("balance").alias("b"), F.sum("value").alias("v"))
    return (
        per.withColumn("all", everything)
        .select(
            F.coalesce("ud1_code", F.lit("NULL/EMPTY")).alias("ud1_code"), lng("n").alias("sku_count"), dbl("b").alias("total_balance"),
            rnd("v", 2).alias("inventory_value"),
            F.when(F.col("all") > 0, rnd(ratio("v", "all") * 100, 1)).otherwise(0.0).alias("value_pct"),
        )
        .orderBy(F.desc_nulls_last("inventory_value"), "ud1_code")
    )


def true_stockout(T) -> DataFrame:
    """UD-2: stock-outs among stocks meant to be held; a missing code counts as held."""
    code = F.col("ud1_code")
    stockable = code.isNull() | ~code.isin(config.NON_STOCKABLE_CODES)
    out = stockable & (F.col("balance") <= 0)
    return _active_with_balance(T).agg(
        lng(F.count("stock_id")).alias("total_active_skus"),
        count_if(stockable).alias("stockable_skus"),
        count_if(out).alias("stockout_stockable"),
        count_if(code == "SPECIAL REQUEST").alias("special_request_skus"),
        count_if(code == "DISCONTINUED").alias("discontinued_skus"),
        F.coalesce(rnd(ratio(F.count_if(out), F.count_if(stockable)) * 100, 2), F.lit(0.0)).alias("true_stockout_rate"),
    )


def therapeutic_groups(T, as_of, limit: int | None = 100) -> DataFrame:
    """TG-1: groups of several stocks with their house brands and yearly sales."""
    cash = facts.period(facts.cash_sales(T, costed=False), days_before(as_of, 365))
    sold = cash.groupBy("stock_id").agg(F.sum("qty").alias("q"), F.sum("amount").alias("r"))
    rows = facts.base_products(T, active_only=True).select("stock_id", "therapeutic_group", "ud1_code").join(sold, "stock_id", "left")
    zero = F.lit(0)
    per = rows.groupBy("therapeutic_group").agg(
        F.count("stock_id").alias("n"), F.count_if(F.col("ud1_code") == config.HOUSE_BRAND).alias("hb"),
        F.sum(F.coalesce("q", zero)).alias("q"), F.sum(F.coalesce("r", zero)).alias("r"),
    )
    out = per.filter(F.col("n") > 1).select(
        F.coalesce("therapeutic_group", F.lit("UNCLASSIFIED")).alias("therapeutic_group"), lng("n").alias("sku_count"),
        lng("hb").alias("house_brand_count"), (F.col("hb") > 0).alias("has_house_brand"), dbl("q").alias("total_sales_qty"), rnd("r", 2).alias("total_revenue"),
    )
    return top(out, F.desc_nulls_last("total_revenue"), "therapeutic_group", limit=limit)


def special_request(T, as_of, min_days: int = 180, max_monthly: float = 5, limit: int | None = 500) -> DataFrame:
    """SR-1: held stocks that hardly sell, by value tied up."""
    cash = facts.period(facts.cash_sales(T, costed=False), days_before(as_of, 365))
    per_month = cash.groupBy("stock_id", F.trunc("doc_date", "month").alias("month")).agg(F.max("doc_date").alias("d"), F.sum("qty").alias("q"))
    sold = per_month.groupBy("stock_id").agg(F.max("d").alias("last_sale_date"), F.sum("q").alias("q"), F.count("month").alias("n"))
    held = T.stock_balance.groupBy("stock_id").agg(F.sum("balance_qty").alias("balance")).filter(F.col("balance") > 0)
    products = facts.base_products(T, active_only=True).filter(
        ~F.coalesce("ud1_code", F.lit("NA")).isin(config.SPECIAL_REQUEST_EXCLUDED_CODES)
    )
    year = dbl(F.coalesce("q", F.lit(0)))
    rows = products.join(held, "stock_id").join(sold, "stock_id", "left").filter(
        (F.col("last_sale_date").isNull() | (F.col("last_sale_date") < days_before(as_of, min_days))) & (year / 12.0 < max_monthly)
    )
    out = facts.with_category(rows, T).select(
        "stock_id", F.col("name").alias("stock_name"), "barcode", F.col("ud1_code").alias("current_ud1"), "therapeutic_group", "category",
        dbl("balance").alias("current_balance"), rnd(F.col("balance") * F.col("cost"), 2).alias("inventory_value"), "last_sale_date",
        lng(F.datediff(day(as_of), "last_sale_date")).alias("days_since_sale"), year.alias("annual_qty"),
        rnd(year / 12.0, 2).alias("avg_monthly_qty"), F.coalesce(lng("n"), F.lit(0).cast("bigint")).alias("months_sold"),
    )
    return top(out, F.desc("inventory_value"), "stock_id", limit=limit)
