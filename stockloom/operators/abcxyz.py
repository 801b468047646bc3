"""ABC-XYZ classification, health score and delist candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import (
    contains_any, days_before, dbl, first_match, lng, lookup, ratio, rnd, stddev_from_sums, top, total,
)
from stockloom.operators import facts, pareto
from stockloom.session import cut_lineage


def _sku_sales(T, as_of, location, months) -> DataFrame:
    """Per stock: totals and monthly moments over months * 30 days, cash and invoice.

    Sums by (stock, unit, month) first, so invoice lines meet the master cost as
    a few rows per stock.
    """
    sales = facts.period(T.sales(costed=True), days_before(as_of, months * 30), location=location)
    cash = F.col("channel") == "CASH"
    grain = sales.groupBy("stock_id", "uom_id", F.trunc("doc_date", "month").alias("month")).agg(
        F.sum("qty").alias("qty"),
        F.sum("amount").alias("revenue"),
        F.sum(F.when(cash, F.col("qty") * F.col("unit_cost"))).alias("cash_cost"),
        F.sum(F.when(~cash, F.col("qty"))).alias("invoice_qty"),
    )
    cost = T.stock_master.select("stock_id", "uom_id", F.col("cost").alias("master_cost"))
    zero = F.lit(0)
    grain = grain.join(cost, ["stock_id", "uom_id"], "left").withColumn(
        "cost",
        F.coalesce("cash_cost", zero) + F.coalesce("invoice_qty", zero) * F.coalesce("master_cost", zero),
    )
    # one exchange on the stock serves both sums below
    monthly = grain.repartition("stock_id").groupBy("stock_id", "month").agg(
        F.sum("qty").cast("decimal(18,4)").alias("qty"), F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost")
    )
    return monthly.groupBy("stock_id").agg(
        F.sum("qty").alias("total_qty"),
        F.sum("revenue").cast("decimal(28,4)").alias("total_revenue"),
        F.sum("cost").alias("total_cost"),
        F.sum(F.col("qty") * F.col("qty")).alias("qty_sq"),
        F.count("month").alias("months_with_sales"),
    )


def abc_xyz(T, as_of, location=None, months: int = 12) -> DataFrame:
    """ABC-1: revenue class by running share, demand class by month-to-month variation."""
    ranked = pareto.add_abc(cut_lineage(_sku_sales(T, as_of, location, months)), "total_revenue")
    value = facts.valued_balance(T).groupBy("stock_id").agg(F.sum("balance_qty").alias("bal"), F.sum("value").alias("value"))
    products = facts.with_category(facts.product_names(T, "category_id", "ud1_code"), T)
    avg = ratio("total_qty", "months_with_sales")
    cv = F.when(F.col("avg") > 0, ratio(stddev_from_sums(F.col("months_with_sales"), F.col("total_qty"), F.col("qty_sq")), "avg"))
    gp = F.col("total_revenue") - F.col("total_cost")
    bal = dbl(F.coalesce("bal", F.lit(0)))
    return (
        ranked.join(products, "stock_id")
        .join(value, "stock_id", "left")
        .withColumn("avg", avg)
        .withColumn("cv_raw", cv)
        .select(
            "stock_id", "stock_name", "barcode", "category", "ud1_code",
            dbl("total_qty").alias("total_qty"),
            rnd("total_revenue", 2).alias("total_revenue"),
            rnd(gp, 2).alias("gross_profit"),
            rnd(ratio(gp, "total_revenue") * 100, 1).alias("gp_margin_pct"),
            rnd("avg", 1).alias("avg_monthly_qty"),
            F.coalesce(rnd("cv_raw", 2), F.lit(0.0)).alias("cv"),
            lng("months_with_sales").alias("months_with_sales"),
            bal.alias("current_balance"),
            rnd(F.coalesce("value", F.lit(0)), 2).alias("inventory_value"),
            F.when(F.col("avg") > 0, rnd(ratio(bal * 30, "avg"), 0)).otherwise(9999.0).alias("days_of_inventory"),
            rnd(F.col("share") * 100, 2).alias("cumulative_pct"),
            rnd(ratio("total_revenue", "grand_total") * 100, 3).alias("revenue_contribution_pct"),
            "rank",
            lng("total_rows").alias("total_skus"),
            "abc_class",
            first_match([(F.col("cv_raw") < 0.5, "X"), (F.col("cv_raw") <= 1.0, "Y")], "Z").alias("xyz_class"),
        )
    )


def add_protection(abc: DataFrame, brands=None, protected_codes=None) -> DataFrame:
    """ABC-3: brand-name match and delist protection (clearance stock is not protected)."""
    brands = brands or config.PROTECTED_BRANDS
    codes = protected_codes or config.PROTECTED_CODES
    branded = F.coalesce(contains_any("stock_name", brands), F.lit(False))
    return abc.withColumn("is_branded", branded).withColumn(
        "is_protected", F.coalesce(F.col("ud1_code").isin(codes), F.lit(False)) | F.col("is_branded")
    )


def health_score_v1(abc: DataFrame, brands=None, protected_codes=None) -> DataFrame:
    """ABC-2: 0-100 score from margin, volume, revenue, stability, cover and protection."""
    a = add_protection(abc, brands, protected_codes)
    top_values = abc.agg(F.struct(F.max("total_qty").alias("qty"), F.max("total_revenue").alias("revenue")).alias("m")).scalar()
    share = lambda c: F.when(F.col(f"m.{c}") > 0, F.col(f"total_{c}") / F.col(f"m.{c}") * 100).otherwise(0.0)
    # a days-of-inventory of 0 counts as unknown, like the no-sales marker
    doi = F.when(F.col("days_of_inventory") == 0, 9999.0).otherwise(F.col("days_of_inventory"))
    return (
        a.withColumn("m", top_values)
        .withColumn("doi", doi)
        .withColumn("profitability_score", F.least(F.col("gp_margin_pct") / 60 * 100, F.lit(100.0)))
        .withColumn("volume_score", share("qty"))
        .withColumn("revenue_score", share("revenue"))
        .withColumn("stability_score", F.greatest(F.lit(0.0), F.lit(100.0) - F.col("cv") * 50))
        .withColumn(
            "doi_score",
            F.when(F.col("doi") < 9999, F.greatest(F.lit(0.0), F.lit(100.0) - F.col("doi") / 180 * 100)).otherwise(0.0),
        )
        .withColumn("strategic_score", F.when(F.col("is_protected"), 100.0).otherwise(0.0))
        .withColumn(
            "raw_score",
            F.col("profitability_score") * 0.25 + F.col("volume_score") * 0.20 + F.col("revenue_score") * 0.20
            + F.col("stability_score") * 0.15 + F.col("doi_score") * 0.10 + F.col("strategic_score") * 0.10,
        )
        .withColumn("health_score", rnd("raw_score", 1))
        .withColumn("abc_xyz", F.concat("abc_class", "xyz_class"))
        .drop("m", "doi")
    )


def abc_report(scored: DataFrame, limit: int | None = 100) -> DataFrame:
    """The classified items as reported, biggest revenue first."""
    out = scored.select(
        "stock_id", "stock_name", "barcode", "category", F.coalesce("ud1_code", F.lit("")).alias("ud1_code"),
        "abc_class", "xyz_class", "abc_xyz", "total_revenue", "gross_profit", "gp_margin_pct",
        lng("total_qty").alias("total_qty"), "cv", lng("current_balance").alias("current_balance"),
        F.when((F.col("days_of_inventory") < 9999) & (F.col("days_of_inventory") != 0), lng("days_of_inventory")).alias("days_of_inventory"),
        "health_score", "is_branded", "is_protected",
    )
    return top(out, F.desc("total_revenue"), "stock_id", limit=limit)


def abc_distribution(abc: DataFrame) -> DataFrame:
    """ABC-4: items and revenue per class, with the class's share of revenue."""
    per_class = abc.groupBy("abc_class").agg(
        lng(F.count("stock_id")).alias("sku_count"), F.sum(F.col("total_revenue").cast("decimal(28,2)")).alias("r")
    )
    return per_class.withColumn("g", F.sum("r").over(Window.partitionBy())).select(  # three rows
        "abc_class", "sku_count", dbl("r").alias("revenue"), F.coalesce(rnd(ratio("r", "g") * 100, 1), F.lit(0.0)).alias("revenue_pct")
    )


def abc_xyz_matrix(abc: DataFrame, actions=None) -> DataFrame:
    """ABC-5: all nine cells with count and action, empty cells as zero."""
    actions = actions or config.ABC_XYZ_ACTIONS
    # count each fixed cell in one aggregate row, then turn the row into nine
    cell = F.concat("abc_class", "xyz_class")
    counts = abc.agg(*[F.count_if(cell == k).cast("bigint").alias(k) for k in actions])
    cells = F.array(*[F.struct(F.lit(k).alias("abc_xyz"), F.col(k).alias("sku_count"), F.lit(v).alias("action")) for k, v in actions.items()])
    return counts.select(F.inline(cells))


def delist_candidates(scored: DataFrame, max_score: float = 30, limit: int | None = 50) -> DataFrame:
    """ABC-6: class C, erratic, unprotected and low-scoring; weakest first."""
    weak = scored.filter(
        (F.col("abc_class") == "C") & (F.col("xyz_class") == "Z") & ~F.col("is_protected") & (F.col("raw_score") < max_score)
    )
    out = weak.select("stock_id", "stock_name", "category", "ud1_code", "gp_margin_pct", "cv", "days_of_inventory", "health_score")
    return top(out, "health_score", "stock_id", limit=limit)
