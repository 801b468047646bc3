"""Seasonality: variation classes, seasonal index, promotion-aware variation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom import config
from stockloom.functions.expr import days_before, dbl, first_match, lng, lookup, ratio, rnd, stddev_from_sums, top
from stockloom.operators import facts

HISTORY_DAYS = 730
PEAK_INDEX, TROUGH_INDEX = 1.3, 0.7


def _calendar(monthly: DataFrame) -> DataFrame:
    """Monthly rows to one row per (stock, calendar month): at most twelve a stock.

    Month sums are few per stock, so one exchange on the stock serves this sum
    and the next.
    """
    return monthly.repartition("stock_id").groupBy("stock_id", F.month("month").alias("month_num")).agg(
        F.sum("qty").alias("s"),
        F.sum(F.col("qty").cast("decimal(18,4)") * F.col("qty").cast("decimal(18,4)")).alias("q"),
        F.count("month").alias("n"),
        F.min("qty").alias("lo"),
        F.max("qty").alias("hi"),
    )


def _per_stock(monthly: DataFrame) -> DataFrame:
    """Monthly moments per stock with the (at most twelve) calendar-month means as an array."""
    by_month = _calendar(monthly).withColumn("mean", ratio("s", "n"))
    return by_month.groupBy("stock_id").agg(
        F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.collect_list(F.struct("month_num", "mean")).alias("means"),
    )


def month_list(entries) -> F.Column:
    return F.transform(entries, lambda e: e.month_num)


def _by_mean(entries, descending=True):
    """Calendar months by their mean; equal means by month number."""
    sign = -1 if descending else 1
    keyed = F.transform(entries, lambda e: F.struct((e.mean * sign).alias("k"), e.month_num.alias("month_num")))
    return F.sort_array(keyed)


def seasonal_patterns(T, as_of, min_months: int = 12, cv_threshold: float = 0.5, limit: int | None = 500, monthly: DataFrame | None = None) -> DataFrame:
    """SEA-1: variation class over two years, with the three strongest calendar months.

    Ready month sums of the two years can be passed in, as plans.closed gives them.
    """
    monthly = facts.monthly_sales(T, days_before(as_of, HISTORY_DAYS)) if monthly is None else monthly
    st = _per_stock(monthly).filter(F.col("n") >= min_months)
    st = st.withColumn("avg", ratio("s", "n")).withColumn("dev", stddev_from_sums(F.col("n"), F.col("s"), F.col("q")))
    st = st.withColumn("cv", ratio("dev", "avg"))
    out = facts.enrich(st, T, category=True).select(
        "stock_id", "stock_name", "barcode", "category",
        lng("n").alias("months_with_sales"),
        rnd("avg", 2).alias("avg_monthly_qty"),
        rnd("dev", 2).alias("stddev_monthly"),
        rnd("cv", 3).alias("coefficient_of_variation"),
        first_match([(F.col("cv") > cv_threshold, "HIGH_VARIANCE"), (F.col("cv") > 0.3, "MEDIUM_VARIANCE")], "LOW_VARIANCE").alias("seasonality_class"),
        dbl("lo").alias("min_monthly"),
        dbl("hi").alias("max_monthly"),
        rnd(ratio("hi", "lo"), 1).alias("peak_to_trough_ratio"),
        F.slice(month_list(_by_mean("means")), 1, 3).alias("top_3_peak_months"),
    )
    return top(out, F.desc_nulls_last("coefficient_of_variation"), "stock_id", limit=limit)


def class_counts(report: DataFrame, column: str) -> DataFrame:
    """SEA-1b, SEA-2b, SEA-3b: rows of a report per class."""
    return report.groupBy(column).agg(lng(F.count("stock_id")).alias("sku_count"))


def seasonal_index(T, stock=None, min_months: int = 18, limit: int | None = 500) -> DataFrame:
    """SEA-2: calendar-month mean over overall mean, all history, and the range of that index."""
    st = _per_stock(facts.monthly_sales(T, stock=stock)).filter(F.col("n") >= min_months)
    st = st.withColumn("avg", ratio("s", "n"))
    index = F.transform("means", lambda e: F.struct(
        e.month_num.alias("month_num"), F.when(F.col("avg") > 0, F.try_divide(e.mean, F.col("avg"))).otherwise(1.0).alias("mean")
    ))
    st = st.withColumn("idx", index)
    values = F.transform("idx", lambda e: e.mean)
    st = st.withColumn("hi", F.array_max(values)).withColumn("lo", F.array_min(values))
    st = st.withColumn("span", F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).otherwise(F.col("hi")))
    products = facts.product_names(T, "category_id")
    out = facts.with_category(st.join(products, "stock_id"), T).select(
        "stock_id", "stock_name", "barcode", "category",
        rnd("hi", 2).alias("peak_index"),
        rnd("lo", 2).alias("trough_index"),
        rnd("span", 2).alias("seasonal_range"),
        first_match([(F.col("span") > 3.0, "HIGHLY_SEASONAL"), (F.col("span") >= 1.5, "MODERATELY_SEASONAL")], "STABLE").alias("seasonality_type"),
        month_list(_by_mean(F.filter("idx", lambda e: e.mean > PEAK_INDEX))).alias("peak_months"),
        month_list(_by_mean(F.filter("idx", lambda e: e.mean < TROUGH_INDEX), descending=False)).alias("trough_months"),
    )
    return top(out, F.desc("seasonal_range"), "stock_id", limit=limit)


def smart_cv(T, as_of, stock=None, months: int = 12, min_months: int = 6, limit: int | None = 500) -> DataFrame:
    """SEA-3: is the variation of cash sales promotional, seasonal or erratic?

    A day counts as promotional when any of its lines was.
    """
    sales = facts.period(facts.cash_sales(T, costed=False), days_before(as_of, months * 30), stock=stock)
    days = sales.groupBy("stock_id", "doc_date").agg(F.sum("qty").alias("qty"), F.bool_or("has_promo").alias("promo"))
    clean = F.sum(F.when(~F.col("promo"), F.col("qty")).otherwise(F.lit(0)))
    per_month = days.repartition("stock_id").groupBy("stock_id", F.trunc("doc_date", "month").alias("month")).agg(
        F.sum("qty").cast("decimal(18,4)").alias("q"), clean.cast("decimal(18,4)").alias("c"), F.bool_or("promo").alias("promo")
    )
    st = per_month.groupBy("stock_id").agg(
        F.count("month").alias("n"),
        F.sum("q").alias("sq"), F.sum(F.col("q") * F.col("q")).alias("qq"),
        F.sum("c").alias("sc"), F.sum(F.col("c") * F.col("c")).alias("cc"),
        F.count_if("promo").alias("promo_months"), F.max("q").alias("hi"), F.min("q").alias("lo"),
    ).filter(F.col("n") >= min_months)

    def cv(s, q):
        mean = ratio(s, "n")
        return F.when(mean > 0, ratio(stddev_from_sums(F.col("n"), F.col(s), F.col(q)), mean))

    st = st.withColumns({"base": cv("sq", "qq"), "clean": cv("sc", "cc"), "swing": F.coalesce(ratio("hi", "lo"), F.lit(1.0))})
    base, clean_cv, swing = F.col("base"), F.col("clean"), F.col("swing")
    varied = base > config.VARIED
    kind = first_match(
        [
            (base.isNull(), "INSUFFICIENT_DATA"), (varied & (clean_cv < config.PROMO_FREE), "PROMO_DRIVEN"), (varied & (swing > config.PEAK_TO_TROUGH), "TRUE_SEASONAL"),
            (base > config.ERRATIC, "ERRATIC"), (base > config.MODERATE, "MODERATE_VARIABILITY"),
        ],
        "STABLE",
    )
    out = facts.with_category(st.join(facts.product_names(T, "category_id"), "stock_id"), T).select(
        "stock_id", "stock_name", "barcode", "category",
        rnd(ratio("sq", "n"), 1).alias("avg_monthly_qty"),
        F.coalesce(rnd(base, 2), F.lit(0.0)).alias("base_cv"),
        F.coalesce(rnd(clean_cv, 2), F.lit(0.0)).alias("clean_cv"),
        lng("n").alias("month_count"),
        lng("promo_months").alias("promo_months"),
        rnd(ratio("promo_months", "n") * 100, 0).alias("promo_frequency_pct"),
        rnd(swing, 1).alias("peak_trough_ratio"),
        kind.alias("demand_pattern"),
        lookup(kind, config.VARIATION_ADVICE, config.VARIATION_DEFAULT_ADVICE).alias("recommendation"),
        F.coalesce(rnd(base, 9), F.lit(0.0)).alias("sort_cv"),
    )
    return top(out, F.desc("sort_cv"), "stock_id", limit=limit).drop("sort_cv")
